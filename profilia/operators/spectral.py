"""The first eigenvectors of a graph's normalised Laplacian, by filtered subspace iteration over blocks of edges.

The block of vectors is a table with a packed row for each block of vertices; the driver sees only its small Gram matrices. A product
of the weighted adjacency with the vectors sends them to every block of edges (see blocks.py), so a whole polynomial, written as a product of
linear factors, is one chain of passes between two checkpoints. The polynomial is small on the unwanted part of the spectrum and one at
its upper end. All works on u = D^-1/2 x, for which D^-1/2 W D^-1/2 becomes D^-1 W: degrees are then sums of a block's own edges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Blocks, blocks
from .lineage import cut
from .preprocess import numbered

#: Vectors beyond the wanted ones; they widen the gap that the filter works on.
GUARD = 4
#: Residuals from which on vectors are sent, and kept, in single precision; their products and residuals are taken in double.
COARSE = 1e-5


def _walk(edges: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """D^-1 W x for the heads of a block, a row for each vector, and the heads' degrees."""
    a, b, w = edges
    begins = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))  # every vertex has an edge
    degree = np.add.reduceat(w, begins)
    return np.stack([np.add.reduceat(w * c[b], begins) for c in x]) / degree, degree


def _drawn(seed: int, turn: int, block: int, count: int, size: int) -> np.ndarray:
    return np.random.default_rng([seed, turn, block]).random((count, size)) - 0.5


def _own(b: Blocks, block: int) -> slice:
    return slice(block * b.heads, block * b.heads + b.size(block))


def _filtered(b: Blocks, values: DataFrame, root: float, kind: str, mix: np.ndarray | None, redrawn: tuple[int, int, int]) -> DataFrame:
    """(D^-1 W - root) / (1 - root) times the vectors, which mix turns before and `redrawn` (seed, turn, how many) completes."""
    shape = Blocks(b.n, b.heads, b.keys, None)  # sizes only

    def kernel(block: int, edges: tuple, x: np.ndarray) -> list:
        if mix is not None:
            seed, turn, more = redrawn
            x = mix.T @ x
            if more:
                x = np.concatenate((x, np.concatenate([_drawn(seed, turn, k, more, shape.size(k)) for k in range(len(shape.keys))], axis=1)))
        y, _ = _walk(edges, x)
        return [block, ((y - root * x[:, _own(shape, block)]) / (1 - root)).astype(kind).tobytes()]

    return b.meet(values, kernel, "block long, x binary", kind)


def _measured(b: Blocks, values: DataFrame, kind: str, seed: int) -> DataFrame:
    """block, x (its vectors), gram: the block's share of the inner products of x with x, with the product and of the product with itself, and of x with fixed numbers."""
    shape = Blocks(b.n, b.heads, b.keys, None)

    def kernel(block: int, edges: tuple, x: np.ndarray) -> list:
        y, degree = _walk(edges, x)
        own = x[:, _own(shape, block)].astype(float)
        side = own * np.sqrt(degree) @ _drawn(seed, 1 << 20, block, 1, own.shape[1])[0]
        return [block, own.astype(kind).tobytes(), np.concatenate([(own * degree @ own.T).ravel(), (own * degree @ y.T).ravel(), (y * degree @ y.T).ravel(), side])]

    return cut(b.meet(values, kernel, "block long, x binary, gram array<double>", kind))


def _factors(degree: int, high: float) -> list[float]:
    """Roots of the Chebyshev polynomial on [-1, high], in an order that keeps partial products moderate."""
    roots = list((high - 1) / 2 + (high + 1) / 2 * np.cos(np.pi * (np.arange(degree) + 0.5) / degree))
    order = [roots.pop(int(np.argmin(roots)))]
    while roots:
        far = [np.log(np.abs(r - np.array(order)) + 1e-300).sum() for r in roots]
        order.append(roots.pop(int(np.argmax(far))))
    return order


def _grams(z: DataFrame, p: int) -> tuple[np.ndarray, ...]:
    """The matrices of inner products x.x, x.y and y.y of the vectors and their product, and those of x with fixed numbers."""
    whole = sum(np.array(r["gram"]) for r in z.select("block", "gram").orderBy("block").collect())  # a row for each block
    return *whole[: 3 * p * p].reshape(3, p, p), whole[3 * p * p :]


def _ritz(xx: np.ndarray, xy: np.ndarray, yy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, largest first, their vectors in the block's basis, and the residual norms."""
    unit = 1 / np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1))  # the filter leaves columns of very different lengths
    size, basis = np.linalg.eigh(xx * unit[:, None] * unit)
    keep = size > 1e-10
    whiten = unit[:, None] * basis[:, keep] / np.sqrt(size[keep])
    inner = whiten.T @ xy @ whiten
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    value, v = value[::-1], (whiten @ vector)[:, ::-1]
    square = np.einsum("ik,ij,jk->k", v, yy, v) - 2 * value * np.einsum("ik,ij,jk->k", v, (xy + xy.T) / 2, v) + value**2 * np.einsum("ik,ij,jk->k", v, xx, v)
    return value, v, np.sqrt(np.maximum(square, 0))


def eigenvectors(graph: DataFrame, count: int, seed: int = 43, tol: float = 1e-4, degree: int = 16, rounds: int = 40) -> tuple[DataFrame | None, np.ndarray, np.ndarray]:
    """graph (i, j, w) -> (i, v0, v1, ...), the eigenvalues of I - D^-1/2 W D^-1/2 and the residual norms of the `count` vectors after the first.

    The weights are positive and symmetric. The vectors have length one; the residual |Lx - cx| of each is at most tol, or what `rounds`
    rounds have reached. None where the graph is disconnected (or has too few vertices for `count` vectors), as the eigenvalue 0 is then
    a multiple one and says nothing about a component's shape.
    """
    p = count + 1 + GUARD
    ids = cut(numbered(graph.select("i").distinct(), "i", "k"))
    n = ids.count()
    if n <= count:
        return None, np.zeros(0), np.zeros(0)
    edges = graph.join(ids.select("i", F.col("k").alias("a")), "i").join(ids.select(F.col("i").alias("j"), F.col("k").alias("b")), "j")
    b = blocks(edges.select("a", "b", "w"), F.col("w"), n)
    kind = "<f4" if tol >= COARSE else "<f8"
    try:
        if not b.connected():  # numbers close to 1 would tell too, but late
            return None, np.zeros(0), np.zeros(0)
        # the first eigenvector is known, the same number everywhere; within the block it keeps the others from falling together with it
        start = lambda block, size: np.concatenate((np.ones((1, size)), _drawn(seed, 1 << 21, block, p - 1, size)))
        values = b.made(start, kind)
        for turn in range(rounds):
            z = _measured(b, values, kind, seed)
            *grams, side = _grams(z, p)
            value, v, residual = _ritz(*grams)
            if len(value) <= count:
                return None, 1 - value[1:], residual[1:]
            wanted = slice(1, count + 1)
            if value[1] > 1 - 1e-9:
                return None, 1 - value[wanted], residual[wanted]
            if residual[wanted].max() <= tol or turn == rounds - 1:
                break
            high = float(np.clip(value[-1], -0.9, 1 - 1e-6))
            values = z
            for nth, root in enumerate(_factors(degree, high)):  # vectors that fell together are drawn anew
                values = _filtered(b, values, root, kind, None if nth else v, (seed, turn, p - len(value)))
        turned = v[:, wanted] * np.where(v[:, wanted].T @ side < 0, -1.0, 1.0)  # an eigenvector has no sign of its own
        names = [f"v{c}" for c in range(count)]
        out = cut(b.unpacked(z, names, lambda block, x: turned.T @ x.reshape(p, -1), kind).join(ids, "k").join(graph.groupBy("i").agg(F.sum("w").alias("deg")), "i"))
        return out.select("i", *[(F.col(c) * F.sqrt("deg")).alias(c) for c in names]), 1 - value[wanted], residual[wanted]
    finally:
        b.release()
