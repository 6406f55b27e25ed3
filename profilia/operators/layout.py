"""A map of profiles from their neighbour graph: fuzzy weights, a start from the graph's spectrum, then attraction along edges and
repulsion of random pairs.

The layout follows the published method: weights from local scales, a curve fitted to the least distance, edges drawn in proportion to
their weight, several random repulsions for each draw, a falling step. Edges are dealt into parts by their head, at most EDGES of one
head to a part; in a round a task moves the heads of its block's parts, one after the other, through several epochs, with the tails of
other parts where the round found them, and positions are exchanged and checkpointed between rounds: all of them to each block of edges (see
blocks.py). Coordinates are seeded and don't depend on tasks, partitions or blocks, but equal no other implementation's.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ManifoldConfig
from . import clusters
from .blocks import blocks
from .lineage import cut
from .preprocess import numbered
from .spectral import eigenvectors

#: Heads of a part (a divisor of blocks.UNIT), edges of one head in a part, vertices that repulsion draws from in a round (all, if there are no more).
HEADS, EDGES, DRAWN = 1024, 1 << 15, 8192
#: In an epoch a head moves at most so often; its further edges are averaged into these moves.
TURNS = 32
_STEP_LIMIT = 4.0


def fit_curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a, b of 1 / (1 + a d^2b), by least squares to the curve that is 1 up to min_dist and falls exponentially beyond (damped Gauss-Newton)."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    rest = lambda p: 1 / (1 + np.exp(p[0]) * x ** (2 * p[1])) - y  # noqa: E731  (the logarithm of a keeps it positive)
    p, damping = np.array([0.0, 1.0]), 1e-3
    for _ in range(200):
        f = 1 / (1 + np.exp(p[0]) * x ** (2 * p[1]))
        slope = -f * (1 - f)
        jacobian = np.stack([slope, slope * 2 * np.log(x)], 1)
        normal, gradient = jacobian.T @ jacobian, jacobian.T @ (f - y)
        step = np.linalg.solve(normal + damping * np.diag(np.diag(normal)), gradient)
        if np.square(rest(p - step)).sum() <= np.square(rest(p)).sum():
            p, damping = p - step, damping / 3
            if np.abs(step).max() < 1e-12:
                break
        else:
            damping *= 4
    return float(np.exp(p[0])), float(p[1])


def fuzzy_graph(edges: DataFrame, k: int) -> DataFrame:
    """(i, j, d) -> i, j, w both ways: exponential weights at a local scale, joined as a + b - ab."""

    @F.pandas_udf("double")
    def scale(ds: pd.Series) -> pd.Series:
        if not len(ds):
            return pd.Series([], dtype=float)
        d, begins = np.concatenate(ds.to_list()).astype(float), np.concatenate(([0], np.cumsum([len(x) for x in ds])[:-1]))
        sizes = np.diff(np.append(begins, len(d)))
        least = np.minimum.reduceat(np.where(d > 0, d, np.inf), begins)
        over = np.maximum(0, d - np.repeat(np.where(np.isfinite(least), least, 0.0), sizes))
        lo, hi = np.full(len(begins), 1e-6), np.full(len(begins), 1e3)
        for _ in range(60):
            mid = (lo + hi) / 2
            short = np.add.reduceat(np.exp(-over / np.repeat(mid, sizes)), begins) < math.log2(k)
            lo, hi = np.where(short, mid, lo), np.where(short, hi, mid)
        return pd.Series(hi)

    local = edges.groupBy("i").agg(F.collect_list("d").alias("ds"), F.coalesce(F.min(F.when(F.col("d") > 0, F.col("d"))), F.lit(0.0)).alias("rho")).select("i", "rho", scale("ds").alias("sigma"))
    w = edges.join(local, "i").select("i", "j", F.exp(-F.greatest(F.lit(0.0), F.col("d") - F.col("rho")) / F.col("sigma")).alias("w"))
    back = w.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("u"))
    a, b = F.coalesce("w", F.lit(0.0)), F.coalesce("u", F.lit(0.0))
    return w.join(back, ["i", "j"], "full").select("i", "j", (a + b - a * b).alias("w"))


def move(p: np.ndarray, heads: np.ndarray, tails: np.ndarray, every: np.ndarray, others: np.ndarray, own: np.ndarray, epochs: range, total: int, curve: tuple[float, float], negatives: int, rng: np.random.Generator) -> None:
    """Moves the rows `heads` of p in place through `epochs`; edges, in order of their heads, are due once in `every` epochs.

    others: places that repel; own: for each row of p its place among them, or -1: nothing repels itself, and what moves here repels from where it is.
    """
    a, b = curve
    others = others.copy()
    for e in epochs:
        due = np.flatnonzero(np.floor(e / every) > np.floor((e - 1) / every))
        if not len(due):
            continue
        rate = 1 - e / total
        begins = np.concatenate(([True], heads[due][1:] != heads[due][:-1]))
        rank = np.arange(len(due)) - np.maximum.accumulate(np.where(begins, np.arange(len(due)), 0))
        for turn in range(min(TURNS, int(rank.max()) + 1)):
            at = due[rank % TURNS == turn]
            h = heads[at]
            d = p[h] - p[tails[at]]
            d2 = np.square(d).sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                pull = np.where(d2 > 0, -2 * a * b * d2 ** (b - 1) / (1 + a * d2**b), 0.0)
            step = 2 * np.clip(pull[:, None] * d, -_STEP_LIMIT, _STEP_LIMIT)  # once for the edge and once for the one that leads back
            drawn = rng.integers(0, len(others), (len(at), negatives))
            d = p[h][:, None] - others[drawn]
            d2 = np.square(d).sum(2)
            push = np.where((d2 > 0) & (drawn != own[h][:, None]), 2 * b / ((0.001 + d2) * (1 + a * d2**b)), 0.0)
            step += np.clip(push[:, :, None] * d, -_STEP_LIMIT, _STEP_LIMIT).sum(1)
            if len(h) == 1 or (h[1:] != h[:-1]).all():
                p[h] += rate * step
            else:
                some, first, n = np.unique(h, return_index=True, return_counts=True)
                p[some] += rate * np.add.reduceat(step, first) / n[:, None]
            h = h[own[h] >= 0]
            others[own[h]] = p[h]


def _lots(a: np.ndarray, heads: int, most: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The part of each of a block's edges (a: heads, in order), and what tells each part apart: its first head's place and 0, or a head with more than `most` edges and the number of its share."""
    lot = (a // heads).astype(np.int64)
    names = [(int(part), 0) for part in range(int(lot[-1]) + 1)] if len(a) else []
    begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(a)), bool), a[1:] != a[:-1])))
    sizes = np.diff(np.append(begins, len(a)))
    for begin, size in zip(begins[sizes > most], sizes[sizes > most], strict=True):
        shares = -(-int(size) // most)
        lot[begin : begin + size] = len(names) + np.arange(size) % shares
        names += [(int(a[begin]), share + 1) for share in range(shares)]
    return lot, names


def scaled(start: DataFrame, names: list[str], seed: int) -> DataFrame:
    """start with each coordinate, after a slight seeded shift, stretched to 0..10 (0 where all are equal), to five places.

    The rounding takes away what the order of sums leaves in the start, so that reruns agree.
    """
    limits = start.agg(*[F.max(F.abs(c)).alias(f"m{c}") for c in names]).first()
    noise = lambda c: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(c)), F.lit(1 << 30)) / float(1 << 30) * 1e-4
    wide = start.select("id", *[(F.col(c) * (10 / limits[f"m{c}"] if limits[f"m{c}"] else 0.0) + noise(c)).alias(c) for c in names])
    edge = wide.agg(*[F.min(c).alias(f"l{c}") for c in names], *[F.max(c).alias(f"h{c}") for c in names]).first()
    return wide.select("id", *[F.round((F.col(c) - edge[f"l{c}"]) * (10 / (edge[f"h{c}"] - edge[f"l{c}"]) if edge[f"h{c}"] > edge[f"l{c}"] else 0.0), 5).alias(c) for c in names])


def layout(graph: DataFrame, start: DataFrame, cfg: ManifoldConfig = ManifoldConfig(), together: int = 20, negatives: int = 5) -> DataFrame:
    """graph (i, j, w; symmetric) and start (id, a column for each of cfg.n_components coordinates) -> the same columns after all epochs.

    cfg.epochs None means 500 up to 10,000 vertices and 200 beyond. `together` epochs make a round, all of
    them if there is one part only. Vertices without edges only keep their
    start; an empty start gives an empty map.
    """
    names = [c for c in start.columns if c != "id"]
    if len(names) != cfg.n_components:
        raise ValueError(f"the start has {len(names)} coordinates, the settings say {cfg.n_components}")
    start = cut(start)
    n = start.count()
    if not n:
        return start
    total = cfg.epochs or (500 if n <= 10_000 else 200)
    curve = fit_curve(cfg.min_dist)
    ids = cut(numbered(start.select("id"), "id", "k"))
    most = graph.agg(F.max("w")).first()[0] or 1.0
    kept = graph.where((F.col("i") != F.col("j")) & (F.col("w") >= most / total))
    edges = kept.join(ids.select(F.col("id").alias("i"), F.col("k").alias("a")), "i").join(ids.select(F.col("id").alias("j"), F.col("k").alias("b")), "j").select("a", "b", "w")
    b = blocks(edges, F.lit(most) / F.col("w"), n)  # an edge is due once in so many epochs
    parts, shares, seed = HEADS, EDGES, cfg.seed
    drawn_at_most, heads, dims = DRAWN, b.heads, len(names)
    try:
        pos = b.packed(scaled(start, names, seed).join(ids, "id"), names)
        if n <= parts and (edges.groupBy("a").count().agg(F.max("count")).first()[0] or 0) <= shares:
            together = total  # a lone part has nothing to exchange
        for begin in range(0, total, together):
            epochs = range(max(begin, 1), min(begin + together, total))

            def run(block: int, edges: tuple, x: np.ndarray) -> list:
                a, tails, every = edges
                p = np.ascontiguousarray(x.T)
                # all vertices repel, or about as many as DRAWN of them, other ones in each round
                ks = np.flatnonzero(np.random.default_rng([seed, begin]).random(n) < drawn_at_most / n) if n > drawn_at_most else np.arange(n)
                first = block * heads
                own = min(heads, n - first)
                placed, edges_of = np.zeros((own, dims)), np.bincount(a, minlength=own)
                lot, named = _lots(a, parts, shares)
                order = np.argsort(lot, kind="stable")
                for part, at in enumerate(np.split(order, np.searchsorted(lot[order], np.arange(1, len(named))))):
                    if not len(at):
                        continue
                    k, place = np.unique(np.concatenate((a[at].astype(np.int64) + first, tails[at].astype(np.int64))), return_inverse=True)
                    q = p[k]
                    among = np.minimum(np.searchsorted(ks, k), len(ks) - 1)
                    nth, share = named[part]
                    draws = np.random.default_rng([seed, begin, nth + (first // parts if not share else first), share])
                    move(q, place[: len(at)], place[len(at) :], every[at], p[ks], np.where(ks[among] == k, among, -1), epochs, total, curve, negatives, draws)
                    moved, some = np.unique(a[at], return_counts=True)
                    # a head whose edges are in several parts goes to the mean of its places, weighed by edges
                    placed[moved] += q[np.searchsorted(k, moved.astype(np.int64) + first)] * (some / edges_of[moved])[:, None]
                return [block, np.where(edges_of > 0, placed.T, x[:, first : first + own]).astype("<f8").tobytes()]

            pos = cut(b.meet(pos, run, "block long, x binary"))
        return cut(b.unpacked(pos, names).join(ids, "k").select("id", *names))
    finally:
        b.release()


def spectral_start(graph: DataFrame, points: DataFrame, cfg: ManifoldConfig = ManifoldConfig(), tol: float = 1e-4) -> DataFrame:
    """id and cfg.n_components coordinates: the graph's first eigenvectors, or where it is disconnected the first components of points (id, v)."""
    names = clusters.axes(cfg.n_components)
    found, _, _ = eigenvectors(graph, cfg.n_components, cfg.seed, tol)
    if found is None:
        return clusters.pca_map(points, cfg.n_components)[0]
    return found.select(F.col("i").alias("id"), *[F.col(f"v{c}").alias(x) for c, x in enumerate(names)])


def manifold_map(neighbours: DataFrame, points: DataFrame, cfg: ManifoldConfig = ManifoldConfig()) -> DataFrame:
    """neighbours (i, j, d: cfg.n_neighbors of each id) and points (id, v) -> id and cfg.n_components coordinates."""
    graph = cut(fuzzy_graph(neighbours, cfg.n_neighbors))
    return layout(graph, spectral_start(graph, points, cfg), cfg)
