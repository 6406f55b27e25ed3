"""A graph's edges in blocks of heads that meet the values of all vertices: a pass shuffles the values only, packed, and never the edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut

#: Heads that a block holds a multiple of, heads of a block at most, blocks wanted as far as that allows.
UNIT, MOST, WANTED = 1024, 1 << 16, 12


def _keys(spark: SparkSession, count: int) -> list[int]:
    """A key for each of `count` blocks; repartition(count) deals each to a partition of its own."""
    place = F.pmod(F.hash("id"), F.lit(count))
    found = {r["place"]: r["id"] for r in spark.range(64 * count).groupBy(place.alias("place")).agg(F.min("id").alias("id")).collect()}  # a row for each block
    return [found.get(b, -1 - b) for b in range(count)]


@dataclass
class Blocks:
    """Vertices 0 .. n - 1, `heads` to a block, and a row of packed edges for each block (key, block, a, b, w; a within the block), in order of a and b."""

    n: int
    heads: int
    keys: list[int]
    edges: DataFrame

    def size(self, block: int) -> int:
        return min(self.heads, self.n - block * self.heads)

    def packed(self, values: DataFrame, names: list[str]) -> DataFrame:
        """values (k and the columns `names`) -> block, x: the columns of each block one after the other, as doubles."""

        def pack(key: tuple, t: pa.Table) -> pa.Table:
            order = np.argsort(t.column("k").to_numpy())
            x = np.stack([t.column(c).to_numpy()[order] for c in names])
            return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([x.astype("<f8").tobytes()], pa.binary())], names=["block", "x"])

        rows = values.select(F.floor(F.col("k") / self.heads).alias("block"), "k", *names)
        return cut(rows.groupBy("block").applyInArrow(pack, "block long, x binary"))

    def made(self, make: Callable, kind: str = "<f8") -> DataFrame:
        """block, x: the columns, of the type `kind`, that make(block, its size) gives."""
        n, heads = self.n, self.heads

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch.column("block").to_pylist():
                    x = make(block, min(heads, n - block * heads)).astype(kind)
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["block", "x"])

        return cut(self.edges.select("block").mapInArrow(rows, "block long, x binary"))

    def unpacked(self, values: DataFrame, names: list[str], then: Callable = lambda block, x: x, kind: str = "<f8") -> DataFrame:
        """block, x (columns of the type `kind`) -> k and the columns `names`, a row for each vertex; then(block, x) may turn the columns."""
        heads = self.heads

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    block = batch.column("block")[i].as_py()
                    x = then(block, np.frombuffer(batch.column("x")[i].as_buffer(), kind))
                    x = x.reshape(len(names), -1)
                    yield pa.RecordBatch.from_arrays([pa.array(block * heads + np.arange(x.shape[1])), *[pa.array(c, pa.float64()) for c in x]], names=["k", *names])

        return values.select("block", "x").mapInArrow(rows, ", ".join(["k long", *[f"{c} double" for c in names]]))

    def meet(self, values: DataFrame, kernel: Callable, schema: str, kind: str = "<f8") -> DataFrame:
        """kernel(block, (a, b, w), x) on each block's edges and the values of all vertices (block, x: columns of the type `kind`) -> a row.

        A task holds one block's edges and all values; the values are sent once for each block.
        """
        names = [c.split()[0] for c in schema.split(", ")]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            block = left.column("block")[0].as_py()
            edges = tuple(np.frombuffer(left.column(c)[0].as_buffer(), t) for c, t in (("a", "<u4"), ("b", "<u4"), ("w", "<f8")))
            order = np.argsort(right.column("block").to_numpy())
            x = [np.frombuffer(right.column("x")[int(r)].as_buffer(), kind).reshape(-1, self_size(int(nth))) for nth, r in enumerate(order)]
            row = kernel(block, edges, np.concatenate(x, axis=1))
            return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, (types[c.split()[1]] for c in schema.split(", ")), strict=True)], names=names)

        types = {"long": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
        n, heads = self.n, self.heads
        self_size = lambda block: min(heads, n - block * heads)
        sent = values.selectExpr(f"explode(array({', '.join(f'{k}L' for k in self.keys)})) as key", "block", "x").repartition(len(self.keys), "key")
        return self.edges.groupBy("key").cogroup(sent.groupBy("key")).applyInArrow(run, schema)

    def connected(self) -> bool:
        """Whether there is a path between any two vertices (edges lead both ways): labels fall to the least one around and jump to their label's label, until they stand."""
        n, heads = self.n, self.heads

        def kernel(block: int, edges: tuple, x: np.ndarray) -> list:
            a, b, _ = edges
            label = x[0].astype(np.int64)
            while (label[label] != label).any():
                label = label[label]
            own = label[block * heads : min(n, (block + 1) * heads)].copy()
            if len(a):
                begins = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
                own[a[begins]] = np.minimum(own[a[begins]], np.minimum.reduceat(label[b], begins))
            moved = float((own != x[0, block * heads : block * heads + len(own)]).sum())
            return [block, own.astype("<f8").tobytes(), [moved, float(own.max())]]

        labels = self.made(lambda block, size: block * heads + np.arange(size, dtype=float))
        while True:
            labels = cut(self.meet(labels, kernel, "block long, x binary, state array<double>"))
            state = np.array([r["state"] for r in labels.select("state").collect()])  # a row for each block
            if not state[:, 1].any():
                return True
            if not state[:, 0].any():
                return False

    def release(self) -> None:
        self.edges.unpersist()


def blocks(edges: DataFrame, w: Column, n: int) -> Blocks:
    """edges (a, b: numbers of vertices below n) and the value w of each, in blocks that depend on n only; a block without edges has a row too."""
    spark = edges.sparkSession
    heads = min(MOST, max(UNIT, -(-n // WANTED)))
    heads = -(-heads // UNIT) * UNIT
    count = -(-n // heads)
    keys = _keys(spark, count)

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        a, b, w = (t.column(c).to_numpy() for c in ("a", "b", "w"))
        keep = b >= 0
        a, b, w = a[keep], b[keep], w[keep]
        order = np.lexsort((b, a))
        block = key[0].as_py()
        data = [(a[order] - block * heads).astype("<u4"), b[order].astype("<u4"), w[order].astype("<f8")]
        return pa.Table.from_arrays([pa.array([v], pa.int64()) for v in (keys[block], block)] + [pa.array([x.tobytes()], pa.binary()) for x in data], names=["key", "block", "a", "b", "w"])

    rows = edges.select(F.floor(F.col("a") / heads).alias("block"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), w.cast("double").alias("w"))
    none = spark.range(count).select(F.col("id").alias("block"), F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(0.0).alias("w"))
    packed = cut(rows.union(none).groupBy("block").applyInArrow(pack, "key long, block long, a binary, b binary, w binary"))
    return Blocks(n, heads, keys, packed.repartition(count, "key").persist())
