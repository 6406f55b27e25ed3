"""Exact nearest neighbours through a metric index, so that most pairs of blocks are never formed where vectors cluster.

Vectors belong to the cell of the nearest of some pivots, and cells are cut into rings by distance from the pivot. By the triangle
inequality a ring with radii lo..hi holds nothing nearer to x than lo - d(x, pivot) or d(x, pivot) - hi, and nothing farther than
d(x, pivot) + hi. A search first bounds the k-th distance of each query from the rings' sizes, then meets the query's own block,
which lowers the bound, and at last only the rings that the bound leaves. Pivots and rings are bounded in number whatever the
rows; blocks are parts of rings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .neighbors import nearest

#: Pivots at most, rings of a cell at most.
PIVOTS, RINGS = 1024, 8


@dataclass(frozen=True)
class Rings:
    """Pivots (pivot, coordinate) and of each ring its pivot's number, radii and rows; the rings of a cell are successive."""

    pivots: np.ndarray
    cell: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    rows: np.ndarray

    def distances(self, v: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(np.square(v - p).sum(1)) for p in self.pivots], 1) if len(v) else np.zeros((0, len(self.pivots)))

    def at_least(self, d: np.ndarray) -> np.ndarray:
        """Distances to pivots -> what the distance to any member of each ring is at least."""
        d = d[:, self.cell]
        return np.maximum(0, np.maximum(d - self.hi, self.lo - d))

    def bound(self, d: np.ndarray, k: int) -> np.ndarray:
        """Distances to pivots -> what the distance to the k-th nearest vector is at most; infinity if there are fewer than k."""
        far = d[:, self.cell] + self.hi
        order = np.argsort(far, axis=1)
        enough = np.cumsum(self.rows[order], axis=1) >= k
        at = enough.argmax(1)
        found = np.take_along_axis(far, np.take_along_axis(order, at[:, None], 1), 1)[:, 0]
        return np.where(enough.any(1), found, np.inf)


def slackened(x: np.ndarray) -> np.ndarray:
    """Bounds with room for rounding, of the bounds themselves and of distances to nine places."""
    return x + 1e-7 + 1e-9 * np.abs(x)


def pivots_of(vectors: DataFrame, n: int) -> np.ndarray:
    """About n vectors, at most PIVOTS, drawn by the hash of their ids."""
    drawn = vectors.select("v").orderBy(F.xxhash64("id")).limit(min(PIVOTS, max(1, n))).collect()
    return np.unique(np.array([r["v"] for r in drawn], float), axis=0)


def _with_cells(vectors: DataFrame, pivots: np.ndarray, id_type: str) -> DataFrame:
    """id, v, cell, r: the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column("v").to_pylist(), float).reshape(b.num_rows, -1)
            best, cell = np.full(len(v), np.inf), np.zeros(len(v), np.int32)
            for p, at in enumerate(pivots):
                d = np.sqrt(np.square(v - at).sum(1)) if len(v) else best
                cell, best = np.where(d < best, p, cell), np.minimum(d, best)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell, pa.int32()), pa.array(best)], names=["id", "v", "cell", "r"])

    return vectors.select("id", "v").mapInArrow(run, f"id {id_type}, v array<double>, cell int, r double")


def _edges(celled: DataFrame, block: int) -> DataFrame:
    """cell, edges: inner radii that cut a cell into rings of about equal size, one for each block's worth of rows and RINGS at most."""
    cells = celled.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("r", [i / RINGS for i in range(1, RINGS)], 1000).alias("q"))
    parts = F.least(F.lit(RINGS), F.ceil(F.col("n") / block).cast("int"))
    inner = F.when(parts > 1, F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.col("q")[F.floor(i * RINGS / parts).cast("int") - 1])).otherwise(F.array().cast("array<double>"))
    return cells.select("cell", F.array_distinct(inner).alias("edges"))


def _with_rings(celled: DataFrame, edges: DataFrame) -> DataFrame:
    placed = celled.join(F.broadcast(edges), "cell", "left")  # PIVOTS rows at most
    return placed.withColumn("ring", F.coalesce(F.size(F.filter("edges", lambda e: e < F.col("r"))), F.lit(0))).drop("edges")


def metric_rings(vectors: DataFrame, id_type: str, block: int) -> tuple[Rings, DataFrame]:
    """The rings over vectors (id, v), and id, v, ring, part of all vectors; a part of a ring is a block."""
    n = vectors.count()
    pivots = pivots_of(vectors, -(-n // block))
    celled = cut(_with_cells(vectors, pivots, id_type))
    edges = cut(_edges(celled, block))
    placed = _with_rings(celled, edges)
    rows = placed.groupBy("cell", "ring").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n")).orderBy("cell", "ring").collect()  # PIVOTS * RINGS at most
    rings = Rings(pivots, *(np.array([r[c] for r in rows], t) for c, t in (("cell", int), ("lo", float), ("hi", float), ("n", int))))
    numbers = vectors.sparkSession.createDataFrame([(r["cell"], r["ring"], k, max(1, -(-r["n"] // block))) for k, r in enumerate(rows)], "cell int, ring int, place int, parts int")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    members = placed.join(F.broadcast(numbers), ["cell", "ring"]).select("id", "v", F.col("place").alias("ring"), part.alias("part"))
    return rings, members


def surviving(queries: DataFrame, rings: Rings, k: int, id_type: str, only_own: bool = False) -> DataFrame:
    """queries (id, v, most: a bound of the k-th distance, or null) -> id, v, most, own (number of the nearest ring), rings that may hold neighbours.

    only_own: just the nearest ring is wanted, and rings is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 1024):
                b = whole.slice(s, 1024)
                d = rings.distances(np.array(b.column("v").to_pylist(), float).reshape(b.num_rows, -1))
                given = np.array([np.inf if m is None else m for m in b.column("most").to_pylist()])
                most = np.minimum(given, rings.bound(d, k))
                least = rings.at_least(d)
                may = least <= slackened(most)[:, None]
                own = (least + 1e-9 * d[:, rings.cell]).argmin(1) if len(rings.cell) else np.zeros(len(d), int)
                lists = pa.array([[] if only_own else np.flatnonzero(m).tolist() for m in may], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(most), pa.array(own.astype(np.int32)), lists], names=["id", "v", "most", "own", "rings"])

    return queries.mapInArrow(run, f"id {id_type}, v array<double>, most double, own int, rings array<int>")


def _blocked(rows: DataFrame, keys: list[str], block: int, columns: list[str]) -> DataFrame:
    """rows of each key in lists of about `block`, so that no list grows with its key."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    cell = F.pmod(F.xxhash64("id", F.lit(7)), F.ceil(F.col("__n") / block).cast("long"))
    return rows.join(n, keys).withColumn("__slot", cell).groupBy(*keys, "__slot").agg(F.collect_list(F.struct(*columns)).alias("rows"))


def _met(asked: DataFrame, members: DataFrame, k: int, id_type: str, drop_self: bool) -> DataFrame:
    """asked (keys, rows) and members (keys, rows) that share keys -> i, j, d: the k nearest of each pair of lists, within the bounds."""
    keys = [c for c in members.columns if c != "rows"]
    pairs = asked.select(*keys, F.col("rows").alias("l")).join(members.withColumnRenamed("rows", "r"), keys).select("l", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                l, r = batch.column("l")[i].as_py(), batch.column("r")[i].as_py()
                side = lambda rows: {"id": np.array([x["id"] for x in rows]), "v": np.array([x["v"] for x in rows], float)}
                most = np.array([x["most"] for x in l])
                found = nearest(side(l), side(r), k, drop_self, slackened(most))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found] if found[0] else [pa.array([], t) for t in (kinds[id_type], kinds[id_type], pa.float64())], names=["i", "j", "d"])

    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    return pairs.mapInArrow(run, f"i {id_type}, j {id_type}, d double")


def share_left(queries: DataFrame, rings: Rings, probes: int, plain: Callable[[DataFrame], DataFrame], k: int) -> float:
    """The share of all vectors that the rings leave for `probes` queries, whose k-th distance comes from the search `plain`."""
    asked = cut(queries.orderBy(F.xxhash64("id")).limit(probes))
    kth = {r["i"]: r["d"] for r in plain(asked).groupBy("i").agg(F.max("d").alias("d"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}  # a row for each probe
    found = asked.collect()
    if not found:
        return 1.0
    least = rings.at_least(rings.distances(np.array([r["v"] for r in found], float)))
    may = least <= slackened(np.array([kth.get(r["id"], np.inf) for r in found]))[:, None]
    return float((may @ rings.rows).mean() / max(1, rings.rows.sum()))


def indexed_nearest(queries: DataFrame, vectors: DataFrame, index: tuple[Rings, DataFrame], k: int, id_type: str, drop_self: bool, block: int) -> DataFrame:
    """(id, v) -> i, j, d: for each query all of its k nearest, and some more, that are vectors; index as from metric_rings.

    Ids may repeat; with drop_self no vector with the query's own id counts.
    """
    columns = ["id", "v", "most"]
    rings, members = index
    members = cut(members)
    blocks = cut(members.groupBy("ring", "part").agg(F.collect_list(F.struct("id", "v")).alias("rows")))
    parts = members.groupBy("ring").agg((F.max("part") + 1).alias("parts"))  # PIVOTS * RINGS rows at most
    # with drop_self the bound from sizes must hold without the query's own rows, of which there may be several
    own_rows = vectors.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    need = k + (own_rows if drop_self else 0)
    start = cut(surviving(queries.select("id", "v", F.lit(None).cast("double").alias("most")), rings, need, id_type, only_own=True).drop("rings"))
    home = start.select("id", "v", "most", F.col("own").alias("ring")).join(F.broadcast(parts), "ring")
    home = home.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    first = cut(_met(_blocked(home, ["ring", "part"], block, columns), blocks, k, id_type, drop_self))
    ranked = first.groupBy(F.col("i").alias("id")).agg(F.slice(F.sort_array(F.collect_list("d")), 1, k).alias("d"))  # k for each query row
    kth = ranked.where(F.size("d") == k).select("id", F.element_at("d", k).alias("lower"))
    again = queries.select("id", "v").join(kth, "id", "left").select("id", "v", F.col("lower").alias("most"))
    if own_rows > 1:  # the list of a repeated id mixes its rows' neighbours: only bounds from sizes hold
        again = queries.select("id", "v", F.lit(None).cast("double").alias("most"))
    rest = surviving(again, rings, need, id_type)
    rest = cut(rest.select("id", "v", "most", F.explode("rings").alias("ring")))
    return _met(_blocked(rest, ["ring"], block, columns), blocks.select("ring", "rows"), k, id_type, drop_self)
