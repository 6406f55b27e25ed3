"""Exact distances between vectors by blocks: nearest neighbours, distance sums, medoids.

Vectors are packed into parts of bounded size. A block of parts, the queries, meets the parts of all vectors one after the other in
one task, which holds its queries and one part at a time and keeps what it has found so far; so a query's result leaves
its task once, and no row exists for a pair of vectors or of parts.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Rows of a part, parts of a block of queries at most, blocks of queries wanted at least.
BLOCK, PARTS, BLOCKS = 1024, 16, 24
#: Queries held against a part at once.
SLICE = 512
#: A product in single precision is taken where the k-th distances are so much larger than its rounding.
ROUGH = 5e-5
#: Blocks of vectors from which a search for neighbours may go through a metric index; below, all pairs of blocks are cheaper.
INDEXED = 16
#: An index is used where its rings leave at most this share of all pairs, of PROBES queries.
LEFT, PROBES = 0.1, 256

_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64())}


def placed(vectors: DataFrame, by: str | None = None, near: bool = False) -> DataFrame:
    """vectors with the columns __group and __part: parts of about BLOCK rows, of one value of `by`, or with near of one place by the first two coordinates."""
    if by is not None:
        sizes = vectors.groupBy(by).agg(F.ceil(F.count("*") / BLOCK).alias("__n"))
        return vectors.join(sizes, by).withColumns({"__group": F.col(by).cast("string"), "__part": F.pmod(F.xxhash64("id"), F.col("__n"))}).drop("__n")
    n = max(1, -(-vectors.count() // BLOCK))
    if not near:
        return vectors.withColumns({"__group": F.lit(""), "__part": F.pmod(F.xxhash64("id"), F.lit(n)).cast("long")})
    side = int(np.ceil(np.sqrt(n)))
    marks = lambda c: F.percentile_approx(c, [i / side for i in range(1, side)] or [0.5], 10_000)
    step = lambda edges, c: F.size(F.filter(edges, lambda e: e < c))
    second = F.coalesce(F.try_element_at("v", F.lit(2)), F.lit(0.0))
    columns = vectors.agg(marks(F.col("v")[0]).alias("__edges"))  # one row
    striped = vectors.join(F.broadcast(columns)).withColumn("__x", step(F.col("__edges"), F.col("v")[0])).drop("__edges")
    rows = striped.groupBy("__x").agg(marks(second).alias("__edges"))  # a row for each stripe
    celled = cut(striped.join(F.broadcast(rows), "__x").withColumn("__y", step(F.col("__edges"), second)).drop("__edges"))
    sizes = celled.groupBy("__x", "__y").agg(F.ceil(F.count("*") / BLOCK).alias("__n")).orderBy("__x", "__y").collect()  # a row for each part or cell, about vectors / BLOCK
    begins = np.concatenate(([0], np.cumsum([r["__n"] for r in sizes]))).tolist()
    cells = vectors.sparkSession.createDataFrame([(r["__x"], r["__y"], r["__n"], b) for r, b in zip(sizes, begins, strict=False)], "__x int, __y int, __n long, __b long")
    part = F.col("__b") + F.pmod(F.xxhash64("id"), F.col("__n"))
    return celled.join(F.broadcast(cells), ["__x", "__y"]).withColumns({"__group": F.lit(""), "__part": part}).drop("__x", "__y", "__n", "__b")


def _pack(key: tuple, t: pa.Table) -> pa.Table:
    sink = pa.BufferOutputStream()
    rows = t.drop_columns(["__group", "__part"]).combine_chunks()
    at = rows.column_names.index("v")
    v = rows.column("v").chunk(0) if rows.num_rows else None
    if v is not None and not v.null_count and not v.offset:  # single precision where that is all there is
        x = v.values.to_numpy(zero_copy_only=False)
        single = x.astype(np.float32)
        if (single == x).all():
            rows = rows.set_column(at, "v", pa.ListArray.from_arrays(v.offsets, pa.array(single)))
    with pa.ipc.new_stream(sink, rows.schema) as w:
        w.write_table(rows)
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["group", "part", "data"])


def _packed(vectors: DataFrame, extra: list[str], by: str | None) -> DataFrame:
    rows = vectors if "__part" in vectors.columns else placed(vectors, by)
    rows = rows.select("__group", "__part", "id", "v", *extra)
    return cut(rows.groupBy("__group", "__part").applyInArrow(_pack, "`group` string, part long, data binary"))


def _columns(t: pa.Table) -> dict:
    out = {}
    for name in t.column_names:
        c = t.column(name).combine_chunks()
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c
        if pa.types.is_list(c.type):
            out[name] = c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
        elif pa.types.is_string(c.type):
            out[name] = np.array(c.to_pylist())
        else:
            out[name] = c.to_numpy(zero_copy_only=False)
    return out | {"v": out["v"].astype(float, copy=False)}


def _typed(c, kind: pa.DataType) -> pa.Array:
    return pa.array(c.tolist() if isinstance(c, np.ndarray) and c.dtype.kind in "UO" else list(c) if pa.types.is_list(kind) else c, kind)


def scan(left: DataFrame, right: DataFrame, kernel: Callable, schema: str, extra: list[str] | None = None, by: str | None = None, asked: list[str] | None = None) -> DataFrame:
    """kernel(queries, parts) on each block of left rows and an iterator over the parts of all right rows, a block's own parts first.

    Both are dicts of arrays: id, v (a row for each vector) and the extra columns, queries those named by `asked` too. The kernel yields
    lists of columns. With `by` only rows of equal values meet.
    """
    extra = extra or []
    a = _packed(left, extra + (asked or []), by)
    b = a if left is right else _packed(right, extra, by)
    per = max(1, min(PARTS, a.count() // BLOCKS))
    block = F.floor(F.col("part") / per)
    blocks = a.groupBy("group").agg(F.max(block).alias("last"))
    queries = a.select("group", block.alias("block"), F.lit(0).alias("side"), "data")
    met = b.join(F.broadcast(blocks) if by is None else blocks, "group").select("group", "part", "data", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"))
    side = F.when(block == F.col("block"), 1).otherwise(2) if left is right else F.lit(2)
    rows = queries.union(met.select("group", "block", side.alias("side"), "data"))
    tasks = 16 * max(1, blocks.agg(F.sum(F.col("last") + 1)).first()[0] or 1)
    rows = rows.repartition(min(tasks, 4096), "group", "block").sortWithinPartitions("group", "block", "side")
    names, kinds = zip(*[(x.split()[0], _TYPES[x.split()[1]]) for x in schema.split(", ")], strict=True)
    read = lambda data: pa.ipc.open_stream(data).read_all()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield (batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), batch.column(2)[i].as_py(), batch.column(3)[i].as_buffer()

        for _, found in itertools.groupby(each(), key=lambda r: r[0]):
            own, first = [], []
            for _, nth, data in found:
                if nth:
                    first.append(data)
                    break
                t = read(data)
                own.append(t.set_column(t.column_names.index("v"), "v", t.column("v").cast(pa.list_(pa.float64()))))
            if not own:
                continue
            parts = (_columns(read(data)) for data in itertools.chain(first, (r[2] for r in found)))
            for out in kernel(_columns(pa.concat_tables(own)), parts):
                for s in range(0, len(out[0]), 65536):
                    yield pa.RecordBatch.from_arrays([_typed(c[s : s + 65536], k) for c, k in zip(out, kinds, strict=True)], names=list(names))

    return rows.mapInArrow(run, schema)


def _differences(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the rows i of x to the rows j of y by differences, in slices that bound memory."""
    d = np.empty(len(i))
    for s in range(0, len(i), 65536):
        at = slice(s, s + 65536)
        d[at] = np.sqrt(np.square(y[j[at]] - x[i[at]]).sum(1))
    return d


def _about(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and for each row of x what they may be wrong by."""
    xx, yy = np.square(x).sum(1), np.square(y).sum(1)
    one = np.ones
    about = np.column_stack((-2 * x, xx, one(len(x)))) @ np.column_stack((y, one(len(y)), yy)).T
    return about, 1e-13 * (x.shape[1] + 8) * (xx + (yy.max() if len(yy) else 0)) + 1e-17


def _roughly(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _about, by a product in single precision, which takes less than half the time and is wrong by more; for numbers that single precision has."""
    xx, yy = np.square(x).sum(1), np.square(y).sum(1)
    one = np.ones
    left, right = np.column_stack((-2 * x, xx, one(len(x)))), np.column_stack((y, one(len(y)), yy))
    return left.astype(np.float32) @ right.astype(np.float32).T, 2.5e-7 * (x.shape[1] + 8) * (xx + (yy.max() if len(yy) else 0)) + 1e-30


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of x against rows of y: by a matrix product, and by differences where rounding would tell."""
    if not len(x) or not len(y):
        return np.zeros((len(x), len(y)))
    centre = y.mean(0)
    a, b = x - centre, y - centre
    d, slack = _about(a, b)
    close = np.flatnonzero(d.ravel() <= 1e9 * np.float64(1e-13) * (np.square(a).sum(1).max() + np.square(b).sum(1).max()))
    d = np.sqrt(np.maximum(d, 0, out=d), out=d)
    if len(close):
        d.ravel()[close] = _differences(x, y, *np.divmod(close, len(y)))
    return d


def slices(n: int) -> Iterator[slice]:
    return (slice(s, min(n, s + SLICE)) for s in range(0, n, SLICE))


def apart(a: np.ndarray, b: np.ndarray) -> float:
    """What the distance of any row of a to any row of b is at least, by their boxes; with room for rounding."""
    gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return float(np.sqrt(np.square(gap).sum())) * (1 - 1e-9) - 2e-9


def _shared_ids(a: dict, b: dict) -> bool:
    return bool(np.isin(b["id"], a["id"]).any())


def nearest(a: dict, b: dict, k: int, drop_self: bool, most: np.ndarray | None = None) -> list[list]:
    """i, j, d of the k nearest of each row of a among those of b (to nine places, ties by id), with most only where d is at most that."""
    found = Nearest(a, k, drop_self, most)
    if len(a["id"]) and len(b["id"]):
        found.meet(b)
    return [c.tolist() for c in found.columns()]


class Nearest:
    """The k nearest of each row of a among all parts met so far.

    One matrix product picks the rows that can be among them with its rounding allowed for; only for those d is taken, by differences.
    """

    def __init__(self, a: dict, k: int, drop_self: bool, most: np.ndarray | None = None, skip: tuple[np.ndarray, np.ndarray] | None = None):
        """skip: rows of a and, for each, an id that is none of its neighbours."""
        self.a, self.k, self.drop_self = a, k, drop_self
        self.skip = None
        if skip is not None and len(skip[0]):
            order = np.argsort(skip[1], kind="stable")
            self.skip = skip[0][order], skip[1][order]
        n = len(a["id"])
        self.most = np.full(n, np.inf) if most is None else np.array(most, float) + 1e-9
        self.centre = a["v"].mean(0) if n else 0.0
        self.kept: list[tuple] = []
        self.pending, self.held = 0, 0

    def meet(self, b: dict) -> None:
        a, k = self.a, self.k
        if apart(a["v"], b["v"]) > self.most.max():
            return
        shared = self.drop_self and _shared_ids(a, b)
        y = b["v"] - self.centre
        rows, cols = self._skipped(b["id"])
        for at in slices(len(a["id"])):
            x, kth = a["v"][at] - self.centre, np.square(self.most[at])
            size = np.square(x).sum(1).max() + (np.square(y).sum(1).max() if len(y) else 0)
            # rows that the rougher product can't tell from neighbours are compared by differences, so these must be few
            rough = np.isfinite(kth).all() and size < 1e30 and (ROUGH * size * (x.shape[1] + 8) <= kth).all()
            about, slack = _roughly(x, y) if rough else _about(x, y)
            if shared:
                about[a["id"][at][:, None] == b["id"][None]] = np.inf
            if len(rows):
                here = (rows >= at.start) & (rows < at.stop)
                about[rows[here] - at.start, cols[here]] = np.inf
            edge = np.square(self.most[at])
            fresh = np.flatnonzero(~np.isfinite(edge))
            if len(fresh):
                some = min(len(y), k) - 1
                least = np.partition(about[fresh], some, axis=1)[:, some]
                edge[fresh] = np.where(np.isfinite(least), np.maximum(least, 0), np.inf)
            with np.errstate(invalid="ignore"):
                limit = np.where(np.isfinite(edge), edge + 2 * slack + 4e-9 * np.sqrt(np.where(np.isfinite(edge), edge, 0) + slack), np.finfo(float).max)
            if rough:
                limit = np.nextafter(limit.astype(np.float32), np.float32(np.inf))  # compared as it is, not widened
            near, other = np.divmod(np.flatnonzero((about <= limit[:, None]).ravel()), len(y))
            near += at.start
            d = np.round(_differences(a["v"], b["v"], near, other), 9)
            ok = d <= self.most[near]
            if ok.any():
                self.kept.append((near[ok], b["id"][other[ok]], d[ok]))
                self.pending += int(ok.sum())
        if self.pending > min(len(a["id"]) * k, 1 << 22) or not self.held:
            self.settle()

    def _skipped(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.skip is None:
            return np.zeros(0, int), np.zeros(0, int)
        begin = np.searchsorted(self.skip[1], ids)
        n = np.searchsorted(self.skip[1], ids, "right") - begin
        cols = np.repeat(np.arange(len(ids)), n)
        return self.skip[0][np.arange(len(cols)) + np.repeat(begin - np.cumsum(n) + n, n)], cols

    def settle(self) -> None:
        if not self.kept:
            return
        near, j, d = (np.concatenate(c) for c in zip(*self.kept, strict=True))
        order = np.lexsort((j, d, near))
        near, j, d = near[order], j[order], d[order]
        rank = np.arange(len(near)) - np.searchsorted(near, np.arange(len(self.most)))[near]
        full = rank == self.k - 1
        self.most[near[full]] = np.minimum(self.most[near[full]], d[full])
        keep = rank < self.k
        self.kept, self.pending, self.held = [(near[keep], j[keep], d[keep])], 0, int(keep.sum())

    def columns(self) -> list[np.ndarray]:
        self.settle()
        if not self.kept:
            return [self.a["id"][:0], self.a["id"][:0], np.zeros(0)]
        near, j, d = self.kept[0]
        return [self.a["id"][near], j, d]


def _nearest_of_all(a: dict, parts: Iterator[dict], k: int, drop_self: bool) -> Iterator[list]:
    found = Nearest(a, k, drop_self)
    for b in parts:
        found.meet(b)
    yield found.columns()


def knn(queries: DataFrame, vectors: DataFrame, k: int, id_type: str = "string", drop_self: bool = True) -> DataFrame:
    """(id, v) -> i, j, d, rank: the k nearest of each query by Euclidean distance (to nine places), ties by id.

    From INDEXED blocks of vectors on, a metric index (see metric_index.py) leaves out blocks that can't hold any of them, where a few
    queries show that it leaves out most; otherwise every block of queries meets all vectors.
    """
    from .metric_index import indexed_nearest, metric_rings, share_left

    same = queries is vectors
    queries = cut(queries.select("id", "v"))
    vectors = queries if same else cut(vectors.select("id", "v"))
    plain = lambda asked: scan(asked, vectors, lambda a, parts: _nearest_of_all(a, parts, k, drop_self), f"i {id_type}, j {id_type}, d double")
    index = metric_rings(vectors, id_type, BLOCK) if vectors.count() >= INDEXED * BLOCK else None
    if index and share_left(queries, index[0], PROBES, plain, k) <= LEFT:
        found = indexed_nearest(queries, vectors, index, k, id_type, drop_self, BLOCK)
    else:
        found = plain(queries)
    w = Window.partitionBy("i").orderBy("d", "j")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_beside(queries: DataFrame, vectors: DataFrame, k: int, id_type: str = "string") -> DataFrame:
    """queries (id, v, skip: an array of ids) -> i, j, d: the k nearest vectors of each query that are neither itself nor in its skip."""

    def kernel(a: dict, parts: Iterator[dict]) -> Iterator[list]:
        lists = [json.loads(x) for x in a["skip"]]
        rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        ids = np.array([x for some in lists for x in some], dtype=None if id_type == "string" else np.int64)
        found = Nearest(a, k, True, skip=(rows, ids))
        for b in parts:
            found.meet(b)
        yield found.columns()

    packed = queries.select("id", "v", F.encode(F.to_json("skip"), "UTF-8").alias("skip"))
    found = scan(packed, vectors, kernel, f"i {id_type}, j {id_type}, d double", asked=["skip"])
    nth = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def neighbor_pairs(edges: DataFrame) -> DataFrame:
    """Unordered pairs among the edges, each once, with their distance."""
    return edges.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "d").groupBy("a", "b").agg(F.min("d").alias("d"))


def distance_sums(vectors: DataFrame, id_type: str = "bigint", within: bool = False) -> DataFrame:
    """(id, v, label) -> id, label, other, s, n: each vector's summed distance to every label (within: its own only), itself left out."""

    def kernel(a: dict, parts: Iterator[dict]) -> Iterator[list]:
        n = len(a["id"])
        sums: dict = {}
        for b in parts:
            labels, place = np.unique(b["label"], return_inverse=True)
            member = np.zeros((len(place), len(labels)))
            member[np.arange(len(place)), place] = 1
            shared, size = _shared_ids(a, b), member.sum(0)
            for g in labels:
                if g not in sums:
                    sums[g] = np.zeros(n), np.zeros(n, np.int64)
            for at in slices(n):
                d = _distances(a["v"][at], b["v"])
                seen = size
                if shared:
                    same = a["id"][at][:, None] == b["id"][None]
                    d[same] = 0
                    seen = size - same @ member
                part = d @ member
                for k, g in enumerate(labels):
                    sums[g][0][at] += part[:, k]
                    sums[g][1][at] += (seen[..., k]).astype(np.int64)
        for g, (s, m) in sums.items():
            yield [a["id"], a["label"].astype(np.int64), np.full(n, g, np.int64), s, m]

    part = scan(vectors, vectors, kernel, f"id {id_type}, label bigint, other bigint, s double, n bigint", ["label"], "label" if within else None)
    return part.groupBy("id", "label", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumns({c: F.col(c).cast("int") for c in ("label", "other")})
