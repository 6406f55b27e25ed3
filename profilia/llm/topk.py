"""Exact top-k inner-product search by norm-bucketed retrieval with coordinate or length pruning in each bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Vectors in a block, queries in a block.
BLOCK, QUERY_BLOCK = 2048, 512
_FLOORS = "struct<ids:array<bigint>,floors:array<bigint>>"
#: Coordinates that a query looks at (its largest), and vectors of a bucket on which it tries whether they prune better than lengths.
FOCUS, TRIED = 8, 64


def _matrix(ids: list, vectors: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    width = max(map(len, vectors), default=0)
    m = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v
    return np.array(ids, np.int64), m


def _pack(ids: np.ndarray, m: np.ndarray) -> bytes:
    """Ids and components, the latter in the narrowest integers that hold them."""
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if not m.size or np.abs(m).max() <= np.iinfo(t).max)
    return np.array([*m.shape, np.dtype(kind).itemsize], np.int64).tobytes() + ids.tobytes() + m.astype(kind).tobytes()


def _unpack(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, w, size = np.frombuffer(b, np.int64, 3)
    return np.frombuffer(b, np.int64, n, 24), np.frombuffer(b, f"i{size}", n * w, 24 + 8 * n).reshape(n, w).astype(np.int64)


def _block(table: pa.Table) -> pa.Table:
    ids, m = _matrix(table.column("id").to_pylist(), table.column("v").to_pylist())
    norm = np.sqrt(np.square(m.astype(float)).sum(1))
    order = np.lexsort((ids, -norm))
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "top": pa.array([norm.max()], pa.float64()), "n": pa.array([len(ids)], pa.int64()), "data": pa.array([_pack(ids[order], m[order])], pa.binary())})


def _aligned(q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(q.shape[1], m.shape[1])
    return (np.pad(q, ((0, 0), (0, w - q.shape[1]))), np.pad(m, ((0, 0), (0, w - m.shape[1]))))


def _product(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer products; by way of float64 where no sum can leave its 53 bits."""
    if q.size and m.size and float(np.abs(q).max()) * float(np.abs(m).max()) * q.shape[1] < 2.0**53:
        return (q.astype(float) @ m.T.astype(float)).astype(np.int64)
    return q @ m.T


def survivors(q: np.ndarray, mf: np.ndarray, mn: np.ndarray, floor: float, slack: float) -> np.ndarray:
    """Rows of a bucket (longest first, lengths mn) whose product with q may reach floor.

    Length pruning cuts the bucket where length alone can't reach it. Coordinate pruning takes the query's largest coordinates exactly and bounds
    the rest by Cauchy and Schwarz; it is chosen where, at the bucket's local threshold and by a few of its vectors, it saves products.
    """
    qn = np.sqrt(np.square(q).sum())
    n = int(np.searchsorted(-mn * qn, -(floor - slack), side="right"))
    if floor <= 0 or len(q) <= FOCUS or not n:
        return np.arange(n)
    at = np.argsort(-np.abs(q))[:FOCUS]
    q_rest = np.sqrt(max(0.0, qn**2 - np.square(q[at]).sum()))

    def reach(rows: np.ndarray) -> np.ndarray:
        part = mf[np.ix_(rows, at)]
        m_rest = np.sqrt(np.maximum(0.0, np.square(mn[rows]) - np.square(part).sum(1)))
        return part @ q[at] + q_rest * m_rest >= floor - slack

    tried = np.unique(np.linspace(0, n - 1, TRIED).astype(int))
    if reach(tried).mean() * len(q) + 2 * FOCUS >= len(q):
        return np.arange(n)
    return np.flatnonzero(reach(np.arange(n)))


def _search(k: int):
    """mapInArrow function over pairs of a query block (with thresholds) and a vector block."""

    def best(qid: int, ids: np.ndarray, score: np.ndarray) -> list[tuple[int, int, int]]:
        keep = ids != qid
        ids, score = ids[keep], score[keep]
        if len(ids) > 4 * k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            ids, score = ids[score >= edge], score[score >= edge]
        order = np.lexsort((ids, -score))[:k]
        return [(qid, int(i), int(s)) for i, s in zip(ids[order], score[order], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qb, floors, vb in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                qids, q = _unpack(qb)
                ids, m = _unpack(vb)
                q, m = _aligned(q, m)
                mf, qf = m.astype(float), q.astype(float)
                qn, mn = np.sqrt(np.square(qf).sum(1)), np.sqrt(np.square(mf).sum(1))
                known = dict(zip(*floors.values(), strict=True)) if floors else {}
                floor = np.array([known.get(i, -np.inf) for i in qids.tolist()], float)
                with np.errstate(divide="ignore", invalid="ignore"):
                    local = np.where(qn * mn[0] > 0, floor / (qn * mn[0]), np.where(floor > 0, np.inf, -np.inf))
                out: list[tuple[int, int, int]] = []
                slack = 1e-9 * qn * (mn[0] if len(mn) else 0) + 1e-6
                dense = np.flatnonzero(local <= 0)
                if len(dense):
                    for i, s in zip(dense, _product(q[dense], m), strict=True):
                        out += best(int(qids[i]), ids, s)
                for i in np.flatnonzero((local > 0) & (floor <= qn * mn[0] + slack)):
                    rows = survivors(qf[i], mf, mn, floor[i], slack[i])
                    if len(rows):
                        out += best(int(qids[i]), ids[rows], _product(q[i : i + 1], m[rows])[0])
                a = np.array(out, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1]), pa.array(a[:, 2])], names=["query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scratch: Scratch | None = None) -> DataFrame:
    """vectors and queries (id long, v array<long>) -> query_id, rank, vec_id, score, best k of every query.

    Vectors are grouped by length into blocks of bounded size (those of about equal length are dealt over several
    blocks). The longest block gives every query a first threshold. A query block then meets only vector blocks whose
    length bound reaches the smallest threshold in it; inside, a query's local cosine threshold chooses between
    pruning by length alone or by its largest coordinates, and the survivors' products are verified exactly.
    Ties go to the smaller id and bounds are never strict, so equal scores aren't lost. A row isn't its own
    candidate; rows with the id of a query aren't either. Of queries with one id the largest vector, in the order of arrays, asks; candidates
    with one id all count. Vectors of any length are read whole and further columns are ignored. Shorter vectors count as padded by zeros; empty tables give
    an empty result; ids that are null take no part.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "topk")
    queries = queries.where("id is not null").groupBy("id").agg(F.max("v").alias("v"))
    ready = vectors.where("id is not null").select("id", "v").withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))
    ready = scratch.table(ready, "vectors")
    total = ready.count()
    if not total or queries.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cuts = sorted(set(ready.approxQuantile("norm", [i / 64 for i in range(1, 64)], 0.002)))
    band = F.lit(len(cuts)) - F.aggregate(F.array(*[F.lit(float(c)) for c in cuts]), F.lit(0), lambda a, c: a + (F.col("norm") >= c).cast("int"))  # 0: the longest
    banded = ready.withColumn("band", band)
    sizes = {r["band"]: r["count"] for r in banded.groupBy("band").count().collect()}
    deal = F.element_at(F.create_map(*[F.lit(x) for b, c in sizes.items() for x in (b, -(-c // BLOCK))]), F.col("band"))
    blocks = banded.withColumn("block", F.col("band").cast("long") * (1 << 32) + F.pmod(F.xxhash64("id"), deal))
    data = scratch.table(blocks.select("block", "id", "v").groupBy("block").applyInArrow(_block, "block long, top double, n long, data binary"), "blocks")
    n_queries = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = queries.where("id is not null").select(F.pmod(F.xxhash64("id"), F.lit(n_queries)).alias("block"), "id", "v")
    asked = scratch.table(asked.groupBy("block").applyInArrow(_block, "block long, top double, n long, data binary"), "queries")

    first_block = data.orderBy("block").limit(1).select(F.lit(1).alias("one"), F.col("data").alias("vb"), F.col("block").alias("vblock"))
    warm = asked.select(F.lit(1).alias("one"), F.col("data"), F.col("block")).join(F.broadcast(first_block), "one")  # one block of at most a few times BLOCK vectors
    out = "query_id long, vec_id long, score long"
    start = scratch.table(warm.select("data", F.lit(None).cast(_FLOORS).alias("floors"), "vb").mapInArrow(_search(k), out), "warm")
    kth = start.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.size("s") >= k)  # at most k each
    kth = kth.select(F.pmod(F.xxhash64("query_id"), F.lit(n_queries)).alias("block"), "query_id", F.element_at("s", k).alias("floor"))
    floors = kth.groupBy("block").agg(F.struct(F.collect_list("query_id").alias("ids"), F.collect_list("floor").alias("floors")).alias("floors"))
    ready_q = scratch.table(asked.join(floors, "block", "left").select("top", "n", "data", F.col("floors").cast(_FLOORS).alias("floors")), "floors")
    first_id = data.agg(F.min("block")).first()[0]
    longest = {r["band"]: r["top"] for r in data.groupBy(F.shiftright("block", 32).alias("band")).agg(F.max("top").alias("top")).collect()}  # at most 64
    bands = F.array(*[F.struct(F.lit(b).cast("long").alias("band"), F.lit(float(t)).alias("top"), F.lit(-(-sizes[b] // BLOCK)).cast("long").alias("deal")) for b, t in longest.items()])
    low = F.when(F.size("floors.floors") == F.col("n"), F.array_min("floors.floors"))  # a query without a threshold meets every block
    fits = F.col("low").isNull() | (F.col("low") <= 0) | (F.col("x.top") * F.col("top") * (1 + 1e-9) + 1e-6 >= F.col("low"))
    reach = ready_q.withColumn("low", low).select("data", "floors", "top", "low", F.explode(bands).alias("x")).where(fits)
    pairs = reach.select("data", "floors", F.explode(F.sequence(F.lit(0).cast("long"), F.col("x.deal") - 1)).alias("sub"), "x.band").select("data", "floors", (F.col("band") * (1 << 32) + F.col("sub")).alias("vblock"))
    n_blocks = sum(-(-c // BLOCK) for c in sizes.values())
    other = data.select(F.col("block").alias("vblock"), F.col("data").alias("vb")).repartition(n_blocks, "vblock")
    met = pairs.where(F.col("vblock") != first_id).repartition(n_blocks, "vblock").join(other, "vblock")
    every = start.unionByName(met.select("data", "floors", "vb").mapInArrow(_search(k), out))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantized(embeddings: DataFrame) -> DataFrame:
    """embeddings (vec_id, embedding, ...) -> id, v: floor(64 * x) of every component; unusable vectors go."""
    x = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = x.where(F.col("e").isNotNull() & F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return fine.select("id", F.transform("e", lambda c: F.floor(c * 64)).alias("v"))
