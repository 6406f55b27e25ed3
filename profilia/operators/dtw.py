"""Time-warped distances of the pairs that the plain neighbour search proposes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ManifoldConfig
from .lineage import cut
from .neighbors import knn, knn_beside
from .warping import refined_dtw

#: Pairs whose paths are searched together.
TOGETHER = 256
#: Unrefined neighbours that the one search finds, in multiples of those that are wanted.
AHEAD = 2


def frames(channels: list, weights: tuple[float, ...]) -> np.ndarray:
    """Months with any value, as weighted points; missing values among them count as 0."""
    x = np.array(channels, float).T
    x = x[~np.isnan(x).all(1)]
    return np.nan_to_num(x, posinf=0.0, neginf=0.0) * np.array(weights)


def dtw(a: np.ndarray, b: np.ndarray) -> float:
    """Least sum of point distances along a warping path, by anti-diagonals; infinite if a side is empty."""
    n, m = len(a), len(b)
    if not n or not m:
        return float("inf")
    cost = np.sqrt(np.square(a[:, None] - b[None]).sum(2))
    old, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    for k in range(n + m - 1):
        i = np.arange(max(0, k - m + 1), min(n, k + 1))
        new = np.full(n + 1, np.inf)
        best = np.minimum(np.minimum(last[i], last[i + 1]), old[i])
        new[i + 1] = cost[i, k - i] + (best if k else 0.0)
        old, last = last, new
    return float(last[n])


def dtw_all(xs: list[np.ndarray], ys: list[np.ndarray]) -> list[float]:
    """dtw of each pair, the pairs together: one step moves a diagonal of all of them. Shorter series are padded, which no path to their ends meets."""
    out = np.full(len(xs), np.inf)
    some = [p for p in range(len(xs)) if len(xs[p]) and len(ys[p])]
    for s in range(0, len(some), TOGETHER):
        at = some[s : s + TOGETHER]
        ns, ms = np.array([len(xs[p]) for p in at]), np.array([len(ys[p]) for p in at])
        n, m, width = int(ns.max()), int(ms.max()), xs[at[0]].shape[1]
        a, b = np.zeros((n, len(at), width)), np.zeros((m, len(at), width))
        for c, p in enumerate(at):
            a[: ns[c], c], b[: ms[c], c] = xs[p], ys[p]
        old, last = np.full((n + 1, len(at)), np.inf), np.full((n + 1, len(at)), np.inf)
        for k in range(n + m - 1):
            lo, hi = max(0, k - m + 1), min(n, k + 1)
            cost = np.sqrt(np.square(a[lo:hi] - b[k - hi + 1 : k - lo + 1][::-1]).sum(2))
            new = np.full_like(last, np.inf)
            new[lo + 1 : hi + 1] = cost + np.minimum(np.minimum(last[lo:hi], last[lo + 1 : hi + 1]), old[lo:hi]) if k else cost
            done = np.flatnonzero(ns + ms - 2 == k)
            out[np.array(at)[done]] = new[ns[done], done]
            old, last = last, new
    return out.tolist()


def refine(edges: DataFrame, profiles: DataFrame, cfg: ManifoldConfig = ManifoldConfig()) -> DataFrame:
    """edges (i, j, d) and profiles (well_name, an array for each channel) -> a, b, d, d_dtw of each unordered pair.

    Pairs are dealt out by Spark and each is compared on its own; only neighbours are, never all pairs.
    """
    if len(cfg.channels) != len(cfg.channel_weights):
        raise ValueError("a weight for each channel is needed")
    if cfg.warp not in ("exact", "refined"):
        raise ValueError(f"unknown kind of warping: {cfg.warp}")
    missing = sorted(set(cfg.channels) - set(profiles.columns))
    if missing:
        raise ValueError(f"missing channels: {missing}")
    packed = profiles.select("well_name", F.array(*[F.col(c) for c in cfg.channels]).alias("x"))
    pairs = edges.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "d").groupBy("a", "b").agg(F.min("d").alias("d"))
    both = pairs.join(packed.select(F.col("well_name").alias("a"), F.col("x").alias("xa")), "a").join(packed.select(F.col("well_name").alias("b"), F.col("x").alias("xb")), "b")

    def distances(xs: list[np.ndarray], ys: list[np.ndarray]) -> list[float]:
        return dtw_all(xs, ys) if cfg.warp == "exact" else [refined_dtw(x, y, cfg.radius) for x, y in zip(xs, ys, strict=True)]

    def points(column: pa.ListArray) -> list[np.ndarray]:
        return [frames(x, cfg.channel_weights) for x in column.to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for at in range(0, t.num_rows, TOGETHER):
                some = t.slice(at, TOGETHER)
                d = distances(points(some.column("xa")), points(some.column("xb")))
                yield pa.RecordBatch.from_arrays([some.column("a"), some.column("b"), some.column("d"), pa.array(d, pa.float64())], names=["a", "b", "d", "d_dtw"])

    return both.select("a", "b", "d", "xa", "xb").mapInArrow(run, "a string, b string, d double, d_dtw double")


def refined_neighbors(points: DataFrame, profiles: DataFrame, cfg: ManifoldConfig = ManifoldConfig()) -> DataFrame:
    """points (id, v) and profiles -> i, j, d: the n_neighbors nearest of each id where the k_refine nearest pairs have warped distances.

    All other pairs keep their plain ones. One search finds the pairs to refine and AHEAD as many more; an id that this leaves with fewer than
    n_neighbors unrefined pairs, as it is near to many others that aren't near to it, is searched for again beside its refined ones.
    """
    first = cut(knn(points, points, cfg.k_refine + AHEAD * cfg.n_neighbors))
    refined = cut(refine(first.where(F.col("rank") <= cfg.k_refine), profiles, cfg).select("a", "b", "d", F.when(F.abs("d_dtw") < float("inf"), F.col("d_dtw")).alias("w")))
    both = cut(refined.select(F.col("a").alias("i"), F.col("b").alias("j"), "d", "w").union(refined.select("b", "a", "d", "w")))
    plain = cut(first.select("i", "j", "d").join(both.select("i", "j"), ["i", "j"], "left_anti"))
    enough = plain.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= cfg.n_neighbors).select(F.col("i").alias("id"))
    skipped = both.groupBy("i").agg(F.collect_list("j").alias("skip")).withColumnRenamed("i", "id")
    few = cut(points.join(enough, "id", "left_anti").join(skipped, "id").select("id", "v", "skip"))
    more = knn_beside(few, points, cfg.n_neighbors)
    plain = plain.join(few.select(F.col("id").alias("i")), "i", "left_anti").union(more.select("i", "j", "d"))
    d = both.select("i", "j", F.coalesce("w", "d").alias("d")).union(plain)
    nth = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    return d.withColumn("nth", nth).where(F.col("nth") <= cfg.n_neighbors).select("i", "j", "d")
