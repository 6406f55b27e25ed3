"""Anomaly scores of embedded profiles: local outlier factor, distance to the cluster's medoid, their blend; silhouette."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .neighbors import _distances, distance_sums, knn, scan, slices


def minmax(df: DataFrame, col: str, out: str) -> DataFrame:
    """(x - min) / (max - min + 1e-12) over all rows."""
    ends = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))  # one row
    return df.join(F.broadcast(ends)).withColumn(out, (F.col(col) - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-12)).drop("lo", "hi")


def lof_scores(vectors: DataFrame, k: int = 30, id_type: str = "bigint") -> DataFrame:
    """(id, v) -> id, lof, lof_score: the local outlier factor over exactly k neighbours, and scaled to 0..1."""
    k = max(1, min(k, vectors.count() - 1))
    edges = cut(knn(vectors, vectors, k, id_type))
    kd = edges.where(F.col("rank") == k).select(F.col("i").alias("j"), F.col("d").alias("kd"))
    reach = edges.join(kd, "j").withColumn("reach", F.greatest("kd", "d"))
    lrd = cut(reach.groupBy("i").agg((1 / (F.avg("reach") + 1e-10)).alias("lrd")))
    other = lrd.select(F.col("i").alias("j"), F.col("lrd").alias("lrd_j"))
    lof = edges.join(other, "j").groupBy("i").agg(F.avg("lrd_j").alias("m")).join(lrd, "i").select(F.col("i").alias("id"), (F.col("m") / F.col("lrd")).alias("lof"))
    return minmax(lof, "lof", "lof_score")


def mutual_reachability(vectors: DataFrame, k: int, id_type: str = "bigint") -> DataFrame:
    """i, j, mr for the k nearest neighbours: the largest of both core distances and the distance."""
    edges = cut(knn(vectors, vectors, k, id_type))
    core = edges.where(F.col("rank") == k).select("i", F.col("d").alias("core"))
    a, b = core.withColumnRenamed("core", "ci"), core.select(F.col("i").alias("j"), F.col("core").alias("cj"))
    return edges.join(a, "i").join(b, "j").select("i", "j", F.greatest("ci", "cj", "d").alias("mr"))


def medoids(vectors: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(id, v, label) -> label, id, v of the member with the least summed distance; noise (-1) has none."""
    sums = distance_sums(vectors.where("label >= 0"), id_type, within=True)
    best = sums.groupBy("label").agg(F.min_by("id", F.struct(F.round("s", 9), "id")).alias("id"))
    return best.join(vectors.select("id", "v"), "id").select("label", "id", "v")


def distance_to_medoid(vectors: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(id, v, label) -> id, dist, dist_medoid: to the own cluster's medoid, for noise to the nearest, and scaled; null without clusters."""

    def kernel(a: dict, parts: Iterator[dict]) -> Iterator[list]:
        least = np.full(len(a["id"]), np.inf)
        for b in parts:
            for at in slices(len(least)):
                own = a["label"][at]
                d = np.where((own[:, None] == b["label"][None]) | (own < 0)[:, None], _distances(a["v"][at], b["v"]), np.inf)
                least[at] = np.minimum(least[at], d.min(1))
        some = np.isfinite(least)
        yield [a["id"][some], least[some]]

    near = scan(vectors, medoids(vectors, id_type), kernel, f"id {id_type}, d double", ["label"]).groupBy("id").agg(F.min("d").alias("dist"))
    return minmax(vectors.select("id").join(near, "id", "left"), "dist", "dist_medoid")


def anomaly_scores(vectors: DataFrame, lof_k: int = 30, id_type: str = "bigint") -> DataFrame:
    """id, lof_score, dist_medoid and their mean, anomaly_score."""
    vectors = cut(vectors.select("id", "v", "label"))
    both = lof_scores(vectors, lof_k, id_type).select("id", "lof_score").join(distance_to_medoid(vectors, id_type).select("id", "dist_medoid"), "id")
    return both.withColumn("anomaly_score", 0.5 * (F.col("lof_score") + F.col("dist_medoid")))


def top_anomalies(scores: DataFrame, k: int = 50) -> DataFrame:
    return scores.orderBy(F.desc(F.round("anomaly_score", 9)), "id").limit(k)


def silhouette_points(vectors: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(id, v, label) -> id, label, silhouette; a cluster of one gives 0, noise is left out."""
    means = distance_sums(vectors.where("label >= 0"), id_type)
    own = F.when(F.col("label") == F.col("other"), F.col("s") / F.nullif(F.col("n"), F.lit(0)))
    rest = F.when(F.col("label") != F.col("other"), F.col("s") / F.col("n"))
    ab = means.groupBy("id", "label").agg(F.max(own).alias("a"), F.min(rest).alias("b"))
    return ab.select("id", "label", F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)).alias("silhouette"))


def core_distances(vectors: DataFrame, k: int, id_type: str = "bigint") -> DataFrame:
    w = Window.partitionBy("i")
    return knn(vectors, vectors, k, id_type).withColumn("core", F.max("d").over(w)).where(F.col("rank") == k).select(F.col("i").alias("id"), "core")
