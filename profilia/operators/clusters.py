"""Summaries of clustered profiles: sizes, prototypes, bands; and the models that Spark ML has."""

from __future__ import annotations

import math

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def summarize_clusters(map_: DataFrame) -> DataFrame:
    """(cluster, prob) of each well -> cluster, size, share, prob_median, noise_share."""
    total = map_.agg(F.count("*").alias("total"), F.avg((F.col("cluster") == -1).cast("double")).alias("noise_share"))  # one row
    return map_.groupBy("cluster").agg(F.count("*").alias("size"), F.median("prob").alias("prob_median")).join(F.broadcast(total)).select("cluster", "size", (F.col("size") / F.col("total")).alias("share"), "prob_median", "noise_share")


def cluster_prototypes(panel: DataFrame, labels: DataFrame, channels: list[str], T: int = 36) -> DataFrame:
    """cluster, channel, t, value (median), p25, p75; noise is left out."""
    rows = panel.where(F.col("t").between(0, T - 1)).join(labels.where("cluster >= 0"), "well_name")
    long = rows.unpivot(["cluster", "t"], channels, "channel", "y")
    q = F.percentile("y", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75)))
    return long.groupBy("cluster", "channel", "t").agg(q.alias("q")).select("cluster", "channel", "t", F.col("q")[0].alias("value"), F.col("q")[1].alias("p25"), F.col("q")[2].alias("p75"))


def mean_bands(panel: DataFrame, labels: DataFrame, channel: str, T: int) -> DataFrame:
    """cluster, t, mean, p10, p90 of a channel."""
    rows = panel.where(F.col("t").between(0, T - 1)).join(labels, "well_name")
    return rows.groupBy("cluster", "t").agg(F.avg(channel).alias("mean"), F.percentile(channel, F.lit(0.1)).alias("p10"), F.percentile(channel, F.lit(0.9)).alias("p90"))


def axes(count: int) -> list[str]:
    """Names of a map's coordinates."""
    return list("xyz"[:count]) if count <= 3 else [f"x{k}" for k in range(count)]


def _features(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", array_to_vector("v").alias("features"))


def pca_map(vectors: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """(id, v) -> id and coordinates (axes) of the first components of the centred vectors, and the share of variance each explains."""
    size = len(vectors.first()["v"])
    mean = vectors.agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(size)]).first()
    centred = vectors.select("id", F.zip_with("v", F.array(*[F.lit(m) for m in mean]), lambda x, m: x - m).alias("v"))
    rows = _features(centred)
    model = PCA(k=k, inputCol="features", outputCol="p").fit(rows)
    out = model.transform(rows).select("id", vector_to_array("p").alias("p"))
    return out.select("id", *[F.col("p")[i].alias(n) for i, n in enumerate(axes(k))]), list(model.explainedVariance)


def gmm_bic(vectors: DataFrame, ks: range = range(2, 11), seed: int = 42) -> tuple[DataFrame, dict[int, float]]:
    """(id, v) -> id, cluster, prob of the Gaussian mixture with the least BIC, and the BIC of each number of components."""
    rows = cut(_features(vectors))
    n, d = rows.count(), len(vectors.first()["v"])
    models = {k: GaussianMixture(k=k, seed=seed).fit(rows) for k in ks}
    bic = {k: -2 * m.summary.logLikelihood + (k * d + k * d * (d + 1) / 2 + k - 1) * math.log(n) for k, m in models.items()}
    best = models[min(bic, key=bic.get)]
    return best.transform(rows).select("id", F.col("prediction").alias("cluster"), F.array_max(vector_to_array("probability")).alias("prob")), bic
