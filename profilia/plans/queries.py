"""Registered queries of the profile operators over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BaselineConfig, ForecastConfig, ManifoldConfig, PrepConfig
from ..functions import columns as C
from ..operators import anomaly, barycenter, baseline, clusters, density, dtw, elastic, features, forecast, kmeans, layout, models, neighbors, preprocess
from ..operators.lineage import cut
from ..sources import tables

R = C.rounded
_MAP = ManifoldConfig()


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[R(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def monthly_rates(spark: SparkSession, sf: str, cfg: PrepConfig = PrepConfig(clamp_nonnegative=False)) -> DataFrame:
    return _rounded(preprocess.monthly_rates(tables.part_wells(spark, sf), cfg))


def monthly_rates_clamped(spark: SparkSession, sf: str) -> DataFrame:
    return monthly_rates(spark, sf, PrepConfig(days_mode="calendar"))


def _smooth(spark: SparkSession, sf: str) -> DataFrame:
    return preprocess.smooth_rates(preprocess.monthly_rates(tables.supplier_wells(spark, sf)))


def winsorized_rates(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_smooth(spark, sf).select("well_name", "date", "r_oil", "r_water", "r_gas"))


def savgol_smooth(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_smooth(spark, sf).select("well_name", "date", "r_oil_s", "r_water_s", "r_gas_s"))


def watercut_gor(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(preprocess.add_channels(_smooth(spark, sf)).select("well_name", "date", "wc", "gor"))


def _profiles(spark: SparkSession, sf: str) -> preprocess.Profiles:
    return preprocess.preprocess_profiles(tables.supplier_wells(spark, sf))


def _panel(panel: DataFrame) -> DataFrame:
    """gor divides by rates that may be next to nothing, so it is compared more coarsely."""
    gor = F.when(F.col("gor") < 1e4, F.round("gor", 2)).otherwise(F.round("gor", -3))
    return panel.select(*[gor.alias(c) if c == "gor" else R(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in panel.dtypes])


def panel_aligned(spark: SparkSession, sf: str) -> DataFrame:
    return _panel(_profiles(spark, sf).panel)


def panel_aligned_ragged(spark: SparkSession, sf: str) -> DataFrame:
    return _panel(preprocess.preprocess_profiles(tables.part_wells(spark, sf)).panel)


def dropped_summary(spark: SparkSession, sf: str) -> DataFrame:
    return preprocess.preprocess_profiles(tables.customer_wells(spark, sf)).dropped_summary


def start_detection_high_thr(spark: SparkSession, sf: str) -> DataFrame:
    full = preprocess.add_channels(_smooth(spark, sf), PrepConfig(prod_threshold_rel=0.5))
    return full.where("i = 0").select("well_name", F.col("start").cast("int").alias("start"))


def profile_tensor(spark: SparkSession, sf: str) -> DataFrame:
    tensor = preprocess.preprocess_profiles(tables.part_wells(spark, sf)).tensor()
    long = tensor.select("well_name", F.posexplode(F.arrays_zip("r_oil_norm", "wc", "dr_oil_norm")).alias("t", "x"))
    return _rounded(long.select("well_name", "t", "x.r_oil_norm", "x.wc", "x.dr_oil_norm"))


def side_features(spark: SparkSession, sf: str) -> DataFrame:
    found = features.compute_side_features(_profiles(spark, sf).panel, T=36)
    return _rounded(found.withColumns({c: F.col(c).cast("double") for c in ("t_peak", "t_half", "t_20", "plateau_len")}))


def side_features_scaled(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(features.scale_features(features.compute_side_features(_profiles(spark, sf).panel, T=36)))


def prefix_scaled(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(forecast.prefix_scaled(_profiles(spark, sf).panel).select("well_name", "t", "r_oil_pref_norm"))


def prefix_features(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(forecast.prefix_features(forecast.prefix_scaled(_profiles(spark, sf).panel)))


def knn_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.embeddings(spark, sf)
    return _rounded(neighbors.knn(e, e, 10, "bigint"))


def knn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.embeddings(spark, sf)
    return _rounded(neighbors.neighbor_pairs(neighbors.knn(e, e, 10, "bigint")))


def _forecast(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    m = cut(forecast.make_matrices(forecast.prefix_scaled(_profiles(spark, sf).panel)))
    return m, forecast.knn_curves(m)


def knn_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(forecast.knn_forecast(cut(forecast.make_matrices(forecast.prefix_scaled(_profiles(spark, sf).panel)))))


def forecast_long(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(forecast.forecast_long(*_forecast(spark, sf)))


def forecast_wide(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(forecast.forecast_wide(forecast.forecast_long(*_forecast(spark, sf)), ForecastConfig()))


def forecast_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(forecast.evaluate_forecasts(forecast.forecast_long(*_forecast(spark, sf))))


def lof_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(anomaly.lof_scores(tables.embeddings(spark, sf), 30))


def medoid_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(anomaly.distance_to_medoid(tables.embeddings(spark, sf)))


def anomaly_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(anomaly.anomaly_scores(tables.embeddings(spark, sf), 30))


def top_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(anomaly.top_anomalies(anomaly.anomaly_scores(tables.embeddings(spark, sf), 30), 50))


def silhouette_by_label(spark: SparkSession, sf: str) -> DataFrame:
    points = anomaly.silhouette_points(tables.embeddings(spark, sf))
    return _rounded(points.groupBy("label").agg(F.avg("silhouette").alias("silhouette"), F.count("*").alias("n")))


def mutual_reachability(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(anomaly.mutual_reachability(tables.embeddings(spark, sf), 12))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    return s.select(F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("well_name"), (F.col("s_nationkey") % 5 - 1).cast("int").alias("cluster"), (F.col("s_suppkey") % 7 / 7.0).alias("prob"))


def cluster_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(clusters.summarize_clusters(_labels(spark, sf)))


def prototypes_median_iqr(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(clusters.cluster_prototypes(_profiles(spark, sf).panel, _labels(spark, sf), ["r_oil_norm", "wc"], 36))


def cluster_mean_bands(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(clusters.mean_bands(_profiles(spark, sf).panel, _labels(spark, sf), "r_oil_norm", 70))


_BASE = BaselineConfig(signal="bbl_mo", horizon=12, min_consec=2)


def clipped_signal(spark: SparkSession, sf: str) -> DataFrame:
    rows = baseline.daily_signals(tables.part_wells(spark, sf))
    return _rounded(rows.groupBy("well_name").agg(F.count("bopd").alias("n_bopd"), F.max("bopd").alias("max_bopd"), F.round(F.sum("mcfpd"), 3).alias("sum_mcfpd"), F.count("bbl_mo").alias("n_bbl")))


def _signal(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.interpolated_signal(baseline.monthly_signal(baseline.daily_signals(tables.part_wells(spark, sf)), _BASE))


def dense_month_spine(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_signal(spark, sf).select("well_name", "date", "s"))


def interpolated_series(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_signal(spark, sf).select("well_name", "date", F.col("i").cast("int").alias("i"), "f"))


def run_length_start(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.run_starts(_signal(spark, sf), _BASE).select("well_name", F.col("start").cast("int").alias("start"))


def zscored_wide(spark: SparkSession, sf: str) -> DataFrame:
    filled = cut(_signal(spark, sf))  # used three times
    z = baseline.zscored(baseline.wide_matrix(filled, baseline.run_starts(filled, _BASE), _BASE))
    return _rounded(z.select("well_name", F.posexplode("v").alias("t", "z")))


def slugify_names(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", C.slugify(F.concat(F.lit(" "), "p_name", F.lit(": a/b, "), "p_name")).alias("slug"))


def sanitize_names(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select("c_custkey", C.sanitize_filename(F.concat("c_name", F.lit(" <x>|  ?"))).alias("name"))


def record_range_parse(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    key = F.col("c_custkey")
    label = F.when(key % 3 == 0, F.concat(F.lit("Group "), key.cast("string"))).otherwise(F.concat(F.lit("Records "), key.cast("string"), F.lit(" to "), (key * 2 - 40).cast("string")))
    return c.select("c_custkey", C.record_count(label).alias("records"), C.is_tree_node(F.concat(F.lpad(key.cast("string"), 5, "0"), F.lit("1 - x"))).alias("is_node"))


def producing_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = preprocess.producing_rows(tables.part_wells(spark, sf))
    return _rounded(rows.groupBy("well_name").agg(F.count("*").alias("n"), F.sum("oil").alias("oil"), F.sum("gas").alias("gas")))


def resampled_sums(spark: SparkSession, sf: str) -> DataFrame:
    signal = baseline.monthly_signal(baseline.daily_signals(tables.part_wells(spark, sf)), _BASE)
    return _rounded(baseline.filled_signal(signal).select("well_name", "date", "s"))


def monthly_means(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(baseline.monthly_means(tables.part_wells(spark, sf), "oil"))


def sampled_wells(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(preprocess.sample_wells(preprocess.monthly_rates(tables.supplier_wells(spark, sf)), 20).select("well_name", "date", "r_oil"))


def group_names(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    key = F.col("c_custkey").cast("string")
    label = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Group <"), key, F.lit("> "))).otherwise(F.concat(F.lit("Records "), key, F.lit(" to 9000")))
    link = F.concat(F.lit("x('s0"), F.repeat(F.lit("\\"), F.when(F.col("c_custkey") % 2 == 0, 2).otherwise(1)), key, F.lit("')"))
    return c.select("c_custkey", C.group_dir_name(label).alias("folder"), C.group_index(link).alias("nth"), C.well_file_name(F.concat(key, F.lit(": a/b"))).alias("file"))


def metadata_file_names(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    key = F.col("c_custkey")
    entries = F.map_filter(F.create_map(*[x for k, v in zip(C.FILE_KEYS, (F.col("c_name"), F.col("c_mktsegment"), F.concat(F.lit("A/b: "), key.cast("string")), F.lit(None).cast("string"), F.lit("x y")), strict=True) for x in (F.lit(k), v)]), lambda k, v: (k != "Field") | (key % 2 == 0))
    return c.select("c_custkey", C.metadata_file_name(entries).alias("file"))


def wells_by_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    """Each well by place, and the well whose number is twice that place, as far as there is one."""
    wells = preprocess.numbered(tables.part_wells(spark, sf).select("well_name").distinct(), "well_name", "well_idx")
    return preprocess.gathered(wells, wells.select(F.col("well_idx").alias("place"), (F.col("well_idx") * 2).alias("well_idx")))


def hdbscan_clusters(spark: SparkSession, sf: str) -> DataFrame:
    xy = clusters.pca_map(tables.embeddings(spark, sf))[0].select("id", F.array("x", "y").alias("v"))
    return density.hdbscan_clusters(xy)


def cluster_quality(spark: SparkSession, sf: str) -> DataFrame:
    return density.cluster_quality(tables.embeddings(spark, sf))


def barycenters(spark: SparkSession, sf: str) -> DataFrame:
    return barycenter.barycenters(_profiles(spark, sf).tensor(), _labels(spark, sf), "r_oil_norm")


def prototypes_dba(spark: SparkSession, sf: str) -> DataFrame:
    return barycenter.prototypes(_profiles(spark, sf).tensor(), _labels(spark, sf), ["r_oil_norm", "wc"], method="dba")


def pca_map(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.pca_map(tables.embeddings(spark, sf))[0]


def kmeans_auto(spark: SparkSession, sf: str) -> DataFrame:
    return kmeans.kmeans_auto(tables.embeddings(spark, sf), range(2, 13), runs=25)[0]


def gmm_bic(spark: SparkSession, sf: str) -> DataFrame:
    xy = clusters.pca_map(tables.embeddings(spark, sf))[0].select("id", F.array("x", "y").alias("v"))
    return clusters.gmm_bic(xy, range(2, 11))[0]


def _well_points(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    tensor = cut(_profiles(spark, sf).tensor())
    return tensor.select(F.col("well_name").alias("id"), C.flatten_channels(*_MAP.channels).alias("v")), tensor


def dtw_refined_edges(spark: SparkSession, sf: str) -> DataFrame:
    points, tensor = _well_points(spark, sf)
    return dtw.refine(neighbors.knn(points, points, _MAP.k_refine), tensor, _MAP)


def umap_map(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.embeddings(spark, sf)
    return layout.manifold_map(neighbors.knn(e, e, _MAP.n_neighbors, "bigint"), e, _MAP)


def umap_dtw_map(spark: SparkSession, sf: str) -> DataFrame:
    points, tensor = _well_points(spark, sf)
    return layout.manifold_map(dtw.refined_neighbors(points, tensor, _MAP), points, _MAP)


def isolation_forest(spark: SparkSession, sf: str) -> DataFrame:
    return models.flag_outliers(models.isolation_scores(tables.embeddings(spark, sf), trees=300))


def elasticnet_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """As for the k-NN forecast, wells whose horizon is complete."""
    scaled = cut(forecast.prefix_scaled(_profiles(spark, sf).panel))
    return elastic.elastic_net_forecast(forecast.prefix_features(scaled), forecast.suffix_targets(forecast.make_matrices(scaled)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        monthly_rates, monthly_rates_clamped, winsorized_rates, savgol_smooth, watercut_gor, panel_aligned, panel_aligned_ragged, dropped_summary,
        start_detection_high_thr, profile_tensor, side_features, side_features_scaled, prefix_scaled, prefix_features, knn_edges, knn_pairs, knn_forecast,
        forecast_long, forecast_wide, forecast_metrics, lof_scores, medoid_distance, anomaly_scores, top_anomalies, silhouette_by_label,
        mutual_reachability, cluster_summary, prototypes_median_iqr, cluster_mean_bands, clipped_signal, dense_month_spine, interpolated_series,
        run_length_start, zscored_wide, slugify_names, sanitize_names, record_range_parse, producing_rows, resampled_sums, monthly_means, sampled_wells,
        group_names, metadata_file_names, wells_by_ordinal, hdbscan_clusters, cluster_quality, barycenters, prototypes_dba, pca_map, kmeans_auto, gmm_bic,
        dtw_refined_edges, umap_map, umap_dtw_map, isolation_forest, elasticnet_forecast,
    )
}
