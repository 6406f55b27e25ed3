"""Completing a profile from its first months: nearest prefixes, features of the prefix, metrics, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ForecastConfig
from ..functions import columns as C
from .lineage import cut
from .neighbors import knn

#: Wells whose forecasts one task makes.
WELLS = 4096


def prefix_scaled(panel: DataFrame, cfg: ForecastConfig = ForecastConfig(), rate: str = "r_oil_s") -> DataFrame:
    """panel within the horizon with r_oil_pref_norm: the rate over its quantile in the prefix, clipped."""
    rows = panel.where(F.col("t").between(0, cfg.T - 1))
    scales = rows.where(F.col("t") < cfg.T_pref).groupBy("well_name").agg(F.percentile(rate, F.lit(cfg.q)).alias("scale"))
    return rows.join(scales, "well_name", "left").withColumn("r_oil_pref_norm", C.clipped_ratio(F.col(rate), F.col("scale"), cfg.eps, cfg.clip_max)).drop("scale")


def make_matrices(scaled: DataFrame, cfg: ForecastConfig = ForecastConfig(), target: str = "r_oil_s") -> DataFrame:
    """well_name, x_pref (scaled prefix) and y_full (target) as arrays, null where there is no month."""
    x = F.map_from_entries(F.collect_list(F.struct("t", "r_oil_pref_norm")))
    y = F.map_from_entries(F.collect_list(F.struct("t", target)))
    maps = scaled.groupBy("well_name").agg(x.alias("x"), y.alias("y"))
    at = lambda m, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: F.try_element_at(F.col(m), t))
    return maps.select("well_name", at("x", cfg.T_pref).alias("x_pref"), at("y", cfg.T).alias("y_full"))


def suffix_targets(matrices: DataFrame, cfg: ForecastConfig = ForecastConfig()) -> DataFrame:
    """well_name, t, y of the months after the prefix, for the wells whose horizon is complete."""
    full = matrices.where(F.forall("y_full", lambda y: y.isNotNull()))
    late = F.slice("y_full", cfg.T_pref + 1, cfg.T - cfg.T_pref)
    return full.select("well_name", F.posexplode(late).alias("k", "y")).select("well_name", (F.col("k") + cfg.T_pref).alias("t"), "y")


def knn_curves(matrices: DataFrame, cfg: ForecastConfig = ForecastConfig()) -> DataFrame:
    """well_name and pred, the array of predictions of the months after the prefix, of each well whose horizon is complete.

    Neighbours: the K + 1 nearest scaled prefixes, the well itself among them, without those at distance 0, K at most; if none is
    left, the nearest. Each neighbour's curve is scaled to the well's raw prefix by least squares; the forecast is their median. A well's
    neighbours travel as one array each, so there is no row for a neighbour's month.
    """
    full = matrices.where(F.forall("y_full", lambda y: y.isNotNull()) & F.forall("x_pref", lambda x: x.isNotNull()))
    n = full.count()
    if n < 3:
        raise ValueError("fewer than 3 wells with a complete horizon")
    points = full.select(F.col("well_name").alias("id"), F.col("x_pref").alias("v"))
    near = knn(points, points, min(cfg.K + 1, n), drop_self=False)
    own = Window.partitionBy("i")
    ok = F.when((F.col("d") > 0) & (F.col("rank") <= cfg.K + 1), 1).otherwise(0)
    near = near.withColumn("ok", ok).withColumns({"any": F.max("ok").over(own), "nth": F.sum("ok").over(own.orderBy("rank"))})
    pairs = cut(near.where(((F.col("ok") == 1) & (F.col("nth") <= cfg.K)) | ((F.col("any") == 0) & (F.col("rank") == 1))).select("i", "j"))
    a = full.select(F.col("well_name").alias("i"), F.slice("y_full", 1, cfg.T_pref).alias("a"))
    b = full.select(F.col("well_name").alias("j"), F.col("y_full").alias("b"))
    both = pairs.join(a, "i").join(b, "j")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    head = F.slice("b", 1, cfg.T_pref)
    scale = dot(F.col("a"), head) / (dot(head, head) + F.lit(cfg.eps))
    late = both.select("i", F.coalesce(C.finite(scale), F.lit(1.0)).alias("s"), F.slice("b", cfg.T_pref + 1, cfg.T - cfg.T_pref).alias("b"))
    late = late.select("i", F.transform("b", lambda y: F.col("s") * y).alias("y"))
    late = late.repartition(max(matrices.sparkSession.sparkContext.defaultParallelism, -(-n // WELLS)), "i")  # by number of wells: the rows are small, what is done with them isn't
    curves = late.groupBy("i").agg(F.collect_list("y").alias("ys"))  # K at most
    months = F.sequence(F.lit(0), F.lit(cfg.T - cfg.T_pref - 1))
    return curves.select(F.col("i").alias("well_name"), F.transform(months, lambda k: _median(F.transform("ys", lambda y: F.get(y, k)))).alias("pred"))


def _median(values: Column) -> Column:
    """The median of an array without nulls, as percentile gives it: the middle one or the mean of the two in the middle."""
    x = F.transform(F.array(F.sort_array(values)), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) * 0.5)
    return x[0]


def knn_forecast(matrices: DataFrame, cfg: ForecastConfig = ForecastConfig()) -> DataFrame:
    """well_name, t, y_pred for the months after the prefix of each well whose horizon is complete; see knn_curves."""
    months = knn_curves(matrices, cfg).select("well_name", F.posexplode("pred").alias("k", "y_pred"))
    return months.select("well_name", (F.col("k") + cfg.T_pref).alias("t"), "y_pred")


def prefix_features(scaled: DataFrame, cfg: ForecastConfig = ForecastConfig()) -> DataFrame:
    """Mean, deviation, line and curvature of the scaled prefix and mean and deviation of its water cut."""
    w = Window.partitionBy("well_name").orderBy("t")
    y, t = F.col("r_oil_pref_norm"), F.col("t").cast("double")
    rows = scaled.where(F.col("t").between(0, cfg.T_pref - 1)).withColumns({"d2": y - 2 * F.lag(y, 1).over(w) + F.lag(y, 2).over(w), "first": F.first(y).over(w)})
    return rows.groupBy("well_name").agg(
        F.avg(y).alias("y_mean"), F.stddev_pop(y).alias("y_std"),
        F.coalesce(F.when(F.count("*") >= 2, F.regr_slope(y, t)), F.lit(0.0)).alias("y_slope"),
        F.coalesce(F.when(F.count("*") >= 2, F.regr_intercept(y, t)), F.max("first")).alias("y_intercept"),
        F.coalesce(F.avg("d2"), F.lit(0.0)).alias("y_curv"), F.avg("wc").alias("wc_mean"), F.stddev_pop("wc").alias("wc_std"),
    )


def forecast_long(matrices: DataFrame, forecast: DataFrame, cfg: ForecastConfig = ForecastConfig()) -> DataFrame:
    """well_name, t, y_true, y_pred (observed in the prefix), segment for the wells with a forecast; the forecast is computed once.

    forecast: a row for each month (t, y_pred), or for each well (pred, as knn_curves gives it).
    """
    if "pred" in forecast.columns:
        months, at = forecast.select("well_name", "pred"), F.get("pred", F.col("t") - cfg.T_pref)
    else:
        months = forecast.groupBy("well_name").agg(F.map_from_entries(F.collect_list(F.struct("t", "y_pred"))).alias("pred"))  # a horizon each
        at = F.try_element_at("pred", F.col("t"))
    true = matrices.join(months, "well_name").select("well_name", "pred", F.posexplode("y_full").alias("t", "y_true"))
    seen = F.col("t") < cfg.T_pref
    return true.select("well_name", "t", "y_true", F.when(seen, F.col("y_true")).otherwise(at).alias("y_pred"), F.when(seen, "observed").otherwise("forecast").alias("segment"))


def forecast_wide(long: DataFrame, cfg: ForecastConfig = ForecastConfig()) -> DataFrame:
    """A column m<t> of predictions for each month of the horizon, the largest if a month comes twice; a well's months meet in one list."""
    wells = long.groupBy("well_name").agg(F.sort_array(F.collect_list(F.struct("t", "y_pred"))).alias("x"))
    last = F.filter("x", lambda e, i: ~F.get("x", i + 1)["t"].eqNullSafe(e["t"]))
    wells = wells.select("well_name", F.map_from_entries(F.filter(last, lambda e: e["t"].isNotNull())).alias("x"))
    wells = wells.select("well_name", F.transform(F.sequence(F.lit(0), F.lit(cfg.T - 1)), lambda t: F.try_element_at("x", t)).alias("x"))
    return wells.select("well_name", *[F.get("x", F.lit(t)).alias(f"m{t}") for t in range(cfg.T)])


def evaluate_forecasts(long: DataFrame) -> DataFrame:
    """rmse, smape, n_eval over the wells whose forecast months are all present on both sides."""
    rows = long.where("segment = 'forecast'")
    e, both = F.col("y_pred") - F.col("y_true"), F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()
    wells = rows.groupBy("well_name").agg(
        F.bool_and(both).alias("ok"), F.count("*").alias("n"), F.sum(e * e).alias("sq"), F.sum(2 * F.abs(e) / (F.abs("y_pred") + F.abs("y_true") + 1e-9)).alias("rel")
    )
    return wells.where("ok").agg(F.sqrt(F.sum("sq") / F.sum("n")).alias("rmse"), (F.sum("rel") / F.sum("n")).alias("smape"), F.count("*").alias("n_eval"))
