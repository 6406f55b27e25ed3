"""Descriptors of a profile's shape, and their robust scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as S
from ..sources.tables import require_columns
from .lineage import cut
from .quantiles import exact_quantiles

FEATURES = ["peak_oil", "t_peak", "t_half", "t_20", "early_mean6", "early_mean12", "early_trend6", "mid_trend12", "vol_doil_w6", "vol_doil_w12", "wc_mean12", "wc_trend12", "gor_trend12", "plateau_len", "valid_ratio"]


def compute_side_features(panel: DataFrame, T: int = 36) -> DataFrame:
    """One row for each well. t_half and t_20 are the first months at or below half and a fifth of the peak."""
    require_columns(panel, ["well_name", "t", "r_oil_s", "r_oil_norm", "wc", "gor", "dr_oil_norm"])
    whole = Window.partitionBy("well_name")
    w = whole.orderBy("t")
    p = panel.where(F.col("t").between(0, T - 1)).withColumns(
        {
            "peak": F.max("r_oil_s").over(whole),
            "nth": F.row_number().over(w) - 1,
            "s_oil": S.mean_slope(F.col("r_oil_norm"), F.col("t"), w, 12),
            "s_wc": S.mean_slope(F.col("wc"), F.col("t"), w, 12),
            "s_gor": S.mean_slope(F.col("gor"), F.col("t"), w, 12),
            "d6": S.rolling_std(F.col("dr_oil_norm"), w, 6),
            "d12": S.rolling_std(F.col("dr_oil_norm"), w, 12),
        }
    )
    nth, oil = F.col("nth"), F.col("r_oil_s")
    first = lambda n, c: F.when(nth < n, F.col(c))
    low = F.col("r_oil_norm").isNull() | (F.col("r_oil_norm") < 0.9)
    return p.groupBy("well_name").agg(
        F.max("r_oil_s").alias("peak_oil"),
        F.min(F.when(oil == F.col("peak"), nth)).cast("int").alias("t_peak"),
        F.min(F.when(oil <= 0.5 * F.col("peak"), nth)).cast("int").alias("t_half"),
        F.min(F.when(oil <= 0.2 * F.col("peak"), nth)).cast("int").alias("t_20"),
        F.avg(first(6, "r_oil_norm")).alias("early_mean6"),
        F.avg(first(12, "r_oil_norm")).alias("early_mean12"),
        F.when(F.count_if(nth < 6) >= 3, F.regr_slope(first(6, "r_oil_norm"), nth.cast("double"))).alias("early_trend6"),
        F.avg("s_oil").alias("mid_trend12"),
        F.avg("d6").alias("vol_doil_w6"),
        F.avg("d12").alias("vol_doil_w12"),
        F.avg(first(12, "wc")).alias("wc_mean12"),
        F.avg("s_wc").alias("wc_trend12"),
        F.avg("s_gor").alias("gor_trend12"),
        F.coalesce(F.min(F.when(low, nth)), F.count("*")).cast("int").alias("plateau_len"),
        (F.count("r_oil_s") / F.lit(float(max(1, T)))).alias("valid_ratio"),
    )


def scale_features(features: DataFrame, key: str = "well_name") -> DataFrame:
    """(x - median) / (q75 - q25) of each column with exact quantiles; a spread of 0 counts as 1, nulls stay."""
    cols = [c for c in features.columns if c != key]
    features = cut(features)  # read for the quantiles and for the rows
    stats = exact_quantiles(features, cols, [0.25, 0.5, 0.75])

    def scaled(c: str) -> Column:
        low, mid, high = stats[c]
        return F.lit(None).cast("double") if mid is None else (F.col(c) - mid) / ((high - low) or 1.0)

    return features.select(key, *[scaled(c).alias(c) for c in cols])
