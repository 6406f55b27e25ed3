"""The plain pipeline: daily signals on a dense calendar, start by run length, complete rows, z-scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BaselineConfig
from ..functions import columns as C
from ..functions import series as S
from ..sources.tables import canonical
from .lineage import cut, dealt


def daily_signals(raw: DataFrame, cfg: BaselineConfig = BaselineConfig()) -> DataFrame:
    """Rows with bopd, mcfpd and bbl_mo; values above the well's clip quantile become missing."""
    rows = dealt(canonical(raw), raw.count()).withColumns({c: C.nonnegative(F.col(c)) for c in ("oil", "gas", "water")})
    rows = rows.withColumn("days_prod", F.when(F.col("days_prod") > 0, F.col("days_prod")))
    rows = rows.withColumns({"bopd": F.try_divide("oil", "days_prod"), "mcfpd": F.try_divide("gas", "days_prod"), "bbl_mo": F.col("oil")})
    whole = Window.partitionBy("well_name")
    top = {c: F.percentile(c, F.lit(cfg.clip_quantile)).over(whole) for c in ("bopd", "mcfpd", "bbl_mo")}
    return rows.withColumns({f"{c}_top": q for c, q in top.items()}).withColumns({c: F.when(F.col(c) <= F.col(f"{c}_top"), F.col(c)) for c in top}).drop(*[f"{c}_top" for c in top])


def monthly_signal(rows: DataFrame, cfg: BaselineConfig = BaselineConfig()) -> DataFrame:
    """well_name, date (month end), s on every month from the first to the last of a well; months without a value are missing."""
    sums = rows.groupBy("well_name", C.month_end(F.col("date")).alias("date")).agg(F.sum("oil").alias("oil"), F.sum("gas").alias("gas"), F.sum("days_prod").alias("days"))
    s = {"bopd": F.try_divide("oil", "days"), "mcfpd": F.try_divide("gas", "days"), "bbl_mo": F.col("oil")}[cfg.signal]
    sums = sums.select("well_name", "date", s.alias("s"))
    spine = sums.groupBy("well_name").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    months = F.sequence(F.trunc("a", "MM"), F.trunc("b", "MM"), F.expr("interval 1 month"))
    spine = spine.select("well_name", F.explode(months).alias("m")).select("well_name", F.last_day("m").alias("date"))
    return spine.join(sums, ["well_name", "date"], "left")


def interpolated_signal(signal: DataFrame) -> DataFrame:
    w = Window.partitionBy("well_name").orderBy("date")
    signal = cut(signal)
    signal = dealt(signal, signal.count())
    out = signal.withColumn("i", F.row_number().over(w) - 1)
    return out.withColumn("f", S.interpolated(F.col("s"), F.col("i"), w, Window.partitionBy("well_name").orderBy(F.desc("date"))))


def filled_signal(signal: DataFrame, empty: float = 0.0) -> DataFrame:
    """The monthly signal with months that have no value as `empty`: the sum over a month without rows is 0."""
    return signal.withColumn("s", F.coalesce("s", F.lit(empty)))


def monthly_means(rows: DataFrame, column: str) -> DataFrame:
    """well_name, date (month end), s: the mean of a column's present values in each month that has rows; for signals that can't be summed."""
    return rows.groupBy("well_name", C.month_end(F.col("date")).alias("date")).agg(F.avg(column).alias("s"))


def run_starts(filled: DataFrame, cfg: BaselineConfig = BaselineConfig()) -> DataFrame:
    """well_name, start: where a run of min_consec months at the threshold begins; wells without one are absent."""
    whole = Window.partitionBy("well_name")
    ahead = whole.orderBy("i").rowsBetween(0, cfg.min_consec - 1)
    flag = (F.col("f") >= cfg.start_fraction * F.col("top")).cast("int")
    rows = filled.withColumn("top", F.max("f").over(whole)).where("top > 0").withColumn("flag", flag)
    rows = rows.withColumns({"all": F.min("flag").over(ahead), "k": F.count("flag").over(ahead)})
    return rows.where((F.col("all") == 1) & (F.col("k") == cfg.min_consec)).groupBy("well_name").agg(F.min("i").alias("start"))


def wide_matrix(filled: DataFrame, starts: DataFrame, cfg: BaselineConfig = BaselineConfig()) -> DataFrame:
    """well_name and v, the signal from the start on, for wells that fill the horizon."""
    total = filled.groupBy("well_name").agg(F.sum("s").alias("total")).where("total <> 0").select("well_name")
    rows = filled.join(starts, "well_name").join(total, "well_name").withColumn("t", F.col("i") - F.col("start")).where(F.col("t").between(0, cfg.horizon - 1))
    packed = rows.groupBy("well_name").agg(F.sort_array(F.collect_list(F.struct("t", "f"))).alias("a"))
    return packed.where((F.size("a") == cfg.horizon) & F.forall("a", lambda x: x["f"].isNotNull())).select("well_name", F.transform("a", lambda x: x["f"]).alias("v"))


def zscored(wide: DataFrame) -> DataFrame:
    """(x - mean) / (population deviation + 1e-8) within each row."""
    n = F.size("v")
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / n
    rows = wide.withColumn("mean", mean).withColumn("sd", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x - F.col("mean")) * (x - F.col("mean"))) / n))
    return rows.select("well_name", F.transform("v", lambda x: (x - F.col("mean")) / (F.col("sd") + 1e-8)).alias("v"))
