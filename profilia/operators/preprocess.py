"""Production rows -> aligned, smoothed and normalised monthly panel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import PrepConfig
from ..functions import columns as C
from ..functions import series as S
from ..sources.tables import canonical
from .lineage import cut, dealt

VOLUMES = ("oil", "water", "gas")


def producing_rows(raw: DataFrame) -> DataFrame:
    """Rows whose three volumes are all present and not negative."""
    return canonical(raw).where(" and ".join(f"{c} >= 0" for c in VOLUMES))


def sample_wells(rows: DataFrame, n: int, seed: int = 43) -> DataFrame:
    """All rows of n wells, the first by the MD5 of seed and name; all wells if there are no more."""
    wells = rows.select("well_name").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "well_name").cast("binary")), "well_name").limit(n)
    return rows.join(wells, "well_name", "left_semi")


def monthly_rates(raw: DataFrame, cfg: PrepConfig = PrepConfig()) -> DataFrame:
    """One row for each well and present month: sums, effective days and daily rates. A month without any value sums to 0."""
    rows = canonical(raw)
    if cfg.clamp_nonnegative:
        rows = rows.withColumns({c: C.nonnegative(F.col(c)) for c in (*VOLUMES, "days_prod")})
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    grid = rows.groupBy("well_name", C.month_start(F.col("date")).alias("date")).agg(
        *[total(c).alias(f"{c}_sum") for c in VOLUMES], total("days_prod").alias("days_sum"), F.count_if(F.col("days_prod") > 0).alias("valid_days")
    )
    grid = dealt(grid, raw.count())  # a bound; the windows that follow take this partitioning
    grid = grid.withColumn("days_eff", F.when(F.col("valid_days") > 0, F.col("days_sum")).otherwise(C.nominal_days(F.col("date"), cfg.days_mode)))
    return grid.withColumns({f"r_{c}": C.rate(F.col(f"{c}_sum"), F.col("days_eff"), cfg.eps) for c in VOLUMES})


def smooth_rates(rates: DataFrame, cfg: PrepConfig = PrepConfig()) -> DataFrame:
    """Winsorized rates r_*, smoothed r_*_s, position i and length n of the series."""
    whole = Window.partitionBy("well_name")
    w, back = whole.orderBy("date"), whole.orderBy(F.desc("date"))
    out = rates.withColumns({f"r_{c}": S.winsorized(F.col(f"r_{c}"), cfg.winsorize_low, cfg.winsorize_high, whole) for c in VOLUMES})
    out = out.withColumns({"i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(whole)})
    base = {f"r_{c}_s": F.col(f"r_{c}") for c in VOLUMES}
    if cfg.interpolate_gaps:
        base = {k: S.interpolated(v, F.col("i"), w, back) for k, v in base.items()}
    out = out.withColumns(base)
    out = out.withColumns({k: S.smoothed(F.col(k), F.col("i"), F.col("n"), w, cfg.smooth_window, cfg.smooth_poly) for k in base})
    if cfg.clamp_nonnegative:
        out = out.withColumns({k: F.when(F.col(k) < 0, 0.0).otherwise(F.col(k)) for k in base})
    return out


def add_channels(smooth: DataFrame, cfg: PrepConfig = PrepConfig()) -> DataFrame:
    """Ratios, peak-normalised channels, the first difference, and the start of production of the whole series."""
    whole = Window.partitionBy("well_name")
    w = whole.orderBy("date")
    peak = F.max("r_oil_s").over(whole)
    out = smooth.withColumns({"wc": C.water_cut(F.col("r_oil_s"), F.col("r_water_s"), cfg.eps), "gor": C.gas_oil_ratio(F.col("r_oil_s"), F.col("r_gas_s"), cfg.eps), "peak": peak})
    scale = F.when(F.col("peak") > cfg.eps, F.col("peak")).otherwise(1.0) if cfg.normalize_by_peak else F.lit(1.0 - cfg.eps)
    out = out.withColumns({f"r_{c}_norm": F.col(f"r_{c}_s") / (scale + F.lit(cfg.eps)) for c in VOLUMES})
    threshold = F.greatest(F.lit(cfg.prod_threshold_abs), F.lit(cfg.prod_threshold_rel) * F.coalesce("peak", F.lit(0.0)))
    return out.withColumns({"dr_oil_norm": F.col("r_oil_norm") - F.lag("r_oil_norm").over(w), "start": F.min(F.when(F.col("r_oil_s") >= threshold, F.col("i"))).over(whole)})


PANEL = ["well_name", "t", "date", "oil_sum", "water_sum", "gas_sum", "days_sum", "valid_days", "days_eff", "r_oil", "r_water", "r_gas", "r_oil_s", "r_water_s", "r_gas_s", "wc", "gor", "r_oil_norm", "r_water_norm", "r_gas_norm", "dr_oil_norm"]


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """rows with their place from 0 in the order of the unique column `by`: ranges are numbered on their own and shifted by the rows before them."""
    ranged = cut(rows.repartitionByRange(by).withColumn("__part", F.spark_partition_id()))
    before = ranged.groupBy("__part").agg(F.count("*").alias("n"))  # one row for each partition
    offsets = before.withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "offset")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(by)) - 1
    return ranged.withColumn("__k", inside).join(F.broadcast(offsets), "__part").withColumn(name, F.col("offset") + F.col("__k")).drop("__part", "__k", "offset")


def gathered(indexed: DataFrame, ordinals: DataFrame, index: str = "well_idx") -> DataFrame:
    """indexed, whose rows are numbered by `index`, and ordinals (place, index) -> place and the columns of the row with that number.

    An ordinal may come several times; one beyond the rows, or null, gives a row of nulls.
    """
    return ordinals.select("place", index).join(indexed, index, "left")


@dataclass
class Profiles:
    """Lazy results: panel, the wells that were dropped with their reasons, and their counts."""

    panel: DataFrame
    dropped: DataFrame
    config: PrepConfig

    @property
    def dropped_summary(self) -> DataFrame:
        return self.dropped.groupBy("reason").agg(F.count("*").alias("count"))

    @property
    def wells(self) -> DataFrame:
        """well_name with its explicit place in the order of names."""
        return numbered(self.panel.select("well_name").distinct(), "well_name", "well_idx")

    def tensor(self) -> DataFrame:
        """An array of length T for each channel and well, null where the profile has ended."""
        return padded(self.panel, self.config.tensor_channels, self.config.T)


def padded(panel: DataFrame, channels: tuple[str, ...], T: int) -> DataFrame:
    """well_name and one array of T values for each channel."""
    maps = [F.map_from_entries(F.collect_list(F.struct("t", c))).alias(c) for c in channels]
    out = panel.where(F.col("t").between(0, T - 1)).groupBy("well_name").agg(*maps)
    at = lambda c: F.transform(F.sequence(F.lit(0), F.lit(T - 1)), lambda t: F.try_element_at(F.col(c), t))
    return out.select("well_name", *[at(c).alias(c) for c in channels])


def preprocess_profiles(raw: DataFrame, cfg: PrepConfig = PrepConfig()) -> Profiles:
    """All steps: rates, smoothing, channels, alignment to the start of production, length check, cut to T months."""
    full = add_channels(smooth_rates(monthly_rates(raw, cfg), cfg), cfg)
    whole = Window.partitionBy("well_name")
    after = F.count(F.when(F.col("i") >= F.col("start"), F.col("r_oil_s"))).over(whole)
    full = full.withColumn("valid", after)
    long_enough = F.col("start").isNotNull() & (F.col("valid") >= cfg.min_profile_months)
    panel = full.where(long_enough & (F.col("i") >= F.col("start")) & (F.col("i") < F.col("start") + cfg.T)).withColumn("t", (F.col("i") - F.col("start")).cast("int")).select(*PANEL)
    reason = F.when(F.col("start").isNull(), "no_start_detected").when(F.col("valid") < cfg.min_profile_months, f"too_short(<{cfg.min_profile_months})")
    dropped = full.where("i = 0").select("well_name", reason.alias("reason")).where("reason is not null")
    return Profiles(panel, dropped, cfg)
