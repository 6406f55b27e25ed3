"""Streams: arriving production files, and monthly rates under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import CANONICAL


def arriving_files(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Rows of Parquet files as they arrive; the query's checkpoint keeps what was read, so a restart goes on from there."""
    schema = "well_name string, date timestamp, oil double, water double, gas double, days_prod double"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).select(*CANONICAL)


def monthly_sums(rows: DataFrame, delay: str = "40 days") -> DataFrame:
    """Sums, days and rates for each well and month; a month is final once the watermark has passed its end.

    The event time is the end of a row's month, so the state holds one row for each well and open month; rows of months that ended more than
    `delay` before the latest month seen are left out. Negative volumes and days count as missing.
    """
    ended = rows.withColumn("month_end", F.last_day("date").cast("timestamp")).withWatermark("month_end", delay)
    present = {c: F.when(F.col(c) >= 0, F.col(c)) for c in ("oil", "water", "gas", "days_prod")}
    sums = ended.groupBy("well_name", "month_end").agg(*[F.sum(v).alias(c) for c, v in present.items()])
    rates = [F.when(F.col("days_prod") > 0, F.col(c) / F.col("days_prod")).alias(f"r_{c}") for c in ("oil", "water", "gas")]
    return sums.select("well_name", F.trunc(F.to_date("month_end"), "MM").alias("date"), "oil", "water", "gas", "days_prod", *rates)
