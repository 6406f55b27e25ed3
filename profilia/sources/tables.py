"""Readers: production CSV files, CSV files with a preamble, and adapters of star-schema tables to production rows."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .csv_folder import read_csv_folder

CANONICAL = ["well_name", "date", "oil", "water", "gas", "days_prod"]
RENAMES = {"API_WellNo": "well_name", "RptDate": "date", "BBLS_OIL_COND": "oil", "MCF_GAS": "gas", "BBLS_WTR": "water", "DAYS_PROD": "days_prod"}


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def canonical(df: DataFrame) -> DataFrame:
    """Typed production rows: bad numbers and dates become null, rows without a name or a date go."""
    require_columns(df, CANONICAL)
    kinds = dict(df.dtypes)
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    day = F.expr("try_cast(`date` as date)") if kinds["date"] == "string" else F.col("date").cast("date")
    out = df.select(F.col("well_name").cast("string").alias("well_name"), day.alias("date"), *[F.when(~F.isnan(number(c)) & (F.abs(number(c)) < float("inf")), number(c)).alias(c) for c in CANONICAL[2:]])
    return out.where("well_name is not null and date is not null")


def read_production_csv(spark: SparkSession, path: str, planned: bool | None = None) -> DataFrame:
    """All CSV files under a folder, their columns matched by name; unknown columns are dropped, absent ones null.

    planned: through the data source of csv_folder, which reads each byte once; by default where the path is a local or mounted folder.
    Otherwise (stores that only Spark reads) files are read by groups of equal headers, which takes a scan of the lines first.
    """
    if planned is None:
        planned = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file"
    if not planned:
        return canonical(_by_headers(spark, path))
    return canonical(read_csv_folder(spark, path, ", ".join(f"{c} string" for c in CANONICAL), RENAMES))


def _by_headers(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path)
    first = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("nth")).where("start = 0")
    heads = first.groupBy("path").agg(F.min_by("value", "nth").alias("head")).groupBy("head").agg(F.collect_list("path").alias("paths")).orderBy("head").collect()  # paths, which the driver lists anyway
    out = None
    for h in heads:
        rows = spark.read.option("header", True).csv(h["paths"])
        named = rows.withColumnsRenamed({c: RENAMES.get(c.lstrip("\ufeff").strip(), c.lstrip("\ufeff").strip()) for c in rows.columns})
        part = named.select(*[F.col(c).cast("string").alias(c) if c in named.columns else F.lit(None).cast("string").alias(c) for c in CANONICAL])
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], ", ".join(f"{c} string" for c in CANONICAL))


def _plain_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for path, text in zip(b["path"], b["value"], strict=True):
            try:
                rows = [r for r in csv.reader(io.StringIO(text.lstrip("\ufeff"))) if any(x.strip() for x in r)]
            except csv.Error:  # this file is skipped, the others are read
                continue
            if len(rows) < 4:
                continue
            trimmed = [r[: max(i + 1 for i, x in enumerate(r) if x.strip())] for r in rows]
            head = next((i for i, r in enumerate(trimmed[2:], 2) if {"api_wellno", "rptdate"} <= {x.strip().lower() for x in r}), None)
            if head is None:
                continue
            meta = dict(zip([x.strip() for x in trimmed[0]], [x.strip() for x in trimmed[1]], strict=False))
            names = [x.strip() for x in trimmed[head]]
            out += [(path, meta, dict(zip(names, r, strict=False))) for r in trimmed[head + 1 :]]
        yield pd.DataFrame(out, columns=["path", "meta", "row"])


def read_preamble_csv(spark: SparkSession, path: str) -> DataFrame:
    """path, meta map, row map of each data row of CSV files that begin with two rows of metadata; files without a header are skipped.

    A file is read whole by one task; one file is one well.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(_plain_rows, "path string, meta map<string,string>, `row` map<string,string>")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _well(prefix: str, key: str) -> F.Column:
    return F.concat(F.lit(prefix), F.lpad(F.col(key).cast("string"), 6, "0")).alias("well_name")


def supplier_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    return _read(spark, sf_dir, "lineitem").select(
        _well("S", "l_suppkey"), F.col("l_shipdate").cast("date").alias("date"), d("l_quantity").alias("oil"), (d("l_quantity") * d("l_discount") * 10).alias("water"), (d("l_extendedprice") / 1000).alias("gas"), d("l_linenumber").alias("days_prod")
    )


def part_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    return _read(spark, sf_dir, "lineitem").select(
        _well("P", "l_partkey"),
        F.col("l_shipdate").cast("date").alias("date"),
        (d("l_quantity") - 2).alias("oil"),
        (d("l_quantity") * d("l_discount") * 10).alias("water"),
        (d("l_extendedprice") / 1000).alias("gas"),
        F.when(F.col("l_returnflag") == "R", 0.0).otherwise(d("l_linenumber")).alias("days_prod"),
    )


def customer_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    price = F.col("o_totalprice").cast("double")
    both = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return both.select(
        _well("C", "o_custkey"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("c_mktsegment") == "BUILDING", 0.0).otherwise(price / 1000).alias("oil"),
        F.lit(0.0).alias("water"),
        (price / 5000).alias("gas"),
        F.lit(None).cast("double").alias("days_prod"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
