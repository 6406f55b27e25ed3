"""Cutting lineage in iterative operators with tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a series' table that one task sorts.
DEALT = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="profilia-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def dealt(df: DataFrame, rows: int, key: str = "well_name") -> DataFrame:
    """df by its key in as many tasks as `rows`, its size or a bound of it, call for; windows over the key then grow in number of tasks and not in size."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // DEALT)), key)


def cut(df: DataFrame) -> DataFrame:
    """df, written under spark.checkpoint.dir and read again: any executor can go on from it, and plans know its true size.

    checkpoint() would carry the estimates of the plan it ends, which a loop of joins squares in each round.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
