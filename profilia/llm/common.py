"""Shared helpers: scratch tables in the cluster's shared folder, size-checked broadcasts, row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes, measured over all rows, up to which a side is broadcast; for one column of ids more, as they pack densely.
BROADCAST_BYTES, BROADCAST_ID_BYTES = 24 << 20, 32 << 20
#: Rows that a task writes at least where a table's size is known beforehand.
TASK_ROWS = 100_000

_open: list[list[Scratch]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset and driver and executors are one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="profilia-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


class Scratch:
    """Parquet tables under the shared folder that cut lineage; any executor can read them again after a loss.

    A lazy result may still read them: drop_all() once it is written, or let temporary() do so.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        if _open:
            _open[-1].append(self)

    def table(self, df: DataFrame, name: str = "t", most: int | None = None) -> DataFrame:
        """most: rows that df has at most, if known; small tables are then written by few tasks."""
        self._n += 1
        if most is not None:
            df = df.coalesce(max(1, -(-most // TASK_ROWS)))
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if "_scratch_path" in vars(t):  # not what was selected from a table
                delete(self.spark, t._scratch_path)

    def drop_all(self) -> None:
        delete(self.spark, self.root)


@contextmanager
def temporary() -> Iterator[None]:
    """Drops every Scratch that was made inside; results must be written by then."""
    _open.append([])
    try:
        yield
    finally:
        for s in _open.pop():
            s.drop_all()


def _width(field: T.StructField) -> Column:
    """Bytes of a column's values beyond its fixed 8."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(c)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return 8 * F.size(c)
    if isinstance(kind, T.StructType):
        return F.lit(16 * len(kind.fields))
    return F.lit(0) if isinstance(kind, (T.NumericType, T.BooleanType)) else F.octet_length(F.to_json(F.struct(c)))


def sized(df: DataFrame) -> DataFrame:
    """df (a scratch table) marked for broadcast if the bytes of all its rows, measured, allow it, else left to a shuffled join."""
    n = len(df.columns)
    extra = [F.coalesce(_width(f), F.lit(0)).cast("long") for f in df.schema.fields]
    rows, wide = df.agg(F.count("*"), F.coalesce(F.sum(sum(extra[1:], extra[0])), F.lit(0))).first()
    return F.broadcast(df) if rows * (16 + 16 * n) + wide <= (BROADCAST_ID_BYTES if n == 1 else BROADCAST_BYTES) else df


def _hashable(c: Column, kind: T.DataType) -> Column:
    return F.to_json(F.struct(c)) if "map<" in kind.simpleString() else c


def row_key(*cols: str | Column) -> Column:
    """A 64-bit key of a row's content that is defined for nulls and equal for repeated rows."""
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.xxhash64(*[x for c in cols for x in (c, c.isNull())])


def whole_row_key(df: DataFrame) -> Column:
    """row_key over all columns of df."""
    return row_key(*[_hashable(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])
