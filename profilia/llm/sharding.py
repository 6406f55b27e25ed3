"""Size-tiered compaction of append-only shards under versioned manifests, with DataFrame operations only.

A store is a folder: data/<batch>/part-* are immutable Parquet shards, manifests/v<n> is the table of the shards that make up
version n. Arrivals are appended as the small shards that their tasks write, without a shuffle. Compaction looks at
the manifest only to find runs: shards are put in tiers by size, each tier's shards are packed in order into runs of
about the target size, and the rows of a run are rewritten as one file by one task, which reads the run's files and no others. A
version appears by one atomic rename of its finished manifest; of two writers of the same version the second fails and can try
again. Files that a version no longer names stay readable for older versions until they are removed; files of a writer that hasn't
committed yet are kept for a day.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import delete, sized

#: Bytes of a merged file; shards below TARGET * FULL are merged; each tier spans a factor of FAN in size.
TARGET, FULL, FAN = 32 << 20, 0.75, 4
#: Shards that are packed into runs together; appends of a table at most; files that one scan names.
GROUP, ARRIVALS, FILES = 1024, 100, 5_000
#: Seconds for which remove_unused keeps folders that no manifest names: their writers may be about to commit.
GRACE = 86_400
_MANIFEST = "file string, bytes long, rows long, tier int, batch string"


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET):
        self.spark, self.root, self.target = spark, root, target

    # manifests

    def versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v"))

    def manifest(self, version: int | None = None) -> DataFrame:
        """file, bytes, rows, tier, batch of each shard of a version, by default the last."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifests/v{version}")

    def _commit(self, manifest: DataFrame, version: int) -> int:
        """Publishes a manifest as `version`; FileExistsError if another writer was first."""
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        manifest.select([c.split()[0] for c in _MANIFEST.split(", ")]).write.parquet(staged)
        fsp = self.spark._jvm.org.apache.hadoop.fs
        a, b = fsp.Path(staged), fsp.Path(f"{self.root}/manifests/v{version}")
        fs = a.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(b.getParent())
        if fs.exists(b):
            raise FileExistsError(f"version {version} exists")
        context = fsp.FileContext.getFileContext(b.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(fsp.Options.Rename, 0)
        try:
            context.rename(a, b, options)  # atomic, and never onto a manifest that is there
        except Exception as e:
            if fs.exists(b):
                raise FileExistsError(f"version {version} exists") from e
            raise
        return version

    def _shards(self, batch: str, schema: T.StructType) -> DataFrame:
        """The manifest rows of a written batch, from its files' sizes and footers."""
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/data/{batch}")
        about = rows.metadataColumn("_metadata")  # also where a column has that name
        rows = rows.select(about["file_path"].alias("file_path"), about["file_size"].alias("file_size"))
        shards = rows.groupBy(F.col("file_path").alias("file")).agg(F.max("file_size").alias("bytes"), F.count("*").alias("rows"))
        tier = F.greatest(F.lit(0), F.floor(F.log(float(FAN), F.col("bytes").cast("double") / (self.target / FAN**4)))).cast("int")
        return shards.select("file", "bytes", "rows", tier.alias("tier"), F.lit(batch).alias("batch"))

    # operations

    def append(self, rows: DataFrame) -> int:
        """Adds an arrival as small shards, one for each task that holds some of it; gives the new version."""
        version, batch = max(self.versions(), default=0), f"append-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.root}/data/{batch}")
        return self._commit(self.manifest(version).unionByName(self._shards(batch, rows.schema)), version + 1)

    def runs(self, least: int = FAN) -> DataFrame:
        """file, run of each shard that is to be merged: shards of a tier, dealt into groups of about GROUP and packed to about the target size.

        A run has two shards or more; a group of a tier waits until it holds `least`.
        """
        small = self.manifest().where(F.col("bytes") < self.target * FULL)
        numbered = small.withColumn("part", F.pmod(F.xxhash64("file"), F.lit(-(-max(1, small.count()) // GROUP))))
        group = Window.partitionBy("tier", "part")
        numbered = numbered.withColumn("have", F.count("*").over(group)).where(F.col("have") >= least)
        packed = numbered.withColumn("bin", F.floor((F.sum("bytes").over(group.orderBy("file")) - F.col("bytes")) / self.target))
        run = packed.select("file", F.xxhash64("tier", "part", "bin").alias("run"))
        several = run.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run")
        return run.join(several, "run").select("file", "run")

    def _scan(self, files: list[str], schema: T.StructType) -> DataFrame:
        """row and file, whatever the columns are called."""
        rows = self.spark.read.schema(schema).parquet(*files)
        return rows.select(F.struct(*[F.col(f"`{c}`") for c in schema.names]).alias("row"), rows.metadataColumn("_metadata")["file_path"].alias("file"))

    def compact(self, schema: T.StructType, least: int = FAN) -> int:
        """Merges runs of similar shards into files of about the target size; gives the new version, or the last if there are none."""
        version = max(self.versions(), default=0)
        before = self.manifest(version)
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        self.runs(least).write.parquet(staged)
        runs = self.spark.read.schema("file string, run long").parquet(staged)
        sizes = runs.groupBy("run").agg(F.count("*").alias("n")).orderBy("run").collect()  # one for each merged file
        if not sizes:
            delete(self.spark, staged)
            return version
        batch = f"merge-{uuid.uuid4().hex}"
        waves: list[dict[int, int]] = [{}]  # runs of about FILES files together, numbered
        held = 0
        for r in sizes:
            if waves[-1] and held + r["n"] > FILES:
                waves.append({})
                held = 0
            waves[-1][r["run"]] = len(waves[-1])
            held += r["n"]
        for i, place in enumerate(waves):
            wave = {r["file"]: place[r["run"]] for r in runs.where(F.col("run").between(min(place), max(place))).collect()}
            dealt = self.spark.createDataFrame(list(wave.items()), "file string, place int")
            merged = self._scan(list(wave), schema).join(F.broadcast(dealt), "file").repartitionById(len(place), "place").select("row.*")  # a run for each task
            merged.write.option("compression", "zstd").parquet(f"{self.root}/data/{batch}/{i:08d}")
        kept = before.join(runs.select("file"), "file", "left_anti")
        done = self._commit(kept.unionByName(self._shards(batch, schema)), version + 1)
        delete(self.spark, staged)
        return done

    def compact_all(self, schema: T.StructType) -> int:
        """Compacts until no tier holds two shards to merge: merged files that are still small meet those of the tier they reach."""
        version = max(self.versions(), default=0)
        while (after := self.compact(schema, least=2)) != version:
            version = after
        return version

    def read(self, schema: T.StructType, version: int | None = None, with_file: bool = False) -> DataFrame:
        """The rows of a version, from the files that its manifest names and no others; with_file: as `row`, with the `file` that holds it."""
        files = [r["file"] for r in self.manifest(version).select("file").orderBy("file").collect()]  # names, which a scan's driver lists anyway
        if not files:
            none = T.StructType([T.StructField("row", schema), T.StructField("file", T.StringType())])
            return self.spark.createDataFrame([], none if with_file else schema)
        rows = reduce(DataFrame.union, [self._scan(files[i : i + FILES], schema) for i in range(0, len(files), FILES)])
        return rows if with_file else rows.select(*[F.col("row")[c].alias(c) for c in schema.names])

    def remove_unused(self, grace: float = GRACE) -> None:
        """Deletes the folders of batches that the last version doesn't name and that are older than `grace` seconds; older versions can't be read then."""
        named = {r[0] for r in self.manifest().select("batch").distinct().collect()}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/data")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for s in fs.listStatus(path) if fs.exists(path) else []:
            if s.getPath().getName() not in named and s.getModificationTime() / 1000 <= time.time() - grace:
                fs.delete(s.getPath(), True)


def shard_documents(docs: DataFrame, root: str, arrivals: str = "lang", target: int = TARGET) -> DataFrame:
    """Appends docs arrival by arrival (a value of the column `arrivals` each, or several together if there are many), compacts them and reads the last version back.

    Gives all columns of docs as `row` with file, tier, batch, file_rows, file_bytes of the shard that holds the row. Nulls in any column,
    empty and very long texts and repeated rows are stored as they are; rows whose arrival is null form an arrival; an
    empty table gives an empty store and result; columns of any name are kept.
    """
    store = ShardStore(docs.sparkSession, root, target)
    names = [r[0] for r in docs.select(F.col(arrivals)).distinct().orderBy(arrivals).limit(ARRIVALS + 1).collect()]
    if len(names) > ARRIVALS:  # values that share a hash arrive together
        part = F.pmod(F.xxhash64(F.col(arrivals)), F.lit(ARRIVALS))
        arriving = [part == F.lit(k) for k in range(ARRIVALS)]
    else:
        arriving = [F.col(arrivals).eqNullSafe(F.lit(name)) for name in names]
    for rows in arriving:
        store.append(docs.where(rows))
    store.compact_all(docs.schema)
    rows = store.read(docs.schema, with_file=True)
    about = store.manifest().select("file", "tier", "batch", F.col("rows").alias("file_rows"), F.col("bytes").alias("file_bytes"))
    return rows.join(sized(about), "file")
