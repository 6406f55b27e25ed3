"""A training-data pipeline over documents: quality, lines, near duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next. All but
the last return the columns of documents. Null and empty texts, null ids, repeated rows and further columns of any name pass through every stage
as its operator's docstring says (a mixed document comes once or twice); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilia.llm import bpe, line_dedup, mixing, ngram_join, quality
from profilia.llm.common import Scratch, temporary


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, the same or similar, in an earlier document or place; none goes, some become empty."""
    rows = line_dedup.dedup_lines(docs).select("row")
    return rows.select(*[F.length("row.text").cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return ngram_join.one_of_each(docs, num=3, den=4)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words as often as the mix takes them: once, twice or not at all."""
    return mixing.mixed_documents(docs, mixing.mix_sources(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (packed little-endian unsigned 32-bit), decoded_sha256."""
    source = docs.select("doc_id", "source", "text")
    return bpe.encode_documents(source, bpe.default_rules(), keep=["source"]).select(
        "doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", distinct_lines),
    ("n-gram Jaccard join", one_of_near_duplicates),
    ("mixing sources", mixed_sources),
    ("BPE encoding and decoding", token_ids),
]

#: The classifier, MinHash and the random mix aren't SQL; tests/llm/test_pipeline.py checks each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with temporary():  # a stage's own tables go once its result is written, and so does the input of the stage
            docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
