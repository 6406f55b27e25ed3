"""WARC archives: written by Spark's text writer, read back with boundary-chain verification.

A record is a row of text and the record terminator is the writer's line separator, so archives go to any file system
with Spark's commit protocol. Reading, tasks emit every offset that looks like a record with the offset of its successor;
pointer jumping from the start of each file then keeps only the records on the chain, so that record magic inside a
payload is never taken for a record.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sized

MAGIC, END = b"WARC/1.1\r\n", b"\r\n\r\n"
#: Classes of pages by bytes at most, and records of a class in an archive file: about 64 MB a file, which bounds what one task reads at once.
CLASSES = [(1 << 16, 1024), (1 << 20, 64), (1 << 23, 8), (1 << 31, 1)]
DATE = "2024-01-01T00:00:00Z"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four characters from each five hex digits."""
    h = F.sha1(data)
    parts = [F.conv(F.substring(h, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(F.lit(_BASE32), F.shiftright(p, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for p in parts for s in (15, 10, 5, 0)])


def write_archives(pages: DataFrame, path: str, scratch: Scratch | None = None) -> None:
    """One record for each row of pages (page_id, url, html, ...) in archive files under path.

    Among rows of equal payload those with the largest page_id are responses and the others revisit them. A null html is an
    empty payload; a null page_id or url leaves its header out, and such a row is a revisit if its payload has an id. Long pages are written whole,
    fewer of them to a file; repeated rows give records of their own; an empty table gives an archive without records; further columns are ignored.
    """
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    repeats = rows.select("page_id", "digest").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    both = rows.join(sized(scratch.table(repeats, "repeats")), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    payload = F.when(again, F.lit("")).otherwise(F.col("html"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("html")))),
        line("WARC-Refers-To", urn(F.when(again, F.col("first")))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(payload).cast("string")),
        F.lit("\r\n"),
        payload,
    )
    size = F.octet_length("html")
    kind = F.coalesce(*[F.when(size <= most, k) for k, (most, _) in enumerate(CLASSES)])
    there = {r["kind"] for r in rows.select(kind.alias("kind")).distinct().collect()}  # at most one for each class
    both = both.withColumn("kind", kind)
    for k, (_, records) in enumerate(CLASSES):
        if k in there or (k == 0 and not there):
            part = both.where(F.col("kind") == k) if len(there) > 1 else both
            part.select(record.alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records).text(path)


_LENGTH = re.compile(rb"\r\nContent-Length: (\d{1,15})\r\n")
_FIELDS = {"record_type": re.compile(rb"\r\nWARC-Type: (\w+)\r\n"), "page_id": re.compile(rb"\r\nWARC-Record-ID: <urn:page:(-?\d+)>\r\n"), "refers_to": re.compile(rb"\r\nWARC-Refers-To: <urn:page:(-?\d+)>\r\n"), "declared": re.compile(rb"\r\nWARC-Payload-Digest: sha1:(\w+)\r\n")}
_CANDIDATE = "file long, start long, body long, next long, record_type string, page_id long, refers_to long, declared string"
_RECORD = "record_type string, page_id long, refers_to long, declared string, payload_bytes long, payload_digest string, payload binary"
_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[dict], ddl: str) -> pa.RecordBatch:
    schema = pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in ddl.split(", "))])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def candidates(data: bytes) -> Iterator[dict]:
    """Every offset of data that looks like a record, with the offset of its successor; time is linear in data, however records nest.

    A record stands at the start or after the terminator of another, and its header ends at the next blank line: so no two headers
    overlap, and payloads are only looked at where they should end.
    """
    at = 0 if data.startswith(MAGIC) else _next(data, 0)
    while at >= 0:
        head = data.find(END, at)
        first, last = at + len(MAGIC) - 2, head + 2
        length = _LENGTH.search(data, first, last) if head >= 0 else None
        if length:
            body = head + len(END)
            end = body + int(length[1])
            if data.startswith(END, end):
                got = {k: (m[1].decode() if (m := p.search(data, first, last)) else None) for k, p in _FIELDS.items()}
                got |= {k: int(v) if (v := got[k]) is not None else None for k in ("page_id", "refers_to")}
                yield got | {"start": at, "body": body, "next": end + len(END)}
        at = _next(data, at)


def _next(data: bytes, at: int) -> int:
    found = data.find(END + MAGIC, at)
    return found + len(END) if found >= 0 else -1


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            file = b.column("file")[i].as_py()
            yield _batch([r | {"file": file} for r in candidates(b.column("content")[i].as_py())], _CANDIDATE)


def _payloads(with_payload: bool):
    """content, records (those on the chain) -> the records with the figures of their payloads; each byte is hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data, out = memoryview(b.column("content")[i].as_buffer()), []
                for r in b.column("records")[i].as_py():
                    payload = data[r.pop("body") : r.pop("next") - len(END)]
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    out.append(r | {"payload_bytes": len(payload), "payload_digest": digest, "payload": bytes(payload) if with_payload else None})
                yield _batch(out, _RECORD)

    return run


def read_archives(spark, path: str, with_payload: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Records of all archives under path: record_type, page_id, refers_to, declared, payload_bytes, payload_digest, payload.

    Only records on the chain from a file's start are kept, and only their payloads are read, in a second pass over the files. ValueError if a
    chain doesn't end at its file's end or a response's payload doesn't have the digest that its header declares. A folder without
    archives gives an empty result.
    """
    scratch = scratch or Scratch(spark, "warc")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.xxhash64("path").alias("file"), "content", "length").where("length > 0")
    found = scratch.table(files.select("file", "content").mapInArrow(_find, _CANDIDATE), "candidates")
    jump = found.select("file", "start", "next")
    kept = scratch.table(found.where("start = 0").select("file", "start"), "kept")
    n = kept.count()
    while True:
        grown = kept.union(kept.join(jump, ["file", "start"]).select("file", F.col("next").alias("start"))).distinct()
        grown = scratch.table(grown, "kept")
        scratch.drop(kept)
        kept, before, n = grown, n, grown.count()
        if n == before:
            break
        onward = jump.select("file", F.col("start").alias("next"), F.col("next").alias("over"))
        longer = scratch.table(jump.join(onward, ["file", "next"], "left").select("file", "start", F.coalesce("over", "next").alias("next")), "jump")
        if hasattr(jump, "_scratch_path"):
            scratch.drop(jump)
        jump = longer
    fields = [x.split()[0] for x in _CANDIDATE.split(", ") if not x.startswith(("file", "start"))]
    chain = scratch.table(found.join(kept, ["file", "start"]).groupBy("file").agg(F.max("next").alias("end"), F.collect_list(F.struct(*fields)).alias("records")), "chains")  # a file's records
    damaged = files.select("file", "length").join(chain.select("file", "end"), "file", "left").where("end is null or end <> length").count()
    if damaged:
        raise ValueError(f"{damaged} damaged archive files in {path}")
    whole = files.select("file", "content").join(sized(chain.select("file", "records")), "file").select("content", "records")
    records = scratch.table(whole.mapInArrow(_payloads(with_payload), _RECORD), "records")
    damaged = records.where("record_type = 'response' and declared <> payload_digest").count()
    if damaged:
        raise ValueError(f"{damaged} records in {path} whose payload isn't the one declared")
    scratch.drop(kept, found, chain)
    return records


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits have the figures of what they revisit."""
    response = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("declared"), F.col("payload_bytes").alias("full")).dropDuplicates(["refers_to", "declared"])
    again = records.where("record_type = 'revisit'").join(response, ["refers_to", "declared"], "left").select("page_id", F.col("full").alias("payload_bytes"), F.col("declared").alias("payload_digest"), "record_type", "refers_to")
    return records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(again)
