"""A data source for folders of CSV files whose headers differ.

Planning opens the first bytes of each file, numbers the distinct headers and cuts the files into byte ranges; a partition is a bundle
of ranges of about SPLIT_BYTES with the headers that they need. So each data byte is read once, by the task that parses it, and
columns are matched by name in the task. Files are opened through pyarrow: local or mounted folders, and the stores that it knows.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import csv as arrow_csv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a partition, first bytes that are read of a file, files that planning opens at a time.
SPLIT_BYTES, HEAD_BYTES, OPENED = 32 << 20, 1 << 14, 32


@dataclass
class Splits(InputPartition):
    """pieces: path, first byte, end, number of the header in headers, byte at which the data of the file begin."""

    pieces: list[tuple[str, int, int, int, int]] = field(default_factory=list)
    headers: list[tuple[str, ...]] = field(default_factory=list)


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return store, [info]
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda p: any(x[:1] in "._" for x in p[len(root) :].split("/") if x)
    return store, sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(".csv") and f.size and not hidden(f.path)), key=lambda f: f.path)


def _head(store: fs.FileSystem, f: fs.FileInfo) -> tuple[tuple[str, ...], int]:
    """Names of the first line that isn't empty, and the byte after it."""
    with store.open_input_file(f.path) as src:
        text, at = b"", 0
        while True:
            more = src.read(HEAD_BYTES)
            text += more
            end = text.find(b"\n", at)
            while end >= 0 and not text[at:end].removeprefix(b"\xef\xbb\xbf").strip():
                at, end = end + 1, text.find(b"\n", end + 1)
            if end >= 0 or not more:
                line = text[at:] if end < 0 else text[at:end]
                names = next(csv.reader([line.decode("utf-8-sig", "replace").rstrip("\r")]), [])
                return tuple(x.lstrip("\ufeff").strip() for x in names), len(text) if end < 0 else end + 1


def _heads(path: str, renames: dict[str, str]) -> Iterator[tuple[fs.FileInfo, tuple[str, ...], int]]:
    store, files = _files(path)
    with ThreadPoolExecutor(OPENED) as pool:
        for f, (names, begin) in zip(files, pool.map(lambda f: _head(store, f), files), strict=True):
            yield f, tuple(renames.get(n, n) for n in names), begin


def plan(path: str, split_bytes: int = SPLIT_BYTES, renames: dict[str, str] | None = None) -> list[Splits]:
    """Partitions of about split_bytes over all files under path; each data byte belongs to one piece."""
    out, room = [], 0
    for f, names, begin in _heads(path, renames or {}):
        at = begin
        while at < f.size:
            if room <= 0:
                out.append(Splits())
                room = split_bytes
            part = out[-1]
            if names not in part.headers:
                part.headers.append(names)
            end = min(f.size, at + room)
            part.pieces.append((f.path, at, end, part.headers.index(names), begin))
            room -= end - at
            at = end
    return out


def _lines(src: pa.NativeFile, start: int, end: int, begin: int) -> bytes:
    """The lines that start in [start, end): a line belongs to the piece that holds its first byte."""
    src.seek(max(begin, start - 1))
    text = src.read(end - max(begin, start - 1))
    if start > begin:
        cut = text.find(b"\n")
        if cut < 0:
            return b""
        text = text[cut + 1 :]
    tail = []
    while text and not text.endswith(b"\n"):  # the last line goes on in the next piece
        more = src.read(HEAD_BYTES)
        if not more:
            break
        cut = more.find(b"\n")
        tail.append(more if cut < 0 else more[: cut + 1])
        if cut >= 0:
            break
    return text + b"".join(tail)


def parsed(text: bytes, names: tuple[str, ...], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Lines of CSV -> string columns by name, null where the file has no such column.

    Lines with too few values end in nulls, further values go, as in Spark's reader. An empty value is null, a quoted one the empty string
    (null in a line with too few or too many values). Of equal names the first counts. Bytes that aren't UTF-8 are replaced.
    """
    if not text.strip():
        return
    try:
        text.decode("utf-8")
    except UnicodeDecodeError:
        text = text.decode("utf-8", "replace").encode()
    keys = [f"{names.index(n)}" if n in names else "absent" for n in columns]
    odd: list[str] = []
    schema = pa.schema([(c, pa.string()) for c in columns])

    def ragged(row: arrow_csv.InvalidRow) -> str:
        odd.append(row.text)
        return "skip"

    used = sorted({k for k in keys if k != "absent"})
    table = arrow_csv.read_csv(
        io.BytesIO(text),
        read_options=arrow_csv.ReadOptions(column_names=[str(i) for i in range(len(names))], use_threads=False, block_size=max(1 << 20, 1 + max(map(len, text.split(b"\n"))))),
        parse_options=arrow_csv.ParseOptions(invalid_row_handler=ragged),
        convert_options=arrow_csv.ConvertOptions(column_types={k: pa.string() for k in used}, include_columns=used or ["0"], null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=False),
    )
    for b in table.to_batches():
        yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.string()) if k == "absent" else b.column(used.index(k)) for k in keys], schema=schema)
    if odd:
        rows = list(csv.reader(odd))
        value = lambda r, k: (r[int(k)] or None) if k != "absent" and int(k) < len(r) else None
        yield pa.RecordBatch.from_arrays([pa.array([value(r, k) for r in rows], pa.string()) for k in keys], schema=schema)


class FolderReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], split_bytes: int, renames: dict[str, str]):
        self.path, self.columns, self.split_bytes, self.renames = path, columns, split_bytes, renames

    def partitions(self) -> list[Splits]:
        return plan(self.path, self.split_bytes, self.renames) or [Splits()]

    def read(self, partition: Splits) -> Iterator[pa.RecordBatch]:
        store = _store(self.path)
        for path, start, end, head, begin in partition.pieces:
            with store.open_input_file(path) as src:
                text = _lines(src, start, end, begin)
            yield from parsed(text, partition.headers[head], self.columns)


def _store(path: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(path)[0] if "://" in path or path.startswith("file:") else fs.LocalFileSystem()


class CsvFolder(DataSource):
    """Format `csv_folder`, options path, splitBytes and renames (JSON, header to column); all columns are strings.

    Without a schema the columns are the names of all headers, in order.
    """

    @classmethod
    def name(cls) -> str:
        return "csv_folder"

    def schema(self) -> T.StructType:
        names = sorted({n for _, head, _ in _heads(self.options["path"], self._renames()) for n in head if n})
        return T.StructType([T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema: T.StructType) -> FolderReader:
        return FolderReader(self.options["path"], schema.fieldNames(), int(self.options.get("splitBytes", SPLIT_BYTES)), self._renames())

    def _renames(self) -> dict[str, str]:
        return json.loads(self.options.get("renames", "{}"))


def read_csv_folder(spark: SparkSession, path: str, schema: str | T.StructType | None = None, renames: dict[str, str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All CSV files under a folder, columns by name. schema: the columns wanted, with types; values that don't fit them become null."""
    spark.dataSource.register(CsvFolder)
    reader = spark.read.format("csv_folder").option("splitBytes", split_bytes).option("renames", json.dumps(renames or {}))
    if schema is None:
        return reader.load(path)
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    rows = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in wanted.fields])).load(path)
    return rows.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted.fields])
