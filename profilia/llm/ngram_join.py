"""N-gram Jaccard join of documents: rare-first prefix filtering, length, positional and suffix filters.

1. One scan gives each document its set size and a digest of its shingle set. Equal sets form a class, which
   takes part once. The same scan fills a frequency sketch of fixed size that counts the shingles of all texts.
2. A second scan orders each set rare first (sketch level, then hash) and keeps the prefix that any partner at the
   threshold must share a member with. Every task first aggregates its own prefix entries: it links the classes
   that share a shingle to the smallest of them and forwards only that one, so a shingle sends at most one
   entry for each task however many documents hold it.
3. Buckets of shingles do the same among tasks. Components grow from hub pairs (see linking.py), of which texts whose sets agree in two
   of four extremes (smallest and largest hashes) make more, so that groups of near copies are one component before pairs are listed; the pairs that share a
   prefix shingle and still lie in different components are enumerated with the positional and length filters.
4. Before any set is sent, a pair must pass the length filter and a bound from the parities of both sets' shingles by their low
   bits: each bit in which they differ stands for a shingle that one set lacks. In the last join a pair leaves at the first prefix
   shingle that it shares and at few others, however many they are. Each candidate pair is verified once, behind a suffix filter.

Only counters and the sketch (SKETCH_BITS, 4 MiB) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_key, sized
from .linking import linked_components
from .shingles import set_digest, shingle_sets, slices

SKETCH_BITS = 22
PARTS = 64
#: Parity bits of a set, a multiple of 64.
PARITIES = 2048
#: Partners that a class meets in one place when pairs are verified.
FAN = 500
#: Prefix entries that a task gathers before it aggregates them, and that a bucket holds on average.
FLUSH, BUCKET = 2_000_000, 500_000


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """A row of PARITIES bits, as 64-bit integers, for each set: how many members fall on each bit, modulo 2."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bit = (np.concatenate(sets) & np.uint64(PARITIES - 1)).astype(np.int64)
    odd = np.bincount(owner * PARITIES + bit, minlength=len(sets) * PARITIES).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(sets), PARITIES), axis=1).view(np.int64)


_SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)
#: Pairs of the four values of extremes() that make a key.
SKETCHES = ((0, 1), (2, 3), (0, 3), (1, 2))


def extremes(sets: list[np.ndarray]) -> np.ndarray:
    """For each sorted set its smallest and largest member, and the same of its members in another order; an empty set has zeros."""
    size = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), 4), np.uint64)
    some = size > 0
    if some.any():
        members = np.concatenate(sets)
        begin = (np.cumsum(size) - size)[some]
        with np.errstate(over="ignore"):
            other = members * _SCRAMBLE
        out[some] = np.stack([members[begin], members[begin + size[some] - 1], np.minimum.reduceat(other, begin), np.maximum.reduceat(other, begin)], axis=1)
    return out.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    names = ["part", "counts", "doc_id", "rk", "n", "cls", "bits", "ends"]
    for part, texts in slices(batches, "text"):
        sets = shingle_sets(texts)
        cells = np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)
        counts += np.bincount(cells.astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
        k = len(sets)
        bits = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * (PARITIES // 64)), pa.array(parities(sets).ravel()))
        ends = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * 4), pa.array(extremes(sets).ravel()))
        found = [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) for s in sets], pa.int64()), bits, ends]
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), part.column("doc_id"), part.column("rk"), *found], names=names)
    for p, x in enumerate(counts.reshape(PARTS, -1)):
        if x.any():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([x.tobytes()], pa.binary())] + [pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.list_(pa.int64()))] * 2, names=names)


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the sketch parts that reach this task; gives eight levels for each doubling of the count."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sums[p] = sums.get(p, 0) + np.frombuffer(x, np.uint32).astype(np.uint64)
    for p, x in sums.items():
        level = np.minimum(255, 8 * np.log2(x + 1.0)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["part", "levels"])


def _runs(key: np.ndarray, cls: np.ndarray, pos: np.ndarray):
    """Sorted distinct (key, cls) entries with the index of the first entry of each key and each entry's key index."""
    order = np.lexsort((cls, key))
    key, cls, pos = key[order], cls[order], pos[order]
    keep = np.concatenate(([True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])))
    key, cls, pos = key[keep], cls[keep], pos[keep]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    return key, cls, pos, np.flatnonzero(new), np.cumsum(new) - 1


def _stars(key: np.ndarray, cls: np.ndarray, pos: np.ndarray):
    """Hub pairs with the number of shared keys, entries of keys with several classes, and one entry for each key."""
    key, cls, pos, first, run = _runs(key, cls, pos)
    size = np.diff(np.append(first, len(key)))
    many = size[run] > 1
    hub = cls[first][run]
    star = many & (hub != cls)
    pairs, counts = np.unique(np.stack([hub[star], cls[star]]), axis=1, return_counts=True) if star.any() else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
    return (pairs[0], pairs[1], counts), (key[many], cls[many], pos[many]), (key[first], cls[first], pos[first])


_ENTRY = np.dtype([("key", "<u8"), ("cls", "<i8"), ("pos", "<u2")])
_NAMES = ["bucket", "kind", "data"]


def _prefix_entries(levels, n_buckets: int, num: int, den: int):
    """mapInArrow function: texts -> packed entries, aggregated in the task; kind 0 entry, 1 hub pair, 2 shared entry."""

    def rows(kind: int, data: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(bucket):
            return
        order = np.argsort(bucket, kind="stable")
        data, bucket = data[order], bucket[order]
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        for a, b in zip(first, [*first[1:], len(bucket)], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])], pa.int32()), pa.array([kind], pa.int32()), pa.array([data[a:b].tobytes()], pa.binary())], names=_NAMES)

    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        (a, b, c), shared, one = _stars(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        for kind, (key, cls, pos) in ((0, one), (2, shared)):
            e = np.zeros(len(key), _ENTRY)
            e["key"], e["cls"], e["pos"] = key, cls, pos
            yield from rows(kind, e, (key % np.uint64(n_buckets)).astype(np.int64))
        p = np.stack([a, b, c], axis=1).astype("<i8") if len(a) else np.zeros((0, 3), "<i8")
        yield from rows(1, p, b % n_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        parts, held, seen = [], 0, set()
        for _, texts in slices(batches, "text"):
            for s in shingle_sets(texts):
                if not len(s) or (cls := set_digest(s)) in seen:
                    continue
                if len(seen) < FLUSH:
                    seen.add(cls)
                n = len(s)
                k = n - -(-num * n // den) + 1
                lv = level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                rank = np.argsort(lv, kind="stable")[:k]  # s is sorted by hash, so ties go by hash
                parts.append((s[rank], np.full(k, cls, np.int64), np.minimum(np.arange(k), 65535).astype(np.uint16)))
                held += k
                if held >= FLUSH:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


def _bucket(table: pa.Table) -> pa.Table:
    """One bucket of keys: hub pairs and shared entries, with those that the tasks found themselves."""
    by: dict[int, list[bytes]] = {0: [], 1: [], 2: []}
    for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
        by[kind].append(data)
    e = np.frombuffer(b"".join(by[0]), _ENTRY)
    own = np.frombuffer(b"".join(by[2]), _ENTRY)
    p = np.frombuffer(b"".join(by[1]), "<i8").reshape(-1, 3)
    (a, b, c), (key, cls, pos), _ = _stars(e["key"], e["cls"], e["pos"]) if len(e) else ((p[:0, 0],) * 3, (own["key"][:0], own["cls"][:0], own["pos"][:0]), None)
    a, b, c = np.concatenate([a, p[:, 0]]), np.concatenate([b, p[:, 1]]), np.concatenate([c, p[:, 2]])
    key, cls, pos = (np.concatenate([x, own[f]]) for x, f in ((key, "key"), (cls, "cls"), (pos, "pos")))
    if len(key):
        key, cls, pos, *_ = _runs(key, cls, pos)
    none = np.zeros(len(key), bool)
    return pa.table(
        {
            "key": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(key.astype(np.int64))]),
            "a": pa.concat_arrays([pa.array(a.astype(np.int64)), pa.array(cls.astype(np.int64))]),
            "b": pa.concat_arrays([pa.array(b.astype(np.int64)), pa.array(none.astype(np.int64), mask=~none)]),
            "w": pa.concat_arrays([pa.array(c.astype(np.int64)), pa.array(pos.astype(np.int64))]),
        }
    )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set of each class, once for each task."""
    seen: set[int] = set()
    for _, texts in slices(batches, "text"):
        rows = []
        for s in shingle_sets(texts):
            cls = set_digest(s)
            if cls not in seen:
                rows.append((cls, s.tobytes()))
            if len(seen) < FLUSH:
                seen.add(cls)
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["cls", "members"])


def _far(x: np.ndarray, y: np.ndarray, most: int, depth: int = 3) -> int:
    """Suffix filter: a lower bound of the number of members in one sorted set only, by splitting both at a pivot."""
    if depth == 0 or len(x) < 16 or len(y) < 16:
        return abs(len(x) - len(y))
    pivot = y[len(y) // 2]
    i, j = np.searchsorted(x, pivot), len(y) // 2
    low = abs(int(i) - j) + abs(len(x) - int(i) - len(y) + j)
    if low > most:
        return low
    left = _far(x[:i], y[:j], most, depth - 1)
    return left if left > most else left + _far(x[i:], y[j:], most - left, depth - 1)


def similar(x: np.ndarray, y: np.ndarray, num: int = 3, den: int = 4) -> bool:
    """den * intersection >= num * union, for sorted distinct members."""
    total = len(x) + len(y)
    most = total - 2 * -(-num * total // (num + den))
    if _far(x, y, most) > most:
        return False
    both = np.concatenate([x, y])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return den * inter >= num * (total - inter)


def _verify(num: int, den: int):
    """mapInArrow function over (dest, hub, cls, members) in order of dest, the hub's set first: the hub against each of its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub, own = None, None, None
        for b in batches:
            out: list[tuple[int, int]] = []
            for dest, h, cls, x in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                members = np.frombuffer(x, np.uint64)
                if h:
                    at, hub, own = dest, cls, members
                elif dest == at and similar(own, members, num, den):
                    out.append((hub, cls))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([d for _, d in out], pa.int64())], names=["src", "dst"])

    return run


def ngram_jaccard_components(docs: DataFrame, num: int = 3, den: int = 4, scratch: Scratch | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, class_id, root, rk: one row for each row of docs.

    Two documents link when den * |A & B| >= num * |A | B| for their sets of 5-word shingles. component_id is the
    smallest doc_id reachable by links, class_id tells equal sets apart, root components and rk rows. Null and blank texts have no shingles, link
    with nothing and keep their own doc_id; a null doc_id takes part and is reported under its component's smallest
    id; repeated rows are returned as often as they occur; an empty table gives an empty result; further columns of
    docs are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ngram")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("rk", row_key("doc_id", "text"))
    scan = scratch.table(rows.mapInArrow(_signatures, "part int, counts binary, doc_id long, rk long, n long, cls long, bits array<long>, ends array<long>"), "signatures")
    info = scan.where("part is null").select("doc_id", "rk", "n", "cls")
    filled = info.where("n > 0")
    classes = scratch.table(filled.groupBy("cls").agg(F.min("rk").alias("rk"), F.min("n").alias("n"), F.min("doc_id").alias("least")), "classes", scan.count())
    n_classes = classes.count()

    parts = scan.where("part is not null").select("part", "counts").repartition("part").mapInArrow(_levels, "part int, levels binary").collect()
    levels = np.zeros((PARTS, (1 << SKETCH_BITS) // PARTS), np.uint8)
    for p in parts:
        levels[p["part"]] = np.frombuffer(p["levels"], np.uint8)
    sketch = spark.sparkContext.broadcast(levels.tobytes())
    members = classes.agg(F.sum("n")).first()[0] or 0
    n_buckets = max(1, -(-members * (den - num) // (den * BUCKET)))
    entries = rows.select("text").mapInArrow(_prefix_entries(sketch, n_buckets, num, den), "bucket int, kind int, data binary")
    found = scratch.table(entries.groupBy("bucket").applyInArrow(_bucket, "key long, a long, b long, w long"), "prefixes")

    size = classes.select("cls", "n")

    def near(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that lengths and parities allow."""
        ids = scratch.table(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), f"{name}-classes", n_classes)
        marks = scan.where("n > 0").select("cls", "n", "bits").join(sized(ids), "cls", "left_semi").groupBy("cls").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
        marks = scratch.table(marks, f"{name}-marks", n_classes)
        x, y = (marks.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
        differ = F.aggregate(F.zip_with("bitsa", "bitsb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k)
        sizes = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
        out = pairs.join(x, "a").join(y, "b").where(sizes & (differ * (num + den) <= (F.col("na") + F.col("nb")) * (den - num))).select("a", "b")
        out = scratch.table(out, f"{name}-near")
        scratch.drop(ids, marks)
        return out

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Sends a's set and each partner's to one place, FAN partners to a place, and compares them there."""
        pairs = near(pairs, name)
        places = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("places"))
        n = pairs.count()
        pairs = pairs.select("a", "b").join(places, "a").withColumn("dest", F.xxhash64("a", F.pmod(F.xxhash64("b"), "places")))
        route = pairs.select("dest", F.lit(False).alias("hub"), F.col("b").alias("cls")).union(pairs.select("dest", F.lit(True), "a").distinct())
        route = scratch.table(route, f"{name}-routes", 2 * n)
        wanted = scratch.table(route.select("cls").distinct().join(classes, "cls").select("rk").distinct(), f"{name}-ids", min(2 * n, n_classes))
        sets = rows.join(sized(wanted), "rk", "left_semi").select("text").mapInArrow(_sets, "cls long, members binary")
        sent = sets.join(sized(route), "cls").select("dest", "hub", "cls", "members").repartition("dest").sortWithinPartitions("dest", F.desc("hub"), "cls")
        sent = sent.coalesce(max(1, -(-n // (4 * FAN))))  # whole partitions one after the other: a place stays together and in order
        out = scratch.table(sent.mapInArrow(_verify(num, den), "src long, dst long"), f"{name}-links")
        scratch.drop(wanted, route, pairs)
        return out

    stars = found.where("key is null").groupBy("a", "b").agg(F.sum("w").alias("w"))
    hubs = stars.groupBy("b").agg(F.max_by("a", F.struct("w", "a")).alias("a")).select("a", "b")
    # a hub by prefixes may be a text that shares just a passage; texts alike in two extremes are mostly alike as a whole
    ends = scan.where("n > 0").groupBy("cls").agg(F.first("ends").alias("e"))
    marks = [F.xxhash64(F.lit(k), F.get("e", F.lit(x)), F.get("e", F.lit(y))) for k, (x, y) in enumerate(SKETCHES)]
    alike = scratch.table(ends.select("cls", F.explode(F.array(*marks)).alias("key")), "alike", n_classes * len(marks))
    least = alike.groupBy("key").agg(F.min("cls").alias("a"), F.max("cls").alias("last")).where("a < last").select("key", "a")
    mates = alike.join(least, "key").where("a <> cls").select("a", F.col("cls").alias("b"))
    best = scratch.table(hubs.union(mates).distinct(), "hub-pairs", n_classes * (1 + len(marks)))
    scratch.drop(alike)
    shared = found.where("key is not null").select("key", F.col("a").alias("id"), F.col("w").alias("pos")).join(size.withColumnRenamed("cls", "id"), "id")
    shared = scratch.table(shared, "shared", found.count())
    scratch.drop(found)
    both = F.col("l.n") + F.col("r.n")
    rest = F.least(F.col("l.n") - F.col("l.pos"), F.col("r.n") - F.col("r.pos"))
    possible = (F.least("l.n", "r.n") * den >= F.greatest("l.n", "r.n") * num) & (rest * (num + den) >= both * num)
    comps = linked_components(shared, best, verified, scratch, possible)
    sketch.unpersist()

    root = classes.join(comps.select(F.col("id").alias("cls"), "component"), "cls", "left").select("cls", F.coalesce("component", "cls").alias("root"), "least")
    least = root.groupBy("root").agg(F.min("least").alias("component_id"))
    label = scratch.table(root.join(least, "root").select("cls", "root", "component_id"), "labels", n_classes)
    scratch.drop(shared, best)
    full = filled.join(label, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("cls").alias("class_id"), "root", "rk")
    blank = info.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("root"), "rk")
    return full.unionByName(blank)


def one_of_each(docs: DataFrame, num: int = 3, den: int = 4) -> DataFrame:
    """The rows of docs, all columns, without near duplicates: of each component the row with the smallest doc_id stays.

    Ids that are null come last; of rows that agree in id and text one stays; rows without any word all stay.
    """
    scratch = Scratch(docs.sparkSession, "ngram")
    found = ngram_jaccard_components(docs, num, den, scratch).where("root is not null").select("root", "rk", F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rk").alias("place"))
    found = scratch.table(found, "found")
    keep = found.groupBy("root").agg(F.min("place").alias("keep"))
    rows = found.groupBy("root", "rk").agg(F.count("*").alias("n")).join(keep, "root")
    odd = scratch.table(rows.where((F.col("rk") != F.col("keep.rk")) | (F.col("n") > 1)).select("rk", (F.col("rk") == F.col("keep.rk")).alias("again")), "odd")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("rk"))
    single = keyed.join(sized(odd.select("rk")), "rk", "left_anti").select("row")
    repeated = keyed.join(sized(odd.where("again").select("rk")), "rk", "left_semi").groupBy("rk").agg(F.first("row").alias("row")).select("row")
    return single.union(repeated).select("row.*")
