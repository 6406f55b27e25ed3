"""Fuzzy line dedup with DataFrame operations only.

A line, lower-cased and trimmed, has as shingles the SHINGLE characters (UTF-16 units) from each character on, or itself if it is
shorter. MinHash: each shingle is hashed once, and the permutations order by that hash XOR a number of their own; the minima of a line
form BANDS bands of ROWS. Lines that share a band are candidates; exact Jaccard similarity of the
shingle sets, as 64-bit hashes, decides; connected components of the links keep one line, the first by document and position.

Lines meet hubs first and the pairs of a band that lie in different components afterwards (see linking.py), so large groups
of similar lines cost a few comparisons for each line and no pair of a band is left out. What is left is compared inside the
join by bit sets of the shingles, which bound the similarity from above, before any text is sent. Lines are cut from the texts once.

Equal lines have equal 64-bit ids and equal check hashes (another seed). Of different lines that share an id, which 128 bits tell
apart, the one with the largest check hash takes part in the fuzzy comparison and all are compared for equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sized, whole_row_key
from .linking import linked_components

SHINGLE = 12
BANDS, ROWS = 6, 2
#: Bits of the hash that a permutation orders by.
FIELD = 31
#: A permutation orders by the hash XOR its number; the numbers differ in their first four bits, so each one's minimum is sought in another sixteenth.
ORDERS = [(k << (FIELD - 4)) | (0x9E3779B97F4A7C15 * (k + 1) >> 20) % (1 << (FIELD - 4)) for k in range(BANDS * ROWS)]
#: Shingles of a row that is aggregated.
STEP = 4
#: Similarity of 4/5 or more.
NUM, DEN = 4, 5
#: 64-bit words of a line's bit set.
WORDS = 16
_BLANKS = " \t\n\x0b\f\r"


def _positions(line: str) -> tuple[Column, Column]:
    """The line's UTF-16 units as bytes, and the number of its shingles."""
    units = F.encode(F.col(line), "UTF-16BE")
    return units, F.greatest(F.lit(1), F.floor(F.octet_length(units) / 2).cast("int") - (SHINGLE - 1))


def shingle_hashes(line: str) -> Column:
    """The set of a line's shingles as an array of 64-bit hashes."""
    return F.array_distinct(_hashes(line))


def _hashes(line: str) -> Column:
    units, n = _positions(line)
    each = lambda u: F.transform(F.sequence(F.lit(1), 2 * n - 1, F.lit(2)), lambda p: F.xxhash64(F.substring(u, p, F.lit(2 * SHINGLE))))
    return F.transform(F.array(units), each)[0]


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, rk, pos, line: every line that isn't blank."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_row_key(docs).alias("rk"), F.lower(F.col("text").cast("string")).alias("text"))
    rows = rows.select("doc_id", "rk", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    return rows.select("doc_id", "rk", "pos", F.btrim("raw", F.lit(_BLANKS)).alias("line")).where("line <> ''")


def _keyed(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"id": F.xxhash64("line"), "chk": F.xxhash64("line", F.lit(1))})


def signatures(lines: DataFrame) -> DataFrame:
    """lines (id, line), repeated or not -> id, bands; shingles are aggregated where the lines are read, STEP of them in a row."""
    units, n = _positions("line")
    rows = lines.select("id", units.alias("u"), n.alias("n")).select("id", "u", "n", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(STEP))).alias("p"))
    at = lambda i: F.least(F.col("p") + i, F.col("n")) if i else F.col("p")
    hashed = lambda i: F.shiftrightunsigned(F.xxhash64(F.substring("u", 2 * at(i) - 1, F.lit(2 * SHINGLE))), 64 - FIELD)
    each = rows.select("id", *[hashed(i).alias(f"h{i}") for i in range(STEP)])
    least = [F.min(F.least(*[F.col(f"h{i}").bitwiseXOR(F.lit(c)) for i in range(STEP)])).alias(f"m{k}") for k, c in enumerate(ORDERS)]
    bands = F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{b * ROWS + r}") for r in range(ROWS)]) for b in range(BANDS)])
    return each.groupBy("id").agg(*least).select("id", bands.alias("bands"))


def bit_sets(texts: DataFrame) -> DataFrame:
    """texts (id, line), an id once -> id, n (shingles, those that repeat counted again), w0 .. (the bits that shingles fall on).

    Repeated shingles change no bit, so none has to be found here; n and the number of bits enclose the size of the set.
    """
    units, n = _positions("line")
    rows = texts.select("id", units.alias("u"), n.alias("n")).select("id", "u", F.explode(F.sequence(F.lit(1), 2 * F.col("n") - 1, F.lit(2))).alias("p"))
    each = rows.select("id", F.xxhash64(F.substring("u", F.col("p"), F.lit(2 * SHINGLE))).alias("h"))
    each = each.select("id", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int")).alias("bit"), F.shiftright("h", 6).bitwiseAND(F.lit(WORDS - 1)).alias("part"))
    words = [F.bit_or(F.when(F.col("part") == w, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(WORDS)]
    return each.groupBy("id").agg(F.count("*").alias("n"), *words)


def possible(l: str, r: str) -> Column:
    """Whether sizes and bit sets allow the similarity: each bit in which two sets differ stands for a shingle that one of them lacks."""
    word = lambda side, w: F.col(f"{side}.w{w}")
    total = lambda f: sum((F.bit_count(f(w)) for w in range(1, WORDS)), F.bit_count(f(0)))
    differ, some, other = total(lambda w: word(l, w).bitwiseXOR(word(r, w))), total(lambda w: word(l, w)), total(lambda w: word(r, w))
    x, y = F.col(f"{l}.n"), F.col(f"{r}.n")
    return (differ * (NUM + DEN) <= (x + y) * (DEN - NUM)) & (DEN * x >= NUM * other) & (DEN * y >= NUM * some)


def parity_sets(texts: DataFrame) -> DataFrame:
    """As bit_sets, with n the size of the set and parities of its shingles instead of bits: a closer bound that costs several times as much."""
    each = texts.select("id", F.explode(shingle_hashes("line")).alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    part = F.shiftright("h", 6).bitwiseAND(F.lit(WORDS - 1))
    words = [F.bit_xor(F.when(part == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(WORDS)]
    return each.groupBy("id").agg(F.count("*").alias("n"), *words)


def similar(x: str, y: str) -> Column:
    """Whether the shingle sets of two lines are similar; their sizes are counted only where repeated shingles may decide it."""

    def enough(z: Column) -> Column:
        both = F.size(F.array_intersect(z["x"], z["y"])) * (NUM + DEN)
        sizes = lambda f: (F.size(f(z["x"])) + F.size(f(z["y"]))) * NUM
        return (both >= sizes(lambda a: a)) | (both >= sizes(F.array_distinct))

    return F.transform(F.array(F.struct(_hashes(x).alias("x"), _hashes(y).alias("y"))), enough)[0]


def duplicate_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """rk, gone, kept, copies of each row with lines that occur elsewhere or resemble others: positions that go and that stay, and how often the row occurs."""
    lines = scratch.table(_keyed(_lines(docs)), "lines")
    places = lines.drop("line")
    signed = scratch.table(signatures(lines.select("id", "line")), "bands")
    each = signed.select("id", F.explode("bands").alias("key"))
    hubs = scratch.table(each.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub"), "hubs")
    shared = scratch.table(each.join(sized(hubs), "key"), "shared")
    ids = scratch.table(shared.select("id").distinct(), "candidate-ids")
    met = lines.select("id", "line", "chk").join(sized(ids), "id", "left_semi").distinct()
    texts = scratch.table(met.select("id", "line", "chk"), "candidate-lines")
    if texts.count() > ids.count():  # different lines with the same id
        texts = scratch.table(texts.groupBy("id").agg(F.max_by("line", "chk").alias("line"), F.max("chk").alias("chk")), "one-line-each")
    marked = scratch.table(bit_sets(texts), "bit-sets")
    marks = ["n", *[f"w{w}" for w in range(WORDS)]]
    scratch.drop(signed, hubs, ids)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        def bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
            side = lambda c: sets.select(F.col("id").alias(c), F.struct(*marks).alias(f"m{c}"))
            return scratch.table(pairs.join(side("a"), "a").join(side("b"), "b").where(possible("ma", "mb")).select("a", "b"), f"{name}-near")

        near = bounded(pairs, marked)
        wanted = scratch.table(near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), f"{name}-ids")
        some = texts.join(sized(wanted), "id", "left_semi")
        if near.count() > wanted.count():  # a line is in several pairs
            parities, wide = scratch.table(parity_sets(some), f"{name}-parities"), near
            near = bounded(wide, parities)
            scratch.drop(parities, wide)
        x, y = some.select(F.col("id").alias("a"), F.col("line").alias("x")), some.select(F.col("id").alias("b"), F.col("line").alias("y"))
        links = near.join(x, "a").join(y, "b").where(similar("x", "y"))
        out = scratch.table(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), f"{name}-links")
        scratch.drop(near, wanted)
        return out

    stars = shared.where("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("n"))
    best = stars.groupBy("id").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub")).select(F.col("hub").alias("a"), F.col("id").alias("b"))
    comps = linked_components(shared.select("key", "id"), best, verified, scratch, possible("l", "r"), marked)
    fuzzy = scratch.table(comps.join(texts.select("id", "chk"), "id").select("id", "chk", "component"), "fuzzy")
    scratch.drop(shared, marked, texts)

    counts = places.groupBy("id", "chk").agg(F.count("*").alias("n"))
    group = [F.coalesce("component", "id").alias("g"), F.when(F.col("component").isNull(), F.col("chk")).otherwise(0).alias("c")]
    repeated = scratch.table(counts.join(sized(fuzzy), ["id", "chk"], "left").where("n > 1 or component is not null").select("id", "chk", *group), "repeated")
    members = scratch.table(places.join(sized(repeated), ["id", "chk"]).select("g", "c", "doc_id", "rk", "pos"), "members")
    keep = scratch.table(members.groupBy("g", "c").agg(F.min(F.struct("doc_id", "rk", "pos")).alias("keep")), "keep")
    stays = (F.col("keep.rk") == F.col("rk")) & (F.col("keep.pos") == F.col("pos"))
    found = members.join(sized(keep), ["g", "c"]).groupBy("rk").agg(F.collect_set(F.when(~stays, F.col("pos"))).alias("gone"), F.collect_set(F.when(stays, F.col("pos"))).alias("kept"), F.count("*").alias("n"))
    copies = (F.col("n") / (F.size("gone") + F.size("kept"))).cast("long")
    found = found.withColumn("copies", copies).where("size(gone) > 0 or copies > 1")
    out = scratch.table(found.select("rk", "gone", F.when(F.col("copies") > 1, F.col("kept")).alias("kept"), "copies"), "dropped")
    scratch.drop(lines, fuzzy, repeated, members, keep)
    return out


def dedup_lines(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> columns row (that of docs, with the text that stays), n_lines, n_dropped.

    n_lines counts the lines that aren't blank; blank lines always stay. A null text stays null, an empty one empty. Of rows that
    are equal in all columns one keeps what stays of their lines and the others lose all lines. A null doc_id comes first in order. Texts and
    lines of any length are read whole. Columns of docs keep their names and values, whatever they are called. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    gone = duplicate_lines(docs, scratch)
    repeats = not gone.where("copies > 1").isEmpty()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), whole_row_key(docs).alias("rk")).join(sized(gone if repeats else gone.select("rk", "gone")), "rk", "left")
    if not repeats:
        rows = rows.select("row", "gone")
    else:
        again = rows.where("copies > 1").groupBy("rk").agg(F.first("row").alias("row"), F.first("gone").alias("gone"), F.first("kept").alias("kept"), F.count("*").alias("n"))
        again = again.select("row", "gone", "kept", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth"))
        again = again.select("row", F.when(F.col("nth") == 1, F.col("gone")).otherwise(F.array_union("gone", "kept")).alias("gone"))
        rows = rows.where("copies is null or copies = 1").select("row", "gone").union(again)
    parts = F.split("row.text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    text = F.transform(F.array(F.struct(parts.alias("p"), stay.alias("s"))), lambda x: F.array_join(F.transform(x["s"], lambda i: F.element_at(x["p"], i + 1)), "\n"))[0]
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(F.filter(parts, lambda p: F.btrim(p, F.lit(_BLANKS)) != "")))
    return rows.select(
        F.col("row").withField("text", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(text)).alias("row"),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
