"""Mixing sources to target weights, with DataFrame operations only.

Every source's words are laid end to end and packed into blocks of BLOCK words. Output shards of SHARD slots draw multinomial
counts of the sources; what a source draws beyond its target's blocks goes, in order, to sources below theirs. What a source then lacks
to its target, less than two blocks, comes from its next slots, the last of them in part, so that each source comes out at its target to the
word. A source's slots, numbered over all shards, are mapped to its blocks by one pseudorandom permutation of
the block indexes after the other (a Feistel network on a rectangle, walked until it stays within range), and blocks
are joined by index. As no target exceeds twice its source, no block is used more than twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, row_key, sized

WORD = r"[^\x20\x09-\x0D]+"
BLOCK, SHARD = 64, 8192
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
#: Rows of a source in a chunk of its layout, bins of the unit interval that source draws are looked up by, steps of a walk.
CHUNK_ROWS, BINS, WALK = 10_000, 4096, 64
#: Slots that a task draws or permutes.
TASK_SLOTS = 200_000
SEED = 20240101


@dataclass
class Mix:
    """documents: doc_id, rk, source, sid, size, at; sources: sid, source, size, target, blocks, quota (whole slots); draws: sid, shard, block;
    uses: sid, block, uses, part (how many of the block's first words are used once more)."""

    documents: DataFrame
    sources: DataFrame
    draws: DataFrame
    uses: DataFrame


def _layout(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    rows = scratch.table(rows.select("doc_id", "source", size.alias("size"), row_key("doc_id", "source", "text").alias("rk")), "sizes")
    n_chunks = max(1, -(-rows.count() // CHUNK_ROWS))
    chunk = rows.withColumn("chunk", F.pmod("rk", F.lit(n_chunks)))
    sums = chunk.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0)))
    by_source = scratch.table(sums.groupBy("source").agg(F.sum("words").alias("size")), "by-source")
    # one row for each source from here
    ids = by_source.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1)
    ids = scratch.table(ids.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS)).cast("int") + 1)), "sources")
    keys = sums.select("source", "chunk", "base")
    inside = Window.partitionBy("source", "chunk").orderBy("doc_id", "rk").rowsBetween(Window.unboundedPreceding, -1)
    placed = chunk.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    k, s = keys.alias("k"), ids.select("source", "sid").alias("s")
    placed = placed.alias("p").join(k, F.col("p.source").eqNullSafe(F.col("k.source")) & (F.col("p.chunk") == F.col("k.chunk"))).join(sized(s), F.col("p.source").eqNullSafe(F.col("s.source")))
    return scratch.table(placed.select("p.doc_id", "p.rk", "p.source", "sid", "p.size", (F.col("base") + F.col("inside")).alias("at")), "layout"), ids


def _targets(sources: DataFrame) -> DataFrame:
    """Shares SHARE of all words by weight; a source stops at LIMIT times its size and the excess is shared anew."""
    total, weight = sources.agg(F.sum("size"), F.sum("weight")).first()
    total, rate, last = SHARE * (total or 0), 0.0, -1.0
    if total:
        rate = total / weight
        while rate != last:
            over = LIMIT * F.col("size") < F.lit(rate) * F.col("weight")
            full, rest = sources.agg(F.sum(F.when(over, LIMIT * F.col("size"))), F.sum(F.when(~over, F.col("weight")))).first()
            last, rate = rate, max(rate, (total - (full or 0)) / rest)
    target = F.least(F.lit(rate) * F.col("weight"), LIMIT * F.col("size").cast("double"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    turns = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("size"), F.lit(0))), F.lit(0)).cast("long")
    rest = F.floor((F.col("target") - turns * F.col("size")) / BLOCK).cast("long")
    return sources.withColumn("target", target).withColumn("blocks", blocks).withColumn("quota", turns * F.col("blocks") + rest)


def _uniform(*key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") * 2.0**-53


def _draw(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """(sid, shard, n, first): how many slots of a shard each source gets, and the number of its slots before them."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("quota")).first()[0] or 0
    upto = F.sum("quota").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    edges = sources.where("quota > 0").select("sid", "quota", upto.alias("upto")).select("sid", ((F.col("upto") - F.col("quota")) / F.lit(float(total or 1))).alias("lo"), (F.col("upto") / F.lit(float(total or 1))).alias("hi"))
    last_bin = F.least(F.lit(BINS - 1), F.floor(F.col("hi") * BINS)).cast("int")
    bins = scratch.table(edges.select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * BINS).cast("int"), last_bin)).alias("bin")), "bins")
    slots = spark.range(0, total, 1, max(1, -(-total // TASK_SLOTS))).select(F.floor(F.col("id") / SHARD).cast("long").alias("shard"), _uniform(F.lit(SEED), F.col("id")).alias("u"))
    drawn = slots.withColumn("bin", F.floor(F.col("u") * BINS).cast("int")).join(sized(bins), "bin").where("u >= lo and u < hi")
    counts = scratch.table(drawn.groupBy("sid", "shard").agg(F.count("*").alias("n")), "multinomial")
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    quota = sources.select("sid", "quota")
    kept = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(sized(quota), "sid")
    kept = scratch.table(kept.select("sid", "shard", "n", F.least("n", F.greatest(F.col("quota") - F.col("before"), F.lit(0))).alias("kept")), "kept")
    # the excess, about the square root of all slots
    over = kept.where("n > kept").select("shard", "sid", F.explode(F.sequence(F.lit(1), (F.col("n") - F.col("kept")).cast("int"))).alias("j"))
    over = over.select("shard", F.row_number().over(Window.orderBy("shard", "sid", "j")).alias("k"))
    have = kept.groupBy("sid").agg(F.sum("kept").alias("have"))
    under = quota.join(have, "sid", "left").withColumn("lack", F.col("quota") - F.coalesce("have", F.lit(0))).where("lack > 0")
    under = under.select("sid", F.explode(F.sequence(F.lit(1), F.col("lack").cast("int"))).alias("j"))
    under = under.select("sid", F.row_number().over(Window.orderBy("sid", "j")).alias("k"))
    moved = over.join(under, "k").groupBy("sid", "shard").agg(F.count("*").alias("kept"))
    final = kept.select("sid", "shard", "kept").unionByName(moved).groupBy("sid", "shard").agg(F.sum("kept").alias("n")).where("n > 0")
    return final.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def permuted(i: Column, n: Column, *key: Column) -> Column:
    """The image of i under a pseudorandom permutation of 0 .. n-1 that the key selects."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def once(x: Column) -> Column:
        left, right = F.floor(x / b).cast("long"), F.pmod(x, b)
        for k in range(3):
            left = F.pmod(left + F.pmod(F.xxhash64(*key, F.lit(2 * k), right), a), a)
            right = F.pmod(right + F.pmod(F.xxhash64(*key, F.lit(2 * k + 1), left), b), b)
        return left * b + right

    def walk(x: Column) -> Column:
        step = lambda y, _: F.when(y < n, y).otherwise(once(y))
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), x, step)

    home = F.transform(F.array(once(i)), lambda y: F.when(y < n, y).otherwise(walk(y)))
    return F.transform(home, lambda y: F.when(y < n, y).otherwise(F.raise_error(F.lit("a walk did not come home")).cast("long")))[0]


def _block_of(r: Column) -> Column:
    """The block of a source's slot r, for rows with sid and blocks."""
    return permuted(F.pmod(r, F.col("blocks")), F.col("blocks"), F.lit(SEED), F.col("sid"), F.floor(r / F.col("blocks")).cast("long"))


def _tails(sources: DataFrame, uses: DataFrame) -> DataFrame:
    """(sid, block, uses, part): what the whole slots leave of each source's target, from its next two slots."""
    words = lambda block: F.when(block == F.col("blocks") - 1, F.col("size") - BLOCK * (F.col("blocks") - 1)).otherwise(BLOCK)
    some = sources.where("size > 0")
    have = uses.join(sized(some.select("sid", "size", "blocks")), "sid").groupBy("sid").agg(F.sum(F.col("uses") * words(F.col("block"))).alias("have"))
    lack = some.join(have, "sid", "left").withColumn("lack", F.round("target").cast("long") - F.coalesce("have", F.lit(0)))
    two = lack.select("*", _block_of(F.col("quota")).alias("b0"), _block_of(F.col("quota") + 1).alias("b1"))
    two = two.withColumn("x0", F.least("lack", words(F.col("b0")))).withColumn("x1", F.col("lack") - F.col("x0"))
    each = two.select("sid", F.explode(F.array(*[F.struct(F.col(f"b{k}").alias("block"), F.col(f"x{k}").alias("x"), words(F.col(f"b{k}")).alias("w")) for k in (0, 1)])).alias("t")).where("t.x > 0")
    return each.select("sid", "t.block", F.when(F.col("t.x") == F.col("t.w"), 1).otherwise(0).cast("long").alias("uses"), F.when(F.col("t.x") < F.col("t.w"), F.col("t.x")).otherwise(0).cast("long").alias("part"))


def mix_sources(docs: DataFrame, scratch: Scratch | None = None) -> Mix:
    """docs (doc_id, text, source, ...) -> the mix. A null text has no words, a null source is a source, the last.

    Repeated rows take places of their own; sources without words get nothing; an empty table gives an empty mix; further
    columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    layout, ids = _layout(docs, scratch)
    sources = scratch.table(_targets(ids), "targets")
    shares = scratch.table(_draw(sources, scratch), "shares")
    n_slots = sources.agg(F.sum("quota")).first()[0] or 0
    spread = shares.repartition(max(1, -(-n_slots // TASK_SLOTS)), "sid", "shard")  # few rows that become many
    slots = spread.select("sid", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("r")).join(sized(sources.select("sid", "blocks")), "sid")
    draws = slots.select("sid", "shard", _block_of(F.col("r")).alias("block"))
    whole = scratch.table(draws.groupBy("sid", "block").agg(F.count("*").alias("uses")), "whole-slots")
    uses = whole.withColumn("part", F.lit(0).cast("long")).unionByName(_tails(sources, whole)).groupBy("sid", "block").agg(F.sum("uses").alias("uses"), F.sum("part").alias("part"))
    uses = scratch.table(uses, "uses")
    return Mix(layout, sources, draws, uses)


def _pieces(mix: Mix) -> DataFrame:
    """(sid, at, begin, words, uses): the parts of documents in drawn blocks."""
    full = mix.documents.where("size > 0")
    block = F.explode(F.sequence(F.floor(F.col("at") / BLOCK).cast("long"), F.floor((F.col("at") + F.col("size") - 1) / BLOCK).cast("long")))
    parts = full.select("sid", "at", "size", block.alias("block"))
    begin = F.greatest(F.col("at"), F.col("block") * BLOCK)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * BLOCK)
    found = parts.select("sid", "at", "block", begin.alias("from"), end.alias("to")).join(mix.uses, ["sid", "block"])
    piece = lambda a, b, n: F.struct((a - F.col("at")).alias("begin"), (b - a).alias("words"), n.alias("uses"))
    mid = F.greatest("from", F.least("to", F.col("block") * BLOCK + F.col("part")))
    both = F.array(piece(F.col("from"), mid, F.col("uses") + 1), piece(mid, F.col("to"), F.col("uses")))
    cut = F.when(F.col("part") > 0, both).otherwise(F.array(piece(F.col("from"), F.col("to"), F.col("uses"))))
    return found.select("sid", "at", F.explode(cut).alias("p")).select("sid", "at", "p.*").where("words > 0 and uses > 0")


def taken_words(mix: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of documents."""
    taken = _pieces(mix).groupBy("sid", "at").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    sources = mix.sources.select("sid", F.col("size").alias("source_size"), "target")
    full = mix.documents.where("size > 0").join(taken, ["sid", "at"], "left")
    rows = full.select("sid", "doc_id", "size", "taken").unionByName(mix.documents.where("size = 0").select("sid", "doc_id", "size", F.lit(0).cast("long").alias("taken")))
    return rows.join(sized(sources), "sid").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """The mix as rows of docs: a document comes once, or twice, with the words that are taken at least once, or twice.

    A text of which every word is taken stays as it is; otherwise the taken words are joined by blanks. Columns are those
    of docs, with n_chars renewed.
    """
    part = F.struct("begin", "words", "uses")
    parts = _pieces(mix).groupBy("sid", "at").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    chosen = mix.documents.select("sid", "at", "rk", "size").where("size > 0").join(parts, ["sid", "at"]).select("rk", "size", "parts")
    key = row_key(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    texts = docs.select(key.alias("rk"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).groupBy("rk").agg(F.first("row").alias("row"))
    rows = chosen.join(texts, "rk").select("row", "size", "parts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    rows = rows.withColumn("parts", F.filter("parts", lambda p: p["uses"] >= F.col("copy"))).where(F.size("parts") > 0)
    words = F.array(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)))
    some = F.transform(words, lambda w: F.array_join(F.transform("parts", lambda p: F.array_join(F.slice(w, p["begin"].cast("int") + 1, p["words"].cast("int")), " ")), " "))[0]
    whole = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["words"]) == F.col("size")
    rows = rows.select("row", F.when(whole, F.col("row.text")).otherwise(some).alias("new"))
    return rows.select(*[F.col("new").alias(c) if c == "text" else F.length("new").cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])
