"""Components of a similarity graph whose candidates share keys, without comparing all pairs of large groups.

First every id meets the hub that it shares most keys with. While many pairs are left that share a key and lie in different
components and, by the share of links among the pairs of the round before, many of them link, each id outside the largest component
of a key meets a member of that component and one of a few ids of the key that fall into the same cell, both drawn anew each
round, so that dense groups grow together whether their hub belongs to them or not. Finally all
pairs that are left are compared, first by bounds inside the join so that only pairs that may link leave it: no link between
components is missed; inside a component no comparison is needed. Each id goes into that join with the BEFORE keys before the
current one, in order, and a pair that shares one of those leaves it there and not here: always at its first shared key, seldom again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, sized
from .components import connected_components

#: Rounds at most before the remaining pairs are compared; partners of an id in a round; links expected for each entry that need no further round; ids of a key in a cell, on average.
ROUNDS, PARTNERS, FEW, CELL = 8, 3, 1, 4
#: Preceding keys of its id that an entry carries.
BEFORE = 8


def with_keys_before(entries: DataFrame) -> DataFrame:
    """entries (id, key, and pos or not) with `before`, up to BEFORE keys of the id that precede the entry's by pos and key."""
    near = Window.partitionBy("id").orderBy(*[c for c in ("pos", "key") if c in entries.columns]).rowsBetween(-BEFORE, -1)
    return entries.withColumn("before", F.collect_list("key").over(near))


def linked_components(shared: DataFrame, first: DataFrame, verify: Callable[[DataFrame, str], DataFrame], scratch: Scratch, possible: Column | None = None, marks: DataFrame | None = None) -> DataFrame:
    """shared: key, id and more; first: pairs (a, b); verify: pairs (a, b) -> scratch table of links (src, dst).

    possible: a condition on aliases l and r of shared that every linked pair meets at the first of its shared keys, by pos (where shared has
    it) and key; marks: further columns of each id that it reads. Gives id, component of all ids with links.
    """
    n_shared = shared.count()
    done = scratch.table(first.select("a", "b"), "pairs", n_shared)
    n_links = done.count()
    links = verify(done, "hub")
    seen = done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rate = links.count() / max(1, n_links)
    for k in range(ROUNDS + 1):
        comps = connected_components(links, scratch, n_links)
        placed = shared.join(sized(comps), "id", "left").withColumn("component", F.coalesce("component", "id"))
        groups = placed.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("major"), F.count("*").alias("k"), F.sum("c").alias("m"), F.sum(F.col("c").cast("double") * F.col("c")).alias("s"))
        open_keys = scratch.table(groups.where("k > 1").select("key", "major", ((F.col("m").cast("double") * F.col("m") - F.col("s")) / 2).alias("pairs"), "m"), "open-keys", n_shared)
        pairs, entries = open_keys.agg(F.coalesce(F.sum("pairs"), F.lit(0.0)), F.coalesce(F.sum("m"), F.lit(0))).first()
        rest = scratch.table(placed.join(sized(open_keys.select("key", "major", F.col("m").alias("size"))), "key").withColumn("minor", F.col("component") != F.col("major")), "open", n_shared)
        scratch.drop(open_keys, comps)
        if k == ROUNDS or pairs * rate <= FEW * entries:
            break
        members = rest.where("not minor").groupBy("key").agg(F.min_by("id", F.xxhash64("id", "key", F.lit(k))).alias("a"))
        met = rest.where("minor").select("key", F.col("id").alias("b")).join(members, "key").select("a", "b")
        h = F.xxhash64("id", "key", F.lit(-1 - k))
        cell = rest.select("key", "id", "component", h.alias("h"), F.pmod(h, F.ceil(F.col("size") / CELL)).alias("cell"))
        least = cell.groupBy("key", "cell").agg(F.min_by("id", "h").alias("a"), F.min_by("component", "h").alias("c"))
        mates = cell.join(least, ["key", "cell"]).where("component <> c").select("a", F.col("id").alias("b"))
        met = met.union(mates).groupBy("a", "b").agg(F.count("*").alias("n"))
        best = met.withColumn("nth", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), F.xxhash64("a", F.lit(k))))).where(F.col("nth") <= PARTNERS)
        fresh = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(seen, ["a", "b"], "left_anti").distinct()
        fresh = scratch.table(fresh, "pairs", n_shared)
        n_fresh, found = fresh.count(), verify(fresh, f"round-{k}")
        rate = found.count() / max(1, n_fresh)
        n_links += n_fresh
        links = links.union(found)
        seen = seen.union(fresh)
        scratch.drop(rest)
    full = rest
    if marks is not None:
        full = scratch.table(rest.join(marks.join(sized(scratch.table(rest.select("id").distinct(), "open-ids", n_shared)), "id", "left_semi"), "id"), "marked", n_shared)
        scratch.drop(rest)
    full = with_keys_before(full)
    l, r = full.where("minor").alias("l"), full.alias("r")
    cross = (F.col("l.key") == F.col("r.key")) & (F.col("l.component") != F.col("r.component")) & (~F.col("r.minor") | (F.col("l.id") < F.col("r.id")))
    if possible is not None:
        cross &= possible
    cross &= ~F.arrays_overlap("l.before", "r.before")
    more = l.join(r, cross).select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()
    more = scratch.table(more.join(seen, ["a", "b"], "left_anti"), "pairs", int(min(pairs, 1e15)))
    out = connected_components(links.union(verify(more, "cross")), scratch, n_links + more.count())
    scratch.drop(full, more, done)
    return out
