"""Density clusters from a spanning tree's edges, without a task that holds them all.

The single-linkage dendrogram is found by contraction: at each level every vertex of the tree takes its lightest edge, the edges taken
are contracted, and the tree of the other edges, at most half as many, is the next level's. A contracted edge belongs to the chain below
the first heavier edge that leaves its contracted part at some level; within a chain edges follow each other by weight. Chains give
parents by neighbouring rows and subtree sizes by running sums over range partitions, so a long chain is split like any other rows.
The condensed tree, its masses, the selection by excess of mass and the labels are joins, sums and pointer jumps.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ClusterConfig
from .lineage import cut
from .preprocess import numbered

#: Density of points at distance 0.
DENSEST = 1e12


def followed(step: DataFrame, key: str, to: str, rounds: int | None = None) -> DataFrame:
    """(key, to) -> the same with `to` moved along to the last key of its path; a key without a row, or that leads to itself, is an end."""
    step = cut(step)
    while rounds is None or rounds > 0:
        ahead = step.select(F.col(key).alias("__at"), F.col(to).alias("__next"))
        moved = step.join(ahead, F.col(to) == F.col("__at"), "left").select(key, F.coalesce("__next", to).alias(to), (F.col("__next") != F.col(to)).alias("__moved"))
        moved = cut(moved)
        step = moved.drop("__moved")
        if rounds is None:
            if moved.where("__moved").isEmpty():
                break
        else:
            rounds -= 1
    return step


def chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (e, a, b), e unique and in order of weight -> (e, p, s, level) and (x, e).

    The first has for each edge its chain: p is the edge above the chain (-1: none), s the contracted part below p; level tells in which
    contraction it was found. The second has the lightest edge of each vertex.
    """
    live = cut(edges.select("e", F.col("a").alias("u"), F.col("b").alias("v")))
    kind = live.schema["u"].dataType
    waiting = live.sparkSession.createDataFrame([], f"e long, s {kind.simpleString()}")
    closed, first, level = [], None, 0
    while True:
        low = cut(live.select(F.explode(F.array("u", "v")).alias("x"), "e").groupBy("x").agg(F.min("e").alias("low")))
        first = low.select("x", F.col("low").alias("e")) if first is None else first
        met = cut(waiting.join(low, F.col("s") == F.col("x"), "left").select("e", "s", F.coalesce("low", F.lit(-1)).alias("low")))
        heavier = (F.col("low") < 0) | (F.col("low") > F.col("e"))
        closed.append(met.where(heavier).select("e", F.col("low").alias("p"), "s", F.lit(level).alias("level")))
        if live.isEmpty():
            break
        marked = cut(live.join(low.select(F.col("low").alias("e")).distinct().withColumn("taken", F.lit(True)), "e", "left"))
        taken = marked.where("taken")
        ends = taken.select("e", "u", "v").union(taken.select("e", "v", "u")).toDF("e", "x", "y")
        hook = low.withColumnRenamed("low", "e").join(ends, ["e", "x"]).select("x", "y")
        back = hook.select(F.col("x").alias("y"), F.col("y").alias("z"))
        # the lightest edge of a part is taken from both sides; the smaller end is the part's name
        root = followed(hook.join(back, "y").select("x", F.when((F.col("z") == F.col("x")) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y")).alias("y")), "x", "y")
        part = lambda c: root.select(F.col("x").alias(c), F.col("y").alias(f"__{c}"))  # noqa: E731, B023
        stay = met.where(~heavier).select("e", "s").union(taken.select("e", F.col("u").alias("s")))
        waiting = cut(stay.join(part("s"), "s").select("e", F.col("__s").alias("s")))
        live = cut(marked.where("taken is null").join(part("u"), "u").join(part("v"), "v").select("e", F.col("__u").alias("u"), F.col("__v").alias("v")))
        level += 1
    out = closed[0]
    for c in closed[1:]:
        out = out.union(c)
    return cut(out), cut(first)


def dendrogram(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (e, a, b) as for chains -> (e, par, size): the next heavier edge that takes in the edge's part (null: none) and its vertices; and (x, e)."""
    found, first = chains(edges)
    weights = [first.groupBy("e").agg(F.count("*").alias("n"))]  # vertices that hang on an edge, alone or by chains
    done = []
    for level in [r["level"] for r in found.select("level").distinct().orderBy("level").collect()]:
        total = weights[0]
        for w in weights[1:]:
            total = total.union(w)
        rows = cut(found.where(F.col("level") == level).join(total.groupBy("e").agg(F.sum("n").alias("n")), "e", "left").select("e", "p", "s", F.coalesce("n", F.lit(0)).alias("n")))
        done.append(rows)
        weights.append(cut(rows.where("p >= 0").groupBy("p", "s").agg(F.sum("n").alias("n")).select(F.col("p").alias("e"), "n")))
    whole = done[0]
    for d in done[1:]:
        whole = whole.union(d)
    ranged = cut(whole.repartitionByRange("p", "s", "e").withColumn("piece", F.spark_partition_id()))
    inside = Window.partitionBy("piece", "p", "s").orderBy("e")
    across = Window.partitionBy("p", "s").orderBy("piece")
    pieces = ranged.groupBy("piece", "p", "s").agg(F.sum("n").alias("sum"), F.min("e").alias("least"))
    pieces = pieces.select("piece", "p", "s", F.coalesce(F.sum("sum").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("least").over(across).alias("after"))
    rows = ranged.select("e", "p", "s", "piece", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.lead("e").over(inside).alias("next"))
    out = rows.join(pieces, ["piece", "p", "s"]).select("e", F.coalesce("next", "after", F.when(F.col("p") >= 0, F.col("p"))).alias("par"), (F.col("run") + F.col("before")).alias("size"))
    return cut(out), first


def condensed_tree(edges: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """edges (e, a, b, w) -> clusters (c, up, birth, peak, mass, kids) and points (id, c, lam).

    A cluster splits where two parts of at least `size` vertices meet; kids is 0 or 2. birth: density at which it appears (0 for the
    whole); lam: density at which a point leaves it; mass: its excess of mass; peak: the highest density at which a point leaves or it splits.
    """
    tree, first = dendrogram(edges)
    tree = cut(tree.join(edges.select("e", (1 / F.greatest("w", F.lit(1 / DENSEST))).alias("lam")), "e"))
    small = F.col("par").isNotNull() & (F.col("size") < size)
    up = followed(tree.where(small).select("e", F.col("par").alias("to")), "e", "to", rounds=max(1, math.ceil(math.log2(size))))
    big = cut(tree.where(~small))
    splits = cut(big.groupBy(F.col("par").alias("e")).agg(F.count("*").alias("kids")).where("kids = 2 and e is not null").select("e", F.lit(True).alias("split")))
    under = big.join(splits.select(F.col("e").alias("par"), "split"), "par", "left")
    top = followed(under.select("e", F.when(F.col("par").isNull() | F.col("split"), F.col("e")).otherwise(F.col("par")).alias("c")), "e", "c")
    heights = big.select("e", "lam")
    left = first.join(up, "e", "left").select(F.col("x").alias("id"), F.coalesce("to", "e").alias("e"))
    points = cut(left.join(top, "e").join(heights, "e").select("id", "c", "lam"))
    deaths = splits.join(top, "e").join(heights, "e").select("c", F.col("lam").alias("death"))
    born = big.join(top.where("e = c").select("e"), "e", "left_semi").select(F.col("e").alias("c"), "par", "size")
    over = top.select(F.col("e").alias("par"), F.col("c").alias("up")).join(heights.select(F.col("e").alias("par"), F.col("lam").alias("birth")), "par")
    clusters = cut(born.join(over, "par", "left").select("c", "up", "size", F.coalesce("birth", F.lit(0.0)).alias("birth")))
    own = points.groupBy("c").agg(F.sum("lam").alias("lams"), F.count("*").alias("n"), F.max("lam").alias("most"))
    below = clusters.where("up is not null").groupBy(F.col("up").alias("c")).agg(F.sum(F.col("size") * F.col("birth")).alias("kid_lams"), F.sum("size").alias("kid_n"), F.count("*").cast("int").alias("kids"))
    both = clusters.join(own, "c", "left").join(below, "c", "left").join(deaths, "c", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    mass = zero("lams") - zero("n") * F.col("birth") + zero("kid_lams") - zero("kid_n") * F.col("birth")
    return cut(both.select("c", "up", "birth", F.greatest("most", "death").alias("peak"), mass.alias("mass"), zero("kids").alias("kids"))), points


def selected(clusters: DataFrame, single: bool) -> DataFrame:
    """(c): the clusters with the most excess of mass, decided from the leaves up, a layer of the tree in each round."""
    barred = F.lit(False) if single else F.col("up").isNull()
    leaf = clusters.where("kids = 0")
    done = cut(leaf.select("c", "up", F.when(barred, 0.0).otherwise(F.col("mass")).alias("value"), (~barred).alias("chosen")))
    rest = cut(clusters.where("kids > 0"))
    while not rest.isEmpty():
        inner = done.groupBy("up").agg(F.sum("value").alias("inner"), F.count("*").alias("n")).where("n = 2").select(F.col("up").alias("c"), "inner")
        met = cut(rest.join(inner, "c"))
        best = ~barred & (F.col("mass") >= F.col("inner"))
        done = cut(done.union(met.select("c", "up", F.when(best, F.col("mass")).otherwise(F.col("inner")), best)))
        rest = cut(rest.join(met.select("c"), "c", "left_anti"))
    return done.where("chosen").select("c")


def highest(clusters: DataFrame, marked: DataFrame) -> DataFrame:
    """(c, owner): the marked cluster nearest to the root on each cluster's way there, itself included; null if there is none."""
    state = cut(clusters.select("c", "up").join(marked.select("c", F.col("c").alias("owner")), "c", "left"))
    while not state.where("up is not null").isEmpty():
        over = state.select(F.col("c").alias("up"), F.col("up").alias("next"), F.col("owner").alias("nearer"))
        state = cut(state.join(over, "up", "left").select("c", F.col("next").alias("up"), F.coalesce("nearer", "owner").alias("owner")))
    return state.select("c", "owner")


def tree_labels(tree: DataFrame, cfg: ClusterConfig = ClusterConfig()) -> DataFrame:
    """tree (a, b, w), the edges of a spanning tree -> id, cluster (-1: noise; numbered from 0), prob (0 to 1) for each of its vertices.

    Edges go by weight, then a, then b. An empty tree gives no rows.
    """
    if cfg.min_cluster_size < 2:
        raise ValueError("a cluster has at least two members")
    edges = cut(numbered(tree.select(F.struct("w", "a", "b").alias("key")), "key", "e").select("e", "key.*"))
    if edges.isEmpty():
        return tree.select(F.col("a").alias("id"), F.lit(-1).alias("cluster"), F.lit(0.0).alias("prob"))
    clusters, points = condensed_tree(edges, cfg.min_cluster_size)
    owner = highest(clusters, selected(clusters, cfg.allow_single_cluster))
    if cfg.cluster_selection_epsilon > 0:  # one born at a distance below epsilon becomes its first ancestor born above it
        roots = clusters.where("up is null").select(F.col("c").alias("up"), F.lit(True).alias("root"))
        high = F.col("up").isNull() | F.coalesce("root", F.lit(False)) | (F.col("birth") <= 1 / cfg.cluster_selection_epsilon)
        rise = followed(clusters.join(roots, "up", "left").select("c", F.when(high, F.col("c")).otherwise(F.col("up")).alias("to")), "c", "to")
        marked = owner.select(F.col("owner").alias("c")).distinct().join(rise, "c").select(F.col("to").alias("c")).distinct()
        owner = highest(clusters, marked)
    number = numbered(owner.where("owner is not null").select("owner").distinct(), "owner", "k")
    peaks = clusters.select(F.col("c").alias("owner"), "peak")
    named = owner.join(number, "owner", "left").join(peaks, "owner", "left").select("c", F.coalesce("k", F.lit(-1)).cast("int").alias("cluster"), "peak")
    known = (F.col("peak") > 0) & (F.col("peak") < float("inf"))
    prob = F.when(F.col("cluster") < 0, 0.0).when(known, F.least("lam", "peak") / F.col("peak")).otherwise(1.0)
    return points.join(named, "c").select("id", "cluster", prob.alias("prob"))
