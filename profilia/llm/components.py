"""Distributed connected components by repeated contraction; counters reach the driver, and of a contracted graph at most REST edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Edges (16 bytes each) up to which the driver ends what a first contraction has left; a larger rest is contracted further in Spark.
REST = 1 << 16


def roots(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of a few edges and a representative of each one's component: roots hook onto smaller roots, then pointers jump."""
    ids, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = ends[: len(src)], ends[len(src) :]
    root = np.arange(len(ids))
    while (apart := root[a] != root[b]).any():
        x, y = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    return ids, ids[root]


def connected_components(edges: DataFrame, scratch: Scratch, most: int | None = None) -> DataFrame:
    """(src, dst) long edges -> (id, component): every vertex of an edge with the smallest id of its component.

    Each round every vertex joins the smallest vertex of its closed neighbourhood and edges are renamed
    accordingly; the order is by id in the first round (stars collapse at once) and by a hash that changes with
    the round afterwards, so that chains shrink by a constant factor. Minima are pre-aggregated before each
    shuffle and joins have one row per vertex on one side, so a vertex with very many edges is split by AQE.
    Once contracted, a graph of at most REST edges is ended in the driver, as rounds of small joins cost more than they do.
    Nulls and self-loops are ignored; repeated edges count once; no edges give an empty table.
    most: the number of edges at most, if known.
    """
    cur = scratch.table(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst").distinct(), "edges", most)
    parents: list[DataFrame] = []
    most = 0
    while n := cur.count():
        k = len(parents)
        most = max(most, 2 * n)  # later tables are no larger
        if parents and n <= REST:
            t = cur.toArrow()
            ends = pa.table(dict(zip("vp", roots(*(t.column(c).to_numpy() for c in ("src", "dst"))), strict=True)))
            parents.append(scratch.table(scratch.spark.createDataFrame(ends, "v long, p long"), "parent", most))
            scratch.drop(cur)
            break

        def order(c, k=k):
            first = F.lit(0).cast("long") if k == 0 else F.xxhash64(c, F.lit(k))
            return F.struct(first.alias("rank"), c.alias("id"))

        both = cur.select(F.col("src").alias("v"), F.col("dst").alias("w")).union(cur.select("dst", "src"))
        best = both.groupBy("v").agg(F.min(order(F.col("w"))).alias("m"))
        smaller = F.col("m") < order(F.col("v"))
        parent = scratch.table(best.select("v", F.when(smaller, F.col("m")["id"]).otherwise(F.col("v")).alias("p")), "parent", most)
        parents.append(parent)
        a = parent.select(F.col("v").alias("src"), F.col("p").alias("ps"))
        b = parent.select(F.col("v").alias("dst"), F.col("p").alias("pd"))
        nxt = scratch.table(cur.join(a, "src").join(b, "dst").where("ps <> pd").select(F.col("ps").alias("src"), F.col("pd").alias("dst")).distinct(), "edges", most)
        scratch.drop(cur)
        cur = nxt
    if not parents:
        return scratch.table(cur.select(F.col("src").alias("id"), F.col("dst").alias("component")), "components", 0)
    label = parents[0].select(F.col("v").alias("id"), F.col("p").alias("root"))
    for p in parents[1:]:
        step = p.select(F.col("v").alias("root"), "p")
        label = label.join(step, "root", "left").select("id", F.coalesce("p", "root").alias("root"))
    label = scratch.table(label, "roots", most)
    least = label.groupBy("root").agg(F.min("id").alias("component"))
    out = scratch.table(label.join(least, "root").select("id", F.least("component", "root").alias("component")), "components", most)
    scratch.drop(label, *parents)
    return out
