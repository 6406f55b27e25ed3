"""Density clusters: exact spanning tree of mutual reachability, clusters of the condensed tree, and their validity index.

Distances are computed by pairs of blocks (see neighbors.py). The spanning tree grows in rounds: every vector finds its nearest
vector of another component, every component takes its best edge, and components are renamed by pointer jumping. The tree's edges become
labels and strengths by contraction (see dendrogram.py).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ClusterConfig
from .anomaly import silhouette_points
from .dendrogram import tree_labels
from .lineage import cut
from .neighbors import _about, _differences, _distances, apart, knn, placed, scan, slices


def _least_leaving(a: dict, parts: Iterator[dict]) -> Iterator[list]:
    """The lightest edge, ties by ids, from each component among the rows of a to another one among the parts, if it is at most the component's `most`."""
    v, core, comp = a["v"], a["core"].astype(float), a["comp"]
    names, place = np.unique(comp, return_inverse=True)
    most = np.where(np.isnan(a["most"]), np.inf, a["most"])
    centre, kept = v.mean(0), []
    for b in parts:
        y, other = b["v"] - centre, b["comp"]
        lone = bool((other == other[0]).all())
        rows = np.flatnonzero(comp != other[0]) if lone else np.arange(len(v))
        if not len(rows) or max(apart(v[rows], b["v"]), b["core"].min()) > most[rows].max():
            continue
        gap = np.maximum(0, np.maximum(v[rows] - b["v"].max(0), b["v"].min(0) - v[rows]))
        gap = np.sqrt(np.square(gap).sum(1)) * (1 - 1e-9) - 2e-9
        rows = rows[np.maximum(gap, core[rows]) <= most[rows]]
        for at in slices(len(rows)):
            r = rows[at]
            about, slack = _about(v[r] - centre, y)
            m = np.sqrt(np.maximum(about - slack[:, None], 0))
            m = np.maximum(np.maximum(m, core[r][:, None], out=m), b["core"][None], out=m)
            if not lone:
                m[comp[r][:, None] == other[None]] = np.inf
            least = np.minimum(most[r], np.sqrt(np.square(m.min(1)) + 2 * slack) + 2e-9)
            i, j = np.divmod(np.flatnonzero((m <= np.where(np.isfinite(least), least + 1e-9, -1.0)[:, None]).ravel()), len(y))
            i = r[i]
            w = np.maximum(np.round(_differences(v, b["v"], i, j), 9), np.maximum(core[i], b["core"][j]))
            ok = w <= most[i]
            i, j, w = i[ok], j[ok], w[ok]
            x, z = a["id"][i], b["id"][j]
            lo, hi = np.where(x < z, x, z), np.where(x < z, z, x)
            order = np.lexsort((hi, lo, w, place[i]))
            first = order[np.unique(place[i][order], return_index=True)[1]]
            kept.append((place[i[first]], w[first], lo[first], hi[first], other[j[first]]))
            least = np.full(len(names), np.inf)
            np.minimum.at(least, place[i[first]], w[first])
            most = np.minimum(most, least[place])
    if kept:
        c, w, lo, hi, other = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((hi, lo, w, c))
        first = order[np.unique(c[order], return_index=True)[1]]
        yield [names[c[first]], other[first], w[first], lo[first], hi[first]]


def spanning_tree(vectors: DataFrame, id_type: str = "bigint", within: bool = False, known: DataFrame | None = None) -> DataFrame:
    """(id, v, core[, label]) -> a, b, w: the least spanning tree by max(distance, both cores); ties by ids.

    within: a tree for each label. Repeated vectors are joined at their cores. known: edges (i, j, w) of the graph, with their exact weights;
    they bound what each component's lightest edge may weigh, so that parts farther away are passed over.
    """
    nodes = cut(placed(vectors, "label" if within else None, near=not within).withColumn("comp", F.col("id")))
    tree = None
    while True:
        bounded = nodes.withColumn("most", F.lit(None).cast("double"))
        if known is not None:
            one, two = nodes.select(F.col("id").alias("i"), F.col("comp").alias("ci")), nodes.select(F.col("id").alias("j"), F.col("comp").alias("cj"))
            known = cut(known.join(one, "i").join(two, "j").where("ci <> cj").select("i", "j", "w", "ci", "cj"))
            most = known.select(F.explode(F.array("ci", "cj")).alias("comp"), "w").groupBy("comp").agg(F.min("w").alias("most"))
            bounded, known = nodes.join(most, "comp", "left"), known.select("i", "j", "w")
        bounded = cut(bounded)
        found = scan(bounded, bounded, _least_leaving, f"c {id_type}, other {id_type}, w double, a {id_type}, b {id_type}", ["core", "comp", "most"], "label" if within else None)
        best = cut(found.groupBy("c").agg(F.min(F.struct("w", "a", "b", "other")).alias("e")).select("c", "e.*"))
        if best.isEmpty():
            return tree if tree is not None else best.select("a", "b", "w")
        edges = best.select("a", "b", "w").distinct()
        tree = cut(edges if tree is None else tree.union(edges))
        # a component points to the one its edge leads to; of two that point to each other the smaller is the root
        back = best.select(F.col("c").alias("other"), F.col("other").alias("c"), F.lit(True).alias("mutual"))
        up = best.select("c", "other").join(back, ["c", "other"], "left")
        up = cut(up.select("c", F.when(F.col("mutual") & (F.col("c") < F.col("other")), F.col("c")).otherwise(F.col("other")).alias("up")))
        while True:
            over = up.select(F.col("c").alias("up"), F.col("up").alias("over"))
            nxt = cut(up.join(over, "up").select("c", F.col("over").alias("up"), (F.col("over") != F.col("up")).alias("moved")))
            up, done = nxt.select("c", "up"), nxt.where("moved").isEmpty()
            if done:
                break
        renamed = nodes.join(up.select(F.col("c").alias("comp"), "up"), "comp", "left")
        nodes = cut(renamed.withColumn("comp", F.coalesce("up", "comp")).drop("up").select(*nodes.columns))


def hdbscan_clusters(vectors: DataFrame, cfg: ClusterConfig = ClusterConfig(), id_type: str = "bigint") -> DataFrame:
    """(id, v) -> id, cluster (-1: noise), prob. Fewer rows than a cluster needs are all noise; an empty table gives an empty result.

    The tree grows over block pairs; see dendrogram for what follows.
    """
    rows = vectors.select("id", "v")
    n = rows.count()
    none = rows.select("id", F.lit(-1).alias("cluster"), F.lit(0.0).alias("prob"))
    if n < 2:
        return none
    k = min(cfg.min_samples, n - 1)
    edges = cut(knn(rows, rows, k, id_type))
    core = cut(edges.where(F.col("rank") == k).select(F.col("i").alias("id"), F.col("d").alias("core")))
    ends = edges.join(core.select(F.col("id").alias("i"), F.col("core").alias("ci")), "i").join(core.select(F.col("id").alias("j"), F.col("core").alias("cj")), "j")
    tree = spanning_tree(rows.join(core, "id"), id_type, known=ends.select("i", "j", F.greatest("d", "ci", "cj").alias("w")))
    return tree_labels(tree, cfg)


def validity_index(vectors: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(id, v, label) -> label, size, validity of each cluster, and dbcv, their sum by share of all rows; noise (-1) lowers it. Null with one cluster."""
    total, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    members = vectors.where("label >= 0")

    def near(a: dict, parts: Iterator[dict]) -> Iterator[list]:
        s = np.zeros(len(a["id"]))
        for b in parts:
            for at in slices(len(s)):
                d = _distances(a["v"][at], b["v"])
                s[at] += (np.where(d > 0, 1 / np.where(d > 0, d, 1), 0.0) ** width).sum(1)
        yield [a["id"], s]

    sums = scan(members, members, near, f"id {id_type}, s double", ["label"], "label").groupBy("id").agg(F.sum("s").alias("s"))
    sizes = members.groupBy("label").agg(F.count("*").alias("size"))
    core = F.when(F.col("s") > 0, F.pow(F.col("s") / F.greatest(F.col("size") - 1, F.lit(1)), -1.0 / (width or 1))).otherwise(0.0)
    points = cut(members.join(sums, "id").join(sizes, "label").select("id", "v", "label", core.alias("core")))
    tree = cut(spanning_tree(points, id_type, within=True))
    degree = tree.select(F.col("a").alias("id")).union(tree.select("b")).groupBy("id").agg(F.count("*").alias("deg"))
    marked = points.join(degree, "id", "left").withColumn("inner", F.coalesce(F.col("deg") > 1, F.lit(False)))
    marked = marked.join(marked.groupBy("label").agg(F.bool_or("inner").alias("some")), "label").withColumn("inner", F.col("inner") | ~F.col("some"))
    marked = cut(marked.select("id", "v", "label", "core", "inner"))
    inner = marked.select("id", "label", "inner")
    ends = tree.join(inner.select(F.col("id").alias("a"), "label", F.col("inner").alias("ia")), "a").join(inner.select(F.col("id").alias("b"), F.col("inner").alias("ib")), "b")
    sparse = ends.groupBy("label").agg(F.coalesce(F.max(F.when(F.col("ia") & F.col("ib"), F.col("w"))), F.max("w")).alias("sparse"))

    def between(a: dict, parts: Iterator[dict]) -> Iterator[list]:
        own, least = a["label"], np.full(len(a["id"]), np.inf)
        for b in parts:
            for at in slices(len(own)):
                d = _distances(a["v"][at], b["v"])
                d = np.maximum(np.maximum(d, a["core"][at][:, None], out=d), b["core"][None], out=d)
                d[own[at][:, None] == b["label"][None]] = np.inf
                least[at] = np.minimum(least[at], d.min(1))
        names = np.unique(own)
        yield [names.astype(np.int64), np.array([least[own == g].min() for g in names])]

    cores = marked.where("inner")
    separate = scan(cores, cores, between, "label bigint, apart double", ["label", "core"]).groupBy("label").agg(F.min("apart").alias("apart"))
    v = (F.col("apart") - F.col("sparse")) / F.nullif(F.greatest("apart", "sparse"), F.lit(0.0))
    each = sizes.join(sparse, "label").join(separate.where(F.col("apart") < float("inf")), "label", "left").select("label", "size", v.alias("validity"))
    whole = each.agg(F.sum(F.col("size") / F.lit(float(total or 1)) * F.col("validity")).alias("dbcv"))  # one row
    return each.join(F.broadcast(whole))


def cluster_quality(vectors: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(id, v, label) -> silhouette, dbcv: one row."""
    silhouette = silhouette_points(vectors, id_type).agg(F.avg("silhouette").alias("silhouette"))
    return silhouette.join(F.broadcast(validity_index(vectors, id_type).agg(F.max("dbcv").alias("dbcv"))))
