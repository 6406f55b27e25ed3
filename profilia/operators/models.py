"""Isolation trees: Spark draws their rows and scores where rows lie, numpy grows trees of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .quantiles import exact_quantiles

#: Rows that a tree is grown from; the sample of a tree is drawn by hash.
TREE_ROWS = 256


def _length(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def isolation_scores(vectors: DataFrame, trees: int = 100, seed: int = 42) -> DataFrame:
    """(id, v) -> id, score in 0..1, higher for rows that random splits isolate sooner.

    Each tree draws about TREE_ROWS rows by hash, so a group never holds more than a small multiple of that; the grown trees, of bounded
    size, are broadcast and every row is scored where it lies.
    """
    n = vectors.count()
    share = min(1.0, TREE_ROWS / max(1, n))
    cut = int(share * 1_000_000) + 1
    mine = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64("id", t, F.lit(seed)), F.lit(1_000_000)) < F.lit(cut))
    drawn = vectors.select("id", "v", F.explode(mine).alias("tree"))  # a row for each tree that draws the row

    def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng((seed, int(key[0])))
        pdf = pdf.sort_values("id")
        x, out = np.stack(pdf["v"].to_numpy()), []
        limit = int(np.ceil(np.log2(max(2, len(x)))))
        todo = [(1, np.arange(len(x)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            spread = np.flatnonzero(x[rows].max(0) > x[rows].min(0)) if len(rows) > 1 else []
            if depth >= limit or not len(spread):
                out.append((int(key[0]), node, -1, 0.0, depth + _length(len(rows))))
                continue
            f = int(rng.choice(spread))
            cut = float(rng.uniform(x[rows, f].min(), x[rows, f].max()))
            out.append((int(key[0]), node, f, cut, 0.0))
            low = x[rows, f] < cut
            todo += [(2 * node, rows[low], depth + 1), (2 * node + 1, rows[~low], depth + 1)]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "depth"])

    grown = drawn.groupBy("tree").applyInPandas(grow, "tree int, node long, feature int, cut double, depth double").toPandas()
    forest = vectors.sparkSession.sparkContext.broadcast([t.set_index("node")[["feature", "cut", "depth"]].to_dict("index") for _, t in grown.groupby("tree")])
    norm = max(_length(min(n, TREE_ROWS)), 1e-9)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["v"].to_numpy()) if len(b) else np.zeros((0, 1))
            total = np.zeros(len(b))
            for nodes in forest.value:
                todo = [(1, np.arange(len(b)))]
                while todo:
                    k, rows = todo.pop()
                    if nodes[k]["feature"] < 0:
                        total[rows] += nodes[k]["depth"]
                    elif len(rows):
                        low = x[rows, int(nodes[k]["feature"])] < nodes[k]["cut"]
                        todo += [(2 * k, rows[low]), (2 * k + 1, rows[~low])]
            yield pd.DataFrame({"id": b["id"], "score": 2 ** (-total / max(1, len(forest.value)) / norm)})

    return vectors.select("id", "v").mapInPandas(score, "id long, score double")


def flag_outliers(scores: DataFrame, contamination: float = 0.03) -> DataFrame:
    """(id, score) -> id, score, outlier: the share `contamination` with the highest scores."""
    scores = cut(scores)
    bound = exact_quantiles(scores, ["score"], [1 - contamination])["score"][0]
    return scores.select("id", "score", (F.col("score") > F.lit(bound).cast("double")).alias("outlier"))
