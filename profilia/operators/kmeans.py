"""Many k-means models at once: each pass over the vectors serves all numbers of clusters and all starts.

The state is a small table of centres, one row for each (k, start, centre), which grows with the models and not with the data. A pass
sends it to the tasks, which hold the vectors against all centres by one matrix product a slice and sum by centre; models that stand
still leave. Starts are chosen by k-means||: a few rounds that draw vectors in proportion to their squared distance, then weighted
k-means++ among the drawn. All draws are functions of seed, model and id, so the partitioning has no influence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, dealt
from .neighbors import _distances, scan, slices

#: Vectors held against all centres at once.
SLICE = 256


@dataclass
class Model:
    """One k-means model: its centres and, once a pass has seen them, the summed squared distance of all vectors to them."""

    k: int
    start: int
    centres: np.ndarray
    cost: float = float("inf")
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def uniforms(h: np.ndarray, seed: int, k: int, start: int, turn: int) -> np.ndarray:
    """Numbers in (0, 1), one for each 64-bit h, that depend on nothing but the arguments."""
    with np.errstate(over="ignore"):
        x = h.astype(np.uint64)
        for v in (seed, k, start, turn):
            x = (x + np.uint64(v + 1)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    return np.maximum(np.square(x).sum(1)[:, None] - 2 * (x @ centres.T) + np.square(centres).sum(1), 0.0)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            part = batch.slice(i, SLICE)
            yield part.column("h").to_numpy(), part.column("v").flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(part.num_rows, -1)


def _bounds(models: list[Model]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum([len(m.centres) for m in models])))


def _all_centres(models: list[Model]) -> np.ndarray:
    return np.concatenate([m.centres for m in models])


def _nearest(x: np.ndarray, models: list[Model]) -> tuple[np.ndarray, np.ndarray]:
    """For each model (column) the number, among the centres of all, of each row's nearest centre, and the squared distance to it.

    Models of equal numbers of centres are searched together. A row's own length is left out until the end, as it moves no minimum.
    """
    centres, bounds = _all_centres(models), _bounds(models)
    sizes = np.diff(bounds)
    length = np.square(x).sum(1)
    left = np.column_stack((-2 * x, np.ones(len(x))))
    near, least = np.empty((len(x), len(models)), np.int64), np.empty((len(x), len(models)))
    for size in np.unique(sizes):
        some = np.flatnonzero(sizes == size)
        at = (bounds[some] + np.arange(size)[:, None]).ravel()  # the first centre of each, the second of each, ...
        d = (left @ np.column_stack((centres[at], np.square(centres[at]).sum(1))).T).reshape(len(x), size, len(some))
        best, which = d[:, 0].copy(), np.zeros((len(x), len(some)), np.int32)
        for c in range(1, size):
            np.copyto(which, c, where=d[:, c] < best)
            np.minimum(best, d[:, c], out=best)
        near[:, some], least[:, some] = bounds[some] + which, best
    return near, np.maximum(least + length[:, None], 0.0)


def _shared(rows: DataFrame, state: object, make: Callable, schema: str, use: Callable):
    """use(rows.mapInArrow(make(state))) with the state sent once to each executor and released afterwards."""
    sent = rows.sparkSession.sparkContext.broadcast(state)
    try:
        return use(rows.mapInArrow(lambda batches: make(sent.value, batches), schema))
    finally:
        sent.destroy()


def _sums(state: list[Model], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each centre of all models: how many vectors are nearest to it, their summed squared distance, their sum."""
    centres = _all_centres(state)
    n, cost, total = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros(centres.shape)
    for _, x in _slices(batches):
        near, d = _nearest(x, state)
        member = np.zeros((len(x), len(centres)))
        member[np.arange(len(x))[:, None], near] = 1
        n += np.bincount(near.ravel(), minlength=len(centres))
        cost += np.bincount(near.ravel(), d.ravel(), len(centres))
        total += member.T @ x
    some = np.flatnonzero(n)
    if len(some):
        cols = [pa.array(some, pa.int32()), pa.array(n[some]), pa.array(cost[some]), pa.array(list(total[some]), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["centre", "n", "cost", "total"])


def assign(rows: DataFrame, models: list[Model]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each model: the sizes of its clusters, the sums of their vectors and its cost, by one pass."""
    vector = Summarizer.sum(array_to_vector("total"))
    found = _shared(rows, models, _sums, "centre int, n long, cost double, total array<double>", lambda part: part.groupBy("centre").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), vector_to_array(vector).alias("total")).collect())  # a row for each centre
    centres, bounds = _all_centres(models), _bounds(models)
    n, cost, total = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros(centres.shape)
    for r in found:
        n[r["centre"]], cost[r["centre"]], total[r["centre"]] = r["n"], r["cost"], r["total"]
    return [(n[a:b], total[a:b], float(cost[a:b].sum())) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _keys(h: np.ndarray, x: np.ndarray, models: list[Model], seed: int, turn: int) -> np.ndarray:
    """Draw keys, a column for each model: the smallest ones are drawn, in proportion to the squared distance to the centres so far."""
    if not turn:
        return np.stack([uniforms(h, seed, m.k, m.start, 0) for m in models], 1)
    d, bounds = squared(x, _all_centres(models)), _bounds(models)
    d[d < 1e-12 * (1 + np.square(x).sum(1))[:, None]] = 0  # the vector itself, but for rounding
    with np.errstate(divide="ignore"):
        return np.stack([-np.log(uniforms(h, seed, m.k, m.start, turn)) / d[:, a:b].min(1) for m, a, b in zip(models, bounds[:-1], bounds[1:], strict=True)], 1)


def _draws(state: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the smallest keys of each model, of those in the task."""
    models, seed, turn, most = state
    keys, hs, xs = np.full((0, len(models)), np.inf), np.zeros((0, len(models)), np.int64), None
    top = max(most)
    for h, x in _slices(batches):
        new = _keys(h, x, models, seed, turn)
        xs = np.zeros((0, len(models), x.shape[1])) if xs is None else xs
        keys, hs = np.concatenate((keys, new)), np.concatenate((hs, np.repeat(h[:, None], len(models), 1)))
        xs = np.concatenate((xs, np.repeat(x[:, None], len(models), 1))) if len(keys) <= top else xs
        if len(keys) > top:
            best = np.argpartition(keys, top - 1, axis=0)[:top]
            old = len(keys) - len(x)
            xs = np.stack([np.where((best[:, m] < old)[:, None], xs[np.minimum(best[:, m], max(old - 1, 0)), m] if old else 0.0, x[np.maximum(best[:, m] - old, 0)]) for m in range(len(models))], 1)
            keys, hs = np.take_along_axis(keys, best, 0), np.take_along_axis(hs, best, 0)
    for m in range(len(models)):
        order = np.lexsort((hs[:, m], keys[:, m]))[: most[m]]
        order = order[np.isfinite(keys[order, m])]
        if len(order):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), m), pa.int32()), pa.array(keys[order, m]), pa.array(hs[order, m]), pa.array(list(xs[order, m]), pa.list_(pa.float64()))], names=["model", "key", "h", "v"])


def draw(rows: DataFrame, models: list[Model], seed: int, turn: int, most: list[int]) -> list[np.ndarray]:
    """For each model m, most[m] vectors drawn without replacement, by one pass."""
    w = Window.partitionBy("model").orderBy("key", "h")
    limits = F.array(*[F.lit(n) for n in most])
    best = lambda part: part.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limits[F.col("model")]).select("model", "nth", "v").collect()
    found: list[list] = [[] for _ in models]
    for r in sorted(_shared(rows, (models, seed, turn, most), _draws, "model int, key double, h long, v array<double>", best), key=lambda r: (r["model"], r["nth"])):
        found[r["model"]].append(r["v"])
    return [np.array(v, float) for v in found]


def weighted_start(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the points by k-means++ with weights; all of them if there are no more."""
    if len(points) <= k:
        return points
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    near = squared(points, points[chosen])[:, 0]
    while len(chosen) < k:
        near[chosen] = 0
        p = near * weights
        if not p.sum() > 0:
            break
        chosen.append(int(rng.choice(len(points), p=p / p.sum())))
        near = np.minimum(near, squared(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def starts(rows: DataFrame, ks: Iterable[int], runs: int, seed: int, rounds: int = 2) -> list[Model]:
    """A model for each k and each of `runs` starts, seeded by k-means|| with 2 k vectors drawn in each round: rounds + 2 passes for all."""
    models = [Model(k, r, np.zeros((0, 0))) for k in ks for r in range(runs)]
    for m, c in zip(models, draw(rows, models, seed, 0, [1] * len(models)), strict=True):
        m.centres = c
    for turn in range(1, rounds + 1):
        for m, c in zip(models, draw(rows, models, seed, turn, [2 * m.k for m in models]), strict=True):
            m.centres = np.concatenate((m.centres, c)) if len(c) else m.centres
    for m, (n, _, _) in zip(models, assign(rows, models), strict=True):
        m.centres = weighted_start(m.centres[n > 0], n[n > 0].astype(float), m.k, np.random.default_rng([seed, m.k, m.start]))
    return models


def fit(rows: DataFrame, models: list[Model], most: int = 300, tol: float = 1e-4) -> list[Model]:
    """Lloyd's passes for all models at once, until each moves by at most tol times the mean variance, or `most` passes.

    A cluster that loses all its vectors keeps its centre.
    """
    spread = rows.select(vector_to_array(Summarizer.variance(array_to_vector("v"))).alias("v")).first()["v"]
    still = tol * float(np.mean(spread)) if spread else 0.0
    live = models
    for _ in range(most):
        if not live:
            break
        moving = []
        for m, (n, total, cost) in zip(live, assign(rows, live), strict=True):
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], m.centres)
            shift = float(np.square(new - m.centres).sum())
            m.centres, m.cost, m.sizes = new, cost, n
            if shift > still:
                moving.append(m)
        live = moving
    return models


def _labels(state: list[Model], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bounds = _bounds(state)
    for batch in batches:
        near = [np.zeros((0, len(state)), np.int32)]
        for _, x in _slices([batch]):
            near.append((_nearest(x, state)[0] - bounds[:-1]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(list(np.concatenate(near)), pa.list_(pa.int32()))], names=["id", "v", "labels"])


def label(rows: DataFrame, models: list[Model]) -> DataFrame:
    """rows with an array of labels, one of each model, written as a table of its own."""
    kind = rows.schema["id"].dataType.simpleString()
    return _shared(rows, models, _labels, f"id {kind}, v array<double>, labels array<int>", cut)


def silhouettes(labelled: DataFrame, counts: list[int]) -> list[float | None]:
    """labelled (id, v, labels) -> the mean silhouette of each labelling, by one search over all block pairs.

    counts: how many labels each labelling has at most. Labellings with one cluster have none; a cluster of one counts as 0. Ids must be
    unique.
    """
    cuts = np.concatenate(([0], np.cumsum(counts)))
    kind = labelled.schema["id"].dataType.simpleString()

    def kernel(a: dict, parts: Iterator[dict]) -> Iterator[list]:
        s = np.zeros((len(a["id"]), int(cuts[-1])))
        for b in parts:
            member = np.zeros((len(b["id"]), int(cuts[-1])))
            member[np.arange(len(b["id"]))[:, None], b["labels"] + cuts[:-1]] = 1
            for at in slices(len(s)):
                s[at] += _distances(a["v"][at], b["v"]) @ member
        yield [a["id"], a["labels"], s]

    part = scan(labelled, labelled, kernel, f"id {kind}, labels array<bigint>, s array<double>", ["labels"])
    sums = part.groupBy("id").agg(F.first("labels").alias("labels"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
    sized = labelled.select(F.posexplode("labels").alias("m", "label")).groupBy("m", "label").count().collect()  # a row for each cluster
    size = np.zeros(int(cuts[-1]))
    for r in sized:
        size[cuts[r["m"]] + r["label"]] = r["count"]

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.stack([np.asarray(v.values, float) for v in batch.column("s")])
            own = np.stack([np.asarray(v.values) for v in batch.column("labels")]) + cuts[:-1]
            out = []
            for m, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                at, n = own[:, m], size[own[:, m]]
                inside = s[np.arange(len(s)), at] / np.maximum(n - 1, 1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    other = np.where(size[a:b] > 0, s[:, a:b] / size[a:b], np.inf)
                other[np.arange(len(s)), at - a] = np.inf
                outside = other.min(1)
                widest = np.maximum(inside, outside)
                out.append(float(np.where((n > 1) & (widest > 0), (outside - inside) / np.where(widest > 0, widest, 1), 0.0).sum()) if (size[a:b] > 0).sum() > 1 else None)
            yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64())), pa.array([len(s)], pa.int64())], names=["s", "n"])

    totals = sums.mapInArrow(mean, "s array<double>, n long").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[m]).alias(f"s{m}") for m in range(len(counts))]).first()
    return [None if totals[f"s{m}"] is None else totals[f"s{m}"] / totals["n"] for m in range(len(counts))]


def _rank(m: Model) -> tuple[float, int]:
    """Costs that differ by the order of sums only count as equal, so that the first such start is taken in any partitioning."""
    return float(f"{m.cost:.9e}"), m.start


def kmeans_auto(vectors: DataFrame, ks: Iterable[int] = range(2, 13), seed: int = 42, runs: int = 25, otherwise: int = 3) -> tuple[DataFrame, dict[int, float]]:
    """(id, v) -> id, cluster for the number of clusters with the largest exact silhouette, and the silhouette of each number.

    Of the `runs` starts of a number that with the least cost counts. If no number gives two clusters (all vectors are equal), it is
    `otherwise` clusters, as far as there are different vectors. Rows whose vector is null or holds null or non-finite components take
    no part; an empty table gives an empty result.
    """
    whole = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = vectors.where(whole).select("id", F.xxhash64("id").alias("h"), F.col("v").cast("array<double>").alias("v"))
    rows = cut(dealt(rows, vectors.count(), "id"))  # a file may lie in one row group, which one task would read in every pass
    if rows.isEmpty():
        return rows.select("id", F.lit(0).alias("cluster")), {}
    ks = list(ks)
    models = fit(rows, starts(rows, ks, runs, seed))
    best = [min((m for m in models if m.k == k), key=_rank) for k in ks]
    labelled = label(rows, best)
    found = silhouettes(labelled, [len(m.centres) for m in best])
    score = {k: s for k, s in zip(ks, found, strict=True) if s is not None}
    if not score:
        only = min(fit(rows, starts(rows, [otherwise], runs, seed)), key=_rank)
        return label(rows, [only]).select("id", F.col("labels")[0].alias("cluster")), score
    k = max(score, key=lambda k: (score[k], -k))
    return labelled.select("id", F.col("labels")[ks.index(k)].alias("cluster")), score
