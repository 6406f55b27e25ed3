"""Prototypes of clusters by method: soft-DTW barycentres, DTW barycentre averaging, medians.

A curve for each cluster and channel is what the driver holds; members never leave the tasks. A pass sends the curves out, aligns every
member to its own, and sums by cluster, channel and place; so all clusters and channels move in the same passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

METHODS = ("auto", "softdtw", "dba", "median")
#: Members aligned at once in a task.
_MEMBERS = 512


def soft_dtw(z: np.ndarray, y: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """Soft-DTW values of curve z against each row of y, and their gradients in z, for squared differences."""
    n, (m, t) = len(z), y.shape
    d = np.square(z[None, :, None] - y[:, None, :])
    r = np.full((m, n + 2, t + 2), np.inf)
    r[:, 0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, t + 1):
            near = np.stack([r[:, i - 1, j - 1], r[:, i - 1, j], r[:, i, j - 1]])
            low = near.min(0)
            r[:, i, j] = d[:, i - 1, j - 1] + low - gamma * np.log(np.exp(-(near - low) / gamma).sum(0))
    value = r[:, n, t].copy()
    r[:, n + 1, :], r[:, :, t + 1] = -np.inf, -np.inf
    r[:, n + 1, t + 1] = value
    e, dd = np.zeros((m, n + 2, t + 2)), np.zeros((m, n + 2, t + 2))
    e[:, n + 1, t + 1], dd[:, 1 : n + 1, 1 : t + 1] = 1, d
    for i in range(n, 0, -1):
        for j in range(t, 0, -1):
            for a, b in ((i + 1, j), (i, j + 1), (i + 1, j + 1)):
                e[:, i, j] += e[:, a, b] * np.exp((r[:, a, b] - r[:, i, j] - dd[:, a, b]) / gamma)
    weight = e[:, 1 : n + 1, 1 : t + 1]
    return value, (2 * weight * (z[None, :, None] - y[:, None, :])).sum(2)


def dtw_align(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of y: the least summed squared difference to curve z along a warping path, and for each place of z the sum and number
    of the row's values that the path lays on it. Of equal steps the diagonal one is taken, then the one along z."""
    n, (m, t) = len(z), y.shape
    d = np.square(z[None, :, None] - y[:, None, :])
    r = np.full((m, n + 1, t + 1), np.inf)
    r[:, 0, 0] = 0
    for k in range(2, n + t + 1):
        i = np.arange(max(1, k - t), min(n, k - 1) + 1)
        j = k - i
        r[:, i, j] = d[:, i - 1, j - 1] + np.minimum(np.minimum(r[:, i - 1, j - 1], r[:, i - 1, j]), r[:, i, j - 1])
    total, count = np.zeros((m, n)), np.zeros((m, n))
    row, i, j = np.arange(m), np.full(m, n), np.full(m, t)
    while len(row):
        total[row, i - 1] += y[row, j - 1]
        count[row, i - 1] += 1
        step = np.stack([r[row, i - 1, j - 1], r[row, i - 1, j], r[row, i, j - 1]]).argmin(0)
        i, j = i - (step < 2), j - (step != 1)
        on = (i > 0) & (j > 0)
        row, i, j = row[on], i[on], j[on]
    return r[:, n, t], total, count


Curves = dict[tuple[int, str], np.ndarray]


def _pass(rows: DataFrame, kernel: Callable, at: Curves) -> dict[tuple[int, str], tuple[float, np.ndarray, np.ndarray]]:
    """Sums over the members of each curve in `at`: kernel's values, and its two numbers for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = list(zip(b.column("cluster").to_pylist(), b.column("channel").to_pylist(), strict=True))
            members: dict[tuple[int, str], list[int]] = {}
            for i, k in enumerate(keys):
                if k in at:
                    members.setdefault(k, []).append(i)
            out = []
            for k, of in members.items():
                for i in range(0, len(of), _MEMBERS):
                    y = np.array([b.column("y")[r].as_py() for r in of[i : i + _MEMBERS]], float)
                    value, one, two = kernel(at[k], y)
                    out.append((*k, float(value.sum()), one.sum(0).tolist(), two.sum(0).tolist()))
            kinds = [pa.int32(), pa.string(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            cols = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays(cols, names=["cluster", "channel", "value", "one", "two"])

    part = rows.mapInArrow(run, "cluster int, channel string, value double, one array<double>, two array<double>")
    each = part.select("cluster", "channel", "value", F.posexplode(F.arrays_zip("one", "two")).alias("t", "x"))
    whole = each.groupBy("cluster", "channel", "t").agg(F.sum("value").alias("value"), F.sum("x.one").alias("one"), F.sum("x.two").alias("two"))
    found: dict[tuple[int, str], list] = {}
    for r in sorted(whole.collect(), key=lambda r: r["t"]):  # a row for each place of each curve
        found.setdefault((r["cluster"], r["channel"]), []).append((r["value"], r["one"], r["two"]))
    return {k: (v[0][0], np.array([x[1] for x in v]), np.array([x[2] for x in v])) for k, v in found.items()}


def _soft(rows: DataFrame, curves: Curves, sizes: dict, gamma: float, rounds: int) -> Curves:
    """Steps down the gradient of the summed soft-DTW, each halved until the sum falls."""
    kernel = lambda z, y: (*(r := soft_dtw(z, y, gamma)), np.zeros_like(r[1]))
    curves = dict(curves)
    now = _pass(rows, kernel, curves)
    step = {k: 0.25 / sizes[k] for k in curves}
    live = set(curves)
    for _ in range(rounds):
        live = {k for k in live if step[k] * np.abs(now[k][1]).max() >= 1e-7}
        if not live:
            break
        tried = {k: curves[k] - step[k] * now[k][1] for k in live}
        after = _pass(rows, kernel, tried)
        for k in live:
            if after[k][0] < now[k][0]:
                curves[k], now[k], step[k] = tried[k], after[k], 1.5 * step[k]
            else:
                step[k] /= 2
    return curves


def _averaged(rows: DataFrame, curves: Curves, sizes: dict, rounds: int, tol: float = 1e-5) -> Curves:
    """Each place becomes the mean of the values that the members' best paths lay on it, until the mean cost of a member falls by no more than tol."""
    curves, cost = dict(curves), dict.fromkeys(curves, np.inf)
    live = set(curves)
    for _ in range(rounds):
        if not live:
            break
        found = _pass(rows, dtw_align, {k: curves[k] for k in live})
        for k, (value, total, count) in found.items():
            mean = value / sizes[k]
            if cost[k] - mean <= tol:
                live.discard(k)
            if mean <= cost[k]:
                curves[k], cost[k] = total / count, mean
    return curves


def prototypes(profiles: DataFrame, labels: DataFrame, channels: list[str], T: int = 36, method: str = "auto", gamma: float = 1.0, rounds: int = 50) -> DataFrame:
    """profiles (well_name, an array for each channel), labels (well_name, cluster) -> cluster, channel, t, value: a curve of T months each.

    method: "softdtw" and "dba" start at the mean, with missing months as 0; "median" takes the median of each month's values, null where
    no member has one; "auto" is "softdtw", and the median for a curve that doesn't come out finite. Noise (-1) and null clusters are left out,
    a cluster of one has that member's own curve, empty inputs give no rows. Further columns are ignored.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    spark = profiles.sparkSession
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.slice(c, 1, T).cast("array<double>").alias("y")) for c in channels])).alias("x")
    raw = profiles.join(labels.where("cluster >= 0").select("well_name", F.col("cluster").cast("int").alias("cluster")), "well_name").select("cluster", each).select("cluster", "x.channel", "x.y")
    median = raw.select("cluster", "channel", F.posexplode("y").alias("t", "x")).groupBy("cluster", "channel", "t").agg(F.median(F.when(F.abs("x") < float("inf"), F.col("x"))).alias("value"))
    if method == "median":
        return median
    rows = cut(raw.select("cluster", "channel", F.transform("y", lambda x: F.when(F.abs(x) < float("inf"), x).otherwise(0.0)).alias("y")).where(F.size("y") > 0))
    start = rows.select("cluster", "channel", F.posexplode("y").alias("t", "x")).groupBy("cluster", "channel", "t").agg(F.avg("x").alias("x"), F.count("*").alias("n")).collect()  # T numbers for each curve
    curves: Curves = {}
    sizes: dict[tuple[int, str], int] = {}
    for r in sorted(start, key=lambda r: r["t"]):
        k = (r["cluster"], r["channel"])
        curves[k], sizes[k] = np.append(curves.get(k, []), r["x"]), r["n"]
    if curves:
        curves = _averaged(rows, curves, sizes, rounds) if method == "dba" else _soft(rows, curves, sizes, gamma, rounds)
    whole = {k: z for k, z in curves.items() if np.isfinite(z).all()}
    flat = [(int(c), name, t, float(x)) for (c, name), z in whole.items() for t, x in enumerate(z)]
    out = spark.createDataFrame(flat, "cluster int, channel string, t int, value double")
    if method == "auto" and len(whole) < len(curves):
        lost = spark.createDataFrame([k for k in curves if k not in whole], "cluster int, channel string")
        out = out.union(median.join(F.broadcast(lost), ["cluster", "channel"]))  # a row for each such curve
    return out


def barycenters(profiles: DataFrame, labels: DataFrame, channel: str, T: int = 36, gamma: float = 1.0, rounds: int = 50) -> DataFrame:
    """The soft-DTW prototypes of one channel: cluster, t, value."""
    return prototypes(profiles, labels, [channel], T, "softdtw", gamma, rounds).drop("channel")
