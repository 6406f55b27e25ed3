"""Elastic nets for each month of a horizon, chosen by cross-validation over a whole path of penalties.

Spark numbers the wells, cuts the order into contiguous folds and sums counts, means and covariances of each (month, fold). A task
then solves the nets of a month from these few numbers: all folds and mixes together, from the largest penalty to the smallest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .preprocess import numbered

FEATURES = ["y_mean", "y_std", "y_slope", "y_intercept", "y_curv", "wc_mean", "wc_std"]
#: Penalties of a path and the last one's share of the first; sweeps at most for a penalty.
PENALTIES, LAST, SWEEPS = 100, 1e-3, 5000
#: Sweeps between two attempts to solve for the weights whose signs are known.
EVERY = 5


def objective(g: np.ndarray, c: np.ndarray, w: np.ndarray, alpha: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Half the mean squared error plus the penalty, without the target's own part, for each problem (g, c, w have one in each row)."""
    fit = 0.5 * np.einsum("bi,bij,bj->b", w, g, w) - (c * w).sum(1)
    return fit + alpha * (ratio * np.abs(w).sum(1) + 0.5 * (1 - ratio) * np.square(w).sum(1))


def _exact(g: np.ndarray, c: np.ndarray, w: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights that solve the equations of the places where w isn't 0 with the signs of w, and whether they are the minimum."""
    p, sign = w.shape[1], np.sign(w)
    on = sign != 0
    system = np.where(on[:, :, None] & on[:, None, :], g, 0.0)
    system[:, np.arange(p), np.arange(p)] += np.where(on, l2[:, None], 1.0)
    try:
        solved = np.linalg.solve(system, np.where(on, c - l1[:, None] * sign, 0.0)[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:  # only without the quadratic part
        return w, np.zeros(len(w), bool)
    rest = np.abs(c - np.einsum("bij,bj->bi", g, solved))
    scale = np.abs(c).max(1, initial=0.0)[:, None] + 1e-300
    fine = np.where(on, sign * solved >= 0, rest <= l1[:, None] + 1e-12 * scale).all(1)
    return np.where(on, solved, 0.0), fine


def elastic_paths(g: np.ndarray, c: np.ndarray, alphas: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Weights (problem, penalty, feature) that minimise `objective` along decreasing penalties alphas (problem, penalty).

    g (problem, feature, feature) and c (problem, feature) are covariances of the features and with the target. Coordinate descent
    starts at the weights of the penalty before. Features that the sequential rule says stay at 0 are left out, and come back
    where the minimum's conditions show that they were left out wrongly. Once the signs stand the weights come from the linear equations.
    """
    problems, p = c.shape
    w, out = np.zeros((problems, p)), np.zeros((problems, alphas.shape[1], p))
    diagonal, before = np.einsum("bii->bi", g), alphas[:, 0]
    for k in range(alphas.shape[1]):
        l1, l2 = alphas[:, k] * ratio, alphas[:, k] * (1 - ratio)
        slack = np.abs(c - np.einsum("bij,bj->bi", g, w))
        some = (slack >= (2 * l1 - before * ratio)[:, None]) | (w != 0)
        todo = np.arange(problems)
        for sweep in range(1, SWEEPS + 1):
            a, gt, ct, on = w[todo], g[todo], c[todo], some[todo]
            for j in np.flatnonzero(on.any(0)):
                r = ct[:, j] - np.einsum("bi,bi->b", gt[:, j], a) + diagonal[todo, j] * a[:, j]
                shrunk = np.sign(r) * np.maximum(0.0, np.abs(r) - l1[todo])
                whole = diagonal[todo, j] + l2[todo]
                a[:, j] = np.where(on[:, j] & (whole > 0), shrunk / np.where(whole > 0, whole, 1.0), 0.0)
            w[todo] = a
            if sweep % EVERY == 0 or sweep == 1:
                solved, fine = _exact(gt, ct, a, l1[todo], l2[todo])
                w[todo[fine]] = solved[fine]
                todo = todo[~fine]
                if not len(todo):
                    break
                some[todo] |= np.abs(c[todo] - np.einsum("bij,bj->bi", g[todo], w[todo])) > l1[todo, None]
        out[:, k], before = w, alphas[:, k]
    return out


def contiguous_folds(wells: DataFrame, folds: int = 5) -> DataFrame:
    """wells (well_name, each once) -> well_name, fold: the order of names cut into folds, the first ones longer by one where it doesn't divide."""
    placed = numbered(wells.select("well_name"), "well_name", "k")
    n = placed.count()
    size, longer = n // folds, n % folds
    edge = longer * (size + 1)
    fold = F.when(F.col("k") < edge, F.floor(F.col("k") / (size + 1))).otherwise(longer + F.floor((F.col("k") - edge) / max(1, size)))
    return placed.select("well_name", fold.cast("int").alias("fold"))


def elastic_net_forecast(features: DataFrame, targets: DataFrame, ratios: tuple[float, ...] = (0.1, 0.5, 0.9), folds: int = 5, penalties: int = PENALTIES) -> DataFrame:
    """features (well_name, FEATURES) and targets (well_name, t, y) -> well_name, t, y_pred, y_oof of the wells of targets.

    For each month and mix of penalties the path begins where all weights are 0 and ends at LAST of that. The pair with the least error,
    the mean over the folds of their mean squares, is fitted to all wells for y_pred (as in-sample as its model); y_oof comes from
    that pair's fit without the well's fold. Folds are contiguous in the order of names. Wells with a missing feature, and rows with a
    missing target, don't take part.
    """
    whole = features.where(" and ".join(f"{c} is not null" for c in FEATURES)).select("well_name", *[F.col(c).cast("double").alias(c) for c in FEATURES])
    known = targets.where("y is not null").select("well_name", "t", F.col("y").cast("double").alias("y"))
    fold = contiguous_folds(whole.join(known.select("well_name").distinct(), "well_name", "left_semi"), folds)
    keyed = whole.join(fold, "well_name")
    names = [*FEATURES, "y"]
    shared = [F.covar_pop(a, b).alias(f"{a}*{b}") for i, a in enumerate(names) for b in names[i:]]
    sums = known.join(keyed, "well_name").groupBy("t", "fold").agg(F.count("*").cast("double").alias("n"), *[F.avg(c).alias(c) for c in names], *shared)

    def pooled(parts: list[tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
        n = sum(k for k, _, _ in parts)
        mean = sum(k * m for k, m, _ in parts) / n
        return n, mean, sum(k * (s + np.outer(m - mean, m - mean)) for k, m, s in parts) / n

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {}
        for r in pdf.to_dict("records"):
            cov = np.array([[r[f"{a}*{b}"] if f"{a}*{b}" in r else r[f"{b}*{a}"] for b in names] for a in names])
            parts[r["fold"]] = (r["n"], np.array([r[c] for c in names]), cov)
        held = sorted(parts) if len(parts) > 1 else []
        every = pooled(list(parts.values()))
        fits = [every, *[pooled([x for f, x in parts.items() if f != h]) for h in held]]
        x, y = slice(0, -1), -1
        top = np.abs(every[2][x, y]).max()
        paths = [np.geomspace(max(top / r, 1e-12), max(top / r, 1e-12) * LAST, penalties) for r in ratios]
        g = np.stack([s[x, x] for _, _, s in fits] * len(ratios))
        c = np.stack([s[x, y] for _, _, s in fits] * len(ratios))
        ratio = np.repeat(ratios, len(fits))
        w = elastic_paths(g, c, np.repeat(np.stack(paths), len(fits), 0), ratio).reshape(len(ratios), len(fits), penalties, -1)
        loss = np.zeros((len(ratios), penalties))
        for i, h in enumerate(held, 1):
            _, mean, s = parts[h]
            v = w[:, i]
            off = (mean[y] - fits[i][1][y]) - (v @ (mean[x] - fits[i][1][x]))
            loss += (s[y, y] - 2 * v @ s[x, y] + np.einsum("rki,ij,rkj->rk", v, s[x, x], v) + off**2) / len(held)
        a, b = np.unravel_index(loss.argmin(), loss.shape)  # ties: the first mix, the largest penalty
        out = []
        for i, h in enumerate([-1, *held]):
            v, mean = w[a, i, b], fits[i][1]
            out.append((key[0], h, float(paths[a][b]), float(ratios[a]), float(mean[y] - v @ mean[x]), v.tolist()))
        return pd.DataFrame(out, columns=["t", "fold", "alpha", "ratio", "b", "w"])

    models = sums.groupBy("t").applyInPandas(fit, "t int, fold int, alpha double, ratio double, b double, w array<double>")
    packed = models.groupBy("t").agg(F.max(F.when(F.col("fold") < 0, F.struct("b", "w"))).alias("all"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("b", "w")))).alias("by_fold"))
    value = lambda m: m["b"] + F.aggregate(F.zip_with(m["w"], F.array(*FEATURES), lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    months = targets.select("well_name", "t").distinct().join(keyed, "well_name").join(packed, "t")
    return months.select("well_name", "t", value(F.col("all")).alias("y_pred"), value(F.try_element_at("by_fold", F.col("fold"))).alias("y_oof"))
