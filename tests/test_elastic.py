"""Elastic-net paths against a long plain run, folds in order, the whole search against plain cross-validation."""

import numpy as np
import pytest

from profilia.operators import elastic
from profilia.plans import queries


def plain(x, y, alpha, ratio, rounds=20000):
    """Coordinate descent on centred rows, one weight after another, for as long as any weight moves."""
    n, p = x.shape
    w, r = np.zeros(p), y.copy()
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero(x.any(0)):
            rho = x[:, j] @ r / n + (x[:, j] @ x[:, j] / n) * w[j]
            new = np.sign(rho) * max(0.0, abs(rho) - alpha * ratio) / (x[:, j] @ x[:, j] / n + alpha * (1 - ratio))
            r += x[:, j] * (w[j] - new)
            moved, w[j] = max(moved, abs(w[j] - new)), new
        if moved < 1e-13:
            break
    return w


def cost(x, y, w, alpha, ratio):
    return 0.5 * np.mean((y - x @ w) ** 2) + alpha * (ratio * np.abs(w).sum() + 0.5 * (1 - ratio) * (w**2).sum())


@pytest.mark.parametrize("ratio", [0.1, 0.5, 0.9, 1.0])
def test_paths_reach_the_minimum(ratio):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 7)) * [1, 3, 0.2, 1, 1, 5, 1]
    x[:, 3] = x[:, 0] - 0.9 * x[:, 2] + 1e-3 * rng.normal(size=50)  # nearly dependent, as the line's features are
    x[:, 6] = 2.0  # constant
    y = 3 * x[:, 0] - x[:, 2] + rng.normal(size=50)
    x, y = x - x.mean(0), y - y.mean()
    g, c = x.T @ x / 50, x.T @ y / 50
    alphas = np.geomspace(np.abs(c).max() / ratio, np.abs(c).max() / ratio * 1e-3, 100)
    w = elastic.elastic_paths(g[None], c[None], alphas[None], np.array([ratio]))[0]
    assert np.abs(w[0]).max() < 1e-12 and not w[:, 6].any()
    for k in range(0, 100, 9):
        best = cost(x, y, plain(x, y, alphas[k], ratio), alphas[k], ratio)
        assert cost(x, y, w[k], alphas[k], ratio) <= best + 1e-8 * (1 + best)
        given = elastic.objective(g[None], c[None], w[k][None], alphas[k : k + 1], np.array([ratio]))[0]
        assert given + 0.5 * np.mean(y**2) == pytest.approx(cost(x, y, w[k], alphas[k], ratio))


def test_problems_together_equal_problems_alone():
    rng = np.random.default_rng(6)
    xs = [rng.normal(size=(30, 4)) for _ in range(6)]
    ys = [x @ rng.normal(size=4) + rng.normal(size=30) for x in xs]
    g, c = np.stack([x.T @ x / 30 for x in xs]), np.stack([x.T @ y / 30 for x, y in zip(xs, ys, strict=True)])
    alphas, ratio = np.geomspace(np.abs(c).max(1), 1e-3, 40).T, np.linspace(0.1, 1, 6)
    both = elastic.elastic_paths(g, c, alphas, ratio)
    for i in range(6):
        assert np.allclose(both[i], elastic.elastic_paths(g[i : i + 1], c[i : i + 1], alphas[i : i + 1], ratio[i : i + 1])[0], atol=1e-9)


def test_folds_in_order(spark):
    wells = spark.createDataFrame([(f"w{i:03d}",) for i in np.random.default_rng(1).permutation(23)], "well_name string")
    got = {r["well_name"]: r["fold"] for r in elastic.contiguous_folds(wells).collect()}
    assert [got[f"w{i:03d}"] for i in range(23)] == [0] * 5 + [1] * 5 + [2] * 5 + [3] * 4 + [4] * 4
    assert {r["fold"] for r in elastic.contiguous_folds(wells.limit(3)).collect()} == {0, 1, 2}
    assert elastic.contiguous_folds(wells.limit(0)).count() == 0


def test_elastic_net_against_plain_search(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(43, 7)) + 5
    ys = {k: 3 * x[:, 0] - x[:, 2] + k + rng.normal(size=43) * (k - 19) for k in (20, 21)}
    f = spark.createDataFrame([(f"w{i:02d}", *map(float, r)) for i, r in enumerate(x)], "well_name string, " + ", ".join(f"{c} double" for c in elastic.FEATURES))
    rows = [(f"w{i:02d}", k, float(y[i])) for k, y in ys.items() for i in range(43)]
    t = spark.createDataFrame([*rows, ("absent", 20, 1.0), ("w00", 22, None)], "well_name string, t int, y double")
    got = {(r["well_name"], r["t"]): r for r in elastic.elastic_net_forecast(f, t, penalties=12).collect()}
    assert set(got) - {("w00", 22)} == {(w, k) for w, k, _ in rows}
    folds = np.array_split(np.arange(43), 5)
    for k, y in ys.items():
        def fit(train, alpha, ratio):
            mx, my = x[train].mean(0), y[train].mean()
            w = plain(x[train] - mx, y[train] - my, alpha, ratio)
            return lambda z: my + (z - mx) @ w

        best = (np.inf,)
        for ratio in (0.1, 0.5, 0.9):
            top = np.abs((x - x.mean(0)).T @ (y - y.mean()) / 43).max() / ratio
            for alpha in np.geomspace(top, top * 1e-3, 12):
                error = np.mean([np.mean((y[h] - fit(np.setdiff1d(np.arange(43), h), alpha, ratio)(x[h])) ** 2) for h in folds])
                if error < best[0] - 1e-12:
                    best = (error, alpha, ratio)
        whole = fit(np.arange(43), *best[1:])(x)
        assert np.allclose([got[f"w{i:02d}", k]["y_pred"] for i in range(43)], whole, atol=1e-6)
        for h in folds:
            out = fit(np.setdiff1d(np.arange(43), h), *best[1:])(x[h])
            assert np.allclose([got[f"w{i:02d}", k]["y_oof"] for i in h], out, atol=1e-6)


def test_query_covers_complete_wells(spark):
    rows = queries.elasticnet_forecast(spark, "/root/testdata/sf0.001").toPandas()
    if len(rows):
        assert set(rows["t"]) == set(range(20, 70)) and rows["y_pred"].notna().all() and (rows.groupby("well_name").size() == 50).all()
