"""The metric index: same neighbours as all pairs, most blocks left out where vectors cluster."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilia.operators import metric_index, neighbors


def frame(spark, v, ids=None):
    rows = [(int(i), [float(x) for x in r]) for i, r in zip(range(len(v)) if ids is None else ids, v, strict=True)]
    return spark.createDataFrame(rows, "id bigint, v array<double>")


def plain(q, v, k, drop_self=True):
    out = set()
    for i, x in enumerate(q):
        d = np.round(np.sqrt(np.square(v - x).sum(1)), 9)
        order = [j for j in np.lexsort((np.arange(len(v)), d)) if not (drop_self and i == j)][:k]
        out |= {(i, int(j), float(d[j]), n + 1) for n, j in enumerate(order)}
    return out


def clustered(rng, groups=12, each=40, dim=4):
    return np.concatenate([rng.normal(size=dim) * 50 + rng.normal(size=(each, dim)) for _ in range(groups)])


def rows(df):
    return {(r["i"], r["j"], r["d"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("kind", ["clustered", "spread", "copies", "hot", "far"])
def test_same_neighbours_as_all_pairs(spark, monkeypatch, kind):
    rng = np.random.default_rng(7)
    v = clustered(rng) if kind != "spread" else rng.normal(size=(300, 6))
    if kind == "copies":  # ties at distance 0
        v[100:140] = v[3]
    if kind == "hot":  # a third of all rows in one place
        v[::3] = v[0] + 1e-7 * rng.normal(size=v[::3].shape)
    if kind == "far":  # differences are small against the coordinates
        v = np.round(v + 1e6, 3)
    monkeypatch.setattr(neighbors, "BLOCK", 20)
    monkeypatch.setattr(neighbors, "INDEXED", 4)
    df = frame(spark, v)
    assert rows(neighbors.knn(df, df, 5, "bigint")) == plain(v, v, 5)


def test_other_queries_and_self(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v = clustered(rng, 6, 30)
    q = np.concatenate([v[:10], rng.normal(size=(10, 4)) * 80])
    monkeypatch.setattr(neighbors, "BLOCK", 16)
    monkeypatch.setattr(neighbors, "INDEXED", 2)
    assert rows(neighbors.knn(frame(spark, q), frame(spark, v), 7, "bigint", drop_self=False)) == plain(q, v, 7, False)


def test_fewer_vectors_than_asked_and_repeated_ids(spark, monkeypatch):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(12, 3))
    monkeypatch.setattr(neighbors, "BLOCK", 4)
    monkeypatch.setattr(neighbors, "INDEXED", 1)
    assert rows(neighbors.knn(frame(spark, v), frame(spark, v), 20, "bigint")) == plain(v, v, 20)
    twice = frame(spark, v, [*range(11), 0])
    got = neighbors.knn(twice, twice, 3, "bigint").where("i = 1").collect()
    d = sorted((round(float(np.linalg.norm(v[1] - v[j])), 9), j % 11) for j in range(12) if j != 1)
    assert [(r["d"], r["j"]) for r in sorted(got, key=lambda r: r["rank"])] == d[:3]


def test_most_blocks_are_left_out(spark):
    v = clustered(np.random.default_rng(10), 30, 60)
    df = frame(spark, v)
    rings, members = metric_index.metric_rings(df, "bigint", 20)
    blocks = {(r["ring"], r["part"]) for r in members.select("ring", "part").distinct().collect()}
    assert members.count() == len(v) and rings.rows.sum() == len(v)
    bounds = {i: d for i, _, d, n in plain(v, v, 5) if n == 5}
    asked = df.join(spark.createDataFrame(list(bounds.items()), "id bigint, most double"), "id").select("id", "v", "most")
    ringed = metric_index.surviving(asked, rings, 6, "bigint").select("id", F.explode("rings").alias("ring"))
    met = sum(len([b for b in blocks if b[0] == r["ring"]]) for r in ringed.collect())
    assert met < 0.2 * len(v) * len(blocks)


def test_bounds_hold():
    rng = np.random.default_rng(11)
    v = rng.normal(size=(200, 3))
    pivots = v[:5]
    d = np.stack([np.linalg.norm(v - p, axis=1) for p in pivots], 1)
    cell = d.argmin(1)
    own = [d[cell == c, c] for c in range(5)]
    rings = metric_index.Rings(pivots, np.arange(5), np.array([o.min() for o in own]), np.array([o.max() for o in own]), np.array([len(o) for o in own]))
    q = rng.normal(size=(50, 3)) * 3
    to = np.linalg.norm(q[:, None] - v[None], axis=2)
    least = rings.at_least(rings.distances(q))
    for c in range(5):
        assert (to[:, cell == c].min(1) >= least[:, c] - 1e-9).all()
    for k in (1, 10, 200):
        assert (np.sort(to, 1)[:, k - 1] <= rings.bound(rings.distances(q), k) + 1e-9).all()
    assert np.isinf(rings.bound(rings.distances(q), 201)).all()


@pytest.mark.parametrize("left", [-1, 1])
@pytest.mark.parametrize("kind", ["clustered", "spread", "copies"])
def test_both_ways_give_the_same_rows(spark, monkeypatch, kind, left):
    rng = np.random.default_rng(12)
    v = clustered(rng) if kind != "spread" else rng.normal(size=(300, 6))
    if kind == "copies":
        v[100:140] = v[3]
    for name, value in (("BLOCK", 20), ("INDEXED", 4), ("LEFT", left), ("SLICE", 7), ("BLOCKS", 3)):
        monkeypatch.setattr(neighbors, name, value)
    df = frame(spark, v)
    assert rows(neighbors.knn(df, df, 5, "bigint")) == plain(v, v, 5)


def test_an_index_that_leaves_all_is_not_used(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 20)
    monkeypatch.setattr(neighbors, "INDEXED", 4)
    monkeypatch.setattr(metric_index, "indexed_nearest", None)  # a call would fail
    v = np.random.default_rng(13).normal(size=(300, 40))
    df = frame(spark, v)
    assert rows(neighbors.knn(df, df, 5, "bigint")) == plain(v, v, 5)


def test_a_query_leaves_its_task_with_its_own_neighbours_only(spark, monkeypatch):
    """k rows of a query whatever the number of parts; they were k for each part."""
    monkeypatch.setattr(neighbors, "BLOCK", 20)
    a = frame(spark, np.random.default_rng(14).normal(size=(400, 5)))
    found = neighbors.scan(a, a, lambda x, parts: neighbors._nearest_of_all(x, parts, 3, True), "i bigint, j bigint, d double")
    assert found.count() == 3 * 400


def test_distances_by_product_equal_those_by_differences():
    rng = np.random.default_rng(15)
    y = rng.normal(size=(50, 8)) + 1e3
    x = np.concatenate([y[:5], y[5:10] + 1e-7, rng.normal(size=(40, 8)) + 1e3])
    exact = np.sqrt(np.square(x[:, None] - y[None]).sum(2))
    assert np.allclose(neighbors._distances(x, y), exact, rtol=1e-9, atol=1e-12)
