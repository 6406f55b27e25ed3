"""Graphs in blocks of edges: several blocks give what one gives, and a pass sends values only."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_map import graph_of, ring_and_chords

from profilia.config import ManifoldConfig
from profilia.operators import blocks, layout, neighbors, spectral


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "UNIT", 16)
    monkeypatch.setattr(blocks, "WANTED", 4)


def test_eigenvectors_of_several_blocks(spark, small_blocks):
    n = 90
    edges = {(a, b): w for a, b, w in ring_and_chords(np.random.default_rng(3), n)}
    w = np.zeros((n, n))
    for (a, b), x in edges.items():
        w[a, b] = w[b, a] = x
    deg = w.sum(1)
    lap = np.eye(n) - w / np.sqrt(deg[:, None] * deg[None])
    # ids in no row, in single precision
    found, got, residual = spectral.eigenvectors(graph_of(spark, [(3 * a + 5, 3 * b + 5, x) for (a, b), x in edges.items()]), 2, tol=1e-4)
    x = np.array([[r["v0"], r["v1"]] for r in found.orderBy("i").collect()])
    assert got == pytest.approx(np.linalg.eigvalsh(lap)[1:3], abs=1e-7) and residual.max() <= 1e-4
    assert np.linalg.norm(lap @ x - x * got, axis=0).max() < 1.1e-4 and np.linalg.norm(x, axis=0) == pytest.approx(1, abs=1e-5)


def test_layout_does_not_depend_on_blocks(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(90, 3))
    points = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, v array<double>").cache()
    graph = layout.fuzzy_graph(neighbors.knn(points, points, 6, "bigint"), 6).cache()
    start = points.select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y")).union(spark.createDataFrame([(500, 0.25, 0.5)], "id long, x double, y double"))
    monkeypatch.setattr(layout, "HEADS", 16)
    monkeypatch.setattr(layout, "DRAWN", 40)
    monkeypatch.setattr(layout, "EDGES", 8)  # some heads have more
    place = lambda: np.array([[r["id"], r["x"], r["y"]] for r in layout.layout(graph, start, ManifoldConfig(epochs=20), together=10).orderBy("id").collect()])
    one = place()
    monkeypatch.setattr(blocks, "UNIT", 16)
    monkeypatch.setattr(blocks, "WANTED", 4)
    assert len(one) == 91 and np.isfinite(one).all() and np.array_equal(one, place())


def test_a_pass_sends_no_edges(spark, small_blocks):
    """Each of several passes has one exchange, that of the values; every block lies in a partition of its own."""
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(64) for j in range(64) if i != j], "a long, b long, w double")
    b = blocks.blocks(edges, F.col("w"), 64)
    assert len(b.keys) == 4 and b.edges.select(F.spark_partition_id()).distinct().count() == 4
    values = b.made(lambda block, size: np.full((2, size), float(block)))
    out = values
    for _ in range(3):
        out = b.meet(out, lambda block, e, x: [block, np.stack([np.bincount(e[0], x[c][e[1]]) for c in range(2)]).astype("<f8").tobytes()], "block long, x binary")
    lines = out._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    inside, exchanges = None, 0
    for x, at in zip(lines, depth, strict=True):  # what made the kept edges is no part of a pass
        inside = None if inside is not None and at <= inside else inside
        inside = at if inside is None and "InMemoryRelation" in x else inside
        exchanges += inside is None and "Exchange" in x
    assert out.count() == 4 and exchanges == 3
    rows = {r["k"]: r["x"] for r in b.unpacked(values, ["x", "y"]).collect()}
    assert len(rows) == 64 and rows[63] == 3.0
    b.release()


@pytest.mark.parametrize("gaps", [[], [41], [16, 63]])
def test_connected(spark, small_blocks, gaps):
    """A path in no order of its numbers, whole or with some of its edges missing."""
    order = np.random.default_rng(1).permutation(70).tolist()
    pairs = [(order[k], order[k + 1]) for k in range(69) if k not in gaps]
    b = blocks.blocks(spark.createDataFrame([(i, j, 1.0) for x, y in pairs for i, j in ((x, y), (y, x))], "a long, b long, w double"), F.col("w"), 70)
    assert b.connected() == (not gaps)
    b.release()


def test_neighbours_in_single_precision():
    """A product in single precision can't tell these rows apart; the neighbours are those by differences all the same."""
    rng = np.random.default_rng(5)
    for far, spread in ((0.0, 1.0), (1e3, 1e-3), (1e8, 1e-6), (0.0, 1e-20), (0.0, 1e20)):
        x = far + spread * rng.normal(size=(400, 8))
        x[200:] = x[:200] + spread * 1e-7 * rng.normal(size=(200, 8))
        found = neighbors.Nearest({"id": np.arange(50), "v": x[:50]}, 7, True)
        for s in range(0, 400, 100):
            found.meet({"id": np.arange(s, s + 100), "v": x[s : s + 100]})
        i, j, d = found.columns()
        want = np.round(np.sqrt(np.square(x[None] - x[:50, None]).sum(2)), 9)
        want[np.arange(50), np.arange(50)] = np.inf
        for q in range(50):
            order = np.lexsort((np.arange(400), want[q]))[:7]
            assert j[i == q].tolist() == order.tolist() and np.array_equal(d[i == q], want[q][order])
