"""The map: fitted curve, spectral start against a dense solver, layout on clusters, hubs, settings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilia.config import ManifoldConfig
from profilia.operators import layout, neighbors, spectral


def graph_of(spark, edges):
    return spark.createDataFrame([(i, j, w) for a, b, w in edges for i, j in ((a, b), (b, a))], "i long, j long, w double").repartition(3).cache()


def test_curve_of_known_distances():
    for least, a, b in ((0.1, 1.576943, 0.895061), (0.001, 1.929073, 0.791505), (0.5, 0.583030, 1.334167)):
        assert layout.fit_curve(least) == pytest.approx((a, b), rel=2e-2)
    x = np.linspace(0, 3, 300)[1:]
    y = np.where(x < 0.05, 1, np.exp(-(x - 0.05)))
    cost = lambda a, b: np.square(1 / (1 + a * x ** (2 * b)) - y).sum()
    a, b = layout.fit_curve(0.05)
    assert all(cost(a, b) <= cost(a + da, b + db) for da in (-1e-3, 0, 1e-3) for db in (-1e-3, 0, 1e-3))


def ring_and_chords(rng, n):
    return [(i, (i + 1) % n, float(rng.uniform(0.5, 1))) for i in range(n)] + [(int(i), int(j), float(rng.uniform(0.1, 1))) for i, j in rng.choice(n, (2 * n, 2)) if i < j and j - i > 1 and (i, j) != (0, n - 1)]


def test_eigenvectors_equal_a_dense_solver(spark):
    n, count = 90, 3
    edges = {(a, b): w for a, b, w in ring_and_chords(np.random.default_rng(3), n)}
    w = np.zeros((n, n))
    for (a, b), x in edges.items():
        w[a, b] = w[b, a] = x
    deg = w.sum(1)
    lap = np.eye(n) - w / np.sqrt(deg[:, None] * deg[None])
    value, vector = np.linalg.eigh(lap)
    found, got, residual = spectral.eigenvectors(graph_of(spark, [(a, b, x) for (a, b), x in edges.items()]), count, tol=5e-7)
    x = np.array([[r[f"v{c}"] for c in range(count)] for r in found.orderBy("i").collect()])
    assert got == pytest.approx(value[1 : count + 1], abs=1e-9) and residual.max() <= 5e-7
    for c in range(count):
        assert np.linalg.norm(lap @ x[:, c] - got[c] * x[:, c]) < 1e-6 and np.linalg.norm(x[:, c]) == pytest.approx(1)
        assert abs(x[:, c] @ vector[:, c + 1]) == pytest.approx(1, abs=1e-5)


def test_disconnected_graphs_have_no_start(spark):
    two = [(i, j, 1.0) for base in (0, 10) for i in range(base, base + 8) for j in range(i + 1, base + 8)]
    g = graph_of(spark, two)
    assert spectral.eigenvectors(g, 2)[0] is None
    assert spectral.eigenvectors(g.limit(0), 2)[0] is None and spectral.eigenvectors(graph_of(spark, [(0, 1, 1.0)]), 2)[0] is None
    points = spark.createDataFrame([(i, [float(i), float(i % 3), 1.0]) for i in [*range(8), *range(10, 18)]], "id long, v array<double>")
    start = layout.spectral_start(g, points)
    assert start.columns == ["id", "x", "y"] and start.count() == 16


def trustworthiness(x, z, k):
    d, e = (np.square(v[:, None] - v[None]).sum(2) for v in (x, z))
    np.fill_diagonal(d, np.inf)
    np.fill_diagonal(e, np.inf)
    rank = d.argsort(1).argsort(1) + 1
    n = len(x)
    near = e.argsort(1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum()


@pytest.fixture(scope="module")
def curve_points(spark):
    t = np.linspace(0, 3 * np.pi, 150)
    x = np.stack([t * np.cos(t), t * np.sin(t), np.sin(3 * t)], 1) + np.random.default_rng(4).normal(0, 0.05, (150, 3))
    return x, spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, v array<double>").cache()


def places(df):
    return np.array([[r["x"], r["y"]] for r in df.orderBy("id").collect()])


def test_map_keeps_neighbours(spark, curve_points):
    x, points = curve_points
    z = places(layout.manifold_map(neighbors.knn(points, points, 8, "bigint"), points, ManifoldConfig(n_neighbors=8, epochs=60)))
    assert trustworthiness(x, z, 8) > 0.97 and np.isfinite(z).all()


def test_reruns_agree_and_parts_exchange(spark, curve_points, monkeypatch):
    x, points = curve_points
    cfg = ManifoldConfig(n_neighbors=8, epochs=60)
    graph = layout.fuzzy_graph(neighbors.knn(points, points, 8, "bigint"), 8).cache()
    start = points.select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    z = places(layout.layout(graph, start, cfg))
    assert np.array_equal(z, places(layout.layout(graph.repartition(7), start.repartition(2), cfg)))
    monkeypatch.setattr(layout, "HEADS", 20)  # several parts
    assert trustworthiness(x, places(layout.layout(graph, start, cfg, together=20)), 8) > 0.95


def test_min_dist_and_dimensions(spark, curve_points):
    x, points = curve_points
    graph = layout.fuzzy_graph(neighbors.knn(points, points, 8, "bigint"), 8).cache()
    start = points.select("id", *[F.col("v")[c].alias(n) for c, n in enumerate("xyz")])
    three = layout.layout(graph, start, ManifoldConfig(n_components=3, epochs=30))
    assert three.columns == ["id", "x", "y", "z"] and three.count() == 150
    assert layout.spectral_start(graph, points, ManifoldConfig(n_components=4), tol=1e-2).columns == ["id", "x0", "x1", "x2", "x3"]

    def place(least, seed=43):
        return np.array([[r["x"], r["y"]] for r in layout.layout(graph, start.drop("z"), ManifoldConfig(min_dist=least, epochs=60, seed=seed)).orderBy("id").collect()])

    def nearest(least):
        z = place(least)
        d = np.sqrt(np.square(z[:, None] - z[None]).sum(2)) + np.eye(150) * 1e9
        return np.median(d.min(1))

    assert nearest(0.8) > 1.5 * nearest(0.01)
    assert not np.allclose(place(0.8), place(0.8, seed=7), atol=1e-3)
    with pytest.raises(ValueError):
        layout.layout(graph, three, ManifoldConfig())


def test_hubs_are_split(spark, monkeypatch):
    """A star whose centre has more edges than a part takes: its place is finite and amid its leaves; a vertex without edges stays."""
    monkeypatch.setattr(layout, "EDGES", 16)
    star = graph_of(spark, [(0, k, 1.0) for k in range(1, 80)])
    start = spark.createDataFrame([(k, float(np.cos(k)), float(np.sin(k))) for k in range(81)], "id long, x double, y double")
    got = {r["id"]: (r["x"], r["y"]) for r in layout.layout(star, start, ManifoldConfig(epochs=50), together=5).collect()}
    z = np.array([got[k] for k in range(81)])
    assert len(got) == 81 and np.isfinite(z).all()
    assert np.linalg.norm(z[0] - z[1:80].mean(0)) < np.linalg.norm(z[1:80] - z[1:80].mean(0), axis=1).max()
    assert layout.layout(star, start.limit(0), ManifoldConfig()).collect() == []


def test_edges_are_due_by_weight():
    """With curve, rates and draws fixed, an edge of a tenth of the greatest weight is drawn in a tenth of the epochs."""
    seen = []

    class Draws:
        def integers(self, low, high, size):
            seen.append(size[0])
            return np.zeros(size, int)

    p = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    layout.move(p, np.array([0, 1]), np.array([1, 2]), np.array([1.0, 10.0]), p.copy(), np.arange(3), range(1, 101), 101, (1.5, 0.9), 5, Draws())
    assert sum(seen) == 100 + 10
