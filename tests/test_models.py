"""Kernels and models against plain versions or invariants."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilia import report
from profilia.config import ManifoldConfig
from profilia.operators import clusters, dtw, kmeans, layout, models, neighbors
from profilia.plans import queries
from profilia.streaming import monthly


def slow_dtw(a, b):
    n, m = len(a), len(b)
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    for i, j in itertools.product(range(n), range(m)):
        d[i + 1, j + 1] = np.linalg.norm(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[n, m]


def test_dtw():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (1, 5), (6, 6), (9, 4)):
        a, b = rng.normal(size=(n, 2)), rng.normal(size=(m, 2))
        assert dtw.dtw(a, b) == pytest.approx(slow_dtw(a, b)) == pytest.approx(dtw.dtw(b, a))
    assert dtw.dtw(a, a) == 0 and dtw.dtw(a[:0], a) == float("inf")
    assert dtw.frames([[1.0, None, 2.0], [None, None, 3.0]], (0.5, 1.0)).tolist() == [[0.5, 0.0], [1.0, 3.0]]


def test_pairs_together_equal_pairs_alone(monkeypatch):
    rng = np.random.default_rng(5)
    xs, ys = ([rng.normal(size=(int(n), 2)) for n in rng.integers(0, 9, 60)] for _ in range(2))
    monkeypatch.setattr(dtw, "TOGETHER", 7)
    assert dtw.dtw_all(xs, ys) == [dtw.dtw(x, y) for x, y in zip(xs, ys, strict=True)]


def test_refine_checks_channels(spark):
    p = spark.createDataFrame([("a", [1.0], [1.0])], "well_name string, r_oil_norm array<double>, wc array<double>")
    e = spark.createDataFrame([], "i string, j string, d double")
    with pytest.raises(ValueError):
        dtw.refine(e, p, ManifoldConfig(channels=("nope",), channel_weights=(1.0,)))
    with pytest.raises(ValueError):
        dtw.refine(e, p, ManifoldConfig(channel_weights=(1.0,)))
    assert dtw.refine(e, p).count() == 0


def test_refined_neighbors(spark):
    """Against all pairs: refined ones at warped distances, the others at plain ones."""
    rng = np.random.default_rng(4)
    x = {f"w{i:02d}": rng.normal(size=(2, 6)) * (1 + i % 4) for i in range(30)}
    cfg = ManifoldConfig(k_refine=4, n_neighbors=6)
    points = spark.createDataFrame([(k, [float(z) for z in v.ravel()]) for k, v in x.items()], "id string, v array<double>")
    wells = spark.createDataFrame([(k, *[[float(z) for z in c] for c in v]) for k, v in x.items()], "well_name string, r_oil_norm array<double>, wc array<double>")
    d = {(a, b): round(float(np.linalg.norm(x[a] - x[b])), 9) for a in x for b in x if a != b}
    near = {a: sorted((d[a, b], b) for b in x if b != a)[:4] for a in x}
    for a, b in {(min(a, b), max(a, b)) for a in x for _, b in near[a]}:
        d[a, b] = d[b, a] = slow_dtw(*(dtw.frames(x[k], cfg.channel_weights) for k in (a, b)))
    want = {a: [b for _, b in sorted((d[a, b], b) for b in x if b != a)[:6]] for a in x}
    got = {}
    for r in dtw.refined_neighbors(points, wells, cfg).orderBy("i", "d", "j").collect():
        got.setdefault(r["i"], []).append(r["j"])
        assert r["d"] == pytest.approx(d[r["i"], r["j"]])
    assert got == want


def test_map_queries_use_the_settings(spark, monkeypatch):
    ks, settings = [], []
    monkeypatch.setattr(queries, "_profiles", lambda *a: type("P", (), {"tensor": lambda s: spark.createDataFrame([], "well_name string, r_oil_norm array<double>, wc array<double>")})())
    monkeypatch.setattr(queries.tables, "embeddings", lambda *a: None)
    monkeypatch.setattr(queries.neighbors, "knn", lambda a, b, k, *t: ks.append(k))
    monkeypatch.setattr(queries.dtw, "refine", lambda *a: None)
    monkeypatch.setattr(queries.layout, "manifold_map", lambda n, p, cfg: settings.append(cfg))
    queries.dtw_refined_edges(spark, "")
    queries.umap_map(spark, "")
    assert ks == [40, 30] and settings == [ManifoldConfig()] and settings[0].epochs is None


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    pts = [*rng.normal(0, 0.2, (40, 3)), *rng.normal(6, 0.2, (40, 3)), np.full(3, 40.0)]
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id long, v array<double>").cache()


def test_isolation(blobs):
    s = models.flag_outliers(models.isolation_scores(blobs, trees=30), 0.02)
    assert s.orderBy(F.desc("score")).first()["id"] == 80 and s.count() == 81


def test_clusterings_find_blobs(blobs):
    two = blobs.where("id < 80")
    for found in (kmeans.kmeans_auto(two, range(2, 4), runs=1)[0], clusters.gmm_bic(two, range(2, 4))[0].select("id", "cluster")):
        by = {r["id"]: r["cluster"] for r in found.collect()}
        assert by[0] == by[39] != by[40] == by[79]


def test_queries_search_the_whole_range(spark, monkeypatch):
    """The registered queries pass the reference's ranges, starts and trees."""
    seen = {}

    def note(name, out):
        return lambda df, *a, **k: (seen.update({name: (a, k)}), out)[1]

    monkeypatch.setattr(kmeans, "kmeans_auto", note("kmeans", (None, {})))
    monkeypatch.setattr(clusters, "gmm_bic", note("gmm", (None, {})))
    monkeypatch.setattr(clusters, "pca_map", lambda df: (spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double"), []))
    monkeypatch.setattr(models, "isolation_scores", note("forest", None))
    monkeypatch.setattr(models, "flag_outliers", lambda s: s)
    monkeypatch.setattr(queries.tables, "embeddings", lambda *a: None)
    for f in (queries.kmeans_auto, queries.gmm_bic, queries.isolation_forest):
        f(spark, "")
    assert seen == {"kmeans": ((range(2, 13),), {"runs": 25}), "gmm": ((range(2, 11),), {}), "forest": ((), {"trees": 300})}


def test_kmeans_finds_seven_blobs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(20 * b + i, [float(x) for x in rng.normal(0, 0.1, 2) + (10 * (b % 3), 10 * (b // 3))]) for b in range(7) for i in range(20)]
    monkeypatch.setattr(queries.tables, "embeddings", lambda *a: spark.createDataFrame(rows, "id long, v array<double>").coalesce(1).cache())
    whole = kmeans.kmeans_auto
    monkeypatch.setattr(kmeans, "kmeans_auto", lambda df, ks, runs: whole(df, ks, runs=min(runs, 3)))  # fewer starts, for time
    assert queries.kmeans_auto(spark, "").select("cluster").distinct().count() == 7


def test_pca_and_layout(blobs):
    two = blobs.where("id < 80")
    start, share = clusters.pca_map(two)
    assert 0.9 < share[0] <= 1
    graph = layout.fuzzy_graph(neighbors.knn(two, two, 8, "bigint"), 8).cache()
    w = {(r["i"], r["j"]): r["w"] for r in graph.collect()}
    assert all(w[j, i] == pytest.approx(x) and 0 <= x <= 1 for (i, j), x in w.items())
    a, b = (layout.layout(graph, start, ManifoldConfig(epochs=3)).orderBy("id").collect() for _ in range(2))
    assert [r["id"] for r in a] == list(range(80)) and np.allclose([r["x"] for r in a], [r["x"] for r in b])


def test_stream(spark, tmp_path):
    rows = spark.sql("SELECT 'w' AS well_name, timestamp'2024-01-05 10:00:00' AS date, 2.0D AS oil, -1.0D AS water, 1.0D AS gas, 1.0D AS days_prod UNION ALL SELECT 'w', timestamp'2024-01-25 12:00:00', 3.0D, 1.0D, 1.0D, 1.0D")
    rows.write.parquet(f"{tmp_path}/in")
    q = monthly.monthly_sums(monthly.arriving_files(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("monthly_t").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(str(r["date"]), r["oil"], r["water"], r["days_prod"], r["r_oil"]) for r in spark.table("monthly_t").collect()] == [("2024-01-01", 5.0, 1.0, 2.0, 2.5)]


def test_report(spark, tmp_path):
    m = spark.createDataFrame([(f"<w{i}>", float(i), 1.0, i % 2 - 1, i / 20) for i in range(20)], "well_name string, x double, y double, cluster int, anomaly_score double")
    data = report.map_data(m)
    assert data.where("anomalous").count() == 1
    page = report.html_report("R & D", [("Map", report.scatter_svg(data)), ("Sizes", report.bars_svg(report.cluster_sizes(m))), ("Rows", report.table_html(m))])
    assert "R &amp; D" in page and "&lt;w3&gt;" in page and page.count("<circle") == 20
    report.export_csv_summaries(m, clusters.summarize_clusters(m.withColumn("prob", F.lit(1.0))), f"file://{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out/cluster_summary").count() == 2


def test_forecast_exports_and_lines(spark, tmp_path):
    long = spark.createDataFrame([("a", t, 1.0, 1.0 + t, "observed" if t < 1 else "forecast") for t in range(3)], "well_name string, t int, y_true double, y_pred double, segment string")
    metrics = spark.createDataFrame([(1.0, 0.5, 3)], "rmse double, smape double, n_eval long")
    report.export_forecasts({"knn": long}, {"knn": metrics, "net": metrics}, f"file://{tmp_path}/f")
    read = lambda n: spark.read.option("header", True).csv(f"file://{tmp_path}/f/{n}")
    assert read("pred_knn").columns == ["well_name", "m2", "m3"] and read("metrics").count() == 2
    report.export_matrix(spark.createDataFrame([("b", [1.0, None]), ("a", [2.0, 3.0])], "well_name string, x array<double>"), "x", f"file://{tmp_path}/m")
    assert {r["well_name"]: r["row"] for r in spark.read.parquet(f"file://{tmp_path}/m").collect()} == {"a": [2.0, 3.0], "b": [1.0, None]}
    band = spark.createDataFrame([("<c>", t, 1.0 * t, 0.5 * t, 2.0 * t) for t in range(4)], "name string, t int, y double, low double, high double")
    svg = report.lines_svg(band)
    assert svg.count("<polyline") == svg.count("<polygon") == 1 and "&lt;c&gt;" in svg and "<polyline" not in report.lines_svg(band.limit(0))
