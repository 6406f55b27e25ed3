"""Exact quantiles by narrowing histograms; chart data; file names, gathering and flattening."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilia import report
from profilia.functions import columns as C
from profilia.operators import features, models, preprocess, quantiles


@pytest.mark.parametrize("bins", [50])
def test_quantiles_equal_percentile(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = np.random.default_rng(1)
    n = 400
    data = {
        "ties": rng.integers(0, 4, n).astype(float),
        "wide": np.sign(rng.normal(size=n)) * 10.0 ** rng.uniform(-20, 20, n),
        "near": 1.0 + rng.integers(0, 5, n) * 2.0**-52,
        "same": np.full(n, -2.5),
        "normal": rng.normal(size=n),
    }
    rows = [tuple(None if c == "normal" and i % 5 == 0 else float("nan") if c == "ties" and i % 50 == 3 else float(v[i]) for c, v in data.items()) + (None,) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data) + ", `no.ne` double").repartition(3).cache()
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = quantiles.exact_quantiles(df, [*data, "no.ne"], qs)
    whole = df.withColumn("ties", F.when(~F.isnan("ties"), F.col("ties")))
    want = whole.agg(*[F.percentile(c, F.array(*map(F.lit, qs))).alias(c) for c in data]).first()
    assert all(got[c] == want[c] for c in data if c != "wide") and got["no.ne"] == [None] * 7
    assert got["wide"] == pytest.approx(want["wide"], rel=1e-12)
    assert quantiles.exact_quantiles(df.limit(0), ["ties"], [0.5]) == {"ties": [None]}
    df.unpersist()


def test_scaling_and_flags_by_quantiles(spark):
    f = spark.createDataFrame([(f"w{i}", float(i), 7.0, None) for i in range(9)], "well_name string, a double, b double, c double")
    got = {r["well_name"]: r for r in features.scale_features(f).collect()}
    assert got["w4"]["a"] == 0 and got["w8"]["a"] == 1.0 and got["w3"]["b"] == 0 and got["w3"]["c"] is None
    flagged = models.flag_outliers(spark.createDataFrame([(i, float(i)) for i in range(101)], "id long, score double"), 0.05)
    assert sorted(r["id"] for r in flagged.where("outlier").collect()) == [96, 97, 98, 99, 100]


def test_charts_say_what_they_leave_out(spark, monkeypatch):
    monkeypatch.setattr(report, "LINES", 3)
    rows = spark.createDataFrame([(f"n{k}", t, float(k + t)) for k in range(5) for t in range(4)], "name string, t int, y double")
    svg = report.lines_svg(rows)
    assert svg.count("<polyline") == 3 and "3 of 5 lines" in svg and "of" not in report.lines_svg(rows.where("name < 'n3'"))
    m = spark.createDataFrame([(f"w{i}", float(i), 1.0, i % 2, i / 20) for i in range(20)], "well_name string, x double, y double, cluster int, anomaly_score double")
    data = report.map_data(m, medoids=m.where("well_name in ('w4', 'w7')").select("well_name"))
    assert data.where("medoid").count() == 2 and data.count() == 20
    svg = report.scatter_svg(data)
    assert svg.count("<circle") == 20 and ">0</text>" in svg and ">1</text>" in svg
    monkeypatch.setattr(report, "POINTS", 6)
    svg = report.scatter_svg(data)
    assert svg.count("<circle") == 6 and "6 of 20 points" in svg and svg.count("font-size=\"12\"") == 2


def test_chart_data(spark):
    panel = spark.createDataFrame([(f"w{k}", t, float(k * 10 + t)) for k in range(6) for t in range(3)], "well_name string, t int, q double")
    labels = spark.createDataFrame([(f"w{k}", k % 2 if k < 5 else -1) for k in range(6)], "well_name string, cluster int")
    lines = {(r["name"], r["t"]): r for r in report.prototype_lines(panel, labels, "q", 3).collect()}
    assert set(lines) == {(f"cluster {c}", t) for c in (0, 1) for t in range(3)} and (lines["cluster 0", 1]["y"], lines["cluster 0", 1]["low"], lines["cluster 0", 1]["high"]) == (21.0, 11.0, 31.0)
    mean = {(r["name"], r["t"]): r["y"] for r in report.mean_lines(panel, labels, "q", 3).collect()}
    assert mean["cluster 1", 0] == 20.0 and mean["cluster -1", 2] == 52.0
    long = spark.createDataFrame([(f"w{k}", t, 1.0 if t < 2 else None, 2.0) for k in range(9) for t in range(3)], "well_name string, t int, y_true double, y_pred_knn double")
    got = report.forecast_lines(long, {"knn": "y_pred_knn"}, wells=2)
    assert {r["name"] for r in got.collect()} == {"w0 truth", "w0 knn", "w1 truth", "w1 knn"} and got.count() == 10
    assert report.lines_svg(got).count("<polyline") == 4


def test_names_gathering_and_vectors(spark):
    maps = spark.createDataFrame([({"Well_Nm": " a/b c", "Well_Type": None, "Field": "F, 1"},), ({},)], "m map<string,string>")
    assert [r[0] for r in maps.select(C.metadata_file_name(F.col("m"))).collect()] == ["a_b_c_unknown_unknown_unknown_F_1", "unknown_unknown_unknown_unknown_unknown"]
    wells = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "well_name string, well_idx long")
    at = spark.createDataFrame([(0, 2), (1, 0), (2, 2), (3, 9), (4, None)], "place int, well_idx long")
    assert [(r["place"], r["well_name"]) for r in preprocess.gathered(wells, at).orderBy("place").collect()] == [(0, "c"), (1, "a"), (2, "c"), (3, None), (4, None)]
    x = spark.createDataFrame([([1.0, None], [float("nan"), float("inf")])], "a array<double>, b array<double>")
    assert x.select(C.flatten_channels("a", "b")).first()[0] == [1.0, 0.0, 0.0, 0.0]
