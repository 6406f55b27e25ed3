"""Edge cases of the profile operators on inline rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from profilia.config import BaselineConfig, ForecastConfig, PrepConfig
from profilia.functions import columns as C
from profilia.functions import series as S
from profilia.operators import anomaly, baseline, features, forecast, neighbors, preprocess
from profilia.sources import tables

SCHEMA = "well_name string, date string, oil double, water double, gas double, days_prod double"


def months(values, well="w", days=30.0):
    return [(well, f"{2020 + k // 12}-{k % 12 + 1:02d}-05", v if v is None else float(v), 1.0, 1.0, days) for k, v in enumerate(values)]


def raw(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_rates_missing_negative_and_fallback(spark):
    rows = [("a", "2024-01-03", None, 1.0, 1.0, 10.0), ("a", "2024-01-04", None, 1.0, 1.0, 10.0), ("a", "2024-02-04", -1.0, 2.0, 1.0, -3.0), (None, "2024-02-04", 1.0, 1.0, 1.0, 1.0), ("a", "bad", 1.0, 1.0, 1.0, 1.0)]
    got = {r["date"]: r for r in preprocess.monthly_rates(raw(spark, rows)).collect()}
    assert got[dt.date(2024, 1, 1)]["oil_sum"] == 0.0 and got[dt.date(2024, 1, 1)]["days_eff"] == 20.0
    feb = got[dt.date(2024, 2, 1)]
    assert (feb["oil_sum"], feb["valid_days"], feb["days_eff"]) == (0.0, 0, 59.0) and len(got) == 2
    calendar = preprocess.monthly_rates(raw(spark, rows), PrepConfig(days_mode="calendar")).where("date = '2024-02-01'").first()
    assert calendar["days_eff"] == 29.0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9])
def test_smoothing_keeps_quadratics_and_short_series(spark, n):
    y = [2.0 + 3 * k + 0.5 * k * k for k in range(n)]
    df = spark.createDataFrame([("w", k, v) for k, v in enumerate(y)], "w string, i int, y double")
    w = Window.partitionBy("w").orderBy("i")
    got = df.withColumn("n", F.count("*").over(Window.partitionBy("w"))).select("i", S.smoothed(F.col("y"), F.col("i"), F.col("n"), w).alias("s")).orderBy("i").collect()
    assert np.allclose([r["s"] for r in got], y)


def test_interpolation(spark):
    df = spark.createDataFrame([("w", k, v) for k, v in enumerate([None, 1.0, None, 3.0, None])], "w string, i int, y double")
    w = Window.partitionBy("w").orderBy("i")
    assert [r[0] for r in df.select(S.interpolated(F.col("y"), F.col("i"), w, Window.partitionBy("w").orderBy(F.desc("i"))), "i").orderBy("i").collect()] == [1, 1, 2, 3, 3]


def test_start_cut_and_reasons(spark):
    tail = [10, 9, 8, 7, 6, 5, 4, 3, 2, 2, 2, 2, 2, 2, 2]
    rows = months([0] * 7 + tail, "late") + months([0] * 20, "none") + months([5] * 11, "short") + months([5] * 12, "kept") + months([7] * 80, "long")
    p = preprocess.preprocess_profiles(raw(spark, rows))
    late = p.panel.where("well_name = 'late'").orderBy("t").collect()
    assert len(late) == 16 and late[0]["dr_oil_norm"] is not None and late[0]["t"] == 0
    assert {r["well_name"]: r["reason"] for r in p.dropped.collect()} == {"none": "no_start_detected", "short": "too_short(<12)"}
    assert {r["reason"]: r["count"] for r in p.dropped_summary.collect()} == {"no_start_detected": 1, "too_short(<12)": 1}
    assert [r["t"] for r in p.panel.where("well_name = 'long'").orderBy("t").collect()] == list(range(70))
    tensor = {r["well_name"]: r for r in p.tensor().collect()}
    assert len(tensor["kept"]["wc"]) == 70 and tensor["kept"]["wc"][12] is None and tensor["kept"]["r_oil_norm"][11] == pytest.approx(1.0)
    assert [tuple(r) for r in p.wells.orderBy("well_idx").collect()] == [("kept", 0), ("late", 1), ("long", 2)]


def test_empty_input(spark):
    p = preprocess.preprocess_profiles(raw(spark, []))
    assert p.panel.columns == preprocess.PANEL and p.panel.count() == 0 and p.dropped_summary.count() == 0


def panel(spark, values, well="w"):
    rows = [(well, t, float(v), float(v) / 10, 0.2, 0.5, None if t == 0 else 0.1 * t) for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "well_name string, t int, r_oil_s double, r_oil_norm double, wc double, gor double, dr_oil_norm double")


def test_feature_quirks(spark):
    ramp = features.compute_side_features(panel(spark, [1, 5, 10, 9, 8])).first()
    assert ramp["t_half"] == 0 and ramp["t_peak"] == 2 and ramp["plateau_len"] == 0 and ramp["mid_trend12"] is None
    tie = features.compute_side_features(panel(spark, [5, 9, 9, 1])).first()
    assert tie["t_peak"] == 1 and tie["t_20"] == 3 and tie["valid_ratio"] == pytest.approx(4 / 36)


def test_scaling_of_constant_column(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 1.0, None)], "well_name string, x double, y double")
    got = {r["well_name"]: (r["x"], r["y"]) for r in features.scale_features(df).collect()}
    assert got == {"a": (0.0, -1.0), "b": (0.0, 1.0), "c": (0.0, None)}


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="missing columns"):
        tables.canonical(spark.createDataFrame([("a",)], "well_name string"))


def test_knn_against_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5))
    v[7] = v[3]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id bigint, v array<double>")
    got = neighbors.knn(df, df, 4, "bigint").collect()
    for i in range(60):
        d = np.round(np.sqrt(((v - v[i]) ** 2).sum(1)), 9)
        d[i] = np.inf
        assert [r["j"] for r in sorted((r for r in got if r["i"] == i), key=lambda r: r["rank"])] == list(np.lexsort((np.arange(60), d))[:4])


def test_outlier_and_medoid(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (30, 2))
    pts = [*a, *b, np.array([20.0, 20.0])]
    rows = [(i, [float(x) for x in p], 0 if i < 30 else 1 if i < 60 else -1) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, label int")
    top = anomaly.top_anomalies(anomaly.anomaly_scores(df, 10), 1).first()
    assert top["id"] == 60
    none = anomaly.distance_to_medoid(df.withColumn("label", F.lit(-1)))
    assert none.where("dist is not null").count() == 0 and none.count() == 61


def test_forecast_duplicates_and_too_few(spark):
    cfg = ForecastConfig(T=6, T_pref=3, K=2)
    rows = [("a", t, float(v)) for t, v in enumerate([1, 2, 3, 4, 5, 6])] + [("b", t, float(v)) for t, v in enumerate([1, 2, 3, 9, 9, 9])] + [("c", t, float(v)) for t, v in enumerate([3, 2, 1, 4, 4, 4])]
    p = spark.createDataFrame(rows, "well_name string, t int, r_oil_s double")
    m = forecast.make_matrices(forecast.prefix_scaled(p, cfg), cfg)
    got = {(r["well_name"], r["t"]): r["y_pred"] for r in forecast.knn_forecast(m, cfg).collect()}
    s = (1 * 3 + 2 * 2 + 3 * 1) / 14  # only c is left for a: b lies at distance 0
    assert got["a", 3] == pytest.approx(4 * s) and len(got) == 9
    with pytest.raises(ValueError):
        forecast.knn_forecast(m.where("well_name <> 'a'"), cfg)


def test_baseline_runs(spark):
    rows = [("w", f"2020-{k:02d}-10", v, 0.0, 0.0, 1.0) for k, v in ((1, 0.0), (2, 9.0), (4, 9.0), (5, 9.0))]
    cfg = BaselineConfig(signal="bbl_mo", min_consec=2, horizon=3, clip_quantile=1.0)
    sig = baseline.interpolated_signal(baseline.monthly_signal(baseline.daily_signals(raw(spark, rows), cfg), cfg))
    assert [r["f"] for r in sig.orderBy("i").collect()] == [0, 9, 9, 9, 9]
    assert baseline.run_starts(sig, cfg).first()["start"] == 1
    z = baseline.zscored(baseline.wide_matrix(sig, baseline.run_starts(sig, cfg), cfg)).first()
    assert z["v"] == [0.0, 0.0, 0.0]


def test_names_and_cells(spark):
    df = spark.createDataFrame([(" a/b, c ", " <> ", "Records 5 to 9", ["x", "", " "])], "a string, b string, c string, d array<string>")
    r = df.select(C.slugify(F.col("a")), C.sanitize_filename(F.col("b")), C.record_count(F.col("c")), C.record_count(F.col("a")), C.trim_trailing_empty(F.col("d"))).first()
    assert tuple(r) == ("a_b_c", "file", 5, 300, ["x"])


def test_preamble_csv(spark, tmp_path):
    (tmp_path / "w.csv").write_text("﻿Well_Nm,County,,\nOne,X,,\n\nAPI_WellNo,RptDate,OIL,\n7,2020-01-01,3,\n8,2020-02-01,4,\n", encoding="utf-8")
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n3,4\n5,6\n")
    (tmp_path / "tiny.csv").write_text("a\n")
    got = sorted((r["row"]["API_WellNo"], r["row"]["OIL"], r["meta"]["Well_Nm"]) for r in tables.read_preamble_csv(spark, f"file://{tmp_path}").collect())
    assert got == [("7", "3", "One"), ("8", "4", "One")]


def test_rows_samples_and_names(spark):
    rows = raw(spark, months([1, -1, None, 2], "a") + months([3], "b") + months([4], "c"))
    assert preprocess.producing_rows(rows).count() == 4
    some = [{r["well_name"] for r in preprocess.sample_wells(rows, n, 7).collect()} for n in (1, 2, 2, 9)]
    assert [len(x) for x in some] == [1, 2, 2, 3] and some[0] < some[1] == some[2]
    signal = baseline.monthly_signal(baseline.daily_signals(raw(spark, [("w", "2024-01-03", 5.0, 0.0, 0.0, 1.0), ("w", "2024-03-03", 5.0, 0.0, 0.0, 1.0)])), BaselineConfig(signal="bbl_mo"))
    assert [r["s"] for r in baseline.filled_signal(signal).orderBy("date").collect()] == [5.0, 0.0, 5.0]
    odd = spark.createDataFrame([(None,), ("Records 3 to 9",), ("A/b",)], "x string")
    assert [tuple(r) for r in odd.select(C.group_dir_name(F.col("x")), C.well_file_name(F.col("x")), C.group_index(F.col("x"))).collect()] == [("file", "file.csv", None), ("records 3 - 9", "Records 3 to 9.csv", None), ("a b", "A b.csv", None)]


def test_csv_headers_may_differ(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "a.csv").write_text("API_WellNo,RptDate,BBLS_OIL_COND,MCF_GAS,BBLS_WTR,DAYS_PROD,Lease\nw1,2024-01-01,1,2,3,4,z\n")
    (tmp_path / "x" / "b.csv").write_text("RptDate,API_WellNo,MCF_GAS,BBLS_OIL_COND,BBLS_WTR\n2024-02-01,w2,5,6,7\nbad,w3,1,1,1\n")
    got = sorted((r["well_name"], r["oil"], r["gas"], r["water"], r["days_prod"]) for r in tables.read_production_csv(spark, f"file://{tmp_path}").collect())
    assert got == [("w1", 1.0, 2.0, 3.0, 4.0), ("w2", 6.0, 5.0, 7.0, None)]


def test_series_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    from profilia.operators import baseline, lineage, preprocess

    rows = spark.range(600).selectExpr("cast(id % 60 as string) as well_name", "date_add(date'2020-01-01', cast(id div 60 * 31 as int)) as date", "1.0 as oil", "1.0 as water", "1.0 as gas", "1.0 as days_prod")
    monkeypatch.setattr(lineage, "DEALT", 20)
    signal = baseline.interpolated_signal(baseline.monthly_signal(baseline.daily_signals(rows)))
    assert signal.rdd.getNumPartitions() == preprocess.smooth_rates(preprocess.monthly_rates(rows)).rdd.getNumPartitions() == 30
    assert signal.count() == 600


def test_forecast_has_no_row_for_a_neighbours_month(spark):
    """Medians as by numpy over each well's scaled neighbours, from arrays: neither a percentile over months nor a pivot is in the plan."""
    rng = np.random.default_rng(8)
    cfg = ForecastConfig(T=9, T_pref=4, K=4)
    y = {f"w{k:02d}": rng.uniform(0.5, 2.0, cfg.T) for k in range(25)}
    m = spark.createDataFrame([(w, [float(z) for z in v[: cfg.T_pref]], [float(z) for z in v]) for w, v in y.items()], "well_name string, x_pref array<double>, y_full array<double>")
    got = forecast.knn_forecast(m, cfg)
    long = forecast.forecast_long(m, forecast.knn_curves(m, cfg), cfg)
    wide = forecast.forecast_wide(long, cfg)
    for df, word in ((got, "percentile"), (got, "median"), (wide, "pivotfirst")):
        assert word not in df._jdf.queryExecution().toString().lower()
    pred = {}
    for w, v in y.items():
        near = sorted((round(float(np.linalg.norm(v[: cfg.T_pref] - u[: cfg.T_pref])), 9), x) for x, u in y.items())[1 : cfg.K + 1]
        heads = [(y[x][: cfg.T_pref], y[x][cfg.T_pref :]) for _, x in near]
        pred[w] = np.median([v[: cfg.T_pref] @ h / (h @ h + cfg.eps) * late for h, late in heads], axis=0)
    for r in got.collect():
        assert r["y_pred"] == pytest.approx(pred[r["well_name"]][r["t"] - cfg.T_pref], rel=1e-12)
    assert got.count() == 25 * 5 and long.count() == 25 * 9
    by_month = {(r["well_name"], r["t"]): r["y_pred"] for r in long.collect()}
    from_months = forecast.forecast_long(m, got, cfg)
    assert {(r["well_name"], r["t"]): r["y_pred"] for r in from_months.collect()} == by_month
    for r in wide.collect():
        assert [r[f"m{t}"] for t in range(cfg.T)] == [by_month[r["well_name"], t] for t in range(cfg.T)]
    odd = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 5.0), ("a", 1, None), ("a", 3, None), ("a", None, 7.0), ("a", 40, 1.0)], "well_name string, t int, y_pred double")
    assert [tuple(r) for r in forecast.forecast_wide(odd, ForecastConfig(T=4)).collect()] == [("a", None, 5.0, None, None)]
