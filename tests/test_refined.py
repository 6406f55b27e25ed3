"""Neighbours beside refined ones: hubs, which many wells are near to, need no deep search of all wells."""

import numpy as np
import pytest
from test_models import slow_dtw

from profilia.config import ManifoldConfig
from profilia.operators import dtw, neighbors


def test_hubs_are_searched_for_alone(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = {f'w{i:02d}"\n': (rng.normal(size=(2, 6)) * 0.01 if i < 2 else (v := rng.normal(size=(2, 6))) / np.linalg.norm(v)) for i in range(60)}
    cfg = ManifoldConfig(k_refine=3, n_neighbors=4)
    points = spark.createDataFrame([(k, [float(z) for z in v.ravel()]) for k, v in x.items()], "id string, v array<double>").cache()
    wells = spark.createDataFrame([(k, *[[float(z) for z in c] for c in v]) for k, v in x.items()], "well_name string, r_oil_norm array<double>, wc array<double>")
    d = {(a, b): round(float(np.linalg.norm(x[a] - x[b])), 9) for a in x for b in x if a != b}
    near = {a: sorted((d[a, b], b) for b in x if b != a)[:3] for a in x}
    pairs = {(min(a, b), max(a, b)) for a in x for _, b in near[a]}
    hub = max(sum(a in p for p in pairs) for a in x)
    for a, b in pairs:
        d[a, b] = d[b, a] = slow_dtw(*(dtw.frames(x[k], cfg.channel_weights) for k in (a, b)))
    want = {a: [b for _, b in sorted((d[a, b], b) for b in x if b != a)[:4]] for a in x}
    depths, asked = [], []
    monkeypatch.setattr(dtw, "knn", lambda q, v, k, *t: depths.append(k) or neighbors.knn(q, v, k, *t))
    monkeypatch.setattr(dtw, "knn_beside", lambda q, *t: asked.extend(r["id"] for r in q.collect()) or neighbors.knn_beside(q, *t))
    got = {}
    for r in dtw.refined_neighbors(points, wells, cfg).orderBy("i", "d", "j").collect():
        got.setdefault(r["i"], []).append(r["j"])
        assert r["d"] == pytest.approx(d[r["i"], r["j"]])
    assert got == want
    assert hub > 20 and depths == [3 + 2 * 4] and 0 < len(asked) < 20
