"""Warping in bands against the exact distance."""

import numpy as np
import pytest

from profilia.config import ManifoldConfig
from profilia.operators import dtw, warping


def test_never_below_exact_and_equal_when_covered():
    rng = np.random.default_rng(12)
    gaps = {r: [] for r in (1, 6, 12)}
    for n, m in ((1, 1), (1, 9), (2, 3), (8, 8), (33, 20), (70, 70), (71, 64), (90, 41)):
        for _ in range(4):
            a, b = rng.normal(size=(n, 2)).cumsum(0), rng.normal(size=(m, 2)).cumsum(0)
            exact = dtw.dtw(a, b)
            assert warping.refined_dtw(a, b, max(n, m)) == pytest.approx(exact, rel=1e-12)
            for r, found in gaps.items():
                d = warping.refined_dtw(a, b, r)
                assert d >= exact - 1e-9
                found.append(d / max(exact, 1e-9))
    assert np.mean(gaps[12]) <= np.mean(gaps[6]) + 1e-9 <= np.mean(gaps[1]) + 2e-9 and np.mean(gaps[6]) < 1.05
    assert warping.refined_dtw(a, a, 3) == 0 and warping.refined_dtw(a[:0], a, 3) == float("inf")
    with pytest.raises(ValueError):
        warping.refined_dtw(a, b, -1)


def test_paths_are_paths():
    rng = np.random.default_rng(13)
    a, b = rng.normal(size=(57, 1)).cumsum(0), rng.normal(size=(83, 1)).cumsum(0)
    d, first, last = warping.refined_path(a, b, 4)
    assert first[0] == 0 and last[-1] == 82 and (first <= last).all() and ((first[1:] - last[:-1] == 0) | (first[1:] - last[:-1] == 1)).all()
    assert sum(np.abs(b[j] - a[i])[0] for i in range(57) for j in range(first[i], last[i] + 1)) == pytest.approx(d)


def test_bands_stay_narrow():
    rng = np.random.default_rng(14)
    cells = []
    for n in (1000, 4000):
        a, b = rng.normal(size=(n, 2)).cumsum(0), rng.normal(size=(n, 2)).cumsum(0)
        _, first, last = warping.refined_path(warping._halved(a), warping._halved(b), 3)
        lo, hi = warping.band_around(first, last, n, n, 3)
        assert (hi > lo).all() and lo[0] == 0 and hi[-1] == n and (lo[1:] <= hi[:-1]).all()
        cells.append((hi - lo).sum() / n)
    assert max(cells) < 40


def test_refine_reads_radius(spark):
    rng = np.random.default_rng(15)
    x = {f"w{i}": [[float(z) for z in c] for c in rng.normal(size=(2, 60)).cumsum(1)] for i in range(4)}
    x["w3"][0][5] = x["w3"][1][5] = None
    wells = spark.createDataFrame([(k, *v) for k, v in x.items()], "well_name string, r_oil_norm array<double>, wc array<double>")
    edges = spark.createDataFrame([(a, b, 1.0) for a in x for b in x if a != b], "i string, j string, d double")
    got = {}
    for cfg in (ManifoldConfig(), ManifoldConfig(warp="refined", radius=1), ManifoldConfig(warp="refined", radius=60)):
        got[cfg.warp, cfg.radius] = np.array([r["d_dtw"] for r in dtw.refine(edges, wells, cfg).orderBy("a", "b").collect()])
        plain = [warping.refined_dtw(dtw.frames(x[a], (0.7, 0.3)), dtw.frames(x[b], (0.7, 0.3)), cfg.radius) for a in sorted(x) for b in sorted(x) if a < b]
        assert cfg.warp == "exact" or np.allclose(got[cfg.warp, cfg.radius], plain)
    assert np.allclose(got["exact", 6], got["refined", 60]) and (got["refined", 1] >= got["exact", 6] - 1e-9).all()
    with pytest.raises(ValueError, match="warping"):
        dtw.refine(edges, wells, ManifoldConfig(warp="?"))
