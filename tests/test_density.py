"""Density clusters, their validity and barycentres against plain versions."""

import itertools

import numpy as np
import pytest

from plain_tree import condensed
from profilia.config import ClusterConfig
from profilia.operators import barycenter, density, dendrogram


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(0)
    return np.array([*rng.normal(0, 0.3, (30, 2)), *rng.normal(5, 0.5, (35, 2)), *rng.uniform(-8, 14, (8, 2)), (5.0, 5.0), (5.0, 5.0)])


@pytest.fixture(scope="module")
def table(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, v array<double>").cache()


def plain_tree(d):
    """Prim over a full matrix: the weights of a least spanning tree."""
    inside, best, out = {0}, d[0].copy(), []
    while len(inside) < len(d):
        k = min((i for i in range(len(d)) if i not in inside), key=lambda i: best[i])
        out.append(best[k])
        inside.add(k)
        best = np.minimum(best, d[k])
    return sorted(out)


def test_tree_and_clusters(spark, points, table):
    d = np.round(np.sqrt(((points[:, None] - points[None]) ** 2).sum(2)), 9)
    core = np.sort(d, axis=1)[:, 5]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    np.fill_diagonal(reach, np.inf)
    cores = spark.createDataFrame([(i, float(c)) for i, c in enumerate(core)], "id long, core double")
    tree = density.spanning_tree(table.join(cores, "id")).collect()
    assert len(tree) == len(points) - 1 and np.allclose(sorted(r["w"] for r in tree), plain_tree(reach))
    got = {r["id"]: (r["cluster"], r["prob"]) for r in density.hdbscan_clusters(table, ClusterConfig(min_cluster_size=12, min_samples=5)).collect()}
    assert set(got) == set(range(len(points))) and all(0 <= p <= 1 and (c >= 0 or p == 0) for c, p in got.values())
    assert len({got[i][0] for i in range(30)}) == 1 and len({got[i][0] for i in range(30, 65)}) == 1 and got[0][0] != got[30][0] and min(got[0][0], got[30][0]) >= 0
    assert density.hdbscan_clusters(table.limit(0)).count() == 0
    assert {r["cluster"] for r in density.hdbscan_clusters(table.limit(20)).collect()} == {-1}


def test_condensed_by_hand():
    """Two chains of three joined by a long edge; a far point leaves first."""
    a, b, w = [0, 1, 3, 4, 2, 5], [1, 2, 4, 5, 3, 6], np.array([1.0, 1.0, 1.0, 2.0, 10.0, 50.0])
    got = condensed(a, b, w, 3)
    assert got[6] == (-1, 0.0) and {got[i][0] for i in (0, 1, 2)} != {got[i][0] for i in (3, 4, 5)}
    assert got[0][1] == 1.0 and got[3][1] == 1.0 and got[5][1] == 1.0  # a part too small to split leaves as a whole


def random_tree(rng, n, kind):
    """(a, b, w): each vertex hangs on an earlier one; weights with ties, in clumps, or growing along one long chain."""
    rows = []
    for v in range(1, n):
        u = int(rng.integers(0, v)) if kind != "chain" else v - 1
        w = {"ties": float(rng.integers(0, 5)), "clumps": float(rng.exponential() if (v % 40) else 20 + rng.exponential()), "chain": v / 7 if v % 50 else 100.0 + v}[kind]
        rows.append((u, v, w) if rng.random() < 0.5 else (v, u, w))
    return rows


def groups(labels):
    out = {}
    for i, c in labels.items():
        out.setdefault(c, set()).add(i)
    return sorted(map(sorted, (g for c, g in out.items() if c >= 0)))


@pytest.mark.parametrize("kind,n,size,single,epsilon", [("clumps", 260, 8, False, 0.0), ("ties", 150, 3, True, 0.0), ("chain", 200, 6, False, 60.0), ("clumps", 160, 5, False, 0.8)])
def test_tree_labels_equal_the_plain_ones(spark, kind, n, size, single, epsilon):
    rows = random_tree(np.random.default_rng(n), n, kind)
    want = condensed([a for a, _, _ in rows], [b for _, b, _ in rows], np.array([w for _, _, w in rows]), size, single, epsilon)
    cfg = ClusterConfig(min_cluster_size=size, allow_single_cluster=single, cluster_selection_epsilon=epsilon)
    got = {r["id"]: r for r in dendrogram.tree_labels(spark.createDataFrame(rows, "a long, b long, w double").repartition(3), cfg).collect()}
    assert set(got) == set(range(n))
    assert groups({i: r["cluster"] for i, r in got.items()}) == groups({i: c for i, (c, _) in want.items()}) and groups({i: c for i, (c, _) in want.items()})
    assert all(got[i]["prob"] == pytest.approx(p) for i, (_, p) in want.items())
    names = {r["cluster"] for r in got.values()} - {-1}
    assert names == set(range(len(names)))


def test_dendrogram_parents_and_sizes(spark):
    """Against merging edge by edge."""
    n, rng = 120, np.random.default_rng(9)
    rows = sorted(random_tree(rng, n, "clumps"), key=lambda r: r[2])
    top, count, want, parent = {}, {}, {}, {}
    part = list(range(n))
    for e, (a, b, _) in enumerate(rows):
        x, y = part[a], part[b]
        want[e] = sum(part[v] in (x, y) for v in range(n))
        for s in (x, y):
            if s in top:
                parent[top.pop(s)] = e
        part = [x if p == y else p for p in part]
        top[x] = e
    tree, first = dendrogram.dendrogram(spark.createDataFrame([(e, f"v{a}", f"v{b}") for e, (a, b, _) in enumerate(rows)], "e long, a string, b string"))
    got = {r["e"]: (r["par"], r["size"]) for r in tree.collect()}
    assert got == {e: (parent.get(e), want[e]) for e in range(n - 1)}
    assert {r["x"]: r["e"] for r in first.collect()} == {f"v{v}": min(e for e, (a, b, _) in enumerate(rows) if v in (a, b)) for v in range(n)}
    with pytest.raises(ValueError):
        dendrogram.tree_labels(tree, ClusterConfig(min_cluster_size=1))
    assert dendrogram.tree_labels(spark.createDataFrame([], "a string, b string, w double")).collect() == []


def test_validity(spark, points, table):
    labels = [0] * 30 + [1] * 35 + [-1] * 8 + [1, 1]
    rows = spark.createDataFrame(list(enumerate(labels)), "id long, label int")
    got = {r["label"]: r for r in density.validity_index(table.join(rows, "id")).collect()}
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    labels, sparse, inner, core = np.array(labels), {}, {}, np.zeros(len(points))
    for g in (0, 1):
        at = np.flatnonzero(labels == g)
        for i in at:
            o = np.array([d[i, j] for j in at if d[i, j] > 0])
            core[i] = ((1 / o**2).sum() / (len(at) - 1)) ** -0.5
        m = np.maximum(d[np.ix_(at, at)], np.maximum(core[at][:, None], core[at][None]))
        done, edges = {0}, []
        while len(done) < len(at):
            x, i, j = min((m[i, j], i, j) for i in done for j in range(len(at)) if j not in done)
            done.add(j)
            edges.append((x, i, j))
        deg = np.bincount([k for _, i, j in edges for k in (i, j)], minlength=len(at))
        sparse[g] = max(x for x, i, j in edges if deg[i] > 1 and deg[j] > 1)
        inner[g] = at[deg > 1]
    apart = min(max(d[i, j], core[i], core[j]) for i, j in itertools.product(inner[0], inner[1]))
    want = {g: (apart - sparse[g]) / max(apart, sparse[g]) for g in (0, 1)}
    assert {g: got[g]["validity"] for g in got} == pytest.approx(want, rel=1e-6)
    assert got[0]["dbcv"] == pytest.approx(sum(want[g] * (labels == g).sum() for g in want) / len(points), rel=1e-6)


def test_soft_dtw_gradient():
    rng = np.random.default_rng(2)
    z, y = rng.normal(size=5), rng.normal(size=(3, 6))
    value, g = barycenter.soft_dtw(z, y, 0.7)
    for k in range(5):
        e = np.eye(5)[k] * 1e-6
        up, down = barycenter.soft_dtw(z + e, y, 0.7)[0], barycenter.soft_dtw(z - e, y, 0.7)[0]
        assert np.allclose((up - down) / 2e-6, g[:, k], atol=1e-5)


def test_barycenters(spark):
    t = np.arange(12)
    rows = [(f"w{i}", [float(x) for x in np.exp(-((t - 4 - i % 3) ** 2) / 4)]) for i in range(6)] + [("n", [9.0] * 12)]
    p = spark.createDataFrame(rows, "well_name string, oil array<double>")
    labels = spark.createDataFrame([(f"w{i}", 0) for i in range(6)] + [("n", -1)], "well_name string, cluster int")
    got = barycenter.barycenters(p, labels, "oil", T=12, gamma=0.1, rounds=8).orderBy("t").collect()
    z, y = np.array([r["value"] for r in got]), np.array([r[1] for r in rows[:6]])
    assert len(z) == 12 and barycenter.soft_dtw(z, y, 0.1)[0].sum() < barycenter.soft_dtw(y.mean(0), y, 0.1)[0].sum()
    assert barycenter.barycenters(p, labels.limit(0), "oil", T=12).count() == 0


def plain_path(z, y):
    """The warping path of least summed squares by a table of steps; ties go diagonal, then along z."""
    r = np.full((len(z) + 1, len(y) + 1), np.inf)
    r[0, 0] = 0
    for i, j in itertools.product(range(len(z)), range(len(y))):
        r[i + 1, j + 1] = (z[i] - y[j]) ** 2 + min(r[i, j], r[i, j + 1], r[i + 1, j])
    i, j, path = len(z), len(y), []
    while i and j:
        path.append((i - 1, j - 1))
        _, _, i, j = min((r[i - 1, j - 1], 0, i - 1, j - 1), (r[i - 1, j], 1, i - 1, j), (r[i, j - 1], 2, i, j - 1))
    return r[-1, -1], path


def plain_dba(members, rounds, tol=1e-5):
    z, cost = members.mean(0), np.inf
    for _ in range(rounds):
        found = [plain_path(z, y) for y in members]
        mean = sum(c for c, _ in found) / len(members)
        stop = cost - mean <= tol
        if mean <= cost:
            at = [[y[j] for (_, path), y in zip(found, members, strict=True) for i, j in path if i == k] for k in range(len(z))]
            z, cost = np.array([np.mean(v) for v in at]), mean
        if stop:
            break
    return z


def test_dtw_align_is_the_best_path():
    rng = np.random.default_rng(5)
    z, y = rng.normal(size=7), np.concatenate((rng.normal(size=(20, 9)), np.zeros((1, 9))))
    value, total, count = barycenter.dtw_align(z, y)
    for k, row in enumerate(y):
        cost, path = plain_path(z, row)
        assert value[k] == pytest.approx(cost) and total[k] == pytest.approx([sum(row[j] for i, j in path if i == p) for p in range(7)])
        assert count[k].tolist() == [sum(i == p for i, _ in path) for p in range(7)]


@pytest.fixture(scope="module")
def bumps(spark):
    t = np.arange(16)
    curve = lambda at: np.exp(-((t - at) ** 2) / 3)
    rows = [(f"w{i}", [float(x) for x in curve(4 + i % 6)], [float(x) for x in np.cumsum(curve(9 - i % 4))]) for i in range(24)] + [("one", [1.0, None] * 8, [0.5] * 16), ("noise", [9.0] * 16, [9.0] * 16)]
    p = spark.createDataFrame(rows, "well_name string, oil array<double>, wc array<double>").repartition(5).cache()
    labels = spark.createDataFrame([(f"w{i}", i % 2) for i in range(24)] + [("one", 7), ("noise", -1), ("gone", 3), ("w1", None)], "well_name string, cluster int")
    return p, labels, rows


def curves_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["t"]):
        out.setdefault((r["cluster"], r["channel"]), []).append(r["value"])
    return out


def test_dba_equals_plain_averaging_and_beats_the_mean(bumps):
    p, labels, rows = bumps
    got = curves_of(barycenter.prototypes(p, labels, ["oil", "wc"], T=14, method="dba", rounds=10))
    assert set(got) == {(c, n) for c in (0, 1, 7) for n in ("oil", "wc")}
    for c, (at, name) in itertools.product((0, 1), ((1, "oil"), (2, "wc"))):
        members = np.array([r[at][:14] for i, r in enumerate(rows[:24]) if i % 2 == c])
        assert got[c, name] == pytest.approx(plain_dba(members, 10), abs=1e-9)
        cost = lambda z, members=members: sum(plain_path(z, y)[0] for y in members)
        assert cost(np.array(got[c, name])) < 0.5 * cost(members.mean(0))
    assert got[7, "oil"] == [1.0, 0.0] * 7 and got[7, "wc"] == [0.5] * 14


def test_prototypes_by_method(bumps, monkeypatch):
    p, labels, rows = bumps
    with pytest.raises(ValueError):
        barycenter.prototypes(p, labels, ["oil"], method="mean")
    median = curves_of(barycenter.prototypes(p, labels, ["oil"], method="median"))
    assert median[0, "oil"] == pytest.approx(np.median([r[1] for r in rows[:24:2]], axis=0)) and median[7, "oil"][1] is None
    soft = curves_of(barycenter.prototypes(p, labels, ["oil", "wc"], T=16, gamma=0.1, rounds=3))
    assert soft[1, "wc"] == pytest.approx(curves_of(barycenter.prototypes(p, labels, ["wc"], T=16, method="softdtw", gamma=0.1, rounds=3))[1, "wc"])
    whole = barycenter._soft
    monkeypatch.setattr(barycenter, "_soft", lambda rows, c, *a: whole(rows, c, *a) | {(1, "oil"): np.full(16, np.nan)})
    fallen = curves_of(barycenter.prototypes(p, labels, ["oil", "wc"], T=16, gamma=0.1, rounds=3))
    assert fallen[1, "oil"] == pytest.approx(median[1, "oil"]) and fallen[0, "oil"] == pytest.approx(soft[0, "oil"]) and len(fallen) == 6
    assert barycenter.prototypes(p.limit(0), labels, ["oil"]).collect() == []
