"""Many k-means models in one pass against one model at a time in plain numpy, with the same seeds."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from profilia.operators import kmeans
from profilia.operators.anomaly import silhouette_points


def squared(x, c):
    return np.square(x[:, None] - c[None]).sum(2)


def plain_model(h, x, k, start, seed, rounds=2, most=300, tol=1e-4):
    """k-means|| and Lloyd's rounds for one model, all distances by differences."""
    u = lambda turn: kmeans.uniforms(h, seed, k, start, turn)
    centres = x[[np.lexsort((h, u(0)))[0]]]
    for turn in range(1, rounds + 1):
        d = squared(x, centres).min(1)
        with np.errstate(divide="ignore"):
            key = np.where(d > 1e-10, -np.log(u(turn)) / np.maximum(d, 1e-300), np.inf)
        order = np.lexsort((h, key))[: 2 * k]
        centres = np.concatenate((centres, x[order[np.isfinite(key[order])]]))
    n = np.bincount(squared(x, centres).argmin(1), minlength=len(centres))
    centres = kmeans.weighted_start(centres[n > 0], n[n > 0].astype(float), k, np.random.default_rng([seed, k, start]))
    still = tol * x.var(0, ddof=1).mean()
    for _ in range(most):
        d = squared(x, centres)
        own = d.argmin(1)
        cost = d.min(1).sum()
        new = np.stack([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        shift, centres = np.square(new - centres).sum(), new
        if shift <= still:
            break
    return cost, squared(x, centres).argmin(1)


def plain_silhouette(x, labels):
    d = np.sqrt(squared(x, x))
    out = []
    for i, own in enumerate(labels):
        if (labels == own).sum() == 1:
            out.append(0.0)
            continue
        a = d[i, labels == own].sum() / ((labels == own).sum() - 1)
        b = min(d[i, labels == o].mean() for o in set(labels) - {own})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(c, 0.5, (30, 5)) for c in (0, 3, 6, 9)] + [rng.uniform(-3, 12, (20, 5))])
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, v array<double>").repartition(5).cache()


def test_all_models_equal_plain_ones(points):
    ks, runs, seed = [2, 3, 4, 6], 5, 42
    rows = points.select("id", F.xxhash64("id").alias("h"), "v").orderBy("id").collect()
    ids, h, x = np.array([r["id"] for r in rows]), np.array([r["h"] for r in rows]), np.array([r["v"] for r in rows])
    best = {k: min((plain_model(h, x, k, r, seed) for r in range(runs)), key=lambda m: float(f"{m[0]:.9e}")) for k in ks}
    score = {k: plain_silhouette(x, labels) for k, (_, labels) in best.items()}
    labels, got = kmeans.kmeans_auto(points, ks, seed, runs)
    assert got.keys() == score.keys() and all(got[k] == pytest.approx(score[k], abs=1e-9) for k in ks)
    k = max(score, key=score.get)
    found = {r["id"]: r["cluster"] for r in labels.collect()}
    assert [found[i] for i in ids] == best[k][1].tolist()


def test_slices_of_a_task_add_up(monkeypatch):
    rng = np.random.default_rng(1)
    h, x = rng.integers(-(2**62), 2**62, 50), rng.normal(size=(50, 3))
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array(h[a:b]), pa.array(list(x[a:b]))], names=["h", "v"]) for a, b in ((0, 3), (3, 41), (41, 50))])
    models = [kmeans.Model(2, r, x[[r, r + 9]]) for r in range(4)]
    read = lambda out, *c: [[r[k] for k in c] for b in out for r in b.to_pylist()]
    whole = [read(kmeans._draws((models, 3, turn, [3, 4, 5, 2]), batches()), "model", "h", "v") for turn in (0, 1)], read(kmeans._sums(models, batches()), "centre", "n")
    monkeypatch.setattr(kmeans, "SLICE", 7)
    assert whole == ([read(kmeans._draws((models, 3, turn, [3, 4, 5, 2]), batches()), "model", "h", "v") for turn in (0, 1)], read(kmeans._sums(models, batches()), "centre", "n"))
    assert all(np.allclose(v, x[h == k]) for _, k, v in whole[0][1])


def test_partitioning_has_no_influence(points):
    one, many = (kmeans.kmeans_auto(points.repartition(n), [3, 5], runs=3) for n in (1, 9))
    assert one[1] == pytest.approx(many[1]) and {tuple(r) for r in one[0].collect()} == {tuple(r) for r in many[0].collect()}


def test_silhouettes_of_several_labellings(points):
    two = points.withColumn("labels", F.array((F.col("id") % 3).cast("int"), F.lit(0), F.when(F.col("id") == 5, 1).otherwise(0))).cache()
    got = kmeans.silhouettes(two, [3, 2, 2])
    assert got[1] is None
    for m, label in ((0, "id % 3"), (2, "IF(id = 5, 1, 0)")):
        want = silhouette_points(points.withColumn("label", F.expr(label).cast("int"))).agg(F.avg("silhouette")).first()[0]
        assert got[m] == pytest.approx(want)
    two.unpersist()


def test_draws_follow_the_distances(spark):
    """Of ten places, one at distance 3 is drawn nine times as often as one at distance 1."""
    rows = spark.createDataFrame([(i, [1.0 if i else 3.0]) for i in range(10)], "id long, v array<double>").select("id", F.xxhash64("id").alias("h"), "v")
    models = [kmeans.Model(1, r, np.zeros((1, 1))) for r in range(2000)]
    hits = sum(float(v[0, 0]) == 3.0 for v in kmeans.draw(rows, models, 1, 1, [1] * 2000))
    assert hits / 2000 == pytest.approx(0.5, abs=0.05)


def test_odd_rows(spark):
    schema = "id long, v array<double>"
    bad = [(90, None), (91, [None, 1.0]), (92, [float("nan"), 1.0]), (93, [float("inf"), 0.0])]
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)] + bad, schema)
    labels, score = kmeans.kmeans_auto(same, [2, 3], runs=2)  # one different vector: no silhouette, one cluster
    assert score == {} and [tuple(r) for r in labels.orderBy("id").collect()] == [(i, 0) for i in range(6)]
    three = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(9)] + bad, schema)
    labels, score = kmeans.kmeans_auto(three, [2, 3, 5], runs=2)  # five clusters of three vectors are three
    assert score[3] == score[5] == 1.0 and score[2] < 1 and len({r["cluster"] for r in labels.collect()}) == 3
    assert kmeans.kmeans_auto(three.limit(0), [2])[0].collect() == []
    assert kmeans.kmeans_auto(spark.createDataFrame([("a", [1.0])], "id string, v array<float>"), [2], runs=1)[0].collect()[0]["cluster"] == 0


def test_passes_run_in_many_tasks(spark, points, monkeypatch):
    """Vectors that come in one task are dealt out before the passes."""
    seen = []
    plain = kmeans.fit
    monkeypatch.setattr(kmeans, "fit", lambda rows, models: seen.append(rows.select(F.spark_partition_id()).distinct().count()) or plain(rows, models))
    kmeans.kmeans_auto(points.coalesce(1), [2], runs=1)
    assert seen == [spark.sparkContext.defaultParallelism]


def test_nearest_of_models_of_several_sizes():
    rng = np.random.default_rng(9)
    x = 50 + rng.normal(size=(300, 4))
    models = [kmeans.Model(k, 0, x[rng.choice(300, k, replace=False)]) for k in (3, 1, 5, 3, 2, 5)]
    models[0].centres[2] = models[0].centres[0]  # of equal ones the first
    near, d = kmeans._nearest(x, models)
    begin = 0
    for m, model in enumerate(models):
        want = squared(x, model.centres)
        assert np.array_equal(near[:, m] - begin, want.argmin(1)) and np.allclose(d[:, m], want.min(1), atol=1e-9)
        begin += model.k
