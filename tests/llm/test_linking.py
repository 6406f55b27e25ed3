"""Steps that the similarity operators share: candidate pairs and components."""

import numpy as np
from pyspark.sql import functions as F

from profilia.llm import components, line_dedup, linking
from profilia.llm.common import Scratch


def plain_components(edges):
    label = {v: v for a, b in edges if a != b for v in (a, b)}
    changed = True
    while changed:
        changed = False
        for a, b in edges + edges[::-1]:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_op3_bands_miss_fewer_pairs_than_before():
    """At each similarity that links, the bands must meet as often as seven bands of three would, or miss one pair in a million at most."""
    for j in np.linspace(0.8, 1, 50):
        assert (1 - j**line_dedup.ROWS) ** line_dedup.BANDS <= max((1 - j**3) ** 7, 1e-6)
    assert line_dedup.ROWS * line_dedup.FIELD <= 63 and line_dedup.ROWS * line_dedup.BANDS < 21


def test_pairs_leave_the_last_join_once(spark):
    """Texts that share hundreds of keys and are no hub's must not come once for each key; none is missed, wherever its first shared key stands."""
    rng = np.random.default_rng(17)
    rows = []
    for i in range(30):  # ids in groups of ten share most of 200 keys, each group in its own order of numbers
        keys = rng.permutation(200)[:150] + 1000 * (i // 10)
        rows += [(int(k), i, int(p)) for p, k in enumerate(sorted(keys))]
    rows += [(5000 + i // 2, 100 + i, 0) for i in range(20)]  # and pairs with a single key
    shared = spark.createDataFrame(rows, "key long, id long, pos long")
    full = linking.with_keys_before(shared)
    l, r = full.alias("l"), full.alias("r")
    left = l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.id") < F.col("r.id")) & ~F.arrays_overlap("l.before", "r.before"))
    got = [(x["a"], x["b"]) for x in left.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).collect()]
    want = {(a, b) for a in range(30) for b in range(a + 1, 30) if a // 10 == b // 10} | {(100 + 2 * k, 101 + 2 * k) for k in range(10)}
    assert set(got) == want and len(got) < 1.2 * len(want)


def test_components_end_in_the_driver_or_in_spark(spark, monkeypatch):
    """Chains, stars and cycles have the same components whether the contracted rest is ended in the driver or not, in fewer tables."""
    rng = np.random.default_rng(19)
    order = [int(x) for x in rng.permutation(3000)]
    edges = [(order[k], order[k + 1]) for k in range(2999) if k % 500] + [(5000, 5000 + k) for k in range(1, 50)] + [(7, 7), (9000, 9001), (9001, 9002), (9002, 9000)]
    want = plain_components(edges)
    df, tables = spark.createDataFrame(edges, "src long, dst long"), []
    for rest in (components.REST, -1):
        monkeypatch.setattr(components, "REST", rest)
        scratch = Scratch(spark, "components")
        assert {r["id"]: r["component"] for r in components.connected_components(df, scratch).collect()} == want
        tables.append(scratch._n)
    assert tables[0] < 8 <= tables[1]


def test_op3_hashes_each_shingle_once(spark, monkeypatch):
    """Signatures hash a shingle once for all bands, bit sets call no function for each element of an array, and texts are cut into lines once."""
    t = spark.createDataFrame([(1, "a line of some length that has shingles")], "id long, line string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(line_dedup.signatures(t)).count("xxhash64(") == line_dedup.STEP + line_dedup.BANDS
    assert "lambda" not in plan(line_dedup.bit_sets(t))
    docs, cut = spark.createDataFrame([(1, "one\ntwo"), (2, "two\nthree")], "doc_id long, text string"), []
    table = Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, *a, **b: cut.append(plan(df).count("posexplode(")) or table(self, df, *a, **b))
    line_dedup.duplicate_lines(docs, Scratch(spark, "lines"))
    assert sum(cut) == 1


def test_op3_similarity_with_repeated_shingles(spark):
    """Lines whose shingles repeat are similar by their sets, not by how often a shingle stands in them."""
    rng = np.random.default_rng(23)
    lines = ["ab" * 60, "ab" * 100, "a" * 300, "a" * 11 + "b" * 12, "abc" * 40 + "xyz" * 3] + ["".join(rng.choice(list("ab"), 40)) * int(k) for k in (1, 2, 5)]
    lines += [x + "".join(rng.choice(list("xyz"), int(n))) for x in lines for n in (1, 4, 9)]
    rows = [(i, j, x, y) for i, x in enumerate(lines) for j, y in enumerate(lines) if i < j]
    sets = [{x[k : k + 12] for k in range(max(1, len(x) - 11))} for x in lines]
    got = spark.createDataFrame(rows, "i int, j int, x string, y string").select("i", "j", line_dedup.similar("x", "y").alias("s")).collect()
    texts = spark.createDataFrame(list(enumerate(lines)), "id int, line string")
    want = {(i, j) for i, j, _, _ in rows if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert {(g["i"], g["j"]) for g in got if g["s"]} == want and 5 < len(want) < len(rows)
    for marked in (line_dedup.bit_sets(texts), line_dedup.parity_sets(texts)):
        l, r = marked.alias("l"), marked.alias("r")
        may = {(a, b) for a, b, m in l.join(r, F.col("l.id") < F.col("r.id")).select("l.id", "r.id", line_dedup.possible("l", "r")).collect() if m}
        assert want <= may
