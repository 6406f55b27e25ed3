"""The training-data operators on small tables: brute force, round trips, and rows with nulls, ties, repeats and odd columns."""

import hashlib
import time
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilia.llm import bpe, line_dedup, mixing, ngram_join, ogg, quality, sharding, topk, url_filter, warc
from profilia.llm.common import Scratch
from profilia.llm.components import connected_components
from profilia.llm.shingles import shingle_sets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rk long, row string, size string, uses string, parts string, ids string"


def documents(spark, rows):
    full = [(i, t, "en", s, len(t or ""), 1, "r", "s", "u", "p", "i") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def odd_rows():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(12)]
    near = [" ".join(t.split()[:57] + ["x", "y", "z"]) for t in base[:6]]
    rows = [(k, t, f"s{k % 4}") for k, t in enumerate(base + near)]
    rows += [(100, None, None), (101, "", "s1"), (102, " \n\t ", None), (103, "one two", "s2"), (104, "one  TWO", "s2"), (105, " ".join(rng.choice(words, 30_000)), "s3")]
    rows += [(106, base[0], "s0"), (106, base[0], "s0"), (None, base[1], None), (107, "line a\nline b is here now\n\nline a", "s1"), (108, "Line B is here now\nother", "s1")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, odd_rows()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(7, 7), (None, 3)] + [(5000, 6000 + k) for k in range(50)]
    u = Union()
    for a, b in edges:
        if a is not None and a != b:
            u.join(a, b)
    groups = {}
    for x in u.up:
        groups.setdefault(u.find(x), []).append(x)
    want = {x: min(g) for g in groups.values() for x in g}
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"), Scratch(spark, "t"))
    assert {r["id"]: r["component"] for r in got.collect()} == want
    assert connected_components(spark.createDataFrame([], "src long, dst long"), Scratch(spark, "t")).count() == 0


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def set_of(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_op2_brute_force(docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = [set_of(t) for _, t in rows]
    assert [len(s) for s in shingle_sets([(t or "").encode() for _, t in rows])] == [len(s) for s in sets]
    u = Union()
    for k in range(len(rows)):
        u.find(k)
    for a, b in itertools.combinations(range(len(rows)), 2):
        i = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
            u.join(a, b)
    least = {}
    for k, (d, _) in enumerate(rows):
        least.setdefault(u.find(k), []).append(d)
    want = sorted(((d, len(sets[k]), min((x for x in least[u.find(k)] if x is not None), default=None)) for k, (d, _) in enumerate(rows)), key=str)
    got = ngram_join.ngram_jaccard_components(docs)
    assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == want
    assert ngram_join.ngram_jaccard_components(empty).count() == 0


def test_op2_one_of_each(docs, empty):
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
    assert [i for z, i in ids if not z] == [*range(12), 100, 101, 102, 103, 105, 107, 108] and not ids[-1][0]
    assert ngram_join.one_of_each(empty).count() == 0


def test_op2_extremes():
    sets = shingle_sets([b"a b c d e f g h", b"", b"x y", b"a b c d e f g h i j k l"])
    scramble = int(ngram_join._SCRAMBLE)
    for s, e in zip(sets, ngram_join.extremes(sets).view(np.uint64).tolist(), strict=True):
        other = [int(x) * scramble % 2**64 for x in s]
        assert e == ([int(s[0]), int(s[-1]), min(other), max(other)] if len(s) else [0] * 4)
    assert ngram_join.extremes(sets[1:2]).tolist() == [[0] * 4]


def test_op2_links_in_a_large_group(spark):
    """A group in which few pairs with the hub link: components must still be those of all pairs."""
    rng = np.random.default_rng(3)
    base = [f"b{k}" for k in range(80)]
    rows = []
    for k in range(120):
        t = list(base)
        for j in rng.choice(80, int(rng.integers(0, 4)), replace=False):
            t[j] = f"n{k}-{j}"
        rows.append((k, " ".join(t), "s"))
    sets = [set_of(t) for _, t, _ in rows]
    u = Union()
    for a, b in itertools.combinations(range(120), 2):
        u.find(a), u.find(b)
        i = len(sets[a] & sets[b])
        if 4 * i >= 3 * (len(sets[a]) + len(sets[b]) - i):
            u.join(a, b)
    low = {}
    for k in range(120):
        low[u.find(k)] = min(low.get(u.find(k), k), k)
    got = ngram_join.ngram_jaccard_components(documents(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: low[u.find(k)] for k in range(120)}


def test_op3(docs, empty):
    out = {}
    for r in line_dedup.dedup_lines(docs).collect():
        out.setdefault(r["row"]["doc_id"], []).append((r["row"]["text"], r["n_lines"], r["n_dropped"]))
    assert out[100] == [(None, 0, 0)] and out[101] == [("", 0, 0)] and out[102] == [(" \n\t ", 0, 0)]
    assert out[107] == [("line a\nline b is here now\n", 3, 1)]
    assert out[108] == [("other", 2, 1)]
    assert out[0] == [("", 1, 1)] or out[106] == [("", 1, 1)] * 2
    assert out[104][0][0] == "one  TWO"
    assert line_dedup.dedup_lines(empty).count() == 0


def test_op3_brute_force(spark):
    """One line of each component of exact similarity stays: short and long lines, fuzzy pairs, repeated characters, whole rows that repeat."""
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 9)))) for _ in range(300)]
    lines = []
    for _ in range(25):
        base = [str(x) for x in rng.choice(words, int(rng.integers(3, 60)))]
        for _ in range(6):
            w = list(base)
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(len(w)))] = str(rng.choice(words))
            lines.append(" ".join(w))
    lines += ["a" * 500, "a" * 400, "ab" * 100, "short", "shorn", "日本語" * 20, "日本語" * 21]
    twice = "one more row that comes twice\nand its other line"
    rows = [(i, t, 1) for i, t in enumerate(lines)] + [(500, None, 1), (501, "", 1), (600, twice, 1), (600, twice, 1), (600, twice, 2)]
    got = {}
    for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, row int")).collect():
        got.setdefault(r["row"]["doc_id"], []).append((r["row"]["text"], r["n_lines"], r["n_dropped"]))

    def shingles(line):
        u = line.encode("utf-16-be")
        return {u[2 * k : 2 * k + 24] for k in range(max(1, len(u) // 2 - 11))}

    sets, u = [shingles(x) for x in lines], Union()
    for a, b in itertools.combinations(range(len(lines)), 2):
        u.find(a), u.find(b)
        if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
            u.join(a, b)
    first = {}
    for k in range(len(lines)):
        first.setdefault(u.find(k), k)
    stays = {k: first[u.find(k)] == k for k in range(len(lines))}
    assert 40 < sum(not x for x in stays.values()) and {k: got[k] == [(lines[k], 1, 0)] for k in stays} == stays
    assert got[500] == [(None, 0, 0)] and got[501] == [("", 0, 0)]
    assert sorted(got[600]) == [("", 2, 2), ("", 2, 2), (twice, 2, 0)]


def test_op3_bounds_never_exclude_links(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(400):
        x = "".join(rng.choice(list("abcdefgh "), int(rng.integers(20, 900))))
        at = int(rng.integers(len(x)))
        rows.append((2 * k, x, k))
        rows.append((2 * k + 1, x[:at] + "".join(rng.choice(list("xyz"), int(rng.integers(0, 12)))) + x[at:], k))
    t = spark.createDataFrame(rows, "id long, line string, pair int")
    marked = line_dedup.bit_sets(t).join(t, "id").cache()
    l, r = marked.where("id % 2 = 0").alias("l"), marked.where("id % 2 = 1").alias("r")
    both = l.join(r, F.col("l.pair") == F.col("r.pair")).select("l.line", F.col("r.line").alias("other"), line_dedup.possible("l", "r").alias("may"))
    seen = 0
    for x, y, may in both.collect():
        a, b = ({z.encode("utf-16-be")[2 * k : 2 * k + 24] for k in range(max(1, len(z) - 11))} for z in (x, y))
        linked = 9 * len(a & b) >= 4 * (len(a) + len(b))
        seen += linked
        assert may or not linked
    assert seen > 100


def test_op3_recall(spark):
    """Similar lines must meet in a band about as often as independent permutations make them."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 9)))) for _ in range(5000)]
    rows = []
    for n in rng.integers(15, 25, 6000):
        w = [str(x) for x in rng.choice(words, n)]
        rows.append((" ".join(w), " ".join(w + [str(rng.choice(words)) for _ in range(int(rng.integers(1, 3)))])))
    x, y = (line_dedup.shingle_hashes(c) for c in "ab")
    pairs = spark.createDataFrame(rows, "a string, b string").withColumn("j", F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).where("j between 0.8 and 0.92").cache()
    bands = line_dedup.signatures(pairs.select(F.xxhash64("a").alias("id"), F.col("a").alias("line")).union(pairs.select(F.xxhash64("b"), "b")))
    one = bands.select(F.col("id").alias("i"), F.col("bands").alias("x"))
    two = bands.select(F.col("id").alias("k"), F.col("bands").alias("y"))
    met = pairs.select("j", F.xxhash64("a").alias("i"), F.xxhash64("b").alias("k")).join(one, "i").join(two, "k").select(F.arrays_overlap("x", "y").cast("int"), 1 - F.pow(1 - F.pow("j", line_dedup.ROWS), line_dedup.BANDS)).collect()
    got, ideal = np.mean(met, axis=0)
    assert len(met) > 500 and got > ideal - 0.004


def test_op3_shifted_lines(spark):
    """Similarity mustn't depend on where a line without blanks, or a long word, begins."""
    rng = np.random.default_rng(13)
    han = "".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 3000, 120))
    code = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 150))
    rows = [(1, han, "s"), (2, "\u4e00" + han, "s"), (3, han[:60] + "\u4e00" + han[60:], "s"), (4, code, "s"), (5, f"https://{code}", "s"), (6, code[::-1], "s"), (7, han[::-1], "s"), (8, "short", "s"), (9, "shorn", "s")]
    got = {r["row"]["doc_id"]: (r["row"]["text"], r["n_dropped"]) for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert {i for i, (_, n) in got.items() if n} == {2, 3, 5}
    assert all(got[i] == ("", 1) for i in (2, 3, 5)) and all(got[i][0] == t for i, t, _ in rows if i not in (2, 3, 5))


def test_op4(docs, empty):
    mix = mixing.mix_sources(docs)
    got = mixing.taken_words(mix).collect()
    assert len(got) == docs.count()
    size = {}
    for r in docs.collect():
        size[r["source"]] = size.get(r["source"], 0) + len(words_of(r["text"]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(size.values()), set()
    while True:
        rate = (total - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in size if s not in capped)
        more = {s for s in size if s not in capped and rate * weight[s] > 2 * size[s]}
        if not more:
            break
        capped |= more
    target = {s: 2.0 * size[s] if s in capped else rate * weight[s] for s in size}
    by_source = {r["sid"]: r for r in mix.sources.collect()}
    for k, s in enumerate(order):
        assert by_source[k]["target"] == pytest.approx(target[s]) and by_source[k]["size"] == size[s]
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert sum(r["taken"] for r in got) == pytest.approx(total, abs=len(size))
    again = mixing.taken_words(mixing.mix_sources(docs)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    texts = mixing.mixed_documents(docs, mix)
    assert texts.columns == docs.columns
    assert sum(len(words_of(r["text"])) for r in texts.collect()) == sum(r["taken"] for r in got)
    assert mixing.taken_words(mixing.mix_sources(empty)).count() == 0


def test_op4_every_source_comes_out_at_its_target(spark):
    """Sources of 1 to 1,000 words, in one document or many: the words taken of each are its target, rounded."""
    sizes = [1, 2, 12, 15, 33, 40, 63, 64, 65, 127, 128, 129, 200, 641, 1000]
    rows, k = [], 0
    for n, size in enumerate(sizes):
        for part in ([size] if n % 2 else [size // 3, 0, size - size // 3]):
            rows.append((k, " ".join(f"w{j}" for j in range(part)), f"s{n:02d}"))
            k += 1
    docs = documents(spark, rows)
    mix = mixing.mix_sources(docs)
    got = {r["doc_id"]: r for r in mixing.taken_words(mix).collect()}
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got.values())
    taken, target = {}, {}
    for i, _, s in rows:
        taken[s], target[s] = taken.get(s, 0) + got[i]["taken"], got[i]["target"]
    assert taken == {s: int(t + 0.5) for s, t in target.items()} and sum(target.values()) == pytest.approx(1.5 * sum(sizes))
    out = mixing.mixed_documents(docs, mix).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n"), F.max("n_chars").alias("c")).collect()
    assert {r["source"]: r["n"] for r in out} == {s: n for s, n in taken.items() if n}


def test_columns_with_dots_pass(spark):
    rows = [(1, "a b c d e f g", "s", 3), (2, "a b c d e f g", "s", 4), (3, "z", "t", 5), (4, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` long")
    assert sorted(r["a.b"] for r in ngram_join.one_of_each(docs).collect() if r["text"]) == [3, 5]
    mixed = mixing.mixed_documents(docs, mixing.mix_sources(docs))
    assert mixed.columns == docs.columns and {r["a.b"] for r in mixed.collect()} <= {3, 4, 5}


def test_op4_permutation(spark):
    for n in (1, 2, 3, 7, 100, 4097):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9))).collect()
        assert sorted(r[0] for r in got) == list(range(n))


def test_op5(docs, empty):
    by_text = {}
    for r in docs.select("doc_id", "text").collect():
        by_text.setdefault(r["doc_id"], []).append((r["text"] or "").encode())
    for r in ogg.read_media(ogg.encode_media(docs)).collect():
        text = by_text[r["doc_id"]].pop()
        padded = text + b" " * (max(192, -(-len(text) // 192) * 192) - len(text))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    assert ogg.read_media(ogg.encode_media(empty)).count() == 0


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_op5_container():
    rng = np.random.default_rng(1)
    for n in (192, 192 * 50, 192 * 700):
        payload = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        media = ogg.mux(payload)
        back, info = ogg.demux(media)
        assert back == payload and info["seconds"] == n / 2 / ogg.RATE
        broken = bytearray(media)
        broken[len(media) // 2] ^= 1
        with pytest.raises(ValueError):
            ogg.demux(bytes(broken))
        with pytest.raises(ValueError):
            ogg.demux(media[:-1])
    assert ogg.page_crc(b"some page" * 9) == slow_crc(b"some page" * 9)


def test_op6_candidates_of_nested_headers():
    """Headers nested in a payload cost time in proportion, and all that look like records are found."""
    inner = b""
    for i in range(3000):  # each declares all that follows it as its payload
        inner = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(inner) + inner + b"\r\n\r\n"
        if i % 100:
            continue
        got = list(warc.candidates(inner))
        assert [r["start"] for r in got][:2] == [0, inner.find(b"WARC", 1)][: len(got)] and len(got) == i + 1 and got[0]["next"] == len(inner)
    trap = b"WARC/1.1\r\nWARC-Target-URI: http://x/WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [(r["start"], r["next"]) for r in warc.candidates(trap * 2)] == [(0, len(trap)), (len(trap), 2 * len(trap))]
    assert not list(warc.candidates(b"")) and not list(warc.candidates(b"WARC/1.1\r\n\r\n")) and not list(warc.candidates(b"x" + trap))
    hostile = b"WARC/1.1\r\n" * 400_000  # never a header
    start = time.time()
    assert not list(warc.candidates(hostile + b"\r\n\r\n"))
    assert not list(warc.candidates(b"\r\n\r\nWARC/1.1\r\n" * 300_000))
    assert time.time() - start < 10


def test_op6(spark, tmp_path):
    trap = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 1\r\n\r\nz\r\n\r\n"
    rows = [(1, "http://a/", "same"), (5, "http://b/\nc", "same"), (3, None, "same"), (7, "u", None), (8, "u", ""), (9, "u", trap), (10, "u", "é" * 5000), (None, "u", "alone"), (11, "u", "twice"), (11, "u", "twice")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/a"
    warc.write_archives(pages, path)
    got = sorted((tuple(r) for r in warc.resolved(warc.read_archives(spark, path)).collect()), key=str)
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(x for x in (best.get(h or ""), i if i is not None else -1) if x is not None)
    import base64

    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        first = i is None or best[h or ""] == i
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else best[h or ""]))
    assert got == sorted(want, key=str)
    full = warc.read_archives(spark, path, with_payload=True).where("page_id = 9").first()
    assert full["payload"].decode() == trap
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0
    damaged = next(tmp_path.glob("a/part-*"))
    whole = damaged.read_bytes()
    damaged.write_bytes(whole.replace(b"alone", b"Alone"))
    (damaged.parent / f".{damaged.name}.crc").unlink(missing_ok=True)
    if b"alone" in whole:
        with pytest.raises(ValueError, match="declared"):
            warc.read_archives(spark, path)
    damaged.write_bytes(whole)
    damaged.write_bytes(damaged.read_bytes() + b"rest")
    (damaged.parent / f".{damaged.name}.crc").unlink(missing_ok=True)  # else the local file system's own checksum fails first
    with pytest.raises(ValueError):
        warc.read_archives(spark, path)


def test_op7(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=6)], 1) for k in range(150)]
    rows += [(200 + k, [0.5] * 6, 1) for k in range(30)] + [(300, None, 1), (301, [1.0, None], 1), (302, [float("nan")] * 6, 1), (303, [float("inf")] * 6, 1), (320, [0.0] * 6, 1), (321, [3.0], 1), (340, [], 1), (None, [1.0] * 6, 1)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, norm int")
    v = topk.quantized(e)
    got = {}
    for r in topk.exact_top_k(v, v.where("id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    fine = {i: [int(np.floor(64 * x)) for x in x_] for i, x_, _ in rows if i is not None and x_ is not None and all(x is not None and np.isfinite(x) for x in x_)}
    for q in (i for i in fine if i % 20 == 0):
        s = sorted((-sum(a * b for a, b in zip(fine[q], fine[c])), c) for c in fine if c != q)[:20]
        assert got.pop(q) == [(k + 1, c, -m) for k, (m, c) in enumerate(s)]
    assert not got
    none = v.where("id < 0")
    assert topk.exact_top_k(none, none).count() == 0 and topk.exact_top_k(v, none).count() == 0


def test_op7_pruning(spark):
    """Spread lengths and peaked vectors: both prunings leave few products and lose none."""
    rng = np.random.default_rng(9)
    m = rng.normal(size=(600, 24)) * 8
    m[np.arange(600), rng.integers(0, 24, 600)] += 400
    m *= rng.uniform(0.02, 1, (600, 1)) ** 2
    m = np.floor(m)
    m = m[np.argsort(-np.sqrt((m**2).sum(1)))]
    mn, counts = np.sqrt((m**2).sum(1)), []
    for q in m[::40]:
        s = m @ q
        floor = np.sort(s)[-20]
        rows = topk.survivors(q, m, mn, floor, 1e-6)
        assert set(np.flatnonzero(s >= floor)) <= set(rows)
        counts.append(len(rows))
    assert np.mean(counts) < 200
    flat = np.ones((100, 24))
    assert len(topk.survivors(flat[0], flat, np.sqrt((flat**2).sum(1)), 23.0, 1e-6)) == 100
    short = np.array([[9.0] * 4, [1.0] * 4])
    assert topk.survivors(short[0], short, np.array([18.0, 2.0]), 200.0, 1e-6).tolist() == [0]
    rows = [(k, [int(x) for x in v]) for k, v in enumerate(m[:200])] + [(0, [0] * 24), (7, [1] * 24)]
    v = spark.createDataFrame(rows, "id long, v array<long>")
    got = topk.exact_top_k(v, v.where("id % 20 = 0"), 5).collect()
    asks = {i: max(x for j, x in rows if j == i) for i in range(0, 200, 20)}
    for i, q in asks.items():
        want = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in rows if j != i)[:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == i) == [(k + 1, j, -s) for k, (s, j) in enumerate(want)]


@pytest.fixture(scope="module")
def automaton():
    return bpe.Automaton(**bpe.load_rules(bpe.default_rules()))


def test_op8_against_library(spark, docs, empty, automaton):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_rules())
    rng = np.random.default_rng(2)
    texts = ["", "  ", "Hello WORLD it's <|endoftext|>x\x1c\x85é", "ΣΑΣ İ ½ ²³ __--!!", "日本語", "a" * 3000, *(t or "" for _, t, _ in odd_rows())]
    letters = list("abcdefghijklmnoprstuvwxyz'!?.,0123456789 é中\n")
    texts += ["".join(rng.choice(letters, 40)) for _ in range(500)]
    for t in texts:
        e = lib.encode(t, add_special_tokens=False)
        ids = automaton.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids
        assert automaton.decode(ids) == lib.decode(e.ids, skip_special_tokens=False)
    got = bpe.digests(bpe.encode_documents(docs, bpe.default_rules()))
    assert got.count() == docs.count() and got.where("doc_id = 100").first()["n_tokens"] == 0
    assert bpe.encode_documents(empty, bpe.default_rules()).count() == 0


def test_op8_every_code_point(automaton):
    """Classes, lower case and composition of all code points are those of the library."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_rules())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 4000):
        text = " ".join(f"a{chr(c)}1{chr(c)}!" for c in points[i : i + 4000] if c % 5 == 0 or c < 0x20000)
        assert np.frombuffer(automaton.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_op8_table_is_filled_once(automaton):
    automaton._clear()
    automaton.path("unbelievable")
    n = len(automaton.next)
    assert n > 5 and automaton.path("unbelievable") and len(automaton.next) == n


def test_op8_small_merges():
    labels = ["a", "b", "a</w>", "b</w>", "aa", "ab</w>", "aa</w>", "aab</w>"]
    a = bpe.Automaton(labels, [("a", "a"), ("a", "b</w>"), ("a", "a</w>"), ("aa", "b</w>")], {})
    for n in range(1, 8):
        word = ["a"] * (n - 1) + ["a</w>"]
        for left, right in a_merges(labels):
            k, out = 0, []
            while k < len(word):
                if word[k : k + 2] == [left, right]:
                    out.append(left + right)
                    k += 2
                else:
                    out.append(word[k])
                    k += 1
            word = out
        assert [labels[i] for i in a.path("a" * n)] == word


def a_merges(labels):
    return [("a", "a"), ("a", "b</w>"), ("a", "a</w>"), ("aa", "b</w>")]


def test_op9(spark, empty):
    rng = np.random.default_rng(6)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(k, " ".join(rng.choice(words, 30)) if k % 2 else " ".join(f"{w}!!###" for w in rng.choice(words, 30)), "s") for k in range(120)]
    d = documents(spark, rows + [(500, None, "s"), (501, "", "s"), (None, "alpha", "s")])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(120)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(d, labels).collect()
    assert len(got) == 123 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 120]
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.95
    assert {r["score"] for r in quality.score_documents(d, labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(empty, labels).count() == 0
    kept = quality.keep_good(d, d, labels)
    assert kept.columns == d.columns and kept.count() == sum(r["predicted"] for r in got)


def test_op9_learns_one_row_of_each_id(spark, monkeypatch):
    """Repeated ids are reduced before rows reach the driver."""
    learned = []
    monkeypatch.setattr(quality, "train", lambda texts, labels: learned.append((texts, labels.tolist())))
    docs = spark.range(400).select((F.col("id") % 4).alias("doc_id"), F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("text"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)] * 2, "doc_id long, quality int")
    quality.fit(docs, labels)
    ids = [k for k in range(4) if zlib.crc32(str(k).encode()) % 5]
    assert len(ids) > 1 and learned == [([f"t{396 + k}".encode() for k in ids], [float(k % 2) for k in ids])]


def test_op9_gradient_layout():
    texts = [b"", b"x", b"y" * 63, b"z" * 2000]
    data, at, chunks = quality._layout(texts)
    assert chunks.tolist() == [1, 1, 1, 5] and len(at) == 8 and len(data) % quality.CELL == quality.WIDTH
    m = quality.train([b"good text"] * 20 + [b"BAD!!"] * 20, np.array([1.0] * 20 + [0.0] * 20))
    assert quality.scores([b"good text"], m)[0] > 0.8 > 0.2 > quality.scores([b"BAD!!"], m)[0]
    long = b"good text " * 30_000
    assert quality.scores([long, b"BAD!!"], m)[1] == pytest.approx(quality.scores([b"BAD!!"], m)[0], abs=1e-6)


def test_op9_forward_pass():
    """The vectorised scores against loops over chunks, filters and positions."""
    rng = np.random.default_rng(3)
    m = {"w": rng.normal(size=(quality.WIDTH, 257, quality.FILTERS)).astype(np.float32), "a": rng.normal(size=(quality.FILTERS, quality.HIDDEN)).astype(np.float32), "b": rng.normal(size=quality.HIDDEN).astype(np.float32), "c": rng.normal(size=quality.HIDDEN).astype(np.float32), "d": np.array([0.1], np.float32)}
    for text in (b"", b"short", bytes(rng.integers(0, 256, 700, dtype=np.uint8)), bytes(rng.integers(0, 256, 1300, dtype=np.uint8))):
        cells = -(-(len(text) + quality.WIDTH) // quality.CELL)
        data = list(text) + [256] * (cells * quality.CELL + quality.WIDTH - len(text))
        logits = []
        for k in range(max(1, -(-(cells - 1) // quality.STEP))):
            span = range(k * quality.STEP * quality.CELL, min(k * quality.STEP + quality.CHUNK, cells) * quality.CELL)
            top = np.max([sum(m["w"][j, data[p + j]] for j in range(quality.WIDTH)) for p in span], axis=0)
            logits.append(np.maximum(0, top @ m["a"] + m["b"]) @ m["c"] + 0.1)
        want = 1 / (1 + np.exp(-np.clip(np.mean(logits), -30, 30)))
        assert quality.scores([text], m)[0] == pytest.approx(want, rel=1e-4, abs=1e-7)


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def test_op10(spark):
    canon = '<LINK rel="canonical" href="{}">'
    rows = [
        (1, "http://a.example.com/en/1", None), (2, "https://WWW.Example.com/en/x?q", ""), (3, "http://x.net/es/1", ""), (4, "http://x.net/es", ""),
        (5, "http://b.org/1#f", canon.format("http://x.net/es/2")), (6, "http://c.org/", '<meta http-equiv="refresh" content="0; url=//b.org/1">'),
        (7, "http://d.org/p/q", canon.format("r")), (8, "http://d.org/p/r", canon.format("http://e.com/")), (9, "http://f.org/", canon.format("http://x.net/es/2") + canon.format("http://e.com/")),
        (10, None, canon.format("x")), (11, "no scheme", canon.format("http://x.net/es/2")), (12, "http://netx/es/", ""), (12, "http://netx/es/", ""), (13, "http://com", ""),
    ]
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block") and got[2] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[3][2:] == ("net/es/", "block") and got[4][2:] == (None, "allow")
    assert got[5] == ("b.org", "/1", None, "allow") and got[6][3] == "allow"  # their class holds e.com, which is allowed
    assert got[7][3] == got[8][3] == got[9][3] == "allow"
    assert got[10] == ("", "", None, "allow") and got[11] == ("", "", None, "allow") and got[12][3] == "allow" and got[13] == ("com", "", None, "allow")
    less = [r for r in rows if r[0] != 9]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(less, "page_id long, url string, html string"), RULES).collect()}
    assert got[5] == got[6] == "block" and got[7] == got[8] == "allow"
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0


def test_op1(spark, docs, empty, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target=1 << 20)
    for k in range(4):
        store.append(docs.repartition(2))
    before = store.manifest()
    assert store.versions() == [1, 2, 3, 4] and before.agg(F.sum("rows")).first()[0] == 4 * docs.count()
    n = before.count()
    store.compact(docs.schema)
    after = store.manifest()
    assert store.versions()[-1] == 5 and after.count() < n and after.agg(F.sum("rows")).first()[0] == 4 * docs.count()
    text = lambda df: sorted((str(r["doc_id"]), str(r["text"])) for r in df.select("doc_id", "text").collect())
    assert text(store.read(docs.schema)) == text(store.read(docs.schema, version=4)) == sorted(text(docs) * 4)
    store.append(docs)
    store.compact(docs.schema)
    assert text(store.read(docs.schema)) == sorted(text(docs) * 5)
    with pytest.raises(FileExistsError):
        store._commit(after, 5)
    store.remove_unused()
    assert text(store.read(docs.schema)) == sorted(text(docs) * 5)
    assert sharding.shard_documents(docs, f"file://{tmp_path}/d", arrivals="source").count() == docs.count()
    assert sharding.shard_documents(empty, f"file://{tmp_path}/e").count() == 0


def test_op1_columns_of_any_name(spark, tmp_path):
    d = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("lang"), F.lit("f").alias("__file"), F.struct("id").alias("_metadata"), F.lit(1).alias("row"), F.lit(2).alias("file"), F.lit(3).alias("a.b"))
    got = sharding.shard_documents(d, f"file://{tmp_path}/n", target=1 << 20)
    assert got.select("row.*").columns == d.columns and sorted(map(str, got.select("row.*").collect())) == sorted(map(str, d.collect()))
    assert got.select("file").distinct().count() == 1


def test_op1_cascade_and_many_arrivals(spark, tmp_path, monkeypatch):
    """A tier's merged file meets those of the tier that it reaches; more arrivals than ARRIVALS are stored too."""
    d = spark.range(1860).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"), F.least(F.floor(F.col("id") / 240), F.lit(4)).cast("string").alias("lang")).coalesce(1)
    assert sharding.shard_documents(d, f"file://{tmp_path}/c", target=1 << 20).select("file").distinct().count() == 1
    monkeypatch.setattr(sharding, "ARRIVALS", 3)
    got = sharding.shard_documents(d.withColumn("lang", F.when(F.col("lang") > "0", F.col("lang"))), f"file://{tmp_path}/m")
    assert sorted(map(tuple, got.select("row.*").select("doc_id", "text").collect())) == sorted(map(tuple, d.select("doc_id", "text").collect()))


def test_op1_runs_and_writers(spark, tmp_path):
    """Runs hold shards of one tier up to the target; few shards wait; what another writer hasn't committed isn't removed."""
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"), F.lit("x").alias("place"))
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target=1 << 20)
    for k in range(6):
        store.append(d.where(F.col("doc_id") % 6 == k).coalesce(1))
    manifest = {r["file"]: r for r in store.manifest().collect()}
    by_run = {}
    for r in store.runs().collect():
        by_run.setdefault(r["run"], []).append(manifest[r["file"]])
    assert by_run and all(len(x) > 1 and len({f["tier"] for f in x}) == 1 and sum(f["bytes"] for f in x) < 2 * store.target for x in by_run.values())
    assert store.runs(least=7).count() == 0
    before = len(manifest)
    store.compact(d.schema)
    assert store.manifest().count() == before - sum(map(len, by_run.values())) + len(by_run)
    other = tmp_path / "s" / "data" / "append-other"
    other.mkdir()
    store.remove_unused()
    assert other.exists() and store.read(d.schema, version=6).count() == 4000
    store.remove_unused(grace=-1)
    assert not other.exists() and store.read(d.schema).count() == 4000
