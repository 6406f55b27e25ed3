"""Periodic runs, fill-in-the-middle and chat formatting: brute force, exact round trips, and rows with nulls, ties, repeats and odd columns."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from profilia.llm import chat, infill, queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_runs(words, least=24, times=3):
    """Every maximal stretch of every period, by comparing words; the smallest period of a stretch stays."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_collapse(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_words(seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(int(rng.integers(1, 7))):
        unit = [str(x) for x in rng.integers(0, rng.choice([2, 3, 50]), int(rng.integers(1, 30)))]
        whole = unit * int(rng.integers(1, 12))
        out += whole[: len(whole) - int(rng.integers(0, len(unit)))]
        if rng.random() < 0.3:
            out += [f"x{int(v)}" for v in rng.integers(0, 1000, 20)]
    return out


@pytest.mark.parametrize("top", [1, 3, 16])
def test_names_and_extensions(top):
    rng = np.random.default_rng(top)
    w = np.concatenate(([-1], rng.integers(0, 2, 300), [-1], np.tile([5, 6, 7], 100), [-1])).astype(np.int64)
    names = runs.Names(w, top)
    assert len(names.levels) <= top + 1
    for k, level in enumerate(names.levels):
        for i, j in rng.integers(0, len(w) - (1 << k), (200, 2)):
            a, b = w[i : i + (1 << k)], w[j : j + (1 << k)]
            assert i == j or (level[i] == level[j]) == ((a == b).all() and (a >= 0).all())
    i = rng.integers(0, len(w) - 1, 400)
    j = np.minimum(i + rng.integers(1, 30, 400), len(w) - 1)
    i, j = i[i < j], j[i < j]

    def equal(a, b, step):
        n = 0
        while 0 <= a < len(w) and b < len(w) and w[a] == w[b] >= 0:
            a, b, n = a + step, b + step, n + 1
        return n

    assert names.common(i, j).tolist() == [equal(a, b, 1) for a, b in zip(i, j, strict=True)]
    assert names.common(i, j, back=True).tolist() == [equal(a - 1, b - 1, -1) for a, b in zip(i, j, strict=True)]


@pytest.mark.parametrize("least,times", [(24, 3), (1, 2), (10, 4)])
def test_find_runs_brute_force(least, times, monkeypatch):
    monkeypatch.setattr(runs, "_AT_ONCE", 50)
    for seed in range(60):
        words = periodic_words(seed)
        ids = np.unique(words, return_inverse=True)[1]
        got = runs.find_runs(np.concatenate(([-1], ids, [-1])).astype(np.int64), len(words), least, times)
        assert [(int(s) - 1, int(n), int(q)) for s, n, q in zip(*got, strict=True)] == plain_runs(words, least, times), seed


def test_find_runs_beyond_the_highest_level(monkeypatch):
    monkeypatch.setattr(runs.Names.__init__, "__defaults__", (2,))
    test_find_runs_brute_force(24, 3, monkeypatch)


def odd_texts():
    return [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 50), (4, "a " * 50), (5, "\u00a0x\u2003y " * 30), (None, "b c " * 20), (6, "no run at all"), (7, " ".join(periodic_words(99)))]


def text_frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, runs long, `a.b` string")


def expected_op11(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(plain_collapse(words, found)))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("texts"))
    rows = odd_texts() + [(k, " ".join(periodic_words(k)) if k % 2 else "\n".join(f"l{v}" for v in range(k % 40))) for k in range(10, 260)]
    rows += [(300, "a <S> b c"), (301, "\U0001f600 \U0001f601x\u00e9 end  "), (302, "<<< P> < S>" * 5), (303, "  lead"), (304, "é" * 4000 + " tail")]
    text_frame(spark, rows).repartition(3).write.parquet(f"{where}/documents.parquet")
    return where, rows


def test_op11_brute_force(spark, tables):
    where, rows = tables
    got = sorted((tuple(r) for r in queries.op11_periodic_runs(spark, where).collect()), key=str)
    want = sorted((expected_op11(i, t) for i, t in rows), key=str)
    assert got == want
    assert sum(r[1] for r in got if r[0] and r[0] >= 10) > 40
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and t for i, t in rows)


def test_periodic_runs_parameters_and_empty_table(spark):
    docs = text_frame(spark, [(1, "x a b a b q")])
    out = runs.periodic_runs(docs, least=4, times=2).first()
    assert [tuple(r) for r in out["runs"]] == [(1, 4, 2)] and out["collapsed"] == b"x a b q"
    assert runs.periodic_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, times=1)


def test_a_text_of_one_word_repeated_stays_cheap():
    w = np.concatenate(([-1], np.zeros(200_000, np.int64), [-1]))
    assert [tuple(map(int, r)) for r in zip(*runs.find_runs(w, 200_000), strict=True)] == [(1, 200_000, 1)]


def expected_op12(doc_id, text):
    text = text or ""
    tokens = UNIT.findall(text)
    assert "".join(tokens) == text
    n = len(tokens)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


def test_op12_brute_force(spark, tables):
    where, rows = tables
    got = sorted((tuple(r) for r in queries.op12_fill_in_middle(spark, where).collect()), key=str)
    assert got == sorted((expected_op12(i, t) for i, t in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_units_by_every_grammar(spark):
    texts = ["", "a", " ", "a  b\n\nc ", "\U0001f600\U0001f601 e\u0301x_1,2;  z", "\n\n", "x\ry\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    patterns = {"word": UNIT, "line": re.compile(r"[^\n]*\n|[^\n]+"), "character": re.compile(r"[\s\S]")}
    for name, grammar in infill.GRAMMARS.items():
        got = [r[0] for r in df.select(infill.units(F.col("text"), grammar)).collect()]
        assert ["".join(u) for u in got] == texts
        if name in patterns:
            assert got == [patterns[name].findall(t) for t in texts], name
        assert all(u != "" for us in got for u in us)


def test_fill_in_middle_keeps_columns_and_restores(spark):
    rows = [(1, None, 2, "s"), (None, "a b", 1, "t"), (3, "", 1, "u")] + [(k, f"w{k} <P <S x<M>"[: 12 + k % 5] + " y" * (k % 7), 0, "v") for k in range(10, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, `form.x` string")
    for unit in infill.GRAMMARS:
        out = infill.fill_in_middle(docs, unit=unit, rate=90)
        back = out.select("row", "form", infill.restored(F.col("output"), F.col("form")).alias("text"))
        got = back.collect()
        assert len(got) == len(rows) and all(r["text"] == (r["row"]["text"] or "") for r in got) and got[0]["row"].asDict().keys() == {"doc_id", "text", "n", "form.x"}
    bad = spark.createDataFrame([("<P>a<M>b<S>c", "psm"), ("<S>a<P>b", "spm"), ("x<P>a<S>b<M>c", "psm")], "o string, f string")
    assert [r[0] for r in bad.select(infill.restored(F.col("o"), F.col("f"))).collect()] == [None] * 3
    assert infill.fill_in_middle(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        infill.fill_in_middle(docs, unit="clause")
    with pytest.raises(ValueError):
        infill.Markers("<a<", "<b<", "<c<")


HOSTILE = ["", "\\", "\\\\", "</turn>", "<\\/turn>", "<turn>user<says>", "a<", "<<says>\\<says>", "</turn>\n<turn>assistant<says>x", "\\### Assistant: </turn> ok", "\U0001f600\n", "<says", "\\n</turn"]


def conversation_rows():
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (0, 2, "assistant", "b"), (0, 3, "user", None), (0, 3, "user", None), (1, 5, "assistant", ""), (1, 1, "system", "s"), (2, None, None, "x"), (2, 1, None, "y"), (None, 1, "assistant", "n"), (None, 0, "user", "m")]
    rows += [(10 + k, t, ["user", "assistant", "assistant", "we<turn>ird\\"][(k + t) % 4], HOSTILE[(k * 3 + t) % len(HOSTILE)]) for k in range(40) for t in range(k % 9)]
    return rows


def expected_turns(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in out.items()}


@pytest.fixture(scope="module")
def conversations(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("chats"))
    df = spark.createDataFrame([(c, t, r, x, 1) for c, t, r, x in conversation_rows()], "conv_id long, turn long, role string, text string, segments long")
    df.repartition(3).write.parquet(f"{where}/conversations.parquet")
    return where


def test_op13_round_trip(spark, conversations):
    want = expected_turns([*conversation_rows(), (-7, 0, "user", HOSTILE[9]), (-7, 1, "assistant", HOSTILE[9])])
    got = {r["conv_id"]: r for r in queries.op13_chat_formatting(spark, conversations).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))


def test_blocks_masks_and_spans(spark, conversations):
    out = chat.format_conversations(spark.read.parquet(f"{conversations}/conversations.parquet")).cache()
    found = {r["conv_id"]: r for r in out.collect()}
    assert found[0]["formatted"] == "<turn>user<says>hi</turn>\n<turn>assistant<says>a<says>b</turn>\n<turn>user<says><says></turn>\n" and found[0]["n_turns"] == 5
    turns = expected_turns(conversation_rows())
    for c, r in found.items():
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
        assert sum(s["loss"] for s in r["segments"]) == sum(role == "assistant" for role, _ in turns[c])
    for r in chat.loss_spans(out).collect():
        text = found[r["conv_id"]]["formatted"]
        masked = [s["text"] for s in found[r["conv_id"]]["segments"] if s["loss"]]
        assert text[r["start"] : r["start"] + r["length"]] in masked
    assert chat.loss_spans(out).count() == sum(role == "assistant" for v in turns.values() for role, _ in v)
    out.unpersist()


def test_other_templates_and_empty_table(spark):
    t = chat.Template("[BOT", "[:", "[EOT]", trained=("model", "tool"))
    rows = spark.createDataFrame([(1, 0, "model", "[BOT [: [EOT] \\[EOT]"), (1, 1, "tool", "[")], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(rows, t).select("formatted", chat.read_turns(F.col("formatted"), t).alias("turns"), chat.trained_texts(F.col("segments"), t).alias("loss")).first()
    assert [tuple(x) for x in out["turns"]] == [("model", "[BOT [: [EOT] \\[EOT]"), ("tool", "[")] and out["loss"] == ["[BOT [: [EOT] \\[EOT]", "["]
    assert chat.format_conversations(rows.limit(0)).collect() == []
    for bad in (("<a>", "<a>", "<b>"), ("<a", "<ab", "<c"), ("<a<", "<b", "<c"), ("", "<b", "<c"), ("\\a", "\\b", "\\c")):
        with pytest.raises(ValueError):
            chat.Template(*bad)


@pytest.mark.parametrize("name,table", [("op12_fill_in_middle", "documents"), ("op13_chat_formatting", "conversations")])
def test_sql_agrees_on_odd_rows(spark, tables, conversations, name, table):
    where = tables[0] if table == "documents" else conversations
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{where}/{table}.parquet/*.parquet')")
    cur = db.execute(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, where)
    assert [d[0] for d in cur.description] == df.columns
    assert sorted(cur.fetchall(), key=str) == sorted((tuple(r) for r in df.collect()), key=str)
