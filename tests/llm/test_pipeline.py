"""The stages of corpus_pipeline on odd rows, each against a plain version of what it keeps."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from profilia.llm import bpe, mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(6)
    words = [f"word{k}" for k in range(300)]
    good = [" ".join(rng.choice(words, 40)) for _ in range(60)]
    bad = [" ".join(f"{w}!!###" for w in rng.choice(words, 40)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(good + bad)]
    rows += [(200, good[0]), (201, good[1] + "\n" + good[2]), (202, None), (203, ""), (None, good[3]), (204, good[4]), (204, good[4]), (205, " ".join(good) * 3), (206, " ".join(good[5].split()[:38] + ["x", "y"]))]
    full = [(i, t, "en", f"s{k % 3}" if k % 7 else None, len(t or ""), "r") for k, (i, t) in enumerate(rows)]
    at = f"file://{tmp_path_factory.mktemp('corpus')}"
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k < 60), 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def words(text):
    return [w for w in (text or "").split()]


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources", "BPE encoding and decoding"]
    stages = dict(corpus_pipeline.STAGES)

    def stage(name, rows):
        out = stages[name](spark, rows, tables)
        out.write.parquet(f"file://{tmp_path}/{name[:4]}")
        return spark.read.schema(out.schema).parquet(f"file://{tmp_path}/{name[:4]}")

    kept = stage("quality classifier", docs)
    model = quality.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    rows = docs.collect()
    score = quality.scores([(r["text"] or "").encode() for r in rows], model)
    assert kept.columns == docs.columns and plain(kept) == sorted((tuple(r) for r, s in zip(rows, score, strict=True) if s >= quality.THRESHOLD), key=str)

    lines = stage("line dedup", kept)
    assert lines.columns == docs.columns and lines.count() == kept.count()
    left = [x for r in lines.collect() for x in (r["text"] or "").split("\n") if x.strip()]
    assert len(left) == len(set(left)) and all(r["n_chars"] == len(r["text"]) for r in lines.collect() if r["text"] is not None)

    one = stage("n-gram Jaccard join", lines)
    assert one.columns == docs.columns
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words(r["text"]) for r in one.collect()) if len(w) >= 5]
    assert all(4 * len(a & b) < 3 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert {w for r in one.collect() for w in words(r["text"])} == {w for r in lines.collect() for w in words(r["text"])}

    mixed = stage("mixing sources", one)
    taken = mixing.taken_words(mixing.mix_sources(one)).agg(F.sum("taken")).first()[0]
    assert mixed.columns == docs.columns and sum(len(words(r["text"])) for r in mixed.collect()) == taken

    coded = stage("BPE encoding and decoding", mixed).collect()
    a = bpe.Automaton(**bpe.load_rules(bpe.default_rules()))
    want = sorted(((r["doc_id"], a.encode(r["text"] or "")) for r in mixed.collect()), key=str)
    assert sorted(((r["doc_id"], bytes(r["ids"])) for r in coded), key=str) == want
    assert all(r["decoded_sha256"] == hashlib.sha256(a.decode(bytes(r["ids"])).encode()).hexdigest() for r in coded)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), tables).count() == 0, name
