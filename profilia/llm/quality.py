"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters of WIDTH bytes run over each
chunk, each filter's maximum goes through a small dense layer to a chunk logit, and a document's probability is the
sigmoid of the mean of its chunks' logits. Training (Adam on the driver) uses a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import slices

WIDTH, FILTERS, HIDDEN = 6, 24, 16
#: Bytes in a cell, cells in a chunk, cells from one chunk's start to the next.
CELL, CHUNK, STEP = 64, 8, 7
#: The bound of the training sample: rows of each label, bytes of a text.
TRAIN_ROWS, TRAIN_BYTES = 2000, 65_536
EPOCHS, UPDATES, BATCH, RATE = 8, 600, 32, 0.01
THRESHOLD = 0.3
_PAD = 256


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded to whole cells; the cells of every chunk; chunks of each text."""
    cells = np.array([-(-(len(t) + WIDTH) // CELL) for t in texts])
    first = np.cumsum(cells) - cells
    data = np.full(int(cells.sum()) * CELL + WIDTH, _PAD, np.int16)
    for t, a in zip(texts, first * CELL, strict=True):
        data[a : a + len(t)] = np.frombuffer(t, np.uint8)
    chunks = np.maximum(1, -(-(cells - 1) // STEP))
    owner = np.repeat(np.arange(len(texts)), chunks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    at = np.minimum((nth * STEP)[:, None] + np.arange(CHUNK), (cells[owner] - 1)[:, None]) + first[owner][:, None]
    return data, at, chunks


def _convolve(data: np.ndarray, w: np.ndarray) -> np.ndarray:
    n = len(data) - WIDTH
    out = w[0].take(data[:n], axis=0)
    for k in range(1, WIDTH):
        out += w[k].take(data[k : k + n], axis=0)
    return out


def _sum_by(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, np.cumsum(counts) - counts)


def scores(texts: list[bytes], model: dict) -> np.ndarray:
    if not len(texts):
        return np.zeros(0)
    data, at, chunks = _layout(texts)
    step = 1024 * CELL
    cells = [_convolve(data[i : min(i + step, len(data) - WIDTH) + WIDTH], model["w"]).reshape(-1, CELL, FILTERS).max(1) for i in range(0, len(data) - WIDTH, step)]
    top = np.concatenate(cells)[at].max(1)
    logit = np.maximum(0, top @ model["a"] + model["b"]) @ model["c"] + model["d"][0]
    return 1 / (1 + np.exp(-np.clip(_sum_by(logit.astype(float), chunks) / chunks, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> dict:
    """Weights learned from the sample; without rows of both labels, weights that score everything 0.5."""
    rng = np.random.default_rng(seed)
    m = {
        "w": rng.normal(0, 0.15, (WIDTH, 257, FILTERS)).astype(np.float32),
        "a": rng.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)).astype(np.float32),
        "b": np.zeros(HIDDEN, np.float32),
        "c": rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32),
        "d": np.zeros(1, np.float32),
    }
    if not 0 < labels.sum() < len(labels):
        return {k: np.zeros_like(v) for k, v in m.items()}
    m["w"][:, _PAD] = 0
    mean, square, t = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    epochs = max(EPOCHS, -(-UPDATES * BATCH // len(texts)))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            data, at, chunks = _layout([texts[j] for j in pick])
            x = _convolve(data, m["w"]).reshape(-1, CELL, FILTERS)
            arg = x.argmax(1)
            cell = np.take_along_axis(x, arg[:, None], 1)[:, 0]
            which = cell[at].argmax(1)
            cells = np.take_along_axis(at, which, 1)  # (chunks, filters): the cell that holds the maximum
            top = cell[cells, np.arange(FILTERS)]
            pre = top @ m["a"] + m["b"]
            hid = np.maximum(0, pre)
            logit = hid @ m["c"] + m["d"][0]
            p = 1 / (1 + np.exp(-np.clip(_sum_by(logit, chunks) / chunks, -30, 30)))
            g = np.repeat((p - labels[pick]) / chunks / len(pick), chunks).astype(np.float32)
            g_hid = np.outer(g, m["c"]) * (pre > 0)
            g_top = g_hid @ m["a"].T
            place = cells * CELL + arg[cells, np.arange(FILTERS)]
            g_w = np.zeros_like(m["w"])
            for k in range(WIDTH):
                np.add.at(g_w[k], (data[place + k], np.arange(FILTERS)[None, :].repeat(len(place), 0)), g_top)
            g_w[:, _PAD] = 0
            t += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for k, grad in {"w": g_w, "a": top.T @ g_hid, "b": g_hid.sum(0), "c": hid.T @ g, "d": g.sum(keepdims=True)}.items():
                mean[k] += 0.1 * (grad - mean[k])
                square[k] += 0.001 * (grad * grad - square[k])
                m[k] -= rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
    return m


def held_out(doc_id) -> F.Column:
    """Rows that take no part in learning: crc32 of the id as text is a multiple of 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model learned from at most TRAIN_ROWS labelled rows of each label, outside the held-out rows.

    The sample is the first ids in hash order; texts over TRAIN_BYTES don't enter it. Null texts or labels don't either; of
    rows with the same id the last by text does.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null")
    known = known.where(~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"])
    of = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS) for q in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= TRAIN_BYTES)
    found = texts.join(F.broadcast(of[0].union(of[1])), "doc_id").groupBy("doc_id", "quality").agg(F.max("text").alias("text"))
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])  # at most 2 * TRAIN_ROWS, one for each id
    return train([r["text"].encode() for r in rows], np.array([r["quality"] for r in rows], float))


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text", 1 << 20):
            names = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(scores(texts, model.value), pa.float64())], names=[*names, "score"])

    return run


def _keeper(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text", 1 << 20):
            yield part.filter(pa.array(scores(texts, model.value) >= threshold))

    return run


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) and labels (doc_id, quality, ...) -> doc_id, held_out, score, predicted.

    Null texts score as empty ones; repeated rows and null ids stay; an empty table of docs gives an empty result, one of
    labels a score of 0.5; texts of any length are read whole; further columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_scorer(model), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, all_docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(fit(all_docs, labels))
    return docs.mapInArrow(_keeper(model, threshold), docs.schema)
