"""Periodic runs of words: stretches that repeat themselves at least a few times over, and the texts without the repetitions.

Names of all stretches of 1, 2, 4, ... words tell whether two such stretches are equal (Karp, Miller and Rosenberg): a level's names
come from sorting pairs of names of the level below, so equality is exact, without hashes or suffix sorting. A run of period q
matches itself q words on over an interval, and the interval covers a point of a grid as wide as q allows; points whose names
agree are extended both ways by descending the levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import slices

#: The highest level; longer extensions repeat it, so the names of a text take at most 4 * (LEVELS + 1) bytes a word.
LEVELS = 16
#: Grid points extended at once; a bound on memory, of no effect on results.
_AT_ONCE = 1 << 17
_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _ranked(keys: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, bool]:
    """Names of the n places: equal keys at different places share a number from 0 up, any other place has a negative one of its own."""
    names = -1 - np.arange(n, dtype=np.int32)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return names, False
    group = np.concatenate(([0], np.cumsum(~same))).astype(np.int32)
    repeated = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    names[at[order[repeated]]] = group[repeated]
    return names, True


class Names:
    """levels[k][i] == levels[k][j] for i != j says that the 2**k words from i and from j are the same."""

    def __init__(self, words: np.ndarray, top: int = LEVELS):
        """words: a number for each word; negative ones equal nothing and must stand at both ends."""
        n = len(words)
        at = np.flatnonzero(words >= 0)
        names, any_ = _ranked(words[at], at, n)
        self.levels, width = [names], 1
        while any_ and len(self.levels) <= top:
            at = np.flatnonzero(names[: max(0, n - width)] >= 0)
            at = at[names[at + width] >= 0]
            names, any_ = _ranked(names[at].astype(np.int64) << 32 | names[at + width], at, n)
            width *= 2
            if any_:
                self.levels.append(names)
        #: whether no longer stretch occurs twice
        self.complete = not any_

    def common(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """Number of equal words from i and from j (i < j) on, or before them."""
        done, top, live = np.zeros(len(i), np.int64), len(self.levels) - 1, np.arange(len(i))
        while len(live):  # the highest level as often as it agrees
            live = self._step(top, i, j, done, live, back)
        for k in range(top - 1, -1, -1):
            self._step(k, i, j, done, np.arange(len(i)), back)
        return done

    def _step(self, k: int, i: np.ndarray, j: np.ndarray, done: np.ndarray, live: np.ndarray, back: bool) -> np.ndarray:
        names, size = self.levels[k], 1 << k
        if back:
            a = i[live] - done[live] - size
            live, a = live[a >= 0], a[a >= 0]
            b = a + (j - i)[live]
        else:
            a, b = i[live] + done[live], j[live] + done[live]
        live = live[names[a] == names[b]]
        done[live] += size
        return live


def find_runs(words: np.ndarray, longest: int, least: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every run of length >= max(least, times * period), by start, then period.

    words as for Names; longest: the most words between two negative ones.
    """
    names = Names(words)
    found, hits, periods, waiting = [], [], [], 0

    def extend() -> None:
        i, q = np.concatenate(hits), np.concatenate(periods)
        before, after = names.common(i, i + q, back=True), names.common(i, i + q)
        rows = np.stack([i - before, before + after + q, q], 1)
        found.append(np.unique(rows[rows[:, 1] >= np.maximum(least, times * q)], axis=0))

    for q in range(1, longest // times + 1):
        fits = max(least - q, (times - 1) * q)  # words that must agree with those q on
        k = ((fits + 1) // 2).bit_length() - 1
        if k >= len(names.levels):
            if names.complete:
                break  # no stretch as long as that occurs twice
            k = len(names.levels) - 1
        grid = fits - (1 << k) + 1
        level = names.levels[k]
        at = np.flatnonzero(level[:-q:grid] == level[q::grid])
        if len(at):
            hits.append(at * grid)
            periods.append(np.full(len(at), q))
            waiting += len(at)
            if waiting >= _AT_ONCE:
                extend()
                hits, periods, waiting = [], [], 0
    if waiting:
        extend()
    rows = np.concatenate([np.zeros((0, 3), np.int64), *found])
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.diff(rows[:, :2], axis=0, prepend=-1).any(1)]  # multiples of a period give the same stretch
    return tuple(rows[np.lexsort((rows[:, 2], rows[:, 0]))].T)


def _collapse(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            words = [t.split() for t in texts]  # bytes are split at the six ASCII blanks only
            sizes = np.array([len(w) for w in words])
            begin = np.cumsum(sizes + 1) - sizes  # of each text, after a place that equals nothing
            flat = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
            place = np.arange(len(flat)) + np.repeat(np.arange(1, len(words) + 1), sizes)
            ids = np.full(len(flat) + len(words) + 1, -1, np.int64)
            ids[place] = flat.indices.to_numpy(zero_copy_only=False) + np.repeat(np.arange(len(words)) * len(flat.dictionary), sizes)
            start, length, period = find_runs(ids, int(sizes.max()), least, times)
            of = np.searchsorted(begin, start, side="right") - 1
            change = np.zeros(len(ids) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            gone = np.cumsum(change) > 0
            kept = []
            for k, ws in enumerate(words):
                off = gone[begin[k] : begin[k] + len(ws)]
                kept.append(b" ".join(ws if not off.any() else [ws[i] for i in np.flatnonzero(~off)]))
            runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start - begin[of], length, period)], names=["start", "length", "period"])
            cuts = pa.array(np.searchsorted(of, np.arange(len(words) + 1)), pa.int32())
            cols = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(cuts, runs), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, runs (start, length, period; by start, then period), collapsed; no shuffle.

    Words are what stands between the blanks \\x20 and \\x09-\\x0D. A run has at least `least` words and `times` periods (2 or more) and isn't
    part of a longer one of its period. collapsed: UTF-8 bytes of the words, joined by single blanks, but for those that a run holds after
    its first period. Null and empty texts have no words and no runs; null ids and repeated rows stay; texts of any length are whole, in
    memory in proportion to their words; an empty table gives an empty result; further columns, whatever their names, are ignored.
    """
    if times < 2:
        raise ValueError("a run has at least two periods")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_collapse(least, times), f"doc_id long, n_words long, runs {_RUNS}, collapsed binary")


def strongest(runs: str = "runs"):
    """The run with the greatest exact length / period, the first of them by start, then period; null if there is none."""
    better = lambda acc, x: acc.isNull() | (x["length"] * acc["period"] > acc["length"] * x["period"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, lambda acc, x: F.when(better(acc, x), x).otherwise(acc))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document by the checksum h of its id repeats a stretch of its own words.

    With g = h div 10 and n words, those from a = g mod n on repeat the first 1 + (n - a) div (3 + g mod 8) of them. A null id has no
    checksum, so its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text").cast("string"), r"[ \t-\r]+"), lambda w: w != "")

    def repeat(x):
        n, g = F.size(x["words"]).cast("long"), F.floor(x["h"] / 10)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i)
        return F.array_join(F.transform(x["words"], lambda _, i: x["words"][at(i.cast("long")).cast("int")]), " ")

    whole = F.transform(F.array(F.struct(words.alias("words"), h.alias("h"))), repeat)[0]  # words are made once
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when((h % 10 == 0) & F.rlike(F.col("text").cast("string"), F.lit(r"[^ \t-\r]")), whole).otherwise(F.col("text")).alias("text"))
