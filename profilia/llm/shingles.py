"""Word-shingle sets of whole texts as 64-bit hashes, computed in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (shift-multiply rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offset and hash of every maximal run of bytes that aren't white space."""
    solid = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return begin, np.zeros(0, np.uint64)
    size = end - begin
    first = np.cumsum(size) - size
    power = np.full(int(size.max()), 0x5851F42D4C957F2D, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    h = np.add.reduceat(_BYTE[data[solid]] * power[place], first)
    return begin, mix(h + size.astype(np.uint64))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Per text its sorted distinct shingle hashes; fewer than WORDS words make one shingle, none make none."""
    begin, words = word_hashes(np.frombuffer(b" ".join(texts).translate(_LOWER), np.uint8))
    ends = np.cumsum([len(t) + 1 for t in texts])
    cut = np.concatenate(([0], np.searchsorted(begin, ends)))
    n = len(words)
    rows = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rows += words[k : k + len(rows)] * _STEP[k]
    rows = mix(rows)
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b - a >= WORDS:
            s = np.sort(rows[a : b - WORDS + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mix((words[a:b] * _STEP[: b - a]).sum(keepdims=True) + _STEP[7:] * np.uint64(b - a)))
        else:
            out.append(rows[:0])
    return out


def set_digest(s: np.ndarray) -> int:
    """63-bit digest of a shingle set: two independent sums over its members, mixed."""
    with np.errstate(over="ignore"):
        a = s.sum(dtype=np.uint64) + np.uint64(len(s)) * _STEP[5]
        b = mix(s ^ _STEP[6]).sum(dtype=np.uint64)
        return int(mix(np.array([mix(np.array([a]))[0] + b * _STEP[4]]))[0] >> np.uint64(1))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with about `most` bytes of text each (a longer text comes alone); nulls are empty."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
        start = total = 0
        for i, t in enumerate(texts):
            if i > start and total + len(t) > most:
                yield batch.slice(start, i - start), texts[start:i]
                start, total = i, 0
            total += len(t)
        if texts:
            yield batch.slice(start), texts[start:]
