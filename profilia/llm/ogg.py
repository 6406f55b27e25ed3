"""Ogg media columns: two logical streams (left, right) of 8-bit samples multiplexed into one physical stream.

Writing: a payload is taken as interleaved stereo samples; each channel becomes a logical stream of packets, packets
are laced into segments and pages, and each page carries its checksum and granule position (samples completed).
Reading: page checksums are verified, packets are reassembled from lacing values (over page ends too), logical
streams are separated by serial number, and timestamps follow from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import slices

BLOCK = 192
RATE = 48_000
PACKET = 4_000
SEGMENTS = 64
SERIALS = (1, 2)
_HEAD = struct.Struct("<4sBBqIIIB")
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """The checksum of Ogg (polynomial 04c11db7, most significant bit first, start 0) by way of the reflected one of zlib."""
    x = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{x:032b}"[::-1], 2)


def _pages(serial: int, packets: list[bytes], ends: list[int]) -> Iterator[tuple[int, bytes]]:
    """(granule position that orders it, page) of one logical stream; a packet may go on over several pages."""
    lacing: list[tuple[int, int | None]] = []  # segment size, granule position if a packet ends there
    for p, end in zip(packets, ends, strict=True):
        lacing += [(255, None)] * (len(p) // 255) + [(len(p) % 255, end)]
    data, at, seq, open_packet, clock = b"".join(packets), 0, 0, False, 0
    for i in range(0, len(lacing), SEGMENTS):
        part = lacing[i : i + SEGMENTS]
        size = sum(s for s, _ in part)
        done = [e for _, e in part if e is not None]
        flags = (1 if open_packet else 0) | (2 if i == 0 else 0) | (4 if i + SEGMENTS >= len(lacing) else 0)
        clock = done[-1] if done else clock
        head = (b"OggS", 0, flags, done[-1] if done else -1, serial, seq)
        table = bytes(s for s, _ in part)
        body = data[at : at + size]
        crc = page_crc(_HEAD.pack(*head, 0, len(part)) + table + body)
        yield clock, _HEAD.pack(*head, crc, len(part)) + table + body
        open_packet = part[-1][1] is None
        at, seq = at + size, seq + 1


def mux(payload: bytes) -> bytes:
    pages = []
    for serial in SERIALS:
        samples = payload[serial - 1 :: 2]
        packets = [b"\x01media" + struct.pack("<IB", RATE, serial)] + [samples[i : i + PACKET] for i in range(0, len(samples), PACKET)]
        ends = [0, *(min(i + PACKET, len(samples)) for i in range(0, len(samples), PACKET))]
        pages += [(clock, serial, k, page) for k, (clock, page) in enumerate(_pages(serial, packets, ends))]
    return b"".join(p for *_, p in sorted(pages, key=lambda x: (x[2] > 0, *x[:3])))


def demux(media: bytes) -> tuple[bytes, dict]:
    """The payload and what the container tells; ValueError for a damaged page, a lost page or a cut packet."""
    streams: dict[int, dict] = {}
    at = n_pages = 0
    while at < len(media):
        if len(media) - at < _HEAD.size:
            raise ValueError("cut page header")
        magic, version, flags, granule, serial, seq, crc, n = _HEAD.unpack_from(media, at)
        table = media[at + _HEAD.size : at + _HEAD.size + n]
        body = at + _HEAD.size + n
        end = body + sum(table)
        if magic != b"OggS" or version or len(table) < n or end > len(media):
            raise ValueError(f"no page at {at}")
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"bad checksum at {at}")
        s = streams.setdefault(serial, {"next": 0, "packets": [], "open": b"", "granule": 0, "times": []})
        if seq != s["next"] or bool(s["open"]) != bool(flags & 1):
            raise ValueError(f"page lost before {at}")
        s["next"] += 1
        for size in table:
            s["open"] += media[body : body + size]
            body += size
            if size < 255:
                s["packets"].append(s["open"])
                s["open"] = b""
        if granule >= 0:
            s["granule"] = granule
            s["times"].append(granule / RATE)
        at, n_pages = end, n_pages + 1
    if any(s["open"] for s in streams.values()):
        raise ValueError("cut packet")
    left, right = (b"".join(streams[k]["packets"][1:]) for k in SERIALS)
    out = np.empty(len(left) + len(right), np.uint8)
    out[::2], out[1::2] = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    return out.tobytes(), {"pages": n_pages, "packets": sum(len(s["packets"]) for s in streams.values()), "seconds": max(s["granule"] for s in streams.values()) / RATE}


def pad(text: bytes) -> bytes:
    return text + b" " * (max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(pad(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for part, media in slices(batches, "media"):
        rows = []
        for m in media:
            payload, info = demux(m)
            x = np.frombuffer(payload, np.uint8)
            loud = np.sqrt(np.square(x.astype(np.float32) - 128).mean(dtype=np.float64))
            feature = f"pages={info['pages']};packets={info['packets']};seconds={info['seconds']:.6f};mean={x.mean(dtype=np.float64):.4f};rms={loud:.4f}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature))
        cols = [pa.array(c) for c in zip(*rows, strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *cols], names=names)


def encode_media(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, media (an Ogg file): no shuffle, a text at a time.

    Null texts are empty and, like empty ones, padded to one block; long texts are whole; repeated rows and null ids
    stay; an empty table gives an empty result; further columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media -> digests and features of what is read back from the stored bytes."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(_features, schema)
