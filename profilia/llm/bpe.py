"""BPE encoding and decoding by a tokenization automaton.

Compilation. The merges are applied in order, one gadget each, to an automaton over tokens whose states say which token was read last. The
gadget of a merge (u, v) -> w takes the arc v away from the state after u, adds the arc w to every state that has the arc u, and
gives w a state of its own, a copy of the state after v. What a gadget took, when each arc came and which state each one copies
is kept in place of whole copies. Then each arc's label is spelled out in bytes, and the subset construction makes the
automaton deterministic: a state is the set of arcs that are under way, each with the token before it, and the byte that
completes an arc emits its token. Rows of the transition table are filled when a worker first needs them; a filled row is never decided again.

Encoding. A pre-split word costs one look-up in the table for each byte. The token that ends at a byte is the one on the arc taken there
(a prefix has one accepted path), so the word's tokens are read back from its last byte. Decoding emits the labels of arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import slices

END = "</w>"
#: Distinct words that a Python worker keeps in a generation, of which it has two, and states of its table.
KEPT_WORDS, KEPT_STATES = 250_000, 400_000
#: Code points that the published tokenizer's library takes for letters and digits beyond Unicode 15.1, and lowers or composes.
_NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
_NEW_DIGITS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
_NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, **{c: c + 32 for c in range(0x10D50, 0x10D66)}, **{c: c + 27 for c in range(0x16EA0, 0x16EB9)}}
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same split for texts of ASCII and composed Latin letters only, and what such texts don't hold; both are in normal form C already.
_LATIN = "a-z\u00df-\u00f6\u00f8-\u017f"
_LATIN_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\s{_LATIN}0-9]+", re.ASCII)
_OTHER = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]")


@cache
def _word_pattern() -> re.Pattern:
    """The split of the published tokenizer for any text: contractions, letters, single digits, others."""
    kinds: dict[str, list[list[int]]] = {"L": [list(x) for x in _NEW_LETTERS], "N": [list(x) for x in _NEW_DIGITS]}
    for c in range(0x110000):
        found = kinds.get(unicodedata.category(chr(c))[0])
        if found is not None:
            if found[-1][1] == c - 1:
                found[-1][1] = c
            else:
                found.append([c, c])
    letters, digits = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in kinds[k]) for k in "LN")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{_SPACE}{letters}{digits}]+")


def byte_labels() -> list[str]:
    """The printable character that stands for each byte: itself where it shows, else the next one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in shown else chr(spare))
        spare += b not in shown
    return out


class Automaton:
    """labels: token text by id (None where absent); merges: pairs of texts in order; special: text -> id."""

    def __init__(self, labels: list[str], merges: list[tuple[str, str]], special: dict[str, int]):
        self.labels, self.special = labels, special
        self.ids = {t: i for i, t in enumerate(labels) if t is not None and i not in special.values()}
        self.made: dict[int, tuple[int, int, int]] = {}  # arc -> left, right, time
        self.taken: dict[tuple[int, int], int] = {}  # (state, arc) -> time
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        for time, (a, b) in enumerate(merges):
            u, v = self.ids[a], self.ids[b]
            alive = self._has(u, v, time)
            self.taken[u, v] = time
            if alive:
                self.made[self.ids[a + b]] = (u, v, time)
        # the arcs' labels spelled out: a node for each beginning of a label, with the tokens that end there
        self.onward: list[dict[str, int]] = [{}]
        self.inner, self.final = [-1], [-1]
        for t, i in self.ids.items():
            name = t.removesuffix(END)
            if len(name) > 1 and i not in self.made:
                continue
            k = 0
            for c in name:
                if c not in self.onward[k]:
                    self.onward[k][c] = len(self.onward)
                    self.onward.append({})
                    self.inner.append(-1)
                    self.final.append(-1)
                k = self.onward[k][c]
            (self.final if t.endswith(END) and t != END else self.inner)[k] = i
        self._clear()
        self.split = regex.compile("|".join(map(regex.escape, special))) if special else None

    def _clear(self) -> None:
        """A table of the start state only."""
        self.next: list[dict[str, int]] = [{}]
        self.last: list[dict[str, tuple[int, int]]] = [{}]
        self.emits: list[tuple[int, int]] = [(-1, 0)]  # token on the arcs into a state and its length
        self.under_way: list[tuple] = [((-1, 0, 0),)]  # (token before, node, bytes read)
        self.states: dict[tuple, int] = {self.under_way[0]: 0}

    def _has(self, t: int, x: int, time: int) -> bool:
        """Whether the state after token t has arc x once the gadgets before `time` are applied."""
        while True:
            if self.taken.get((t, x), time) < time:
                return False
            born = self.made[t][2] if t in self.made else -1
            if x not in self.made:
                if born < 0:
                    return True
                t, time = self.made[t][1], born
                continue
            left, right, came = self.made[x]
            if came >= time:
                return False
            if came < born:
                t, time = self.made[t][1], born
            elif came == born:
                t, x, time = self.made[t][1], left, came
            elif self.taken.get((t, left)) == came:
                return False
            else:
                x, time = left, came

    def _fill(self, state: int, c: str) -> int:
        """The transition of a state by a byte that doesn't end the word."""
        ahead, done = [], None
        for t, node, n in self.under_way[state]:
            node = self.onward[node].get(c)
            if node is None:
                continue
            x = self.inner[node]
            if done is None and x >= 0 and (t < 0 or self._has(t, x, 1 << 60)):
                done = (x, n + 1)
            if self.onward[node]:
                ahead.append((t, node, n + 1))
        if done is None:
            raise ValueError(f"no arc for {c!r}")
        key = (*ahead, (done[0], 0, 0))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.next)
            self.next.append({})
            self.last.append({})
            self.emits.append(done)
            self.under_way.append(key)
        self.next[state][c] = to
        return to

    def _fill_last(self, state: int, c: str) -> tuple[int, int]:
        """The token that a word's last byte completes, and its length."""
        for t, node, n in self.under_way[state]:
            node = self.onward[node].get(c)
            x = -1 if node is None else self.final[node]
            if x >= 0 and (t < 0 or self._has(t, x, 1 << 60)):
                self.last[state][c] = (x, n + 1)
                return x, n + 1
        raise ValueError(f"no last arc for {c!r}")

    def path(self, word: str) -> list[int]:
        """Ids of the accepted path of a non-empty word, given as byte labels."""
        if len(self.next) > KEPT_STATES:
            self._clear()
        table, s, way = self.next, 0, []
        for c in word[:-1]:
            to = table[s].get(c)
            s = self._fill(s, c) if to is None else to
            way.append(s)
        x, n = self.last[s].get(word[-1]) or self._fill_last(s, word[-1])
        out, i = [x], len(word) - n
        while i:
            x, n = self.emits[way[i - 1]]
            out.append(x)
            i -= n
        return out[::-1]

    def _ids_of(self, word: str) -> bytes:
        if len(self.words) >= KEPT_WORDS:
            self.older, self.words = self.words, {}
        found = self.words.get(word) or self.older.get(word)
        if found is None:
            ids = self.path(word.encode().decode("latin-1").translate(_table()))
            found = struct.pack(f"<{len(ids)}I", *ids)
        self.words[word] = found
        return found

    def _plain(self, text: str) -> bytes:
        if not _OTHER.search(text):
            found = _LATIN_WORD.findall(text.lower())
        else:
            text = unicodedata.normalize("NFC", text).translate(_NEW_LOWER).replace("Σ", "σ")  # a final sigma is lowered like any other
            found = _word_pattern().findall(text.lower())
        words = self.words
        return b"".join([words.get(w) or self._ids_of(w) for w in found])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special tokens' texts are theirs."""
        if not self.split or not self.split.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, set apart by blanks as the published tokenizer does."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def _table() -> dict[int, str]:
    return dict(enumerate(byte_labels()))


_loaded: dict[str, Automaton] = {}


def load_rules(path: str) -> dict:
    """What the automaton needs of a tokenizer file: labels by id, merges, special tokens (a few MB, bounded by the vocabulary)."""
    d = json.loads(Path(path).read_text())
    special = {t["content"]: t["id"] for t in d["added_tokens"]}
    labels: list = [None] * (1 + max([*d["model"]["vocab"].values(), *special.values()]))
    for t, i in [*d["model"]["vocab"].items(), *special.items()]:
        labels[i] = t
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in d["model"]["merges"]]
    return {"labels": labels, "merges": merges, "special": special}


def default_rules() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _coder(rules, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _loaded:
            _loaded[key] = Automaton(**rules.value)
        a = _loaded[key]
        for part, texts in slices(batches, "text"):
            ids = [a.encode(t.decode()) for t in texts]
            rest = [c for c in part.schema.names if c != "text"]
            coded = [pa.array(ids, pa.binary()), pa.array([a.decode(i) for i in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *coded], names=[*rest, "ids", "decoded"])

    return run


def encode_documents(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, the string columns in `keep`, ids (packed unsigned 32-bit), decoded; no shuffle.

    Null and empty texts have no ids; repeated rows and null ids stay; long texts are whole, words of any length
    take time in proportion to it; an empty table gives an empty result; further columns are ignored.
    """
    rules = load_rules(path)
    key = hashlib.sha256(json.dumps([rules["labels"], rules["merges"]]).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(rules)
    keep = keep or []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in keep], F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_coder(shared, key), ", ".join(["doc_id long", *[f"`{c}` string" for c in keep], "ids binary", "decoded string"]))


def digests(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
