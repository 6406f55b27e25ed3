"""Fill-in-the-middle documents: a text is cut at two unit boundaries and its parts are put in another order, with markers.

What a unit is, is said by a grammar of neighbouring character classes. A grammar becomes one zero-width pattern, a look behind and a
look ahead for each pair of classes between which a unit ends, and Spark's split at that pattern keeps every character.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK, SOLID, ANY = r"[ \t-\r]", r"[^ \t-\r]", r"[\s\S]"

#: Unit grammars: pairs of classes (the character before, the character after) between which one unit ends and the next begins.
GRAMMARS: dict[str, tuple[tuple[str, str], ...]] = {
    "word": ((SOLID, BLANK),),  # blanks and the word after them; blanks at the end are a unit
    "line": ((r"\n", ANY),),  # a line with its line feed
    "character": ((ANY, ANY),),
    "part": ((SOLID, BLANK), (r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_ \t-\r]"), (r"[^\p{L}\p{N}_ \t-\r]", r"[\p{L}\p{N}_]")),  # words, and marks apart from letters and digits
}


@dataclass(frozen=True)
class Markers:
    """Strings that stand before the prefix, the suffix and the middle; of equal length, none overlapping another or itself."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        all_ = (self.prefix, self.suffix, self.middle)
        if len(set(all_)) < 3 or len({len(m) for m in all_}) > 1 or any(a[-k:] == b[:k] for a in all_ for b in all_ for k in range(1, len(a))) or not self.prefix:
            raise ValueError("markers must differ, be of equal length and not overlap")


def boundary(grammar: tuple[tuple[str, str], ...]) -> str:
    """The zero-width pattern of a grammar's unit boundaries."""
    return "|".join(f"(?<={before})(?={after})" for before, after in grammar)


def units(text: Column, grammar: tuple[tuple[str, str], ...]) -> Column:
    """The units of a text, in order; joined they are the text. An empty text has none (split alone would give one empty piece)."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once for each row however often it is used."""
    return F.transform(F.array(value), use)[0]


def fill_in_middle(docs: DataFrame, unit: str = "word", seed: int = 42, rate: int = 50, spm_rate: int = 80, markers: Markers = Markers()) -> DataFrame:
    """docs (doc_id, text, ...) -> row (all columns of docs), n (units), form, prefix, middle, suffix, output; no shuffle, no Python.

    `rate` percent of the texts are cut, of these `spm_rate` percent begin with the suffix (spm), the others with the prefix (psm). The
    draws come from the SHA-256 of seed and doc_id, so reruns agree and equal ids are cut by the same numbers. Empty texts and texts that
    hold a marker stay as they are (plain; their parts are null). A null text is empty, a null doc_id counts as an empty id; repeated rows
    stay; texts of any length are whole; an empty table gives an empty result; columns of any name are kept in row.
    """
    if unit not in GRAMMARS:
        raise ValueError(f"unit must be one of {sorted(GRAMMARS)}")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draw = lambda h, k: F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")
    m = (markers.prefix, markers.suffix, markers.middle)

    def cut(x: Column) -> Column:
        n = F.size(x["units"]).cast("long")
        a, b = F.pmod(draw(x["h"], 0), n + 1), F.pmod(draw(x["h"], 1), n + 1)
        lo, hi = F.least(a, b).cast("int"), F.greatest(a, b).cast("int")
        piece = lambda start, end: F.array_join(F.slice(x["units"], start + 1, end - start), "")
        held = F.contains(x["text"], F.lit(m[0])) | F.contains(x["text"], F.lit(m[1])) | F.contains(x["text"], F.lit(m[2]))
        plain = (n == 0) | held | (draw(x["h"], 2) % 100 >= rate)
        form = F.when(plain, "plain").when(draw(x["h"], 3) % 100 < spm_rate, "spm").otherwise("psm")
        part = lambda c: F.when(~plain, c)
        return F.struct(n.alias("n"), form.alias("form"), part(piece(F.lit(0), lo)).alias("prefix"), part(piece(lo, hi)).alias("middle"), part(piece(hi, n.cast("int"))).alias("suffix"), x["text"].alias("text"))

    parts = _let(F.struct(text.alias("text"), units(text, GRAMMARS[unit]).alias("units"), digest.alias("h")), cut)
    put = lambda x, order: F.concat(*[c for mark, name in order for c in (F.lit(mark), x[name])])
    x = F.col("x")
    output = F.when(x["form"] == "plain", x["text"]).when(x["form"] == "psm", put(x, [(m[0], "prefix"), (m[1], "suffix"), (m[2], "middle")])).otherwise(put(x, [(m[1], "suffix"), (m[0], "prefix"), (m[2], "middle")]))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), parts.alias("x"))
    return rows.select("row", *[x[c].alias(c) for c in ("n", "form", "prefix", "middle", "suffix")], output.alias("output"))


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text of an output and its form, read at the markers; null if markers are missing or in a wrong order."""
    pattern = "|".join(f"\\Q{m}\\E" for m in (markers.prefix, markers.suffix, markers.middle))
    size = len(markers.prefix)

    def read(x: Column) -> Column:
        p = x["parts"]
        second, third = F.char_length(p[1]) + size, F.char_length(p[1]) + F.char_length(p[2]) + 2 * size
        marks = F.concat(F.substring(x["output"], 1, size), F.substring(x["output"], second + 1, F.lit(size)), F.substring(x["output"], third + 1, F.lit(size)))
        psm = (form == "psm") & (marks == markers.prefix + markers.suffix + markers.middle)
        spm = (form == "spm") & (marks == markers.suffix + markers.prefix + markers.middle)
        return F.when((F.size(p) == 4) & (p[0] == "") & psm, F.concat(p[1], p[3], p[2])).when((F.size(p) == 4) & (p[0] == "") & spm, F.concat(p[2], p[3], p[1]))

    return F.when(form == "plain", output).otherwise(_let(F.struct(output.alias("output"), F.split(output, pattern, -1).alias("parts")), read))
