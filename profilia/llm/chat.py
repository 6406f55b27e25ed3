"""Conversations as single training texts, with a loss mask, in Spark expressions only.

A conversation's turns are collected and sorted, adjacent turns of one role are merged into one block, and blocks are concatenated:

    <turn>user<says>first text<says>second text</turn>\n<turn>assistant<says>answer</turn>\n

Control strings inside texts and roles are broken by a backslash after their first character, and backslashes are doubled, so no
escaped text holds a control string and reading back is exact.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings: before a block's role, before each of its texts, after the block; and the roles that are trained on.

    They begin with a character that occurs in none of them again and isn't a backslash, so none can begin inside a text and end outside.
    """

    turn: str = "<turn>"
    says: str = "<says>"
    end: str = "</turn>\n"
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        c = self.turn[:1]
        control = (self.turn, self.says, self.end)
        if not c or c == "\\" or any(s[:1] != c or c in s[1:] or "\\" in s or len(s) < 2 for s in control) or len(set(control)) < 3:
            raise ValueError("control strings must begin with one character that occurs in none of them again")
        if any(a != b and b.startswith(a) for a in control for b in control):
            raise ValueError("no control string may begin another")

    def escape(self, text: Column) -> Column:
        rest = "|".join(re.escape(s[1:].strip("\n")) for s in (self.turn, self.says, self.end))
        return F.regexp_replace(text, rf"\\|(?<={re.escape(self.turn[0])})(?={rest})", r"\\$0")

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """rows (conv_id, turn, role, text, ...) -> conv_id, n_turns, segments (text, loss), formatted.

    formatted is the concatenation of the segments' texts; loss marks those that are trained on: the escaped texts of trained roles, and
    nothing else. Turns go by turn (null first), then role, then text; repeated rows are turns of their own; a null text or role is empty;
    rows with a null conv_id form one conversation. A conversation is one value of the result, so it is collected in one row; its size is
    bounded by what a row can hold, and all steps take time in proportion to it. Very long texts are whole; an empty table gives an empty
    result; further columns, whatever their names, are left out.
    """
    t = template
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select("conv_id", F.struct(F.col("turn"), empty("role").alias("role"), empty("text").alias("text")).alias("x"))
    sorted_ = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    # places where a role begins, and the end of the last one: each pair of neighbours bounds a block
    begins = F.filter(F.transform("turns", lambda x, i: F.when((i == 0) | (x["role"] != F.col("turns")[F.greatest(i - 1, F.lit(0))]["role"]), i)), lambda i: i.isNotNull())
    bounds = sorted_.select("conv_id", F.transform("turns", lambda x: t.escape(x["text"])).alias("texts"), F.col("turns.role").alias("roles"), F.concat(begins, F.array(F.size("turns"))).alias("bounds"))
    block = lambda i, k: F.struct(F.col("roles")[i].alias("role"), F.slice("texts", i + 1, F.col("bounds")[k + 1] - i).alias("texts"))
    blocks = bounds.select("conv_id", F.size("roles").cast("long").alias("n_turns"), F.transform(F.slice("bounds", 1, F.size("bounds") - 1), block).alias("blocks"))

    def segments(b: Column) -> Column:
        head = F.concat(F.lit(t.turn), t.escape(b["role"]), F.lit(t.says))
        piece = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
        merged = F.array(piece(F.concat(head, F.array_join(b["texts"], t.says), F.lit(t.end)), False))
        inner = F.flatten(F.transform(b["texts"], lambda x, i: F.array(piece(F.when(i == 0, head).otherwise(t.says), False), piece(x, True))))
        return F.when(b["role"].isin(*t.trained), F.concat(inner, F.array(piece(F.lit(t.end), False)))).otherwise(merged)

    out = blocks.select("conv_id", "n_turns", F.flatten(F.transform("blocks", segments)).alias("segments"))
    return out.select("conv_id", "n_turns", "segments", F.array_join("segments.text", "").alias("formatted"))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation, in order."""
    t = template

    def turns(block: Column) -> Column:
        parts = F.split(F.substring(block, len(t.turn) + 1, 2**31 - 1), re.escape(t.says), -1)
        return F.transform(F.array(parts), lambda p: F.transform(F.slice(p, 2, F.size(p)), lambda x: F.struct(t.unescape(p[0]).alias("role"), t.unescape(x).alias("text"))))[0]

    blocks = F.filter(F.split(formatted, re.escape(t.end), -1), lambda b: b != "")
    return F.flatten(F.transform(blocks, turns))


def trained_texts(segments: Column, template: Template = Template()) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"]))


def loss_spans(formatted: DataFrame) -> DataFrame:
    """Formatted conversations -> conv_id, start, length: the code points of `formatted` that are trained on, a row for each span."""
    each = formatted.select("conv_id", F.posexplode("segments").alias("k", "s")).select("conv_id", "k", "s.loss", F.char_length("s.text").cast("long").alias("length"))
    before = F.sum("length").over(Window.partitionBy("conv_id").orderBy("k")) - F.col("length")
    return each.select("conv_id", "loss", before.alias("start"), "length").where("loss").drop("loss")
