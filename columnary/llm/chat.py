"""Chat formatting: turns of a conversation to one marked-up training string.

Spark expressions only. Turns are collected and sorted inside the row, adjacent
turns of one role become one block by array slices, and the string is the
concatenation of segments, each flagged as inside or outside the loss mask.

Markup: ``<|im_start|>role<|im_body|>text<|im_next|>text<|im_end|>`` and a line
feed, ``<|im_next|>`` between merged turns. Control strings in texts (this
markup and the common instruction tags) get a backslash behind their first
character and backslashes are doubled, so every text can be restored exactly.

Defined cases: null text or role is empty text; null turns sort first; equal
turns are ordered by role, then text; repeated rows are turns of their own; a
null conversation id is one conversation; an empty table gives an empty one;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BODY, NEXT, END = "<|im_start|>", "<|im_body|>", "<|im_next|>", "<|im_end|>\n"
#: What may follow the first character of a control string.
_TAILS = r"(\||/?s>|<SYS>>|</SYS>>|/?INST\])"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"([<\[])" + _TAILS, r"$1\\$2")


def unescape(text: Column) -> Column:
    plain = F.regexp_replace(text, r"([<\[])\\" + _TAILS, "$1$2")
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, segments, n_blocks``.

    ``segments`` is an array of (piece, loss) in order; ``formatted`` is the
    concatenation of the pieces, and ``loss`` marks assistant texts alone.
    """
    own = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("said"),
    )
    sorted_turns = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))
    n = F.size("said")
    first = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at("said", i)["role"] != F.element_at("said", F.greatest(i - 1, F.lit(1)))["role"]))
    starts = sorted_turns.withColumn("starts", first)

    def block(s: Column, k: Column) -> Column:
        until = F.coalesce(F.get("starts", k + 1), n + 1)
        return F.struct(F.element_at("said", s)["role"].alias("role"), F.transform(F.slice("said", s, until - s), lambda t: t["text"]).alias("texts"))

    def pieces(b: Column) -> Column:
        spoken = b["role"] == "assistant"
        head = F.array(F.struct(F.concat(F.lit(START), escape(b["role"]), F.lit(BODY)).alias("piece"), F.lit(False).alias("loss")))
        # a text and what follows it: the mark of the next merged turn, or the end
        body = F.flatten(F.transform(b["texts"], lambda t, j: F.array(
            F.struct(escape(t).alias("piece"), spoken.alias("loss")),
            F.struct(F.when(j + 1 < F.size(b["texts"]), F.lit(NEXT)).otherwise(F.lit(END)).alias("piece"), F.lit(False).alias("loss")),
        )))
        return F.concat(head, body)

    blocks = starts.withColumn("blocks", F.transform("starts", block))
    return (
        blocks.withColumn("segments", F.flatten(F.transform("blocks", pieces)))
        .select("conv_id", F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted"), "segments", F.size("blocks").cast("long").alias("n_blocks"))
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text), unmerged."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")
    parted = F.transform(blocks, lambda b: F.split(F.substring(b, len(START) + 1, 2147483647), r"<\|im_body\|>"))
    return F.flatten(F.transform(parted, lambda p: F.transform(
        F.split(p[1], r"<\|im_next\|>"),
        lambda t: F.struct(unescape(p[0]).alias("role"), unescape(t).alias("text")),
    )))
