"""Substring deduplication by line hashing, with original offsets.

Units are lines, cut further at sentence ends and, where a sentence is long, at
words chosen by their hash, so that a passage set into the middle of a line
falls into the same units wherever it stands; neighbouring sentences too short
for a unit are taken together. Units of at least ``UNIT_WORDS``
words are normalised (white space, case) and digested; digests are grouped over
all documents, and the occurrence of least (id, offset) is the one to keep.
Every other occurrence counts as repeated, and a run of repeated neighbours is
removed when it has ``RUN_WORDS`` words. With ``whole_lines`` (the query) every
line that has words is a unit of its own besides, and each later occurrence of a
line is removed whatever its length and neighbours; a repeated paragraph is a
row of such lines. Without it short common lines alone stay.

Grouping is a combinable minimum, so a line in a third of all documents costs
one row per task; offsets are code points of the original text.

Defined cases: null or empty text has no units; a null id ranks last; rows with
equal id and text are one document; equal units inside one document count as
repeats of the first; an empty table gives an empty one; extra columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship

UNIT_WORDS, RUN_WORDS = 5, 30
#: A sentence of more words is cut behind words of which one in ``ANCHOR`` is chosen, or at ``LONGEST``.
LONG_SENTENCE, ANCHOR, LONGEST = 16, 8, 32

_BREAK = re.compile(r"(?<=[.!?])[^\S\n]+|\s*\n\s*")
_WORD = re.compile(r"\S+")
#: Rows of a batch handed back to Spark.
_ROWS = 50_000


def split_units(text: str | None) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of every unit of enough words, in order."""
    text = text or ""
    at, short = 0, -1
    for stop, after in [*((m.start(), m.end()) for m in _BREAK.finditer(text)), (len(text), len(text))]:
        size = len(text[at:stop].split())
        if size < UNIT_WORDS:
            short = at if short < 0 else short  # short sentences are taken together
        else:
            if short >= 0:
                yield from _pieces(text, short, at)
                short = -1
            yield from _pieces(text, at, stop)
        at = after
    if short >= 0:
        yield from _pieces(text, short, len(text))


def _pieces(text: str, start: int, stop: int) -> Iterator[tuple[int, int, int, bytes]]:
    words = [(m.start(), m.end(), m[0].lower().encode("utf-8", "surrogatepass")) for m in _WORD.finditer(text, start, stop)]
    begin, whole = 0, len(words) <= LONG_SENTENCE
    for k, (_, end, word) in enumerate(words):
        size = k + 1 - begin
        if size < UNIT_WORDS or not (k + 1 == len(words) or not whole and (size == LONGEST or xxhash.xxh3_64_intdigest(word) % ANCHOR == 0)):
            continue
        yield words[begin][0], end, size, xxhash.xxh3_128_digest(b" ".join(w for _, _, w in words[begin:k + 1]))
        begin = k + 1


def split_lines(text: str | None) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of every line that has words, in order; digests as those of units."""
    at = 0
    for line in (text or "").split("\n"):
        words = [w.lower().encode("utf-8", "surrogatepass") for w in line.split()]
        if words:
            yield at + len(line) - len(line.lstrip()), at + len(line.rstrip()), len(words), xxhash.xxh3_128_digest(b" ".join(words))
        at += len(line) + 1


def _placed(text: str | None, whole_lines: bool) -> Iterator[tuple[int | None, bool, int, int, int, int, bytes]]:
    """(number, whether a line, first word, start, end, words, digest) of units and, where asked, lines (numbered if also a unit)."""
    lines = {(u[0], u[1]): u for u in split_lines(text)} if whole_lines else {}
    starts = [m.start() for m in _WORD.finditer(text or "")]
    for n, u in enumerate(split_units(text)):
        yield n, lines.pop((u[0], u[1]), None) is not None, bisect_left(starts, u[0]), *u
    for u in lines.values():
        yield None, True, bisect_left(starts, u[0]), *u


def units(docs: DataFrame, whole_lines: bool = False) -> DataFrame:
    """``doc_id, unit, line, word, start, end, n_words, digest``; ``unit`` numbers the units of a text (null for lines
    that are none), ``line`` marks whole lines, ``word`` is the number of the first word."""
    names = ["doc_id", "unit", "line", "word", "start", "end", "n_words", "digest"]
    types = [pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, out = batch.column(0), [], []

            def flush() -> pa.RecordBatch:
                columns = list(zip(*out)) or [[]] * len(types)
                made = pa.RecordBatch.from_arrays([keys.take(pa.array(np.asarray(rows, np.int64)))] + [pa.array(c, t) for c, t in zip(columns, types)], names=names)
                rows.clear()
                out.clear()
                return made

            for i, text in enumerate(batch.column(1).to_pylist()):
                for u in _placed(text, whole_lines):
                    rows.append(i)
                    out.append(u)
                    if len(out) >= _ROWS:
                        yield flush()
            yield flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(spread, f"doc_id {kind}, unit int, line boolean, word int, start int, end int, n_words int, digest binary")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, whole_lines: bool = False) -> DataFrame:
    """Spans to remove: ``doc_id, start, end, n_units, n_words, kept_doc_id, kept_start``.

    ``kept_doc_id`` and ``kept_start`` tell where the first unit of the span stays.
    Spans do not touch; a line and its pieces count once in ``n_units`` and ``n_words``.
    """
    ship(docs.sparkSession)
    made = cut(units(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), whole_lines), "units")
    place = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "start")
    firsts = made.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").select("digest", "first")
    later = made.join(firsts, "digest").where(~place.eqNullSafe(F.col("first"))).drop("digest").dropDuplicates(["doc_id", "start", "end"])
    later = later.withColumn("stop", F.col("word") + F.col("n_words"))
    order = Window.partitionBy("doc_id").orderBy("start", F.desc("end"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # neighbours among the units of a document share unit - rank
    run = F.col("unit") - F.count("unit").over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy("doc_id", "run")
    ran = later.withColumn("run", run).withColumn("long", F.col("run").isNotNull() & (F.sum("n_words").over(whole) >= run_words))
    ran = ran.withColumn("reach", F.when(F.col("long"), F.max("stop").over(whole)).otherwise(F.col("stop"))).where("line or long")
    # a span goes on while the next unit starts at or before the word it has reached
    met = ran.withColumn("fresh", F.coalesce(F.col("word") > F.max("reach").over(before), F.lit(True)).cast("int"))
    met = met.withColumn("added", F.greatest(F.lit(0), F.col("stop") - F.greatest("word", F.max("stop").over(before)))).withColumn("span", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = met.groupBy("doc_id", "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count_if(F.col("added") > 0).alias("n_units"), F.sum("added").alias("n_words"),
        F.min_by("first", F.struct("start", -F.col("end"))).alias("first"))
    return spans.select(
        "doc_id", "start", "end", "n_units", "n_words", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"))


def without_repeats(docs: DataFrame, run_words: int = RUN_WORDS, whole_lines: bool = False) -> DataFrame:
    """``docs`` with the repeated spans cut out of ``text``, and ``removed``: their (start, end) in the original."""
    spans = repeated_spans(docs, run_words=run_words, whole_lines=whole_lines).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed")).withColumnRenamed("doc_id", "span_id")
    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("span_id")), "left")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    walked = F.aggregate("removed", start, lambda a, s: F.struct(s["end"].alias("at"), F.array_append(a["out"], F.substr("text", a["at"] + 1, s["start"] - a["at"])).alias("out")))
    left = F.concat(F.array_join(walked["out"], ""), F.substr("text", walked["at"] + 1))
    return joined.withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(left)).select(*docs.columns, "removed")
