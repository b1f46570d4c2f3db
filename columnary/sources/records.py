"""CSV records whose quoted fields contain line breaks, cut in parallel.

A line break ends a record only outside quotes, and whether the start of a file
split lies inside quotes depends on all splits before it. Every split tells, in
one pass, in which state it leaves a reader that enters it outside quotes and
one that enters it inside; following these answers split by split gives the
state each one starts in. A second pass then cuts every split into records. A
record that crosses splits comes out as pieces, at most two a split beside
splits that lie wholly inside it, and the pieces alone are shuffled together.

A field is quoted when a quote is its first character. Two quotes stand for one;
any other quote inside ends the quoting, and the field goes on to the next comma.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dataset import ARRIVAL
from ..session import ensure_checkpoint_dir

#: Most splits whose start states are sent to all tasks; beyond it lines meet them in a shuffle.
BROADCAST_SPLITS = 200_000
_QUOTED = rb'"[^"]*+(?:""[^"]*+)*+"'
_FIELDS = re.compile(rb'(?:(?:' + _QUOTED + rb'|(?!"))[^,]*+,)*+')
_CLOSED = re.compile(_QUOTED)
_REST = re.compile(rb'[^"]*+(?:""[^"]*+)*+"[^,]*+')
_BOM = b"\xef\xbb\xbf"
WHOLE, HEAD, MORE, LAST = 0, 1, 2, 3


def follower() -> Callable[[bytes, bool], bool]:
    """A function of a line and whether it starts inside quotes: whether it ends inside quotes."""
    fields, closed, rest = _FIELDS, _CLOSED, _REST

    def follow(line: bytes, inside: bool) -> bool:
        at = 0
        if inside:
            end = rest.match(line)
            if end is None:
                return True
            at = end.end() + 1  # behind the comma
            if at > len(line):
                return False
        at = fields.match(line, at).end()
        return line[at : at + 1] == b'"' and closed.match(line, at) is None

    return follow


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, block, line`` as bytes; the rows of a split are in order of the file."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _split_states(lines: DataFrame) -> DataFrame:
    """``path, block, before, inside``: lines before each split and the state it starts in."""
    follow, bom = follower(), _BOM

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, states = None, 0, [False, True]

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([n], pa.int64()), pa.array([states[0]]), pa.array([states[1]])],
                names=["path", "block", "lines", "outside_to", "inside_to"])

        for batch in batches:
            quotes = pc.match_substring(batch.column(2), b'"').to_pylist()
            for i, (path, block) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if (path, block) != key:
                    if key is not None:
                        yield told()
                    key, n, states = (path, block), 0, [False, True]
                if quotes[i]:
                    line = batch.column(2)[i].as_py()
                    line = line.removeprefix(bom) if block == 0 and n == 0 else line
                    states = [follow(line, s) for s in states]
                n += 1
        if key is not None:
            yield told()

    def enter(splits: pd.DataFrame) -> pd.DataFrame:
        inside, starts = False, []
        splits = splits.sort_values("block")
        for to in zip(splits["outside_to"], splits["inside_to"]):
            starts.append(inside)
            inside = bool(to[inside])
        return splits.assign(inside=starts)[["path", "block", "lines", "inside"]]

    left = lines.mapInArrow(leave, "path string, block long, lines long, outside_to boolean, inside_to boolean")
    known = left.groupBy("path").applyInPandas(enter, "path string, block long, lines long, inside boolean")  # one row a split
    before = F.sum("lines").over(Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1))
    return known.select("path", "block", F.coalesce(before, F.lit(0)).alias("before"), "inside")


def _pieces(placed: DataFrame) -> DataFrame:
    """``path, number, kind, is_first, piece``: records and pieces of records; ``number`` is that of the first line."""
    follow, bom = follower(), _BOM
    whole, head, more, last = WHOLE, HEAD, MORE, LAST

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, inside, entered, held, first = None, 0, False, False, [], False
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int32()),
                 pa.array([r[3] for r in out], pa.bool_()), pa.array([r[4] for r in out], pa.binary())],
                names=["path", "number", "kind", "is_first", "piece"])
            out.clear()
            return made

        def close(kind: int) -> None:
            nonlocal held, first
            out.append((key[0], n - len(held), kind, first, b"\n".join(held)))
            held, first = [], False

        for batch in batches:
            columns = [batch.column(name) for name in ("path", "block", "before", "inside")]
            quotes = pc.match_substring(batch.column("line"), b'"').to_pylist()
            for i, (path, block, before, start) in enumerate(zip(*(c.to_pylist() for c in columns))):
                if (path, block) != key:
                    if held:
                        close(more if entered else head)
                    key, n, inside, entered = (path, block), before, start, start
                    top = block == 0
                line = batch.column("line")[i].as_py()
                if top:
                    line, top, first = line.removeprefix(bom), False, True
                if not inside and not line.strip():  # blank lines are no records; the first record may come later
                    n += 1
                    continue
                held.append(line)
                n += 1
                inside = follow(line, inside) if quotes[i] else inside
                if not inside:
                    close(last if entered else whole)
                    entered = False
            if out:
                yield flush()
        if held:
            close(more if entered else head)
        if out:
            yield flush()

    return placed.mapInArrow(cut, "path string, number long, kind int, is_first boolean, piece binary")


def csv_records(spark: SparkSession, path: str, charset: str) -> DataFrame:
    """``record, is_first`` and the place in file order of every CSV record below ``path``; blank lines are left out.

    ``is_first`` marks the first record of each file, which is its header. A
    quote that is never closed takes the rest of its file into one record.
    """
    ensure_checkpoint_dir(spark)
    lines = _lines(spark, path)
    states = _split_states(lines).checkpoint()
    key = ["path", "block"]
    if states.count() <= BROADCAST_SPLITS:
        placed = lines.join(F.broadcast(states), key)
    else:
        order = [*key, "place"]
        placed = lines.withColumn("place", F.monotonically_increasing_id()).join(states, key).repartition(*key).sortWithinPartitions(*order).drop("place")
    piece = F.col("piece").cast("string") if charset == "UTF-8" else F.decode("piece", charset)
    pieces = _pieces(placed).withColumn("piece", piece)
    record = F.regexp_replace("record", "\r$", "").alias("record")
    whole = pieces.where(F.col("kind") == WHOLE).select(F.col("piece").alias("record"), "is_first", F.col("number").alias(ARRIVAL))
    parts = pieces.where(F.col("kind") != WHOLE)
    owner = F.count_if(F.col("kind") == HEAD).over(Window.partitionBy("path").orderBy("number"))  # a few rows a split
    joined = parts.withColumn("owner", owner).groupBy("path", "owner").agg(
        F.array_sort(F.collect_list(F.struct("number", "piece"))).alias("all"), F.bool_or("is_first").alias("is_first"))
    crossing = joined.select(F.array_join("all.piece", "\n").alias("record"), "is_first", F.col("all")[0]["number"].alias(ARRIVAL)).checkpoint()
    return whole.union(crossing).select(record, "is_first", ARRIVAL)
