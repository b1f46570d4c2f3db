"""First values in row order: previews and per-column samples."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import column
from ..session import compiled_methods
from .dataset import TIME, Dataset, pin
from .tally import column_facts

#: Rows read ahead of the wanted sample size, to step over missing values.
SLACK = 24


def preview_rows(ds: Dataset, limit: int = 20) -> DataFrame:
    """The first rows in row order with their 0-based ``row_id`` (top-k, no sort)."""
    head = ds.rows.orderBy(*ds.order_columns).limit(limit)
    position = F.row_number().over(Window.orderBy(*ds.order_columns)) - 1
    return head.select(position.cast("long").alias("row_id"), *[column(n) for n in ds.all_columns])


def head_values(ds: Dataset, k: int) -> DataFrame:
    """First k non-null values of each column as text: ``(ordinal, rank, v)``.

    One top-k over the row order fetches a few more than k rows, which is
    enough for every column that is not sparse at the start. Only for a column
    that falls short is a second top-k run, over that column alone.
    """
    return ds.remember(("head", k), lambda: _head_values(ds, k))


def _head_values(ds: Dataset, k: int) -> DataFrame:
    facts = {r.ordinal: r for r in column_facts(ds).collect()}
    texts = [ds.text(f.name).alias(str(f.ordinal)) for f in ds.fields]
    # texts are made after the top-k, for the few rows that are kept
    with compiled_methods(ds.spark):
        head = ds.rows.orderBy(*ds.order_columns).limit(k + SLACK).select(*texts).toArrow()

    ordinals, ranks, values = [], [], []
    short = []
    for f in ds.fields:
        present = [v for v in head.column(str(f.ordinal)).to_pylist() if v is not None][:k]
        if len(present) < min(k, facts[f.ordinal].non_null):
            short.append(f)
            continue
        for rank, v in enumerate(present, 1):
            ordinals.append(f.ordinal)
            ranks.append(rank)
            values.append(v)
    table = pa.table({"ordinal": pa.array(ordinals, pa.int32()), "rank": pa.array(ranks, pa.int32()), "v": pa.array(values, pa.string())})
    sample = ds.spark.createDataFrame(table)
    for start in range(0, len(short), 50):
        parts = []
        for f in short[start : start + 50]:
            first = ds.rows.where(ds.value(f.name).isNotNull()).orderBy(*ds.order_columns).limit(k)
            rank = F.row_number().over(Window.orderBy(*ds.order_columns))  # k rows
            parts.append(first.select(F.lit(f.ordinal).alias("ordinal"), rank.alias("rank"), ds.text(f.name).alias("v")))
        sample = sample.unionByName(pin(reduce(DataFrame.unionAll, parts)))

    days = [f.ordinal for f in ds.fields if f.lane == TIME and facts[f.ordinal].midnight]
    if days:
        sample = sample.withColumn("v", F.when(F.col("ordinal").isin(days), F.substring("v", 1, 10)).otherwise(F.col("v")))
    return sample
