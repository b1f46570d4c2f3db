"""Descriptive statistics and correlations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse_timestamp, rounded, safe_ratio, sample_skew
from ..functions.dates import iso_text
from ..session import compiled_methods
from .dataset import TIME, Dataset, pin
from .profile import columns_of
from .ranks import exact_quantiles
from .tally import column_facts, ranked_labels

NUMERIC_SCHEMA = (
    "ordinal int, column string, count long, mean double, median double, std double, min double, max double, "
    "q1 double, q3 double, skew double"
)
PAIR_SCHEMA = "a_ordinal int, b_ordinal int, column_a string, column_b string, correlation double"
#: Aggregate expressions evaluated in one pass.
PASS_WIDTH = 300
#: Columns whose moments are found in one pass: the generated method of more is one that the JVM only interprets.
MOMENT_COLUMNS = 8
#: Most columns whose pairs, without gaps, are plain sums; others go through block products.
GRAM_COLUMNS = 16
#: Rows multiplied at once.
BLOCK_ROWS = 4096
_SUMS = ("n", "u", "v", "uv", "uu", "vv")
QUARTILES = [0.25, 0.5, 0.75]


def labelled_columns(ds: Dataset) -> list[str]:
    return columns_of(ds, "categorical", "boolean", "text")


def numeric_columns(ds: Dataset) -> list[str]:
    return columns_of(ds, "numeric")


def quartiles(ds: Dataset, names: list[str]) -> dict[str, list[float]]:
    """Exact quartiles per column, remembered for the life of the dataset."""
    known = ds.remember("quartiles", dict)
    todo = [n for n in names if n not in known]
    if todo:
        spans = {n: (m["count"], m["min"], m["max"]) for n, m in moments(ds, todo).items()}
        known.update(exact_quantiles(ds.rows, {n: ds.number(n) for n in todo}, QUARTILES, known=spans))
    return {n: known[n] for n in names}


def moments(ds: Dataset, names: list[str]) -> dict[str, dict]:
    """count, mean, std, min, max, skew per column from one shuffle-free pass."""
    known = ds.remember("moments", dict)
    todo = [n for n in names if n not in known]
    for start in range(0, len(todo), MOMENT_COLUMNS):
        chunk = todo[start : start + MOMENT_COLUMNS]
        aggs = []
        for i, n in enumerate(chunk):
            x = ds.number(n)
            aggs += [
                F.count(x).alias(f"count{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_pop(x).alias(f"std{i}"),
                F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"), sample_skew(x).alias(f"skew{i}"),
            ]
        row = ds.rows.agg(*aggs).first()
        for i, n in enumerate(chunk):
            known[n] = {k: row[f"{k}{i}"] for k in ("count", "mean", "std", "min", "max", "skew")}
    return {n: known[n] for n in names}


def numeric_summary(ds: Dataset) -> DataFrame:
    """Count, centre, spread, quartiles and skew of every numeric column."""
    names = numeric_columns(ds)
    m, q = moments(ds, names), quartiles(ds, names)
    rows = []
    for n in names:
        s = m[n]
        if not s["count"]:
            continue
        rows.append((ds.get(n).ordinal, n, s["count"], s["mean"], q[n][1], s["std"], s["min"], s["max"], q[n][0], q[n][2], s["skew"]))
    table = ds.spark.createDataFrame(rows, NUMERIC_SCHEMA)
    values = [rounded(k, 6).alias(k) for k in ("mean", "median", "std", "min", "max", "q1", "q3", "skew")]
    return table.select("ordinal", "column", "count", *values)


def label_counts(ds: Dataset, names: list[str], k: int = 10) -> DataFrame:
    """Pinned top-k labels per column, remembered; missing counts as a label."""
    if not names:
        return ds.spark.createDataFrame([], "ordinal int, column string, v string, n long, rank int")

    def build() -> DataFrame:
        top = ranked_labels(ds, names, k)
        heads = column_facts(ds).select("ordinal", F.col("name").alias("column"))
        return pin(top.join(F.broadcast(heads), "ordinal").select("ordinal", "column", "v", "n", "rank"))

    return ds.remember(("labels", tuple(names), k), build)


def categorical_summary(ds: Dataset) -> DataFrame:
    """Per column: distinct labels (missing included) and the ten most frequent."""
    top = label_counts(ds, labelled_columns(ds))
    facts = column_facts(ds).select("ordinal", "rows", (F.col("unique") + (F.col("missing") > 0).cast("long")).alias("unique_count"))
    value = F.struct(
        "rank", F.col("v").alias("value"), F.col("n").alias("count"), rounded(safe_ratio(F.col("n"), F.greatest("rows", F.lit(1))), 4).alias("pct")
    )
    return (
        top.join(F.broadcast(facts), "ordinal")
        .groupBy("ordinal", "column", "unique_count")
        .agg(F.array_sort(F.collect_list(value)).alias("ranked"))
        .select("ordinal", "column", "unique_count", F.transform("ranked", lambda s: s.dropFields("rank")).alias("top_values"))
    )


def datetime_summary(ds: Dataset) -> DataFrame:
    """First and last instant and the whole days between, per datetime column."""
    names = columns_of(ds, "datetime")
    schema = "ordinal int, column string, min string, max string, span_days long"
    if not names:
        return ds.spark.createDataFrame([], schema)
    aggs = []
    for i, n in enumerate(names):
        x = ds.value(n) if ds.get(n).lane == TIME else parse_timestamp(ds.text(n))
        aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    wide = ds.rows.agg(*aggs)
    entries = [
        F.struct(
            F.lit(ds.get(n).ordinal).alias("ordinal"), F.lit(n).alias("column"), F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b")
        )
        for i, n in enumerate(names)
    ]
    long = wide.select(F.inline(F.array(*entries))).where(F.col("a").isNotNull())
    return long.select(
        "ordinal", "column", iso_text(F.col("a")).alias("min"), iso_text(F.col("b")).alias("max"),
        F.timestamp_diff("DAY", F.col("a"), F.col("b")).alias("span_days"),
    )


def _gram(ds: Dataset, names: list[str], deviation: dict[str, Column]) -> dict[tuple[str, str], tuple]:
    """Sums over the rows where both columns of a pair are present, for all pairs in one pass.

    A task multiplies blocks of values, squares and presence flags and keeps one
    total per pair, so what is shuffled is a row per pair and task.
    """
    width = len(names)
    one, two = np.triu_indices(width, 1)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, len(one)))
        for batch in batches:
            block = batch.column(0)
            x = block.flatten().to_numpy(zero_copy_only=False).reshape(len(block), width)
            for start in range(0, len(x), BLOCK_ROWS):
                v = x[start : start + BLOCK_ROWS]
                here = (~np.isnan(v)).astype(float)
                v = np.where(here > 0, v, 0.0)
                with np.errstate(invalid="ignore"):
                    n, s, q, uv = here.T @ here, v.T @ here, (v * v).T @ here, v.T @ v
                sums += np.stack([n[one, two], s[one, two], s[two, one], uv[one, two], q[one, two], q[two, one]])
        yield pa.RecordBatch.from_arrays([pa.array(one.astype(np.int32)), pa.array(two.astype(np.int32)), *[pa.array(r) for r in sums]], names=["a", "b", *_SUMS])

    rows = ds.rows.select(F.array(*[F.coalesce(deviation[n], F.lit(float("nan"))) for n in names]).alias("v"))
    found = rows.mapInArrow(totals, "a int, b int, " + ", ".join(f"{c} double" for c in _SUMS))
    with compiled_methods(ds.spark):
        added = pin(found.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in _SUMS])).collect()
    return {(names[r.a], names[r.b]): (int(r.n), r.u, r.v, r.uv, r.uu, r.vv) for r in added}


def pair_correlations(ds: Dataset, names: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of the named (or all) numeric columns over
    the rows where both are present; NULL where undefined. One row per unordered
    pair, unrounded.

    Plain sums of deviations from the column means, which one earlier pass
    found: few columns without missing values cost a single sum of products a
    pair, all others one pass of block products. No data is shuffled.
    """
    asked = numeric_columns(ds) if names is None else names

    def build() -> DataFrame:
        names = asked
        known = moments(ds, names)
        whole = {r["name"] for r in column_facts(ds).where("num_n = rows").select("name").collect()}
        pairs = list(combinations(names, 2))
        full = [n for n in names if n in whole and known[n]["count"]]
        deviation = {n: ds.number(n) - F.lit(known[n]["mean"]) for n in names}
        values: dict = {}
        if len(full) == len(names) <= GRAM_COLUMNS:
            row = ds.rows.agg(*[F.sum(deviation[a] * deviation[b]).alias(f"uv{i}") for i, (a, b) in enumerate(pairs)]).first() if pairs else None
            for i, (a, b) in enumerate(pairs):
                n = known[a]["count"]
                values[a, b] = _correlation(n, 0.0, 0.0, row[f"uv{i}"], n * (known[a]["std"] or 0.0) ** 2, n * (known[b]["std"] or 0.0) ** 2)
        else:
            filled = [n for n in names if known[n]["count"]]
            found = _gram(ds, filled, deviation) if len(filled) > 1 else {}
            values = {p: _correlation(*found[p]) if p in found else None for p in pairs}
        rows = [(ds.get(a).ordinal, ds.get(b).ordinal, a, b, values[a, b]) for a, b in pairs]
        return ds.spark.createDataFrame(rows, PAIR_SCHEMA)

    return ds.remember(("pairs", *asked), build)


def _correlation(n: int, u: float | None, v: float | None, uv: float | None, uu: float | None, vv: float | None) -> float | None:
    """Pearson r from the sums of deviations; None where undefined."""
    if not n or uv is None or uu is None or vv is None:
        return None
    left, right = uu - u * u / n, vv - v * v / n
    # a column constant on the common rows leaves rounding noise, not spread
    if left <= 1e-12 * uu or right <= 1e-12 * vv:
        return None
    r = (uv - u * v / n) / math.sqrt(left * right)
    return max(-1.0, min(1.0, r)) if r == r else None


def correlation_matrix(ds: Dataset, limit: int | None = None) -> DataFrame:
    """Both triangles and the diagonal over all (or the first ``limit``) numeric columns."""
    names = numeric_columns(ds)
    schema = "x_ordinal int, y_ordinal int, x string, y string, value double"
    if len(names) < 2:
        return ds.spark.createDataFrame([], schema)
    pairs = pair_correlations(ds, names[:limit]).where("correlation is not null")
    spread = moments(ds, names[:limit])
    diagonal = [(ds.get(n).ordinal, ds.get(n).ordinal, n, n, 1.0) for n in names[:limit] if (spread[n]["std"] or 0.0) > 0]
    upper = pairs.toDF("x_ordinal", "y_ordinal", "x", "y", "value")
    lower = upper.select(F.col("y_ordinal"), F.col("x_ordinal"), F.col("y"), F.col("x"), "value")
    cells = upper.union(lower).union(ds.spark.createDataFrame(diagonal, schema))
    return cells.withColumn("value", rounded("value", 4))


def strongest_correlations(ds: Dataset, limit: int = 8) -> DataFrame:
    """Distinct pairs by absolute correlation."""
    matrix = correlation_matrix(ds).where("x_ordinal < y_ordinal")
    return matrix.orderBy(F.desc(F.abs("value")), "x", "y").limit(limit).select("x", "y", "value")


def skewed_fields(ds: Dataset, limit: int = 6) -> DataFrame:
    return numeric_summary(ds).where("abs(skew) >= 1").orderBy(F.desc(F.abs("skew")), "ordinal").limit(limit)


def dominant_categories(ds: Dataset, limit: int = 6) -> DataFrame:
    """Each column's leading label, most dominant column first."""
    lead = categorical_summary(ds).select("ordinal", "column", "unique_count", F.element_at("top_values", 1).alias("top"))
    flat = lead.select("ordinal", "column", "unique_count", F.col("top.value").alias("value"), F.col("top.count").alias("count"), F.col("top.pct").alias("pct"))
    return flat.orderBy(F.desc("pct"), "ordinal").limit(limit)


