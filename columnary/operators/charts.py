"""Chart-ready tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rounded, safe_ratio
from .dataset import Dataset
from .quality import fence_counts
from .stats import (
    correlation_matrix, label_counts, labelled_columns, moments, numeric_columns, pair_correlations, quartiles,
)
from .tally import column_facts, melt

SCATTER_PAIRS, SCATTER_POINTS, SCATTER_MINIMUM = 4, 220, 10


def first_rows(table: DataFrame, limit: int | None) -> DataFrame:
    return table if limit is None else table.limit(limit)


def missingness(ds: Dataset, limit: int | None = None) -> DataFrame:
    """Missing share in percent, worst columns first; all of them, or the first ``limit``."""
    share = rounded(safe_ratio(F.col("missing"), F.greatest("rows", F.lit(1))), 4)
    table = column_facts(ds).select("ordinal", F.col("name").alias("column"), rounded(share * 100, 2).alias("missing_pct"), F.col("missing").alias("missing_count"))
    return first_rows(table.where("missing_pct > 0").orderBy(F.desc("missing_pct"), "ordinal"), limit)


def bin_edges(low: float, high: float, count: int) -> list[float]:
    """Equal-width edges; a constant column is widened by half a unit each way."""
    bins = min(12, max(4, math.isqrt(count)))
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins
    return [low + i * step for i in range(bins)] + [high]


def _bin(x: Column, edges: list[float]) -> Column:
    """0-based bin, last one closed: a division, then a check against the edges."""
    bins = len(edges) - 1
    grid = F.array(*[F.lit(e) for e in edges])
    guess = F.least(F.floor((x - edges[0]) * (bins / (edges[-1] - edges[0]))).cast("int"), F.lit(bins - 1))
    return (
        F.when(x < F.element_at(grid, guess + 1), guess - 1)
        .when((guess < bins - 1) & (x >= F.element_at(grid, guess + 2)), guess + 1)
        .otherwise(guess)
    )


def histograms(ds: Dataset, columns: int | None = None) -> DataFrame:
    """Equal-width bin counts of all (or the first ``columns``) numeric columns, empty bins kept."""
    names = numeric_columns(ds)[:columns]
    m = moments(ds, names)
    edges = {n: bin_edges(m[n]["min"], m[n]["max"], m[n]["count"]) for n in names if m[n]["count"]}
    frame = [
        (ds.get(n).ordinal, n, b, e[b], e[b + 1]) for n, e in edges.items() for b in range(len(e) - 1)
    ]
    grid = ds.spark.createDataFrame(frame, "ordinal int, column string, bin int, start double, end double")
    if not edges:
        return grid.withColumn("count", F.lit(0).cast("long"))
    binned = melt(ds, {ds.get(n).ordinal: _bin(ds.number(n), e) for n, e in edges.items()}).where("v is not null")
    counts = binned.groupBy("ordinal", F.col("v").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return grid.join(F.broadcast(counts), ["ordinal", "bin"], "left").select(
        "ordinal", "column", "bin", rounded("start", 6).alias("start"), rounded("end", 6).alias("end"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
    )


def boxplots(ds: Dataset, columns: int | None = None) -> DataFrame:
    """Five-number summary and outlier count of all (or the first ``columns``) numeric columns."""
    names = numeric_columns(ds)[:columns]
    m, q, f = moments(ds, names), quartiles(ds, names), fence_counts(ds, names)
    rows = [
        (ds.get(n).ordinal, n, m[n]["min"], q[n][0], q[n][1], q[n][2], m[n]["max"], f[n][1]) for n in names if m[n]["count"]
    ]
    table = ds.spark.createDataFrame(rows, "ordinal int, column string, min double, q1 double, median double, q3 double, max double, outlier_count long")
    return table.select("ordinal", "column", *[rounded(c, 6).alias(c) for c in ("min", "q1", "median", "q3", "max")], "outlier_count")


def top_categories(ds: Dataset, columns: int | None = None) -> DataFrame:
    """Ten most frequent labels of all (or the first ``columns``) labelled columns."""
    top = label_counts(ds, labelled_columns(ds)[:columns])
    return top.select("ordinal", "column", F.col("v").alias("label"), F.col("n").alias("count"), "rank")


def correlation_heatmap(ds: Dataset, columns: int | None = None) -> DataFrame:
    return correlation_matrix(ds, columns)


def scatter_pairs(ds: Dataset, columns: int | None = None, pairs: int = SCATTER_PAIRS) -> list:
    """The strongest defined pairs among all (or the first ``columns``) numeric columns."""
    found = pair_correlations(ds, numeric_columns(ds)[:columns]).where(F.col("correlation").isNotNull())
    return found.orderBy(F.desc(F.abs("correlation")), "a_ordinal", "b_ordinal").limit(pairs).collect()


def pairwise_scatter(ds: Dataset, columns: int | None = None, pairs: int = SCATTER_PAIRS, shown: int = SCATTER_POINTS) -> DataFrame:
    """First ``shown`` complete rows, in row order, of the strongest pairs (top-k each)."""
    schema = "x_column string, y_column string, correlation double, row int, x double, y double"
    parts = []
    keys = [o.alias(f"k{i}") for i, o in enumerate(ds.order_columns)]
    order = [F.col(f"k{i}") for i in range(len(keys))]
    for pair in scatter_pairs(ds, columns, pairs):
        points = ds.rows.select(*keys, ds.number(pair.column_a).alias("x"), ds.number(pair.column_b).alias("y"))
        head = points.where("x is not null and y is not null").orderBy(*order).limit(shown)
        numbered = head.withColumn("row", F.row_number().over(Window.orderBy(*order))).withColumn("points", F.count(F.lit(1)).over(Window.partitionBy()))
        parts.append(
            numbered.where(F.col("points") >= SCATTER_MINIMUM).select(
                F.lit(pair.column_a).alias("x_column"), F.lit(pair.column_b).alias("y_column"),
                rounded(F.lit(pair.correlation), 4).alias("correlation"), "row", rounded("x", 6).alias("x"), rounded("y", 6).alias("y"),
            )
        )
    return reduce(DataFrame.unionAll, parts) if parts else ds.spark.createDataFrame([], schema)


PICK_SCHEMA = ["pick", "subject", "detail", "value", "share", "low", "high"]


def chart_picks(
    ds: Dataset, recent: Column | None = None, histogram_columns: int | None = None, label_columns: int | None = None,
    heatmap_columns: int | None = None, shown: int | None = None,
) -> DataFrame:
    """The single most telling entry of every chart, one row per pick.

    The charts cover all columns, or the first so many of their kind; ``shown``
    bounds the boxplots and missing shares that are picked from.
    """
    from .drift import drift_checks

    def pick(df: DataFrame, label: str, order: list[Column], place: int = 1, **cols) -> DataFrame:
        top = df.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") == place)
        return top.select(
            F.lit(label).alias("pick"),
            F.col(cols["subject"]).cast("string").alias("subject"),
            (F.col(cols["detail"]) if "detail" in cols else F.lit(None)).cast("string").alias("detail"),
            F.col(cols["value"]).cast("double").alias("value"),
            (rounded(cols["share"], 4) if "share" in cols else F.lit(None)).cast("double").alias("share"),
            (F.col(cols["low"]) if "low" in cols else F.lit(None)).cast("double").alias("low"),
            (F.col(cols["high"]) if "high" in cols else F.lit(None)).cast("double").alias("high"),
        )

    cells = correlation_heatmap(ds, heatmap_columns).where("x_ordinal < y_ordinal")
    hist = histograms(ds, histogram_columns)
    first_hist = hist.where(F.col("ordinal") == (hist.agg(F.min("ordinal")).first()[0]))
    of_all = safe_ratio(F.col("count"), F.sum("count").over(Window.partitionBy()))
    labels = top_categories(ds, label_columns)
    first_labels = labels.where(F.col("ordinal") == (labels.agg(F.min("ordinal")).first()[0]))
    boxes = first_rows(boxplots(ds, histogram_columns).orderBy("ordinal"), shown).withColumn("range", F.col("max") - F.col("min"))
    missing = missingness(ds, shown)
    drift = drift_checks(ds, recent, numeric_columns_used=histogram_columns, label_columns_used=label_columns)
    corr = {"subject": "x", "detail": "y", "value": "value"}
    parts = [
        pick(cells.where("value > 0"), "strongest_positive", [F.desc("value"), F.asc("x_ordinal"), F.asc("y_ordinal")], **corr),
        pick(cells.where("value < 0"), "strongest_negative", [F.asc("value"), F.asc("x_ordinal"), F.asc("y_ordinal")], **corr),
        pick(first_hist.withColumn("s", of_all), "densest_bin", [F.desc("count"), F.asc("bin")], subject="column", value="count", share=F.col("s"), low="start", high="end"),
        pick(first_labels.withColumn("s", of_all), "leading_category", [F.asc("rank")], subject="column", detail="label", value="count", share=F.col("s")),
        pick(first_labels.withColumn("s", of_all), "runner_up_category", [F.asc("rank")], 2, subject="column", detail="label", value="count", share=F.col("s")),
        pick(boxes, "most_outliers", [F.desc("outlier_count"), F.asc("ordinal")], subject="column", value="outlier_count"),
        pick(boxes, "widest_range", [F.desc("range"), F.asc("ordinal")], subject="column", value="range", low="min", high="max"),
        pick(missing, "most_missing", [F.desc("missing_pct"), F.asc("ordinal")], subject="column", value="missing_pct"),
        pick(missing, "least_missing", [F.asc("missing_pct"), F.asc("ordinal")], subject="column", value="missing_pct"),
        pick(drift, "largest_drift", [F.desc("change_score"), F.desc("kind"), F.asc("ordinal")], subject="column", detail="kind", value="change_score"),
    ]
    return reduce(DataFrame.unionAll, parts)
