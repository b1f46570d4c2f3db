"""Drift between an earlier and a later part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rounded, safe_ratio
from .dataset import Dataset
from .ordinals import from_rank
from .stats import labelled_columns, moments, numeric_columns
from .tally import column_facts, ranked_labels

SHOWN = 10
NUMERIC_SCHEMA = "ordinal int, column string, baseline double, recent double, std double"


def second_half(ds: Dataset) -> Column | None:
    """Condition for the second half of the rows; None when it is empty."""
    if ds.row_count < 2:
        return None
    return ds.remember("second_half", lambda: from_rank(ds, max(1, ds.row_count // 2)))


def _is_recent(ds: Dataset, recent: Column | None) -> Column | None:
    return second_half(ds) if recent is None else F.coalesce(recent, F.lit(False))


def numeric_drift(ds: Dataset, recent: Column | None = None, columns: int | None = None) -> DataFrame:
    """Mean shift of all (or the first ``columns``) numeric columns; ``recent`` replaces the half split."""
    names = numeric_columns(ds)
    flag = _is_recent(ds, recent)
    rows = []
    if len(names) >= 2 and flag is not None:
        names = names[:columns]
        spread = moments(ds, names)
        aggs = []
        for i, n in enumerate(names):
            x = ds.number(n)
            aggs += [F.avg(F.when(~flag, x)).alias(f"a{i}"), F.avg(F.when(flag, x)).alias(f"b{i}")]
        row = ds.rows.agg(*aggs).first()
        for i, n in enumerate(names):
            if row[f"a{i}"] is not None and row[f"b{i}"] is not None:
                rows.append((ds.get(n).ordinal, n, row[f"a{i}"], row[f"b{i}"], spread[n]["std"] or 1.0))
    table = ds.spark.createDataFrame(rows, NUMERIC_SCHEMA)
    shift = F.col("recent") - F.col("baseline")
    floor = F.lit(1e-6)
    return table.select(
        "ordinal", "column", F.lit("numeric").alias("kind"),
        F.lit("First half mean").alias("baseline_label"), F.lit("Second half mean").alias("recent_label"),
        rounded("baseline", 6).alias("baseline_value"), rounded("recent", 6).alias("recent_value"),
        rounded(shift / F.greatest(F.abs("baseline"), floor) * 100.0, 4).alias("delta_pct"),
        rounded(F.abs(shift) / F.greatest(F.col("std"), floor), 4).alias("change_score"),
    )


def categorical_drift(ds: Dataset, recent: Column | None = None, columns: int | None = None) -> DataFrame:
    """Leading label and its share in either part, for all (or the first ``columns``) labelled columns."""
    schema = (
        "ordinal int, column string, kind string, baseline_label string, recent_label string, baseline_top string, "
        "recent_top string, baseline_share double, recent_share double, change_score double"
    )
    names = labelled_columns(ds)[:columns]
    flag = _is_recent(ds, recent)
    if not names or flag is None:
        return ds.spark.createDataFrame([], schema)
    by = [flag.alias("late")]
    counts = ds.rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    top = ranked_labels(ds, names, 1, by, ["late"])
    shares = top.join(F.broadcast(counts), "late").withColumn("share", safe_ratio(F.col("n"), F.col("total")))
    early, late = F.when(~F.col("late"), F.col("v")), F.when(F.col("late"), F.col("v"))
    sides = shares.groupBy("ordinal").agg(
        F.max(early).alias("baseline_top"), F.max(late).alias("recent_top"),
        F.max(F.when(~F.col("late"), F.col("share"))).alias("a"), F.max(F.when(F.col("late"), F.col("share"))).alias("b"),
    )
    heads = column_facts(ds).select("ordinal", F.col("name").alias("column"))
    return sides.where("a is not null and b is not null").join(F.broadcast(heads), "ordinal").select(
        "ordinal", "column", F.lit("categorical").alias("kind"),
        F.lit("First half top category").alias("baseline_label"), F.lit("Second half top category").alias("recent_label"),
        "baseline_top", "recent_top", rounded("a", 4).alias("baseline_share"), rounded("b", 4).alias("recent_share"),
        rounded(F.abs(F.col("b") - F.col("a")), 4).alias("change_score"),
    )


def drift_checks(
    ds: Dataset, recent: Column | None = None, limit: int = SHOWN, numeric_columns_used: int | None = None, label_columns_used: int | None = None,
) -> DataFrame:
    """Both kinds together, the ``limit`` largest changes first; over all columns or the first so many of a kind."""
    both = numeric_drift(ds, recent, numeric_columns_used).unionByName(categorical_drift(ds, recent, label_columns_used), allowMissingColumns=True)
    return both.orderBy(F.desc("change_score"), F.desc("kind"), "ordinal").limit(limit)
