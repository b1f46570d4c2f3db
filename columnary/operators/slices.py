"""How the target behaves across feature bands and categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rounded, text_key
from .dataset import Dataset, pin
from .features import is_number
from .ranks import rank_values
from .tally import column_facts, melt, restore_labels, top_labels

BANDS = 5
LABELS, LABEL_ROWS, MINIMUM_ROWS = 6, 5, 20

SLICE_SCHEMA = (
    "feature string, feature_type string, bucket int, lower double, upper double, label string, count long, "
    "target_label string, target_value double, target_class string"
)


def slice_label(ds: Dataset, target: str, task: str) -> str | None:
    """The positive label of a two-class target: the last one alphabetically."""
    if task == "regression":
        return None
    facts = column_facts(ds).where(F.col("name") == target).first()
    if facts["unique"] != 2:
        return None
    return ds.rows.agg(F.max(ds.text(target))).first()[0]


def band_edges(values: list[float]) -> list[float]:
    return sorted(set(values))


def _quantile_edges(ds: Dataset, rows: DataFrame, names: list[str], distinct: dict[str, int]) -> dict[str, list[float]]:
    """Distinct quantile edges per feature, interpolated linearly."""
    edges: dict[str, list[float]] = {}
    by_bands: dict[int, list[str]] = {}
    for n in names:
        by_bands.setdefault(min(BANDS, distinct[n]), []).append(n)
    for bands, group in by_bands.items():
        if bands < 1:
            continue
        probs = [i / bands for i in range(bands + 1)]

        def spots(n: int) -> list[tuple[int, int]]:
            return [(int((n - 1) * p), min(n - 1, int((n - 1) * p) + 1)) for p in probs]

        for name, (n, pairs) in rank_values(rows, {g: ds.number(g) for g in group}, spots).items():
            if n < MINIMUM_ROWS:
                continue
            values = []
            for p, (low, high) in zip(probs, pairs):
                part = (n - 1) * p - int((n - 1) * p)
                values.append(low + (high - low) * part)
            edges[name] = band_edges([float(v) for v in values])
    return edges


def _measure(task: str, target: str, positive: str | None) -> tuple[str, Column | None]:
    if task == "regression":
        return f"Average {target}", F.avg("y")
    if positive is not None:
        return f"{positive} rate", F.avg((F.col("label_y") == positive).cast("double"))
    return "Dominant class share", None


def _aggregate(long: DataFrame, keys: list[str], measure: Column | None) -> DataFrame:
    """Count and target measure per slice, partially aggregated in the map stage."""
    if measure is not None:
        return long.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), measure.alias("target_value"), F.lit(None).cast("string").alias("target_class"))
    cells = long.groupBy(*keys, "label_y").agg(F.count(F.lit(1)).alias("n"))
    # most frequent class, the smallest label on a tie
    lead = F.min(F.struct((-F.col("n")).alias("m"), F.col("label_y").alias("c")))
    return cells.groupBy(*keys).agg(F.sum("n").alias("count"), (-lead["m"] / F.sum("n")).alias("target_value"), lead["c"].alias("target_class"))


def target_slices(
    ds: Dataset, target: str, task: str, features: list[str] | None = None, numeric: int | None = None, total: int | None = None,
) -> DataFrame:
    """Bands of the numeric features, most related first, then common categories.

    All features, or ``numeric`` banded ones and ``total`` features at most.
    """
    names = [n for n in (features or ds.names) if n != target]
    rows = ds.rows.where(ds.text(target).isNotNull())
    work = ds.within(rows)
    facts = {r["name"]: r for r in column_facts(work).collect()}
    if facts[target].non_null < MINIMUM_ROWS:
        return ds.spark.createDataFrame([], SLICE_SCHEMA)
    positive = slice_label(work, target, task)
    target_label, measure = _measure(task, target, positive)
    y, label_y = (ds.number(target) if is_number(ds, target) else F.lit(None).cast("double")), ds.text(target)

    numbers = [n for n in names if is_number(ds, n) and facts[n].non_null >= MINIMUM_ROWS]
    scores = _scores(ds, rows, numbers, task, y, label_y, positive)
    leading = sorted(numbers, key=lambda n: (-scores[n], names.index(n)))[:numeric]
    edges = _quantile_edges(ds, rows, leading, {n: facts[n]["unique"] for n in leading})
    banded = [n for n in leading if len(edges.get(n, [])) >= 2]
    parts = []
    keep = [y.alias("y"), label_y.alias("label_y")]
    if banded:
        def band(n: str) -> Column:
            x = ds.number(n)
            inner = F.array(*[F.lit(e) for e in edges[n][1:-1]]).cast("array<double>")
            return F.when(x.isNotNull(), F.size(F.filter(inner, lambda e: e < x)))

        long = melt(work, {ds.get(n).ordinal: band(n) for n in banded}, keep).where("v is not null")
        found = _aggregate(long, ["ordinal", "v"], measure)
        frame = [(ds.get(n).ordinal, b, n, i, edges[n][b], edges[n][b + 1]) for i, n in enumerate(banded) for b in range(len(edges[n]) - 1)]
        grid = ds.spark.createDataFrame(frame, "ordinal int, v int, feature string, position int, lower double, upper double")
        parts.append(
            # a band between two edges may hold no row: it is listed with a count of 0
            grid.join(F.broadcast(pin(found)), ["ordinal", "v"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long"))).select(
                "feature", F.lit("numeric").alias("feature_type"), (F.col("v") + 1).alias("bucket"),
                rounded("lower", 6).alias("lower"), rounded("upper", 6).alias("upper"), F.lit(None).cast("string").alias("label"),
                "count", F.lit(target_label).alias("target_label"), rounded("target_value", 6).alias("target_value"), "target_class",
            )
        )
    labelled = [n for n in names if not is_number(ds, n) and facts[n]["unique"] + (facts[n].missing > 0) >= 2]
    # every such feature yields a slice unless all its common values are rare
    top = pin(top_labels(work, labelled, LABELS)).where(F.col("n") >= LABEL_ROWS) if labelled else None
    if top is not None:
        present = {r.ordinal for r in top.select("ordinal").distinct().collect()}
        wanted = [n for n in labelled if ds.get(n).ordinal in present][: None if total is None else max(0, total - len(banded))]
        if wanted:
            chosen = top.where(F.col("ordinal").isin([ds.get(n).ordinal for n in wanted]))
            long = melt(work, {ds.get(n).ordinal: text_key(work.labelled(n)) for n in wanted}, keep)
            hits = long.join(F.broadcast(chosen.select("ordinal", "v", "rank")), ["ordinal", "v"])
            found = _aggregate(hits, ["ordinal", "v", "rank"], measure)
            heads = ds.spark.createDataFrame([(ds.get(n).ordinal, n) for n in wanted], "ordinal int, feature string")
            named = restore_labels(work, pin(found)).join(F.broadcast(heads), "ordinal")
            parts.append(
                named.select(
                    "feature", F.lit("categorical").alias("feature_type"), F.col("rank").alias("bucket"),
                    F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"), F.col("v").alias("label"),
                    "count", F.lit(target_label).alias("target_label"), rounded("target_value", 6).alias("target_value"), "target_class",
                )
            )
    return reduce(DataFrame.unionAll, parts) if parts else ds.spark.createDataFrame([], SLICE_SCHEMA)


def _scores(ds: Dataset, rows: DataFrame, names: list[str], task: str, y: Column, label_y: Column, positive: str | None) -> dict[str, float]:
    """How strongly each numeric feature relates to the target."""
    if not names:
        return {}
    aggs = []
    for i, n in enumerate(names):
        x = ds.number(n)
        if task == "regression" or positive is not None:
            t = y if task == "regression" else (label_y == positive).cast("double")
            r = F.try_divide(F.regr_sxy(t, x), F.sqrt(F.regr_sxx(t, x) * F.regr_syy(t, x)))
            aggs.append(F.abs(r).alias(f"s{i}"))
        else:
            aggs.append(F.stddev_pop(x).alias(f"s{i}"))
    row = rows.agg(*aggs).first()
    return {n: row[f"s{i}"] or 0.0 for i, n in enumerate(names)}
