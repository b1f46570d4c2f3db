"""Data quality: flags, duplicates, score and posture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import column, rounded, safe_ratio, text_key
from .dataset import DOUBLE, TEXT, Dataset
from .profile import profile_facts, target_candidates
from .stats import PASS_WIDTH, numeric_columns, pair_correlations, quartiles
from .tally import column_facts

#: Columns from which a row travels as one digest.
DIGEST_COLUMNS = 8
OUTLIER_SCHEMA = "ordinal int, column string, valid_count long, outlier_count long, lower_fence double, upper_fence double"


def missing_by_column(ds: Dataset) -> DataFrame:
    """Columns with missing cells, worst first."""
    share = rounded(safe_ratio(F.col("missing"), F.greatest("rows", F.lit(1))), 4)
    return (
        column_facts(ds).where("missing > 0")
        .select("ordinal", F.col("name").alias("column"), F.col("missing").alias("missing_count"), share.alias("missing_pct"))
        .orderBy(F.desc("missing_pct"), "ordinal")
    )


def missing_cells(ds: Dataset) -> DataFrame:
    """Total missing cells and their share of all cells."""
    cells = F.greatest(F.coalesce(F.max("rows"), F.lit(0)), F.lit(1)) * F.count(F.lit(1))
    total = F.coalesce(F.sum("missing"), F.lit(0))
    return column_facts(ds).agg(total.alias("total_missing_values"), safe_ratio(total, cells).alias("total_missing_pct"))


def _row_digest(values: list[Column]) -> Column:
    """SHA-256 of values as texts, each with its length ahead, so that no two rows read alike."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def row_keys(ds: Dataset) -> list[Column]:
    """What rows are compared by: their values, or one digest of many."""
    values, plain = [], []
    for name in ds.all_columns:
        if name not in ds.names:
            values.append(F.sha2(F.to_json(F.struct(column(name))), 256))
            plain.append(values[-1])
            continue
        field, key = ds.get(name), ds.key(name)
        plain.append(text_key(key) if field.lane == TEXT else key)
        values.append(key + F.lit(0.0) if field.lane == DOUBLE and not field.exact else key)  # minus zero is zero
    return plain if len(values) < DIGEST_COLUMNS else [_row_digest(values)]


def row_counts(ds: Dataset) -> tuple[int, int]:
    """Rows and distinct rows, missing values equal to each other.

    Identical rows collapse in the map stage; long texts and rows of many columns
    enter by digest, so a row's share of the shuffle stays bounded.
    """

    def build() -> tuple[int, int]:
        groups = ds.rows.groupBy(*[k.alias(f"c{i}") for i, k in enumerate(row_keys(ds))]).agg(F.count(F.lit(1)).alias("n"))
        found = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("kinds")).first()
        return found.rows, found.kinds

    return ds.remember("row_counts", build)


def duplicate_row_count(ds: Dataset) -> int:
    """Rows that repeat an earlier identical row."""
    rows, kinds = row_counts(ds)
    return rows - kinds


def duplicate_rows(ds: Dataset) -> DataFrame:
    rows, kinds = row_counts(ds)
    return ds.spark.createDataFrame([(rows, kinds, rows - kinds)], "row_count long, distinct_row_count long, duplicate_row_count long")


def constant_columns(ds: Dataset) -> DataFrame:
    return column_facts(ds).where("`unique` <= 1").select("ordinal", F.col("name").alias("column"))


def near_constant_columns(ds: Dataset) -> DataFrame:
    share = safe_ratio(F.col("top_n"), F.col("non_null"))
    return (
        column_facts(ds).where("`unique` > 1").withColumn("share", share).where("share >= 0.95 and share < 1.0")
        .select("ordinal", F.col("name").alias("column"), F.col("top_n").alias("dominant_count"), rounded("share", 4).alias("dominant_value_ratio"))
    )


def _not_numeric(ds: Dataset) -> DataFrame:
    return profile_facts(ds).where("inferred_type not in ('numeric', 'datetime')")


def invalid_numeric_columns(ds: Dataset) -> DataFrame:
    """Non-numeric columns of which a good part still parses as numbers."""
    return (
        _not_numeric(ds).where("num_ratio >= 0.2 and num_ratio < 0.9")
        .select("ordinal", F.col("name").alias("column"), F.col("num_n").alias("numeric_count"), rounded("num_ratio", 4).alias("numeric_parse_ratio"))
    )


def high_cardinality_columns(ds: Dataset) -> DataFrame:
    share = safe_ratio(F.col("unique"), F.greatest("rows", F.lit(1)))
    return (
        _not_numeric(ds).withColumn("share", share).where("share > 0.5 and `unique` > 25")
        .select("ordinal", F.col("name").alias("column"), F.col("unique").alias("unique_count"), rounded("share", 4).alias("unique_pct"))
    )


def fence_counts(ds: Dataset, names: list[str]) -> dict[str, tuple[int, int, float, float]]:
    """Per column: values, values outside 1.5 IQR, and the two fences."""
    known = ds.remember("fences", dict)
    todo = [n for n in names if n not in known]
    bounds = {}
    for n, (q1, _, q3) in quartiles(ds, todo).items():
        if q1 is not None:
            bounds[n] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    for start in range(0, len(todo), PASS_WIDTH // 2):
        chunk = todo[start : start + PASS_WIDTH // 2]
        aggs = []
        for i, n in enumerate(chunk):
            x = ds.number(n)
            low, high = bounds.get(n, (0.0, 0.0))
            aggs += [F.count(x).alias(f"n{i}"), F.count_if((x < low) | (x > high)).alias(f"o{i}")]
        row = ds.rows.agg(*aggs).first()
        for i, n in enumerate(chunk):
            low, high = bounds.get(n, (None, None))
            spread = low is not None and high > low
            known[n] = (row[f"n{i}"], row[f"o{i}"] if spread else 0, low, high)
    return {n: known[n] for n in names}


def outlier_columns(ds: Dataset) -> DataFrame:
    """Numeric columns with values beyond the IQR fences (at least ten values)."""
    rows = [
        (ds.get(n).ordinal, n, valid, out, low, high)
        for n, (valid, out, low, high) in fence_counts(ds, numeric_columns(ds)).items()
        if valid >= 10 and out > 0
    ]
    table = ds.spark.createDataFrame(rows, OUTLIER_SCHEMA)
    return table.withColumn("outlier_pct", rounded(safe_ratio(F.col("outlier_count"), F.greatest("valid_count", F.lit(1))), 4))


def high_correlations(ds: Dataset, threshold: float = 0.85) -> DataFrame:
    pairs = pair_correlations(ds).where(F.abs("correlation") >= threshold)
    return pairs.withColumn("correlation", rounded("correlation", 4))


def quality_flags(ds: Dataset) -> DataFrame:
    """All column flags in long form: ``column, flag, count, ratio``."""

    def flag(df: DataFrame, name: str, count, ratio) -> DataFrame:
        return df.select("ordinal", "column", F.lit(name).alias("flag"), count.cast("long").alias("count"), ratio.cast("double").alias("ratio"))

    nothing = F.lit(None)
    return (
        flag(constant_columns(ds), "constant", nothing, nothing)
        .unionAll(flag(near_constant_columns(ds), "near_constant", F.col("dominant_count"), F.col("dominant_value_ratio")))
        .unionAll(flag(high_cardinality_columns(ds), "high_cardinality", F.col("unique_count"), F.col("unique_pct")))
        .unionAll(flag(invalid_numeric_columns(ds), "invalid_numeric", F.col("numeric_count"), F.col("numeric_parse_ratio")))
        .unionAll(flag(outlier_columns(ds), "outlier", F.col("outlier_count"), F.col("outlier_pct")))
    )


def quality_measures(ds: Dataset) -> DataFrame:
    """One row of the counts and shares the score is made of."""
    facts = column_facts(ds)
    size = facts.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("row_count"), F.count(F.lit(1)).alias("column_count"), F.coalesce(F.sum("missing"), F.lit(0)).alias("total_missing_values"))
    worst = missing_by_column(ds).agg(F.coalesce(F.max("missing_pct"), F.lit(0.0)).alias("max_missing_pct"), F.count(F.lit(1)).alias("missing_columns"))
    constant = constant_columns(ds).agg(F.count(F.lit(1)).alias("constant_columns"))
    near = near_constant_columns(ds).agg(F.count(F.lit(1)).alias("near_constant_columns"))
    wide = high_cardinality_columns(ds).agg(F.count(F.lit(1)).alias("high_cardinality_columns"))
    invalid = invalid_numeric_columns(ds).agg(
        F.count(F.lit(1)).alias("invalid_numeric_columns"),
        F.coalesce(F.sum((1.0 - F.col("numeric_parse_ratio")) * 6.0), F.lit(0.0)).alias("invalid_weight"),
    )
    out = outlier_columns(ds).agg(F.count(F.lit(1)).alias("outlier_columns"), F.coalesce(F.avg("outlier_pct"), F.lit(0.0)).alias("mean_outlier_pct"))
    corr = high_correlations(ds).agg(F.count(F.lit(1)).alias("high_correlations"))
    one = size
    for part in (worst, constant, near, wide, invalid, out, corr):  # one-row tables
        one = one.crossJoin(part)
    return one.withColumn("duplicate_row_count", F.lit(duplicate_row_count(ds)).cast("long")).withColumn(
        "numeric_columns", F.lit(len(numeric_columns(ds))).cast("long")
    )


PENALTIES = ["missing", "duplicates", "constant", "near_constant", "high_cardinality", "invalid_numeric", "outliers", "correlations"]


def quality_score(ds: Dataset, constant_rule: str = "share") -> DataFrame:
    """Eight penalties and the score. ``constant_rule`` is ``share`` (penalty by
    share of columns) or ``count`` (8 points per constant column)."""
    m = quality_measures(ds)
    rows = F.greatest(F.col("row_count"), F.lit(1))
    cols = F.greatest(F.col("column_count"), F.lit(1))

    def capped(value, top: float):
        return F.least(value.cast("double"), F.lit(top))

    missing_share = F.col("total_missing_values") / (rows * cols)
    by_share = capped(F.col("constant_columns") / cols * 20.0, 16.0)
    by_count = capped(F.col("constant_columns") * 8.0, 16.0)
    scored = m.select(
        (F.col("max_missing_pct") * 25.0 + missing_share * 20.0).alias("missing"),
        capped(F.col("duplicate_row_count") / rows * 40.0, 20.0).alias("duplicates"),
        (by_share if constant_rule == "share" else by_count).alias("constant"),
        capped(F.col("near_constant_columns") * 1.5, 12.0).alias("near_constant"),
        capped(F.col("high_cardinality_columns") * 2.0, 12.0).alias("high_cardinality"),
        capped(F.col("invalid_weight"), 12.0).alias("invalid_numeric"),
        capped(safe_ratio(F.col("outlier_columns"), F.col("numeric_columns")) * 12.0 + F.col("mean_outlier_pct") * 20.0, 20.0).alias("outliers"),
        capped(F.col("high_correlations") * 4.0, 12.0).alias("correlations"),
    )
    total = sum((F.col(p) for p in PENALTIES[1:]), F.col(PENALTIES[0]))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - total))
    return scored.withColumn("quality_score", rounded(score, 2))


def recommendations(ds: Dataset) -> DataFrame:
    """Advice lines in order: ``position, text``."""
    m = quality_measures(ds)
    lines = F.array_compact(F.array(
        F.when(F.col("missing_columns") > 0, vocab.ADVICE_MISSING),
        F.when(F.col("constant_columns") > 0, vocab.ADVICE_CONSTANT),
        F.when(F.col("high_correlations") > 0, vocab.ADVICE_CORRELATED),
        F.when(F.col("outlier_columns") > 0, vocab.ADVICE_OUTLIERS),
    ))
    lines = F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(vocab.ADVICE_CLEAN)))
    return m.select(F.posexplode(lines).alias("position", "text"))


def posture(ds: Dataset) -> DataFrame:
    """Shape label, density, target count and score in one row."""
    score = quality_score(ds, "count").select("quality_score")
    m = quality_measures(ds).crossJoin(score)
    cells = F.col("row_count") * F.col("column_count")
    density = F.when(cells > 0, 100.0 - F.col("total_missing_values") / F.greatest(cells, F.lit(1)) * 100.0).otherwise(100.0)
    width = F.when(F.col("column_count") >= 40, "Wide dataset").when(F.col("column_count") >= 15, "Balanced shape").otherwise("Compact table")
    return m.select(
        width.alias("width_label"), "row_count", "column_count", rounded(F.greatest(density, F.lit(0.0)), 4).alias("density_pct"),
        "total_missing_values", F.lit(target_candidates(ds).count()).cast("long").alias("target_candidate_count"),
        rounded("quality_score", 1).alias("quality_score"), "duplicate_row_count",
    )


def completeness(ds: Dataset) -> DataFrame:
    """Share of filled cells and of non-duplicate rows, in percent."""
    m = quality_measures(ds)
    cells = F.greatest(F.col("row_count") * F.col("column_count"), F.lit(1))
    rows = F.greatest(F.col("row_count"), F.lit(1))
    return m.select(
        rounded(F.greatest(F.lit(0.0), (cells - F.col("total_missing_values")) / cells * 100.0), 4).alias("completeness_pct"),
        rounded(F.greatest(F.lit(0.0), (F.col("row_count") - F.col("duplicate_row_count")) / rows * 100.0), 4).alias("uniqueness_pct"),
    )


