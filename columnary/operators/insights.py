"""Findings and next steps in words, readiness and capability gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import double_text
from .dataset import Dataset, pin
from .profile import columns_of, target_candidates
from .quality import high_correlations, missing_by_column, quality_measures
from .stats import numeric_summary


def _measures(ds: Dataset) -> DataFrame:
    """One row with everything the sentences mention."""

    def build() -> DataFrame:
        worst = missing_by_column(ds).orderBy(F.desc("missing_pct"), "ordinal").limit(1).agg(
            F.max("column").alias("worst_column"), F.max("missing_pct").alias("worst_pct")
        )
        pair = high_correlations(ds).orderBy("a_ordinal", "b_ordinal").limit(1).agg(
            F.max("column_a").alias("pair_a"), F.max("column_b").alias("pair_b"), F.max("correlation").alias("pair_value")
        )
        skewed = numeric_summary(ds).agg(F.count_if(F.abs("skew") >= 1.0).alias("skewed_fields"))
        one = quality_measures(ds).crossJoin(worst).crossJoin(pair).crossJoin(skewed)  # one-row tables
        return pin(
            one.withColumn("numeric_fields", F.lit(len(columns_of(ds, "numeric"))))
            .withColumn("categorical_fields", F.lit(len(columns_of(ds, "categorical"))))
            .withColumn("candidates", F.lit(target_candidates(ds).count()))
        )

    return ds.remember("insight_measures", build)


def _whole(name: str):
    return F.format_number(F.col(name), 0)


def insights(ds: Dataset) -> DataFrame:
    """``kind`` (finding / next_step), ``position``, ``text``."""
    ready = (F.col("candidates") > 0) | (F.col("numeric_fields") >= 2)
    has_missing = F.col("worst_column").isNotNull()
    has_duplicates = F.col("duplicate_row_count") > 0
    has_pair = F.col("pair_a").isNotNull()
    findings = F.array_compact(F.array(
        F.concat(
            F.lit(ds.name), F.lit(" contains "), _whole("row_count"), F.lit(" rows across "), F.col("column_count").cast("string"),
            F.lit(" columns with "), F.col("numeric_fields").cast("string"), F.lit(" numeric and "),
            F.col("categorical_fields").cast("string"), F.lit(" categorical fields."),
        ),
        F.when(has_missing, F.format_string("The highest missingness is in %s at %.1f%% missing values.", F.col("worst_column"), F.col("worst_pct") * 100)),
        F.when(has_duplicates, F.concat(F.lit("The dataset includes "), _whole("duplicate_row_count"), F.lit(" duplicate rows that may skew summaries or downstream models."))),
        F.when(F.col("constant_columns") > 0, F.concat(F.col("constant_columns").cast("string"), F.lit(" columns are constant and can be dropped without losing information."))),
        F.when(has_pair, F.concat(
            F.lit("Strong correlation detected between "), F.col("pair_a"), F.lit(" and "), F.col("pair_b"), F.lit(" ("), double_text(F.col("pair_value")), F.lit(")."),
        )),
        F.when(F.col("skewed_fields") > 0, F.concat(F.col("skewed_fields").cast("string"), F.lit(" numeric fields are heavily skewed, which may need transformation before modeling."))),
    ))
    steps = F.array_compact(F.array(
        F.when(has_missing, vocab.STEP_MISSING),
        F.when(has_duplicates, vocab.STEP_DUPLICATES),
        F.when(has_pair, vocab.STEP_CORRELATED),
        F.when(ready, vocab.STEP_READY).otherwise(vocab.STEP_NOT_READY),
    ))
    m = _measures(ds)
    return m.select(F.lit("finding").alias("kind"), F.posexplode(findings).alias("position", "text")).unionAll(
        m.select(F.lit("next_step").alias("kind"), F.posexplode(steps).alias("position", "text"))
    )


def summary(ds: Dataset) -> DataFrame:
    """The first three findings as one paragraph."""
    first = insights(ds).where("kind = 'finding' and position < 3")
    ordered = F.array_sort(F.collect_list(F.struct("position", "text")))
    return first.agg(F.concat_ws(" ", F.transform(ordered, lambda s: s["text"])).alias("summary"))


def readiness(ds: Dataset) -> DataFrame:
    ready = (F.col("candidates") > 0) | (F.col("numeric_fields") >= 2)
    return _measures(ds).select(ready.alias("is_ready"), F.col("candidates").cast("long").alias("target_candidate_count"), F.col("numeric_fields").cast("long").alias("numeric_fields"))


def capability_gates(ds: Dataset) -> DataFrame:
    """Whether the unsupervised scan and the supervised benchmark can run."""
    from .targets import heuristic_targets

    recommended = heuristic_targets(ds).where("recommended_task <> 'none'").count()
    m = _measures(ds)
    scan = (F.col("numeric_fields") >= 2) & (F.col("row_count") >= 10)
    bench = (F.col("candidates") > 0) | F.lit(recommended > 0)
    unsupervised = m.select(
        F.lit("unsupervised").alias("capability"), scan.alias("available"),
        F.when(scan, "At least two numeric columns are available for clustering, PCA, and anomaly detection.")
        .otherwise("Need at least two numeric columns and 10 rows for unsupervised analysis.").alias("reason"),
    )
    supervised = m.select(
        F.lit("supervised").alias("capability"), bench.alias("available"),
        F.when(bench, "Choose a target column to compare dataset-specific supervised models.")
        .otherwise("No obvious target candidates were inferred automatically, but you can still choose a valid target column manually.").alias("reason"),
    )
    return unsupervised.unionAll(supervised)
