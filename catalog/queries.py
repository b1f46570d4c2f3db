"""The registered queries: one per operator of the survey."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from columnary import vocab
from columnary.functions import day_ordinal, rounded
from columnary.operators import (
    archive, charts, drift, extra_trees, features, insights, metrics, ordinals, probe, profile, quality, samples, slices, stats, supervised,
    tally, targets, unsupervised,
)
from columnary.operators.dataset import Dataset, pin
from columnary.session import ensure_checkpoint_dir
from columnary.sources import purge_runs, read_csv, read_section, write_sections

from . import inputs
from .inputs import dataset, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def add(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return add


def _on(name: str, data: str, build: Callable[[Dataset], DataFrame]) -> None:
    REGISTRY[name] = lambda spark, sf_dir: build(dataset(spark, sf_dir, data))


# -- A. sources, sinks, row order ----------------------------------------------
_on("preview_rows", "events", lambda ds: samples.preview_rows(ds).select(
    "row_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "user_id", "event_type", "value", "props"))


@query("row_ordinals")
def row_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = Dataset(table(spark, sf_dir, "orders"), "orders", ["o_orderdate", "o_orderkey"])
    return ordinals.with_row_id(ds).select("o_orderkey", "row_id")


@query("csv_round_trip")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items written as CSV, read back with inferred columns."""
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}.csv"
    cols = ["l_orderkey", "order_quantity", "mixed", "return_status", "is_open", "ship_text"]
    source = table(spark, sf_dir, "dirty").select(*cols).withColumn("return_status", F.coalesce("return_status", F.lit("N/A")))
    source.withColumnRenamed("mixed", " mixed ").write.option("header", True).csv(path)
    ds = read_csv(spark, path)
    kinds = spark.createDataFrame([(f.ordinal, f.lane) for f in ds.fields], "ordinal int, data_type string")
    facts = tally.column_facts(ds).join(F.broadcast(kinds), "ordinal")
    return facts.select("ordinal", "name", "data_type", "non_null", "missing", F.col("unique").alias("unique_count"))


@query("csv_multiline")
def csv_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whose texts contain line breaks and quotes, written as CSV and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}.csv"
    layout = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    table(spark, sf_dir, "documents").write.options(**layout).csv(path)
    rows = read_csv(spark, path, order_by=["doc_id"]).source
    breaks = F.length("text") - F.length(F.translate("text", "\n", ""))
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), breaks.cast("long").alias("line_breaks"), "lang", "source", "n_chars")


@query("report_sink")
def report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs stored by section, one read back."""
    path = f"{ensure_checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    for run, name in ((1, "orders"), (2, "part")):
        ds = dataset(spark, sf_dir, name)
        write_sections({"column_profile": profile.column_profile(ds).drop("sample_values")}, path, run)
    return read_section(spark, path, "column_profile", 2).select("analysis_id", "ordinal", "name", "inferred_type", "unique_count", "non_null_count")


@query("report_sink_replaced")
def report_sink_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full section written again as an empty one, and one that was empty from the start."""
    path = f"{ensure_checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    full = profile.column_profile(dataset(spark, sf_dir, "orders")).select("name", "inferred_type")
    for run, kept in ((1, full), (1, full.limit(0)), (2, full.limit(0)), (3, full)):
        write_sections({"types": kept, "never": full.limit(0)}, path, run)
    types = read_section(spark, path, "types").withColumn("section", F.lit("types"))
    return types.unionByName(read_section(spark, path, "never").withColumn("section", F.lit("never")))


# -- B. column profile ----------------------------------------------------------
def _profile(ds: Dataset) -> DataFrame:
    return profile.column_profile(ds).withColumn("sample_values", F.concat_ws("|", "sample_values"))


for _name in ("lineitem", "dirty", "orders", "customer", "part", "events", "documents"):
    _on("column_profile" if _name == "lineitem" else f"column_profile_{_name}", _name, _profile)

_on("column_counts", "dirty", lambda ds: profile.column_profile(ds).select(
    "name", "non_null_count", "non_null_pct", "missing_count", "missing_pct", "unique_count", "unique_pct"))
_on("sample_values", "customer", lambda ds: profile.sample_values(ds))
_on("parse_ratios", "dirty", lambda ds: profile.column_ratios(ds).select(
    "name", rounded("bool_ratio", 6).alias("bool_ratio"), rounded("num_ratio", 6).alias("num_ratio"),
    "looks_date", rounded("date_ratio", 6).alias("date_ratio"), rounded("mean_length", 6).alias("mean_length")))
_on("column_types", "dirty", lambda ds: profile.profile_facts(ds).select("name", "inferred_type"))
_on("header_tokens", "dirty", lambda ds: profile.header_tokens(ds))
_on("pattern_shares", "dirty", lambda ds: profile.column_ratios(ds).select("name", "email_share", "phone_share", "url_share"))
_on("integer_ratio", "dirty", lambda ds: profile.column_ratios(ds).where("num_n > 0").select("name", rounded("int_ratio", 6).alias("int_ratio")))
_on("semantic_types", "dirty", lambda ds: profile.profile_facts(ds).select("name", "semantic_type", "semantic_confidence"))
_on("semantic_types_late_values", "late", lambda ds: profile.profile_facts(ds).select("name", "inferred_type", "semantic_type", "likely_role"))
_on("column_counts_decimal", "exact", lambda ds: profile.column_profile(ds).select("name", "non_null_count", "unique_count"))
_on("column_roles", "dirty", lambda ds: profile.profile_facts(ds).select("name", "likely_role"))


@query("semantic_types_strict")
def semantic_types_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = Dataset(table(spark, sf_dir, "orders"), "orders", ["o_orderkey"], semantic_rules="strict")
    return profile.profile_facts(ds).select("name", "semantic_type", "semantic_confidence", "likely_role")


_on("type_counts", "dirty", lambda ds: profile.type_counts(ds).select("inferred_type", "column_count"))
_on("key_columns", "dirty", lambda ds: profile.identifier_columns(ds).withColumn("kind", F.lit("identifier")).unionAll(
    profile.target_candidates(ds).withColumn("kind", F.lit("target_candidate"))).select("kind", "name"))
_on("type_mix", "dirty", lambda ds: profile.type_mix(ds).select("inferred_type", "column_count", rounded("pct", 4).alias("pct")))
_on("schema_groups", "dirty", lambda ds: profile.schema_groups(ds).select("group_title", "name"))
_on("unsupported_columns", "embeddings", lambda ds: ds.unsupported_columns().select("name").crossJoin(
    profile.overview(ds).select("row_count", "column_count")))

# -- C. data quality --------------------------------------------------------------
_on("missing_by_column", "dirty", lambda ds: quality.missing_by_column(ds).select("column", "missing_count", "missing_pct"))
_on("missing_cells", "dirty", lambda ds: quality.missing_cells(ds).withColumn("total_missing_pct", rounded("total_missing_pct", 6)))
_on("duplicate_rows_decimal", "exact", lambda ds: quality.duplicate_rows(ds))
_on("duplicate_rows", "order_pairs", lambda ds: quality.duplicate_rows(ds))
_on("duplicate_rows_text", "documents", lambda ds: quality.duplicate_rows(Dataset(ds.source.select("text", "lang"), "texts")))
_on("constant_columns", "dirty", lambda ds: quality.constant_columns(ds).select("column"))
_on("near_constant_columns", "dirty", lambda ds: quality.near_constant_columns(ds).select("column", "dominant_count", "dominant_value_ratio"))
_on("invalid_numeric_columns", "dirty", lambda ds: quality.invalid_numeric_columns(ds).select("column", "numeric_count", "numeric_parse_ratio"))
_on("high_cardinality_columns", "dirty", lambda ds: quality.high_cardinality_columns(ds).select("column", "unique_count", "unique_pct"))
_on("iqr_outliers", "dirty", lambda ds: quality.outlier_columns(ds).select(
    "column", "valid_count", "outlier_count", "outlier_pct", rounded("lower_fence", 6).alias("lower_fence"), rounded("upper_fence", 6).alias("upper_fence")))
_on("high_correlations", "dirty", lambda ds: quality.high_correlations(ds).select("column_a", "column_b", "correlation"))
_on("quality_flags", "dirty", lambda ds: quality.quality_flags(ds).select("column", "flag", "count", "ratio"))


def _score(rule: str) -> Callable[[Dataset], DataFrame]:
    def build(ds: Dataset) -> DataFrame:
        s = quality.quality_score(ds, rule)
        return s.select(*[rounded(c, 6).alias(c) for c in quality.PENALTIES], "quality_score")

    return build


_on("quality_score", "dirty", _score("share"))
_on("quality_score_count", "dirty", _score("count"))
_on("quality_score_clean", "lineitem", _score("share"))
_on("quality_recommendations", "dirty", lambda ds: quality.recommendations(ds))
_on("dataset_posture", "dirty", lambda ds: quality.posture(ds))
_on("completeness", "order_pairs", lambda ds: quality.completeness(ds))
_on("completeness_dirty", "dirty", lambda ds: quality.completeness(ds))

# -- D. statistics ------------------------------------------------------------------
# 60,000 values of two decimals put one mean in six exactly on a six-place rounding
# edge, where summation order decides; this table is compared on four places
_on("numeric_summary", "lineitem", lambda ds: stats.numeric_summary(ds).drop("ordinal").withColumn("mean", rounded("mean", 4)))
_on("numeric_summary_dirty", "dirty", lambda ds: stats.numeric_summary(ds).drop("ordinal"))


def _labels(ds: Dataset) -> DataFrame:
    out = stats.categorical_summary(ds).select("column", "unique_count", F.posexplode("top_values").alias("position", "top"))
    return out.select("column", "unique_count", "position", "top.value", "top.count", "top.pct")


_on("categorical_summary", "dirty", _labels)
_on("categorical_summary_documents", "documents", lambda ds: _labels(ds).withColumn("value", F.sha2("value", 256)))
_on("datetime_summary", "events", lambda ds: stats.datetime_summary(ds).drop("ordinal"))
_on("datetime_summary_text", "dirty", lambda ds: stats.datetime_summary(ds).drop("ordinal"))
_on("correlation_matrix", "lineitem", lambda ds: stats.correlation_matrix(ds).select("x", "y", "value"))
_on("correlation_matrix_dirty", "dirty", lambda ds: stats.correlation_matrix(ds).select("x", "y", "value"))
_on("correlation_matrix_wide", "wide", lambda ds: stats.correlation_matrix(ds).where("x_ordinal < y_ordinal").select("x", "y", "value"))
_on("correlation_matrix_wide_gaps", "wide_gaps", lambda ds: stats.correlation_matrix(ds).where("x_ordinal < y_ordinal").select("x", "y", "value"))
_on("strongest_correlations", "dirty", lambda ds: stats.strongest_correlations(ds))
_on("skewed_fields", "dirty", lambda ds: stats.skewed_fields(ds).select("column", "skew"))
_on("dominant_categories", "dirty", lambda ds: stats.dominant_categories(ds).drop("ordinal"))

@query("categorical_ties_long_text")
def categorical_ties_long_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts that begin alike and are equally frequent come in order of the whole text."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("the same beginning of all texts, " * 5), "text").alias("body"))
    return stats.label_counts(Dataset(texts, "texts", ["doc_id"]), ["body"]).select("rank", F.sha2("v", 256).alias("value"), "n")


# -- E. chart tables and drift --------------------------------------------------------
_on("missingness", "dirty", lambda ds: charts.missingness(ds).drop("ordinal"))
_on("histograms", "lineitem", lambda ds: charts.histograms(ds, 8).drop("ordinal"))
_on("boxplots", "dirty", lambda ds: charts.boxplots(ds, 8).drop("ordinal"))
_on("top_categories", "dirty", lambda ds: charts.top_categories(ds, 6).drop("ordinal"))
_on("correlation_heatmap", "dirty", lambda ds: charts.correlation_heatmap(ds, 10).select("x", "y", "value"))
_on("pairwise_scatter", "events", lambda ds: charts.pairwise_scatter(ds, 10))
_on("drift_numeric", "events", lambda ds: drift.numeric_drift(ds, columns=8).drop("ordinal"))
_on("drift_categorical", "events", lambda ds: drift.categorical_drift(ds, columns=6).drop("ordinal"))
_on("drift_checks", "orders", lambda ds: drift.drift_checks(ds).drop("ordinal"))
_on("drift_text_key", "customer_by_name", lambda ds: drift.drift_checks(ds).drop("ordinal"))
_on("drift_null_key", "gaps", lambda ds: drift.drift_checks(ds).drop("ordinal"))
@query("drift_no_key")
def drift_no_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves in the order of the files, of a table that is not kept and names no key."""
    return drift.drift_checks(Dataset(table(spark, sf_dir, "events"), "events", None, hold=False)).drop("ordinal")


_on("drift_by_time", "dirty", lambda ds: drift.drift_checks(ds, F.col("ship_text") >= "1999/01/01", numeric_columns_used=8, label_columns_used=6).drop("ordinal"))
_on("chart_picks", "events", lambda ds: charts.chart_picks(ds, None, 8, 6, 10, 6))

# -- F. insights ----------------------------------------------------------------------
_on("insights", "dirty", lambda ds: insights.insights(ds))
_on("insights_duplicates", "order_pairs", lambda ds: insights.insights(ds))
_on("insight_summary", "dirty", lambda ds: insights.summary(ds))
_on("modelling_readiness", "dirty", lambda ds: insights.readiness(ds))
_on("capability_gates", "dirty", lambda ds: insights.capability_gates(ds).select("capability", "available", "reason"))

# -- G. target recommendation -----------------------------------------------------------
_on("normalized_entropy", "dirty", lambda ds: targets.normalized_entropy(ds).drop("ordinal"))
_on("header_signals", "dirty", lambda ds: targets.header_signals(ds).drop("ordinal"))
_on("target_scores", "dirty", lambda ds: targets.heuristic_targets(ds).select("column", "recommended_task", "semantic_type", "verdict", "score"))
_on("target_reasons", "dirty", lambda ds: targets.heuristic_targets(ds).select("column", F.posexplode("reasons").alias("position", "reason")))
_on("target_top8", "dirty", lambda ds: targets.target_recommendations(ds, probe=False).select("column", "recommended_task", "verdict", "score"))
_on("preferred_target", "dirty", lambda ds: targets.preferred_target(ds))
_on("probe_rerank", "customer", lambda ds: targets.target_recommendations(ds).select(
    "column", "recommended_task", "verdict", "score", "heuristic_score", "probe_score", F.concat_ws("|", "reasons").alias("reasons")))


@query("probe_blend")
def probe_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blending rule on probe scores taken from the data (share of distinct values)."""
    ds = dataset(spark, sf_dir, "dirty")
    given = profile.column_profile(ds).where("inferred_type = 'numeric'").select(F.col("name").alias("column"), F.col("unique_pct").alias("probe_score"), F.lit("given").alias("reason"))
    return probe.blend(targets.heuristic_targets(ds), given).select("column", "score", "heuristic_score", "probe_score", F.size("reasons").alias("reason_count"))


# -- H. supervised benchmark --------------------------------------------------------------
@query("task_types")
def task_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = dataset(spark, sf_dir, "dirty")
    rows = [(n, features.task_type(ds, n)) for n in ds.names]
    usable = profile.column_profile(ds).select(F.col("name").alias("column"), F.col("non_null_count").alias("usable_rows"))
    return usable.join(spark.createDataFrame(rows, "column string, task string"), "column")


_on("stratified_split", "orders", lambda ds: supervised.split_table(ds, "o_orderpriority"))


@query("stratified_split_repeated_key")
def stratified_split_repeated_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row order by a day that many orders share."""
    return supervised.split_table(Dataset(table(spark, sf_dir, "orders"), "orders", ["o_orderdate"]), "o_orderpriority")


@query("stratified_split_no_key")
def stratified_split_no_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without any order."""
    return supervised.split_table(Dataset(table(spark, sf_dir, "documents"), "documents", None, hold=False), "lang")


@query("stratified_split_equal_rows")
def stratified_split_equal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a few kinds, all repeated: status and priority of the orders."""
    return supervised.split_table(Dataset(table(spark, sf_dir, "order_pairs"), "order_pairs", None), "o_orderpriority")


@query("class_weights_many")
def class_weights_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training weight of every class where there are thousands: the parts of the line items."""
    ds = dataset(spark, sf_dir, "lineitem")
    counts = features.class_counts(ds, ds.rows, "l_partkey")
    known = supervised.numbered_classes(counts, features.counted_weights(counts)).toDF("part", "position", "weight")
    met = ds.rows.join(known, ds.text("l_partkey").eqNullSafe(F.col("part")))
    return met.groupBy("part").agg(F.count(F.lit(1)).alias("n"), rounded(F.max("weight"), 6).alias("weight"))


@query("stratified_sample")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from columnary.operators.sampling import sample_rows

    ds = dataset(spark, sf_dir, "orders")
    sizes = features.class_sizes(ds, ds.rows, "o_orderstatus")
    sample = sample_rows(ds, ds.rows, vocab.TRAIN_ROWS, sizes, F.col("o_orderstatus"))
    return sample.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


_on("day_ordinals", "orders", lambda ds: ds.rows.select("o_orderkey", day_ordinal(F.col("o_orderdate")).cast("long").alias("day_number")))
_on("identifier_like", "documents", lambda ds: features.identifier_like(ds).drop("ordinal"))
_on("identifier_like_dirty", "dirty", lambda ds: features.identifier_like(ds).drop("ordinal"))
_on("feature_choice", "dirty", lambda ds: features.feature_choice_table(ds, "return_status").select("feature", "kind"))


def _gapped(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset(table(spark, sf_dir, "wide_gaps").drop("l_orderkey"), "wide_gaps", None)


@query("feature_trim")
def feature_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five widest of sixty numbers (a column without values is dropped) and the two fullest categories."""
    wide = features.feature_choice_table(_gapped(spark, sf_dir), None, numeric=5)
    texts = features.feature_choice_table(dataset(spark, sf_dir, "dirty"), "return_status", categorical=2).where("kind = 'categorical'")
    return wide.unionAll(texts)


@query("scan_features_trimmed")
def scan_features_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four widest numeric columns of a scan, and how many were on offer."""
    names, offered = unsupervised.scan_features(_gapped(spark, sf_dir), 4)
    return spark.createDataFrame([(i, n, offered) for i, n in enumerate(names)], "position int, feature string, offered int")


@query("scan_sampled")
def scan_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of an exact sample: its rows, its sizes and its note."""
    scan = unsupervised.unsupervised_scan(dataset(spark, sf_dir, "orders"), 3, max_rows=500)
    known = scan.rows.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("key_0").alias("keys"))
    return known.select("*", F.lit(scan.rows_scanned).cast("long").alias("scanned"), F.lit(scan.rows_available).cast("long").alias("available"), F.lit(scan.warnings.first()["text"]).alias("note"))


@query("feature_variance")
def feature_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = dataset(spark, sf_dir, "dirty")
    return unsupervised.scan_features_table(ds).withColumn("variance", rounded("variance", 2))


@query("impute_scale")
def impute_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and scales learnt on all rows, and the sum of squares after scaling."""
    ds = dataset(spark, sf_dir, "dirty")
    names = ["order_quantity", "discount_rate", "net_price", "spike"]
    medians, centres = features.impute_and_scale(ds, ds.rows, names)
    aggs = []
    for i, n in enumerate(names):
        z = (F.coalesce(ds.number(n), F.lit(medians[n])) - centres[n][0]) / centres[n][1]
        aggs.append(F.struct(
            F.lit(n).alias("feature"), F.lit(medians[n]).alias("median"), rounded(F.lit(centres[n][0]), 6).alias("mean"),
            rounded(F.lit(centres[n][1]), 6).alias("std"), rounded(F.sum(z * z), 2).alias("sum_of_squares"), rounded(F.max(z), 6).alias("largest"),
        ).alias(f"s{i}"))
    one = ds.rows.agg(*aggs)
    return one.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(names))])))


@query("infrequent_encode")
def infrequent_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories after mode filling and pooling of the rare ones."""
    ds = dataset(spark, sf_dir, "part")
    names = ["p_name", "p_brand", "p_type"]
    encoding = features.Encoding()
    features.learn_categories(ds, ds.rows, names, vocab.MAX_CATEGORIES, vocab.MIN_CATEGORY_SHARE, encoding)
    wide = ds.rows.select(*[features.encoded_category(ds, encoding, n).alias(n) for n in names])
    long = wide.unpivot([], names, "feature", "category")
    return long.groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n"))


@query("class_weights")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = dataset(spark, sf_dir, "orders")
    weights = features.class_weights(features.class_sizes(ds, ds.rows, "o_orderpriority"))
    return spark.createDataFrame(list(weights.items()), "label string, weight double").withColumn("weight", rounded("weight", 6))


_on("positive_label", "dirty", lambda ds: supervised.positive_label_table(ds, "is_open").withColumn("target", F.lit("is_open")).unionAll(
    supervised.positive_label_table(ds, "near_const").withColumn("target", F.lit("near_const"))))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[rounded(c, 6).alias(c) for c in df.columns])


REGISTRY["confusion_metrics"] = lambda spark, sf_dir: _rounded(metrics.classification_metrics(inputs.predictions(spark, sf_dir)))
REGISTRY["confusion_metrics_multiclass"] = lambda spark, sf_dir: _rounded(metrics.classification_metrics(inputs.multi_predictions(spark, sf_dir)))
REGISTRY["confusion_metrics_many_classes"] = lambda spark, sf_dir: _rounded(metrics.classification_metrics(inputs.wide_predictions(spark, sf_dir)))
REGISTRY["roc_auc"] = lambda spark, sf_dir: _rounded(metrics.roc_auc(inputs.predictions(spark, sf_dir)))
REGISTRY["average_precision"] = lambda spark, sf_dir: _rounded(metrics.average_precision(inputs.predictions(spark, sf_dir)))
REGISTRY["regression_metrics"] = lambda spark, sf_dir: _rounded(metrics.regression_metrics(inputs.value_predictions(spark, sf_dir)))


def _rule_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of three rule-made classifiers, one row per model (pinned)."""
    lines = table(spark, sf_dir, "lineitem")
    parts = []
    for position, (name, limit) in enumerate((("Low Cut", 10), ("Middle Cut", 25), ("High Cut", 40))):
        rows = lines.select(
            F.when(F.col("l_returnflag") == "R", "yes").otherwise("no").alias("actual"),
            F.when(F.col("l_quantity") > limit, "yes").otherwise("no").alias("prediction"),
        )
        parts.append(metrics.classification_metrics(rows).withColumn("position", F.lit(position)).withColumn("model", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return pin(out)


REGISTRY["model_choice"] = lambda spark, sf_dir: metrics.model_choice(_rule_models(spark, sf_dir), "classification").select(
    "model", rounded("score", 6).alias("score"), "is_best")
REGISTRY["metric_chart"] = lambda spark, sf_dir: metrics.metric_chart(
    _rule_models(spark, sf_dir).unpivot("model", ["accuracy", "balanced_accuracy", "f1", "precision", "recall"], "metric", "value"), "classification"
).select("model", "metric", rounded("raw", 6).alias("raw"), rounded("normalized", 6).alias("normalized"))


@query("relative_importance")
def relative_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the largest, with feature variance standing in for importance."""
    given = unsupervised.scan_features_table(dataset(spark, sf_dir, "dirty")).select("feature", F.col("variance").alias("importance"))
    return metrics.relative_importance(given).select("feature", rounded("raw", 2).alias("raw"), rounded("normalized", 6).alias("normalized"))


@query("supervised_warnings")
def supervised_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warning rules on the measured metrics of a rule-made classifier."""
    found = metrics.classification_metrics(inputs.predictions(spark, sf_dir)).crossJoin(metrics.roc_auc(inputs.predictions(spark, sf_dir)))
    counts = inputs.predictions(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("rows_available"), (F.count_if("positive") / F.count(F.lit(1))).alias("p"), F.countDistinct("actual").alias("target_cardinality"))
    run = counts.crossJoin(found).select(
        F.lit("classification").alias("task_type"), "rows_available", F.lit(5000).alias("rows_used"), F.lit(True).alias("sampling_applied"),
        F.lit(2).alias("high_cardinality_features"), F.lit(1).alias("dropped_identifier_like_features"), F.lit(3).alias("trimmed_numeric_features"),
        F.lit(0).alias("trimmed_categorical_features"), F.lit(100).alias("test_rows"), F.greatest("p", 1 - F.col("p")).alias("dominant_share"),
        "target_cardinality", "balanced_accuracy", "f1", "roc_auc",
    )
    return supervised.supervised_warnings(run, vocab.REPORT_ROWS)


SLICED = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus"]
SLICE_COLUMNS = ["feature", "feature_type", "bucket", "lower", "upper", "label", "count", "target_label", "target_value", "target_class"]
_on("slices_regression", "lineitem", lambda ds: slices.target_slices(ds, "l_extendedprice", "regression", SLICED, 4, 6).select(*SLICE_COLUMNS))
_on("slices_binary", "lineitem", lambda ds: slices.target_slices(ds, "l_linestatus", "classification", SLICED, 4, 6).select(*SLICE_COLUMNS))
_on("slices_multiclass", "dirty", lambda ds: slices.target_slices(
    ds, "return_status", "classification", ["spike", "order_quantity", "discount_rate", "priority", "is_open", "mixed", "near_const"], 4, 6).select(*SLICE_COLUMNS))

_runs: dict = {}


def _benchmark(spark: SparkSession, sf_dir: str, data: str, target: str) -> supervised.Benchmark:
    """One benchmark per session; its result tables are separate queries."""
    key = (spark.sparkContext.applicationId, sf_dir, data, target)
    if key not in _runs:
        _runs[key] = supervised.supervised_benchmark(dataset(spark, sf_dir, data), target)
    return _runs[key]


REGISTRY["supervised_benchmark"] = lambda spark, sf_dir: _benchmark(spark, sf_dir, "customer", "c_mktsegment").model_comparison
REGISTRY["supervised_regression"] = lambda spark, sf_dir: _benchmark(spark, sf_dir, "part", "p_retailprice").model_comparison
REGISTRY["supervised_model_scores"] = lambda spark, sf_dir: _benchmark(spark, sf_dir, "part", "p_retailprice").model_scores
REGISTRY["feature_importance"] = lambda spark, sf_dir: _benchmark(spark, sf_dir, "part", "p_retailprice").feature_importance
REGISTRY["prediction_preview"] = lambda spark, sf_dir: supervised.prediction_preview(_benchmark(spark, sf_dir, "customer", "c_mktsegment"))
REGISTRY["exact_matches"] = lambda spark, sf_dir: supervised.exact_matches(supervised.prediction_preview(_benchmark(spark, sf_dir, "customer", "c_mktsegment")))
REGISTRY["supervised_diagnostics"] = lambda spark, sf_dir: _benchmark(spark, sf_dir, "part", "p_retailprice").diagnostics.drop("dominant_share")
REGISTRY["benchmark_warnings"] = lambda spark, sf_dir: _benchmark(spark, sf_dir, "customer", "c_mktsegment").warnings


@query("extra_trees_invariants")
def extra_trees_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every forest, grown by levels over all training rows; grown in tasks it is the same."""
    p = supervised.prepare(dataset(spark, sf_dir, "customer"), "c_mktsegment")
    trees, depth = 8, 6
    by_levels, in_tasks = (
        extra_trees.ExtraTrees(len(p.labels), trees, depth, "sqrt", vocab.SEED, local_bytes=size).fit(p.train).nodes.drop(columns="stats")
        for size in (0, extra_trees.LOCAL_BYTES))
    p.release()
    nodes, others = spark.createDataFrame(by_levels), spark.createDataFrame(in_tasks)
    keys = ["tree", "node", "feature", "n"]
    unlike = nodes.select(keys).exceptAll(others.select(keys)).unionAll(others.select(keys).exceptAll(nodes.select(keys)))
    children = nodes.where("node > 1").groupBy("tree", F.shiftright("node", 1).alias("node")).agg(F.sum("n").alias("below"), F.count(F.lit(1)).alias("sides"))
    known = nodes.join(children, ["tree", "node"], "left")
    inner, bad = F.col("feature") >= 0, F.coalesce((F.col("below") == F.col("n")) & (F.col("sides") == 2), F.lit(False))
    return known.agg(
        F.count_if(F.col("node") == 1).alias("trees"), F.sum(F.when(~inner, F.col("n")).otherwise(0)).alias("leaf_rows"),
        F.count_if(inner & ~bad).alias("uneven_nodes"), F.count_if(inner & ~((F.col("low") <= F.col("threshold")) & (F.col("threshold") < F.col("high")))).alias("outside_range"),
        F.count_if(F.col("gain") < -1e-6).alias("worse_splits"), F.count_if(F.col("node") >= 2 ** (depth + 1)).alias("too_deep"),
    ).crossJoin(unlike.agg(F.count(F.lit(1)).alias("unlike_in_tasks")))  # one row each


# -- I. unsupervised scan -------------------------------------------------------------------
def _scan(spark: SparkSession, sf_dir: str) -> unsupervised.Scan:
    key = (spark.sparkContext.applicationId, sf_dir, "scan")
    if key not in _runs:
        _runs[key] = unsupervised.unsupervised_scan(dataset(spark, sf_dir, "orders"), 4)
    return _runs[key]


REGISTRY["kmeans_clusters"] = lambda spark, sf_dir: _scan(spark, sf_dir).cluster_distribution()
REGISTRY["isolation_forest"] = lambda spark, sf_dir: _scan(spark, sf_dir).rows
REGISTRY["anomaly_count"] = lambda spark, sf_dir: _scan(spark, sf_dir).anomaly_count()
REGISTRY["scan_preview"] = lambda spark, sf_dir: _scan(spark, sf_dir).preview()
REGISTRY["pca_variance"] = lambda spark, sf_dir: spark.createDataFrame(
    [(i + 1, v, unsupervised.retained_variance(_scan(spark, sf_dir))) for i, v in enumerate(_scan(spark, sf_dir).explained_variance)],
    "component int, explained_variance double, retained_pct double")


@query("isolation_forest_lineitem")
def isolation_forest_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a scan of many rows: all scored, the share of flags, odd rows apart from the rest."""
    ds = dataset(spark, sf_dir, "lineitem")
    scan = unsupervised.unsupervised_scan(ds, 3)
    flagged = F.count_if("anomaly_flag")
    return scan.rows.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("cluster").alias("clusters"),
        (flagged <= F.floor((F.count(F.lit(1)) - 1) * vocab.CONTAMINATION) + 1).alias("flags_bounded"), (flagged > 0).alias("flags_found"),
        F.count_if(F.col("anomaly_flag") != (F.col("anomaly_score") < 0)).alias("sign_errors"),
        F.lit(scan.rows_scanned).cast("long").alias("rows_scanned"))


@query("top_anomalies")
def top_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity scale on a given score: the negated event value."""
    given = table(spark, sf_dir, "events").select(F.col("event_id").alias("key_0"), (-F.col("value")).alias("anomaly_score"))
    return unsupervised.top_anomalies(given).select(F.col("key_0").alias("event_id"), "anomaly_score", rounded("severity", 6).alias("severity"))


@query("cluster_share")
def cluster_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster sizes and shares on a given grouping: the order status."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("cluster"))
    given = unsupervised.Scan(3, [], 0, 0, rows, [], rows)
    return given.cluster_distribution().select("cluster", "count", rounded("share", 6).alias("share"))


@query("scan_invariants")
def scan_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every scan, asked of all its rows."""
    rows = _scan(spark, sf_dir).rows
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("key_0").alias("key_count"), F.count_distinct("cluster").alias("clusters"),
        F.count_if(F.col("anomaly_flag") != (F.col("anomaly_score") < 0)).alias("sign_errors"),
        (F.count_if(F.col("anomaly_score") < 0) <= F.floor((F.count(F.lit(1)) - 1) * 0.05) + 1).alias("flags_bounded"),
        (F.count_if(F.col("anomaly_score") <= 0) >= F.floor((F.count(F.lit(1)) - 1) * 0.05) + 1).alias("flags_filled"),
        (rounded(F.abs(F.avg("pc1")), 3) + rounded(F.abs(F.avg("pc2")), 3)).alias("centre"),
    )


@query("cluster_order")
def cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters are numbered by falling size and hold all rows."""
    found = _scan(spark, sf_dir).cluster_distribution()
    ahead = F.lag("count").over(Window.orderBy("cluster"))  # at most eight rows
    return found.withColumn("ahead", ahead).agg(
        F.sum("count").alias("row_count"), rounded(F.sum("share"), 6).alias("share"), F.count_if(F.col("ahead") < F.col("count")).alias("out_of_order"))


@query("scan_preview_rows")
def scan_preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row number and the record of the previewed rows, against the orders they came from."""
    shown = _scan(spark, sf_dir).preview()
    placed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key_0"), F.col("o_totalprice").alias("price"))
    return shown.join(placed, "key_0").agg(
        F.count(F.lit(1)).alias("shown"), F.count_if(F.col("record.o_totalprice") == F.col("price")).alias("records"),
        F.count_if(F.col("row") == F.col("key_0") - F.lit(table(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0]) + 1).alias("placed"))


@query("preview_records")
def preview_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the prediction preview are the features of the rows they name."""
    shown = supervised.prediction_preview(_benchmark(spark, sf_dir, "part", "p_retailprice"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key_0"), "p_size")
    return shown.join(parts, "key_0").agg(F.count(F.lit(1)).alias("shown"), F.count_if(F.col("record.p_size") == F.col("p_size")).alias("records"))


@query("slices_empty_band")
def slices_empty_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band whose edges lie in the gap behind a repeated value holds no row and is listed."""
    made = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.expr(inputs.BAND_GAP).alias("spread"))
    ds = Dataset(made, "orders", ["o_orderkey"])
    return slices.target_slices(ds, "o_totalprice", "regression", ["spread"]).select("feature", "bucket", "lower", "upper", "count", rounded("target_value", 4).alias("target_value"))


@query("report_purge")
def report_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of two schemas stored, one purged, one purged and written again: what is read back."""
    path = f"{ensure_checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    for run, kept in ((1, parts), (2, parts.withColumn("p_partkey", F.col("p_partkey") + 1).withColumn("extra", F.lit("e"))), (3, parts)):
        write_sections({"parts": kept}, path, run)
    purge_runs(spark, path, [1, 3])
    write_sections({"parts": parts.where("p_brand is not null").withColumn("extra", F.lit("again"))}, path, 3)
    return read_section(spark, path, "parts").groupBy("analysis_id", "p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"), F.max("extra").alias("extra"))


@query("scan_preview_keys")
def scan_preview_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = _scan(spark, sf_dir).preview()
    return shown.join(table(spark, sf_dir, "orders"), F.col("key_0") == F.col("o_orderkey"), "left").agg(
        F.count(F.lit(1)).alias("shown"), F.count("o_orderkey").alias("known"))


@query("pca_two_columns")
def pca_two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two standardised columns have the variance shares (1 + |r|) / 2 and (1 - |r|) / 2."""
    ds = Dataset(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "customer", ["c_custkey"])
    shares = unsupervised.unsupervised_scan(ds, 2).explained_variance
    return spark.createDataFrame([(i + 1, round(v, 6)) for i, v in enumerate(shares)], "component int, share double")


@query("linear_fit_line")
def linear_fit_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's linear model on one feature is the least-squares line."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("label"), array_to_vector(F.array("l_quantity")).alias("features"))
    line = dict(supervised.value_models(2, 2, 2))["Linear Regression"].fit(rows)
    return spark.createDataFrame([(round(float(line.coefficients[0]), 4), round(float(line.intercept), 2), round(float(line.summary.r2), 6))], "slope double, intercept double, r2 double")


@query("prediction_actuals")
def prediction_actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All held-out predictions, their actual values looked up in the table."""
    b = _benchmark(spark, sf_dir, "customer", "c_mktsegment")
    same = F.col("actual") == F.col("c_mktsegment")
    known = b.predictions.join(table(spark, sf_dir, "customer"), F.col("key_0") == F.col("c_custkey"))
    right = metrics.classification_metrics(b.predictions.select("actual", "prediction")).first()["accuracy"]
    told = b.model_comparison.where((F.col("model") == b.best_model) & (F.col("metric") == "accuracy")).first()["value"]
    return known.agg(F.count(F.lit(1)).alias("test_rows"), F.count_if(~same).alias("wrong_actuals")).withColumn("accuracy_agrees", F.lit(abs(right - told) < 1e-3))


@query("scan_warnings")
def scan_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = table(spark, sf_dir, "orders").agg(F.lit(vocab.SCAN_ROWS).alias("used"), F.count(F.lit(1)).alias("available")).withColumn("kept", F.lit(16)).withColumn("offered", F.lit(20))
    return unsupervised.scan_warnings(run)


# -- J. run archive -----------------------------------------------------------------------------
def _listing(spark: SparkSession, sf_dir: str, owner: int | None = None) -> DataFrame:
    full = archive.with_experiments(inputs.runs(spark, sf_dir), inputs.experiments(spark, sf_dir), inputs.deleted_experiments(spark, sf_dir))
    return archive.list_runs(full, owner)


def _flat(listing: DataFrame) -> DataFrame:
    return listing.select(
        "id", "user_id", "display_name", "source_filename", "status", F.col("overview.dataset_name").alias("dataset_name"),
        F.col("insights.is_ready").alias("is_ready"), "experiment_count", F.col("latest_experiment.id").alias("latest_id"),
        F.col("latest_experiment.summary").alias("latest_summary"))


REGISTRY["runs_list"] = lambda spark, sf_dir: _flat(_listing(spark, sf_dir, 7))
REGISTRY["runs_search"] = lambda spark, sf_dir: _flat(archive.search_runs(_listing(spark, sf_dir), " Machinery ", "ml-ready", "with-ml"))
REGISTRY["runs_search_experiment"] = lambda spark, sf_dir: _flat(archive.search_runs(_listing(spark, sf_dir), "status o", "eda-first"))
REGISTRY["runs_stats"] = lambda spark, sf_dir: archive.archive_statistics(
    _listing(spark, sf_dir), archive.search_runs(_listing(spark, sf_dir), "building", ml="without-ml"))
REGISTRY["experiments_latest"] = lambda spark, sf_dir: archive.latest_results(
    inputs.experiments(spark, sf_dir), inputs.deleted_experiments(spark, sf_dir))
REGISTRY["runs_purge"] = lambda spark, sf_dir: archive.purge_runs(inputs.runs(spark, sf_dir), 3).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
REGISTRY["experiments_purge"] = lambda spark, sf_dir: archive.purge_experiments(
    inputs.experiments(spark, sf_dir), archive.purge_runs(inputs.runs(spark, sf_dir), 3)).groupBy("experiment_type").agg(F.count(F.lit(1)).alias("n"))
