"""Supervised benchmark: prepare, split, fit, compare, explain."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import column, rounded
from .dataset import Dataset, pin
from .extra_trees import ExtraTrees
from .features import (
    FeatureChoice, Encoding, choose_features, class_sizes, class_weights, feature_vector, is_number, learn_encoding, task_type,
)
from .forests import GroupedForest
from .metrics import average_precision, classification_metrics, model_choice, regression_metrics, roc_auc
from .ordinals import with_row_id
from .sampling import can_stratify, quotas, row_hash, sample_rows, split_rows
from .slices import target_slices
from .tally import column_facts

ALL = "all"
_CLASS, _INDEX, _WEIGHT = "__class", "__index", "__weight"
CLASS_METRICS = ["accuracy", "balanced_accuracy", "f1", "precision", "recall"]
VALUE_METRICS = ["r2", "explained_variance", "mae", "rmse"]


def positive_label(sizes: dict[str, int], hints: list[str] = vocab.POSITIVE_HINTS) -> str | None:
    """The label counted as positive: a known word, else the rarer class."""
    if len(sizes) != 2:
        return None
    labels = sorted(sizes)
    plain: dict[str, str] = {}
    for label in labels:
        plain.setdefault(label.strip().lower(), label)
    for hint in hints:
        if hint in plain:
            return plain[hint]
    return min(labels, key=lambda g: (sizes[g], labels.index(g)))


def positive_label_table(ds: Dataset, target: str, hints: list[str] = vocab.POSITIVE_HINTS) -> DataFrame:
    """The rule applied to the classes of a column: one row, none unless it has two."""
    chosen = positive_label(class_sizes(ds, ds.rows.where(ds.text(target).isNotNull()), target), hints)
    return ds.spark.createDataFrame([] if chosen is None else [(chosen,)], "positive_label string")


def holdout(ds: Dataset, rows: DataFrame, share: float, sizes: dict[str, int] | None, target: str) -> tuple[DataFrame, DataFrame, int, int]:
    """Test rows, training rows, and the numbers of training and test rows.

    Stratified when every class has two rows; the test side takes exactly
    ``ceil(share * n)`` rows by hash of the row, equal rows included.
    """
    stratified = sizes is not None and can_stratify(sizes)
    group = ds.text(target) if stratified else F.lit(ALL)
    per = sizes if stratified else {ALL: sum(sizes.values()) if sizes else rows.count()}
    total = sum(per.values())
    test = math.ceil(share * total)
    held_out, kept = split_rows(rows, group, row_hash(ds), quotas(per, test))
    return held_out, kept, total - test, test


@dataclass
class Prepared:
    """Everything the fits need: encoded rows, labels, learnt preparation."""

    ds: Dataset
    target: str
    task: str
    choice: FeatureChoice
    encoding: Encoding
    labels: list[str]
    sizes: dict[str, int]
    train: DataFrame
    test: DataFrame
    train_rows: int
    test_rows: int
    rows_available: int
    rows_used: int
    rows: DataFrame

    def release(self) -> None:
        self.train.unpersist()
        self.test.unpersist()


def class_table(ds: Dataset, labels: list[str], weights: dict[str, float]) -> DataFrame:
    """One row per class: its name, index and training weight (1 where training rows have none of it)."""
    rows = [(g, float(i), float(weights.get(g, 1.0))) for i, g in enumerate(labels)]
    return ds.spark.createDataFrame(rows, f"{_CLASS} string, {_INDEX} double, {_WEIGHT} double")


def numbered_classes(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """``class_table`` of classes in order of their names that are themselves a table, for any number of them."""
    placed = with_row_id(Dataset(counts.select("g"), "classes", ["g"], hold=False))
    known = weights.select(F.col("g").alias(_CLASS), F.col("weight").alias(_WEIGHT))
    return placed.join(known, F.col("g").eqNullSafe(F.col(_CLASS))).select(_CLASS, F.col("row_id").cast("double").alias(_INDEX), _WEIGHT)


def _label_order(ds: Dataset, target: str, sizes: dict[str, int]) -> list[str]:
    return sorted(sizes, key=float) if is_number(ds, target) and ds.get(target).lane != "bool" else sorted(sizes)


def prepare(
    ds: Dataset, target: str, task: str | None = None, max_rows: int | None = None, test_share: float = 0.2,
    max_categories: int = vocab.MAX_CATEGORIES, min_share: float = vocab.MIN_CATEGORY_SHARE, min_rows: int = vocab.MIN_SUPERVISED_ROWS,
    choice: FeatureChoice | None = None,
) -> Prepared:
    if target not in ds.names:
        raise ValueError("Target column not found in dataset.")
    facts = column_facts(ds).where(F.col("name") == target).first()
    available, complete = facts.non_null, facts.missing == 0
    present = ds.rows if complete else ds.rows.where(ds.text(target).isNotNull())
    whole = ds if complete else ds.within(present)  # a complete target shares the known facts
    if available < min_rows:
        raise ValueError(f"Supervised analysis requires at least {min_rows} rows after dropping missing target values.")
    task = task or task_type(whole, target)
    used, sizes = available, class_sizes(ds, present, target) if task == "classification" else {}
    rows = present
    if max_rows is not None and available > max_rows:
        stratified = task == "classification" and can_stratify(sizes)
        group = ds.text(target) if stratified else F.lit(ALL)
        rows = sample_rows(ds, present, max_rows, sizes if stratified else {ALL: available}, group)
        used = max_rows
        sizes = class_sizes(ds, rows, target) if task == "classification" else {}
        whole = ds.within(rows)
    choice = choice or choose_features(whole, target)
    if not choice.numeric and not choice.categorical:
        raise ValueError("No usable feature columns remain after excluding the target column.")
    test_raw, train_raw, train_rows, test_rows = holdout(ds, rows, test_share, sizes or {ALL: used}, target)
    encoding = learn_encoding(ds, train_raw, choice, max_categories, min_share)
    labels = _label_order(ds, target, sizes)

    classes = None
    if task == "classification":
        weights = class_weights(class_sizes(ds, train_raw, target))
        classes = class_table(ds, labels, weights)
        y, w = F.col(_INDEX), F.col(_WEIGHT)
    else:
        y, w = ds.number(target), F.lit(1.0)
    keys = [k.alias(f"key_{i}") for i, k in enumerate(ds.order_columns)]
    columns = [*keys, feature_vector(ds, encoding).alias("features"), y.alias("label"), w.alias("weight")]

    # held-out rows keep their features as they were, for the preview
    record = F.struct(*[column(n) for n in [*choice.numeric, *choice.categorical]]).alias("record")

    def encoded(side: DataFrame, *more: Column) -> DataFrame:
        # one row per class: the plan is as large for many classes as for two
        known = side if classes is None else side.join(F.broadcast(classes), ds.text(target) == F.col(_CLASS))
        return known.select(*columns, *more)

    level = StorageLevel.MEMORY_AND_DISK
    return Prepared(
        ds, target, task, choice, encoding, labels, sizes, encoded(train_raw).persist(level),
        encoded(test_raw, record).persist(level), train_rows, test_rows, available, used, rows,
    )


def class_models(n: int, classes: int, trees: int, extra: int, depth: int) -> list[tuple[str, object]]:
    common = {"labelCol": "label", "featuresCol": "features", "weightCol": "weight"}
    forest = {**common, "featureSubsetStrategy": "sqrt", "maxDepth": depth, "minInstancesPerNode": 2, "maxMemoryInMB": 512}
    return [
        ("Logistic Regression", LogisticRegression(regParam=1.0 / (0.75 * max(1, n)), maxIter=1500, standardization=False, **common)),
        ("Random Forest", GroupedForest(RandomForestClassifier(**forest), RandomForestClassificationModel, classes, trees, vocab.SEED)),
        ("Extra Trees", ExtraTrees(classes, extra, depth, "sqrt", vocab.SEED)),
    ]


def value_models(trees: int, extra: int, depth: int) -> list[tuple[str, object]]:
    common = {"labelCol": "label", "featuresCol": "features"}
    forest = {**common, "maxDepth": depth, "minInstancesPerNode": 2, "maxMemoryInMB": 512}
    return [
        ("Linear Regression", LinearRegression(solver="normal", regParam=0.0, **common)),
        ("Random Forest", GroupedForest(RandomForestRegressor(featureSubsetStrategy="0.8", **forest), RandomForestRegressionModel, 0, trees, vocab.SEED)),
        ("Extra Trees", ExtraTrees(0, extra, depth, 0.9, vocab.SEED)),
    ]


def scored(p: Prepared, model) -> DataFrame:
    """Test rows with ``actual``, ``prediction`` and, for two classes, the
    probability of the positive label."""
    out = model.transform(p.test)
    keys = [c for c in p.test.columns if c.startswith("key_")]
    if p.task == "regression":
        return out.select(*keys, F.col("label").alias("actual"), "prediction", "record")
    score = F.lit(None).cast("double")
    positive = positive_label(p.sizes)
    if positive is not None:
        score = vector_to_array("probability")[p.labels.index(positive)]
    names = class_table(p.ds, p.labels, {}).select(F.col(_INDEX), F.col(_CLASS))
    for index, name in (("label", "actual"), ("prediction", "predicted")):
        out = out.join(F.broadcast(names.toDF(f"{name}_index", name)), F.col(index) == F.col(f"{name}_index"), "left")
    return out.select(*keys, "actual", F.col("predicted").alias("prediction"), score.alias("score"), "record")


def evaluate(p: Prepared, rows: DataFrame) -> dict[str, float]:
    if p.task == "regression":
        return regression_metrics(rows).first().asDict()
    found = classification_metrics(rows).first().asDict()
    positive = positive_label(p.sizes)
    if positive is not None:
        binary = rows.select((F.col("actual") == positive).alias("positive"), "score")
        both = binary.agg(F.count_if("positive").alias("a"), F.count_if(~F.col("positive")).alias("b")).first()
        if both.a and both.b:
            found.update(roc_auc(binary).first().asDict())
            found.update(average_precision(binary).first().asDict())
    return found


def importances(model, names: list[str]) -> list[tuple[str, float]]:
    """Importance per encoded feature: trees report it, linear models by |coef|."""
    if hasattr(model, "featureImportances"):
        values = list(model.featureImportances.toArray())
    elif hasattr(model, "coefficientMatrix"):
        matrix = model.coefficientMatrix.toArray()
        values = list(abs(matrix).mean(axis=0))
    else:
        values = [abs(v) for v in model.coefficients.toArray()]
    return [(n, float(v)) for n, v in zip(names, values)]


@dataclass
class Benchmark:
    """Result tables of one supervised run."""

    task: str
    best_model: str
    model_comparison: DataFrame
    model_scores: DataFrame
    feature_importance: DataFrame
    predictions: DataFrame
    diagnostics: DataFrame
    warnings: DataFrame
    prepared: Prepared
    report_rows: int | None = None

    def target_slices(self, max_rows: int | None = None) -> DataFrame:
        """Slices of all used rows, or of the ``report_rows`` the warnings speak of; ``max_rows`` replaces them."""
        p = self.prepared
        rows = p.rows
        max_rows = self.report_rows if max_rows is None else max_rows
        if max_rows is not None and p.rows_used > max_rows:
            stratified = p.task == "classification" and can_stratify(p.sizes)
            group = p.ds.text(p.target) if stratified else F.lit(ALL)
            rows = sample_rows(p.ds, rows, max_rows, p.sizes if stratified else {ALL: p.rows_used}, group, vocab.SEED + 1)
        return target_slices(p.ds.within(rows), p.target, p.task, p.choice.numeric + p.choice.categorical)


def supervised_benchmark(
    ds: Dataset, target: str, max_rows: int | None = None, trees: int = vocab.FOREST_TREES, extra: int = vocab.EXTRA_TREES,
    depth: int = 15, report_rows: int | None = None,
) -> Benchmark:
    """Fit three models on 80 % of the rows and compare them on the rest.

    No row cap by default; ``max_rows`` takes a stratified sample of exact size.
    """
    p = prepare(ds, target, max_rows=max_rows)
    models = class_models(p.train_rows, len(p.labels), trees, extra, depth) if p.task == "classification" else value_models(trees, extra, depth)
    names = VALUE_METRICS if p.task == "regression" else CLASS_METRICS + ["roc_auc", "average_precision"]
    table, fitted, shown = [], {}, {}
    for position, (label, estimator) in enumerate(models):
        model = estimator.fit(p.train)
        fitted[label], shown[label] = model, scored(p, model)
        held_out = shown[label].persist(StorageLevel.MEMORY_AND_DISK)  # several metrics read it
        found = evaluate(p, held_out)
        held_out.unpersist()
        table.append((position, label, *[found.get(m) for m in names]))
    schema = "position int, model string, " + ", ".join(f"{m} double" for m in names)
    wide = ds.spark.createDataFrame(table, schema)
    choice = pin(model_choice(wide, p.task))
    best = choice.where("is_best").first().model
    comparison = wide.unpivot(["position", "model"], names, "metric", "value").where("value is not null").withColumn("value", rounded("value", 6))
    ranked = ds.spark.createDataFrame(importances(fitted[best], p.encoding.names()), "feature string, importance double")
    importance = ranked.orderBy(F.desc("importance"), "feature").limit(15).withColumn("importance", rounded("importance", 6))
    diagnostics = diagnostics_table(p)
    metrics = wide.where(F.col("model") == best).drop("position", "model")
    warned = supervised_warnings(
        diagnostics.crossJoin(metrics), reporting_rows=min(report_rows or p.rows_used, p.rows_used)  # one row each
    )
    return Benchmark(p.task, best, comparison, choice, importance, shown[best], diagnostics, warned, p, report_rows)


def prediction_preview(b: Benchmark, limit: int = vocab.PREVIEW_ROWS) -> DataFrame:
    """First held-out rows in row order: actual and predicted value and the features as ``record``."""
    keys = [c for c in b.predictions.columns if c.startswith("key_")]
    return b.predictions.orderBy(*keys).limit(limit)


def exact_matches(preview: DataFrame) -> DataFrame:
    same = F.col("actual").cast("string") == F.col("prediction").cast("string")
    return preview.agg(F.count_if(same).alias("exact_matches"), F.count(F.lit(1)).alias("preview_rows"))


DIAGNOSTIC_SCHEMA = (
    "task_type string, rows_available long, rows_used long, training_rows long, test_rows long, numeric_features int, "
    "categorical_features int, high_cardinality_features int, dropped_identifier_like_features int, trimmed_numeric_features int, "
    "trimmed_categorical_features int, sampling_applied boolean, target_cardinality long, dominant_share double"
)


def diagnostics_table(p: Prepared) -> DataFrame:
    c = p.choice
    known = p.ds if p.rows is p.ds.rows else p.ds.within(p.rows)  # the whole table's facts are there already
    cardinality = len(p.sizes) if p.sizes else column_facts(known).where(F.col("name") == p.target).first()["unique"]
    dominant = max(p.sizes.values()) / sum(p.sizes.values()) if p.sizes else None
    row = (
        p.task, p.rows_available, p.rows_used, p.train_rows, p.test_rows, len(c.numeric), len(c.categorical), c.high_cardinality,
        c.dropped_identifier_like, c.trimmed_numeric, c.trimmed_categorical, p.rows_used < p.rows_available, cardinality, dominant,
    )
    return p.ds.spark.createDataFrame([row], DIAGNOSTIC_SCHEMA)


def supervised_warnings(run: DataFrame, reporting_rows: int | None = None) -> DataFrame:
    """Warnings of a run, in order: ``position, text``.

    ``run`` is one row: the diagnostics columns and the metrics of the best model.
    """

    def whole(name: str) -> Column:
        return F.format_number(F.col(name), 0)

    def metric(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0)) if name in run.columns else F.lit(0.0)

    def text(*parts) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    classes, values = F.col("task_type") == "classification", F.col("task_type") == "regression"
    weak_auc = (F.col("roc_auc") < 0.67) if "roc_auc" in run.columns else F.lit(False)
    weak = F.coalesce(weak_auc, F.lit(False)) | (metric("balanced_accuracy") < 0.6) | (metric("f1") < 0.58)
    reduced = F.lit(reporting_rows) < F.col("rows_used") if reporting_rows is not None else F.lit(False)
    trimmed = (F.col("trimmed_numeric_features") > 0) | (F.col("trimmed_categorical_features") > 0)
    rules = [
        (F.col("sampling_applied"), text("Used a representative sample of ", whole("rows_used"), " rows from ", whole("rows_available"), " available rows to keep supervised benchmarking responsive.")),
        (F.col("high_cardinality_features") > 0, text(F.col("high_cardinality_features").cast("string"), " categorical feature(s) were compressed during encoding so rare categories do not dominate runtime or feature space.")),
        (F.col("dropped_identifier_like_features") > 0, text("Dropped ", F.col("dropped_identifier_like_features").cast("string"), " identifier-like or free-text feature(s) before training so noisy high-cardinality columns do not dominate the benchmark.")),
        (trimmed, text("Trimmed ", F.col("trimmed_numeric_features").cast("string"), " numeric and ", F.col("trimmed_categorical_features").cast("string"), " categorical feature(s) to keep the supervised benchmark responsive on deployment.")),
        (reduced, text("Feature slices and narrative diagnostics were generated from a representative sample of ", F.format_number(F.lit(reporting_rows or 0), 0), " rows to keep the response fast.")),
        (F.col("test_rows") < 120, text("Only ", whole("test_rows"), " rows were held out for testing, so the supervised scores may move noticeably between runs.")),
        (classes & (F.col("dominant_share") >= 0.78), text("The dominant class accounts for ", F.format_string("%.1f%%", F.col("dominant_share") * 100), " of usable target rows, so some models can look accurate while still missing minority cases.")),
        (classes & (F.col("target_cardinality") > 6), text("This target spans ", F.col("target_cardinality").cast("string"), " classes, which splits the training signal across many labels and can depress benchmark scores.")),
        (classes & weak, text("Weak target signal: even the strongest held-out model did not separate the target cleanly, so the available features may not explain this outcome very well.")),
        (values & (metric("r2") < 0.15), text("Weak target signal: the best regression model explains only a small share of target variation on the held-out rows.")),
        (values & (metric("r2") < 0), text("Negative R2 means the benchmark performed worse than predicting the target average, so this target is not behaving like a stable regression outcome yet.")),
    ]
    lines = F.array_compact(F.array(*[F.when(c, t) for c, t in rules]))
    return run.select(F.posexplode(lines).alias("position", "text"))


def split_table(ds: Dataset, target: str, share: float = 0.2) -> DataFrame:
    """Rows per class on either side of the stratified holdout."""
    rows = ds.rows.where(ds.text(target).isNotNull())
    test, train, _, _ = holdout(ds, rows, share, class_sizes(ds, rows, target), target)
    label = ds.text(target).alias("label")
    sides = test.select(label, F.lit("test").alias("side")).unionAll(train.select(label, F.lit("train").alias("side")))
    return sides.groupBy("label", "side").agg(F.count(F.lit(1)).alias("n"))
