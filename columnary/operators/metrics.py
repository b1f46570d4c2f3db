"""Model metrics from a table of predictions, all by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that running totals are cut into.
RUN_SPLITS = 255


def confusion(rows: DataFrame) -> DataFrame:
    """Counts per (actual, prediction)."""
    return rows.groupBy("actual", "prediction").agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy and support-weighted F1, precision, recall."""
    cells = confusion(rows)
    hit = F.when(F.col("actual") == F.col("prediction"), F.col("n")).otherwise(0)
    true = cells.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    made = cells.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    per_class = true.join(made, "label", "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hits"), F.col("support")), F.lit(0.0))
    per_class = per_class.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))

    def weighted(value: Column) -> Column:
        return F.sum(value * F.col("support")) / F.sum("support")

    return per_class.withColumn("f1", f1).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg("recall").alias("balanced_accuracy"),
        weighted(F.col("f1")).alias("f1"),
        weighted(F.col("precision")).alias("precision"),
        weighted(F.col("recall")).alias("recall"),
    )


def running_totals(table: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Exclusive running sums ``<value>_before`` in ascending ``key`` order.

    The table is cut into key ranges at sketched quantiles: ranges run in
    parallel and take the total of the ranges before them as offset.
    """
    facts = table.agg(F.percentile_approx(key, [i / (RUN_SPLITS + 1) for i in range(1, RUN_SPLITS + 1)], 10_000).alias("cuts")).first()
    cuts = sorted(set(facts.cuts or []))
    if cuts:
        part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(key)))
    else:
        part = F.lit(0)
    cut = table.withColumn("part", part)
    sums = cut.groupBy("part").agg(*[F.sum(v).alias(f"{v}_part") for v in values])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most RUN_SPLITS + 1 rows
    offsets = sums.select("part", *[F.coalesce(F.sum(f"{v}_part").over(earlier), F.lit(0)).alias(f"{v}_offset") for v in values])
    inside = Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(F.broadcast(offsets), "part")
    before = [(F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"{v}_offset")).alias(f"{v}_before") for v in values]
    return joined.select(*table.columns, *before)


def _by_score(rows: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score."""
    return rows.groupBy(F.col("score")).agg(
        F.count_if(F.col("positive")).alias("pos"), F.count_if(~F.col("positive")).alias("neg")
    )


def roc_auc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve, ties counted half. Needs ``positive``, ``score``."""
    run = running_totals(_by_score(rows), "score", ["neg"])
    area = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return run.agg(F.try_divide(area, (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc"))


def average_precision(rows: DataFrame) -> DataFrame:
    """Sum over thresholds of the recall gained times the precision there."""
    table = _by_score(rows).withColumn("falling", -F.col("score"))
    run = running_totals(table, "falling", ["pos", "neg"])
    hits = F.col("pos_before") + F.col("pos")
    everything = hits + F.col("neg_before") + F.col("neg")
    return run.agg(F.try_divide(F.sum(F.col("pos") * hits / everything), F.sum("pos").cast("double")).alias("average_precision"))


def regression_metrics(rows: DataFrame) -> DataFrame:
    """R2, explained variance, mean absolute and root mean squared error."""
    error = F.col("actual") - F.col("prediction")
    spread = F.var_pop("actual")
    mse = F.avg(error * error)
    return rows.agg(
        (1.0 - F.try_divide(mse, spread)).alias("r2"),
        (1.0 - F.try_divide(F.var_pop(error), spread)).alias("explained_variance"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(mse).alias("rmse"),
    )


METRIC_PRIORITY = {
    "regression": ["r2", "explained_variance", "neg_root_mean_squared_error", "neg_mean_absolute_error", "rmse", "mae", "mse"],
    "classification": ["roc_auc", "f1", "accuracy", "balanced_accuracy", "precision", "recall", "average_precision"],
}


def metric_chart(comparison: DataFrame, task: str) -> DataFrame:
    """The leading metric of every model on a 0-1 scale, errors inverted.

    ``comparison`` is long: ``model, metric, value``.
    """
    order = METRIC_PRIORITY[task]
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(m) for m in order]), F.col("metric")), F.lit(0)), F.lit(len(order) + 1))
    everything = Window.partitionBy()  # a handful of models
    chosen = comparison.withColumn("rank", rank).withColumn("best", F.min("rank").over(everything)).where("rank = best")
    low, high = F.min("value").over(everything), F.max("value").over(everything)
    error = F.col("metric").rlike("(?i)(rmse|mae|mse|loss|error)") & ~F.col("metric").rlike("(?i)^neg_")
    place = F.when(error, high - F.col("value")).otherwise(F.col("value") - low)
    scaled = F.when(high == low, 1.0).otherwise(F.try_divide(place, high - low))
    return chosen.select("model", "metric", F.col("value").alias("raw"), scaled.alias("normalized"))


def relative_importance(importance: DataFrame, limit: int = 10) -> DataFrame:
    """The leading features as a share of the largest importance."""
    top = importance.orderBy(F.desc("importance"), "feature").limit(limit)
    peak = F.max("importance").over(Window.partitionBy())
    return top.select("feature", F.col("importance").alias("raw"), F.when(peak > 0, F.col("importance") / peak).otherwise(0.0).alias("normalized"))


def model_choice(comparison: DataFrame, task: str) -> DataFrame:
    """Score of every model and the best one (first wins a tie).

    ``comparison`` is wide: ``position, model`` and one column per metric.
    """
    if task == "regression":
        score = F.col("r2")
    else:
        score = F.col("f1") * 0.6 + F.col("balanced_accuracy") * 0.4
        if "roc_auc" in comparison.columns:
            score = F.when(F.col("roc_auc").isNotNull(), score * 0.6 + F.col("roc_auc") * 0.4).otherwise(score)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "position"))
    return comparison.withColumn("score", score).withColumn("is_best", place == 1).select("position", "model", "score", "is_best")
