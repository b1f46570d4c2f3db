"""Learnability probe: a quick held-out fit of the leading target candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import clamp_unit, rounded
from .dataset import TIME, Dataset
from .features import FeatureChoice, is_number
from .metrics import classification_metrics, regression_metrics, roc_auc
from .supervised import class_models, positive_label, prepare, scored, value_models
from .tally import column_facts
from .targets import heuristic_targets


def probe_target(ds: Dataset, target: str, task: str, max_rows: int | None = None) -> tuple[float, str] | None:
    """Score in [0, 1] and the sentence that reports it; None when not probed."""
    facts = {r["name"]: r for r in column_facts(ds).collect()}
    if facts[target].non_null < vocab.PROBE_MIN_ROWS:
        return None
    if task == "classification" and facts[target]["unique"] > vocab.PROBE_MAX_CLASSES:
        return None
    usable = [n for n in ds.names if n != target and facts[n].non_null > 0]
    numbers = [n for n in usable if is_number(ds, n) or ds.get(n).lane == TIME]
    choice = FeatureChoice(numbers, [n for n in usable if n not in numbers])
    if not usable:
        return None
    p = prepare(ds, target, task, max_rows, 0.25, vocab.PROBE_MAX_CATEGORIES, 0.0, vocab.PROBE_MIN_ROWS, choice)
    try:
        if task == "regression":
            model = value_models(1, 1, 1)[0][1].fit(p.train)
            m = regression_metrics(scored(p, model)).first()
            r2, ev = m.r2 or 0.0, m.explained_variance or 0.0
            score = max(0.0, min(1.0, max(0.0, r2) * 0.7 + max(0.0, ev) * 0.3))
            return score, f"Quick probe: held-out learnability looked like R2 {r2:.2f} and explained variance {ev:.2f}."
        estimator = class_models(p.train_rows, len(p.labels), 1, 1, 1)[0][1].setMaxIter(600).setRegParam(1.0 / (0.7 * max(1, p.train_rows)))
        rows = scored(p, estimator.fit(p.train))
        balanced = classification_metrics(rows).first().balanced_accuracy
        positive = positive_label(p.sizes, vocab.PROBE_POSITIVE_HINTS)
        if positive is not None:
            generic = positive_label(p.sizes)
            # the table scores the generic positive label; the other class is its mirror
            score = F.col("score") if positive == generic else 1.0 - F.col("score")
            auc = roc_auc(rows.select((F.col("actual") == positive).alias("positive"), score.alias("score"))).first().roc_auc
            if auc is not None:
                return max(0.0, min(1.0, (balanced + auc) / 2.0)), (
                    f"Quick probe: held-out learnability looked like balanced accuracy {balanced:.2f} and ROC AUC {auc:.2f}."
                )
        return max(0.0, min(1.0, balanced)), f"Quick probe: held-out learnability looked like balanced accuracy {balanced:.2f}."
    finally:
        p.release()


def blend(table: DataFrame, probes: DataFrame) -> DataFrame:
    """Heuristic scores with the probe results worked in.

    ``probes``: ``column, probe_score, reason``.
    """
    w = vocab.PROBE_WEIGHT
    joined = table.join(F.broadcast(probes), "column", "left")
    probed = F.col("probe_score").isNotNull()
    return joined.select(
        "ordinal", "column", "recommended_task", "semantic_type", "verdict",
        F.when(probed, rounded(clamp_unit(F.col("score") * (1.0 - w) + F.col("probe_score") * w), 4)).otherwise(F.col("score")).alias("score"),
        F.when(probed, F.concat("reasons", F.array("reason"))).otherwise(F.col("reasons")).alias("reasons"),
        F.when(probed, rounded("score", 4)).alias("heuristic_score"),
        rounded("probe_score", 4).alias("probe_score"),
    )


def probed_targets(ds: Dataset, max_rows: int | None = None, targets: int = vocab.PROBE_TARGETS) -> DataFrame:
    """All columns, the first ``targets`` strong candidates probed (computed once)."""

    def build() -> DataFrame:
        table = heuristic_targets(ds)
        ordered = table.where((F.col("recommended_task") != "none") & (F.col("score") >= vocab.PROBE_MIN_SCORE))
        found = []
        for r in ordered.orderBy(F.desc("score"), F.lower("column")).select("column", "recommended_task").collect():
            if len(found) >= targets:
                break
            probe = probe_target(ds, r.column, r.recommended_task, max_rows)
            if probe:
                found.append((r.column, *probe))
        return blend(table, ds.spark.createDataFrame(found, "column string, probe_score double, reason string"))

    return ds.remember(("probed", max_rows, targets), build)
