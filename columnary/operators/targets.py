"""Which columns would make prediction targets, and why.

The score is arithmetic over the per-column facts: no pass over the data beyond
the tally, except the 10th and 90th percentile of regression candidates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import clamp_unit, rounded, safe_ratio
from .dataset import Dataset, pin
from .profile import profile_facts, target_candidates
from .ranks import exact_quantiles

CONTACT = ["email", "phone", "url", "identifier", "postal_code"]
COORDINATE = ["latitude", "longitude", "free_text"]
MEASURE = ["currency", "percentage", "count", "duration"]


def _contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def outcome_bonus(header: Column) -> Column:
    """Points for a header that names an outcome (exact or contained)."""
    return F.when(header.isin(vocab.EXACT_OUTCOME_NAMES), 0.16).when(_contains_any(header, vocab.OUTCOME_HINTS), 0.09).otherwise(0.0)


def feature_penalty(header: Column) -> Column:
    """Points off for a header that names a plan or a grouping."""
    return F.when(header.contains("plan"), 0.08).when(_contains_any(header, vocab.GROUPING_HINTS), 0.05).otherwise(0.0)


def code_like(header: Column) -> Column:
    """Headers of identifiers, codes and postal fields."""
    endings = [header.endswith(e) for e in (" id", "_id", " code", "zip")]
    parts = [header.contains(p) for p in ("identifier", "area code", "postal", "pincode")]
    return reduce(lambda a, b: a | b, endings + parts, header == "id")


def header_signals(ds: Dataset) -> DataFrame:
    header = F.lower(F.trim("name"))
    return profile_facts(ds).select("ordinal", "name", outcome_bonus(header).alias("outcome_bonus"), feature_penalty(header).alias("feature_penalty"), code_like(header).alias("code_like"))


def _entropy() -> Column:
    """Shannon entropy of the non-null values over its maximum, in [0, 1]."""
    n = F.col("non_null").cast("double")
    bits = F.log2(F.greatest(n, F.lit(1.0))) - safe_ratio(F.col("n_log_n"), n)
    return F.when(F.col("unique") > 1, clamp_unit(F.try_divide(bits, F.log2(F.col("unique").cast("double"))))).otherwise(0.0)


def normalized_entropy(ds: Dataset) -> DataFrame:
    return profile_facts(ds).select("ordinal", F.col("name").alias("column"), rounded(_entropy(), 6).alias("normalized_entropy"))


def _branch() -> Column:
    """Which rule set a column falls under."""
    u, kind = F.col("unique"), F.col("inferred_type")
    return (
        F.when((F.col("likely_role") == "identifier") | (F.col("unique_pct") >= 0.95), "near_unique")
        .when(u < 2, "single_valued")
        .when(F.col("missing_pct") > 0.35, "too_sparse")
        .when(kind.isin("boolean", "categorical") | ((kind == "numeric") & u.between(2, 10)), "classification")
        .when(kind == "numeric", "regression")
        .otherwise("unsuitable")
    )


def _candidates(ds: Dataset) -> DataFrame:
    """Facts with signals; pinned together with the percentiles they need."""
    rows = F.greatest(F.col("rows"), F.lit(1))
    header = F.lower(F.trim("name"))
    base = (
        profile_facts(ds)
        .withColumn("unique_pct", rounded(safe_ratio(F.col("unique"), rows), 4))
        .withColumn("missing_pct", rounded(safe_ratio(F.col("missing"), rows), 4))
        .withColumn("row_count", rows)
        .withColumn("bonus", outcome_bonus(header)).withColumn("penalty", feature_penalty(header)).withColumn("code", code_like(header))
        .withColumn("coverage", clamp_unit(1.0 - F.col("missing_pct") * 1.6))
        .withColumn("support", clamp_unit(F.col("non_null") / 500.0))
        .withColumn("entropy", _entropy())
        .withColumn("branch", _branch())
    )
    names = [r["name"] for r in base.where("branch = 'regression'").orderBy("ordinal").select("name").collect()]
    tails = exact_quantiles(ds.rows, {n: ds.number(n) for n in names}, [0.10, 0.90])
    table = ds.spark.createDataFrame([(ds.get(n).ordinal, q[0], q[1]) for n, q in tails.items()], "ordinal int, q10 double, q90 double")
    return base.join(F.broadcast(table), "ordinal", "left")


def _lines(*pairs: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, t) for c, t in pairs]))


OUTCOME_TEXT = "The header reads like a business outcome, so it is more likely to be the target you want to predict."
GROUPING_TEXT = "The header reads like a feature flag or grouping field, which often works better as an input than as the outcome to predict."
MISSING_TEXT = "Missing target values will reduce usable training rows."
ROLE_TEXT = "The profiling pass reads this more like an input feature than a direct business outcome."
CODE_TEXT = "The header looks like a routing or code field, which is often metadata rather than the business outcome you want to predict."


def _classification() -> tuple[Column, Column]:
    u, n, semantic = F.col("unique").cast("double"), F.col("non_null").cast("double"), F.col("semantic_type")
    per_class = n / F.greatest(u, F.lit(1.0))
    dominant = F.when(n > 0, F.col("top_n") / F.greatest(n, F.lit(1.0))).otherwise(1.0)
    many = F.greatest(F.lit(8.0), F.floor(F.col("row_count") * 0.08).cast("double"))
    binary, ordinal = F.col("inferred_type") == "boolean", semantic == "ordinal_category"
    contact, coordinate, place = semantic.isin(CONTACT), semantic.isin(COORDINATE), semantic == "location_label"
    wrong_role = ~F.col("likely_role").isin("target-candidate", "boolean")

    def points(condition: Column, value) -> Column:
        return F.when(condition, value).otherwise(0.0)

    score = (
        0.08 + F.col("coverage") * 0.18 + F.col("entropy") * 0.22 + clamp_unit(per_class / 180.0) * 0.14
        + clamp_unit(1.0 - F.greatest(F.lit(0.0), u - 2) / 18.0) * 0.12 + F.col("support") * 0.06
        + points(binary, 0.04) + points(ordinal, 0.03) + F.col("bonus") - F.col("penalty")
        - points(contact, 0.28) - points(coordinate, 0.16) - points(place, 0.05)
        - points(dominant > 0.7, F.least(F.lit(0.22), (dominant - 0.7) * 0.55))
        - points(per_class < 40, F.least(F.lit(0.18), (40.0 - per_class) / 40.0 * 0.18))
        - points(u > many, F.least(F.lit(0.14), (u - many) * 0.015))
        - points(wrong_role, 0.18) - points(F.col("code"), 0.32)
    )
    always = F.lit(True)
    reasons = _lines(
        (always, "The column has a limited number of classes, which fits classification."),
        (binary, "Binary outcomes are usually easier to benchmark clearly than multi-class targets."),
        (ordinal, "The values look ordered, which can still produce a clean classification target even without numeric encoding."),
        (F.col("bonus") > 0, OUTCOME_TEXT),
        (F.col("penalty") > 0, GROUPING_TEXT),
        (contact, "The semantic profile reads more like contact, routing, or identifier data than a business outcome."),
        (coordinate, "The semantic profile reads more like descriptive or coordinate data than a stable supervised target."),
        (place, "Location labels are often better used as inputs unless the dataset is explicitly about regional classification."),
        (F.col("missing_pct") > 0.15, MISSING_TEXT),
        (dominant > 0.7, F.format_string("The largest class represents %.1f%% of usable rows, so minority recall may be harder to learn.", dominant * 100)),
        (dominant <= 0.7, "Class balance looks stable enough for a benchmark to be informative."),
        (per_class < 40, F.format_string("Average support is only about %.0f rows per class, which makes the holdout scores less stable.", per_class)),
        (u > many, "There are enough classes that class imbalance or sparsity may become a problem."),
        (wrong_role, ROLE_TEXT),
        (F.col("code"), CODE_TEXT),
    )
    return score, reasons


def _regression() -> tuple[Column, Column]:
    u, n, semantic = F.col("unique").cast("double"), F.col("num_n").cast("double"), F.col("semantic_type")
    q10, q90 = F.coalesce("q10", F.lit(0.0)), F.coalesce("q90", F.lit(0.0))
    dominant = F.when(n > 0, F.col("top_n") / F.greatest(n, F.lit(1.0))).otherwise(1.0)
    contact, coordinate, place = semantic.isin(CONTACT), semantic.isin(COORDINATE), semantic == "location_label"
    wrong_role = ~F.col("likely_role").isin("target-candidate", "boolean")

    def points(condition: Column, value) -> Column:
        return F.when(condition, value).otherwise(0.0)

    score = (
        0.1 + F.col("coverage") * 0.2 + clamp_unit(u / F.greatest(F.lit(30.0), n * 0.45)) * 0.14
        + clamp_unit(F.col("unique_pct") / 0.85) * 0.18 + points(q90 > q10, 0.16) + F.col("support") * 0.1
        - points(u < 12, F.least(F.lit(0.22), (12.0 - u) / 12.0 * 0.22))
        + F.least(F.lit(0.12), F.col("bonus")) + points(semantic.isin(MEASURE), 0.03) - F.least(F.lit(0.06), F.col("penalty"))
        - points(contact, 0.28) - points(F.col("unique_pct") > 0.9, F.least(F.lit(0.16), (F.col("unique_pct") - 0.9) * 1.2))
        - points(n < 80, F.least(F.lit(0.14), (80.0 - n) / 80.0 * 0.14)) - points(q90 <= q10, 0.18)
        - points(dominant > 0.08, F.least(F.lit(0.12), (dominant - 0.08) * 0.8))
        - points(wrong_role, 0.18) - points(F.col("code"), 0.3) - points(coordinate, 0.16) - points(place, 0.05)
    )
    reasons = _lines(
        (F.lit(True), "The column is numeric with enough spread to support regression."),
        (u < 12, "Low numeric variety may make regression unstable or unnecessary."),
        (F.col("bonus") > 0, OUTCOME_TEXT),
        (semantic.isin(MEASURE), "The semantic profile matches a numeric business measure, which is a more natural fit for regression."),
        (F.col("penalty") > 0, GROUPING_TEXT),
        (contact, "The semantic profile reads more like contact, routing, or identifier data than a numeric business outcome."),
        (F.col("unique_pct") > 0.9, "Very high uniqueness can indicate a near-identifier rather than a business target."),
        (F.col("missing_pct") > 0.15, MISSING_TEXT),
        (n < 80, "There are not many usable target rows, so regression scores may move more between runs."),
        (q90 <= q10, "The target shows limited spread across the middle of the distribution, which reduces learnable signal."),
        (dominant > 0.08, "A repeated dominant value takes up a noticeable share of rows, which makes the target less informative for regression."),
        (wrong_role, ROLE_TEXT),
        (F.col("code"), CODE_TEXT),
        (coordinate, "The semantic profile reads more like descriptive or coordinate data than a stable numeric target."),
        (place, "Location labels are often better used as inputs unless the dataset is explicitly about regional forecasting."),
    )
    return score, reasons


def heuristic_targets(ds: Dataset) -> DataFrame:
    """Every column with task, verdict, heuristic score and reasons; pinned."""

    def build() -> DataFrame:
        branch = F.col("branch")
        class_score, class_reasons = _classification()
        value_score, value_reasons = _regression()
        raw = F.when(branch == "classification", class_score).when(branch == "regression", value_score).otherwise(0.0)
        good = F.when(branch == "classification", 0.78).otherwise(0.74)
        usable = F.when(branch == "classification", 0.62).otherwise(0.58)
        judged = branch.isin("classification", "regression")
        verdict = (
            F.when(~judged, "bad target")
            .when(F.col("raw") >= good, F.concat(F.lit("good "), branch, F.lit(" target")))
            .when(F.col("raw") >= usable, F.concat(F.lit("usable "), branch, F.lit(" target")))
            .otherwise("weak target")
        )
        excluded = (
            F.when(branch == "near_unique", "Almost every row has a unique value, so the column behaves like an identifier.")
            .when(branch == "single_valued", "The column has fewer than two distinct values, so it cannot act as a useful target.")
            .when(branch == "too_sparse", "Too many target values are missing for a stable supervised workflow.")
            .otherwise("The column type is not a strong fit for direct supervised learning.")
        )
        reasons = F.when(branch == "classification", class_reasons).when(branch == "regression", value_reasons).otherwise(F.array(excluded))
        scored = _candidates(ds).withColumn("raw", raw)
        return pin(
            scored.select(
                "ordinal", F.col("name").alias("column"),
                F.when(judged, branch).otherwise("none").alias("recommended_task"), "semantic_type", verdict.alias("verdict"),
                rounded(clamp_unit(F.col("raw")), 4).alias("score"), reasons.alias("reasons"),
            ).orderBy("ordinal")
        )

    return ds.remember("heuristic_targets", build)


def ranked(table: DataFrame, limit: int) -> DataFrame:
    return table.orderBy(F.desc("score"), F.lower("column")).limit(limit)


def target_recommendations(ds: Dataset, limit: int = 8, probe: bool = True) -> DataFrame:
    """The best targets, scores blended with a quick learnability probe."""
    if probe:
        from .probe import probed_targets

        return ranked(probed_targets(ds), limit)
    table = heuristic_targets(ds)
    nothing = F.lit(None).cast("double")
    return ranked(table.withColumn("heuristic_score", nothing).withColumn("probe_score", nothing), limit)


def preferred_target(ds: Dataset, probe: bool = False) -> DataFrame:
    """The best recommended column, else the first candidate."""
    best = target_recommendations(ds, probe=probe).where("recommended_task <> 'none'").orderBy(F.desc("score"), F.lower("column")).limit(1)
    best = best.select("column", F.lit(0).alias("preference"))
    fallback = target_candidates(ds).orderBy("ordinal").limit(1).select(F.col("name").alias("column"), F.lit(1).alias("preference"))
    return best.unionAll(fallback).orderBy("preference").limit(1).select("column")
