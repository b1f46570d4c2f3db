"""Feature choice and preparation for the models.

All learnt values - medians, scales, kept categories - are small numbers found
by aggregation; the preparation itself is one projection of built-in
expressions, so encoding a table never leaves whole-stage code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import day_ordinal, rounded, safe_ratio
from .dataset import BOOL, DOUBLE, LONG, TEXT, TIME, Dataset, pin
from .ranks import exact_quantiles
from .stats import PASS_WIDTH
from .tally import column_facts, restore_labels, top_labels


def is_number(ds: Dataset, name: str) -> bool:
    return ds.get(name).lane in (LONG, DOUBLE, BOOL)


def feature_number(ds: Dataset, name: str) -> Column:
    """Numeric feature: numbers, 0/1 for booleans, day numbers for times."""
    return day_ordinal(ds.value(name)) if ds.get(name).lane == TIME else ds.number(name)


def task_type(ds: Dataset, target: str) -> str:
    """Numeric targets with more than ten values are regression, the rest classes."""
    distinct = column_facts(ds).where(F.col("name") == target).first()
    if distinct.non_null == 0:
        raise ValueError("Selected target column is empty.")
    return "regression" if is_number(ds, target) and distinct["unique"] > 10 else "classification"


def identifier_like(ds: Dataset) -> DataFrame:
    """Text columns too close to unique, or long and fairly unique, to be inputs."""
    facts = column_facts(ds).where((F.col("lane") == TEXT) & (F.col("non_null") >= 20)).withColumn("mean_length", safe_ratio(F.col("text_length"), F.col("non_null")))
    share = safe_ratio(F.col("unique"), F.col("non_null"))
    flagged = (share >= vocab.IDENTIFIER_SHARE) | ((share >= 0.55) & (F.col("mean_length") >= 12.0))
    return facts.select("ordinal", F.col("name").alias("column"), rounded(share, 4).alias("unique_share"), rounded("mean_length", 4).alias("mean_length"), flagged.alias("identifier_like"))


def variances(ds: Dataset, names: list[str]) -> dict[str, float]:
    """Sample variance per numeric feature, 0 where undefined."""
    found = {}
    for start in range(0, len(names), PASS_WIDTH):
        chunk = names[start : start + PASS_WIDTH]
        exprs = [F.when(F.count(x) > 1, F.var_samp(x)).alias(f"v{i}") for i, x in enumerate(feature_number(ds, n) for n in chunk)]
        row = ds.rows.agg(*exprs).first()
        found.update({n: row[f"v{i}"] or 0.0 for i, n in enumerate(chunk)})
    return found


@dataclass
class FeatureChoice:
    numeric: list[str]
    categorical: list[str]
    dropped_identifier_like: int = 0
    trimmed_numeric: int = 0
    trimmed_categorical: int = 0
    high_cardinality: int = 0


def choose_features(ds: Dataset, target: str | None, numeric: int | None = None, categorical: int | None = None) -> FeatureChoice:
    """Inputs of the benchmark: every column but identifiers.

    ``numeric`` and ``categorical`` keep the widest-spread numbers and the
    fullest, least varied categories only.
    """
    facts = {r["name"]: r for r in column_facts(ds).collect()}
    flagged = {r["column"] for r in identifier_like(ds).where("identifier_like").collect() if r["column"] != target}
    usable = [n for n in ds.names if n != target and facts[n].non_null > 0 and n not in flagged]
    numbers = [n for n in usable if is_number(ds, n) or ds.get(n).lane == TIME]
    labels = [n for n in usable if n not in numbers]
    picked, kept = numbers, labels
    if numeric is not None and len(numbers) > numeric:
        v = variances(ds, numbers)
        picked = sorted(numbers, key=lambda n: (-v[n], ds.get(n).ordinal))[:numeric]
    if categorical is not None and len(labels) > categorical:
        kept = sorted(labels, key=lambda n: (-facts[n].non_null, facts[n]["unique"], n.lower()))[:categorical]
    wide = sum(facts[n]["unique"] + (facts[n].missing > 0) > vocab.MAX_CATEGORIES for n in kept)
    return FeatureChoice(picked, kept, len(flagged), len(numbers) - len(picked), len(labels) - len(kept), wide)


def feature_choice_table(ds: Dataset, target: str | None, numeric: int | None = None, categorical: int | None = None) -> DataFrame:
    choice = choose_features(ds, target, numeric, categorical)
    rows = [(n, "numeric", i) for i, n in enumerate(choice.numeric)] + [(n, "categorical", i) for i, n in enumerate(choice.categorical)]
    return ds.spark.createDataFrame(rows, "feature string, kind string, position int")


@dataclass
class Encoding:
    """Learnt preparation of one feature set."""

    medians: dict[str, float] = field(default_factory=dict)
    centres: dict[str, tuple[float, float]] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    kept: dict[str, list[str]] = field(default_factory=dict)
    pooled: dict[str, bool] = field(default_factory=dict)

    def names(self) -> list[str]:
        out = [f"numeric__{n}" for n in self.centres]
        for n, values in self.kept.items():
            out += [f"categorical__{n}_{v}" for v in values]
            if self.pooled[n]:
                out.append(f"categorical__{n}_infrequent")
        return out


def impute_and_scale(ds: Dataset, rows: DataFrame, names: list[str]) -> tuple[dict, dict]:
    """Exact medians, then mean and population deviation of the filled column."""
    exprs = {n: feature_number(ds, n) for n in names}
    medians = {n: q[0] for n, q in exact_quantiles(rows, exprs, [0.5]).items() if q[0] is not None}
    centres = {}
    filled = list(medians)
    for start in range(0, len(filled), PASS_WIDTH // 2):
        chunk = filled[start : start + PASS_WIDTH // 2]
        aggs = []
        for i, n in enumerate(chunk):
            x = F.coalesce(exprs[n], F.lit(float(medians[n])))
            aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
        row = rows.agg(*aggs).first()
        centres.update({n: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, n in enumerate(chunk)})
    return medians, centres


def keep_categories(counts: list[tuple[str, int]], distinct: int, rows: int, limit: int, share: float) -> tuple[list[str], bool]:
    """Which categories keep an indicator, and whether the rest are pooled.

    ``counts`` holds the most frequent categories; anything beyond it is rare.
    """
    frequent = [(v, n) for v, n in counts if n >= share * rows]
    if len(frequent) + 1 > limit:
        frequent = sorted(frequent, key=lambda c: (c[1], c[0]), reverse=True)[: limit - 1]
    return sorted(v for v, _ in frequent), distinct > len(frequent)


def learn_categories(ds: Dataset, rows: DataFrame, names: list[str], limit: int, share: float, encoding: Encoding) -> None:
    """Modes and kept categories of text features, from their tallies.

    At most 1 / share categories can be frequent, so that many are fetched.
    """
    if not names:
        return
    part = ds.within(rows)
    enough = int(1 / share) + 1 if share > 0 else limit + 1
    top = restore_labels(part, pin(top_labels(part, names, enough + 1)))
    total = rows.count()
    found: dict[str, list[tuple[str, int]]] = {n: [] for n in names}
    missing = dict.fromkeys(names, 0)
    by_ordinal = {part.get(n).ordinal: n for n in names}
    for r in top.orderBy("ordinal", "rank").collect():
        if r.v == vocab.MISSING_LABEL:
            missing[by_ordinal[r.ordinal]] = r.n
        else:
            found[by_ordinal[r.ordinal]].append((r.v, r.n))
    for n in names:
        if not found[n]:
            continue
        mode = found[n][0][0]
        counts = [(v, c + (missing[n] if v == mode else 0)) for v, c in found[n]]
        encoding.modes[n] = mode
        # beyond the fetched ones there are only rare categories
        encoding.kept[n], encoding.pooled[n] = keep_categories(counts, len(counts), total, limit, share)


def learn_encoding(ds: Dataset, rows: DataFrame, choice: FeatureChoice, limit: int = vocab.MAX_CATEGORIES, share: float = vocab.MIN_CATEGORY_SHARE) -> Encoding:
    encoding = Encoding()
    encoding.medians, encoding.centres = impute_and_scale(ds, rows, choice.numeric)
    learn_categories(ds, rows, choice.categorical, limit, share, encoding)
    return encoding


def encoded_category(ds: Dataset, encoding: Encoding, name: str) -> Column:
    """The category a value is encoded as; NULL when it has no indicator."""
    value = F.coalesce(ds.text(name), F.lit(encoding.modes[name]))
    other = F.lit("infrequent") if encoding.pooled[name] else F.lit(None).cast("string")
    return F.when(value.isin(encoding.kept[name]), value).otherwise(other) if encoding.kept[name] else other


def feature_vector(ds: Dataset, encoding: Encoding) -> Column:
    parts = []
    for n, (mean, scale) in encoding.centres.items():
        filled = F.coalesce(feature_number(ds, n), F.lit(float(encoding.medians[n])))
        parts.append((filled - mean) / scale)
    for n, kept in encoding.kept.items():
        value = F.coalesce(ds.text(n), F.lit(encoding.modes[n]))
        parts += [F.when(value == v, 1.0).otherwise(0.0) for v in kept]
        if encoding.pooled[n]:
            rare = ~value.isin(kept) if kept else F.lit(True)
            parts.append(F.when(rare, 1.0).otherwise(0.0))
    return array_to_vector(F.array(*parts))


def class_weights(sizes: dict[str, int]) -> dict[str, float]:
    """Balanced weights n / (k * n_class)."""
    rows = sum(sizes.values())
    return {g: rows / (len(sizes) * n) for g, n in sizes.items()}


def class_counts(ds: Dataset, rows: DataFrame, target: str) -> DataFrame:
    """``g, n``: rows per class label, for any number of classes."""
    return rows.groupBy(ds.text(target).alias("g")).agg(F.count(F.lit(1)).alias("n"))


def class_sizes(ds: Dataset, rows: DataFrame, target: str) -> dict[str, int]:
    """Rows per class label (bounded by the number of classes)."""
    return {r.g: r.n for r in pin(class_counts(ds, rows, target)).collect()}


def counted_weights(counts: DataFrame) -> DataFrame:
    """``class_weights`` as a table ``g, weight``, for any number of classes."""
    whole = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))  # one row
    return counts.crossJoin(F.broadcast(whole)).select("g", (F.col("rows") / (F.col("classes") * F.col("n"))).alias("weight"))
