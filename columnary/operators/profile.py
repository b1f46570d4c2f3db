"""Column profile: inferred type, semantic type, role, counts, samples.

Everything is decided by one CASE per rule over the per-column facts table, so
the data is read for the tally and for one top-k of values to show, nothing
else. Pattern shares, the date test and the scales ask every value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import has_any_token, name_tokens, rounded, safe_ratio
from .dataset import TIME, Dataset, pin
from .samples import head_values
from .tally import column_facts

SHOWN = 5


def sample_facts(ds: Dataset) -> DataFrame:
    """Per column: the first values in row order, to show."""
    return head_values(ds, SHOWN).groupBy("ordinal").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "v"))), lambda s: s["v"]).alias("sample_values"))


def column_ratios(ds: Dataset) -> DataFrame:
    """Shares behind the type rules, one row per column (unrounded)."""
    facts = column_facts(ds).join(F.broadcast(sample_facts(ds)), "ordinal", "left")
    non_null = F.col("non_null")
    url = "url_exact_n" if ds.semantic_rules == "reference" else "url_prefix_n"
    # times read like dates only where no value has a time of day
    readable = (F.col("lane") != TIME) | F.col("midnight")
    for share, part, whole in (("email_share", "email_n", "filled_n"), ("phone_share", "phone_n", "filled_n"), ("url_share", url, "filled_n"), ("date_share", "date_like_n", "non_null")):
        facts = facts.withColumn(share, F.when(readable, safe_ratio(F.col(part), F.col(whole))).otherwise(0.0))
    tokens = name_tokens(F.col("name"))
    named = has_any_token(tokens, vocab.DATE_TOKENS)
    return (
        facts.withColumn("tokens", tokens)
        .withColumn("bool_ratio", safe_ratio(F.col("bool_n"), non_null))
        .withColumn("num_ratio", safe_ratio(F.col("num_n"), non_null))
        .withColumn("looks_date", (non_null > 0) & (named | (F.col("date_share") >= 0.6) | (F.col("lane") == TIME)))
        .withColumn("date_ratio", F.when(F.col("looks_date"), safe_ratio(F.col("date_n"), non_null)).otherwise(0.0))
        .withColumn("int_ratio", safe_ratio(F.col("int_n"), F.col("num_n")))
        .withColumn("unique_ratio", safe_ratio(F.col("unique"), non_null))
        .withColumn("mean_length", safe_ratio(F.col("text_length"), non_null))
    )


def inferred_type() -> Column:
    """First rule that holds: unknown, boolean, datetime, numeric, text, categorical."""
    two_valued = F.col("unit_like") & (F.col("num_unique") <= 2)
    return (
        F.when(F.col("non_null") == 0, "unknown")
        .when(F.col("bool_ratio") >= 0.95, "boolean")
        .when((F.col("date_ratio") >= 0.9) & (F.col("unique") > 1), "datetime")
        .when(F.col("num_ratio") >= 0.9, F.when(two_valued, "boolean").otherwise("numeric"))
        .when((F.col("mean_length") > 32) & (F.col("unique_ratio") > 0.5), "text")
        .otherwise("categorical")
    )


def semantic_rules(strict: bool) -> list[tuple[Column, str, float]]:
    """Ordered (condition, semantic type, confidence)."""
    kind, tokens = F.col("inferred_type"), F.col("tokens")

    def named(words: list[str]) -> Column:
        return has_any_token(tokens, words)

    def share(part: str) -> Column:
        return safe_ratio(F.col(part), F.col("num_n"))

    wordy = kind.isin("categorical", "text")

    def shaped(part: str) -> Column:
        hit = F.col(part) >= 0.9
        return hit & wordy if strict else hit

    on_scale = (F.col("filled_n") > 0) & reduce(lambda a, b: a | b, [F.col(f"scale_{i}") for i in range(len(vocab.ORDINAL_SCALES))])
    number = kind == "numeric"
    return [
        (F.col("non_null") == 0, "unknown", 0.0),
        (named(vocab.ID_TOKENS), "identifier", 0.99),
        (named(vocab.EMAIL_TOKENS) | shaped("email_share"), "email", 0.97),
        (named(vocab.PHONE_TOKENS) | shaped("phone_share"), "phone", 0.95),
        (named(vocab.URL_TOKENS) | shaped("url_share"), "url", 0.95),
        (named(vocab.POSTAL_TOKENS), "postal_code", 0.95),
        (kind == "boolean", "binary_flag", 0.98),
        ((kind == "datetime") & named(vocab.DATE_TOKENS), "event_timestamp", 0.94),
        (kind == "datetime", "datetime", 0.9),
        (number & named(vocab.LATITUDE_TOKENS) & (share("lat_n") >= 0.95), "latitude", 0.96),
        (number & named(vocab.LONGITUDE_TOKENS) & (share("lng_n") >= 0.95), "longitude", 0.96),
        (number & named(vocab.CURRENCY_TOKENS), "currency", 0.9),
        (number & named(vocab.PERCENT_TOKENS) & (F.greatest(share("unit_n"), share("pct_n")) >= 0.95), "percentage", 0.92),
        (number & named(vocab.DURATION_TOKENS), "duration", 0.86),
        (number & named(vocab.COUNT_TOKENS) & (F.col("int_ratio") >= 0.95) & (share("nonneg_n") >= 0.98), "count", 0.88),
        (number, "numeric_continuous", 0.72),
        (wordy & on_scale, "ordinal_category", 0.9),
        (wordy & named(vocab.LOCATION_TOKENS), "location_label", 0.78),
        (kind == "text", "free_text", 0.82),
        (kind == "categorical", "categorical_label", 0.74),
    ]


def _first_match(rules: list[tuple[Column, object]]) -> Column:
    case = F.when(rules[0][0], F.lit(rules[0][1]))
    for condition, value in rules[1:]:
        case = case.when(condition, F.lit(value))
    return case


def likely_role() -> Column:
    semantic, kind, unique, rows = F.col("semantic_type"), F.col("inferred_type"), F.col("unique"), F.col("rows")
    spread = F.col("unique_ratio")
    id_named = has_any_token(name_tokens(F.lower(F.trim("name"))), vocab.ID_TOKENS)
    near_key = (spread >= 0.98) & (unique > 0.9 * F.greatest(rows, F.lit(1)))

    def few(floor: int, share: float) -> Column:
        return unique.between(2, F.greatest(F.lit(floor).cast("long"), (rows * share).cast("long")))

    return (
        F.when(semantic.isin("identifier", "email", "phone", "url"), "identifier")
        .when((semantic == "postal_code") & (spread >= 0.5), "identifier")
        .when(id_named | near_key, "identifier")
        .when(kind == "datetime", "datetime")
        .when(kind == "boolean", "boolean")
        .when(kind == "numeric", F.when(few(20, 0.05), "target-candidate").otherwise("numeric"))
        .when(kind.isin("categorical", "text"), F.when(few(25, 0.1), "target-candidate").otherwise("categorical"))
        .otherwise("unknown")
    )


def profile_facts(ds: Dataset) -> DataFrame:
    """Facts, shares and decisions together; pinned, one row per column."""

    def build() -> DataFrame:
        typed = column_ratios(ds).withColumn("inferred_type", inferred_type())
        rules = semantic_rules(ds.semantic_rules == "strict")
        decided = (
            typed.withColumn("semantic_type", _first_match([(c, s) for c, s, _ in rules]))
            .withColumn("semantic_confidence", _first_match([(c, w) for c, _, w in rules]))
            .withColumn("likely_role", likely_role())
        )
        return pin(decided.orderBy("ordinal"))

    return ds.remember("profile_facts", build)


def columns_of(ds: Dataset, *types: str) -> list[str]:
    """Names of the columns with one of the given inferred types, in column order."""
    rows = ds.remember("types", lambda: [(r["name"], r.inferred_type) for r in profile_facts(ds).select("name", "inferred_type", "ordinal").orderBy("ordinal").collect()])
    return [name for name, kind in rows if kind in types]


def column_profile(ds: Dataset) -> DataFrame:
    """The schema profile, one row per column."""
    rows = F.greatest(F.col("rows"), F.lit(1))
    return profile_facts(ds).select(
        "ordinal",
        "name",
        "inferred_type",
        "semantic_type",
        "semantic_confidence",
        "likely_role",
        F.col("non_null").alias("non_null_count"),
        rounded(safe_ratio(F.col("non_null"), rows), 4).alias("non_null_pct"),
        F.col("missing").alias("missing_count"),
        rounded(safe_ratio(F.col("missing"), rows), 4).alias("missing_pct"),
        F.col("unique").alias("unique_count"),
        rounded(safe_ratio(F.col("unique"), rows), 4).alias("unique_pct"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
    )


def sample_values(ds: Dataset, k: int = SHOWN) -> DataFrame:
    """First k non-null values per column in row order."""
    names = column_facts(ds).select("ordinal", "name")
    return head_values(ds, k).where(F.col("rank") <= k).join(F.broadcast(names), "ordinal").select("name", "rank", F.col("v").alias("value"))


def header_tokens(ds: Dataset) -> DataFrame:
    """Words of every header, one row per word."""
    return column_facts(ds).select("name", F.explode(name_tokens(F.col("name"))).alias("token"))


def type_counts(ds: Dataset) -> DataFrame:
    """Columns per inferred type over all six types, zeros kept."""
    found = profile_facts(ds).groupBy("inferred_type").agg(F.count(F.lit(1)).alias("found"))
    kinds = ds.spark.createDataFrame([(i, t) for i, t in enumerate(vocab.INFERRED_TYPES)], "position int, inferred_type string")
    return kinds.join(F.broadcast(found), "inferred_type", "left").select(
        "inferred_type", F.coalesce("found", F.lit(0)).cast("long").alias("column_count"), "position"
    )


def type_mix(ds: Dataset) -> DataFrame:
    """Non-zero types with their share of columns in percent, largest first."""
    total = F.greatest(F.sum("column_count").over(Window.partitionBy()), F.lit(1))
    mix = type_counts(ds).withColumn("pct", 100.0 * F.col("column_count") / total)
    return mix.where("column_count > 0").orderBy(F.desc("column_count"), "position").select("inferred_type", "column_count", "pct")


def identifier_columns(ds: Dataset) -> DataFrame:
    return profile_facts(ds).where("likely_role = 'identifier'").select("ordinal", "name")


def target_candidates(ds: Dataset) -> DataFrame:
    return profile_facts(ds).where("likely_role in ('target-candidate', 'boolean')").select("ordinal", "name")


def schema_groups(ds: Dataset) -> DataFrame:
    """The four display groups with their columns, one row per (group, column)."""
    p = profile_facts(ds).select("ordinal", "name", "inferred_type", "likely_role")
    role, kind = F.col("likely_role"), F.col("inferred_type")
    groups = F.array_compact(
        F.array(
            F.when(role == "identifier", "Identifiers"),
            F.when(role.isin("target-candidate", "boolean"), "Target candidates"),
            F.when(kind == "numeric", "Numeric fields"),
            F.when(kind == "categorical", "Categorical fields"),
        )
    )
    return p.select(F.explode(groups).alias("group_title"), "ordinal", "name")


def overview(ds: Dataset) -> DataFrame:
    """One row: size, encoding, missing cells, type counts."""
    from .quality import duplicate_row_count

    p = profile_facts(ds)
    size = p.agg(
        F.coalesce(F.max("rows"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).cast("int").alias("column_count"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("total_missing_values"),
    )
    kinds = type_counts(ds).agg(
        F.map_from_entries(F.collect_list(F.struct("inferred_type", F.col("column_count").cast("int")))).alias("type_counts")
    )
    return size.crossJoin(kinds).select(
        F.lit(ds.name).alias("dataset_name"), "row_count", "column_count", F.lit(ds.encoding).cast("string").alias("encoding"),
        F.lit(duplicate_row_count(ds)).cast("long").alias("duplicate_row_count"), "total_missing_values", "type_counts",
    )
