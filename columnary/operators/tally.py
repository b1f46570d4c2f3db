"""Value tallies: ``(ordinal, v, n)``, one row per column and distinct value.

A tally is an unpivot followed by a hash aggregate, so equal values collapse in
the map stage before anything is shuffled - a value that fills a third of the
table costs one row per task. Columns of one lane share a tally, which keeps the
grouping keys typed (8 bytes for numbers and times) and lets every lane read its
own columns only. Long texts are keyed by digest (see ``text_key``).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import double_text, normalized_text, parse_number, parse_timestamp, text_key, text_key_length, text_key_notes
from ..functions.text import HEAD, LONG_TEXT, column, is_digest
from ..vocab import BOOLEAN_WORDS, DATE_TOKENS, LATITUDE_TOKENS, LONGITUDE_TOKENS, PERCENT_TOKENS
from .dataset import BOOL, DOUBLE, LONG, TEXT, TIME, Dataset, Field, pin

#: Columns unpivoted in one Expand; wider lanes are cut into several.
BATCH = 100


def melt(ds: Dataset, exprs: dict[int, Column], keep: list[Column] | None = None) -> DataFrame:
    """Long form ``(keep..., ordinal, v)`` of same-typed column expressions."""
    keep = keep or []
    parts = []
    items = sorted(exprs.items())
    for start in range(0, len(items), BATCH):
        chunk = items[start : start + BATCH]
        wide = ds.rows.select(*keep, *[e.alias(str(o)) for o, e in chunk])
        ids = wide.columns[: len(keep)]
        long = wide.unpivot([column(i) for i in ids], [column(str(o)) for o, _ in chunk], "ordinal", "v")
        parts.append(long.select(*[column(i) for i in ids], F.col("ordinal").cast("int").alias("ordinal"), "v"))
    return reduce(DataFrame.unionAll, parts)


def tally(ds: Dataset, fields: list[Field], by: list[Column] | None = None) -> DataFrame:
    """Distinct values and their counts for columns of one lane."""
    def key(f: Field) -> Column:
        if f.lane in (TEXT, BOOL):
            return text_key(ds.text(f.name), _notes(ds.text(f.name)))
        return ds.key(f.name).cast("string") if f.exact else ds.value(f.name)

    long = melt(ds, {f.ordinal: key(f) for f in fields}, by)
    return long.groupBy(*long.columns).agg(F.count(F.lit(1)).alias("n"))


def label_tally(ds: Dataset, names: list[str], by: list[Column] | None = None) -> DataFrame:
    """Tally of values as labels, missing counted under ``<missing>``."""
    long = melt(ds, {ds.get(n).ordinal: text_key(ds.labelled(n)) for n in names}, by)
    return long.groupBy(*long.columns).agg(F.count(F.lit(1)).alias("n"))


def top_labels(ds: Dataset, names: list[str], k: int, by: list[Column] | None = None, by_names: list[str] = ()) -> DataFrame:
    """The k most frequent labels per column: ``(by..., ordinal, v, n, rank)``.

    The rank filter is pushed below the shuffle (window group limit), so each
    task ships at most k rows per column.
    """
    window = Window.partitionBy(*by_names, "ordinal").orderBy(F.desc("n"), F.asc("v"))
    ranked = label_tally(ds, names, by).withColumn("rank", F.row_number().over(window))
    return ranked.where(F.col("rank") <= k)


def restore_labels(ds: Dataset, top: DataFrame) -> DataFrame:
    """Replace digest keys in a pinned top-k table by the texts they stand for."""
    long = top.where(F.length("v") > 128)
    ordinals = [r.ordinal for r in long.select("ordinal").distinct().collect()]
    if not ordinals:
        return top
    by_ordinal = {f.ordinal: f.name for f in ds.fields}
    texts = []
    for o in ordinals:
        raw = ds.text(by_ordinal[o])
        wanted = F.broadcast(long.where(F.col("ordinal") == o).select(F.col("v").alias("key")).distinct())
        rows = ds.rows.select(raw.alias("text")).where(F.length("text") > 128).withColumn("key", text_key(F.col("text")))
        found = rows.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
        texts.append(found.select(F.lit(o).alias("ordinal"), "key", "text"))
    lookup = reduce(DataFrame.unionAll, texts)
    joined = top.join(F.broadcast(lookup), (top.ordinal == lookup.ordinal) & (top.v == lookup.key), "left")
    keep = [top[c] if c != "v" else F.coalesce(lookup.text, top.v).alias("v") for c in top.columns]
    return joined.select(*keep)


def ranked_labels(ds: Dataset, names: list[str], k: int, by: list[Column] | None = None, by_names: list[str] = ()) -> DataFrame:
    """Pinned top k labels per column as plain texts, ties in order of the whole text.

    Long texts are tallied under digests that keep their beginning, so only
    labels with the beginning and the count of the k-th one can be out of place.
    Where that beginning is as long as a digest's, all of them are fetched,
    their texts restored, and the first by text take the places left.
    """
    top = pin(top_labels(ds, names, k, by, by_names))
    group = [*by_names, "ordinal"]
    head = F.substring("v", 1, HEAD)
    last = pin(top.where((F.col("rank") == k) & (F.length("v") >= HEAD)).select(*group, F.col("n").alias("last_n"), head.alias("last_head")))
    ordinals = [r.ordinal for r in last.select("ordinal").distinct().collect()]
    if not ordinals:
        return _by_text(restore_labels(ds, top), group, k)
    names_of = {f.ordinal: f.name for f in ds.fields}
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in group]

    def met(rows: DataFrame, how: str) -> DataFrame:
        # one row per column and part of the table
        return rows.alias("x").join(F.broadcast(last.alias("y")), [*same, F.col("x.n") == F.col("y.last_n"), F.substring("x.v", 1, HEAD) == F.col("y.last_head")], how)

    tied = met(label_tally(ds, [names_of[o] for o in ordinals], by), "inner").select("x.*")
    texts = []
    for o in ordinals:
        raw = ds.text(names_of[o])
        mine = tied.where(F.col("ordinal") == o)
        rows = ds.rows.select(raw.alias("text")).where(F.length("text") > LONG_TEXT).withColumn("key", text_key(F.col("text")))
        full = rows.join(mine.select(F.col("v").alias("key")), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
        texts.append(mine.join(full, F.col("v") == F.col("key"), "left").withColumn("v", F.coalesce("text", "v")).select(*mine.columns))
    first = Window.partitionBy(*group).orderBy("v")
    chosen = reduce(DataFrame.unionAll, texts).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    before = restore_labels(ds, pin(met(top, "left_anti").select(*top.columns)))
    return _by_text(before.unionByName(pin(chosen)), group, k)


def _by_text(labels: DataFrame, group: list[str], k: int) -> DataFrame:
    """The first ``k`` labels of each group (a few more, pinned) by count, then text."""
    order = Window.partitionBy(*group).orderBy(F.desc("n"), F.asc("v"))
    return pin(labels.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


#: Value patterns, each with the letter that stands for it in a digest.
PATTERNS = {
    "email": ("e", vocab.EMAIL_PATTERN), "phone": ("p", vocab.PHONE_PATTERN), "url_exact": ("x", vocab.URL_EXACT_PATTERN),
    "url_prefix": ("u", vocab.URL_PREFIX_PATTERN), "date_like": ("d", vocab.DATE_LIKE_PATTERN), "filled": ("f", r"[\s\S]"),
}


def _notes(text: Column) -> Column:
    """Letters of the patterns that a whole text meets."""
    return F.concat(*[F.when(F.trim(text).rlike(p), letter).otherwise("") for letter, p in PATTERNS.values()])


#: Patterns that ask for letters or signs no number or time has; each of these is filled.
WORDED = ("email", "url_exact", "url_prefix")


def _meets(text: Column, name: str, digests: bool, plain_values: bool = False) -> Column:
    letter, pattern = PATTERNS[name]
    if plain_values and name in WORDED:
        return F.lit(False)
    if plain_values and name == "filled":
        return text.isNotNull()
    plain = F.trim(text).rlike(pattern)
    return F.when(is_digest(text), F.contains(text_key_notes(text), F.lit(letter))).otherwise(plain) if digests else plain


# -- column facts -------------------------------------------------------------
def _measured(lane: str, rows: DataFrame, fields: list[Field]) -> DataFrame:
    """Tally rows with what the rules ask of a value, in one shape for all lanes.

    Evaluated once per distinct value, not per row. Whole numbers (2024,
    20240131) may be dates only in columns named like dates.
    """
    v = F.col("v")
    false, nothing = F.lit(False), F.lit(None).cast("double")
    x, truthy, dated, length, day = nothing, false, false, F.lit(0).cast("long"), false
    shown = v  # the value as it reads in a cell
    if lane == LONG:
        shown = v.cast("string")
        x, truthy = v.cast("double"), v.isin(0, 1)
        asked = [f.ordinal for f in fields if header_words(f.name) & set(DATE_TOKENS)]
        if asked:
            shaped = F.col("ordinal").isin(asked) & (v.between(1000, 9999) | v.between(10000101, 99991231))
            dated = F.when(shaped, parse_timestamp(v.cast("string"))).isNotNull()
    elif lane == DOUBLE:
        x, shown = v.cast("double"), double_text(v.cast("double"))
    elif lane == TIME:
        shown = F.substring(v.cast("string"), 1, 10)  # asked only where all values are days
        dated, day = v.isNotNull(), v == F.date_trunc("day", v).cast("timestamp_ntz")
    else:
        x, truthy = parse_number(v), F.lower(F.trim(v)).isin(BOOLEAN_WORDS)
        dated, length = parse_timestamp(v).isNotNull(), text_key_length(v)
    return rows.select(
        "ordinal", "n", v.isNotNull().alias("present"), x.alias("x"), truthy.alias("truthy"), dated.alias("dated"),
        length.alias("length"), F.coalesce(day, false).alias("day"),
        *[F.coalesce(_meets(shown, name, lane == TEXT, lane != TEXT), false).alias(name) for name in PATTERNS],
        (normalized_text(v) if lane == TEXT else F.lit(None).cast("string")).alias("normal"),
    )


def _facts(measured: DataFrame, fields: list[Field]) -> DataFrame:
    """One row per column; every aggregate merges, so the map stage does most.

    Ranges that only matter under certain headers are left out where no header
    asks for them.
    """
    n, x, present = F.col("n"), F.col("x"), F.col("present")
    zero = F.lit(0).cast("long")
    words = set().union(*[header_words(f.name) for f in fields])
    placed, shared = words & {*LATITUDE_TOKENS, *LONGITUDE_TOKENS}, words & set(PERCENT_TOKENS)

    def weight(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), zero)

    whole = F.rint(x)
    near = (x == whole) | (F.abs(x - whole) <= F.lit(1e-9) + F.lit(1e-5) * F.abs(whole))
    return measured.groupBy("ordinal").agg(
        F.sum("n").alias("rows"),
        weight(present).alias("non_null"),
        F.count_if(present).alias("unique"),
        F.coalesce(F.max(F.when(present, n)), zero).alias("top_n"),
        F.coalesce(F.sum(F.when(present, n * F.log2(n))), F.lit(0.0)).alias("n_log_n"),
        weight(present & F.col("truthy")).alias("bool_n"),
        weight(F.col("dated")).alias("date_n"),
        F.coalesce(F.sum(F.when(present, F.col("length") * n)), zero).alias("text_length"),
        F.coalesce(F.bool_and(F.when(present, F.col("day"))), F.lit(False)).alias("midnight"),
        weight(x.isNotNull()).alias("num_n"),
        F.count(x).alias("num_unique"),
        weight(near).alias("int_n"),
        weight(x >= 0).alias("nonneg_n"),
        (weight(x.between(-90, 90)) if placed else zero).alias("lat_n"),
        (weight(x.between(-180, 180)) if placed else zero).alias("lng_n"),
        (weight(x.between(0, 1)) if shared else zero).alias("unit_n"),
        (weight(x.between(0, 100)) if shared else zero).alias("pct_n"),
        F.coalesce(F.bool_and((x > -1) & (x < 2)), F.lit(False)).alias("unit_like"),
        *[weight(F.col(name)).alias(f"{name}_n") for name in PATTERNS],
        *[F.coalesce(F.bool_and(F.when(F.col("filled"), F.coalesce(F.col("normal").isin(scale), F.lit(False)))), F.lit(False)).alias(f"scale_{i}") for i, scale in enumerate(vocab.ORDINAL_SCALES)],
    )


FACT_NAMES = [
    "rows", "non_null", "unique", "top_n", "n_log_n", "bool_n", "date_n", "text_length", "midnight",
    "num_n", "num_unique", "int_n", "nonneg_n", "lat_n", "lng_n", "unit_n", "pct_n", "unit_like",
    *[f"{name}_n" for name in PATTERNS], *[f"scale_{i}" for i in range(len(vocab.ORDINAL_SCALES))],
]
_TRUTHS = {"midnight", "unit_like", *[f"scale_{i}" for i in range(len(vocab.ORDINAL_SCALES))]}


def column_facts(ds: Dataset) -> DataFrame:
    """Pinned table of one row per column, in column order (computed once)."""
    return ds.remember("column_facts", lambda: _column_facts(ds))


def _column_facts(ds: Dataset) -> DataFrame:
    lanes: dict[str, list[Field]] = {}
    for f in ds.fields:
        lanes.setdefault((TEXT if f.lane == BOOL else f.lane, f.exact), []).append(f)
    if not lanes:
        raise ValueError("the table has no column of a supported type")
    measured = [_measured(lane, tally(ds, fields), fields) for (lane, _), fields in lanes.items()]
    facts = pin(_facts(reduce(DataFrame.unionAll, measured), ds.fields))
    heads = ds.spark.createDataFrame(
        [(f.ordinal, f.name, f.lane) for f in ds.fields], "ordinal int, name string, lane string"
    )
    filled = [
        F.coalesce(F.col(k), F.lit(False) if k in _TRUTHS else F.lit(0.0) if k == "n_log_n" else F.lit(0).cast("long")).alias(k)
        for k in FACT_NAMES
    ]
    table = heads.join(F.broadcast(facts), "ordinal", "left").select("ordinal", "name", "lane", *filled)
    table = pin(table.withColumn("missing", F.col("rows") - F.col("non_null")).orderBy("ordinal"))
    return _merge_equal_numbers(ds, table)


def _merge_equal_numbers(ds: Dataset, table: DataFrame) -> DataFrame:
    """Distinct numbers of text columns whose texts may differ for one number
    ('1', '1.0'). It matters only where all numbers are 0 or 1, so it is counted
    only there."""
    doubtful = table.where((F.col("lane") == TEXT) & F.col("unit_like") & (F.col("num_unique") > 2)).select("ordinal", "name").collect()
    if not doubtful:
        return table
    counts = ds.rows.agg(*[F.countDistinct(ds.number(r["name"])).alias(str(r.ordinal)) for r in doubtful]).first()
    exact = F.col("num_unique")
    for r in doubtful:
        exact = F.when(F.col("ordinal") == r.ordinal, F.lit(counts[str(r.ordinal)]).cast("long")).otherwise(exact)
    return pin(table.withColumn("num_unique", exact).orderBy("ordinal"))


def header_words(name: str) -> set[str]:
    """Words of one header, for plan choices made before a query runs."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return {w.lower() for w in re.findall(r"[A-Za-z0-9]+", spaced)}
