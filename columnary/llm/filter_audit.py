"""Filter interaction audit: what every order of a set of filters removes, step by step.

1. Every document gets a bit per filter whose failure condition it meets; rows
   collapse to cells (part, bits) with counts. Copies of a text are told by a
   digest: rows are counted per (digest, part, id) and then per (digest, part),
   so a text that fills a third of the table is counted before it meets in a task.
2. A recursive query extends filter prefixes by every letter not used yet. A
   level joins the cells of each part, carries the applied bits and emits the
   counts of its step. Its size is parts x prefixes, whatever the documents.
3. The complete prefixes are the orders; every step of an order is the level
   that its beginning names, and sums over all orders share out what is removed.

Defined cases: null text is empty; a null part is the empty string; a condition
that is null is not met; a copy is a text that a row of a smaller id has, rows of
the same or of no id are no copies of each other; repeated label rows count once
by their largest value; rows without label are neither good nor toxic; an empty
table has no parts and no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, words

#: The letter of the copy filter; the others are conditions on the text.
COPY = "E"
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of one text, in order of their letters."""
    body = F.coalesce(text, F.lit(""))
    said = words(body)
    capitals = F.char_length(body) - F.char_length(F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(said) < 100,
        "B": 100 * F.size(F.array_distinct(said)) < 80 * F.size(said),
        "C": 100 * capitals > 10 * F.char_length(body),
        "D": body.rlike("[#$%&*|]"),
    }


def _sum(flag: Column) -> Column:
    return F.sum(flag.cast("long"))


def mask_cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], part: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: documents per set of failed filters; the copy filter has the highest bit."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.coalesce(F.max("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.max("toxic") == 1, F.lit(False)).alias("toxic"))
    bits = F.lit(0)
    for i, fails in enumerate(filters.values()):
        bits = bits + F.when(fails, 1 << i).otherwise(0)
    rows = docs.select(
        "doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), bits.alias("bits"))
    known = rows.join(marks, "doc_id", "left")
    by_id = known.groupBy("digest", "part", "bits", "doc_id").agg(
        F.count(F.lit(1)).alias("n"), _sum(F.coalesce("good", F.lit(False))).alias("good"), _sum(F.coalesce("toxic", F.lit(False))).alias("toxic"))
    total = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    own = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n", "good", "toxic"))).alias("own")
    none = [F.sum(F.when(F.col("doc_id").isNull(), F.col(c)).otherwise(0)).alias(f"{c}_none") for c in ("n", "good", "toxic")]
    by_text = by_id.groupBy("digest", "part", "bits").agg(own, *total, *none)
    # a few rows per text, one for a part and set of bits: the least id of a text over all of them
    least = by_text.groupBy("digest").agg(F.min("own.doc_id").alias("least"), F.collect_list(
        F.struct("part", "bits", "own", "n", "good", "toxic", "n_none", "good_none", "toxic_none")).alias("parts"))
    apart = least.select("least", F.inline("parts"))

    def first(c: str) -> Column:
        return F.col(f"{c}_none") + F.when(F.col("own.doc_id") == F.col("least"), F.col(f"own.{c}")).otherwise(0)

    cells = [F.struct(F.col("bits").alias("mask"), *[first(c).alias(c) for c in ("n", "good", "toxic")]),
             F.struct((F.col("bits") + (1 << len(filters))).alias("mask"), *[(F.col(c) - first(c)).alias(c) for c in ("n", "good", "toxic")])]
    return apart.select("part", F.inline(F.array(*cells))).groupBy("part", "mask").agg(*total)


def _count(condition: str, what: str = "n") -> str:
    return f"aggregate(filter(cells, c -> {condition}), 0L, (a, c) -> a + c.{what})"


def enumerate_orders(cells: DataFrame, letters: list[str]) -> DataFrame:
    """``part, prefix, step`` and the counts of the prefix's last step, for every prefix of every order."""
    spark = cells.sparkSession
    parts = cut(cells.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells")), "cells")
    unused = "array(" + ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << i})" for i, x in enumerate(letters)) + ")"
    here, gone = "(c.mask & applied) = 0 AND (c.mask & bit) <> 0", "(c.mask & applied) <> 0 AND (c.mask & bit) <> 0"
    query = f"""
        WITH RECURSIVE walk(part, prefix, applied, step, {", ".join(METRICS)}) AS (
            SELECT part, '', 0, 0, {", ".join(["0L"] * len(METRICS))} FROM {{parts}}
            UNION ALL
            SELECT part, concat(prefix, letter), applied | bit, step + 1,
                {_count("(c.mask & (applied | bit)) = 0")}, {_count(here)}, {_count(gone)},
                {_count("c.mask = bit")}, {_count(here, "good")}, {_count(here, "toxic")}
            FROM (SELECT w.part, w.prefix, w.applied, w.step, p.cells, filter({unused}, x -> (w.applied & x.bit) = 0) AS open
                  FROM walk w JOIN {{parts}} p ON p.part = w.part) LATERAL VIEW inline(open) AS letter, bit)
        SELECT part, prefix, step, {", ".join(METRICS)} FROM walk WHERE step > 0
    """
    prefixes, level = 1, 1
    for k in range(len(letters), 0, -1):
        level *= k
        prefixes += level
    # the result has this many rows exactly; Spark stops recursions beyond a setting
    name, bound = "spark.sql.cteRecursionRowLimit", parts.count() * prefixes + 1
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(max(bound, 1_000_000)))
    try:
        return cut(spark.sql(query, parts=parts), "orders")
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, part: str = "lang") -> DataFrame:
    """Per ``part, filter_order, step``: the counts of that step and ``shapley``, its filter's removals over all orders.

    ``filters`` maps letters to failure conditions on columns of ``docs`` (by
    default ``text_filters``); the copy filter ``E`` always comes with them. The
    orders are all permutations: meant for up to eight filters.
    """
    conditions = text_filters(F.col("text")) if filters is None else filters
    if any(len(x) != 1 or not x.isalnum() or x == COPY for x in conditions):
        raise ValueError(f"filters are named by single letters or digits other than {COPY}")
    letters = [*conditions, COPY]
    cells = mask_cells(docs, labels, conditions, part)
    walked = enumerate_orders(cells, letters)
    orders = walked.where(F.col("step") == len(letters)).select("part", F.col("prefix").alias("filter_order"))
    steps = orders.select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    every = steps.withColumn("prefix", F.expr("substring(filter_order, 1, step)")).join(walked, ["part", "prefix", "step"])
    share = every.groupBy("part", F.expr("substring(filter_order, step, 1)").alias("letter")).agg(F.sum("removed").alias("shapley"))
    shown = every.withColumn("letter", F.expr("substring(filter_order, step, 1)")).join(share, ["part", "letter"])
    return shown.select("part", "filter_order", "step", *METRICS, "shapley")
