"""Benchmark decontamination by templates: DataFrame functions only.

Numbers, names and units of a text become typed marks, so a question asked again
with other values keeps its template. Windows of five template words of all
documents are hash-joined with those of the benchmark; a document holds an item
when it has at least 75 percent of the item's windows. Where the template has
marks, the values behind them are compared on every alignment that reaches this
share alone (where none does, on the commonest), and the closest one counts:
equal values are a verbatim copy; other numbers and units, and other names that are a
one-to-one renaming, a re-parameterised one. Anything else is reported as
``inconsistent`` where that is asked for (the query and the pipeline do) and is
no copy otherwise.

A capital at the start of a text, sentence or quotation may start a name or not, so
every text is read three ways: all capitalised words as names, those inside
sentences only, and none. A window is met when any two readings of it agree; two
windows of an item that differ in the last reading are two. A text is marked and cut
into words once; each word is one number whose lowest bits tell names, so the
readings of a window are hashes of five numbers, and a window without capitals has one.

Windows with fewer than two plain words say too little and do not count; an item
of which no window says enough is looked for by its very words, numbers kept. An
item of fewer than five words is one window of its own, and documents are asked
for windows of each such length.

Defined cases: null or empty texts and items without words match nothing; rows with equal id and
text are one; a null id is reported as null; an empty table on either side gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut

WIDTH, COVERAGE, PLAIN_WORDS = 5, 0.75, 2
#: Kinds of copies, the closest first.
KINDS = ("verbatim", "reparameterised", "inconsistent")
#: Words that count as units behind a number.
UNITS = "percent|%|kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|mile|miles|meter|meters|metre|metres|foot|feet|ft|inch|inches|second|seconds|sec|s|minute|minutes|min|hour|hours|h|day|days|week|weeks|month|months|year|years|dollar|dollars|cent|cents|euro|euros|pound|pounds|liter|liters|litre|litres|l|ml|degree|degrees|times"
_NAME, _NUMBER, _UNIT, _FIRST = "\ue000", "\ue001", "\ue002", "\ue003"
#: What lies between words; a point or comma belongs to a number that it stands inside of.
_SEPARATOR = rf"(?:[^\p{{L}}\p{{N}}.,{_NAME}{_NUMBER}{_UNIT}{_FIRST}]|[.,](?!\d)|(?<!\d)[.,])+"
#: Codes of the types, and the bits that tell names and perhaps-names from other words.
_NUMBER_CODE, _UNIT_CODE, _NAME_CODE, _IS_NAME, _IS_FIRST = 4, 8, 12, 1, 2


def marked(text: Column) -> Column:
    """``text`` with a type mark in front of names, numbers and units."""
    # a capital inside a sentence starts a name; behind a full stop or line start it may, and has a mark of its own
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Lu}(?<=[\p{Ll}\p{N},;:]\s.)\p{L}*", _NAME + "$0")
    t = F.regexp_replace(t, rf"\p{{Lu}}(?<![\p{{L}}\p{{N}}{_NAME}].)\p{{L}}*", _FIRST + "$0")
    t = F.regexp_replace(t, r"\d(?<![\p{L}\p{N}].)[\d.,]*(?<=\d)", _NUMBER + "$0")
    return F.regexp_replace(t, f"(?i)({_NUMBER}\\S+\\s+)({UNITS})(?![\\p{{L}}\\p{{N}}])", f"$1{_UNIT}$2")


def _tokens(text: Column) -> Column:
    """Words of ``text`` in their own case, with the mark of their type in front; punctuation gone."""
    return F.array_remove(F.split(marked(text), _SEPARATOR), "")


def _spoken(text: Column) -> Column:
    return F.transform(_tokens(text), F.lower)


def _bare(t: Column) -> Column:
    return F.translate(t, _NAME + _FIRST + _NUMBER + _UNIT, "")


def _code(t: Column) -> Column:
    """A word as one number: the type of numbers and units, else the hash of the word and in its two
    lowest bits whether it is a name or a sentence's first word."""
    hashed = lambda w, kind: F.shiftleft(F.xxhash64(F.lower(w)), 2).bitwiseOR(F.lit(kind).cast("long"))
    rest = F.substring(t, 2, 1 << 30)
    return (F.when(t < _NAME, hashed(t, 0))  # marks sort behind nearly all letters
            .when(t.startswith(_NUMBER), F.lit(_NUMBER_CODE).cast("long")).when(t.startswith(_UNIT), F.lit(_UNIT_CODE).cast("long"))
            .when(t.startswith(_NAME), hashed(rest, _IS_NAME)).when(t.startswith(_FIRST), hashed(rest, _IS_FIRST)).otherwise(hashed(t, 0)))


def _coded(texts: DataFrame, *keys: str, said: bool) -> DataFrame:
    """``keys`` and ``codes`` of the words of ``text``; with ``said`` also their hashes with the values kept."""
    split = texts.select(*keys, _tokens(F.col("text")).alias("tokens"))
    codes = [F.transform("tokens", _code).alias("codes")]
    if said:
        codes.append(F.transform("tokens", lambda t: F.xxhash64(F.lower(_bare(t)))).alias("said"))
    return split.select(*keys, *codes)


def _placed(coded: DataFrame, shortest: int) -> DataFrame:
    """A row per first position ``pos`` of a window, with the next words ``c0, c1, ...`` (and ``s0, ...`` as said)."""
    # a text without words has no position; a filter on the size would make the codes twice
    at = coded.withColumn("pos", F.explode(F.when(F.size("codes") > 0, F.sequence(F.lit(0), F.greatest(F.size("codes") - shortest, F.lit(0))))))
    names = [("codes", "c"), *([("said", "s")] if "said" in coded.columns else [])]
    words = [F.get(array, F.col("pos") + j).alias(f"{c}{j}") for array, c in names for j in range(WIDTH)]
    return at.select("*", F.size("codes").alias("size"), *words).drop("codes", "said")


def _reading(length: int, names: int) -> Column:
    """Hash of the next ``length`` words, those with any of the bits ``names`` as names without a value."""
    word = lambda c: F.when(c.bitwiseAND(names) != 0, _NAME_CODE).otherwise(c.bitwiseAND(-4)) if names else c.bitwiseAND(-4)
    return F.xxhash64(*(word(F.col(f"c{j}")) for j in range(length)))


def _readings(length: int, reading: Callable[[int], Column]) -> Column:
    """The different readings of a window: its words only, all capitalised words as names, and those inside sentences."""
    bits = reduce(Column.bitwiseOR, (F.coalesce(F.col(f"c{j}"), F.lit(0)) for j in range(length))).bitwiseAND(3)
    words, every, inside = reading(0), reading(_IS_NAME | _IS_FIRST), reading(_IS_NAME)
    return F.when(bits == 0, F.array(words)).when(bits < 3, F.array(words, every)).otherwise(F.array(words, every, inside))


def _said(length: int) -> Column:
    return F.xxhash64(F.lit("exact"), *(F.col(f"s{j}") for j in range(length)))


def _fits(length: int, pos: str) -> Column:
    """Whether ``length`` words follow; a shorter text is one window."""
    return (F.col(pos) + length <= F.col("size")) | (F.col(pos) == 0)


def item_windows(items: DataFrame) -> DataFrame:
    """``window, item_id, item_pos, told, length, exact, n_windows`` of every benchmark item; readings of a window share ``told``."""
    placed = _placed(_coded(items, "item_id", said=True), WIDTH).withColumnRenamed("pos", "item_pos").withColumn("length", F.least(F.lit(WIDTH), F.col("size")))

    def plain(names: int) -> Column:
        ordinary = lambda c: ~c.isin(_NUMBER_CODE, _UNIT_CODE) & (c.bitwiseAND(names) == 0)
        return sum((F.coalesce(ordinary(F.col(f"c{j}")).cast("int"), F.lit(0)) for j in range(WIDTH)), F.lit(0))

    spread = placed.select("item_id", "item_pos", "length", "size", _reading(WIDTH, 0).alias("told"), F.explode(
        _readings(WIDTH, lambda names: F.struct(_reading(WIDTH, names).alias("window"), plain(names).alias("plain")))).alias("read"))
    told = spread.where(F.col("read.plain") >= F.least(F.lit(PLAIN_WORDS), F.col("size"))).select("item_id", "item_pos", "length", "told", "read.window", F.lit(False).alias("exact")).distinct()
    mute = placed.join(told.select("item_id").distinct(), "item_id", "left_anti").select("item_id", "item_pos", "length", _said(WIDTH).alias("window")).distinct()
    told = told.unionByName(mute.withColumn("told", F.col("window")).withColumn("exact", F.lit(True)))
    sizes = told.groupBy("item_id").agg(F.count_distinct("told").alias("n_windows"))
    return told.join(sizes, "item_id")


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", inconsistent: bool = False) -> DataFrame:
    """``doc_id, item_id, n_windows, n_matched, coverage, n_slots, kind`` for every document that holds an item;
    with ``inconsistent`` also where names are mixed up."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    made = cut(item_windows(items), "item-windows")
    windows = broadcast_if_small(made)
    shapes = [(x["length"], x["exact"]) for x in made.select("length", "exact").distinct().collect()]  # ten at most
    short, exact = ([k for k, e in shapes if e == kind and (e or k < WIDTH)] for kind in (False, True))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    placed = _placed(_coded(keyed, "doc_id", "text_key", said=bool(exact)), min([WIDTH, *short, *exact])).withColumnRenamed("pos", "doc_pos")
    asked = [F.when(_fits(k, "doc_pos"), _readings(k, lambda names: _reading(k, names))) for k in (WIDTH, *short)]  # noqa: B023
    asked += [F.when(_fits(k, "doc_pos"), F.array(_said(k))) for k in exact]
    asked = asked[0] if len(asked) == 1 else F.concat(*(F.coalesce(a, F.array().cast("array<bigint>")) for a in asked))
    spread = placed.select("doc_id", "text_key", "doc_pos", F.explode(asked).alias("window"))
    met = cut(spread.join(windows, "window").select("doc_id", "text_key", "item_id", "n_windows", "told", "item_pos", "doc_pos"), "template-matches")
    key = ["doc_id", "text_key", "item_id"]
    holding = met.groupBy(*key).agg(F.first("n_windows").alias("n_windows"), F.count_distinct("told").alias("n_matched")).where(F.col("n_matched") >= COVERAGE * F.col("n_windows"))
    lanes = met.groupBy(*key, (F.col("doc_pos") - F.col("item_pos")).alias("shift")).agg(F.count_distinct("told").alias("n"), F.first("n_windows").alias("of"))
    enough = F.filter("lanes", lambda x: x["n"] >= COVERAGE * x["of"])
    # the commonest alignment, least shift first, and all that reach the coverage
    lanes = lanes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "shift", "n", "of"))).alias("lanes"))
    lanes = lanes.withColumn("lane", F.explode(F.when(F.size(enough) > 0, enough).otherwise(F.slice("lanes", 1, 1)))).select(*key, "lane.shift", "lane.less")
    same = [F.col(f"h.{k}").eqNullSafe(F.col(f"l.{k}")) for k in key]
    found = cut(holding.alias("h").join(lanes.alias("l"), same).select("h.*", "l.shift", "l.less"), "template-holders")
    return _slots(docs, items, found, inconsistent)


def _slots(docs: DataFrame, items: DataFrame, found: DataFrame, inconsistent: bool) -> DataFrame:
    """Compares the values behind the marks of ``found`` pairs along each alignment, and keeps the closest."""
    ids = broadcast_if_small(found.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).distinct())
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").join(ids, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left_semi").dropDuplicates(["doc_id", "text_key"])
    rich_docs = texts.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), _spoken(F.col("text")).alias("doc_tokens"))
    rich_items = items.dropDuplicates(["item_id"]).select(F.col("item_id").alias("i"), _spoken(F.col("text")).alias("item_tokens"))
    both = found.join(rich_docs, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))).join(broadcast_if_small(rich_items), F.col("item_id").eqNullSafe(F.col("i")))
    places = F.transform("item_tokens", lambda t, p: F.struct(t.alias("asked"), F.get("doc_tokens", p + F.col("shift")).alias("said")))
    both = both.withColumn("places", places)
    def word(t: Column) -> Column:
        return F.translate(F.regexp_replace(t, f"([{_NUMBER}{_UNIT}])\\S+", "$1"), _NAME + _FIRST, "")

    def named(s: Column) -> Column:
        return s["asked"].rlike(f"^[{_NAME}{_FIRST}]") & s["said"].rlike(f"^[{_NAME}{_FIRST}]")

    def same(s: Column) -> Column:
        """Whether a place past either end, or one where both sides agree in a reading."""
        return F.coalesce((word(s["asked"]) == word(s["said"])) | named(s), F.lit(True))

    # a slot carries the same type of mark on both sides, between words that agree
    slot = lambda s: named(s) | reduce(Column.__or__, (s["asked"].startswith(m) & s["said"].startswith(m) for m in (_NUMBER, _UNIT)))
    slots = F.array_distinct(F.filter("places", lambda s, p: s["said"].isNotNull() & slot(s) & same(F.get("places", p - 1)) & same(F.get("places", p + 1))))
    judged = both.withColumn("slots", slots)
    # a sentence's first word is not sure to be a name: it may differ, but mixes nothing up
    names = F.filter("slots", lambda s: s["asked"].startswith(_NAME) & s["said"].startswith(_NAME))
    renamed = [F.size(F.array_distinct(F.transform(names, lambda s: s[side]))) == F.size(names) for side in ("asked", "said")]  # noqa: B023
    equal = F.forall("slots", lambda s: _bare(s["asked"]) == _bare(s["said"]))
    judged = judged.withColumn("rank", F.when(equal, 0).when(renamed[0] & renamed[1], 1).otherwise(2)).withColumn("n_slots", F.size("slots").cast("long"))
    best = judged.groupBy("doc_id", "text_key", "item_id", "n_windows", "n_matched").agg(F.min(F.struct("rank", "less", "shift", "n_slots")).alias("best"))
    kinds = F.array(*map(F.lit, KINDS))
    return best.where(F.lit(inconsistent) | (F.col("best.rank") < 2)).select(
        "doc_id", "item_id", "n_windows", "n_matched", (F.col("n_matched") / F.col("n_windows")).alias("coverage"),
        "best.n_slots", F.get(kinds, F.col("best.rank")).alias("kind"),
    ).distinct()


def clean(docs: DataFrame, benchmark: DataFrame, inconsistent: bool = False) -> DataFrame:
    """``docs`` without the rows whose id is contaminated; columns as they are."""
    bad = contaminated(docs, benchmark, inconsistent=inconsistent).select(F.col("doc_id").alias("bad_id")).distinct()
    bad = broadcast_if_small(cut(bad, "contaminated"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")), "left_anti")
