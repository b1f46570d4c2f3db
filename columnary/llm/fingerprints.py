"""Document fingerprints: threshold-scaled sketches, DataFrame functions only.

A text is the set of its five-word shingle hashes (63 bits); the fingerprint
keeps every hash below a fixed fraction ``1 / SCALE`` of the range. Two such
sketches are complete below their common threshold, so intersections and unions
of them estimate those of the texts however unequal these are, and sketches of
parts merge by union. A text with fewer than ``LEAST`` hashes below the fraction
keeps its ``LEAST`` smallest and states the lower or higher threshold up to which
it is complete; comparisons use the smaller threshold of the two.

As text: the threshold and the sorted hashes, 16 hex digits each, as
``threshold:hash,hash,...``.

Defined cases: null text is empty; a text without words has no hashes, is like
another without words (1.0) and unlike all else (0.0); fewer than five words are
one shingle; a null id comes last in the order; rows with equal id and text are
one in the order and kept each; one row alone is its own next document; an empty
table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, words

SCALE, LEAST, WIDTH = 16, 32, 5
_TOP = (1 << 63) - 1
_BELOW = (1 << 63) // SCALE


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``name``: a struct of the threshold ``top`` and the sorted ``hashes`` below it."""
    # each step is a projection of its own, so that no array is made twice
    low = df.withColumn("w_", words(ascii_lower(F.col(text))))
    starts = F.when(F.size("w_") > 0, F.sequence(F.lit(1), F.greatest(F.size("w_") - WIDTH + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    hashed = low.withColumn("h_", F.transform(starts, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice("w_", i, WIDTH)), 1))).drop("w_")
    split = hashed.withColumn("b_", F.array_distinct(F.filter("h_", lambda h: h < _BELOW)))
    few = F.array_sort(F.array_distinct("h_"))
    kept = split.withColumn("k_", F.when(F.size("b_") >= LEAST, F.array_sort("b_")).otherwise(F.slice(few, 1, LEAST)))
    top = F.when(F.size("b_") >= LEAST, F.lit(_BELOW)).when(F.size("k_") < LEAST, F.lit(_TOP)).otherwise(F.element_at("k_", -1) + 1)
    return kept.withColumn(name, F.struct(top.alias("top"), F.col("k_").alias("hashes"))).drop("h_", "b_", "k_")


def as_text(sketch: str) -> Column:
    hex16 = lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))
    return F.concat(hex16(F.col(sketch)["top"]), F.lit(":"), F.array_join(F.transform(F.col(sketch)["hashes"], hex16), ","))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    top = F.least(F.col(a)["top"], F.col(b)["top"])
    one, two = (F.filter(F.col(s)["hashes"], lambda h: h < top) for s in (a, b))
    together = F.size(F.array_union(one, two))
    return F.when(together == 0, 1.0).otherwise(F.size(F.array_intersect(one, two)) / together)


def containment(a: str, b: str) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too."""
    top = F.least(F.col(a)["top"], F.col(b)["top"])
    one, two = (F.filter(F.col(s)["hashes"], lambda h: h < top) for s in (a, b))
    return F.when(F.size(one) == 0, 1.0).otherwise(F.size(F.array_intersect(one, two)) / F.size(one))


def successors(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_chars, next_id, next_key`` of every different row, by descending id, cyclic.

    Only ids, digests and lengths are sorted, in parallel by range; a row's
    place is its place in its part and the rows of the parts before it.
    """
    keys = docs.groupBy("doc_id", "text_key").agg(F.max(F.char_length("text")).alias("n_chars"))
    order = [F.desc_nulls_last("doc_id"), F.asc("text_key")]
    placed = cut(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "order")
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    offsets = sizes.select("part", before.alias("before"))  # one row per partition
    total = placed.count()
    numbered = placed.withColumn("part", part).join(F.broadcast(offsets), "part").select("doc_id", "text_key", "n_chars", (F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("n"))
    own = numbered.withColumn("m", (F.col("n") + 1) % F.lit(max(1, total)))
    other = numbered.select(F.col("doc_id").alias("next_id"), F.col("text_key").alias("next_key"), F.col("n").alias("m"))
    return cut(own.join(other, "m").select("doc_id", "text_key", "n_chars", "next_id", "next_key"), "successors")


def _on(left: DataFrame, right: DataFrame) -> list[Column]:
    return [left["doc_id"].eqNullSafe(right["at_id"]), left["text_key"] == right["at_key"]]


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id, n_chars, edited_sha256``, the sketches ``own`` and ``changed``, and
    ``near_edited, near_next, contained_edited``.

    The edited text is the text whose last third is replaced by the
    beginning of the next document. Texts move once, and of each next document
    only the beginning that is asked for.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    links = successors(rows)
    asked = links.select(F.col("next_id").alias("at_id"), F.col("next_key").alias("at_key"), F.col("doc_id").alias("to_id"), F.col("text_key").alias("to_key"), F.floor(F.col("n_chars") / 3).cast("int").alias("take"))
    source = rows.select("doc_id", "text_key", "text")
    begins = source.join(asked, _on(source, asked)).select(F.col("to_id").alias("at_id"), F.col("to_key").alias("at_key"), "take", F.substr("text", F.lit(1), F.col("take")).alias("begin")).dropDuplicates(["at_id", "at_key"])
    both = source.join(begins, _on(source, begins)).select(
        "doc_id", "text_key", "text", F.char_length("text").alias("n_chars"), F.concat(F.substr("text", F.lit(1), F.char_length("text") - F.col("take")), "begin").alias("edited"))
    sketched = with_sketch(with_sketch(both, "text", "own").drop("text"), "edited", "changed")
    made = cut(sketched.select("doc_id", "text_key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "changed"), "sketches")
    following = links.select(F.col("doc_id").alias("to_id"), F.col("text_key").alias("to_key"), F.col("next_id").alias("at_id"), F.col("next_key").alias("at_key"))
    nexts = made.join(following, _on(made, following)).select(F.col("to_id").alias("at_id"), F.col("to_key").alias("at_key"), F.col("own").alias("next_own")).dropDuplicates(["at_id", "at_key"])
    return made.join(nexts, _on(made, nexts)).select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "own", "changed",
        likeness("own", "changed").alias("near_edited"), likeness("own", "next_own").alias("near_next"), containment("own", "changed").alias("contained_edited"))
