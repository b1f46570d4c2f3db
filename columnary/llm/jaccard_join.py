"""N-gram Jaccard join: prefix filters under several global token orders, intersected.

Documents are sets of distinct three-word shingles; two are linked when
100 * intersection >= 90 * union. A pair that is linked shares the first of its
common shingles early in both sets, whatever global order the shingles have:
within the first n - ceil(0.9 n) + l places of both, it shares l of them. The
filters of three orders have to agree before full sets are compared:

1. Equal sets are one class. Two hashed orders give each class a prefix with
   l = 1 + n / 20; a class stays only if enough of its first prefix occurs in the
   first prefixes of other classes. Among those that stay the same is asked of a
   longer prefix of the second order, l = 1 + n / 8: it tells classes with half of
   their shingles in other texts from those with nine tenths.
2. The third order is by rising number of classes that hold a shingle, counted
   over the classes left. Passages that many texts share come last in it and
   make no pairs; shingles of one class alone only use up places of its prefix.
3. Classes that share a prefix shingle are candidates. First every class meets
   the class of its bucket with the fewest shingles of its own (linear in the
   rows). Then pairs whose classes are still in different components, minus
   those that sizes, places or unshared shingles rule out.
4. Candidates whose hashed prefixes share too little under either order go, the
   rest are compared on their full sets. Components by pointer jumping.

No link is lost: every filter is a necessary condition. In a bucket of many
distinct texts just below the threshold the pairs of different components are
compared one by one, spread over the tasks.

Defined cases: null or empty text has an empty set and no link; a null id gets
the component of its class, or null where no row of it has an id; rows with
equal ids or texts are kept; an empty table gives an empty one; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, ship, take_worker
from .neardup import BROADCAST_IDS, components
from .shingles import chunks, mix, shingle_set

WIDTH = 3
#: One salt per hashed global order.
ORDERS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
#: Prefixes are made for one common shingle and one more for every so many of a set.
SHORT, LONGER = 20, 8


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _least_overlap(n: int) -> int:
    """Shingles that a set of n shares with any set it is linked to."""
    return (9 * n + 9) // 10


def hashed_prefix(s: np.ndarray, salt: int, every: int = SHORT) -> np.ndarray:
    """The first shingles of a set in the order of their salted hashes."""
    n = len(s)
    m = n - _least_overlap(n) + 1 + n // every
    return np.sort(mix(s ^ np.uint64(salt)))[:m]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.empty(0, np.uint64)]).view(np.int64)))


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, class_key, first``: set size, digest and prefix in the first hashed order of every row."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("shingles")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                sets = [shingle_set(t, WIDTH) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    _lists([hashed_prefix(s, ORDERS[0]) for s in sets]),
                ], names=["doc_id", "n_shingles", "class_key", "first"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(build, f"doc_id {kind}, n_shingles long, class_key binary, first array<long>")


def _met(classes: DataFrame, prefix: str = "first", every: int = SHORT) -> DataFrame:
    """Ids of the classes whose prefix has enough shingles of the prefixes of other classes."""
    places = classes.select("cid", "n", F.explode(prefix).alias("token"))
    shared = places.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("token")
    found = places.join(shared, "token").groupBy("cid", "n").agg(F.count(F.lit(1)).alias("found"))
    # a linked class has at least 0.9 n shingles, so its prefix gives l = 1 + 0.9 n / every at least
    return found.where(F.col("found") >= 1 + F.floor(9 * F.col("n") / (10 * every))).select("cid")


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``cid, text, n, first, second, longer``: one text of each wanted class, its set size and hashed prefixes."""
    chosen = classes.join(wanted, "cid", "left_semi").select("cid", "class_key", F.col("rep").alias("chosen"))
    ids = chosen.select("chosen").distinct()
    # ids are of fixed size where numeric: their number bounds a broadcast, and texts are filtered in place
    ids = broadcast_if_small(ids, BROADCAST_IDS) if dict(docs.dtypes)["doc_id"] in ("int", "bigint") else ids
    found = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("chosen")), "left_semi").select("text")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("shingles")
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([_digest(shingle_set(t, WIDTH)) for t in texts], pa.binary()), batch.column(0)], names=["class_key", "text"])

    # ids may repeat with other texts: the class is taken from the text itself
    keyed = found.mapInArrow(key, "class_key binary, text string").dropDuplicates(["class_key"])
    one = keyed.join(chosen.select("class_key", "cid"), "class_key").select("cid", "text")

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("shingles")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                sets = [shingle_set(t, WIDTH) for t in texts[a:b]]
                prefixes = [_lists([hashed_prefix(s, salt, every) for s in sets]) for salt, every in (*zip(ORDERS, (SHORT, SHORT)), (ORDERS[1], LONGER))]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), *prefixes,
                ], names=["cid", "text", "n", "first", "second", "longer"])

    return one.mapInArrow(orders, "cid long, text string, n long, first array<long>, second array<long>, longer array<long>")


def rarest_first(texts: DataFrame) -> DataFrame:
    """``cid, n, own, token, place``: prefixes in the order of rising class counts.

    ``own`` counts the shingles no other class has. They come first in the order
    and are not listed; ``place`` counts them.
    """
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("shingles")
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                s = shingle_set(text, WIDTH)
                rows = pa.array(np.full(len(s), i, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(np.full(len(s), len(s), np.int64)), pa.array(s.view(np.int64))], names=["cid", "n", "token"])

    units = cut(texts.select("cid", "text").mapInArrow(explode, "cid long, n long, token long"), "tokens")
    spread = units.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    one = Window.partitionBy("cid")  # at most the shingles of one document
    known = units.join(spread, "token").withColumn("shared", F.count(F.lit(1)).over(one))
    enough = known.where(F.col("shared") * 10 >= F.col("n") * 9)
    place = F.row_number().over(one.orderBy("df", "token")) - 1 + F.col("n") - F.col("shared")
    ranked = enough.select("cid", "n", (F.col("n") - F.col("shared")).alias("own"), "token", place.cast("long").alias("place"))
    return ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * 9 / 10))


def _possible(x: str, y: str) -> Column:
    """Sizes, unshared shingles and places that do not rule a link out."""
    n = {k: F.col(f"{k}.n") for k in (x, y)}
    left = {k: F.col(f"{k}.n") - F.col(f"{k}.place") for k in (x, y)}
    both = n[x] + n[y]
    sizes = (n[x] * 10 >= n[y] * 9) & (n[y] * 10 >= n[x] * 9)
    # an overlap of 9/19 of both sizes leaves 1/19 of them unshared
    alone = (F.col(f"{x}.own") + F.col(f"{y}.own")) * 19 <= both
    return sizes & alone & (F.least(left[x], left[y]) * 19 >= both * 9)


def _agreed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose hashed prefixes share enough under every hashed order."""
    slim = texts.select("cid", "n", "first", "second")
    one = slim.select(*[F.col(c).alias(f"{c}_a") for c in slim.columns])
    two = slim.select(*[F.col(c).alias(f"{c}_b") for c in slim.columns])
    both = pairs.join(one, F.col("a") == F.col("cid_a")).join(two, F.col("b") == F.col("cid_b"))
    least = 1 + F.floor(F.least("n_a", "n_b") / 20)
    kept = F.lit(True)
    for order in ("first", "second"):
        kept = kept & (F.size(F.array_intersect(f"{order}_a", f"{order}_b")) >= least)
    return both.where(kept).select("a", "b")


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    one = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("shingles")
        last, other = None, None
        for batch in batches:
            keep = []
            for i, b in enumerate(batch.column(1).to_pylist()):
                if b != last:  # rows arrive sorted by b where the join sorted them
                    last, other = b, shingle_set(batch.column(3)[i].as_py(), WIDTH)
                own = shingle_set(batch.column(2)[i].as_py(), WIDTH)
                shared = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * shared >= 90 * (len(own) + len(other) - shared):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(confirm, "a long, b long")


def _star(prefix: DataFrame) -> DataFrame:
    """Every class with the class of each of its buckets that has the fewest shingles of its own."""
    hubs = prefix.groupBy("token").agg(F.min(F.struct("own", "cid", "n", "place")).alias("hub"), F.count(F.lit(1)).alias("members"))
    hubs = hubs.where("members > 1").select("token", "hub.*")
    met = prefix.alias("x").join(hubs.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.cid") != F.col("y.cid")) & _possible("x", "y"))
    return met.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()


def _across(prefix: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of classes of different components that share a prefix shingle."""
    named = prefix.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    spread = named.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(
        F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("c", "label")).alias("main"))
    mixed = cut(named.join(spread.where("labels > 1").select("token", "main"), "token"), "mixed")
    x, y = mixed.where("label <> main").alias("x"), mixed.alias("y")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label")) & _possible("x", "y"))
    return met.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id``: the least id its links reach."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = cut(signatures(docs), "signed")
    grouped = signed.where("n_shingles > 0").groupBy("class_key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("first").alias("first"))
    # written once, so the numbers hold in every later use
    classes = cut(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    texts = cut(_texts(docs, classes, cut(_met(classes), "met")), "texts")
    near = broadcast_if_small(cut(_met(texts, "longer", LONGER), "met"), BROADCAST_IDS)
    prefix = cut(rarest_first(texts.join(near, "cid", "left_semi")), "prefixes")
    star = cut(_star(prefix), "pairs")
    links = cut(_linked(_agreed(star, texts), texts), "links")
    labels = components(links)
    seen = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = cut(_linked(_agreed(cut(_across(prefix, labels).join(seen, ["a", "b"], "left_anti"), "pairs"), texts), texts), "links")
    if not more.isEmpty():
        labels = components(links.union(more))
    return _result(signed, classes, labels)


def _result(signed: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    named = classes.select("cid", "class_key", "rep").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = named.join(least, "label").select("class_key", "component_id")
    return signed.select("doc_id", "n_shingles", "class_key").join(found, "class_key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
