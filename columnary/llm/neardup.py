"""Near-duplicate documents: fast similarity sketches, banding, exact links.

Documents are sets of distinct five-word shingles; two are linked when
100 * intersection >= 75 * union, and a component is all that links reach.

1. Equal sets collapse to one class, so copies never meet in a join.
2. A sketch per class (hashed bin placement in rounds until all coordinates are
   filled) gives ``BANDS`` bands of ``ROWS`` coordinates; a pair at similarity
   0.75 misses every band with probability (1 - 0.75^5)^42 = 1.2e-5.
3. Every class is compared with the least class of each of its buckets, on the
   full sets. These links are linear in the rows, never all pairs of a bucket.
4. What such stars can miss lies in buckets that still hold several components.
   The classes of those buckets are compared exactly by a prefix join: shingles
   in order of rising frequency, pairs of different components that share a
   shingle early enough for their sizes and positions to allow a link. Passages
   that many texts share come last in that order, so they make no pairs.
5. Components by least label with pointer jumping, each round a written table.

Defined cases: null or empty text has an empty set and no link; a null id is a
row with null ``component_id`` unless its class has an id; rows with equal ids
or equal texts are kept and share a class where their sets are equal; an empty
table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, ship, take_worker
from .shingles import chunks, mix, shingle_set, similarity_sketch

ROWS, BANDS = 5, 42
#: Ids that may be broadcast to filter texts (a few MB).
BROADCAST_IDS = 300_000
WIDTH = 5


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, class_key, bands`` of every row; key and bands are null for an empty set."""
    spread = np.asarray([(2 * k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1) for k in range(ROWS)], np.uint64)
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("shingles")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                sets = [shingle_set(t, WIDTH) for t in texts[a:b]]
                table = similarity_sketch(sets, ROWS * BANDS).reshape(len(sets), BANDS, ROWS)
                bands = mix((mix(table) * spread).sum(axis=2, dtype=np.uint64) ^ salt).view(np.int64)
                full = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) if f else None for s, f in zip(sets, full)], pa.binary()),
                    pa.array([r if f else None for r, f in zip(bands, full)], pa.list_(pa.int64())),
                ], names=["doc_id", "n_shingles", "class_key", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(build, f"doc_id {kind}, n_shingles long, class_key binary, bands array<long>")


def _class_texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text of each class in ``wanted``: ``class_key, text``."""
    chosen = classes.join(wanted, "class_key", "left_semi").select(F.col("rep").alias("chosen")).distinct()
    # ids are of fixed size where numeric: their number bounds a broadcast, and texts are filtered in place
    chosen = broadcast_if_small(chosen, BROADCAST_IDS) if dict(docs.dtypes)["doc_id"] in ("int", "bigint") else chosen
    found = docs.select("doc_id", "text").join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen")), "left_semi").select("text")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("shingles")
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([_digest(shingle_set(t, WIDTH)) for t in texts], pa.binary()), batch.column(0)], names=["class_key", "text"])

    # ids may repeat with other texts: the key is taken from the text itself
    return found.mapInArrow(key, "class_key binary, text string").dropDuplicates(["class_key"])


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of classes whose full sets are similar enough."""
    one = texts.select(F.col("class_key").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("class_key").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")

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
                if 100 * shared >= 75 * (len(own) + len(other) - shared):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(confirm, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the least node each node of ``edges`` (a, b) can reach.

    Contraction: every node points to its least neighbour, pointers are followed
    a few steps, and edges are drawn anew between what they point to. Edges
    inside one label vanish, so each round works on a fraction of the last.
    """
    rounds: list[DataFrame] = []
    left = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while not rounds or not left.isEmpty():
        ends = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
        tops = left.select(F.col("a").alias("node"), F.col("a").alias("label"))
        # a node without a smaller neighbour points to itself
        points = cut(ends.union(tops).groupBy("node").agg(F.min("label").alias("label")), "labels")
        for _ in range(2):
            further = points.select(F.col("node").alias("label"), F.col("label").alias("further"))
            points = cut(points.join(further, "label").select("node", F.col("further").alias("label")), "labels")
        one = points.select(F.col("node").alias("a"), F.col("label").alias("la"))
        two = points.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        drawn = left.join(one, "a").join(two, "b").where("la <> lb")
        left = cut(drawn.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        rounds.append(points)
    labels = rounds.pop()
    while rounds:
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("final"))
        labels = rounds.pop().join(later, "label", "left").select("node", F.coalesce("final", "label").alias("label"))
    return cut(labels, "labels")


def _rest_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of ``members`` (class_key, label) of different labels that may be linked: exact prefix join."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker("shingles")
        for batch in batches:
            keys, labels = batch.column(0), batch.column(1)
            for i, text in enumerate(batch.column(2).to_pylist()):
                s = shingle_set(text, WIDTH)
                rows = pa.array(np.full(len(s), i, np.int64))
                yield pa.RecordBatch.from_arrays([keys.take(rows), labels.take(rows), pa.array(np.full(len(s), len(s), np.int64)), pa.array(s.view(np.int64))], names=["class_key", "label", "n", "shingle"])

    units = cut(members.join(texts, "class_key").select("class_key", "label", "text").mapInArrow(explode, "class_key binary, label binary, n long, shingle long"), "shingles")
    # how often each shingle occurs, in how many components, and its commonest component
    spread = units.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("shingle").agg(
        F.sum("c").alias("df"), F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("c", "label")).alias("main"))
    known = units.join(spread.where("df > 1"), "shingle")
    own = Window.partitionBy("class_key")  # at most the shingles of one document
    shared = F.count(F.lit(1)).over(own)
    position = F.col("n") - shared + F.row_number().over(own.orderBy("df", "shingle")) - 1
    ranked = known.select("*", position.alias("p"))
    prefix = ranked.where((F.col("labels") > 1) & (F.col("p") <= F.col("n") - F.ceil(F.col("n") * 3 / 4)))
    x, y = prefix.where(F.col("label") != F.col("main")), prefix
    # shingles left from the first shared one on must be enough for the overlap that a link needs
    room = F.least(F.col("x.n") - F.col("x.p"), F.col("y.n") - F.col("y.p")) * 7 >= (F.col("x.n") + F.col("y.n")) * 3
    sizes = (F.col("x.n") * 4 >= F.col("y.n") * 3) & (F.col("y.n") * 4 >= F.col("x.n") * 3)
    met = x.alias("x").join(y.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") != F.col("y.label")) & sizes & room)
    return met.select(F.least("x.class_key", "y.class_key").alias("a"), F.greatest("x.class_key", "y.class_key").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id, kept``; ``kept`` marks the least id of each component."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = cut(sketches(docs), "sketches")
    classes = cut(signed.where("n_shingles > 0").groupBy("class_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    reps = classes.select("class_key", "rep")
    bands = classes.select("class_key", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.min("class_key").alias("b"), F.count(F.lit(1)).alias("members")).where("members > 1").select("band", "b")
    crowded = cut(bands.join(buckets, "band"), "buckets")
    star = cut(crowded.where("class_key <> b").select(F.col("class_key").alias("a"), "b").distinct(), "pairs")
    texts = cut(_class_texts(docs, reps, crowded.select("class_key").distinct()), "texts")
    links = cut(linked(star, texts), "links")
    first = components(links)
    named = crowded.select("band", "class_key").join(first.withColumnRenamed("node", "class_key"), "class_key", "left").withColumn("label", F.coalesce("label", "class_key"))
    mixed = named.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band")
    members = cut(named.join(mixed, "band", "left_semi").select("class_key", "label").distinct(), "members")
    more = cut(linked(_rest_pairs(members, texts), texts), "links")
    labels = components(links.union(more)) if not more.isEmpty() else first
    return _result(signed, reps, labels)


def _result(signed: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    least = reps.join(labels.withColumnRenamed("node", "class_key"), "class_key", "left").withColumn("label", F.coalesce("label", "class_key"))
    named = least.join(least.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("class_key", "component_id")
    found: Column = F.coalesce("component_id", "doc_id")
    return signed.select("doc_id", "n_shingles", "class_key").join(named, "class_key", "left").select(
        "doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``: the least id's; columns as they are.

    Ids tell rows apart: rows that share the kept id stay together. Rows without
    shingles are linked with nothing and stay.
    """
    found = near_duplicates(docs)
    gone = found.where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    gone = broadcast_if_small(cut(gone, "gone"), BROADCAST_IDS) if dict(docs.dtypes)["doc_id"] in ("int", "bigint") else cut(gone, "gone")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")
