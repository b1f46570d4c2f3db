"""Unsupervised scan: clusters, anomalies and a two-dimensional projection."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import column, rounded
from .dataset import DOUBLE, LONG, Dataset, pin
from .features import impute_and_scale, variances
from .isolation import grow_forest, score_rows
from .ranks import exact_quantiles
from .sampling import HASH_BITS, row_hash, sample_rows
from .tally import column_facts

ALL = "all"
#: Rows of a scan that one task holds. A kept part that another executor reads passes whole through its memory beside the heap.
PART_ROWS = 200_000


def scan_features(ds: Dataset, limit: int | None = None) -> tuple[list[str], int]:
    """Numeric columns that hold values: all, or the ``limit`` of widest variance, widest first."""
    filled = {r["name"] for r in column_facts(ds).where("non_null > 0").collect()}
    names = [f.name for f in ds.fields if f.lane in (LONG, DOUBLE) and f.name in filled]
    if limit is None or len(names) <= limit:
        return names, len(names)
    v = variances(ds, names)
    return sorted(names, key=lambda n: (-v[n], ds.get(n).ordinal))[:limit], len(names)


def scan_features_table(ds: Dataset) -> DataFrame:
    names, _ = scan_features(ds)
    v = variances(ds, names)
    return ds.spark.createDataFrame([(n, v[n]) for n in names], "feature string, variance double")


def scaled(ds: Dataset, rows: DataFrame, names: list[str]) -> Column:
    """Standardised features as an array, missing values at the median."""
    medians, centres = impute_and_scale(ds, rows, names)
    return F.array(*[
        (F.coalesce(ds.number(n), F.lit(float(medians[n]))) - centres[n][0]) / centres[n][1] for n in names if n in medians
    ])


@dataclass
class Scan:
    """Result tables of one unsupervised run."""

    cluster_count: int
    features: list[str]
    rows_available: int
    rows_scanned: int
    rows: DataFrame
    explained_variance: list[float]
    warnings: DataFrame
    ds: Dataset | None = None

    def cluster_distribution(self) -> DataFrame:
        """Cluster sizes with their share, largest first."""
        counts = self.rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("count"))
        share = F.col("count") / F.sum("count").over(Window.partitionBy())  # at most eight rows
        return counts.withColumn("share", share).orderBy(F.desc("count"), "cluster")

    def anomaly_count(self) -> DataFrame:
        return self.rows.agg(F.count_if("anomaly_flag").alias("anomaly_count"))

    def preview(self, limit: int = vocab.SCAN_PREVIEW_ROWS) -> DataFrame:
        """A fixed pseudo-random sample of scored rows with their features as ``record`` and,
        from 1, their ``row`` in the table."""
        keys = [c for c in self.rows.columns if c.startswith("key_")]
        shown = self.rows.orderBy(F.xxhash64(*keys, F.lit(vocab.SEED)), *keys).limit(limit)
        if self.ds is None:
            return shown.orderBy(*keys)
        shown = pin(shown)
        order = shown.agg(F.sort_array(F.collect_set(F.struct(*keys))).alias("shown_keys"))  # one row
        own = F.struct(*[k.alias(f"key_{i}") for i, k in enumerate(self.ds.order_columns)])
        # rows between two shown keys are counted, no row is sorted; the array holds ``limit`` keys
        ahead = self.ds.rows.select(own.alias("own")).join(F.broadcast(order), how="cross").select(F.size(F.filter("shown_keys", lambda k: k <= F.col("own"))).alias("gap"))
        counts = ahead.groupBy("gap").agg(F.count(F.lit(1)).alias("n"))
        place = F.sum("n").over(Window.orderBy("gap")) + 1  # at most ``limit`` + 1 gaps
        starts = counts.withColumn("row", place).select((F.col("gap") + 1).alias("position"), "row")
        listed = order.select(F.posexplode("shown_keys").alias("position", "own")).select((F.col("position") + 1).alias("position"), "own.*")
        first = listed.join(starts, "position", "left").withColumn("row", F.coalesce("row", F.lit(1).cast("long"))).drop("position")
        on = [F.col(f"shown.{k}").eqNullSafe(F.col(f"first.{k}")) for k in keys]
        return shown.alias("shown").join(F.broadcast(first.alias("first")), on).select("first.row", "shown.*").orderBy("row")

    def top_anomalies(self, limit: int = 6) -> DataFrame:
        return top_anomalies(self.rows, limit)


def top_anomalies(rows: DataFrame, limit: int = 6) -> DataFrame:
    """The oddest rows with their severity on a 0-1 scale (1 = oddest shown)."""
    keys = [c for c in rows.columns if c.startswith("key_")]
    odd = rows.orderBy("anomaly_score", *keys).limit(limit)
    everything = Window.partitionBy()  # ``limit`` rows
    low, high = F.min("anomaly_score").over(everything), F.max("anomaly_score").over(everything)
    severity = F.when(high == low, 1.0).otherwise(F.try_divide(high - F.col("anomaly_score"), high - low))
    return odd.select(*odd.columns, severity.alias("severity"))


def unsupervised_scan(ds: Dataset, n_clusters: int = 3, max_rows: int | None = None, contamination: float = vocab.CONTAMINATION) -> Scan:
    """Cluster, isolate and project every row (or an exact-size hash sample)."""
    names, offered = scan_features(ds)
    if len(names) < 2:
        raise ValueError("Unsupervised analysis requires at least two numeric columns.")
    available = ds.row_count
    if available < 10:
        raise ValueError("Unsupervised analysis requires at least 10 rows.")
    rows, used = ds.rows, available
    if max_rows is not None and available > max_rows:
        rows, used = sample_rows(ds, rows, max_rows, {ALL: available}, F.lit(ALL)), max_rows
    features = array_to_vector(scaled(ds, rows, names)).alias("features")
    if used > PART_ROWS * ds.spark.sparkContext.defaultParallelism:  # vectors are many times larger than the file parts they come from
        rows = rows.repartition(math.ceil(used / PART_ROWS))
    order = ds.order_by or [c for c in ds.rows.columns if c not in ds.all_columns]
    # the raw values and the order tell rows apart; scaled values differ in their last digits from run to run
    place = F.shiftrightunsigned(F.xxhash64(row_hash(ds), *ds.order_columns), 64 - HASH_BITS).alias("place")
    record = F.struct(*[column(n) for n in names]).alias("record")
    vectors = rows.select(*[F.col("`" + k + "`").alias(f"key_{i}") for i, k in enumerate(order)], place, record, features).persist(StorageLevel.MEMORY_AND_DISK)
    arrays = vector_to_array("features").alias("x")  # not kept a second time

    k = max(2, min(int(n_clusters), used - 1, 8))
    clusters = KMeans(k=k, seed=vocab.SEED, featuresCol="features", predictionCol="label").fit(vectors)
    pca = PCA(k=2, inputCol="features", outputCol="projected").fit(vectors)
    # the sign of a component is free: make its largest loading positive
    loadings = pca.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    forest = pin(grow_forest(vectors.select("place", arrays), used)).toPandas()
    scored = score_rows(pca.transform(clusters.transform(vectors)).withColumn("x", arrays), forest, min(vocab.ISOLATION_SAMPLE, used))
    points = vector_to_array("projected")
    flat = scored.select(
        *[f"key_{i}" for i in range(len(order))], "label", "raw_score", "record",
        (points[0] * signs[0]).alias("pc1"), (points[1] * signs[1]).alias("pc2"),
    ).persist(StorageLevel.MEMORY_AND_DISK)
    offset = exact_quantiles(flat, {"s": F.col("raw_score")}, [contamination])["s"][0]
    sizes = flat.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").collect()
    vectors.unpersist()  # ``flat`` is complete and can be recomputed from the source
    renamed = F.create_map(*[F.lit(v) for i, r in enumerate(sizes) for v in (r.label, i)])
    keys = [c for c in flat.columns if c.startswith("key_")]
    decision = F.col("raw_score") - F.lit(offset)
    out = flat.select(
        *keys, F.element_at(renamed, F.col("label")).alias("cluster"), (decision < 0).alias("anomaly_flag"),
        rounded(decision, 6).alias("anomaly_score"), rounded("pc1", 6).alias("pc1"), rounded("pc2", 6).alias("pc2"), "record",
    )
    notes = ds.spark.createDataFrame([(used, available, len(names), offered)], "used long, available long, kept int, offered int")
    return Scan(k, names, available, used, out, [float(v) for v in pca.explainedVariance], scan_warnings(notes), ds)


def scan_warnings(run: DataFrame) -> DataFrame:
    """Sampling notes of a scan: ``position, text``."""
    lines = F.array_compact(F.array(
        F.when(F.col("available") > F.col("used"), F.concat(
            F.lit("Used a representative sample of "), F.format_number("used", 0), F.lit(" rows from "), F.format_number("available", 0),
            F.lit(" available rows to keep the unsupervised scan responsive."))),
        F.when(F.col("offered") > F.col("kept"), F.concat(
            F.lit("Used the "), F.col("kept").cast("string"), F.lit(" highest-variance numeric columns out of "), F.col("offered").cast("string"),
            F.lit(" available to keep the scan stable on smaller deployments."))),
    ))
    return run.select(F.posexplode(lines).alias("position", "text"))


def retained_variance(scan: Scan) -> float:
    return sum(scan.explained_variance) * 100.0
