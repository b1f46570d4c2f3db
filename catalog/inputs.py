"""Input tables of the registered queries, derived from the test tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from columnary import Dataset

ORDER = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "dirty": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"],
    "orders": ["o_orderkey"],
    "late": ["o_orderkey"],
    "customer_by_name": ["c_name"],
    "gaps": ["day_code", "o_orderkey"],
    "wide": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"],
    "wide_gaps": ["l_orderkey"],
    "exact": None,
    "order_pairs": None,
    "customer": ["c_custkey"],
    "part": ["p_partkey"],
    "supplier": ["s_suppkey"],
    "events": ["ts", "event_id"],
    "documents": ["doc_id"],
    "conversations": ["conv_id", "turn"],
    "embeddings": ["vec_id"],
}

#: Line items with gaps, dirty numbers, constants, codes, flags and date texts.
DIRTY = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
       CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS order_quantity,
       CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS discount_rate,
       l_extendedprice * (1 - l_discount) AS net_price,
       CASE WHEN l_orderkey % 97 = 0 THEN l_quantity * 100 ELSE l_quantity END AS spike,
       CASE WHEN l_linenumber > 4 THEN concat('x', CAST(CAST(l_quantity AS INT) AS {text})) ELSE CAST(CAST(l_quantity AS INT) AS {text}) END AS mixed,
       'k' AS const,
       CASE WHEN l_orderkey % 50 = 0 THEN 'rare' ELSE 'common' END AS near_const,
       concat('C', CAST(l_orderkey AS {text}), '-', CAST(l_partkey AS {text}), '-', CAST(l_linenumber AS {text})) AS order_code,
       CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE l_returnflag END AS return_status,
       l_linestatus = 'O' AS is_open,
       CASE WHEN l_linenumber > 4 THEN 'high' WHEN l_linenumber > 2 THEN 'medium' ELSE 'low' END AS priority,
       {slash_date} AS ship_text
FROM lineitem
"""

#: Orders whose first values are on a scale and later ones are not.
LATE = """
SELECT o_orderkey, CASE WHEN o_orderkey > 200 THEN concat('zone ', CAST(o_orderkey % 50 AS {text})) WHEN o_orderkey % 2 = 0 THEN 'low' ELSE 'high' END AS grade,
       CASE WHEN o_orderkey % 3 = 0 THEN 'small' WHEN o_orderkey % 3 = 1 THEN 'medium' ELSE 'large' END AS parcel,
       CASE WHEN o_orderkey > 200 THEN concat('p', CAST(o_orderkey AS {text})) ELSE concat('user', CAST(o_orderkey AS {text}), '@mail.org') END AS contact_text
FROM orders
"""
#: Orders whose leading order key is a text with gaps.
GAPS = """
SELECT CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE concat('d', CAST(o_custkey % 7 AS {text})) END AS day_code, o_orderkey, o_totalprice, o_custkey, o_orderstatus
FROM orders
"""
#: Line items with many derived numbers.
WIDE_COLUMNS = 40
WIDE_TABLE = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, " + ", ".join(
    f"l_quantity * {i % 7} + (l_orderkey * {i + 3}) % {97 + i} + l_tax * {i * i} AS w{i:02d}" for i in range(WIDE_COLUMNS)) + " FROM lineitem"
#: Sixty columns with gaps of their own, one without any and one that is missing everywhere.
GAPPED = [f"g{i:02d}" for i in range(60)]
WIDE_GAPS_TABLE = "SELECT l_orderkey, " + ", ".join(
    f"CASE WHEN (l_orderkey + l_linenumber) % {i % 11 + 2} <> {i % 3} THEN l_quantity * {i % 5} + (l_partkey * {i + 3}) % {53 + i} END AS {n}" for i, n in enumerate(GAPPED)
) + ", CASE WHEN l_orderkey < 0 THEN l_tax END AS nothing FROM lineitem"
#: A tenth below zero, seven tenths at zero, then a gap.
BAND_GAP = "CASE WHEN o_orderkey % 10 = 0 THEN -5.0D - o_orderkey % 3 WHEN o_orderkey % 10 < 8 THEN 0.0D ELSE 1.0D + o_orderkey % 2 END"
#: Prices whose exact values differ in digits that doubles do not hold.
EXACT = """
SELECT CAST(12345678901234567 AS DECIMAL(30, 2)) + CAST((l_linenumber % 4) / 100.0 AS DECIMAL(30, 2)) AS exact_amount, l_returnflag
FROM lineitem
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "dirty":
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        body = DIRTY.format(text="STRING", slash_date="date_format(l_shipdate, 'yyyy/MM/dd')")
        return spark.sql(body.replace("FROM lineitem", "FROM {lines}"), lines=lines)
    if name == "late":
        return spark.sql(LATE.format(text="STRING").replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    if name == "customer_by_name":
        return spark.read.parquet(f"{sf_dir}/customer.parquet")
    if name == "gaps":
        return spark.sql(GAPS.format(text="STRING").replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    if name == "wide":
        return spark.sql(WIDE_TABLE.replace("FROM lineitem", "FROM {lines}"), lines=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    if name == "wide_gaps":
        return spark.sql(WIDE_GAPS_TABLE.replace("FROM lineitem", "FROM {lines}"), lines=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    if name == "exact":
        return spark.sql(EXACT.replace("FROM lineitem", "FROM {lines}"), lines=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    if name == "order_pairs":
        return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderstatus", "o_orderpriority")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shared: dict = {}


def dataset(spark: SparkSession, sf_dir: str, name: str, fresh: bool = False) -> Dataset:
    """A dataset over a test table. Queries of one session share its facts, as
    the sections of a report do; ``fresh`` starts from nothing."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if fresh or key not in _shared:
        made = Dataset(table(spark, sf_dir, name), name, ORDER[name])
        if fresh:
            return made
        _shared[key] = made
    return _shared[key]


def forget() -> None:
    _shared.clear()


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule-made two-class prediction over line items."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "yes").otherwise("no").alias("actual"),
        F.when(q > 25, "yes").otherwise("no").alias("prediction"),
        (F.col("l_returnflag") == "R").alias("positive"),
        (q / 50.0).alias("score"),
    )


def multi_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule-made three-class prediction over line items."""
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("actual"), F.when(n <= 2, "A").when(n <= 5, "N").otherwise("Z").alias("prediction")
    )


def wide_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule-made prediction of one class per part."""
    part = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(part.cast("string").alias("actual"), F.when(F.col("l_linenumber") <= 3, part).otherwise(part + 1).cast("string").alias("prediction"))


def value_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule-made regression over line items."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 2000.0 + F.col("l_discount") * 1000.0).alias("prediction")
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A runs table: one run per customer."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").cast("long").alias("user_id"),
        F.col("c_name").alias("display_name"),
        F.concat(F.lower("c_mktsegment"), F.lit(".csv")).alias("source_filename"),
        F.when(F.col("c_acctbal") < 0, "failed").otherwise("completed").alias("status"),
        F.struct(F.col("c_name").alias("dataset_name"), F.col("c_custkey").alias("row_count")).alias("overview"),
        F.struct(F.concat(F.lit("Segment "), F.col("c_mktsegment")).alias("summary"), (F.col("c_acctbal") > 2000).alias("is_ready")).alias("insights"),
    )


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An experiments table: one experiment per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("analysis_id"),
        F.format_string("exp_%08d", F.col("o_orderkey")).alias("experiment_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "unsupervised").otherwise("supervised").alias("experiment_type"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
        F.concat(F.lit("Status "), F.col("o_orderstatus")).alias("summary"),
    )


def deleted_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tombstones: experiments of finished orders."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("analysis_id"), F.format_string("exp_%08d", F.col("o_orderkey")).alias("experiment_id")
    )
