"""Shared helpers: durable intermediate tables, words, size-checked broadcasts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every operator of this package.
SPACES = "[\\x20\\x09-\\x0D]+"
#: Largest table (rows) handed to an explicit broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000
#: Settings of Arrow batches: name, Spark's value, the value for rows of text.
ARROW = (
    ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"),
    ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b"),
)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master without that setting gets a folder of its own (tests).
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="columnary-llm-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per session.

    Functions run in tasks are imported there by name; a cluster whose
    executors have the package installed gets the same code twice, no more.
    Arrow batches that the session leaves at Spark's size are made smaller:
    texts are long rows, and a task holds a batch several times over.
    """
    context = spark.sparkContext
    for name, usual, ours in ARROW:
        if spark.conf.get(name) == usual:
            spark.conf.set(name, ours)
    if getattr(context, "_columnary_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="columnary-code-"), "columnary-code"), "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    context._columnary_shipped = True


#: What each operator keeps in a Python worker between tasks, and how to drop it.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(owner: str, drop: Callable[[], None]) -> None:
    _KEPT[owner] = drop


def take_worker(owner: str) -> None:
    """Called in a task: drops what other operators keep in this worker, so that
    a worker that serves many stages holds the memory of one."""
    for other, drop in _KEPT.items():
        if other != owner:
            drop()
    pa.default_memory_pool().release_unused()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage at a durable table: lost executors cost no recomputation
    of what came before, and a value computed once is the same in every use.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than needed."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for a broadcast only when its row count is proven small."""
    return F.broadcast(df) if small(df, limit) else df


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Words of ``text``: maximal runs without white space; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")
