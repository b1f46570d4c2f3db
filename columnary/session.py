"""Session helpers: recommended settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


#: Bytes of a method above which HotSpot leaves it to the interpreter.
COMPILED_METHOD = 8_000
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """While it lasts, stages of wide plans whose one generated method the JVM would only
    interpret run operator by operator, in small methods that it compiles. Results are the same."""
    before = spark.conf.get(_METHOD_LIMIT)
    spark.conf.set(_METHOD_LIMIT, str(min(int(before), COMPILED_METHOD)))
    try:
        yield
    finally:
        spark.conf.set(_METHOD_LIMIT, before)


def build_session(app: str = "columnary", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the
    deployment chooses the master and AQE sizes the shuffles.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # one JVM does all the work; takes effect when it is not running yet
            builder = builder.config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def collect_garbage(spark: SparkSession) -> None:
    """Has the driver's JVM give back the heap that finished jobs have filled.

    G1 grows its heap with what is allocated, not with what is held, and returns memory only behind
    a full collection. Loops of hundreds of jobs (forests of many groups) would fill all of it.
    """
    spark.sparkContext._jvm.System.gc()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` wins; a temporary folder is used only where the
    session names none (tests on one machine).
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="columnary-checkpoint-"))
        current = context.getCheckpointDir()
    return current
