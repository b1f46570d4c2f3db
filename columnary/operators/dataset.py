"""The table under analysis: typed columns, row order, per-column memory.

Operators never look at data rows on the driver. What they do keep on the
driver is per-column facts - one row per column, a few numbers each - because
the next plan (which pairs to correlate, which columns to bin) depends on them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import column, double_text, parse_number
from ..session import ensure_checkpoint_dir
from ..vocab import MISSING_LABEL

LONG, DOUBLE, TEXT, BOOL, TIME = "long", "double", "text", "bool", "time"

#: Largest table that may be pinned on the driver (per-column facts only).
PIN_ROWS = 500_000
#: Tables the optimizer estimates below this are spread over the cores and kept.
SMALL_BYTES = 128 * 1024 * 1024
#: Most files whose places are sent to all tasks; beyond it they are joined by a shuffle.
BROADCAST_FILES = 200_000
ARRIVAL = "__arrival"
_FILE, _ROW = "__file", "__row"


def pin(df: DataFrame) -> DataFrame:
    """Evaluate a *small* result once and carry on from its values.

    For per-column, per-bin, per-pair tables whose size depends on the width of
    the data, never on its row count; the bound is checked before collecting.
    """
    table = df.limit(PIN_ROWS + 1).toArrow()
    if table.num_rows > PIN_ROWS:
        raise ValueError(f"refusing to pin more than {PIN_ROWS} rows on the driver")
    return local_table(df.sparkSession, table, df.schema)


def local_table(spark: SparkSession, table: pa.Table, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame(table, schema=schema)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _numbers_rows(rows: DataFrame) -> bool:
    """Whether the rows come straight from files whose reader numbers them."""
    hidden = rows._jdf.queryExecution().analyzed().metadataOutput()
    kinds = [hidden.apply(i) for i in range(hidden.size())]
    return any(a.name() == "_metadata" and "row_index" in a.dataType().simpleString() for a in kinds) and "_metadata" not in rows.columns


def file_order(rows: DataFrame) -> DataFrame:
    """``rows`` with their number in file order, where a scan tells it; no row is moved.

    The rows per file are counted once, from the row numbers that the reader
    makes up, and each file gets the number its first row has.
    """
    if not _numbers_rows(rows):
        return rows.withColumn(ARRIVAL, F.monotonically_increasing_id())
    placed = rows.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_ROW))
    ensure_checkpoint_dir(rows.sparkSession)
    sizes = placed.groupBy(_FILE).agg((F.max(_ROW) + 1).alias("size"))
    before = F.sum("size").over(Window.orderBy(_FILE).rowsBetween(Window.unboundedPreceding, -1))
    files = sizes.select(F.col(_FILE).alias("__path"), F.coalesce(before, F.lit(0)).alias("__before")).checkpoint()  # one row per file
    files = F.broadcast(files) if files.count() <= BROADCAST_FILES else files
    numbered = placed.join(files, F.col(_FILE) == F.col("__path"))
    return numbered.withColumn(ARRIVAL, F.col("__before") + F.col(_ROW)).drop(_FILE, _ROW, "__path", "__before")


def lane_of(data_type: T.DataType) -> str | None:
    """Which of the five value lanes a Spark type belongs to, if any."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return LONG
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return DOUBLE
    if isinstance(data_type, T.BooleanType):
        return BOOL
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TIME
    return None


@dataclass(frozen=True)
class Field:
    ordinal: int
    name: str
    lane: str
    #: Decimals are counted by their exact value and only measured as doubles.
    exact: bool = False


@dataclass
class Dataset:
    """A DataFrame prepared for profiling.

    ``order_by`` names the columns that define row order; it should identify a
    row. Without it, rows of Parquet files are in order of file path and place
    in the file, the same in every read; rows of other sources are in the order
    in which one scan delivers them.
    """

    source: DataFrame
    name: str = "dataset"
    order_by: list[str] | None = None
    semantic_rules: str = "reference"
    encoding: str | None = None
    hold: bool = True
    _memory: dict = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        if self.semantic_rules not in ("reference", "strict"):
            raise ValueError("semantic_rules must be 'reference' or 'strict'")
        missing = [k for k in self.order_by or [] if k not in self.source.columns]
        if missing:
            raise ValueError(f"order_by names unknown columns: {missing}")
        self.fields: list[Field] = []
        self.unsupported: list[tuple[str, str]] = []
        for item in self.source.schema.fields:
            if item.name == ARRIVAL:
                continue
            lane = lane_of(item.dataType)
            if lane is None:
                self.unsupported.append((item.name, item.dataType.simpleString()))
            else:
                self.fields.append(Field(len(self.fields), item.name, lane, isinstance(item.dataType, T.DecimalType)))

        self.rows = self._prepare()

    def _prepare(self) -> DataFrame:
        """The rows the operators scan.

        The reports read the table several times. A table that is small by the
        optimizer's own estimate is spread over the cores and persisted; a
        larger one is rescanned, column-pruned, every time.
        """
        rows = self.source
        if not self.order_by and ARRIVAL not in rows.columns:
            rows = file_order(rows)
        if self.hold and estimated_bytes(self.source) <= SMALL_BYTES:
            parallelism = self.spark.sparkContext.defaultParallelism
            # by row key: unlike round robin this needs no sort to be repeatable
            keys = [column(k) for k in self.order_by] if self.order_by else [F.col(ARRIVAL)]
            rows = rows.repartition(parallelism, *keys).persist(StorageLevel.MEMORY_AND_DISK)
        return rows

    def release(self) -> None:
        """Drop the kept copy of a small table."""
        self.rows.unpersist()

    # -- memory of per-column facts -----------------------------------------
    def remember(self, key, build):
        if key not in self._memory:
            self._memory[key] = build()
        return self._memory[key]

    # -- columns -------------------------------------------------------------
    @property
    def spark(self) -> SparkSession:
        return self.source.sparkSession

    @property
    def all_columns(self) -> list[str]:
        return [c for c in self.source.columns if c != ARRIVAL]

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def within(self, rows: DataFrame) -> Dataset:
        """The same table restricted to some of its rows, facts to be found anew."""
        return Dataset(rows, self.name, self.order_by, self.semantic_rules, self.encoding, hold=False)

    def get(self, name: str) -> Field:
        for item in self.fields:
            if item.name == name:
                return item
        raise KeyError(name)

    def value(self, name: str) -> Column:
        """The column in its lane type, with NaN read as missing."""
        lane, raw = self.get(name).lane, column(name)
        if lane == LONG:
            return raw.cast("long")
        if lane == DOUBLE:
            wide = raw.cast("double")
            return F.when(~F.isnan(wide), wide)
        if lane == TIME:
            return raw.cast("timestamp_ntz")
        if lane == TEXT:
            return raw.cast("string")
        return raw

    def key(self, name: str) -> Column:
        """The value to group by: like ``value``, but exact for decimals."""
        return column(name) if self.get(name).exact else self.value(name)

    def text(self, name: str) -> Column:
        """The value as text, the way it would read in a CSV cell."""
        lane, value = self.get(name).lane, self.value(name)
        if lane == DOUBLE:
            return double_text(value)
        if lane == BOOL:
            return F.when(value, "True").when(~value, "False")
        return value.cast("string")

    def number(self, name: str) -> Column:
        """The value as a double; text that is not a number becomes NULL."""
        lane, value = self.get(name).lane, self.value(name)
        if lane == TEXT:
            return parse_number(value)
        if lane == BOOL:
            return value.cast("int").cast("double")
        if lane == TIME:
            raise ValueError(f"{name} is a time column")
        return value.cast("double")

    def labelled(self, name: str) -> Column:
        return F.coalesce(self.text(name), F.lit(MISSING_LABEL))

    @property
    def order_columns(self) -> list[Column]:
        if self.order_by:
            return [column(k) for k in self.order_by]
        return [F.col(ARRIVAL)]

    @property
    def row_count(self) -> int:
        return self.remember("row_count", self.rows.count)

    def unsupported_columns(self) -> DataFrame:
        """Columns whose type has no profile (arrays, maps, structs, binary)."""
        rows = [(n, t) for n, t in self.unsupported]
        return self.spark.createDataFrame(rows, "name string, data_type string")
