"""Row order: ordinals and split points without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import column
from ..session import ensure_checkpoint_dir
from .dataset import ARRIVAL, DOUBLE, LONG, TIME, Dataset
from .ranks import rank_values

_POSITION, _CONTENT, _PLACE = "__position", "__content", "__place"
#: Different keys that one task may sort when a rank is looked up.
NARROW = 100_000


def with_row_id(ds: Dataset) -> DataFrame:
    """All rows with their 0-based ``row_id`` in row order.

    Range partitioning sorts in parallel; a row's id is its place inside its
    partition plus the rows of the partitions before it. Rows with equal keys
    are in order of a hash of their content, so the rows of one key spread over
    as many ranges as they need; equal rows are told apart by their place in the
    scan, which matters to nothing but the ranges. The sorted rows go through a
    checkpoint first: range bounds are sampled, and ids computed against two
    different samplings would clash.
    """
    ensure_checkpoint_dir(ds.spark)
    keys = [*ds.order_columns, F.col(_CONTENT), F.col(_PLACE)]
    content = F.xxhash64(*[ds.value(n) for n in ds.names]) if ds.names else F.lit(0)
    placed = (
        ds.rows.withColumn(_CONTENT, content).withColumn(_PLACE, F.monotonically_increasing_id())
        .repartitionByRange(*keys).sortWithinPartitions(*keys).drop(_CONTENT, _PLACE)
        .withColumn(_POSITION, F.monotonically_increasing_id()).checkpoint()
    )
    part = F.shiftright(F.col(_POSITION), 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("part"), F.coalesce(before, F.lit(0)).alias("before"))  # one row per partition
    joined = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    inside = F.col(_POSITION).bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn("row_id", F.col("before") + inside).drop("part", "before", _POSITION, ARRIVAL)


def _sortable(ds: Dataset, name: str) -> Column | None:
    """A numeric stand-in with the same order, where the type has one."""
    if name == ARRIVAL:
        return F.col(ARRIVAL)
    lane = ds.get(name).lane
    if lane in (LONG, DOUBLE):
        return ds.value(name)
    if lane == TIME:
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, ds.value(name))
    return None


def _after(expr: Column, value: object) -> Column:
    """Whether ``expr`` comes after ``value`` in ascending order, missing values first."""
    return expr.isNotNull() if value is None else F.coalesce(expr > F.lit(value), F.lit(False))


def key_at(rows: DataFrame, keys: list[Column], rank: int) -> tuple:
    """The key of the row at ``rank`` (from 0) in ascending order, for keys of any type.

    Equal keys collapse to one counted row before anything is sorted, so a
    repeated key is no heavier than another. The different keys are spread over
    ranges, the range that holds the rank is spread again, and so on until it
    holds few keys.
    """
    names = [f"k{i}" for i in range(len(keys))]
    ensure_checkpoint_dir(rows.sparkSession)
    inside = rows.select(*[k.alias(n) for k, n in zip(keys, names)]).groupBy(*names).agg(F.count(F.lit(1)).alias("rows"))
    before = 0
    while True:
        placed = inside.repartitionByRange(*names).withColumn("part", F.spark_partition_id()).checkpoint()
        parts = placed.groupBy("part").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("keys")).orderBy("part").collect()  # one row per range
        for part in parts:
            if rank < before + part["rows"]:
                break
            before += part["rows"]
        inside = placed.where(F.col("part") == part["part"]).drop("part")
        if part["keys"] <= NARROW or len(parts) == 1:
            break
    upto = F.sum("rows").over(Window.orderBy(*names)) + before  # one range, narrowed to few keys
    return tuple(inside.withColumn("upto", upto).where(F.col("upto") > rank).orderBy(*names).select(*names).first())


def from_rank(ds: Dataset, rank: int) -> Column:
    """Condition that holds for the rows at ``rank`` and after, in row order.

    Numeric and time keys are selected key column by key column, each time among
    the rows tied so far, and no row is moved. From the first key of another
    type (or with missing values, which come first) on, the key is found by
    sorting the different keys that are left. Keys should be unique together;
    rows with equal keys stay on one side.
    """
    keys = ds.order_by or [ARRIVAL]
    chosen: list[tuple[Column, object]] = []
    rows, left = ds.rows, rank
    for i, key in enumerate(keys):
        stand_in = _sortable(ds, key)
        found = None
        if stand_in is not None:
            count, found = rank_values(rows, {key: stand_in}, lambda n: [(left, left)] if n > left else [])[key]
            if count != rows.count():
                found = None
        if not found:
            rest = [_sortable(ds, k) if _sortable(ds, k) is not None else column(k) for k in keys[i:]]
            chosen += list(zip(rest, key_at(rows, rest, left)))
            break
        value = found[0][0]
        chosen.append((stand_in, value))
        here = stand_in == F.lit(value)
        if i + 1 == len(keys):
            break
        scope = rows.agg(F.count_if(stand_in < F.lit(value)).alias("below"), F.count_if(here).alias("ties")).first()
        left -= scope.below
        if scope.ties == 1:
            break
        rows = rows.where(here)
    condition = F.lit(True)
    for expr, value in reversed(chosen):
        condition = _after(expr, value) | (expr.eqNullSafe(F.lit(value)) & condition)
    return condition
