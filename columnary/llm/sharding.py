"""Sharding: best-fit decreasing of indivisible groups into fixed-capacity shards.

Rows with equal texts form a group that stays together. Groups of falling size
enter the shard with the tightest remaining capacity that holds them, found in a
balanced search tree; what fits nowhere enters the emptiest shard. The capacity
is an equal share of all bytes, so the shards are as few as can hold them.

At scale the packing has two levels. Groups of at least a 1/``FINE`` part of a
shard (there cannot be more than shards times ``FINE`` of them) are packed first,
in one task. All others are dealt by hash into cells of about ``CELL_GROUPS``
groups; each cell is packed alone, into its part of what the large groups left,
and since it ends with the smallest texts it fills every shard evenly.

A group larger than a whole shard cannot stay together under near-equal shards:
it is dealt by the hash of the row into the fewest parts that fit.

Defined cases: a null text is a text of its own kind without bytes; empty texts
form one group; a null id is a row like others; repeated rows each take a slot;
an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship

#: Bytes that a row takes besides its text.
ROW_BYTES = 8
FINE, CELL_GROUPS = 64, 2_000
#: Parts of a shard that are numbered alone; they bound what one task sorts.
SLOT_PARTS = 64


def best_fit_decreasing(sizes: np.ndarray, room: list[int]) -> np.ndarray:
    """Bin of every size; ``room`` holds the bins' capacities and may be overdrawn at the end."""
    order = sorted((r, b) for b, r in enumerate(room))
    out = np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(order, (size, -1))
        left, b = order.pop(at if at < len(order) else -1)
        out[i] = b
        insort(order, (left - size, b))
    return out


def _assigned(units: DataFrame, room: list[int], cells: int) -> DataFrame:
    """``digest, part, shard`` of all units (digest, part, bytes, cell); each cell has its share of ``room``."""
    total = max(1, sum(max(0, r) for r in room))

    def fit(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["bytes", "digest", "part"], ascending=[False, True, True], kind="stable")
        sizes = cell["bytes"].to_numpy(np.int64)
        held = int(sizes.sum())
        turn = int(cell["cell"].iloc[0])
        share = [-(-held * max(0, r) // total) for r in room] if cells else list(room)
        # the odd bytes of the cells fall to other shards each time
        share = share[turn % len(room):] + share[: turn % len(room)]
        bins = (best_fit_decreasing(sizes, share) + turn) % len(room)
        return pd.DataFrame({"digest": cell["digest"], "part": cell["part"], "shard": bins.astype("int32")})

    return units.groupBy("cell").applyInPandas(fit, "digest binary, part int, shard int")


def shard_documents(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id, size, text_crc32, shard, slot``; slots are gapless from 0 in each shard."""
    ship(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = cut(own.select(
        "doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.unhex(F.coalesce(F.sha2("text", 256), F.lit("00"))).alias("digest"),
    ), "shard-rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    whole = groups.agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    capacity = max(1, -(-(whole.bytes or 0) // shards))
    # at most as many groups as shards can be larger than one
    giants = groups.where(F.col("bytes") > capacity).select("digest", F.ceil(F.col("bytes") / capacity).cast("int").alias("parts"))
    spot = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("parts"))).cast("int")
    placed = rows.join(F.broadcast(giants), "digest", "left").withColumn("part", spot).drop("parts")
    units = cut(placed.groupBy("digest", "part").agg(F.sum("size").alias("bytes")), "shard-units")
    fine = max(1, capacity // FINE)
    cells = max(1, whole.n // CELL_GROUPS)
    large = units.where(F.col("bytes") >= fine).withColumn("cell", F.lit(0))
    first = cut(_assigned(large, [capacity] * shards, 0), "shard-large")
    taken = {r["shard"]: r["bytes"] for r in first.join(large, ["digest", "part"]).groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    small = units.where(F.col("bytes") < fine).withColumn("cell", F.pmod(F.xxhash64("digest", F.lit(11)), F.lit(cells)).cast("int"))
    rest = _assigned(small, [capacity - taken.get(s, 0) for s in range(shards)], cells)
    homes = cut(first.unionByName(rest), "shard-homes")
    named = cut(placed.join(homes, ["digest", "part"]).select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(13)), F.lit(SLOT_PARTS)).cast("int").alias("lane")), "shard-named")
    lanes = named.groupBy("shard", "lane").agg(F.count(F.lit(1)).alias("n"))  # at most shards times SLOT_PARTS rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = lanes.select("shard", "lane", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "lane").orderBy("doc_id", "text_crc32")) - 1
    return named.withColumn("inside", inside).join(F.broadcast(offsets), ["shard", "lane"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot"))
