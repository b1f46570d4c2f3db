"""Deterministic hash cuts: exact-size samples and stratified splits.

A row's place in a sample depends on the hash of its content only (its key and
all supported columns), so the answer survives repartitioning and task retries
and needs no unique key. The cut-off hash per class is found by three small
histograms over the hash bits; rows are never ranked or moved. Where equal rows
lie on the cut-off and only some of them are wanted, those rows alone are
numbered, behind a checkpoint that fixes the numbers: sizes are always exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..vocab import SEED
from .dataset import Dataset

HASH_BITS = 52
#: Hash bits told apart per histogram: at most 2^18 bins of a group meet in one task.
_LEVELS = (18, 18, 16)
_GROUP, _CUT, _PLACE = "__group", "__cut", "__place"


def row_hash(ds: Dataset, seed: int = SEED) -> Column:
    """A uniform integer in [0, 2^52) from the row's key and supported columns."""
    keys = ds.order_columns if ds.order_by else []
    rest = [ds.value(n) for n in ds.names if n not in (ds.order_by or [])]
    return F.shiftrightunsigned(F.xxhash64(*keys, *rest, F.lit(seed)), 64 - HASH_BITS)


def quotas(sizes: dict[str, int], total: int) -> dict[str, int]:
    """Split ``total`` over classes in proportion, by largest remainder."""
    rows = sum(sizes.values())
    exact = {g: total * n / rows for g, n in sizes.items()}
    share = {g: math.floor(v) for g, v in exact.items()}
    order = sorted(sizes, key=lambda g: (-(exact[g] - share[g]), g))
    for g in order[: total - sum(share.values())]:
        share[g] += 1
    return share


def hash_cuts(rows: DataFrame, group: Column, h: Column, wanted: dict[str, int]) -> dict[str, int]:
    """Per group the largest hash that keeps ``wanted[group]`` rows (-1 for none)."""
    return boundary_cuts(rows, group, h, wanted)[0]


def boundary_cuts(rows: DataFrame, group: Column, h: Column, wanted: dict[str, int]) -> tuple[dict[str, int], dict[str, int]]:
    """The cuts per group, and how many rows on the cut are wanted where that is not all of them."""
    need = {g: k for g, k in wanted.items() if k > 0}
    prefix = {g: 0 for g in need}
    part: dict[str, int] = {}
    slim = rows.select(group.alias("g"), h.alias("h"))
    shift = HASH_BITS
    for bits in _LEVELS:
        if not need:
            break
        scope = F.broadcast(rows.sparkSession.createDataFrame([(g, prefix[g], need[g]) for g in need], "g string, p long, need long"))
        here = slim.join(scope, "g").where(F.shiftrightunsigned("h", shift) == F.col("p"))
        shift -= bits
        bins = here.groupBy("g", "need", F.shiftrightunsigned("h", shift).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("g").orderBy("b"))
        hit = bins.withColumn("upto", upto).where("upto >= need").groupBy("g").agg(F.min(F.struct("b", "upto", "n")).alias("s"))
        for r in hit.select("g", "s.*").collect():
            prefix[r.g] = r.b
            need[r.g] -= r.upto - r.n
            if shift == 0 and need[r.g] < r.n:
                part[r.g] = need[r.g]
    return {g: prefix.get(g, -1) for g in wanted}, part


def _with_cut(rows: DataFrame, group: Column, cuts: dict[str, int]) -> DataFrame:
    """``rows`` with the cut of their group (-1 for others): a small table joined, whatever the number of groups."""
    table = rows.sparkSession.createDataFrame(list(cuts.items()), f"{_GROUP} string, {_CUT} long")
    joined = rows.join(F.broadcast(table), group == F.col(_GROUP), "left").drop(_GROUP)  # one row per class
    return joined.withColumn(_CUT, F.coalesce(_CUT, F.lit(-1)))


def split_rows(rows: DataFrame, group: Column, h: Column, wanted: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Exactly ``wanted[group]`` rows of each group, of least hash, and all others."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    cuts, part = boundary_cuts(rows, group, h, wanted)
    cut = _with_cut(rows, group, cuts)
    inside = h <= F.col(_CUT)
    if not part:
        return cut.where(inside).select(*columns), cut.where(~inside).select(*columns)
    ensure_checkpoint_dir(rows.sparkSession)
    torn = _with_cut(rows, group, {g: cuts[g] for g in part})
    tied = torn.where(h == F.col(_CUT)).select(*columns, F.monotonically_increasing_id().alias(_PLACE)).checkpoint()
    # numbers are unique and below 2^52: a cut on them leaves no ties
    places, _ = boundary_cuts(tied, group, F.col(_PLACE), part)
    chosen = _with_cut(tied, group, places)
    first = F.col(_PLACE) <= F.col(_CUT)
    on_cut = _with_cut(rows, group, cuts).join(
        F.broadcast(rows.sparkSession.createDataFrame([(g,) for g in part], f"{_GROUP} string")), group == F.col(_GROUP), "left")
    torn_row = (h == F.col(_CUT)) & F.col(_GROUP).isNotNull()
    return (
        on_cut.where(inside & ~torn_row).select(*columns).unionByName(chosen.where(first).select(*columns)),
        on_cut.where(~inside & ~torn_row).select(*columns).unionByName(chosen.where(~first).select(*columns)),
    )


def sample_rows(ds: Dataset, rows: DataFrame, size: int, sizes: dict[str, int], group: Column, seed: int = SEED) -> DataFrame:
    """Exactly ``size`` rows, stratified by ``group`` (pass one class for none)."""
    if sum(sizes.values()) <= size:
        return rows
    return split_rows(rows, group, row_hash(ds, seed), quotas(sizes, size))[0]


def can_stratify(sizes: dict[str, int]) -> bool:
    return len(sizes) > 1 and min(sizes.values()) >= 2
