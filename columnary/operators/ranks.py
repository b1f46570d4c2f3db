"""Exact order statistics without a global sort.

To find the value at a given rank, a mergeable quantile sketch first brackets it
(one scan, no shuffle of data), a second scan counts what lies below and inside
the bracket, and only the rows inside - a few in ten thousand - are grouped and
ranked. The counts prove the bracket right; if the sketch missed, or the bracket
still holds too much, the next round sketches inside the bracket alone. The
result is exact at any size, and no task ever holds more than ``INSIDE`` distinct
values of a bracket.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sketch accuracy for small and for large brackets.
COARSE, FINE = 1_000, 10_000
FINE_FROM = 20_000_000
INSIDE = 1_000_000
#: Columns searched together.
PASS_KEYS = 40
MAX_ROUNDS = 8


@dataclass
class _Target:
    key: object
    expr: Column
    low_rank: int
    high_rank: int
    low: float
    high: float
    below: int
    inside: int

    def settled(self) -> bool:
        return self.low == self.high


def rank_values(df: DataFrame, exprs: dict, wanted, inside: int = INSIDE, known: dict | None = None) -> dict:
    """Values at ranks: ``{key: (count, [(v_low, v_high), ...])}``.

    ``exprs`` maps a key to a sortable expression (NULLs ignored); ``wanted(n)``
    gives the (low, high) 0-based rank pairs to fetch for a column of n values.
    ``known`` may bring count, minimum and maximum from an earlier pass.
    """
    if not exprs:
        return {}
    keys = list(exprs)
    if len(keys) > PASS_KEYS:  # wide tables: several passes of bounded plan size
        answer = {}
        for start in range(0, len(keys), PASS_KEYS):
            answer.update(rank_values(df, {k: exprs[k] for k in keys[start : start + PASS_KEYS]}, wanted, inside, known))
        return answer
    spans = dict(known or {})
    todo = [k for k in keys if k not in spans]
    if todo:
        first = df.agg(
            *[e for i, k in enumerate(todo) for e in (
                F.count(exprs[k]).alias(f"n{i}"), F.min(exprs[k]).alias(f"lo{i}"), F.max(exprs[k]).alias(f"hi{i}"),
            )]
        ).first()
        spans.update({k: (first[f"n{i}"], first[f"lo{i}"], first[f"hi{i}"]) for i, k in enumerate(todo)})
    counts = {k: spans[k][0] for k in keys}
    targets: list[_Target] = []
    slots: dict = {k: [] for k in keys}
    for k in keys:
        if counts[k] == 0:
            continue
        for low, high in wanted(counts[k]):
            t = _Target(k, exprs[k], low, high, spans[k][1], spans[k][2], 0, counts[k])
            targets.append(t)
            slots[k].append(t)

    open_targets = [t for t in targets if not t.settled()]
    for round_no in range(MAX_ROUNDS):
        if not open_targets:
            break
        before = {id(t): t.inside for t in open_targets}
        _narrow(df, open_targets)
        # a bracket that stops shrinking holds few distinct values: group it
        open_targets = [
            t for t in open_targets
            if not t.settled() and t.inside > inside and t.inside < before[id(t)]
        ]
    picked = _pick(df, [t for t in targets if not t.settled()])
    answer = {}
    for k in keys:
        pairs = []
        for t in slots[k]:
            pairs.append((t.low, t.low) if t.settled() else picked[id(t)])
        answer[k] = (counts[k], pairs)
    return answer


def accuracy(size: int) -> int:
    return FINE if size > FINE_FROM else COARSE


def _narrow(df: DataFrame, targets: list[_Target]) -> None:
    """Shrink every bracket around its ranks by one sketch and one count."""
    by_scope: dict = {}
    for t in targets:
        by_scope.setdefault((t.key, t.low, t.high, t.below, t.inside), []).append(t)
    sketches = []
    scopes = list(by_scope.items())
    for i, ((_, low, high, below, inside), group) in enumerate(scopes):
        grid = []
        for t in group:
            slack = 2.0 / accuracy(inside)
            top = max(inside - 1, 1)
            grid += [max(0.0, (t.low_rank - below) / top - slack), min(1.0, (t.high_rank - below) / top + slack)]
        e = group[0].expr
        scoped = F.when(e.between(low, high), e)
        sketches.append(F.percentile_approx(scoped, grid, accuracy(inside)).alias(f"s{i}"))
    row = df.agg(*sketches).first()
    tries = []
    for i, (_, group) in enumerate(scopes):
        for j, t in enumerate(group):
            tries.append((t, row[f"s{i}"][2 * j], row[f"s{i}"][2 * j + 1]))
    checks = []
    for i, (t, low, high) in enumerate(tries):
        checks.append(F.count_if(t.expr < low).alias(f"b{i}"))
        checks.append(F.count_if(t.expr <= high).alias(f"u{i}"))
    row = df.agg(*checks).first()
    for i, (t, low, high) in enumerate(tries):
        below, upto = row[f"b{i}"], row[f"u{i}"]
        if below <= t.low_rank and t.high_rank < upto:
            t.low, t.high, t.below, t.inside = low, high, below, upto - below


def _pick(df: DataFrame, targets: list[_Target]) -> dict:
    """Group what lies inside the brackets and read off the ranks."""
    if not targets:
        return {}
    within = [t.expr.between(t.low, t.high) for t in targets]
    any_inside = within[0]
    for w in within[1:]:
        any_inside = any_inside | w
    hits = F.array_compact(F.array(*[
        F.when(w, F.struct(F.lit(i).alias("t"), t.expr.alias("x"))) for i, (t, w) in enumerate(zip(targets, within))
    ]))
    counted = df.where(any_inside).select(F.explode(hits).alias("h")).groupBy("h.t", "h.x").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("t").orderBy("x"))
    spans = counted.withColumn("upto", upto)
    low = F.element_at(F.array(*[F.lit(t.low_rank - t.below) for t in targets]), F.col("t") + 1)
    high = F.element_at(F.array(*[F.lit(t.high_rank - t.below) for t in targets]), F.col("t") + 1)
    rows = spans.groupBy("t").agg(
        F.min(F.when(F.col("upto") > low, F.col("x"))).alias("low"),
        F.min(F.when(F.col("upto") > high, F.col("x"))).alias("high"),
    ).collect()
    return {id(targets[r["t"]]): (r["low"], r["high"]) for r in rows}


def exact_quantiles(df: DataFrame, exprs: dict, probs: list[float], inside: int = INSIDE, known: dict | None = None) -> dict:
    """Linearly interpolated quantiles per key; empty columns give None."""

    def spot(n: int) -> list[tuple[int, int]]:
        return [(math.floor((n - 1) * p), math.ceil((n - 1) * p)) for p in probs]

    found = rank_values(df, exprs, spot, inside, known)
    answer = {}
    for key, (n, pairs) in found.items():
        if n == 0:
            answer[key] = [None] * len(probs)
            continue
        values = []
        for p, (low, high) in zip(probs, pairs):
            part = (n - 1) * p - math.floor((n - 1) * p)
            values.append(low if low == high else low + (high - low) * part)
        answer[key] = values
    return answer
