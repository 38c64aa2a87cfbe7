"""Exact order statistics without sorting the table or gathering its values in one task.

``percentile`` keeps every distinct value of a column in one buffer, which one reducer has to merge.
Here each wanted rank is bracketed with the bounded quantile sketch, and one counting pass then
resolves the few values inside the brackets. The counts are exact, so the answers are; a bracket that
turns out wrong or too wide is narrowed in a further pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10_000
VALUE_BUDGET = 100_000


@dataclass
class Wanted:
    """One numeric column, the rough positions asked for, and the exact ranks once its size is known."""

    column: Column
    fractions: Sequence[float]
    ranks: Callable[[int], Sequence[int]]


@dataclass
class OrderStats:
    counts: dict[str, int]
    values: dict[str, dict[int, float]]
    measures: Row | None = None
    minimum: dict[str, float] = field(default_factory=dict)
    maximum: dict[str, float] = field(default_factory=dict)


@dataclass
class _Target:
    name: str
    rank: int
    low: float
    high: float


def quantile_ranks(fractions: Sequence[float]) -> Callable[[int], list[int]]:
    def ranks(count: int) -> list[int]:
        wanted = set()
        for fraction in fractions:
            position = (count - 1) * fraction
            wanted.update((math.floor(position), math.ceil(position)))
        return sorted(wanted)

    return ranks


def interpolate(values: dict[int, float], count: int, fraction: float) -> float | None:
    """Linear interpolation between neighbouring order statistics."""
    if not count:
        return None
    position = (count - 1) * fraction
    below, share = math.floor(position), position - math.floor(position)
    low, high = float(values[below]), float(values[math.ceil(position)])
    span = high - low
    return high - span * (1 - share) if share >= 0.5 else low + span * share


def exact_quantiles(
    df: DataFrame, columns: dict[str, tuple[Column, Sequence[float]]], measures: Sequence[Column] = (), **limits
) -> tuple[dict[str, dict[float, float | None]], OrderStats]:
    """Interpolated quantiles of several columns, plus ``measures`` evaluated in the first pass."""
    wanted = {name: Wanted(c, fractions, quantile_ranks(fractions)) for name, (c, fractions) in columns.items()}
    stats = order_statistics(df, wanted, measures, **limits)
    result = {
        name: {f: interpolate(stats.values[name], stats.counts[name], f) for f in fractions}
        for name, (_, fractions) in columns.items()
    }
    return result, stats


def order_statistics(
    df: DataFrame,
    wanted: dict[str, Wanted],
    measures: Sequence[Column] = (),
    *,
    accuracy: int = SKETCH_ACCURACY,
    budget: int = VALUE_BUDGET,
) -> OrderStats:
    """Values at 0-based ranks of each column's non-null values. Columns must share one numeric type."""
    names = list(wanted)
    slack = 2.0 / accuracy
    # Projected once, so that no aggregate repeats the work of producing the value.
    df = df.select("*", *[wanted[name].column.alias(f"__w{i}") for i, name in enumerate(names)])
    wanted = {name: Wanted(F.col(f"__w{i}"), w.fractions, w.ranks) for i, (name, w) in enumerate(wanted.items())}
    first = list(measures)
    for i, name in enumerate(names):
        column = wanted[name].column
        edges = [e for f in wanted[name].fractions for e in (max(f - slack, 0.0), min(f + slack, 1.0))]
        first += [
            F.count(column).alias(f"__n{i}"),
            F.min(column).alias(f"__lo{i}"),
            F.max(column).alias(f"__hi{i}"),
            F.percentile_approx(column, [float(e) for e in edges], accuracy).alias(f"__q{i}"),
        ]
    row = df.agg(*first).first()
    stats = OrderStats({}, {name: {} for name in names}, row)
    open_targets: list[_Target] = []
    for i, name in enumerate(names):
        count = row[f"__n{i}"]
        stats.counts[name] = count
        stats.minimum[name], stats.maximum[name] = row[f"__lo{i}"], row[f"__hi{i}"]
        if not count:
            continue
        brackets = list(zip(row[f"__q{i}"][::2], row[f"__q{i}"][1::2]))
        for rank in wanted[name].ranks(count):
            if rank == 0:
                stats.values[name][rank] = stats.minimum[name]
            elif rank == count - 1:
                stats.values[name][rank] = stats.maximum[name]
            else:
                place = rank / (count - 1)
                nearest = min(range(len(brackets)), key=lambda j: abs(wanted[name].fractions[j] - place))
                open_targets.append(_Target(name, rank, *brackets[nearest]))
    while open_targets:
        involved = {t.name for t in open_targets}
        # Even fully narrowed brackets need room for themselves and the gaps around them.
        budget = max(budget, 4 * len(open_targets) + len(involved))
        intervals = {name: _merge([(t.low, t.high) for t in open_targets if t.name == name]) for name in involved}
        counted = _count_inside(df, {n: wanted[n].column for n in names if n in involved}, intervals, budget)
        if counted is None:
            narrowed = _narrow(df, wanted, stats, open_targets, accuracy)
            if narrowed == open_targets:
                budget *= 2
            open_targets = narrowed
            continue
        open_targets = _resolve(stats, open_targets, intervals, counted)
    return stats


def _merge(pairs: list[tuple[float, float]]) -> list[tuple[float, float]]:
    merged: list[tuple[float, float]] = []
    for low, high in sorted(pairs):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _count_inside(df, columns: dict[str, Column], intervals, budget: int):
    """Counts per value inside the intervals and per gap between them: {name: [(slot, value, n)]}.

    Odd slots are intervals, even slots gaps. None when more distinct values turn up than the budget.
    """
    names = list(columns)
    projected = df.select(*[c.alias(f"v{i}") for i, c in enumerate(columns.values())])
    pieces = []
    for i, name in enumerate(names):
        value = F.col(f"v{i}")
        slot = F.when(value.isNull(), F.lit(None).cast("int"))
        for j, (low, high) in enumerate(intervals[name]):
            slot = slot.when(value < F.lit(low), 2 * j).when(value <= F.lit(high), 2 * j + 1)
        slot = slot.otherwise(2 * len(intervals[name]))
        pieces += [F.lit(i), slot, F.when(slot % 2 == 1, value)]
    long = projected.select(F.stack(F.lit(len(names)), *pieces).alias("i", "slot", "value"))
    counted = long.filter("slot IS NOT NULL").groupBy("i", "slot", "value").agg(F.count("*").alias("n"))
    rows = counted.limit(budget + 1).collect()
    if len(rows) > budget:
        return None
    result = {name: [] for name in names}
    for row in rows:
        result[names[row["i"]]].append((row["slot"], row["value"], row["n"]))
    return result


def _resolve(stats: OrderStats, targets, intervals, counted) -> list[_Target]:
    still_open = []
    for name in {t.name for t in targets}:
        ranks = sorted((t for t in targets if t.name == name), key=lambda t: t.rank)
        ordered = sorted(counted[name], key=lambda item: (item[0], item[1] if item[1] is not None else 0))
        reached, k = 0, 0
        for slot, value, count in ordered:
            reached += count
            while k < len(ranks) and ranks[k].rank < reached:
                if slot % 2:
                    stats.values[name][ranks[k].rank] = value
                else:
                    bounds = intervals[name]
                    low = bounds[slot // 2 - 1][1] if slot else stats.minimum[name]
                    high = bounds[slot // 2][0] if slot // 2 < len(bounds) else stats.maximum[name]
                    still_open.append(_Target(name, ranks[k].rank, low, high))
                k += 1
    return still_open


def _narrow(df, wanted, stats, targets, accuracy) -> list[_Target]:
    """Replace each bracket by a tighter one, sketched over the values inside it only."""
    inside = [(wanted[t.name].column >= F.lit(t.low)) & (wanted[t.name].column <= F.lit(t.high)) for t in targets]
    row = df.agg(
        *[F.count_if(wanted[t.name].column < F.lit(t.low)).alias(f"b{j}") for j, t in enumerate(targets)],
        *[F.count_if(inside[j]).alias(f"m{j}") for j in range(len(targets))],
    ).first()
    sketches, keep = [], []
    slack = 2.0 / accuracy
    for j, target in enumerate(targets):
        below, within = row[f"b{j}"], row[f"m{j}"]
        local = target.rank - below
        if not 0 <= local < within:
            # The sketch missed: fall back to the side of the bracket that holds the rank.
            low, high = (stats.minimum[target.name], target.low) if local < 0 else (target.high, stats.maximum[target.name])
            keep.append(_Target(target.name, target.rank, low, high))
            continue
        place = local / max(within - 1, 1)
        edges = [max(place - slack, 0.0), min(place + slack, 1.0)]
        column = F.when(inside[j], wanted[target.name].column)
        sketches.append((target, F.percentile_approx(column, edges, accuracy)))
    if sketches:
        found = df.agg(*[s.alias(f"s{j}") for j, (_, s) in enumerate(sketches)]).first()
        for j, (target, _) in enumerate(sketches):
            keep.append(_Target(target.name, target.rank, *found[f"s{j}"]))
    return keep
