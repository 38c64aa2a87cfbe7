"""Exact seeded samples and splits by order of a row hash, without sorting the table.

The rank of a row is its place in the order of ``xxhash64(row identity, seed)``. A cut at rank k is
found by counting hash prefixes, level by level, until the prefix holding the cut has few rows; only
those are looked at. Membership is then a comparison with the cut, so it is the same in every job, on
any number of executors.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.errors import TableError
from tabwright.functions.names import ROW_ID, q
from tabwright.operators.order_stats import Wanted, order_statistics

TRAIN, VALIDATION, TEST = "train", "validation", "test"
PREFIX_ROWS = 2_000
PREFIX_GROUPS = 65_536


@dataclass(frozen=True)
class Cut:
    """First (hash, identity) pair at or after the cut; None when the cut is at the very end."""

    hash: int
    row: object


def row_hash(seed: int) -> Column:
    return F.xxhash64(q(ROW_ID), F.lit(seed))


def before(cut: Cut | None, seed: int) -> Column:
    if cut is None:
        return F.lit(True)
    value = row_hash(seed)
    return (value < F.lit(cut.hash)) | ((value == F.lit(cut.hash)) & (q(ROW_ID) < F.lit(cut.row)))


def hash_cuts(df: DataFrame, seed: int, sizes: Mapping, ranks: Mapping[object, Sequence[int]], group: Column | None = None) -> dict:
    """``{group: [cut, ...]}`` such that exactly ``rank`` rows of the group precede each cut."""
    session = df.sparkSession
    rows = df.select(
        (F.lit(0) if group is None else group).alias("g"), q(ROW_ID).alias("row"), row_hash(seed).alias("h")
    )
    # Open cuts: (group, rank) -> (lowest hash of the prefix, prefix bits, rows before it, rows in it)
    state = {(g, r): (-(2**63), 0, 0, sizes[g]) for g, wanted in ranks.items() for r in wanted if r < sizes[g]}
    groups = len({g for g, _ in state})
    few = max(50, min(PREFIX_ROWS, 100_000 // max(len(state), 1)))
    level = 0
    while level < 64:
        wide = [key for key, (_, _, _, size) in state.items() if size > few]
        if not wide:
            break
        parents = {(key[0], *state[key][:2]) for key in wide}
        needed = math.ceil(math.log2(2 * max(state[key][3] for key in wide) / few))
        level = min(64, level + max(1, min(needed, int(math.log2(PREFIX_GROUPS / groups)))))
        shift = 64 - level
        prefix = F.shiftright("h", shift).alias("p")
        counted: dict = {}
        for row in _within(session, rows, parents).groupBy("g", prefix).agg(F.count("*").alias("n")).collect():
            counted.setdefault(row["g"], []).append((row["p"], row["n"]))
        for key in wide:
            low, bits, reached, _ = state[key]
            first, last = low >> shift, (low + (1 << (64 - bits)) - 1) >> shift
            for p, n in sorted(pair for pair in counted[key[0]] if first <= pair[0] <= last):
                if key[1] < reached + n:
                    state[key] = (p << shift, level, reached, n)
                    break
                reached += n
    prefixes = {(key[0], low, bits) for key, (low, bits, _, _) in state.items()}
    near: dict = {}
    if prefixes:
        for row in _within(session, rows, prefixes).collect():
            near.setdefault(row["g"], []).append((row["h"], row["row"]))
    cuts: dict = {}
    for g, wanted in ranks.items():
        cuts[g] = []
        for rank in wanted:
            if (g, rank) not in state:
                cuts[g].append(None)
                continue
            low, bits, reached, _ = state[(g, rank)]
            members = sorted(pair for pair in near[g] if low <= pair[0] < low + (1 << (64 - bits)))
            place = rank - reached
            if place and members[place] == members[place - 1]:
                raise TableError("the row identity is not unique")
            cuts[g].append(Cut(*members[place]))
    return cuts


def _within(session, rows: DataFrame, prefixes) -> DataFrame:
    """Rows whose hash lies in one of the prefixes; there are at most two prefixes per group."""
    if all(bits == 0 for _, _, bits in prefixes):
        return rows
    schema = f"pg {rows.schema['g'].dataType.simpleString()}, low bigint, high bigint"
    ranges = session.createDataFrame([(g, low, low + (1 << (64 - bits)) - 1) for g, low, bits in prefixes], schema)
    condition = (F.col("g") == F.col("pg")) & F.col("h").between(F.col("low"), F.col("high"))
    return rows.join(F.broadcast(ranges), condition, "left_semi")


def sample_rows(df: DataFrame, size: int, total: int, seed: int) -> DataFrame:
    """Exactly ``min(size, total)`` rows, the same ones every time."""
    if size >= total:
        return df
    (cut,) = hash_cuts(df, seed, {0: total}, {0: [size]})[0]
    return df.filter(before(cut, seed))


# -- sizes -----------------------------------------------------------------------------------------


def split_sizes(rows: int, test: float, validation: float) -> tuple[int, int, int]:
    """Rows for train, validation and test of a random split."""
    n_test = math.ceil(rows * test)
    rest = rows - n_test
    n_validation = math.ceil(rest * (validation / (1 - test))) if validation else 0
    return rest - n_validation, n_validation, n_test


def quotas(counts: Mapping[object, int], draws: int) -> dict[object, int]:
    """Proportional shares by largest remainder; equal remainders go to the smaller label."""
    total = sum(counts.values())
    shares = {g: n * draws // total for g, n in counts.items()}
    left = draws - sum(shares.values())
    for g in sorted(counts, key=lambda g: (-(counts[g] * draws % total), g))[:left]:
        shares[g] += 1
    return shares


def stratified_sizes(counts: Mapping[str, int], test: float, validation: float) -> dict[str, tuple[int, int, int]]:
    """Train, validation and test rows per class, or an error when classes are too small."""
    rows, classes = sum(counts.values()), len(counts)
    n_train, n_validation, n_test = split_sizes(rows, test, validation)
    kept = _stratum(counts, n_train + n_validation, n_test, classes)
    train = _stratum(kept, n_train, n_validation, classes) if validation else kept
    return {g: (train[g], kept[g] - train[g], counts[g] - kept[g]) for g in counts}


def _stratum(counts: Mapping[str, int], first: int, second: int, classes: int) -> dict[str, int]:
    if min(counts.values()) < 2:
        raise TableError("cannot split: a class has fewer than 2 rows")
    if first < classes or second < classes:
        raise TableError("cannot split: fewer rows than classes in a part")
    return quotas(counts, first)


# -- splits ----------------------------------------------------------------------------------------


@dataclass
class Split:
    """Assignment of rows to parts, as a column, with the exact size of each part."""

    column: Column
    sizes: dict[str, int]


def random_split(df: DataFrame, rows: int, test: float, validation: float, seed: int) -> Split:
    n_train, n_validation, n_test = split_sizes(rows, test, validation)
    first, second = hash_cuts(df, seed, {0: rows}, {0: [n_train, n_train + n_validation]})[0]
    column = F.when(before(first, seed), TRAIN).when(before(second, seed), VALIDATION).otherwise(TEST)
    return Split(column, {TRAIN: n_train, VALIDATION: n_validation, TEST: n_test})


def stratified_split(df: DataFrame, label: Column, counts: Mapping[str, int], test: float, validation: float, seed: int) -> Split:
    sizes = stratified_sizes(counts, test, validation)
    ranks = {g: [train, train + valid] for g, (train, valid, _) in sizes.items()}
    cuts = hash_cuts(df, seed, counts, ranks, label)
    # One look-up of a class's two cuts instead of a branch per class.
    kind = df.schema[ROW_ID].dataType

    def packed(cut: Cut | None) -> Column:
        none = cut is None
        return F.struct(F.lit(none).alias("all"), F.lit(0 if none else cut.hash).cast("bigint").alias("hash"), F.lit(None if none else cut.row).cast(kind).alias("row"))

    pieces = [p for g, pair in cuts.items() for p in (F.lit(g), F.array(*map(packed, pair)))]
    found = F.try_element_at(F.create_map(*pieces), label)
    value = row_hash(seed)

    def precedes(k: int) -> Column:
        cut = found[k]
        return cut["all"] | (value < cut["hash"]) | ((value == cut["hash"]) & (q(ROW_ID) < cut["row"]))

    column = F.when(found.isNull(), F.lit(None).cast("string")).when(precedes(0), TRAIN).when(precedes(1), VALIDATION).otherwise(TEST)
    totals = {name: sum(s[i] for s in sizes.values()) for i, name in enumerate((TRAIN, VALIDATION, TEST))}
    return Split(column, totals)


def time_split(df: DataFrame, time: Column, rows: int, test: float, validation: float) -> Split:
    """Earliest rows train, latest test; a moment never falls on both sides of a boundary."""
    n_test, n_validation = math.ceil(rows * test), math.ceil(rows * validation)
    n_train = rows - n_test - n_validation
    if n_train < 2:
        raise TableError("train needs at least 2 rows; lower the validation or test share")
    edges = sorted({n_train, n_train + n_validation})
    moment = F.unix_micros(time)
    wanted = Wanted(moment, [e / rows for e in edges], lambda _: sorted({r for e in edges for r in (e - 1, e)}))
    values = order_statistics(df, {"time": wanted}).values["time"]
    for edge in edges:
        if values[edge - 1] >= values[edge]:
            raise TableError("a split boundary falls inside rows of one timestamp; change the shares")
    column = F.when(moment < F.lit(values[n_train]), TRAIN)
    if n_validation:
        column = column.when(moment < F.lit(values[n_train + n_validation]), VALIDATION)
    return Split(column.otherwise(TEST), {TRAIN: n_train, VALIDATION: n_validation, TEST: n_test})


def split_overlap(df: DataFrame, columns: Sequence[str], split: Column) -> DataFrame:
    """``overlap``: distinct value combinations that occur in more than one part."""
    parts = [F.max((split == F.lit(name)).cast("int")) for name in (TRAIN, VALIDATION, TEST)]
    grouped = df.groupBy(*[q(name) for name in columns]).agg((parts[0] + parts[1] + parts[2]).alias("parts"))
    return grouped.agg(F.count_if(F.col("parts") > 1).alias("overlap"))
