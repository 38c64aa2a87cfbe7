"""Pearson and Spearman correlation, pairwise complete."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.errors import TableError
from tabwright.functions.names import ROW_ID, data_columns, dtype_of, q
from tabwright.functions.numbers import as_number
from tabwright.operators.lookup import attach
from tabwright.operators.profile import infer_roles
from tabwright.operators.splits import sample_rows
from tabwright.session import Scratch

MIN_PAIRS = 3
RANK_BUCKET_ROWS = 200_000
HOT_VALUES = 50_000
SCHEMA = "x string, y string, r double, n bigint"


def correlation(
    df: DataFrame,
    roles: Mapping[str, str] | None = None,
    method: str = "pearson",
    *,
    max_rows: int | None = None,
    max_columns: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """``x, y, r, n`` for every pair of numeric-role columns, diagonal included, x not after y.

    ``r`` is null below three complete pairs and for constant columns. ``max_columns`` and
    ``max_rows`` bound the work on request: the first columns, and a deterministic sample of rows.
    """
    if method not in ("pearson", "spearman"):
        raise TableError("method must be pearson or spearman")
    resolved = infer_roles(df, roles)
    names = [name for name in data_columns(df) if resolved[name] == "numeric"][:max_columns]
    numbers = df.select(q(ROW_ID), *[as_number(q(name), dtype_of(df, name)).alias(name) for name in names])
    if max_rows is not None:
        numbers = sample_rows(numbers, max_rows, df.count(), seed)
    return pearson(numbers, names) if method == "pearson" else spearman(numbers, names)


def pearson(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return pair_correlations(df, {(x, y): (x, y) for x, y in combinations_with_replacement(names, 2)})


def pair_correlations(df: DataFrame, pairs: Mapping[tuple[str, str], tuple[str, str]]) -> DataFrame:
    """``x, y, r, n`` per pair of labels, each correlated over the rows where both its columns have values.

    One scan for the scale of every column, one for the moments, whatever the number of pairs. Moments of
    a pair are centred on that pair's own rows and merged as count, means and co-moments, first inside a
    task, then across tasks, so neither magnitude nor a few distant rows cost digits.
    """
    session = df.sparkSession
    if not pairs:
        return session.createDataFrame([], SCHEMA)
    columns = list(dict.fromkeys(name for pair in pairs.values() for name in pair))
    tops = df.agg(*[F.max(F.abs(q(name))).alias(f"t{i}") for i, name in enumerate(columns)]).first()
    scales = [2.0 ** math.frexp(top)[1] if top and math.isfinite(top) else 1.0 for top in tops]
    scaled = df.select(*[(q(name) / F.lit(scales[i])).alias(f"c{i}") for i, name in enumerate(columns)])
    place = {name: i for i, name in enumerate(columns)}
    partners: dict[int, list[tuple[int, int]]] = {}
    for number, (x, y) in enumerate(pairs.values()):
        partners.setdefault(place[x], []).append((number, place[y]))
    size = len(pairs)

    def moments(batches):
        total = np.zeros((6, size))
        for batch in batches:
            values = batch.to_numpy(dtype=float)
            if len(values):
                total = merged(total, batch_moments(values, partners, size))
        yield pd.DataFrame({"pair": np.arange(size), **dict(zip(MOMENTS, total, strict=True))})

    partial = scaled.mapInPandas(moments, "pair int, " + ", ".join(f"{m} double" for m in MOMENTS)).where("n > 0")
    whole = Window.partitionBy("pair")
    for axis in "xy":
        # Distances from the least mean, so that equal means stay exactly equal.
        partial = partial.withColumn(f"d{axis}", F.col(f"m{axis}") - F.min(f"m{axis}").over(whole))
        mean = F.sum(F.col("n") * F.col(f"d{axis}")).over(whole) / F.sum("n").over(whole)
        partial = partial.withColumn(f"e{axis}", F.col(f"d{axis}") - mean)
    added = partial.groupBy("pair").agg(
        F.sum("n").cast("bigint").alias("n"),
        *[F.sum(F.col(f"c{u}{v}") + F.col("n") * F.col(f"e{u}") * F.col(f"e{v}")).alias(f"c{u}{v}") for u, v in ("xx", "yy", "xy")],
    )
    labels = session.createDataFrame([(k, x, y) for k, (x, y) in enumerate(pairs)], "pair int, x string, y string")
    r = _bounded(F.try_divide(F.col("cxy"), F.sqrt("cxx") * F.sqrt("cyy")))
    found = labels.join(added, "pair", "left").select("x", "y", F.when(F.col("n") >= MIN_PAIRS, r).alias("r"), F.coalesce("n", F.lit(0)).alias("n"))
    return found.select("x", "y", "r", F.col("n").cast("bigint").alias("n"))


MOMENTS = ("n", "mx", "my", "cxx", "cyy", "cxy")


def batch_moments(values: np.ndarray, partners: Mapping[int, list[tuple[int, int]]], size: int) -> np.ndarray:
    out, present = np.zeros((6, size)), ~np.isnan(values)
    for i, listed in partners.items():
        numbers, others = (list(part) for part in zip(*listed, strict=True))
        both = present[:, others] & present[:, [i]]
        n = both.sum(axis=0)
        first = both.argmax(axis=0)
        centred = []
        for column, start in ((values[:, [i]], values[first, i]), (values[:, others], values[first, others])):
            start = np.where(n > 0, start, 0.0)
            away = np.where(both, column - start, 0.0)
            mean = away.sum(axis=0) / np.maximum(n, 1)
            centred.append((start + mean, np.where(both, away - mean, 0.0)))
        (mx, dx), (my, dy) = centred
        out[:, numbers] = n, mx, my, (dx * dx).sum(axis=0), (dy * dy).sum(axis=0), (dx * dy).sum(axis=0)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows together."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    x, y = np.where(a[0] > 0, b[1] - a[1], 0.0), np.where(a[0] > 0, b[2] - a[2], 0.0)
    start_x, start_y = np.where(a[0] > 0, a[1], b[1]), np.where(a[0] > 0, a[2], b[2])
    weight = a[0] * share
    return np.stack([
        n, start_x + x * share, start_y + y * share, a[3] + b[3] + weight * x * x, a[4] + b[4] + weight * y * y, a[5] + b[5] + weight * x * y
    ])


def _bounded(r: Column) -> Column:
    return F.when(r > 1, F.lit(1.0)).when(r < -1, F.lit(-1.0)).otherwise(r)


# -- ranks -----------------------------------------------------------------------------------------


def spearman(df: DataFrame, names: Sequence[str], scratch: Scratch | None = None) -> DataFrame:
    """Pearson on average ranks, each pair ranked on the rows where both columns have values.

    Columns that are missing on the same rows share one ranking per column; further rankings are made
    only for combinations of different missing patterns.
    """
    if not names:
        return df.sparkSession.createDataFrame([], SCHEMA)
    scratch = scratch or Scratch(df.sparkSession)
    pattern = _missing_patterns(df, names)
    wanted: dict[tuple, tuple[str, Column]] = {}
    pairs = {}
    for x, y in combinations_with_replacement(names, 2):
        joint = frozenset({pattern[x], pattern[y]} - {None})
        present = [q(name).isNotNull() for name in sorted(joint)]
        for name in (x, y):
            mask = F.lit(True)
            for condition in present:
                mask = mask & condition
            wanted.setdefault((name, joint), (f"k{len(wanted)}", F.when(mask, q(name))))
        pairs[(x, y)] = ("r" + wanted[(x, joint)][0], "r" + wanted[(y, joint)][0])
    keyed = df.select(q(ROW_ID), *[column.alias(label) for label, column in wanted.values()])
    return pair_correlations(with_ranks(keyed, [label for label, _ in wanted.values()], scratch), pairs)


def _missing_patterns(df: DataFrame, names: Sequence[str]) -> dict[str, str | None]:
    """For each column the first column missing on exactly the same rows; None when nothing is missing."""
    row = df.agg(*[F.count_if(q(name).isNull()).alias(f"m{i}") for i, name in enumerate(names)]).first()
    gaps = {name: row[f"m{i}"] for i, name in enumerate(names) if row[f"m{i}"]}
    result: dict[str, str | None] = dict.fromkeys(names)
    same_count = [(a, b) for i, a in enumerate(gaps) for b in list(gaps)[i + 1 :] if gaps[a] == gaps[b]]
    differ = {}
    if same_count:
        counts = [F.count_if(q(a).isNull() != q(b).isNull()).alias(f"d{i}") for i, (a, b) in enumerate(same_count)]
        found = df.agg(*counts).first()
        differ = {pair: found[f"d{i}"] for i, pair in enumerate(same_count)}
    for name in gaps:
        result[name] = next((other for other in gaps if other == name or differ.get((other, name)) == 0), name)
    return result


def with_ranks(df: DataFrame, labels: Sequence[str], scratch: Scratch, bucket_rows: int = RANK_BUCKET_ROWS) -> DataFrame:
    """Row identity and ``r<label>``: the average rank of each value among the non-null values of its column.

    All columns take the same way, whatever their number: one row per value looks its rank up, and the ranks of a
    row come together again by its identity. Rows without any value are left out.
    """
    ranks = scratch.table(average_ranks(df, labels, scratch, bucket_rows))
    size = ranks.agg(F.count("*").alias("values"), F.sum("n").alias("rows")).first()
    table = ranks.select(F.struct("column", "value").alias("key"), F.col("rank").alias("payload"), "n")
    # So many values at most can be as frequent as that.
    frequent = table.filter(F.col("n") * HOT_VALUES >= F.lit(size["rows"]))
    found = attach(_long(df, labels, q(ROW_ID)), F.struct("column", "value"), table, size["values"], "rank", q(ROW_ID), frequent)
    return found.groupBy(q(ROW_ID)).agg(*[F.max(F.when(F.col("column") == k, F.col("rank"))).alias("r" + label) for k, label in enumerate(labels)])


def _long(df: DataFrame, labels: Sequence[str], *keep: Column) -> DataFrame:
    """``column`` (its number) and ``value`` of every cell that has one."""
    pieces = [piece for k, label in enumerate(labels) for piece in (F.lit(k), q(label))]
    return df.select(*keep, F.stack(F.lit(len(labels)), *pieces).alias("column", "value")).filter("value IS NOT NULL")


def average_ranks(df: DataFrame, labels: Sequence[str], scratch: Scratch, bucket_rows: int = RANK_BUCKET_ROWS) -> DataFrame:
    """``column`` (its number), ``value, n, rank`` per distinct value.

    The frequencies of all columns are cut into ranges of about ``bucket_rows`` by (column, value) and written; ranks run
    inside a range and go on from the rows of its column in the ranges before, which are summed from one row per range and column.
    """
    counts = scratch.table(_long(df, labels).groupBy("column", "value").agg(F.count("*").alias("n")))
    parts = max(math.ceil(counts.count() / bucket_rows), 1)
    ranged = scratch.table(counts.repartitionByRange(parts, "column", "value").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("column", "part").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("column", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("below"))
    order = Window.partitionBy("column", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Ranges follow one another, so these are at most as many rows as ranges and columns together.
    reached = F.col("below") + F.sum("n").over(order)
    known = ranged.join(F.broadcast(totals), ["column", "part"])
    return known.select("column", "value", "n", (reached - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))
