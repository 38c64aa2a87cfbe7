"""Frequency tables: the shared intermediate behind distinct counts, modes, top values and categories."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.names import data_columns, dtype_of, q
from tabwright.functions.numbers import is_numeric


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, value, n`` for every distinct non-null value, with values as text.

    Columns of one type are unpivoted and counted together on their own type; text is made from the
    distinct values only.
    """
    names = list(columns if columns is not None else data_columns(df))
    by_type = defaultdict(list)
    for name in names:
        by_type[dtype_of(df, name).simpleString()].append(name)
    parts = [
        typed_counts(df, group).select("column", F.col("value").cast("string").alias("value"), "n")
        for group in by_type.values()
    ]
    return reduce(DataFrame.unionByName, parts)


def typed_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, n`` for columns that share one type; nulls are left out."""
    if len(columns) == 1:
        long = df.select(F.lit(columns[0]).alias("column"), q(columns[0]).alias("value"))
    else:
        pieces = [piece for name in columns for piece in (F.lit(name), q(name))]
        long = df.select(F.stack(F.lit(len(columns)), *pieces).alias("column", "value"))
    return long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))


def distinct_counts(counts: DataFrame) -> DataFrame:
    """``column, unique``. Reading ``n`` keeps the plan of the counts as it is, so that a query asking for
    top values too shuffles them once."""
    return counts.groupBy("column").agg(F.count_if(F.col("n") > 0).alias("unique"))


def top_values(counts: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent values per column; ties go to the smaller value.

    The rank filter is applied inside each map task first, so a column with a billion values sends
    only k rows per task to the shuffle.
    """
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc())
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest one among ties; columns without values are absent."""
    result = {}
    by_type = defaultdict(list)
    for name in columns:
        by_type[dtype_of(df, name).simpleString()].append(name)
    for group in by_type.values():
        best = F.min(F.struct((-F.col("n")).alias("rank"), "value")).alias("best")
        for row in typed_counts(df, group).groupBy("column").agg(best).collect():
            result[row["column"]] = row["best"]["value"]
    return result


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``rows`` and ``duplicate_rows``: surplus copies beyond the first, nulls counting as equal."""
    keys = [q(name) for name in (columns if columns is not None else data_columns(df))]
    copies = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Every category with its count, ascending by count then by value."""
    counted = value_counts(df, [column])
    return counted.select("value", "n").orderBy("n", "value")


def daily_counts(df: DataFrame, column: str) -> DataFrame:
    if is_numeric(dtype_of(df, column)):
        raise ValueError(f"{column!r} is not a date or time column")
    day = F.to_date(q(column))
    return df.filter(q(column).isNotNull()).groupBy(day.alias("day")).agg(F.count("*").alias("n")).orderBy("day")
