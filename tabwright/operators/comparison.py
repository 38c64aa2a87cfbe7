"""Comparisons of two versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.names import ROW_ID, data_columns, q
from tabwright.operators.draft import cells_differ


def changed_cells(before: DataFrame, after: DataFrame) -> DataFrame:
    """``column, changed``: cells that differ on the rows and columns both frames still have.

    For two independent frames; a cleaning run logs its own changes without any join. The identity
    is unique, so the join has no hot key.
    """
    shared = [name for name in data_columns(before) if name in after.columns]
    left = before.select(q(ROW_ID).alias("__row"), *[q(name).alias(f"__a{i}") for i, name in enumerate(shared)])
    right = after.select(q(ROW_ID).alias("__row"), *[q(name).alias(f"__b{i}") for i, name in enumerate(shared)])
    counts = [
        F.count_if(
            cells_differ(F.col(f"__a{i}"), before.schema[name].dataType, F.col(f"__b{i}"), after.schema[name].dataType)
        ).alias(f"__c{i}")
        for i, name in enumerate(shared)
    ]
    return tidy(left.join(right, "__row").agg(*counts), shared, "changed", "__c")


def invalid_casts(df: DataFrame, casts: dict[str, Column]) -> DataFrame:
    """``column, invalid``: non-missing cells each cast would lose, all columns in one aggregate."""
    counts = [F.count_if(q(name).isNotNull() & cast.isNull()).alias(f"__c{i}") for i, (name, cast) in enumerate(casts.items())]
    return tidy(df.agg(*counts), list(casts), "invalid", "__c")


def tidy(wide: DataFrame, names: list[str], value: str, prefix: str) -> DataFrame:
    """One row per column from a single wide aggregate row."""
    pieces = [piece for i, name in enumerate(names) for piece in (F.lit(name), F.col(f"{prefix}{i}"))]
    return wide.select(F.stack(F.lit(len(names)), *pieces).alias("column", value))
