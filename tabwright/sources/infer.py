"""Missing tokens and conservative number inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions import numbers
from tabwright.functions.names import data_columns, dtype_of, is_identifier_name, q

LEADING_ZERO = r"^[+-]?0[0-9]"


def mark_missing(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Empty text and the given whole-cell tokens become null; whitespace is not trimmed here."""
    absent = ["", *tokens]
    return df.select(
        *[
            F.when(~q(f.name).isin(absent), q(f.name)).alias(f.name) if numbers.is_text(f.dataType) else q(f.name)
            for f in df.schema.fields
        ]
    )


def candidates(df: DataFrame) -> list[str]:
    return [n for n in data_columns(df) if numbers.is_text(dtype_of(df, n)) and not is_identifier_name(n)]


def readings(df: DataFrame, names: Sequence[str], decimal: str = ".") -> DataFrame:
    """The table plus each candidate's bare text, made once for all the questions asked about it."""
    return df.select("*", *[numbers.number_text(q(name), decimal).alias(f"__text{i}") for i, name in enumerate(names)]) if names else df


def inference_measures(names: Sequence[str]) -> list[Column]:
    """Per candidate of ``readings``: values, those that parse, those with a leading zero, whole numbers."""
    measures = []
    for i in range(len(names)):
        text = F.col(f"__text{i}")
        measures += [
            F.count(text).alias(f"valid{i}"),
            F.count_if(text.rlike(f"{numbers.NUMBER}|{numbers.INFINITY}")).alias(f"parses{i}"),
            F.count_if(text.rlike(LEADING_ZERO)).alias(f"padded{i}"),
            F.count_if(text.rlike(numbers.INTEGER) & text.try_cast("bigint").isNotNull()).alias(f"whole{i}"),
        ]
    return measures


def apply_inference(df: DataFrame, names: Sequence[str], row, decimal: str = ".") -> DataFrame:
    """Text columns turn numeric only if every value parses and none has a leading zero."""
    target = {}
    for i, name in enumerate(names):
        valid = row[f"valid{i}"]
        if valid and row[f"parses{i}"] == valid and not row[f"padded{i}"]:
            target[name] = "bigint" if row[f"whole{i}"] == valid else "double"
    return df.withColumns({name: numbers.number_text(q(name), decimal).try_cast(kind) for name, kind in target.items()}) if target else df


def infer_numbers(df: DataFrame, decimal: str = ".") -> DataFrame:
    """One aggregate over all candidate columns decides; nothing is sampled."""
    names = candidates(df)
    if not names:
        return df
    return apply_inference(df, names, readings(df, names, decimal).agg(*inference_measures(names)).first(), decimal)
