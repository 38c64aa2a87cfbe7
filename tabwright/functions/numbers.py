"""Reading numbers out of text, and the finite-number rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.errors import TableError
from tabwright.functions.text import strip

# The accepted number grammar. Spark's own cast also takes "1d", "NaN" and the like.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"
INFINITY = r"^[+-]?(?i:inf(inity)?)$"


def finite(column: Column) -> Column:
    """NaN and both infinities become null. ``nullif`` evaluates its argument once, however long it is."""
    for value in (float("nan"), float("inf"), float("-inf")):
        column = F.nullif(column, F.lit(value))
    return column


def number_text(column: Column, decimal: str = ".", thousands: str = "") -> Column:
    if decimal not in (".", ",") or (thousands and (len(thousands) != 1 or thousands == decimal)):
        raise TableError("decimal must be '.' or ',' and thousands a different single character")
    text = strip(column)
    if thousands:
        text = F.replace(text, F.lit(thousands), F.lit(""))
    if decimal != ".":
        text = F.replace(text, F.lit(decimal), F.lit("."))
    return text


def parse_number(column: Column, decimal: str = ".", thousands: str = "") -> Column:
    # Text outside the grammar must not reach the cast: a failing cast costs an exception per cell.
    text = F.nullif(F.regexp_extract(number_text(column, decimal, thousands), NUMBER, 0), F.lit(""))
    number = text.try_cast("double")
    for value in (float("inf"), float("-inf")):
        number = F.nullif(number, F.lit(value))
    return number


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def as_number(column: Column, dtype: T.DataType) -> Column:
    """The column as finite doubles; whatever is not a finite number becomes null."""
    if is_numeric(dtype):
        value = column.cast("double")
        return finite(value) if isinstance(dtype, (T.DoubleType, T.FloatType)) else value
    if isinstance(dtype, T.BooleanType):
        return column.cast("double")
    if is_text(dtype):
        return parse_number(column)
    return F.lit(None).cast("double")


def null_for_nan(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.nullif(column, F.lit(float("nan")).cast(dtype))
    return column
