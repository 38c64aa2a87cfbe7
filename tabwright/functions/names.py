"""Column names: quoting, hidden row identity, and names that look like identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_ID = "_row_id"

# Fixed value: a column whose lower-cased, trimmed name matches this holds identifiers.
IDENTIFIER_NAME = re.compile(r"^id$|_id$|^id_|^sbd$|^mã|^ma_|code$|phone|postal|zip")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A text as a literal of an SQL expression."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def q(name: str) -> Column:
    """Column by its exact name, dots and all."""
    return F.col(quoted(name))


def is_identifier_name(name: str) -> bool:
    return IDENTIFIER_NAME.search(name.lower().strip()) is not None


def data_columns(df: DataFrame) -> list[str]:
    return [name for name in df.columns if name != ROW_ID]


def dtype_of(df: DataFrame, name: str):
    return df.schema[name].dataType
