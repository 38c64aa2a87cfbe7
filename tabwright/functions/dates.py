"""Date parsing by explicit format: strptime directives turned into a guard and a Spark pattern."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.errors import TableError

# Directive -> (text it accepts, pattern when separated, pattern when directives touch).
DIRECTIVES = {
    "d": (r"[0-9]{1,2}", "d", "dd"),
    "m": (r"[0-9]{1,2}", "M", "MM"),
    "Y": (r"[0-9]{4}", "yyyy", "yyyy"),
    "H": (r"[0-9]{1,2}", "H", "HH"),
    "M": (r"[0-9]{1,2}", "m", "mm"),
    "S": (r"[0-9]{1,2}", "s", "ss"),
    "f": (r"[0-9]{1,6}", "SSSSSS", "SSSSSS"),
    "y": (r"[0-9]{2}", "yy", "yy"),
    "b": (r"[A-Za-z]{3}", "MMM", "MMM"),
    "B": (r"[A-Za-z]{3,9}", "MMMM", "MMMM"),
    "I": (r"[0-9]{1,2}", "h", "hh"),
    "p": (r"[AaPp][Mm]", "a", "a"),
    "j": (r"[0-9]{1,3}", "D", "DDD"),
    "z": (r"(Z|[+-][0-9]{2}:?[0-9]{2})", "XXX", "XXX"),
}
CENTURY_TURN = 2069
ISO_DATE = r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?)?)?$"
ISO_COMPACT = r"^[0-9]{8}$"
OFFSET_WITHOUT_COLON = r"([+-][0-9]{2})([0-9]{2})$"


def spark_pattern(fmt: str) -> tuple[str, str]:
    """Guard regex and Spark datetime pattern of a strptime format."""
    pieces = re.findall(r"%.|[^%]+|%$", fmt)
    guard, pattern = "", ""
    for position, piece in enumerate(pieces):
        if piece == "%%":
            guard, pattern = guard + "%", pattern + "'%'"
        elif piece.startswith("%"):
            if piece[1:] not in DIRECTIVES:
                raise TableError(f"unsupported date directive {piece!r} in {fmt!r}")
            accepted, loose, tight = DIRECTIVES[piece[1:]]
            touching = any(
                0 <= other < len(pieces) and pieces[other].startswith("%") and pieces[other] != "%%"
                for other in (position - 1, position + 1)
            )
            guard += re.sub(r"\{1,([23])\}", r"{\1}", accepted) if touching else accepted
            pattern += tight if touching else loose
        else:
            guard += re.escape(piece)
            pattern += "'" + piece.replace("'", "''") + "'"
    return f"^{guard}$", pattern


def parse_datetime(column: Column, dtype: T.DataType, fmt: str) -> Column:
    """UTC timestamps by an explicit format or ``ISO8601``; anything else becomes null."""
    if not fmt or fmt == "mixed":
        raise TableError("an explicit date format is required, for example %d/%m/%Y or ISO8601")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return column.cast("timestamp")
    text = column.cast("string")
    if fmt == "ISO8601":
        with_colon = F.regexp_replace(text, OFFSET_WITHOUT_COLON, "$1:$2")
        extended = F.when(text.contains(":"), with_colon).otherwise(text)
        return F.when(text.rlike(ISO_DATE), extended.try_cast("timestamp")).when(
            text.rlike(ISO_COMPACT), F.try_to_timestamp(text, F.lit("yyyyMMdd"))
        )
    guard, pattern = spark_pattern(fmt)
    if "%z" in fmt:
        text = F.regexp_replace(text, OFFSET_WITHOUT_COLON, "$1:$2")
    moment = F.try_to_timestamp(text, F.lit(pattern))
    if "%y" in fmt:
        # Two digits from 69 on are years of the last century.
        moment = F.when(F.year(moment) >= CENTURY_TURN, moment - F.expr("INTERVAL 100 YEARS")).otherwise(moment)
    return F.when(column.cast("string").rlike(guard), moment)
