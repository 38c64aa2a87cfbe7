"""Text expressions that agree with Python's ``str`` methods and stay inside the JVM."""

from __future__ import annotations

import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.strip() removes.
WHITESPACE = "".join(chr(code) for code in range(0x10000) if chr(code).isspace())
ASCII_ONLY = r"\A[\x00-\x7F]*\z"


def strip(column: Column) -> Column:
    return F.btrim(column, F.lit(WHITESPACE))


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, tuple[str, ...]]:
    """Code points folding to one other character, their images, and those folding to several."""
    single, image, several = [], [], []
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        folded = char.casefold()
        if folded == char:
            continue
        if len(folded) == 1:
            single.append(char)
            image.append(folded)
        else:
            several.append(char)
    return "".join(single), "".join(image), tuple(several)


def casefold(column: Column) -> Column:
    """``str.casefold``: ASCII takes the cheap branch, expansions such as ß run only where present."""
    single, image, several = _folding()
    folded = F.translate(column, single, image)
    expanded = folded
    for char in several:
        expanded = F.replace(expanded, F.lit(char), F.lit(char.casefold()))
    return (
        F.when(column.rlike(ASCII_ONLY), F.lower(column))
        .when(column.rlike("[" + "".join(several) + "]"), expanded)
        .otherwise(folded)
    )
