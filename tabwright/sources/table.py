"""The loaded table: a frame with a hidden row identity, a name and metadata."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.names import ROW_ID, data_columns, q
from tabwright.functions.numbers import null_for_nan
from tabwright.session import Scratch
from tabwright.sources.places import PLACE, place_lines, place_rows


@dataclass
class Table:
    df: DataFrame
    name: str = "table"
    metadata: dict = field(default_factory=dict)
    scratch: Scratch | None = field(default=None, repr=False)

    def close(self) -> None:
        """Give up the columnar copy of a text source, if one was made."""
        if self.scratch is not None:
            self.scratch.close()

    @property
    def columns(self) -> list[str]:
        return data_columns(self.df)


def identified(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Add the hidden row identity and turn NaN into null.

    A unique key of the table is best: it is the same in every job and leaves pushdown intact. Rows loaded
    from files have their place there, see ``placed``. Any other frame is numbered by scan position, which
    holds only as long as its partitions do; give a key where membership or order must be repeatable.
    """
    if ROW_ID in df.columns:
        return df
    identity = q(row_id) if row_id else F.monotonically_increasing_id()
    return df.select(
        identity.alias(ROW_ID), *[null_for_nan(q(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    )


def placed(scan: DataFrame, row_index: bool, path: str) -> DataFrame:
    """A file scan with the identity of every row: files by name, then by place in the file; see ``places``.

    ``row_index`` is for formats that know a row's number in its file. Text formats have the block and the position
    in the task: ordered the same way, and fixed once the loaded table is written.
    """
    found, _ = place_rows(scan) if row_index else place_lines(scan, path)
    return found.select(q(PLACE).alias(ROW_ID), *[null_for_nan(q(f.name), f.dataType).alias(f.name) for f in scan.schema.fields])


def as_table(df: DataFrame, row_id: str | None = None, name: str = "table") -> Table:
    return Table(identified(df, row_id), name)
