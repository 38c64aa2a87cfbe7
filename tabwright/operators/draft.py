"""A table in the middle of being cleaned.

Between two shuffles a draft never drops anything: each step adds a new version of the columns it
touches, and row-dropping steps add a ``keep`` flag. So every version the step log has to compare sits
side by side in one projection, one aggregate yields the log of all those steps, and Catalyst prunes
whatever a particular job does not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.errors import TableError
from tabwright.functions.names import ROW_ID, data_columns, dtype_of, q
from tabwright.functions.numbers import as_number, is_numeric, is_temporal


@dataclass
class Check:
    """A count that must be acceptable, evaluated together with the next aggregate over the draft."""

    step: int
    operation: str
    count: Column
    complain: Callable[[int], str | None]


@dataclass
class StepRecord:
    step: int
    parameters: dict
    keep_before: str | None = None
    keep_after: str | None = None
    versions: list[tuple[str, str, str]] = field(default_factory=list)
    removed_columns: list[str] = field(default_factory=list)
    removed_versions: list[str] = field(default_factory=list)
    standing: list[str] = field(default_factory=list)
    reshaped: bool = False


class Draft:
    def __init__(self, df: DataFrame):
        self.frame = df
        self.columns = {name: name for name in data_columns(df)}
        self.initial = list(self.columns.values())
        self.keep: str | None = None
        self.records: list[StepRecord] = []
        self._checks: list[Check] = []
        self._serial = 0

    # -- reading ---------------------------------------------------------------------------------

    def column(self, name: str) -> Column:
        return q(self.columns[name])

    def dtype(self, name: str) -> T.DataType:
        return dtype_of(self.frame, self.columns[name])

    def kept(self, column: Column) -> Column:
        """The column's value on rows still in the table, null elsewhere."""
        return column if self.keep is None else F.when(q(self.keep), column)

    def count(self, condition: Column) -> Column:
        return F.count_if(condition if self.keep is None else q(self.keep) & condition)

    def number(self, name: str) -> Column:
        return as_number(self.column(name), self.dtype(name))

    def current(self) -> DataFrame:
        live = self.frame if self.keep is None else self.frame.filter(q(self.keep))
        return live.select(q(ROW_ID), *[q(physical).alias(name) for name, physical in self.columns.items()])

    # -- checks ----------------------------------------------------------------------------------

    def require(self, check: Check) -> None:
        self._checks.append(check)

    def pending(self) -> list[Column]:
        return [check.count.alias(f"__check{i}") for i, check in enumerate(self._checks)]

    def settle(self, row: Row | None) -> None:
        """Raise for the first check that fails in an evaluated aggregate."""
        checks, self._checks = self._checks, []
        for i, check in enumerate(checks):
            message = check.complain(row[f"__check{i}"])
            if message:
                raise TableError(f"step {check.step} ({check.operation}): {message}")

    def measure(self, *measures: Column) -> Row:
        row = self.frame.agg(*self.pending(), *measures).first()
        self.settle(row)
        return row

    def has_checks(self) -> bool:
        return bool(self._checks)

    # -- writing ---------------------------------------------------------------------------------

    def _name(self, stem: str) -> str:
        self._serial += 1
        return f"__{stem}{self._serial}"

    def replace(self, record: StepRecord, new: dict[str, Column]) -> None:
        added = {name: self._name("v") for name in new}
        self.frame = self.frame.select("*", *[new[name].alias(added[name]) for name in new])
        for name, physical in added.items():
            record.versions.append((name, self.columns[name], physical))
            self.columns[name] = physical

    def restrict(self, record: StepRecord, condition: Column) -> None:
        """Keep only rows where the condition is not false; null counts as true."""
        flag = self._name("keep")
        alive = F.coalesce(condition, F.lit(True))
        if self.keep is not None:
            alive = q(self.keep) & alive
        self.frame = self.frame.select("*", alive.alias(flag))
        self.keep = record.keep_after = flag

    def remove(self, record: StepRecord, names: list[str]) -> None:
        record.removed_columns = sorted(names)
        record.removed_versions = [self.columns.pop(name) for name in names]

    def attach(self, table: DataFrame, key: Column, key_name: str) -> None:
        """Left-join a lookup table whose size the configuration fixes."""
        self.frame = self.frame.join(F.broadcast(table), key == q(key_name), "left")


def cells_differ(old: Column, old_type: T.DataType, new: Column, new_type: T.DataType) -> Column:
    """Whether a cell changed: two missing cells are equal, numbers and moments compare by value, the rest by text."""
    if is_numeric(old_type) and is_numeric(new_type):
        return ~old.cast("double").eqNullSafe(new.cast("double"))
    if is_temporal(old_type) and is_temporal(new_type):
        return ~F.unix_micros(old.cast("timestamp")).eqNullSafe(F.unix_micros(new.cast("timestamp")))
    return ~_cell_text(old, old_type).eqNullSafe(_cell_text(new, new_type))


def _cell_text(column: Column, dtype: T.DataType) -> Column:
    if is_temporal(dtype):
        moment = column.cast("timestamp")
        fraction = F.when(F.unix_micros(moment) % 1_000_000 != 0, F.date_format(moment, ".SSSSSS")).otherwise("")
        return F.concat(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"), fraction, F.lit("+00:00"))
    return column.cast("string")


def segment_measures(draft: Draft) -> list[Column]:
    """Aggregates from which ``segment_log`` derives the counts of every step in the draft."""

    def among(keep: str | None, condition: Column) -> Column:
        return F.count_if(condition if keep is None else q(keep) & condition)

    def nulls(physicals: list[str]) -> Column:
        total = F.lit(0)
        for physical in physicals:
            total = total + q(physical).isNull().cast("int")
        return total

    schema = draft.frame.schema
    measures = [F.count("*").alias("rows0"), F.coalesce(F.sum(nulls(draft.initial)), F.lit(0)).alias("missing0")]
    for i, record in enumerate(draft.records):
        changed, delta = F.lit(0), F.lit(0)
        for _, old, new in record.versions:
            differ = cells_differ(q(old), schema[old].dataType, q(new), schema[new].dataType)
            changed = changed + among(record.keep_before, differ)
            delta = delta + among(record.keep_before, q(new).isNull()) - among(record.keep_before, q(old).isNull())
        if record.removed_versions:
            gone = nulls(record.removed_versions)
            alive = gone if record.keep_before is None else F.when(q(record.keep_before), gone)
            delta = delta - F.coalesce(F.sum(alive), F.lit(0))
        if record.keep_after:
            dropped = ~q(record.keep_after) if record.keep_before is None else q(record.keep_before) & ~q(record.keep_after)
            measures.append(F.count_if(dropped).alias(f"dropped{i}"))
            delta = delta - F.coalesce(F.sum(F.when(dropped, nulls(record.standing))), F.lit(0))
        measures += [changed.alias(f"changed{i}"), delta.alias(f"delta{i}")]
    return measures


def segment_log(draft: Draft, row: Row) -> tuple[list[dict], int, int]:
    """Log entries of the draft's steps, and the rows and missing cells after the last of them."""
    schema = draft.frame.schema
    rows, missing, entries = row["rows0"], row["missing0"], []
    for i, record in enumerate(draft.records):
        if record.reshaped:
            entries.append({"step": record.step, "parameters": record.parameters, "rows_before": rows, "missing_before": missing})
            continue
        removed = row[f"dropped{i}"] if record.keep_after else 0
        final = {name: (old, new) for name, old, new in record.versions}
        types = {
            name: [schema[old].dataType.simpleString(), schema[new].dataType.simpleString()]
            for name, (old, new) in final.items()
        }
        entries.append(
            {
                "step": record.step,
                "parameters": record.parameters,
                "rows_before": rows,
                "rows_after": rows - removed,
                "removed_columns": record.removed_columns,
                "changed_cells_retained": row[f"changed{i}"],
                "missing_before": missing,
                "missing_after": missing + row[f"delta{i}"],
                "dtype_changes": {name: pair for name, pair in types.items() if pair[0] != pair[1]},
            }
        )
        rows, missing = rows - removed, missing + row[f"delta{i}"]
    return entries, rows, missing
