"""Row-local work on unbounded input: what was fitted on a table, reapplied to records as they arrive.

Nothing new is computed here. The fitted features and the row-local cleaning steps are projections, so
they accept a streaming frame as it is; steps that need the whole table are refused up front.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabwright.errors import TableError
from tabwright.operators.cleaning import STEPS
from tabwright.operators.draft import Draft, StepRecord
from tabwright.operators.features import FittedFeatures
from tabwright.plans.pipeline import check_config
from tabwright.sources.table import identified

# Steps whose outcome for a row depends on that row only.
ROW_LOCAL = ("normalize_text", "replace_values", "cast", "drop_missing", "drop_columns", "range")


def row_local(step: dict) -> bool:
    if step["op"] == "fill_missing":
        return step.get("strategy", "median") == "constant"
    if step["op"] == "cast":
        return step.get("errors", "raise") == "coerce"
    return step["op"] in ROW_LOCAL


def clean_stream(stream: DataFrame, config: dict, row_id: str) -> DataFrame:
    """Row-local steps of a cleaning configuration; values that are not numbers count as missing."""
    draft = Draft(identified(stream, row_id))
    for number, step in enumerate(check_config(config).get("steps", []), 1):
        if not row_local(step):
            raise TableError(f"step {number} ({step['op']}) needs the whole table")
        record = StepRecord(number, step, keep_before=draft.keep, standing=list(draft.columns.values()))
        options = {key: value for key, value in step.items() if key not in ("op", "columns")}
        STEPS[step["op"]](draft, record, step.get("columns") or list(draft.columns), **options)
    return draft.current()


def transform_stream(stream: DataFrame, fitted: FittedFeatures) -> DataFrame:
    return fitted.transform(stream)
