"""One call from source to outputs, for use with spark-submit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from tabwright.errors import TableError
from tabwright.plans.ml_prep import MLConfig, export_ml, prepare_ml
from tabwright.plans.pipeline import check_config, run_pipeline
from tabwright.plans.report import report
from tabwright.session import configure
from tabwright.sinks.writers import guard_output, published, schema_table, write_json, write_table
from tabwright.sources.load import LoadOptions, load


@dataclass
class JobOutcome:
    rows_in: int
    rows_out: int
    output: str


def run_job(
    spark: SparkSession,
    source: str,
    output: str,
    *,
    pipeline: dict | None = None,
    ml_config: MLConfig | None = None,
    options: LoadOptions | None = None,
    row_id: str | None = None,
    fmt: str = "parquet",
    overwrite: bool = False,
    with_report: bool = True,
) -> JobOutcome:
    """Clean a source, or prepare it for learning; not both, since cleaning statistics would leak into the test part."""
    configure(spark)
    if pipeline is not None and ml_config is not None:
        raise TableError("give a pipeline or a learning configuration, not both")
    guard_output(spark, source, output, overwrite)
    with published(spark, output) as target:
        rows, kept = _write_all(spark, source, target, pipeline, ml_config, options, row_id, fmt, with_report)
    return JobOutcome(rows, kept, output)


def _write_all(spark, source, output, pipeline, ml_config, options, row_id, fmt, with_report) -> tuple[int, int]:
    """Rows read and rows kept; every result is in `output` when this returns."""
    table = load(spark, source, options, row_id)
    rows = table.metadata["rows"]
    if ml_config is not None:
        prepared = prepare_ml(table, ml_config)
        manifest = export_ml(prepared, output, spark)
        write_json(spark, table.metadata, f"{output}/source_metadata")
        prepared.scratch.close()
        table.close()
        return rows, sum(manifest["split_rows"].values())
    config = check_config(pipeline or {"version": 1, "roles": {}, "steps": []})
    result = run_pipeline(table, config)
    log = result.log
    write_table(result.df, f"{output}/cleaned_data", fmt)
    write_json(spark, config, f"{output}/pipeline")
    write_json(spark, log, f"{output}/processing_log")
    write_json(spark, {r["column"]: r["type"] for r in schema_table(result.df).collect()}, f"{output}/schema")
    write_json(spark, table.metadata, f"{output}/source_metadata")
    if with_report:
        shown = report(table.df, result)
        summary = {"before": shown.before.as_dict(), "after": shown.after.as_dict(), "comparison": shown.comparison}
        write_json(spark, summary, f"{output}/profiles")
        for phase, group in shown.tables.items():
            for name, chart in group.items():
                write_table(chart, f"{output}/report/{phase}/{name}")
    result.scratch.close()
    table.close()
    return rows, log[-1]["rows_after"] if log else rows
