"""Writers: results are written to the shared folder, read back and returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators.comparison import tidy
from tabwright.plans.job import run_job
from tabwright.plans.pipeline import run_pipeline
from tabwright.queries.cleaning import CLEANING_STEPS, RUN_CTES
from tabwright.queries.views import table, with_views
from tabwright.session import Scratch, configure
from tabwright.sinks.writers import schema_table, write_table

QUERIES, SQL = {}, {}


def register(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _write_csv(spark, folder):
    result = run_pipeline(table(spark, folder, "dirty_orders"), {"steps": CLEANING_STEPS})
    path = Scratch(spark).path("cleaned")
    write_table(result.df, path, "csv")
    back = spark.read.options(header=True, escape='"').csv(path)
    return back.select(
        F.col("cust_id").cast("bigint"), F.round(F.col("price").cast("double"), 6).alias("price"), "priority", "status",
        F.to_date(F.substring("day_text", 1, 10)).alias("day"),
    )


register(
    "write_csv",
    _write_csv,
    with_views(f"{RUN_CTES} SELECT cust_id, round(price, 6) AS price, priority, status, CAST(day_text AS DATE) AS day FROM s8", "dirty_orders"),
)
def _schema_table(spark, folder):
    """Schema of the written result, with the cells each column holds."""
    result = run_pipeline(table(spark, folder, "dirty_orders"), {"steps": CLEANING_STEPS})
    path = Scratch(spark).path("cleaned")
    write_table(result.df, path)
    written = spark.read.parquet(path)
    names = written.columns
    valid = tidy(written.agg(*[F.count(name).alias(f"v{i}") for i, name in enumerate(names)]), names, "valid", "v")
    return schema_table(written).join(valid, "column")


_TYPES = {"cust_id": "bigint", "price": "double", "price_text": "double", "priority": "string", "day_text": "timestamp", "status": "string"}
register(
    "schema_table",
    _schema_table,
    with_views(
        RUN_CTES
        + " "
        + " UNION ALL ".join(
            f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS type, count({c}) AS valid FROM s8""" for i, (c, t) in enumerate(_TYPES.items())
        ),
        "dirty_orders",
    ),
)


def _job_run(spark, folder):
    """Source to outputs in one call: typed cleaning of the orders file, then the written result."""
    configure(spark)
    output = Scratch(spark).path("job")
    steps = [
        {"op": "range", "columns": ["o_totalprice"], "min": 5000, "action": "drop"},
        {"op": "outliers", "columns": ["o_totalprice"]},
        {"op": "replace_values", "columns": ["o_orderstatus"], "mapping": {"F": "final"}},
    ]
    run_job(spark, f"{folder}/orders.parquet", output, pipeline={"steps": steps}, row_id="o_orderkey", with_report=False)
    return spark.read.parquet(f"{output}/cleaned_data").select("o_orderkey", F.round("o_totalprice", 6).alias("price"), "o_orderstatus")


register(
    "job_run",
    _job_run,
    """WITH a AS (SELECT * FROM orders WHERE o_totalprice >= 5000),
    f AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM a)
    SELECT o_orderkey, round(greatest(least(o_totalprice, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)), 6) AS price,
    CASE o_orderstatus WHEN 'F' THEN 'final' ELSE o_orderstatus END AS o_orderstatus FROM a, f""",
)
