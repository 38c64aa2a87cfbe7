"""Tables with defects, derived from the clean supplied tables, in both SQL dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabwright.session import configure
from tabwright.sources.table import Table, identified

DIRTY_ORDERS = """
SELECT o_orderkey AS row_id, o_custkey AS cust_id,
  CASE WHEN o_orderkey % 10 = 3 THEN NULL
       WHEN o_orderkey % 101 = 7 THEN o_totalprice * 50 ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 50 = 9 THEN 'unknown' WHEN o_orderkey % 50 = 19 THEN '1d'
       ELSE ' ' || CAST(CAST(round(o_totalprice) AS BIGINT) AS {text}) || ',5' END AS price_text,
  CASE o_orderkey % 5 WHEN 0 THEN '  ' || o_orderpriority || ' ' WHEN 1 THEN lower(o_orderpriority)
       WHEN 2 THEN '' WHEN 3 THEN NULL ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 40 = 11 THEN '31/02/2026' ELSE {day} END AS day_text,
  o_orderstatus AS status
FROM orders"""

DIRTY_DUPS = """
SELECT o_orderkey AS row_id, o_custkey % 50 AS k, o_orderstatus AS status, o_orderpriority AS priority FROM orders"""

# Supervised-learning frame: distinct times, gaps, text numbers, a rare and a late category.
LEARN = """
SELECT event_id AS row_id, ts,
  CASE WHEN event_id % 9 = 4 THEN NULL ELSE value END AS amount,
  CASE WHEN event_id % 11 = 5 THEN 'n/a' WHEN event_id % 13 = 6 THEN NULL
       ELSE CAST(user_id % 97 AS {text}) END AS visits,
  CASE WHEN event_id % 7 = 2 THEN NULL ELSE event_type END AS kind,
  'u' || CAST(user_id % 23 AS {text}) AS grp,
  CASE WHEN event_id % 17 = 8 THEN NULL ELSE value * 2 + user_id % 3 END AS target,
  CASE WHEN event_id % 3 = 0 THEN 'low' WHEN event_id % 3 = 1 THEN 'mid' ELSE 'high' END AS label
FROM events"""

SPARK_DIALECT = {"text": "VARCHAR(20)", "day": "date_format(o_orderdate,'dd/MM/yyyy')"}
DUCKDB_DIALECT = {"text": "VARCHAR", "day": "strftime(o_orderdate,'%d/%m/%Y')"}

VIEWS = {"dirty_orders": DIRTY_ORDERS, "dirty_dups": DIRTY_DUPS, "learn": LEARN}
STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
NUMBER = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived frame with the hidden row identity taken from ``row_id``, which is not a data column."""
    sql = VIEWS[name].format(**SPARK_DIALECT)
    source = sql.rsplit("FROM ", 1)[1].strip()
    frame = read(spark, folder, source)
    derived = spark.sql(sql.replace(f"FROM {source}", "FROM {source}"), source=frame)
    return identified(derived, "row_id").drop("row_id")


def table(spark: SparkSession, folder: str, name: str) -> Table:
    return Table(view(spark, folder, name), name)


def with_views(body: str, *names: str) -> str:
    """DuckDB SQL with the named derived views in front; the body continues the WITH list or starts SELECT."""
    parts = ", ".join(f"{name} AS ({VIEWS[name].format(**DUCKDB_DIALECT)})" for name in names)
    return f"WITH {parts}{body if body.lstrip().startswith(',') else ' ' + body}"


def strip_sql(column: str) -> str:
    return STRIP.format(c=column)


def number_sql(text: str) -> str:
    """The number grammar of the cleaning steps on an already stripped text."""
    return f"CASE WHEN regexp_matches({text}, '{NUMBER}') AND isfinite(TRY_CAST({text} AS DOUBLE)) THEN TRY_CAST({text} AS DOUBLE) END"
