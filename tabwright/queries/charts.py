"""Chart aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators import charts
from tabwright.operators.counts import category_counts, daily_counts
from tabwright.plans.pipeline import run_pipeline
from tabwright.plans.report import report
from tabwright.queries.cleaning import CLEANING_STEPS, ORDER_COLUMNS, RUN_CTES
from tabwright.queries.profiling import LINE_NUMBERS, ORDER_ROLES, lines
from tabwright.queries.views import read, view, with_views
from tabwright.sources.table import identified

QUERIES, SQL = {}, {}


def register(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def rounded(frame, *columns):
    return frame.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in frame.columns])


register(
    "missing_rates",
    lambda spark, folder: rounded(charts.missing_rates(view(spark, folder, "dirty_orders")), "rate"),
    with_views(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*)::DOUBLE * 100, 6) AS rate FROM dirty_orders"""
            for c in ORDER_COLUMNS
        ),
        "dirty_orders",
    ),
)


def binned_sql(column: str, source: str, bins: str | None = None, phases: bool = False) -> str:
    """One histogram, by the same edge rule: equal steps from the minimum, last bin closed."""
    bins = bins or "least(60, greatest(1, ceil(sqrt(count(v)))))::INT"
    phase = "phase, " if phases else ""
    phase_join = " AND c.phase = p.phase" if phases else ""
    phase_from = ", (VALUES ('before'), ('after')) AS p(phase)" if phases else ""
    label = "p.phase" if phases else f"""'{column}' AS "column\""""
    return f"""SELECT {label}, k::INT AS bin, round(k * step + lo, 6) AS low,
      round(CASE WHEN k = bins - 1 THEN hi ELSE (k + 1) * step + lo END, 6) AS high, coalesce(n, 0) AS n
    FROM (SELECT *, (hi - lo) / bins AS step FROM (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
           CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi, {bins} AS bins FROM {source}))
      , range(60) AS g(k){phase_from}
      LEFT JOIN (
        SELECT {phase}bin, count(*) AS n FROM (
          SELECT {phase}guess + CASE WHEN v < guess * step + lo THEN -1 WHEN v >= (guess + 1) * step + lo AND guess < bins - 1 THEN 1 ELSE 0 END AS bin
          FROM (SELECT {phase}v, lo, step, bins, least(floor((v - lo) / (hi - lo) * bins)::INT, bins - 1) AS guess
                FROM {source}, (SELECT *, (hi - lo) / bins AS step FROM (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
                  CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi, {bins} AS bins FROM {source})) WHERE v IS NOT NULL))
        GROUP BY {phase}bin) c ON c.bin = k{phase_join}
    WHERE k < bins"""


register(
    "histogram",
    lambda spark, folder: rounded(
        charts.histogram(lines(spark, folder), LINE_NUMBERS).unionAll(
            charts.histogram(view(spark, folder, "dirty_orders"), ["price", "cust_id"])
        ),
        "low", "high",
    ),
    with_views(
        "".join(f", h_{c} AS (SELECT {c} AS v FROM lineitem)" for c in LINE_NUMBERS)
        + "".join(f", h_{c} AS (SELECT {c}::DOUBLE AS v FROM dirty_orders)" for c in ("price", "cust_id"))
        + " "
        + " UNION ALL ".join(binned_sql(c, f"h_{c}") for c in (*LINE_NUMBERS, "price", "cust_id")),
        "dirty_orders",
    ),
)
register(
    "daily_counts",
    lambda spark, folder: daily_counts(read(spark, folder, "events"), "ts"),
    "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1",
)
register(
    "category_counts",
    lambda spark, folder: category_counts(view(spark, folder, "dirty_orders"), "priority"),
    with_views("SELECT priority AS value, count(*) AS n FROM dirty_orders WHERE priority IS NOT NULL GROUP BY priority", "dirty_orders"),
)
register(
    "box_stats",
    lambda spark, folder: rounded(
        charts.box_stats(
            lines(spark, folder).withColumn("squared", F.col("l_extendedprice") * F.col("l_extendedprice")), [*LINE_NUMBERS, "squared"]
        ),
        "q1", "median", "q3", "lower", "upper",
    ),
    "WITH t AS (SELECT *, l_extendedprice * l_extendedprice AS squared FROM lineitem) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median, round(any_value(q3), 6) AS q3,
        round(min({c}) FILTER ({c} >= q1 - 1.5 * (q3 - q1)), 6) AS lower, round(max({c}) FILTER ({c} <= q3 + 1.5 * (q3 - q1)), 6) AS upper
        FROM t, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM t)"""
        for c in (*LINE_NUMBERS, "squared")
    ),
)
register(
    "scatter_pairs",
    lambda spark, folder: rounded(charts.scatter_pairs(view(spark, folder, "learn"), "amount", "visits"), "x", "y"),
    with_views(
        "SELECT round(amount, 6) AS x, round(TRY_CAST(visits AS DOUBLE), 6) AS y FROM learn WHERE amount IS NOT NULL AND TRY_CAST(visits AS DOUBLE) IS NOT NULL",
        "learn",
    ),
)


def _compare(spark, folder):
    before = view(spark, folder, "dirty_orders")
    after = run_pipeline(before, {"steps": CLEANING_STEPS}).df
    return rounded(charts.compare_histogram(before, after, "price"), "low", "high")


register(
    "compare_histogram",
    _compare,
    with_views(
        f"""{RUN_CTES}, u AS (SELECT 'before' AS phase, price AS v FROM dirty_orders UNION ALL SELECT 'after', price FROM s8)
        {binned_sql('price', 'u', '30', True)}""",
        "dirty_orders",
    ),
)


def _report(spark, folder):
    before = view(spark, folder, "dirty_orders")
    result = run_pipeline(before, {"steps": CLEANING_STEPS, "roles": ORDER_ROLES})
    tables = report(identified(before), result).tables
    counted = [
        table.agg(F.count("*").alias("rows")).select(F.lit(phase).alias("phase"), F.lit(name).alias("table"), "rows")
        for phase, group in tables.items()
        for name, table in group.items()
    ]
    return reduce(DataFrame.unionAll, counted)


def _report_sql() -> str:
    parts = []

    def add(phase, table, *values):
        parts.append(f"""SELECT '{phase}' AS phase, '{table}' AS "table", ({' + '.join(f'({v})' for v in values)})::BIGINT AS rows""")

    def distinct(source, *columns):
        return [f"SELECT count(DISTINCT {c}) FROM {source}" for c in columns]

    def bins(source, *columns):
        return [f"SELECT least(60, greatest(1, ceil(sqrt(count({c}))))) FROM {source}" for c in columns]

    for phase, source in (("before", "dirty_orders"), ("after", "s8")):
        add(phase, "missing", "SELECT 6")
    add("before", "numeric", *bins("dirty_orders", "price"))
    add("before", "category", *distinct("dirty_orders", "price_text", "priority", "day_text", "status"))
    add("after", "correlation", "SELECT 3")
    add("after", "numeric", *bins("s8", "price", "price_text"))
    add("after", "category", *distinct("s8", "priority", "status"))
    add("after", "datetime", *distinct("s8", "day_text"))
    add("comparison", "numeric", "SELECT 60")
    return with_views(f"{RUN_CTES} {' UNION ALL '.join(parts)}", "dirty_orders")


register("report_tables", _report, _report_sql())
