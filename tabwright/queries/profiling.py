"""Profiles, frequency tables and quality findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.functions.names import q
from tabwright.operators.counts import duplicate_rows, top_values, value_counts
from tabwright.operators.profile import Profile, compare_profiles, infer_roles
from tabwright.operators.roles import roles_after
from tabwright.plans.pipeline import run_pipeline
from tabwright.queries.cleaning import CLEANING_STEPS, ORDER_COLUMNS, RUN_CTES
from tabwright.queries.views import NUMBER, read, strip_sql, view, with_views
from tabwright.sources.table import identified

QUERIES, SQL = {}, {}
LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
ORDER_ROLES = {"cust_id": "id", "price_text": "text", "priority": "category", "day_text": "datetime"}


def register(name, run, sql):
    QUERIES[name] = run
    SQL[name] = sql


def lines(spark, folder, *extra):
    frame = read(spark, folder, "lineitem")
    return frame.select(*[q(name) for name in (*LINE_NUMBERS, *extra)])


def _profile(spark, folder):
    return Profile(view(spark, folder, "dirty_orders"), ORDER_ROLES)


def _rows(spark, rows, schema, doubles=()):
    frame = spark.createDataFrame(rows, schema)
    return frame.select(*[F.round(c, 6).alias(c) if c in doubles else F.col(c) for c in frame.columns])


def _null_sum(columns):
    return " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in columns)


def overview_sql(source: str, columns, key: str = "") -> str:
    listed = ", ".join(columns)
    return (
        f"SELECT {key}count(*) AS rows, {len(columns)} AS columns, count(*) * {len(columns)} AS cells, "
        f"{_null_sum(columns)} AS missing_cells, "
        f"round(100.0 * ({_null_sum(columns)}) / greatest(count(*) * {len(columns)}, 1), 6) AS missing_pct, "
        f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT {listed} FROM {source})) AS duplicate_rows FROM {source}"
    )


register(
    "profile_overview",
    lambda spark, folder: _rows(
        spark,
        [_profile(spark, folder).overview],
        "rows bigint, columns int, cells bigint, missing_cells bigint, missing_pct double, duplicate_rows bigint",
        ["missing_pct"],
    ),
    with_views(overview_sql("dirty_orders", ORDER_COLUMNS), "dirty_orders"),
)
register(
    "duplicate_rows",
    lambda spark, folder: duplicate_rows(view(spark, folder, "dirty_dups"), ["k", "status", "priority"]),
    with_views(
        "SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT k, status, priority FROM dirty_dups)) AS duplicate_rows "
        "FROM dirty_dups",
        "dirty_dups",
    ),
)


def _column_sql() -> str:
    roles = {"cust_id": "id", "price": "numeric", "price_text": "text", "priority": "category", "day_text": "datetime", "status": "category"}
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{role}' AS role, count({c}) AS valid, count(*) - count({c}) AS missing,
        round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_pct, count(DISTINCT {c}) AS "unique" FROM dirty_orders"""
        for c, role in roles.items()
    )


register(
    "profile_columns",
    lambda spark, folder: _rows(
        spark,
        [{k: v for k, v in entry.items() if k != "dtype"} for entry in _profile(spark, folder).columns],
        "column string, role string, valid bigint, missing bigint, missing_pct double, unique bigint",
        ["missing_pct"],
    ),
    with_views(_column_sql(), "dirty_orders"),
)

_STATS = ("mean", "std", "min", "q1", "median", "q3", "max")
register(
    "profile_numeric",
    lambda spark, folder: _rows(
        spark,
        Profile(identified(lines(spark, folder))).numeric,
        "column string, count bigint, " + ", ".join(f"{s} double" for s in _STATS),
        _STATS,
    ),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median,
        round(quantile_cont({c}, 0.75), 6) AS q3, round(max({c}), 6) AS max FROM lineitem"""
        for c in LINE_NUMBERS
    ),
)


def _outliers(spark, folder):
    frame = lines(spark, folder).select(
        *[q(c) for c in LINE_NUMBERS], (F.col("l_extendedprice") * F.col("l_extendedprice")).alias("squared")
    )
    found = Profile(identified(frame)).outliers
    return _rows(
        spark,
        [(name, bounds[0], bounds[1], count) for name, (bounds, count) in found.items()],
        "column string, low double, high double, outliers bigint",
        ["low", "high"],
    )


register(
    "iqr_outliers",
    _outliers,
    "WITH t AS (SELECT *, l_extendedprice * l_extendedprice AS squared FROM lineitem) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(any_value(q1) - 1.5 * (any_value(q3) - any_value(q1)), 6) AS low,
        round(any_value(q3) + 1.5 * (any_value(q3) - any_value(q1)), 6) AS high,
        count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM t, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM t)"""
        for c in (*LINE_NUMBERS, "squared")
    ),
)


def _dates(spark, folder):
    frame = read(spark, folder, "lineitem").select("l_shipdate")
    return spark.createDataFrame(Profile(identified(frame)).dates, "column string, min timestamp, max timestamp")


register(
    "profile_datetime",
    _dates,
    """SELECT 'l_shipdate' AS "column", min(l_shipdate) AS min, max(l_shipdate) AS max FROM lineitem""",
)
register(
    "value_counts",
    lambda spark, folder: value_counts(view(spark, folder, "dirty_orders"), ["priority", "status", "day_text", "cust_id"]),
    with_views(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM dirty_orders WHERE {c} IS NOT NULL GROUP BY {c}"""
            for c in ("priority", "status", "day_text", "cust_id")
        ),
        "dirty_orders",
    ),
)
register(
    "top_values",
    lambda spark, folder: top_values(value_counts(view(spark, folder, "dirty_orders"), ["priority", "status", "day_text", "price_text"])).select(
        "column", "value", "n", "rank"
    ),
    with_views(
        " UNION ALL ".join(
            f"""SELECT * FROM (SELECT '{c}' AS "column", {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank
            FROM dirty_orders WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 10"""
            for c in ("priority", "status", "day_text", "price_text")
        ),
        "dirty_orders",
    ),
)
register(
    "mean_length",
    lambda spark, folder: _rows(
        spark, list(_profile(spark, folder).mean_lengths.items()), "column string, mean_length double", ["mean_length"]
    ),
    with_views(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", round(avg(length(CAST({c} AS VARCHAR))), 6) AS mean_length FROM dirty_orders"""
            for c in ("cust_id", "price_text", "priority", "status")
        ),
        "dirty_orders",
    ),
)


def _issue_frame(spark, folder):
    """Orders with every kind of finding: repeated rows, a constant, infinities, mixed text."""
    frame = view(spark, folder, "dirty_orders")
    widened = frame.select(
        "_row_id",
        F.when(F.col("cust_id") % 50 != 1, F.col("status")).alias("status"),
        F.when(F.col("cust_id") % 50 == 1, F.lit(1.0)).when(F.col("cust_id") % 50 == 2, F.lit(float("inf")))
        .when(F.col("cust_id") % 50 == 3, F.lit(900.0)).otherwise((F.col("cust_id") % 5).cast("double")).alias("score"),
        F.lit("same").alias("fixed"),
        F.when(F.col("cust_id") % 50 == 4, F.lit("x")).otherwise((F.col("cust_id") % 50).cast("string")).alias("mixed"),
        F.when(F.col("cust_id") % 50 == 5, F.lit(" y ")).otherwise(F.lit("z")).alias("padded"),
        F.lit("01/02/2026").alias("day"),
    )
    return widened


_ISSUE_SQL = """, t AS (SELECT CASE WHEN cust_id % 50 <> 1 THEN status END AS status,
 CASE WHEN cust_id % 50 = 1 THEN 1.0 WHEN cust_id % 50 = 2 THEN 'inf'::DOUBLE WHEN cust_id % 50 = 3 THEN 900.0 ELSE (cust_id % 5)::DOUBLE END AS score,
 'same' AS fixed, CASE WHEN cust_id % 50 = 4 THEN 'x' ELSE (cust_id % 50)::VARCHAR END AS mixed,
 CASE WHEN cust_id % 50 = 5 THEN ' y ' ELSE 'z' END AS padded FROM dirty_orders),
 fin AS (SELECT CASE WHEN isfinite(score) THEN score END AS score FROM t),
 b AS (SELECT quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.75) AS q3 FROM fin)
 SELECT '(table)' AS "column", 'duplicates' AS kind, (SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS count
 UNION ALL SELECT 'status', 'missing', count(*) FILTER (status IS NULL) FROM t
 UNION ALL SELECT 'score', 'invalid_numeric', count(*) FILTER (NOT isfinite(score)) FROM t
 UNION ALL SELECT 'score', 'outliers', count(*) FILTER (score < q1 - 1.5 * (q3 - q1) OR score > q3 + 1.5 * (q3 - q1)) FROM fin, b
 UNION ALL SELECT 'fixed', 'constant', count(fixed) FROM t
 UNION ALL SELECT 'mixed', 'mixed_numeric', count(*) FILTER (mixed = 'x') FROM t
 UNION ALL SELECT 'padded', 'whitespace', count(*) FILTER (padded <> trim(padded)) FROM t
 UNION ALL SELECT 'day', 'constant', count(*) FROM t
 UNION ALL SELECT 'day', 'datetime_unparsed', count(*) FROM t"""


def _issues(spark, folder):
    found = Profile(_issue_frame(spark, folder), {"day": "datetime"}).issues
    return spark.createDataFrame([(i["column"], i["kind"], i["count"]) for i in found], "column string, kind string, count bigint")


register("issues", _issues, with_views(_ISSUE_SQL, "dirty_orders"))


def _infer_roles(spark, folder):
    frame = view(spark, folder, "dirty_orders").withColumnRenamed("day_text", "postal_day")
    roles = infer_roles(frame, {"cust_id": "ignore"})
    return spark.createDataFrame(list(roles.items()), "column string, role string")


_ROLE = "CASE WHEN count(DISTINCT {c}) <= 30 OR count(DISTINCT {c}) / count(*)::DOUBLE < 0.05 THEN 'category' ELSE 'text' END"
register(
    "infer_roles",
    _infer_roles,
    with_views(
        f"""SELECT 'cust_id' AS "column", 'ignore' AS role UNION ALL SELECT 'price', 'numeric' UNION ALL SELECT 'postal_day', 'id'
        UNION ALL SELECT 'price_text', {_ROLE.format(c='price_text')} FROM dirty_orders
        UNION ALL SELECT 'priority', {_ROLE.format(c='priority')} FROM dirty_orders
        UNION ALL SELECT 'status', {_ROLE.format(c='status')} FROM dirty_orders""",
        "dirty_orders",
    ),
)


def _versions(spark, folder):
    """Profiles of the orders before and after cleaning."""
    before = _profile(spark, folder)
    after = run_pipeline(before.df, {"steps": CLEANING_STEPS}).df
    return before, Profile(after, roles_after(before.roles, after.columns, CLEANING_STEPS))


def _compare(spark, folder):
    rows = compare_profiles(*_versions(spark, folder))
    return _rows(
        spark, rows, "metric string, before double, after double, difference double", ["before", "after", "difference"]
    )


def _compare_sql() -> str:
    metrics = ("rows", "columns", "cells", "missing_cells", "missing_pct", "duplicate_rows")
    picks = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(a.{m}::DOUBLE, 6) AS before, round(b.{m}::DOUBLE, 6) AS after, "
        f"round(b.{m}::DOUBLE - a.{m}::DOUBLE, 6) AS difference FROM a, b"
        for m in metrics
    )
    plain = lambda source: overview_sql(source, ORDER_COLUMNS).replace("round(100.0", "(100.0").replace(", 1), 6)", ", 1))")
    return with_views(f"{RUN_CTES}, a AS ({plain('dirty_orders')}), b AS ({plain('s8')}) {picks}", "dirty_orders")


register("compare_profiles", _compare, _compare_sql())


def _issues_after(spark, folder):
    before, after = _versions(spark, folder)
    rows = [
        (phase, i["column"], i["kind"], i["count"])
        for phase, profile in (("before", before), ("after", after))
        for i in profile.issues
    ]
    return spark.createDataFrame(rows, "phase string, column string, kind string, count bigint")


def _issues_after_sql() -> str:
    def fences(source, column):
        return (
            f"(SELECT count(*) FILTER ({column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1)) FROM {source}, "
            f"(SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {source}))"
        )

    found = []

    def add(phase, column, kind, value):
        found.append(f"""SELECT '{phase}' AS phase, '{column}' AS "column", '{kind}' AS kind, ({value}) AS count""")

    for phase, source in (("before", "dirty_orders"), ("after", "s8")):
        add(phase, "(table)", "duplicates", f"(SELECT count(*) FROM {source}) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(ORDER_COLUMNS)} FROM {source}))")
        for column in ORDER_COLUMNS:
            add(phase, column, "missing", f"SELECT count(*) FILTER ({column} IS NULL) FROM {source}")
        add(phase, "price", "outliers", fences(source, "price"))
    add("after", "price_text", "outliers", fences("s8", "price_text"))
    add("before", "day_text", "datetime_unparsed", "SELECT count(day_text) FROM dirty_orders")
    for column in ("price_text", "priority"):
        add("before", column, "whitespace", f"SELECT count(*) FILTER ({column} <> {strip_sql(column)}) FROM dirty_orders")
    return with_views(f"{RUN_CTES} SELECT * FROM ({' UNION ALL '.join(found)}) WHERE count > 0", "dirty_orders")


register("issues_after", _issues_after, _issues_after_sql())
