"""Cleaning steps over tables with defects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.names import ROW_ID, q
from tabwright.operators.cleaning import cast_expression
from tabwright.operators.comparison import changed_cells, invalid_casts
from tabwright.plans.pipeline import run_pipeline
from tabwright.queries.views import number_sql, strip_sql, table, view, with_views

ORDER_COLUMNS = ("cust_id", "price", "price_text", "priority", "day_text", "status")

CLEANING_STEPS = [
    {"op": "fill_missing", "columns": ["priority"], "strategy": "constant", "value": "none"},
    {"op": "outliers", "columns": ["price"], "method": "missing", "factor": 3.0},
    {"op": "normalize_text", "columns": ["priority", "status"], "case": "upper"},
    {"op": "cast", "columns": ["price_text"], "dtype": "numeric", "decimal": ",", "errors": "coerce"},
    {"op": "drop_duplicates", "columns": ["cust_id", "priority"], "keep": "last"},
    {"op": "cast", "columns": ["day_text"], "dtype": "datetime", "format": "%d/%m/%Y", "errors": "coerce"},
    {"op": "drop_missing", "columns": ["day_text"], "how": "any"},
    {"op": "fill_missing", "columns": ["price"], "strategy": "mean"},
]


def shown(result: DataFrame) -> DataFrame:
    """Result rows with the identity visible, doubles rounded."""
    out = [q(ROW_ID).alias("row_id")]
    for field in result.schema.fields:
        if field.name == ROW_ID:
            continue
        column = q(field.name)
        out.append((F.round(column, 6) if field.dataType.simpleString() == "double" else column).alias(field.name))
    return result.select(*out)


def steps(view_name: str, *step_list: dict, columns: tuple[str, ...] | None = None):
    def run(spark, folder):
        result = run_pipeline(table(spark, folder, view_name), {"steps": list(step_list)})
        out = shown(result.df)
        return out if columns is None else out.select("row_id", *columns)

    return run


def order_sql(columns: str, tail: str = "") -> str:
    return with_views(f"SELECT row_id, {columns} FROM dirty_orders {tail}", "dirty_orders")


QUERIES, SQL = {}, {}


def register(name, run, sql):
    QUERIES[name] = run
    SQL[name] = sql


PRIORITY = strip_sql("priority")
PRICE_NUMBER = number_sql(f"replace({strip_sql('price_text')}, ',', '.')")
PLAIN_NUMBER = number_sql(strip_sql("price_text"))

for _case, _wrap in (("keep", "{}"), ("lower", "lower({})"), ("upper", "upper({})"), ("casefold", "lower({})")):
    register(
        f"normalize_text_{'trim' if _case == 'keep' else _case}",
        steps(
            "dirty_orders",
            {"op": "normalize_text", "columns": ["priority"], "case": _case, "empty_as_missing": False},
            columns=("priority",),
        ),
        order_sql(f"{_wrap.format(PRIORITY)} AS priority"),
    )

register(
    "normalize_text_empty",
    steps("dirty_orders", {"op": "normalize_text", "columns": ["priority"]}, columns=("priority",)),
    order_sql(f"nullif({PRIORITY}, '') AS priority"),
)
register(
    "replace_values",
    steps(
        "dirty_orders",
        {"op": "replace_values", "columns": ["status", "priority"], "mapping": {"F": "final", "O": None, "": "blank"}},
        columns=("status", "priority"),
    ),
    order_sql(
        "CASE status WHEN 'F' THEN 'final' WHEN 'O' THEN NULL ELSE status END AS status, "
        "CASE priority WHEN '' THEN 'blank' ELSE priority END AS priority"
    ),
)
register(
    "cast_numeric",
    steps("dirty_orders", {"op": "cast", "columns": ["price_text"], "errors": "coerce"}, columns=("price_text",)),
    order_sql(f"round({PLAIN_NUMBER}, 6) AS price_text"),
)
register(
    "cast_numeric_locale",
    steps(
        "dirty_orders",
        {"op": "cast", "columns": ["price_text"], "errors": "coerce", "decimal": ",", "thousands": "."},
        columns=("price_text",),
    ),
    order_sql(f"round({PRICE_NUMBER}, 6) AS price_text"),
)
register(
    "cast_datetime",
    steps(
        "dirty_orders",
        {"op": "cast", "columns": ["day_text"], "dtype": "datetime", "format": "%d/%m/%Y", "errors": "coerce"},
        columns=("day_text",),
    ),
    order_sql("try_strptime(day_text, '%d/%m/%Y') AS day_text"),
)
register(
    "cast_string",
    steps("dirty_orders", {"op": "cast", "columns": ["cust_id"], "dtype": "string"}, columns=("cust_id",)),
    order_sql("CAST(cust_id AS VARCHAR) AS cust_id"),
)


def _invalid_report(spark, folder):
    frame = view(spark, folder, "dirty_orders")
    text = frame.schema["price_text"].dataType
    return invalid_casts(
        frame,
        {
            "price_text": cast_expression(q("price_text"), text, "numeric", decimal=","),
            "day_text": cast_expression(q("day_text"), text, "datetime", "%d/%m/%Y"),
            "priority": cast_expression(q("priority"), text, "numeric"),
        },
    )


register(
    "cast_invalid_report",
    _invalid_report,
    with_views(
        f"""
        SELECT 'price_text' AS "column", count(*) FILTER (price_text IS NOT NULL AND ({PRICE_NUMBER}) IS NULL) AS invalid FROM dirty_orders
        UNION ALL SELECT 'day_text', count(*) FILTER (day_text IS NOT NULL AND try_strptime(day_text, '%d/%m/%Y') IS NULL) FROM dirty_orders
        UNION ALL SELECT 'priority', count(*) FILTER (priority IS NOT NULL AND ({number_sql(PRIORITY)}) IS NULL) FROM dirty_orders""",
        "dirty_orders",
    ),
)

for _strategy, _stat in (("median", "quantile_cont(price, 0.5)"), ("mean", "avg(price)")):
    register(
        f"fill_{_strategy}",
        steps("dirty_orders", {"op": "fill_missing", "columns": ["price"], "strategy": _strategy}, columns=("price",)),
        order_sql(f"round(coalesce(price, (SELECT {_stat} FROM dirty_orders)), 6) AS price"),
    )
register(
    "fill_mode",
    steps("dirty_orders", {"op": "fill_missing", "columns": ["priority"], "strategy": "mode"}, columns=("priority",)),
    order_sql(
        "coalesce(priority, (SELECT priority FROM dirty_orders WHERE priority IS NOT NULL "
        "GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)) AS priority"
    ),
)
register(
    "fill_constant",
    steps(
        "dirty_orders",
        {"op": "fill_missing", "columns": ["price"], "strategy": "constant", "value": -1},
        {"op": "fill_missing", "columns": ["priority"], "strategy": "constant", "value": "none"},
        columns=("price", "priority"),
    ),
    order_sql("round(coalesce(price, -1), 6) AS price, coalesce(priority, 'none') AS priority"),
)
register(
    "drop_missing_any",
    steps("dirty_orders", {"op": "drop_missing", "columns": []}, columns=("price", "priority")),
    order_sql("round(price, 6) AS price, priority", "WHERE price IS NOT NULL AND priority IS NOT NULL"),
)
register(
    "drop_missing_all",
    steps("dirty_orders", {"op": "drop_missing", "columns": ["price", "priority"], "how": "all"}, columns=("price", "priority")),
    order_sql("round(price, 6) AS price, priority", "WHERE price IS NOT NULL OR priority IS NOT NULL"),
)

for _keep, _pick in (("first", "row_id = lo"), ("last", "row_id = hi")):
    register(
        f"dedupe_{_keep}",
        steps("dirty_dups", {"op": "drop_duplicates", "columns": ["status", "priority", "k"], "keep": _keep}),
        with_views(
            f"""
            SELECT row_id, k, status, priority FROM (
              SELECT *, min(row_id) OVER w AS lo, max(row_id) OVER w AS hi, count(*) OVER w AS n FROM dirty_dups
              WINDOW w AS (PARTITION BY k, status, priority)) WHERE {_pick}""",
            "dirty_dups",
        ),
    )
register(
    "dedupe_none",
    steps("dirty_orders", {"op": "drop_duplicates", "columns": ["cust_id", "priority"], "keep": False}, columns=("cust_id", "priority")),
    with_views(
        "SELECT min(row_id) AS row_id, cust_id, priority FROM dirty_orders GROUP BY cust_id, priority HAVING count(*) = 1",
        "dirty_orders",
    ),
)
register(
    "drop_columns",
    steps("dirty_orders", {"op": "drop_columns", "columns": ["price", "price_text", "day_text"]}),
    order_sql("cust_id, priority, status"),
)

FENCES = """SELECT quantile_cont(price, 0.25) - 1.5 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) AS lo,
 quantile_cont(price, 0.75) + 1.5 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) AS hi FROM dirty_orders"""
for _method, _value, _where in (
    ("clip", "round(CASE WHEN price < lo THEN lo WHEN price > hi THEN hi ELSE price END, 6)", ""),
    ("missing", "round(CASE WHEN price >= lo AND price <= hi THEN price END, 6)", ""),
    ("drop", "round(price, 6)", "WHERE price IS NULL OR (price >= lo AND price <= hi)"),
):
    register(
        f"outliers_{_method}",
        steps("dirty_orders", {"op": "outliers", "columns": ["price"], "method": _method}, columns=("price",)),
        with_views(f", f AS ({FENCES}) SELECT row_id, {_value} AS price FROM dirty_orders, f {_where}", "dirty_orders"),
    )


def _sequential(spark, folder):
    frame = view(spark, folder, "dirty_orders").withColumn("spread", F.col("price") * (F.col("cust_id") % 7))
    result = run_pipeline(frame, {"steps": [{"op": "outliers", "columns": ["price", "spread"], "method": "drop"}]})
    return shown(result.df).select("row_id", "price", "spread")


_QUARTER = "quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3"
_INSIDE = "({c} IS NULL OR ({c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1)))"
register(
    "outliers_drop_sequential",
    _sequential,
    with_views(
        f""", a AS (SELECT row_id, price, price * (cust_id % 7) AS spread FROM dirty_orders),
        fa AS (SELECT {_QUARTER.format(c='price')} FROM a),
        b AS (SELECT a.* FROM a, fa WHERE {_INSIDE.format(c='price')}),
        fb AS (SELECT {_QUARTER.format(c='spread')} FROM b)
        SELECT row_id, round(price, 6) AS price, round(spread, 6) AS spread FROM b, fb WHERE {_INSIDE.format(c='spread')}""",
        "dirty_orders",
    ),
)
register(
    "range_missing",
    steps("dirty_orders", {"op": "range", "columns": ["price"], "min": 10000, "max": 300000}, columns=("price",)),
    order_sql("round(CASE WHEN price BETWEEN 10000 AND 300000 THEN price END, 6) AS price"),
)
register(
    "range_drop",
    steps("dirty_orders", {"op": "range", "columns": ["price"], "min": 10000, "action": "drop"}, columns=("price",)),
    order_sql("round(price, 6) AS price", "WHERE price IS NULL OR price >= 10000"),
)

# The run, spelled out step by step.
RUN_CTES = f""",
 s1 AS (SELECT * REPLACE (coalesce(priority, 'none') AS priority) FROM dirty_orders),
 f AS (SELECT {_QUARTER.format(c='price')} FROM s1),
 s2 AS (SELECT s1.* REPLACE (CASE WHEN price BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1) THEN price END AS price) FROM s1, f),
 s3 AS (SELECT * REPLACE (nullif(upper({PRIORITY}), '') AS priority, nullif(upper({strip_sql('status')}), '') AS status) FROM s2),
 s4 AS (SELECT * REPLACE ({PRICE_NUMBER} AS price_text) FROM s3),
 s5 AS (SELECT * FROM s4 QUALIFY row_number() OVER (PARTITION BY cust_id, priority ORDER BY row_id DESC) = 1),
 s6 AS (SELECT * REPLACE (try_strptime(day_text, '%d/%m/%Y') AS day_text) FROM s5),
 s7 AS (SELECT * FROM s6 WHERE day_text IS NOT NULL),
 s8 AS (SELECT * REPLACE (coalesce(price, (SELECT avg(price) FROM s7)) AS price) FROM s7)"""


def _cleaning_run(spark, folder):
    return shown(run_pipeline(table(spark, folder, "dirty_orders"), {"steps": CLEANING_STEPS}).df)


register(
    "cleaning_run",
    _cleaning_run,
    with_views(
        RUN_CTES + " SELECT row_id, cust_id, round(price, 6) AS price, round(price_text, 6) AS price_text, priority, day_text, status FROM s8",
        "dirty_orders",
    ),
)


def _cleaning_log(spark, folder):
    result = run_pipeline(table(spark, folder, "dirty_orders"), {"steps": CLEANING_STEPS})
    return result.log_table(spark).select(
        "step", "operation", "rows_before", "rows_after", "removed_rows", "changed_cells_retained", "missing_before", "missing_after"
    )


def _log_sql() -> str:
    operations = [step["op"] for step in CLEANING_STEPS]
    names = ["dirty_orders"] + [f"s{i}" for i in range(1, len(CLEANING_STEPS) + 1)]
    missing = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in ORDER_COLUMNS)
    price = "a.price IS DISTINCT FROM b.price"
    # Cells compare by value when both are numbers, by text otherwise.
    changed = {
        1: "a.priority IS DISTINCT FROM b.priority",
        2: price,
        3: "a.priority IS DISTINCT FROM b.priority",
        4: "a.price_text IS DISTINCT FROM b.price_text::VARCHAR",
        5: "false",
        6: "a.day_text IS DISTINCT FROM (strftime(b.day_text, '%Y-%m-%d %H:%M:%S') || '+00:00')",
        7: "false",
        8: price,
    }
    extra = {3: " + count(*) FILTER (a.status IS DISTINCT FROM b.status)"}
    selects = []
    for i in range(1, len(names)):
        before, after = names[i - 1], names[i]
        selects.append(
            f"""SELECT {i} AS step, '{operations[i - 1]}' AS operation,
            (SELECT count(*) FROM {before}) AS rows_before, (SELECT count(*) FROM {after}) AS rows_after,
            (SELECT count(*) FROM {before}) - (SELECT count(*) FROM {after}) AS removed_rows,
            (SELECT count(*) FILTER ({changed[i]}){extra.get(i, '')} FROM {before} a JOIN {after} b USING (row_id)) AS changed_cells_retained,
            (SELECT {missing} FROM {before}) AS missing_before, (SELECT {missing} FROM {after}) AS missing_after"""
        )
    return with_views(RUN_CTES + " " + " UNION ALL ".join(selects), "dirty_orders")


register("cleaning_log", _cleaning_log, _log_sql())


def _changed_cells(spark, folder):
    before = view(spark, folder, "dirty_orders")
    after = run_pipeline(
        before,
        {
            "steps": [
                {"op": "range", "columns": ["price"], "min": 5000, "action": "drop"},
                {"op": "normalize_text", "columns": ["priority"], "case": "upper"},
                {"op": "cast", "columns": ["cust_id"], "dtype": "numeric"},
                {"op": "outliers", "columns": ["price"], "method": "missing"},
                {"op": "drop_columns", "columns": ["status"]},
            ]
        },
    ).df
    return changed_cells(before, after)


register(
    "changed_cells",
    _changed_cells,
    with_views(
        f""", a AS (SELECT * FROM dirty_orders WHERE price IS NULL OR price >= 5000), f AS (SELECT {_QUARTER.format(c='price')} FROM a),
        b AS (SELECT a.* REPLACE (nullif(upper({PRIORITY}), '') AS priority,
              CASE WHEN {_INSIDE.format(c='price')} THEN price END AS price) FROM a, f)
        SELECT 'cust_id' AS "column", count(*) FILTER (a.cust_id IS DISTINCT FROM b.cust_id) AS changed FROM a JOIN b USING (row_id)
        UNION ALL SELECT 'price', count(*) FILTER (a.price IS DISTINCT FROM b.price) FROM a JOIN b USING (row_id)
        UNION ALL SELECT 'price_text', count(*) FILTER (a.price_text IS DISTINCT FROM b.price_text) FROM a JOIN b USING (row_id)
        UNION ALL SELECT 'priority', count(*) FILTER (a.priority IS DISTINCT FROM b.priority) FROM a JOIN b USING (row_id)
        UNION ALL SELECT 'day_text', count(*) FILTER (a.day_text IS DISTINCT FROM b.day_text) FROM a JOIN b USING (row_id)""",
        "dirty_orders",
    ),
)


def _preview(spark, folder):
    result = run_pipeline(table(spark, folder, "dirty_orders"), {"steps": CLEANING_STEPS[:4]})
    return shown(result.df.orderBy(q(ROW_ID)).limit(100))


register(
    "preview",
    _preview,
    with_views(
        RUN_CTES + " SELECT row_id, cust_id, round(price, 6) AS price, round(price_text, 6) AS price_text, priority, day_text, status "
        "FROM s4 ORDER BY row_id LIMIT 100",
        "dirty_orders",
    ),
)
