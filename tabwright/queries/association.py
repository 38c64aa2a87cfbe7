"""Correlation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.operators.correlation import correlation, pearson
from tabwright.queries.views import read, view, with_views
from tabwright.sources.table import identified

QUERIES, SQL = {}, {}
COLUMNS = ("price", "amount", "ratio", "flat")


def register(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _frame(spark, folder):
    """Numbers with different gaps and a constant."""
    frame = view(spark, folder, "dirty_orders")
    return frame.select(
        "_row_id",
        "price",
        F.when(F.col("cust_id") % 4 != 1, (F.col("cust_id") % 100).cast("double")).alias("amount"),
        (F.col("price") / (F.col("cust_id") + 1)).alias("ratio"),
        F.lit(3.0).alias("flat"),
        F.col("cust_id").alias("cust_id"),
    )


_T = """, t AS (SELECT price, CASE WHEN cust_id % 4 <> 1 THEN (cust_id % 100)::DOUBLE END AS amount, price / (cust_id + 1) AS ratio,
 3.0::DOUBLE AS flat FROM dirty_orders)"""


def _rounded(frame):
    return frame.select("x", "y", F.round("r", 6).alias("r"), "n")


def _pairs(source: str, ranked: bool) -> str:
    parts = []
    for i, x in enumerate(COLUMNS):
        for y in COLUMNS[i:]:
            rows = f"(SELECT {x}::DOUBLE AS a, {y}::DOUBLE AS b FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
            if ranked:
                rank = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
                rows = f"(SELECT {rank.format(c='a')} AS a, {rank.format(c='b')} AS b FROM {rows})"
            parts.append(
                f"SELECT '{x}' AS x, '{y}' AS y, CASE WHEN count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 "
                f"THEN round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 6) END AS r, count(*) AS n FROM {rows}"
            )
    return " UNION ALL ".join(parts)


for _method in ("pearson", "spearman"):
    register(
        f"corr_{_method}",
        lambda spark, folder, method=_method: _rounded(correlation(_frame(spark, folder), {"cust_id": "id"}, method)),
        with_views(f"{_T} {_pairs('t', _method == 'spearman')}", "dirty_orders"),
    )

WIDE = tuple(f"w{k:02}" for k in range(40))
_WIDE_VALUES = {
    # Gaps of its own in every column; one column of huge values; one whose spread is tiny on the rows it shares with w02.
    **{name: f"CASE WHEN o_orderkey % {k + 3} <> 1 THEN (o_totalprice + o_custkey * {k}) % {97 + k} END" for k, name in enumerate(WIDE)},
    "w01": "o_totalprice * 1e155",
    "w02": "CASE WHEN o_orderkey % 50 = 7 THEN o_totalprice END",
    "w03": "CASE WHEN o_orderkey % 50 = 7 THEN 1.0 + (o_custkey % 100) * 1e-7 ELSE 1000000.0 END",
}


def _wide_sql(kind: str) -> str:
    return "SELECT o_orderkey, " + ", ".join(f"CAST({value} AS DOUBLE) AS {name}" for name, value in _WIDE_VALUES.items()) + f" FROM {kind}"


def _wide(spark, folder):
    read(spark, folder, "orders").createOrReplaceTempView("tabwright_orders")
    return _rounded(pearson(spark.sql(_wide_sql("tabwright_orders")), WIDE))


def _wide_oracle() -> str:
    """Means and co-moments of the shared rows, centred before they are multiplied, huge columns scaled."""
    scaled = ", ".join(f"{name} / {1e155 if name == 'w01' else 1.0} AS {name}" for name in WIDE)
    parts = []
    for i, x in enumerate(WIDE):
        for y in WIDE[i:]:
            both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
            parts.append(
                f"SELECT '{x}' AS x, '{y}' AS y, (SELECT CASE WHEN count(*) >= 3 AND var_pop({x}) > 0 AND var_pop({y}) > 0 "
                f"THEN round(covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})), 6) END FROM t WHERE {both}) AS r, "
                f"(SELECT count(*) FROM t WHERE {both}) AS n"
            )
    return f"WITH w AS ({_wide_sql('orders')}), t AS MATERIALIZED (SELECT {scaled} FROM w) " + " UNION ALL ".join(parts)


register("corr_many_columns", _wide, _wide_oracle())


def _sampled(spark, folder):
    """The sample's size, the table's, and whether its coefficients are near those of all rows."""
    frame = identified(read(spark, folder, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("buyer")), "o_orderkey")
    roles = {"o_orderkey": "id", "o_totalprice": "numeric", "buyer": "numeric"}
    part = correlation(frame, roles, "pearson", max_rows=1000, max_columns=3)
    full = correlation(frame, roles, "pearson").select("x", "y", F.col("r").alias("full_r"), F.col("n").alias("total_rows"))
    near = F.abs(F.col("r") - F.col("full_r")) < 0.2
    return part.join(full, ["x", "y"]).select("x", "y", F.col("n").alias("rows_used"), "total_rows", near.alias("near"))


register(
    "corr_sampled",
    _sampled,
    """SELECT x, y, least(1000, n) AS rows_used, n AS total_rows, true AS near FROM (SELECT count(*) AS n FROM orders),
(VALUES ('o_totalprice', 'o_totalprice'), ('o_totalprice', 'buyer'), ('buyer', 'buyer')) v(x, y)""",
)
