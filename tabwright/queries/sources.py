"""Readers: each query writes a supplied table in the format under test and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.functions.names import ROW_ID, q
from tabwright.queries.views import number_sql, read, strip_sql, view, with_views
from tabwright.session import Scratch, configure
from tabwright.sources import infer
from tabwright.sources.json import flatten
from tabwright.sources.load import LoadOptions, bad_records, load, metadata_table, scan

QUERIES, SQL = {}, {}


def register(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _orders_as_text(spark, folder):
    return view(spark, folder, "dirty_orders").withColumnRenamed(ROW_ID, "row_id").select("row_id", "cust_id", "price_text", "priority", "day_text")


def _written(spark, frame, suffix, writer):
    path = Scratch(spark).path("source") + suffix
    writer(frame.write, path)
    return path


def _csv_path(spark, folder):
    return _written(
        spark, _orders_as_text(spark, folder), ".csv",
        lambda w, p: w.options(header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(p),
    )


def _csv_scan(spark, folder):
    table = load(configure(spark), _csv_path(spark, folder), LoadOptions(delimiter=",", missing_tokens=["unknown"]))
    return table.df.select("row_id", "cust_id", "price_text", "priority", "day_text")


register(
    "csv_scan",
    _csv_scan,
    with_views(
        "SELECT CAST(row_id AS VARCHAR) AS row_id, CAST(cust_id AS VARCHAR) AS cust_id, nullif(price_text, 'unknown') AS price_text, "
        "nullif(priority, '') AS priority, day_text FROM dirty_orders",
        "dirty_orders",
    ),
)

def _csv_spanning(spark, folder):
    """Texts with line breaks, as quoted cells of a source that is cut into blocks all the same."""
    docs = read(spark, folder, "documents").select("doc_id", "lang", "text")
    path = _written(spark, docs, ".csv", lambda w, p: w.options(header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(p))
    table = load(configure(spark), path, LoadOptions(delimiter=","))
    return table.df.select(q("doc_id").cast("long").alias("doc_id"), "lang", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


register(
    "csv_spanning_scan",
    _csv_spanning,
    "SELECT doc_id, lang, length(nullif(text, '')) AS chars, md5(nullif(text, '')) AS text_md5 FROM documents",
)

_KIND = "CASE WHEN o_orderkey % 97 = 5 THEN 'short' WHEN o_orderkey % 97 = 6 THEN 'long' WHEN o_orderkey % 97 = 7 THEN 'quote' WHEN o_orderkey % 97 = 8 THEN 'breaks' END"
_BROKEN = "CASE {kind} WHEN 'short' THEN o_orderkey || ',' || o_orderstatus WHEN 'long' THEN o_orderkey || ',x,y,z' WHEN 'quote' THEN o_orderkey || ',\"' || o_orderstatus || '\"x,y' END".format(kind=_KIND)
_REASON = "CASE {kind} WHEN 'quote' THEN 'text follows a closing quote' ELSE 'another number of cells than the header' END".format(kind=_KIND)


def _broken(spark, folder):
    """Records of the wrong width, and with text after a quote, among others some of which span lines."""
    fine = F.concat_ws(",", "o_orderkey", "o_orderstatus", F.when(F.expr(_KIND) == "breaks", F.lit('"a\nb"')).otherwise(F.lit("c")))
    rows = read(spark, folder, "orders").select(F.coalesce(F.expr(_BROKEN), fine).alias("record"))
    # Every part of a CSV folder starts with the header.
    first_of_part = F.monotonically_increasing_id() % (1 << 33) == 0
    headed = rows.select(F.when(first_of_part, F.concat(F.lit("key,status,more\n"), "record")).otherwise(F.col("record")))
    path = _written(spark, headed, ".csv", lambda w, p: w.text(p))
    return bad_records(spark, path, LoadOptions(delimiter=",")).select("record", "reason")


register("csv_bad_rows", _broken, f"SELECT {_BROKEN} AS record, {_REASON} AS reason FROM orders WHERE o_orderkey % 97 IN (5, 6, 7)")


def _jsonl_scan(spark, folder):
    frame = read(spark, folder, "events").select(
        "event_id", F.struct(q("user_id").alias("id"), q("event_type").alias("kind")).alias("user"),
        F.when(q("event_id") % 10 != 3, q("value")).alias("value"), F.array("event_type", F.lit("x")).alias("tags"),
    )
    path = _written(spark, frame, ".jsonl", lambda w, p: w.json(p))
    table = load(configure(spark), path)
    return table.df.select(
        "event_id", q("user.id").alias("user_id"), q("user.kind").alias("kind"), F.round("value", 6).alias("value"), "tags"
    )


register(
    "jsonl_scan",
    _jsonl_scan,
    """SELECT event_id, user_id, event_type AS kind, CASE WHEN event_id % 10 <> 3 THEN round(value, 6) END AS value,
    '["' || event_type || '","x"]' AS tags FROM events""",
)


_INFO = """CASE event_id % 4 WHEN 0 THEN '{}' WHEN 1 THEN concat('{"kind":{},"id":', user_id, '}')
    WHEN 2 THEN concat('{"id":', user_id, ',"kind":{"name":"', event_type, '"},"seen":[{"z":null,"by":', user_id, '},{}]}') ELSE 'null' END"""


def _jsonl_lossless(spark, folder):
    """Objects that are empty in some records, nulls inside arrays, and columns that no schema names beforehand."""
    lines = read(spark, folder, "events").select(F.expr(f"""concat('{{"event_id":', event_id, ',"info":', {_INFO}, '}}')""").alias("value"))
    table = load(configure(spark), _written(spark, lines, ".jsonl", lambda w, p: w.text(p)))
    return table.df.select(*[q(n).alias(n.replace(".", "_")) for n in table.columns])


register(
    "jsonl_lossless",
    _jsonl_lossless,
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{}' END AS info, CASE WHEN event_id % 4 IN (1, 2) THEN user_id END AS info_id,
    CASE WHEN event_id % 4 = 1 THEN '{}' END AS info_kind, CASE WHEN event_id % 4 = 2 THEN event_type END AS info_kind_name,
    CASE WHEN event_id % 4 = 2 THEN '[{"by":' || user_id || ',"z":null},{}]' END AS info_seen FROM events""",
)

_TORN = "CASE WHEN event_id % 89 = 3 THEN concat('[', event_id, ']') WHEN event_id % 89 = 4 THEN concat('{\"event_id\":', event_id) END"


def _jsonl_bad(spark, folder):
    lines = read(spark, folder, "events").select(F.expr(f"coalesce({_TORN}, concat('{{\"event_id\":', event_id, '}}'))").alias("value"))
    return bad_records(spark, _written(spark, lines, ".jsonl", lambda w, p: w.text(p))).select("record", "reason")


register("jsonl_bad_rows", _jsonl_bad, f"SELECT {_TORN} AS record, 'not a JSON object' AS reason FROM events WHERE event_id % 89 IN (3, 4)")


def _json_path_scan(spark, folder):
    orders = read(spark, folder, "orders")
    # Documents of at most 500 records, since keys are unique; one document per line keeps the file splittable.
    record = F.struct(q("o_orderkey").alias("id"), F.struct(q("o_custkey").alias("key")).alias("cust"), q("o_totalprice").alias("price"))
    documents = orders.groupBy(F.floor(q("o_orderkey") / 500).alias("page")).agg(F.collect_list(record).alias("records"))
    path = _written(spark, documents.select(F.struct("records").alias("data")), ".json", lambda w, p: w.json(p))
    table = load(configure(spark), path, LoadOptions(json_path="data.records", multi_line=False))
    return table.df.select("id", q("cust.key").alias("cust"), F.round("price", 6).alias("price"))


register(
    "json_path_scan", _json_path_scan, "SELECT o_orderkey AS id, o_custkey AS cust, round(o_totalprice, 6) AS price FROM orders"
)


def _json_flatten(spark, folder):
    frame = read(spark, folder, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return flatten(frame).select("event_id", q("props.k").alias("k"))


register("json_flatten", _json_flatten, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")


def _array_to_json(spark, folder):
    frame = read(spark, folder, "orders").select("o_orderkey", F.split("o_orderpriority", "-").alias("parts"))
    path = _written(spark, frame, ".parquet", lambda w, p: w.parquet(p))
    return scan(spark, path)


register(
    "array_to_json",
    _array_to_json,
    """SELECT o_orderkey, '["' || array_to_string(string_split(o_orderpriority, '-'), '","') || '"]' AS parts FROM orders""",
)


def _parquet_scan(spark, folder):
    table = load(configure(spark), f"{folder}/orders.parquet", row_id="o_orderkey")
    return table.df.select("o_orderkey", "o_custkey", F.round("o_totalprice", 6).alias("o_totalprice"), "o_orderdate", "o_orderpriority")


register(
    "parquet_scan",
    _parquet_scan,
    "SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice, o_orderdate, o_orderpriority FROM orders",
)


def _missing_tokens(spark, folder):
    frame = view(spark, folder, "dirty_orders").select(q(ROW_ID).alias("row_id"), "price_text", "priority")
    return infer.mark_missing(frame, ["unknown", "1-URGENT"])


register(
    "missing_tokens",
    _missing_tokens,
    with_views(
        "SELECT row_id, nullif(price_text, 'unknown') AS price_text, nullif(nullif(priority, ''), '1-URGENT') AS priority FROM dirty_orders",
        "dirty_orders",
    ),
)


def _infer_numeric(spark, folder):
    frame = view(spark, folder, "dirty_orders").select(
        q(ROW_ID).alias("row_id"),
        F.when(~q("price_text").isin("unknown", "1d"), q("price_text")).alias("amount"),
        q("price_text").alias("mixed"),
        q("cust_id").cast("string").alias("count"),
        F.format_string("%05d", "cust_id").alias("padded"),
        q("cust_id").cast("string").alias("cust_code"),
    )
    result = infer.infer_numbers(frame, ",")
    return result.withColumn("amount", F.round("amount", 6))


register(
    "infer_numeric",
    _infer_numeric,
    with_views(
        f"""SELECT row_id, round({number_sql(f"replace({strip_sql('price_text')}, ',', '.')")}, 6) AS amount, price_text AS mixed,
        cust_id AS count, printf('%05d', cust_id) AS padded, CAST(cust_id AS VARCHAR) AS cust_code FROM dirty_orders""",
        "dirty_orders",
    ),
)


def _row_guard(spark, folder):
    rows = read(spark, folder, "lineitem").count()
    outcomes = []
    for limit in (rows, rows - 1):
        try:
            load(spark, f"{folder}/lineitem.parquet", LoadOptions(max_rows=limit, infer_numeric=False))
            outcomes.append((limit, True))
        except ValueError:
            outcomes.append((limit, False))
    return spark.createDataFrame(outcomes, "row_limit bigint, accepted boolean")


register(
    "row_guard",
    _row_guard,
    "SELECT count(*) AS row_limit, true AS accepted FROM lineitem UNION ALL SELECT count(*) - 1, false FROM lineitem",
)


def _source_metadata(spark, folder):
    table = load(configure(spark), f"{folder}/customer.parquet", row_id="c_custkey")
    found = metadata_table(spark, table)
    return found.select("source", "format", "rows", "columns", "sampled", (F.col("bytes") > 0).alias("has_bytes"))


register(
    "source_metadata",
    _source_metadata,
    "SELECT 'customer.parquet' AS source, 'parquet' AS format, count(*) AS rows, 5 AS columns, false AS sampled, true AS has_bytes FROM customer",
)
