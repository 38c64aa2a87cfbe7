"""The shape of physical plans: what must not change as the data grows."""

import re

import pytest
from pyspark.sql import functions as F

from tabwright.functions.names import q
from tabwright.operators.cleaning import deduplicate
from tabwright.operators.correlation import average_ranks
from tabwright.operators.counts import top_values, value_counts
from tabwright.operators.profile import Profile
from tabwright.plans.ml_prep import MLConfig, prepare_ml
from tabwright.plans.pipeline import run_pipeline
from tabwright.session import Scratch
from tabwright.sources.load import load
from tabwright.sources.table import identified


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def lines(spark, data):
    frame = spark.read.parquet(f"{data}/lineitem.parquet")
    return identified(frame.withColumn("key", q("l_orderkey") * 8 + q("l_linenumber")), "key")


def test_row_local_steps_are_one_projection_over_pruned_columns(lines):
    steps = [
        {"op": "normalize_text", "columns": ["l_returnflag"], "case": "lower"},
        {"op": "range", "columns": ["l_quantity"], "min": 5, "action": "drop"},
        {"op": "replace_values", "columns": ["l_linestatus"], "mapping": {"O": "open"}},
    ]
    text = plan(run_pipeline(lines, {"steps": steps}).df.select("l_returnflag", "l_linestatus"))
    assert "Exchange" not in text and "*(1)" in text
    columns = set(re.search(r"ReadSchema: struct<(.*)>", text).group(1).split(","))
    assert {c.split(":")[0] for c in columns} == {"l_quantity", "l_returnflag", "l_linestatus"}


def test_duplicates_combine_before_the_shuffle(lines):
    text = plan(deduplicate(lines.select("_row_id", "l_returnflag", "l_linestatus", "l_tax"), ["l_returnflag", "l_linestatus"]))
    assert "partial_min" in text and text.count("Exchange hashpartitioning") == 1
    assert "Window" not in text


def test_top_values_are_limited_inside_each_task(lines):
    text = plan(top_values(value_counts(lines, ["l_returnflag", "l_linestatus"])))
    assert re.search(r"WindowGroupLimit.*Partial", text) and "Expand" not in text


def test_counts_of_a_profile_are_shuffled_once(spark, lines, monkeypatch):
    import pyspark.sql.classic.dataframe as classic

    plans, collect = [], classic.DataFrame.collect

    def spy(self):
        rows = collect(self)
        plans.append(plan(self))
        return rows

    monkeypatch.setattr(classic.DataFrame, "collect", spy)
    assert Profile(lines.select("_row_id", "l_returnflag", "l_linestatus")).top["l_linestatus"]
    assert "ReusedExchange" in plans[-1]


def test_ranks_never_use_one_window_for_the_whole_table(spark, lines):
    ranks = average_ranks(lines.select("l_extendedprice", "l_tax"), ["l_extendedprice", "l_tax"], Scratch(spark), 500)
    text = plan(ranks)
    assert "SinglePartition" not in text and "hashpartitioning(column" in text.replace("`", "")


def test_transform_needs_no_shuffle(lines):
    config = MLConfig("l_extendedprice", ["l_quantity", "l_tax"], ["l_returnflag", "l_linestatus"])
    text = plan(prepare_ml(lines, config).prepared)
    assert "Exchange" not in text and "Join" not in text


def test_text_sources_are_parsed_once(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    spark.range(100).select(F.col("id"), (F.col("id") * 2).alias("v")).write.option("header", True).csv(path)
    table = load(spark, path)
    text = plan(table.df.select("v"))
    assert "FileScan parquet" in text and "csv" not in text.lower().split("location")[0]
    assert table.df.schema["v"].dataType.simpleString() == "bigint"
    table.close()
