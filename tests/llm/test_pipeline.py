"""The pipeline: each stage's decision on its own input, and every id of what remains."""

import re
from pathlib import Path

import pytest
from compare import database, difference

import corpus_pipeline
from tabwright.llm.queries import QUERIES, SQL
from tabwright.session import Scratch


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, data, name):
    if name in SQL:
        assert difference(spark, database(data), QUERIES[name], SQL[name], data) is None
    else:
        assert QUERIES[name](spark, data).count() > 0


def test_stages(spark, docs_of, awkward):
    text = "the quick brown fox and the slow green turtle walk along the river bank every day of the long summer"
    rows = awkward + [
        (20, text, "en"), (21, text + " again", "en"), (22, "漢字" * 500, None), (23, "token = abcdef123456 is in this line of text", "en"),
        (24, "!!! 123", "en"), *((30 + i, f"{text} number {i} of many others\n" * 2, "en") for i in range(20)),
    ]
    docs, scratch, seen = docs_of(rows), Scratch(spark), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = scratch.table(stage(spark, docs, "unused"))
        assert after.columns == docs.columns
        seen[name] = {r.doc_id: r for r in after.collect()}
        docs = after
    assert {22, 24, 1, 2, 3}.isdisjoint(seen["language"]) and {20, 21, 23, 4}.issubset(seen["language"])
    gone = set(seen["language"]) - set(seen["lines"])
    assert {21, *range(31, 50)} <= gone <= {5, 21, *range(31, 50)}
    assert all(r.text and r.text.strip() for r in seen["lines"].values() if r.doc_id not in (None, 1, 2, 3))
    assert seen["lines"][30].text == f"{text} number 0 of many others\n" and seen["lines"][30].n_chars == len(seen["lines"][30].text)
    assert 20 in seen["near_duplicates"] and 5 not in seen["near_duplicates"] and 4 in seen["near_duplicates"]
    assert seen["secrets"][23].text == "[SECRET] is in this line of text"
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "unused")
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_run_covers_what_the_stages_keep(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "secrets", "packing"]


def test_near_duplicates_keep_one_table_and_deal_texts_once(spark, docs_of, awkward):
    rows = awkward + [(None, "a null id with five words or more in it", "en"), (0, "a zero id with five words or more in it", "en"), (None, "a zero id with five words or more in it", "en")]
    docs, folder = docs_of(rows), Path(spark.conf.get("spark.checkpoint.dir"))
    tables, before = lambda: {*folder.glob("run-*/table-*")}, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        there = tables()
        after = corpus_pipeline.near_duplicate_documents(spark, docs, "unused")
        assert len(tables() - there) == 1
        plan = after._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and not re.search(r"Exchange hashpartitioning\([^\n]*own_key", plan.partition("SortMergeJoin")[0])
        kept = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in after.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # "one" stands under 4 and 5, and what id 0 has under a null id, which comes first.
    assert {(i, t) for none, i, t in kept if not none} == {(i, t or "") for i, t, _ in awkward if i not in (None, 5)}
    assert [t for none, _, t in kept if none] == ["", "a null id with five words or more in it", "a zero id with five words or more in it"]
