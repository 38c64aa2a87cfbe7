"""JSON lines without loss, and refusals by file and line."""

import json

import pytest

from tabwright import TableError
from tabwright.sources.json import paths_of, shape_of
from tabwright.sources.load import bad_records, load


def rows_of(table):
    return [dict(zip(table.columns, list(r)[1:], strict=True)) for r in table.df.orderBy("_row_id").collect()]


def write(tmp_path, records, name="l.jsonl"):
    path = tmp_path / name
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in records))
    return str(path)


def test_nothing_is_lost(spark, tmp_path):
    records = [
        {"a": {"b": {}}, "c": 1, "e": {}}, {"a": {"b": {"x": 2}}, "c": 2.5, "list": [{"z": None, "k": 1}, {}]}, {"c": None, "list": []},
        {"q'r": True, "it.s": "é\n", "a": {}, "e": {}}, '{"c": 3, "c": 4}', "", '  {"mixed": 1}\r', {"mixed": "x", "gone": None},
    ]
    table = load(spark, write(tmp_path, records))
    assert table.columns == sorted(["a", "a.b", "a.b.x", "c", "e", "gone", "it.s", "list", "mixed", "q'r"])
    found = [{k: v for k, v in r.items() if v is not None} for r in rows_of(table)]
    assert found == [
        {"a.b": "{}", "c": 1.0, "e": "{}"}, {"a.b.x": 2, "c": 2.5, "list": '[{"k":1,"z":null},{}]'}, {"list": "[]"},
        {"q'r": True, "it.s": "é\n", "a": "{}", "e": "{}"}, {"c": 4.0}, {"mixed": "1"}, {"mixed": "x"},
    ]


def test_refusals_have_file_and_line(spark, tmp_path):
    path = write(tmp_path, [{"k": 1}, "", "[2]", {"k": 3}, '{"k": 4', "7"])
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for size in ("6", "128MB"):
        for key in keys:
            spark.conf.set(key, size)
        try:
            assert sorted((r.line, r.record, r.reason) for r in bad_records(spark, path).collect()) == [
                (3, "[2]", "not a JSON object"), (5, '{"k": 4', "not a JSON object"), (6, "7", "not a JSON object"),
            ]
            with pytest.raises(TableError, match=r"l.jsonl, line 3: not a JSON object: \[2\]"):
                load(spark, path)
        finally:
            for key in keys:
                spark.conf.unset(key)


def test_keys_of_nested_cells_are_sorted_from_any_source(spark, tmp_path):
    path = str(tmp_path / "n.parquet")
    spark.sql("SELECT array(named_struct('z', 1, 'a', CAST(NULL AS STRING))) AS v, named_struct('b', 1.5D, 'a', map('y', true, 'x', null)) AS s").write.parquet(path)
    assert [tuple(r)[1:] for r in load(spark, path).df.collect()] == [('[{"a":null,"z":1}]', '{"a":{"x":null,"y":true},"b":1.5}')]


def test_shapes_are_read(spark):
    text = "OBJECT<a: OBJECT<b: OBJECT<>, c: DECIMAL(2,1)>, `x, y>`: ARRAY<OBJECT<`p``>`: BIGINT, q: VOID>>, z: STRING>"
    leaves, inner = paths_of(shape_of(text))
    assert [(".".join(p), k) for p, k in leaves] == [("a.b", "OBJECT"), ("a.c", "DECIMAL(2,1)"), ("x, y>", "ARRAY<OBJECT<`p``>`: BIGINT, q: VOID>>"), ("z", "STRING")]
    assert inner == [("a",)]
