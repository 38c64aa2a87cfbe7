"""Sources and sinks, on a small catalogue of plants and on files with defects."""

import json

import pytest

from tabwright import TableError
from tabwright.plans.job import run_job
from tabwright.plans.ml_prep import MLConfig
from tabwright.sinks.writers import plain, schema_table, write_table
from tabwright.sources.csv import detect_delimiter
from tabwright.sources.load import LoadOptions, bad_records, load

HEAD = ["plant_id", "height", "light", "sown"]
PLANTS = [[f"{k:04}", str(20 + k % 13), ("shade", "SHADE ", "sun")[k % 3], f"{k % 28 + 1}.3.2030"] for k in range(40)]
PLANTS[7][1], PLANTS[11][1], PLANTS[19][3] = "9000", "tall", "30.2.2030"
CATALOGUE = "\n".join(";".join(r) for r in [HEAD, *PLANTS, PLANTS[39]])
CARE = [
    {"op": "normalize_text", "columns": ["light"], "case": "lower"},
    {"op": "drop_duplicates", "columns": []},
    {"op": "cast", "columns": ["height"], "dtype": "numeric", "errors": "coerce"},
    {"op": "outliers", "columns": ["height"], "method": "missing"},
    {"op": "cast", "columns": ["sown"], "dtype": "datetime", "format": "%d.%m.%Y", "errors": "coerce"},
]


@pytest.fixture
def write(tmp_path):
    def to(name, content):
        target = tmp_path / name
        target.parent.mkdir(exist_ok=True, parents=True)
        target.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(target)

    return to


def cells(table):
    return [list(r)[1:] for r in table.df.orderBy("_row_id").collect()]


def kinds(table):
    return dict(table.df.dtypes)


def test_types_of_a_catalogue(spark, write):
    table = load(spark, write("p.csv", CATALOGUE))
    assert table.columns == HEAD and len(cells(table)) == 41 and cells(table)[3] == PLANTS[3]
    assert set(kinds(table).values()) == {"bigint", "string"}  # "tall" keeps heights text, names of ids keep zeros
    assert table.metadata["bytes"] == len(CATALOGUE) and table.metadata["rows"] == 41


@pytest.mark.parametrize(
    "column, want",
    [(["4", " 5 ", ""], "double"), (["4", "5x"], "string"), (["04", "5"], "string"), (["1e2", "inf"], "double"), (["-.5", "+7."], "double")],
)
def test_numbers_are_all_or_none(spark, write, column, want):
    text = "n,rest\n" + "".join(f"{c},-\n" for c in column)
    assert kinds(load(spark, write("n.csv", text)))["n"] in (want, "bigint" if want == "double" else want)


def test_decimal_commas_and_tokens(spark, write):
    path = write("m.csv", "when|amount\nmon|3,75\ntue|-\nwed|1,5")
    table = load(spark, path, LoadOptions(decimal=",", missing_tokens=["-"]))
    assert cells(table) == [["mon", 3.75], ["tue", None], ["wed", 1.5]]


@pytest.mark.parametrize(
    "text",
    ["", "\n\n", "k,k\n1,2\n", "k,\n1,2\n", "k,v\n", "k,v\n1\n", "k,v\n1,2,3\n", 'k,v\n1,"two"three\n', '"k"x,v\n1,2\n'],
)
def test_defects_are_refused(spark, write, text):
    with pytest.raises(TableError):
        load(spark, write("d.csv", text))


def test_defects_are_shown(spark, write):
    csv = write("d.csv", "k,v\nfine,1\nshort\nlong,2,3\n")
    assert {r.record for r in bad_records(spark, csv).collect()} == {"short", "long,2,3"}
    lines = write("d.jsonl", '{"k": 1}\n"text"\n{"k"\n\n')
    assert {r.record for r in bad_records(spark, lines).collect()} == {'"text"', '{"k"'}
    with pytest.raises(TableError):
        bad_records(spark, write("d.json", "[]"))


def test_line_breaks_inside_cells(spark, write):
    path = write("q.csv", 'k,said\n1,"one\ntwo, ""three"""\n2,plain\n')
    assert cells(load(spark, path)) == [[1, 'one\ntwo, "three"'], [2, "plain"]]
    alone = write("one.csv", 'said\n"up\ndown"\nleft\n')
    assert cells(load(spark, alone)) == [["up\ndown"], ["left"]]
    quoted = write("inches.csv", 'k,v\n1,5" pipe\n2,"a""b"\n3,""\n')
    assert [c[1] for c in cells(load(spark, quoted))] == ['5" pipe', 'a"b', None]


def test_wide_headers(spark, write):
    names = [f"a_rather_long_column_name_{k:05}" for k in range(9000)]
    table = load(spark, write("wide.csv", ",".join(names) + "\n" + ",".join("1" for _ in names)), LoadOptions(infer_numeric=False))
    assert table.columns == names


@pytest.mark.parametrize("header, want", [("a|b,c|d", "|"), ("one", ","), ('"x;y;z",w', ","), ("p\tq", "\t"), ("a;b;c", ";")])
def test_delimiters_come_from_the_header(header, want):
    assert detect_delimiter(header) == want


def test_encodings(spark, write):
    assert cells(load(spark, write("b.tsv", b"\xef\xbb\xbfName\tname\nr\xc3\xa9\t2\n"))) == [["ré", 2]]
    assert cells(load(spark, write("w.csv", "w\nnaïve\n".encode("cp1252")), LoadOptions(encoding="cp1252"))) == [["naïve"]]


def test_limits(spark, write):
    path = write("p.csv", CATALOGUE)
    load(spark, path, LoadOptions(max_rows=41, max_columns=4))
    load(spark, path, LoadOptions(max_bytes=len(CATALOGUE)))
    for limit in ({"max_rows": 40}, {"max_columns": 3}, {"max_bytes": len(CATALOGUE) - 1}):
        with pytest.raises(TableError, match="more than"):
            load(spark, path, LoadOptions(**limit))
    for wrong in ({"decimal": "."*2}, {"delimiter": ""}):
        with pytest.raises(TableError):
            LoadOptions(**wrong)
    with pytest.raises(TableError, match="unsupported"):
        load(spark, path[:-3] + "doc")


def test_documents(spark, write):
    beds = [{"bed": {"row": k, "soil": {"ph": 6.5 + k}}, "seeds": ["pea", "bean"][:k], "label": None} for k in range(3)]
    path = write("beds.json", json.dumps({"garden": {"beds": beds}}))
    table = load(spark, path, LoadOptions(json_path="garden.beds"))
    assert table.columns == sorted(table.columns) and {"bed.row", "bed.soil.ph", "seeds"} <= set(table.columns)
    assert [json.loads(r["seeds"]) for r in table.df.orderBy("_row_id").collect()] == [[], ["pea"], ["pea", "bean"]]
    for path_in in ("", "garden", "garden.trees", "garden.beds.bed"):
        with pytest.raises(TableError):
            load(spark, path, LoadOptions(json_path=path_in))


def test_every_document_must_be_a_list(spark, write):
    folder = write("many.json/one.json", ' [{"a": 4}, {"a": 5}]').rsplit("/", 1)[0]
    assert sorted(c[0] for c in cells(load(spark, folder))) == [4, 5]
    write("many.json/two.json", '{"a": 3}')
    with pytest.raises(TableError):
        load(spark, folder)


def test_lines_have_one_column_order(spark, write):
    rows = [{"m": 1}] * 150 + [{"z": 2, "a": {"k": 3}}]
    table = load(spark, write("l.jsonl", "\n".join(map(json.dumps, rows))))
    assert table.columns == ["a.k", "m", "z"] and cells(table)[-1] == [3, None, 2]
    for text in ('{"m": 1}\n7\n', '{"m.n": 1, "m": {"n": 2}}'):
        with pytest.raises(TableError):
            load(spark, write("bad.jsonl", text))


def test_nested_columns_of_parquet(spark, tmp_path):
    path = str(tmp_path / "n.parquet")
    spark.sql("SELECT map('a', 1) AS m, named_struct('x', array(2.5D)) AS s, CAST('nan' AS double) AS d").write.parquet(path)
    assert cells(load(spark, path)) == [['{"a":1}', '{"x":[2.5]}', None]]


def test_job_writes_what_it_says(spark, write, tmp_path):
    path, out = write("in/p.csv", CATALOGUE), str(tmp_path / "out")
    done = run_job(spark, path, out, pipeline={"steps": CARE, "expected_columns": HEAD}, fmt="csv")
    assert (done.rows_in, done.rows_out) == (41, 40)
    back = {r["plant_id"]: r for r in spark.read.csv(f"{out}/cleaned_data", header=True).collect()}
    assert {k for k, r in back.items() if r["height"] is None} == {"0007", "0011"} and back["0019"]["sown"] is None
    assert {r["light"] for r in back.values()} == {"shade", "sun"}
    log = json.loads(spark.read.text(f"{out}/processing_log").first()[0])
    assert [e["removed_rows"] for e in log] == [0, 1, 0, 0, 0] and log[0]["changed_cells_retained"] == 13
    profiles = json.loads(spark.read.text(f"{out}/profiles").first()[0])
    assert profiles["before"]["overview"]["rows"] - profiles["after"]["overview"]["rows"] == 1
    with pytest.raises(TableError, match="exists"):
        run_job(spark, path, out)
    run_job(spark, path, out, overwrite=True, with_report=False)
    for inside in (str(tmp_path), str(tmp_path / "in"), path + "/deeper"):
        with pytest.raises(TableError, match="source"):
            run_job(spark, path, inside, overwrite=True)


def test_a_failing_job_leaves_the_earlier_result(spark, write, tmp_path, monkeypatch):
    path, out = write("in/p.csv", CATALOGUE), tmp_path / "out"
    run_job(spark, path, str(out), pipeline={"steps": CARE}, with_report=False)
    before = sorted(p.relative_to(out) for p in out.rglob("*"))

    def broken(*_):
        raise TableError("no report today")

    monkeypatch.setattr("tabwright.plans.job.report", broken)
    with pytest.raises(TableError, match="today"):
        run_job(spark, path, str(out), overwrite=True)
    assert sorted(p.relative_to(out) for p in out.rglob("*")) == before
    with pytest.raises(TableError, match="today"):
        run_job(spark, path, str(tmp_path / "other"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["in", "out"]


def test_job_for_learning(spark, write, tmp_path):
    path, out = write("p.csv", CATALOGUE), str(tmp_path / "learned")
    config = MLConfig("light", ["height"], task="classification", numeric_errors="coerce", stratify=False)
    assert run_job(spark, path, out, ml_config=config).rows_out == 41
    manifest = json.loads(spark.read.text(f"{out}/manifest").first()[0])
    assert sum(manifest["split_rows"].values()) == 41 and manifest["invalid_numeric_to_missing"] == {"height": 1}
    with pytest.raises(TableError, match="not both"):
        run_job(spark, path, out, ml_config=config, pipeline={"steps": []})


def test_small_sinks(spark, tmp_path):
    frame = spark.sql("SELECT 1.5D AS a, DATE'2030-02-01' AS b")
    assert [tuple(r) for r in schema_table(frame).collect()] == [(0, "a", "double"), (1, "b", "date")]
    with pytest.raises(TableError):
        write_table(frame, str(tmp_path / "x"), "orc")
    day = frame.first()["b"]
    assert plain({1: [day, float("-inf"), (2, None)]}) == {"1": ["2030-02-01", None, [2, None]]}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_identity_follows_files(spark, tmp_path, fmt):
    """Files of unequal size, packed in any way: the order is that of names, then of rows."""
    folder = tmp_path / f"many.{fmt}"
    for name, low, high in (("c", 0, 1), ("b", 1, 400), ("a", 400, 420)):
        part = spark.range(low, high, 1, 1).selectExpr("id AS n", "id % 2 AS k")
        part.write.option("header", True).format(fmt).save(str(tmp_path / f"{fmt}-{name}"))
        source = next((tmp_path / f"{fmt}-{name}").glob("part-*"))
        folder.mkdir(exist_ok=True)
        (folder / f"{name}.{fmt}").write_bytes(source.read_bytes())
    want = [*range(400, 420), *range(1, 400), 0]
    for size in ("128MB", "1KB"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", size)
        try:
            assert [c[0] for c in cells(load(spark, str(folder)))] == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
