"""CSV cut anywhere: cells with line breaks at block edges, strict quoting in every mode, refusals by file and line."""

import csv
import io
import random

import pytest

from tabwright import TableError
from tabwright.sources.csv import CLOSED, INSIDE, detect_delimiter, end_of_line, width
from tabwright.sources.load import LoadOptions, bad_records, load


@pytest.fixture
def small_blocks(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def to(size):
        for key in keys:
            spark.conf.set(key, str(size))

    yield to
    for key in keys:
        spark.conf.unset(key)


def cells(table):
    return [[c or "" for c in list(r)[1:]] for r in table.df.orderBy("_row_id").collect()]


def written(rows, **how):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n", **how).writerows(rows)
    return out.getvalue()


BITS = ["plain", "", "a\nb", '"', '""', "\n\n", ",", '","', 'x"\n"y', "é", "k,v", "two\r\nlines", " "]


@pytest.mark.parametrize("size", [17, 90, 1 << 20])
def test_breaks_anywhere(spark, tmp_path, small_blocks, size):
    draw, want = random.Random(size), []
    for k in range(3):
        rows = [[f"id{k}-{n}", "".join(draw.choice(BITS) for _ in range(draw.randint(0, 3))), draw.choice(BITS)] for n in range(25)]
        (tmp_path / "t.csv").mkdir(exist_ok=True)
        (tmp_path / "t.csv" / f"part-{k}.csv").write_bytes(written([["name", "said", "more"], *rows]).encode())
        want += rows
    small_blocks(size)
    table = load(spark, str(tmp_path / "t.csv"), LoadOptions(infer_numeric=False))
    assert cells(table) == want and table.metadata["rows"] == len(want)
    assert bad_records(spark, str(tmp_path / "t.csv")).collect() == []


def test_a_cell_longer_than_many_blocks(spark, tmp_path, small_blocks):
    long = "\n".join(f"line {k}, of many" for k in range(200))
    (tmp_path / "t.csv").write_text(written([["a", "b"], ["1", long], ["2", "x"], ["3", long + '"']]))
    small_blocks(50)
    assert cells(load(spark, str(tmp_path / "t.csv"), LoadOptions(infer_numeric=False))) == [["1", long], ["2", "x"], ["3", long + '"']]


@pytest.mark.parametrize("extra", ["", '5,"one\ntwo"\n'])
@pytest.mark.parametrize("multi_line", [None, True, False])
def test_quoting_is_judged_record_by_record(spark, tmp_path, extra, multi_line):
    if extra and multi_line is False:
        return
    path = tmp_path / "t.csv"
    path.write_text(f'k,v\n1,"a"\n"x"y,1\n{extra}')
    with pytest.raises(TableError, match=r"t.csv, line 3: text follows a closing quote: \"x\"y,1"):
        load(spark, str(path), LoadOptions(multi_line=multi_line))
    path.write_text(f'k,v\n1,5" pipe\n2,""\n{extra}')
    assert [r[1] for r in cells(load(spark, str(path), LoadOptions(multi_line=multi_line)))][:2] == ['5" pipe', ""]


def test_refusals_have_file_line_and_reason(spark, tmp_path, small_blocks):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    (folder / "a.csv").write_text('k,v\n1,"x\ny\nz"\n\n2\n3,4\n')
    (folder / "b.csv").write_text('k,v\n' + "9,9\n" * 30 + '7,8,9\n"q"r,1\n8,"open\n')
    for size in (12, 1 << 20):
        small_blocks(size)
        found = sorted((r.file.rsplit("/", 1)[1], r.line, r.record, r.reason) for r in bad_records(spark, str(folder)).collect())
        assert [f[:2] for f in found] == [("a.csv", 6), ("b.csv", 32), ("b.csv", 33), ("b.csv", 34)]
        assert [f[2] for f in found] == ["2", "7,8,9", '"q"r,1', '8,"open']
        assert [f[3].split()[0] for f in found] == ["another", "another", "text", "a"]
        with pytest.raises(TableError, match="a.csv, line 6: another number of cells"):
            load(spark, str(folder))


def test_records_that_read_like_the_header(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("1,2\n3,4\n1,2\n5,6\n1,2\n")
    assert [list(r)[1:] for r in load(spark, str(path)).df.orderBy("_row_id").collect()] == [[3, 4], [1, 2], [5, 6], [1, 2]]
    folder = tmp_path / "f.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("k,v\n1,2\n")
    (folder / "b.csv").write_text("1,2\n")
    with pytest.raises(TableError, match="header"):
        load(spark, str(folder))


@pytest.mark.parametrize(
    "sample, want",
    [('"a;b;c",d\n"e;f;g",h\n', ","), ("a,b;c;d\n1,5;2;3\n3,5;4;5\n", ";"), ("a b\nc\n", ","), ("x|y\n1|2,3\n4|5\n", "|"), ('n\tm\n"1\t2"\t3\n', "\t")],
)
def test_delimiters_cut_the_sample_evenly(sample, want):
    assert detect_delimiter(sample) == want


def test_states_of_lines():
    assert [end_of_line(x, ",", False) for x in ('a,"b', '"a""b"', '"a"b', 'a"b', "", '"')] == [INSIDE, CLOSED, 2, CLOSED, CLOSED, INSIDE]
    assert [end_of_line(x, ",", True) for x in ("a", 'b"', 'b""', 'b",c', 'b",",d', 'b"c')] == [INSIDE, CLOSED, INSIDE, CLOSED, INSIDE, 2]
    assert [width(x, ",") for x in ("", "a,b", '"a,b",c', '"a""",', 'a"b,c"')] == [1, 2, 2, 2, 2]
