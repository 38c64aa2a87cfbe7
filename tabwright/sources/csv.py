"""Strict CSV and TSV, splittable at any line break: every cell is text, and a record that does not fit is an error, never skipped.

A file is read line by line, in as many tasks as it has blocks. Where no cell holds a line break, a line is a record and
nothing but built-in expressions runs. Otherwise quotes decide: each block tells how it would end if it began outside or
inside a quoted cell, a running composition over the blocks of a file tells how it does begin, and then every block puts
its own records together. Only records that cross a block edge are collected, from their pieces.
"""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.errors import TableError
from tabwright.sources.options import LoadOptions, suffix_of
from tabwright.sources.places import PLACE, Places, place_lines

DELIMITERS = ",;\t|"
SAMPLE, SAMPLE_LINES = 65_536, 1000  # characters that the dialect is taken from, in so many lines at most
MAX_COLUMNS = 1_000_000  # of the parser; load(max_columns=...) is the limit to set
RECORD, REASON, LINES, CELLS = "__record", "__reason", "__lines", "__cells"
# What a line of the source is if not a record to keep.
BLANK, HEADER = "blank", "header"
WIDTH, AFTER_QUOTE, OPEN = "another number of cells than the header", "text follows a closing quote", "a quoted cell is never closed"
CLOSED, INSIDE, BROKEN = 0, 1, 2


@dataclass(frozen=True)
class Dialect:
    header: list[str]
    header_text: str
    delimiter: str
    encoding: str
    line_end: str


def read_dialect(spark: SparkSession, path: str, options: LoadOptions) -> Dialect:
    """Delimiter and header from the first lines of one file."""
    encoding = options.spark_encoding(spark)
    lines = text_lines(spark, path, encoding, "\n")
    first = lines.where(F.length(F.regexp_replace("value", "[\ufeff\r]", "")) > 0).first()
    if first is None:
        raise TableError("the file is empty")
    # The first line whole, of the others what the sample needs.
    some = lines.select(F.substring("value", 1, SAMPLE)).limit(SAMPLE_LINES).collect()
    text = first[0].removeprefix("\ufeff")
    for (line,) in some[1 + next((k for k, (line,) in enumerate(some) if line.strip("\ufeff\r")), 0) :]:
        if len(text) > SAMPLE:
            break
        text += "\n" + line
    line_end = "\n"
    if "\r" in bare(first[0]) and len(some) == 1:
        line_end, text = "\r", text.replace("\r", "\n")
    delimiter = options.delimiter or ("\t" if suffix_of(path) == ".tsv" else detect_delimiter(text))
    header_text, state = next((record, state) for record, state in sample_records(text, delimiter) if record)
    if state == BROKEN:
        raise TableError(f"{AFTER_QUOTE} in the header")
    header = check_header(next(csv.reader(header_text.splitlines(keepends=True), delimiter=delimiter, strict=False), []))
    if options.max_columns is not None and len(header) > options.max_columns:
        raise TableError(f"more than {options.max_columns} columns")
    return Dialect(header, header_text, delimiter, encoding, line_end)


def detect_delimiter(sample: str) -> str:
    """The candidate that cuts the records of the sample most evenly into more than one cell; then the one that gives
    most cells, then the first one of the list; a comma if none does."""
    best, found = (0.0, 0), ","
    for candidate in DELIMITERS:
        widths = [0 if state == BROKEN else width(record, candidate) for record, state in sample_records(sample, candidate) if record]
        whole = widths[:-1] if len(sample) > SAMPLE and len(widths) > 1 else widths
        wide, times = Counter(w for w in whole if w > 1).most_common(1)[0] if any(w > 1 for w in whole) else (0, 0)
        if wide and (score := (times / len(whole), wide)) > best:
            best, found = score, candidate
    return found


def sample_records(sample: str, delimiter: str) -> Iterator[tuple[str, int]]:
    part, state = [], CLOSED
    for line in sample.split("\n"):
        state = end_of_line(line, delimiter, state == INSIDE)
        part.append(line)
        if state != INSIDE:
            yield bare("\n".join(part)), state
            part = []
    if part:
        yield "\n".join(part), state


def width(record: str, delimiter: str) -> int:
    """Cells of a record that is not broken."""
    at, cells = 0, 1
    while True:
        if record.startswith('"', at):
            at += 1
            while (at := record.find('"', at)) >= 0 and record.startswith('"', at + 1):
                at += 2
            at = at + 1 if at >= 0 else len(record)
        if (at := record.find(delimiter, at)) < 0:
            return cells
        at, cells = at + 1, cells + 1


def check_header(header: list[str]) -> list[str]:
    if not header or not all(name.strip() for name in header):
        raise TableError("every column needs a name")
    if len(set(header)) < len(header):
        raise TableError(f"repeated column names: {sorted({name for name in header if header.count(name) > 1})}")
    return header


def bare(line: str) -> str:
    return line.removesuffix("\r")


def end_of_line(line: str, delimiter: str, inside: bool) -> int:
    """Whether a line that begins inside a quoted cell, or outside, leaves the record CLOSED, INSIDE a cell, or BROKEN."""
    at, n = 0, len(bare(line))
    while True:
        if inside:
            while (at := line.find('"', at, n)) >= 0 and line.startswith('"', at + 1):
                at += 2
            if at < 0:
                return INSIDE
            at += 1
            if at >= n:
                return CLOSED
            if not line.startswith(delimiter, at):
                return BROKEN
            at += 1
        if not line.startswith('"', at):
            at = line.find(delimiter + '"', at, n) + 1
            if not at:
                return CLOSED
        at, inside = at + 1, True


def quoting(line: Column, delimiter: str) -> Column:
    """`end_of_line` of a record that begins outside, as an expression: cells one after another, only where there is a quote."""

    def step(state: Column, piece: Column) -> Column:
        opens = (state != INSIDE) & piece.startswith('"')
        body = F.replace(F.when(opens, F.substr(piece, F.lit(2))).otherwise(piece), F.lit('""'), F.lit(""))
        at = F.locate('"', body)
        quoted = F.when(at == 0, INSIDE).when(at == F.length(body), CLOSED).otherwise(BROKEN)
        return F.when(state == BROKEN, BROKEN).when(opens | (state == INSIDE), quoted).otherwise(CLOSED)

    pieces = F.split(line, re.escape(delimiter))
    return F.when(~F.contains(line, F.lit('"')), CLOSED).otherwise(F.aggregate(pieces, F.lit(CLOSED), step))


def source_lines(spark: SparkSession, path: str, dialect: Dialect) -> tuple[DataFrame, Places]:
    """PLACE and value of every line."""
    lines, places = place_lines(spark.read.option("encoding", dialect.encoding).option("lineSep", dialect.line_end).text(path), path)
    return lines.withColumn("value", decoded("value", dialect.encoding)), places


def text_lines(spark: SparkSession, path: str, encoding: str, line_end: str) -> DataFrame:
    return spark.read.option("encoding", encoding).option("lineSep", line_end).text(path).withColumn("value", decoded("value", encoding))


def decoded(name: str, encoding: str) -> Column:
    """The text reader hands on bytes as they are."""
    return F.col(name) if encoding == "UTF-8" else F.decode(F.col(name).cast("binary"), encoding)


def records(lines: DataFrame) -> DataFrame:
    """Every line as a record."""
    return lines.select(PLACE, F.col("value").alias(RECORD), F.lit(1).cast("long").alias(LINES))


def assembled(lines: DataFrame, places: Places, dialect: Dialect) -> DataFrame:
    """Records of whole cells: PLACE of the first line, the text with its line breaks, the number of lines."""
    delimiter, glue, shift = dialect.delimiter, dialect.line_end, places.index_bits
    ends = pa.schema([("block", pa.int64()), ("outside", pa.int32()), ("inside", pa.int32())])
    whole = pa.schema([(PLACE, pa.int64()), (RECORD, pa.string()), (LINES, pa.int64()), ("begins", pa.bool_()), ("closes", pa.bool_())])

    def rows(batches):
        for batch in batches:
            values = batch.column("value")
            quoted = pc.match_substring(values, '"').to_pylist()
            yield from zip(batch.column(PLACE).to_pylist(), values.to_pylist(), quoted, strict=True)

    def block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, states, out = None, None, []
        for place, line, quoted in rows(batches):
            if place >> shift != block:
                if block is not None:
                    out.append((block, *states))
                block, states = place >> shift, [CLOSED, INSIDE]
            if quoted:
                # A broken record is reported later; whatever it leaves open is not.
                seen = {s: end_of_line(line, delimiter, s == INSIDE) for s in set(states)}
                states = [INSIDE if seen[s] == INSIDE else CLOSED for s in states]
        if block is not None:
            out.append((block, *states))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(ends.types)], schema=ends)

    blocks = lines.mapInArrow(block_ends, "block bigint, outside int, inside int")
    blocks = blocks.withColumn("file", F.shiftright("block", places.block_bits)).withColumn("turns", (F.col("outside") != CLOSED) & (F.col("inside") != INSIDE))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    fixed = F.when(F.col("outside") == F.col("inside"), F.struct("outside", F.sum(F.col("turns").cast("int")).over(upto).alias("turned")))
    blocks = blocks.withColumn("fixed", fixed).withColumn("last", F.last("fixed", ignorenulls=True).over(before))
    turned = F.coalesce(F.sum(F.col("turns").cast("int")).over(before), F.lit(0))
    start = (F.coalesce("last.outside", F.lit(CLOSED)) + turned - F.coalesce("last.turned", F.lit(0))) % 2
    begun = blocks.select("block", (start == 1).alias("within")).where("within")
    # One number per block of the source that begins inside a cell: bounded by the listing, which the driver holds too.
    known = lines.withColumn("block", F.shiftright(PLACE, shift)).join(F.broadcast(begun), "block", "left").select(PLACE, "value", "within")

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, part, first, begins, out = None, [], 0, True, []

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(whole.types)], schema=whole)

        for batch in batches:
            within = batch.column("within").to_pylist()
            for (place, line, quoted), inner in zip(rows([batch]), within, strict=True):
                if place >> shift != block:
                    if part:
                        out.append((first, glue.join(part), len(part), begins, False))
                    block, part, first, begins = place >> shift, [], place, not inner
                inside = bool(part) or not begins
                if not part:
                    first = place
                part.append(line)
                state = end_of_line(line, delimiter, inside) if quoted else INSIDE if inside else CLOSED
                if state != INSIDE:
                    out.append((first, glue.join(part), len(part), begins, True))
                    part, begins = [], True
            yield packed()
            out.clear()
        if part:
            out.append((first, glue.join(part), len(part), begins, False))
            yield packed()

    pieces = known.mapInArrow(put_together, f"{PLACE} bigint, {RECORD} string, {LINES} bigint, begins boolean, closes boolean")
    complete = pieces.where("begins and closes").select(PLACE, RECORD, LINES)
    cut = pieces.where("not (begins and closes)").withColumn("file", F.shiftright(PLACE, places.file_shift))
    heads = F.max(F.when(F.col("begins"), F.col(PLACE))).over(Window.partitionBy("file").orderBy(PLACE))
    joined = cut.withColumn("head", heads).groupBy("head").agg(F.sort_array(F.collect_list(F.struct(PLACE, RECORD))).alias("p"), F.sum(LINES).alias(LINES))
    return complete.unionByName(joined.select(F.col("head").alias(PLACE), F.array_join(F.col("p")[RECORD], glue).alias(RECORD), LINES))


def parsed(found: DataFrame, dialect: Dialect) -> DataFrame:
    """Adds CELLS, a struct of the header's columns, and REASON: null for a record to keep, else why it is none."""
    text = F.regexp_replace(F.col(RECORD), "\r$", "")
    unmarked = F.regexp_replace(text, "^﻿", "")
    corrupt = "__corrupt"
    while corrupt in dialect.header:
        corrupt += "_"
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in [*dialect.header, corrupt])
    options = {
        "sep": dialect.delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt,
        "multiLine": "true", "maxColumns": str(MAX_COLUMNS),
    }
    rows = found.withColumn("__text", text)
    cells = F.from_csv(F.col("__text"), F.lit(schema), options)
    rows = rows.withColumn(CELLS, cells).withColumn("__quoting", quoting(F.col("__text"), dialect.delimiter))
    reason = (
        F.when(F.col("__text") == "", BLANK)
        .when(unmarked == dialect.header_text, HEADER)  # if it is the first of its file, which its place decides
        .when(F.col("__quoting") == BROKEN, AFTER_QUOTE)
        .when(F.col("__quoting") == INSIDE, OPEN)
        .when(F.col(CELLS)[corrupt].isNotNull(), WIDTH)
    )
    return rows.withColumn(REASON, reason).drop("__text", "__quoting")


def numbered(bad: DataFrame, every: DataFrame, places: Places) -> DataFrame:
    """`line`: number, from 1, of the first line of each row of `bad` in its file; `every` has all lines or records."""
    shift = places.index_bits
    blocks = every.groupBy(F.shiftright(PLACE, shift).alias("block")).agg(F.sum(LINES).alias("n"), F.min(PLACE).alias("least"))
    order = Window.partitionBy(F.shiftright("block", places.block_bits)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    above = blocks.select("block", "least", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("above"))
    at = bad.withColumn("block", F.shiftright(PLACE, shift)).join(above, "block")
    return at.withColumn("line", F.col("above") + F.col(PLACE) - F.col("least") + 1).drop("block", "above", "least")


def bad_csv_rows(spark: SparkSession, path: str, options: LoadOptions) -> DataFrame:
    """file, line, record, reason of every record that does not fit; `line` counts from 1 and is that of its first line."""
    dialect = read_dialect(spark, path, options)
    lines, places = source_lines(spark, path, dialect)
    found = records(lines) if options.multi_line is False else assembled(lines, places, dialect)
    bad = parsed(found, dialect).where(F.col(REASON).isNotNull() & ~F.col(REASON).isin(BLANK, HEADER))
    shown = numbered(bad, records(lines), places).join(places.names, F.shiftright(PLACE, places.file_shift) == F.col("number"))
    return shown.select("file", "line", F.regexp_replace(RECORD, "\r$", "").alias("record"), F.col(REASON).alias("reason"))
