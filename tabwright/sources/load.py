"""Load a source strictly: structure checked over every record, nothing silently dropped or sampled."""

from __future__ import annotations

import json
from dataclasses import asdict, replace
from pathlib import PurePosixPath

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabwright.errors import TableError
from tabwright.functions.names import ROW_ID, data_columns, literal, q, quoted
from tabwright.session import Scratch, configure
from tabwright.sources import infer
from tabwright.sources.csv import BLANK, CELLS, HEADER, OPEN, REASON, RECORD, assembled, bad_csv_rows, numbered, parsed, read_dialect, records, source_lines
from tabwright.sources.json import NO_OBJECT, VALUE, all_lines, bad_json_lines, cell, flatten_variants, json_lines, read_json_documents
from tabwright.sources.options import LoadOptions, format_of, suffix_of
from tabwright.sources.places import PLACE
from tabwright.sources.table import Table, identified, placed


def scan(spark: SparkSession, path: str, options: LoadOptions | None = None) -> DataFrame:
    """The source as a frame, before missing tokens and inference; reading it fails on malformed records."""
    options = options or LoadOptions()
    configure(spark)
    kind = format_of(path)
    if kind in ("csv", "jsonl"):
        return load(spark, path, replace(options, missing_tokens=[], infer_numeric=False)).df.drop(ROW_ID)
    if kind == "json":
        return read_json_documents(spark, path, options)
    frame = spark.read.parquet(path)
    return frame.select(*[cell(q(f.name), f.dataType).alias(f.name) for f in frame.schema.fields])


def load(
    spark: SparkSession, path: str, options: LoadOptions | None = None, row_id: str | None = None, scratch: Scratch | None = None
) -> Table:
    """Validate every record, mark missing cells and decide numeric columns over the whole source.

    A text source is written to the shared folder, typed and columnar: all later jobs read that, column by column,
    with row identities that never change, instead of parsing the text again.
    """
    options = options or LoadOptions()
    configure(spark)
    scratch, kind = scratch or Scratch(spark), format_of(path)
    try:
        size = source_bytes(spark, path)
        if options.max_bytes is not None and size > options.max_bytes:
            raise TableError(f"more than {options.max_bytes} bytes")
        if kind == "csv":
            frame, rows = _load_csv(spark, path, options, row_id, scratch)
        elif kind == "jsonl":
            frame, rows = _load_json_lines(spark, path, options, row_id, scratch)
        else:
            frame, rows = _load_records(spark, path, options, row_id, scratch)
    except (PySparkException, Py4JJavaError) as error:
        cause = error.java_exception.getMessage() if isinstance(error, Py4JJavaError) else str(error)
        raise TableError(f"cannot read {path}: {cause.splitlines()[0]}") from error
    metadata = {
        "source": PurePosixPath(path.rstrip("/")).name,
        "bytes": size,
        "format": suffix_of(path).lstrip("."),
        "rows": rows,
        "columns": len(data_columns(frame)),
        "load_options": asdict(options),
        "sampled": False,
    }
    return Table(frame, metadata["source"], metadata, scratch)


def _load_records(spark: SparkSession, path: str, options: LoadOptions, row_id: str | None, scratch: Scratch) -> tuple[DataFrame, int]:
    raw = scan(spark, path, options)
    check_columns(raw.columns, options.max_columns)
    if row_id is None and not (format_of(path) == "json" and options.json_path):
        raw = placed(raw, format_of(path) == "parquet", path)
    return _inferred(raw, path, options, row_id, scratch)


def _load_json_lines(spark: SparkSession, path: str, options: LoadOptions, row_id: str | None, scratch: Scratch) -> tuple[DataFrame, int]:
    """The text is parsed once, into variants; what all of them hold is observed on the way and gives the columns."""
    rows, places = json_lines(spark, path, options)
    bad, seen = F.col(VALUE).isNull(), Observation()
    kept = rows.withColumn(RECORD, F.when(bad, F.col(RECORD)))
    copy = scratch.table(kept.observe(seen, F.schema_of_variant_agg(VALUE).alias("shape"), F.count_if(bad).alias("bad"), F.count_if(~bad).alias("rows")))
    if seen.get["bad"]:
        _refuse(copy.withColumn(REASON, F.lit(NO_OBJECT)), all_lines(spark, path), places, bad, 0)
    if not seen.get["rows"]:
        raise TableError("the source has no records")
    raw = flatten_variants(copy, seen.get["shape"])
    check_columns([name for name in raw.columns if name != PLACE], options.max_columns)
    found = _inferred(raw.withColumnRenamed(PLACE, ROW_ID) if row_id is None else raw.drop(PLACE), path, options, row_id, scratch)
    scratch.drop(copy)
    return found


def _inferred(raw: DataFrame, path: str, options: LoadOptions, row_id: str | None, scratch: Scratch) -> tuple[DataFrame, int]:
    frame = infer.mark_missing(raw, options.missing_tokens)
    names = infer.candidates(frame) if options.infer_numeric else []
    row = infer.readings(frame, names, options.decimal).agg(F.count("*").alias("rows"), *infer.inference_measures(names)).first()
    if not row["rows"]:
        raise TableError("the source has no records")
    check_rows(row["rows"], options.max_rows)
    frame = identified(infer.apply_inference(frame, names, row, options.decimal), row_id)
    return (frame if format_of(path) == "parquet" else scratch.table(frame)), row["rows"]


def _load_csv(spark: SparkSession, path: str, options: LoadOptions, row_id: str | None, scratch: Scratch) -> tuple[DataFrame, int]:
    """The text is parsed once, while its cells are written column by column; what validates and infers is observed on the way.

    A source turns out to have line breaks inside cells only then, and is parsed again as such.
    """
    dialect = read_dialect(spark, path, options)
    check_columns(dialect.header, options.max_columns)
    if clash := {PLACE, REASON, RECORD}.intersection(dialect.header):
        raise TableError(f"the column names {sorted(clash)} are reserved")
    lines, places = source_lines(spark, path, dialect)
    reason, names = F.col(REASON), []
    bad = reason.isNotNull() & ~reason.isin(BLANK, HEADER)
    measures = [F.count_if(reason.isNull()).alias("rows"), F.count_if(bad).alias("bad"), F.count_if(reason == OPEN).alias("open")]

    def measured(frame: DataFrame) -> tuple[DataFrame, list]:
        texts = infer.readings(frame, names, options.decimal)
        return texts, [*measures, *infer.inference_measures(names)]

    def parse(spans: bool) -> tuple[DataFrame, dict]:
        rows = parsed(assembled(lines, places, dialect) if spans else records(lines), dialect)
        absent = ", ".join(literal(token) for token in ["", *options.missing_tokens])
        kept = [f"CASE WHEN {REASON} IS NULL AND {CELLS}.{c} NOT IN ({absent}) THEN {CELLS}.{c} END AS {c}" for c in map(quoted, dialect.header)]
        # Written as SQL: with thousands of columns, building each expression from Python takes longer than the job.
        frame = rows.withColumn(RECORD, F.when(bad, q(RECORD))).selectExpr(PLACE, REASON, RECORD, *kept)
        if options.infer_numeric and not names:
            names.extend(infer.candidates(frame.drop(PLACE, REASON, RECORD)))
        texts, wanted = measured(frame)
        seen = Observation()
        return scratch.table(texts.observe(seen, *wanted).drop(*[n for n in texts.columns if n not in frame.columns])), seen.get

    copy, row = parse(options.multi_line is True)
    if row["open"] and options.multi_line is None:
        scratch.drop(copy)
        copy, row = parse(True)
    file = F.shiftright(PLACE, places.file_shift)
    filled = copy.where(reason.isNull() | (reason != BLANK)).groupBy(file.alias("file"))
    heads = filled.agg(F.min(PLACE).alias("first"), F.min(F.when(reason == HEADER, q(PLACE))).alias("head"), F.count_if(reason == HEADER).alias("n"))
    found = heads.agg(F.count_if(F.col("head").isNull() | (F.col("head") != F.col("first"))).alias("headless"), F.max("n").alias("most")).first()
    if found["headless"] or row["bad"]:
        _refuse(copy, records(lines), places, bad, found["headless"])
    if found["most"] > 1:
        # Records that read like the header further down are records: cells and measures are taken again.
        first = heads.select(F.col("head").alias(PLACE), F.lit(True).alias("__first"))
        texts = [F.when((reason == HEADER), F.lit(name)).otherwise(q(name)).alias(name) for name in dialect.header]
        again = copy.join(first, PLACE, "left").select(PLACE, F.when((reason == HEADER) & F.col("__first").isNull(), None).otherwise(reason).alias(REASON), RECORD, *texts)
        copy = scratch.table(again)
        texts, wanted = measured(copy.where(reason.isNull()))
        row = texts.agg(*wanted).first().asDict()
    if not row["rows"]:
        raise TableError("the source has no records")
    check_rows(row["rows"], options.max_rows)
    frame = copy.where(reason.isNull()).drop(REASON, RECORD).withColumnRenamed(PLACE, ROW_ID)
    typed = infer.apply_inference(frame, names, row, options.decimal)
    if row_id is not None:
        typed = identified(typed.drop(ROW_ID), row_id)
    if typed.schema != frame.schema:
        typed = scratch.table(typed)
        scratch.drop(copy)
    return typed, row["rows"]


def _refuse(copy: DataFrame, lines: DataFrame, places, bad, headless: int) -> None:
    """Name the first record that does not fit, by file and line."""
    first = numbered(copy.where(bad).orderBy(PLACE).limit(1), lines, places)
    row = first.join(places.names, F.shiftright(PLACE, places.file_shift) == F.col("number")).first()
    if row is not None:
        raise TableError(f"{row['file']}, line {row['line']}: {row[REASON]}: {row[RECORD][:200]}")
    if headless:
        raise TableError(f"{headless} files do not begin with the header of the others")


def bad_records(spark: SparkSession, path: str, options: LoadOptions | None = None) -> DataFrame:
    """file, line, record, reason of every record ``load`` would refuse; lines count from 1 in each file."""
    options = options or LoadOptions()
    configure(spark)
    kind = format_of(path)
    if kind == "csv":
        return bad_csv_rows(spark, path, options)
    if kind == "jsonl":
        return bad_json_lines(spark, path, options)
    raise TableError("only CSV and JSON lines have separable records")


def source_bytes(spark: SparkSession, path: str) -> int:
    """Total file size; the listing alone answers it, contents are not read."""
    return spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def check_rows(rows: int, limit: int | None) -> None:
    if limit is not None and rows > limit:
        raise TableError(f"more than {limit} rows")


def check_columns(columns: list[str], limit: int | None) -> None:
    if not columns:
        raise TableError("the source has no columns")
    if limit is not None and len(columns) > limit:
        raise TableError(f"more than {limit} columns")
    if ROW_ID in columns:
        raise TableError(f"the column name {ROW_ID} is reserved")
    if len(set(columns)) != len(columns) or any(not name.strip() for name in columns):
        raise TableError("column names must be unique and not blank")


def metadata_table(spark: SparkSession, table: Table) -> DataFrame:
    record = {**table.metadata, "load_options": json.dumps(table.metadata["load_options"], sort_keys=True)}
    return spark.createDataFrame(
        [record], "source string, bytes bigint, format string, rows bigint, columns int, load_options string, sampled boolean"
    )
