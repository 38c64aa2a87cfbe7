"""Outputs: the cleaned table, its schema, and small JSON records."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from tabwright.errors import TableError
from tabwright.functions.names import data_columns, q


def plain(value):
    """What strict JSON can hold: the value written permissively, then read back with NaN and infinity as null."""
    return json.loads(json.dumps(value, default=date.isoformat), parse_constant=lambda _: None)


def write_json(spark: SparkSession, value, path: str, overwrite: bool = False) -> None:
    text = json.dumps(plain(value), ensure_ascii=False, allow_nan=False)
    frame = spark.createDataFrame([(text,)], "value string").coalesce(1)
    frame.write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = False) -> None:
    """Parquet keeps types; CSV is a folder of parts, each with a header, where missing and empty look alike."""
    writer = df.select(*[q(name) for name in data_columns(df)]).write.mode("overwrite" if overwrite else "errorifexists")
    if fmt == "csv":
        writer.options(header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise TableError("the output format must be csv or parquet")


def schema_table(df: DataFrame) -> DataFrame:
    """``position, column, type`` of the data columns."""
    rows = [(i, name, df.schema[name].dataType.simpleString()) for i, name in enumerate(data_columns(df))]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def guard_output(spark: SparkSession, source: str, output: str, overwrite: bool) -> None:
    """Refuse to write over existing results unless asked to, and over or into the source always."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    a, b = (str(make(p).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(make(p))).rstrip("/") + "/" for p in (source, output))
    if a.startswith(b) or b.startswith(a):
        raise TableError("the output would overwrite the source or mix with it")
    if not overwrite and exists(spark, output):
        raise TableError("the output already exists")


@contextmanager
def published(spark: SparkSession, output: str) -> Iterator[str]:
    """A folder beside `output` to write to, which takes its place once everything in it is written.

    An earlier result stays whole and in place until then, and for good if anything fails; readers never meet half of
    either. Where a store cannot rename folders at once, the two renames take as long as it needs.
    """
    staging, earlier = (f"{output.rstrip('/')}.{kind}-{uuid.uuid4().hex[:8]}" for kind in ("new", "old"))
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(output).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        yield staging
        replaced = files.exists(path(output))
        if replaced and not files.rename(path(output), path(earlier)):
            raise TableError(f"cannot replace {output}")
        if not files.rename(path(staging), path(output)):
            if replaced:
                files.rename(path(earlier), path(output))
            raise TableError(f"cannot publish {output}")
        if replaced:
            files.delete(path(earlier), True)
    finally:
        files.delete(path(staging), True)
