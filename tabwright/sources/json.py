"""JSON documents and JSON lines, flattened to dotted columns; arrays stay one cell of JSON text."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.errors import TableError
from tabwright.functions.names import q
from tabwright.sources.csv import LINES, RECORD, decoded, numbered
from tabwright.sources.options import LoadOptions
from tabwright.sources.places import PLACE, Places, place_lines

VALUE, NO_OBJECT = "__value", "not a JSON object"


def json_lines(spark: SparkSession, path: str, options: LoadOptions) -> tuple[DataFrame, Places]:
    """PLACE, RECORD, VALUE of every line that is not blank: VALUE is the object, null where the line is none.

    Of a key that an object has twice the last one counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    encoding = options.spark_encoding(spark)
    lines, places = place_lines(spark.read.option("encoding", encoding).option("lineSep", "\n").text(path), path)
    text = F.regexp_replace(decoded("value", encoding), "^\ufeff", "")
    rows = lines.select(PLACE, text.alias(RECORD)).where(F.col(RECORD).rlike(r"[^\s]")).withColumn("__any", F.try_parse_json(RECORD))
    is_object = F.schema_of_variant("__any").startswith("OBJECT")
    return rows.select(PLACE, RECORD, F.when(is_object, F.col("__any")).alias(VALUE)), places


def all_lines(spark: SparkSession, path: str) -> DataFrame:
    """PLACE and LINES for counting."""
    lines, _ = place_lines(spark.read.option("lineSep", "\n").text(path), path)
    return lines.select(PLACE, F.lit(1).cast("long").alias(LINES))


def bad_json_lines(spark: SparkSession, path: str, options: LoadOptions) -> DataFrame:
    """file, line, record, reason of lines that are not JSON objects; lines count from 1 in each file."""
    rows, places = json_lines(spark, path, options)
    shown = numbered(rows.where(F.col(VALUE).isNull()), all_lines(spark, path), places)
    shown = shown.join(places.names, F.shiftright(PLACE, places.file_shift) == F.col("number"))
    return shown.select("file", "line", F.regexp_replace(RECORD, "\r$", "").alias("record"), F.lit(NO_OBJECT).alias("reason"))


@dataclass(frozen=True)
class Shape:
    """What a variant holds over all rows: the fields of an object, or the name of another type."""

    kind: str
    fields: dict[str, Shape] | None = None


def shape_of(description: str) -> Shape:
    """Reads what schema_of_variant_agg says, such as OBJECT<a: OBJECT<b: BIGINT>, `c d`: ARRAY<STRING>>."""

    def read(at: int) -> tuple[Shape, int]:
        if not description.startswith("OBJECT<", at):
            begin, depth = at, 0
            while at < len(description) and (depth or description[at] not in ",>"):
                if description[at] == "`":
                    at = closing(at)
                depth += (description[at] in "<(") - (description[at] in ">)")
                at += 1
            return Shape(description[begin:at]), at
        at, fields = at + len("OBJECT<"), {}
        while description[at] != ">":
            if description[at] == "`":
                end = closing(at) + 1
                name = description[at + 1 : end - 1].replace("``", "`")
            else:
                end = description.index(":", at)
                name = description[at:end]
            fields[name], at = read(end + 2)
            if description[at] == ",":
                at += 2
        return Shape("OBJECT", fields), at + 1

    def closing(at: int) -> int:
        at = description.index("`", at + 1)
        while description.startswith("``", at):
            at = description.index("`", at + 2)
        return at

    return read(0)[0]


def paths_of(shape: Shape, above: tuple[str, ...] = ()) -> tuple[list[tuple[tuple[str, ...], str]], list[tuple[str, ...]]]:
    """Leaves with their types, and the objects between them, which single rows may have empty."""
    leaves, inner = [], []
    for name, field in (shape.fields or {}).items():
        if field.fields:
            inner.append((*above, name))
            below = paths_of(field, (*above, name))
            leaves, inner = leaves + below[0], inner + below[1]
        else:
            leaves.append(((*above, name), field.kind))
    return leaves, inner


def route(parts: tuple[str, ...]) -> str:
    if odd := [p for p in parts if "'" in p and '"' in p]:
        raise TableError(f"a key with both kinds of quotes cannot be read: {odd[0]}")
    return "$" + "".join(f"['{p}']" if '"' in p else f'["{p}"]' for p in parts)


def found_in(parts: tuple[str, ...], kind: str) -> Column:
    """A number, truth value or text as such, anything else as JSON text with sorted keys and all its nulls."""
    target = "bigint" if kind == "BIGINT" else "boolean" if kind == "BOOLEAN" else "double" if kind.startswith(("DECIMAL", "DOUBLE", "FLOAT")) else "string"
    return F.try_variant_get(VALUE, route(parts), target)


def empty_object(parts: tuple[str, ...]) -> Column:
    return F.try_variant_get(VALUE, route(parts), "string") == "{}"


def flatten_variants(rows: DataFrame, description: str) -> DataFrame:
    """PLACE and the columns of the objects in VALUE, whose merged schema is described: dotted, sorted by name.

    An object that is empty in some rows, and not in others, is a column of its own there, so nothing is lost.
    """
    leaves, inner = paths_of(shape_of(description))
    if inner:
        seen = rows.agg(*[F.coalesce(F.max(empty_object(p)), F.lit(False)).alias(f"e{k}") for k, p in enumerate(inner)]).first()
        inner = [p for k, p in enumerate(inner) if seen[k]]
    columns = [(".".join(p), found_in(p, kind)) for p, kind in leaves] + [(".".join(p), F.when(empty_object(p), "{}")) for p in inner]
    columns.sort(key=lambda c: c[0])
    check_collisions([name for name, _ in columns])
    return rows.select(PLACE, *[column.alias(name) for name, column in columns])


def read_json_documents(spark: SparkSession, path: str, options: LoadOptions) -> DataFrame:
    """Records of documents: a top-level list, or the list at ``json_path``. A document is read by one task.

    With ``multi_line=False`` every line is a document, which lets a large file be split.
    """
    multi_line = options.multi_line is not False
    documents = _reader(spark, options).option("mode", "FAILFAST").option("multiLine", multi_line).json(path)
    if not options.json_path:
        texts = spark.read.option("encoding", options.spark_encoding(spark)).text(path, wholetext=multi_line)
        start = F.substring(F.regexp_replace("value", "^[\ufeff\\s]+", ""), 1, 1)
        if not texts.filter((start != "[") & (start != "")).isEmpty():
            raise TableError("a document is not a list of objects; choose the path of the list")
        return flatten(documents)
    column: Column | None = None
    dtype: T.DataType = documents.schema
    for part in filter(None, options.json_path.split(".")):
        if not isinstance(dtype, T.StructType) or part not in dtype.names:
            raise TableError(f"no such path: {options.json_path}")
        column = q(part) if column is None else column.getField(part)
        dtype = dtype[part].dataType
    if not isinstance(dtype, T.ArrayType) or not isinstance(dtype.elementType, T.StructType):
        raise TableError("the path must lead to a list of objects")
    bad = documents.filter(column.isNull() | F.exists(column, lambda record: record.isNull()))
    if not bad.isEmpty():
        raise TableError(f"a document lacks a list of objects at {options.json_path}")
    return flatten(documents.select(F.inline(column)))


def _reader(spark: SparkSession, options: LoadOptions):
    return spark.read.option("encoding", options.spark_encoding(spark)).option("lineSep", "\n")


def flatten(df: DataFrame) -> DataFrame:
    """Objects become dotted columns, recursively, sorted by name; two routes to one name are an error."""
    found: list[tuple[str, Column]] = []

    def visit(column: Column, field: T.StructField, name: str) -> None:
        if isinstance(field.dataType, T.StructType) and field.dataType.fields:
            for inner in field.dataType.fields:
                visit(column.getField(inner.name), inner, f"{name}.{inner.name}")
        else:
            found.append((name, cell(column, field.dataType)))

    for field in df.schema.fields:
        visit(q(field.name), field, field.name)
    check_collisions([name for name, _ in found])
    found.sort(key=lambda item: item[0])
    return df.select(*[column.alias(name) for name, column in found])


def check_collisions(names: list[str]) -> None:
    if clashing := sorted(name for name, n in Counter(names).items() if n > 1):
        raise TableError(f"column names collide after flattening: {clashing}")


def cell(column: Column, dtype: T.DataType) -> Column:
    """Nested values as JSON text with sorted keys and all their nulls, everything else unchanged."""
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(F.to_variant_object(column)) if as_variant(dtype) else F.to_json(column)
    return column


def as_variant(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return all(as_variant(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return as_variant(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return isinstance(dtype.keyType, T.StringType) and as_variant(dtype.valueType)
    return isinstance(dtype, (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType))
