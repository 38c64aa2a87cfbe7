"""How to read a source."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import PurePosixPath

from tabwright.errors import TableError

# Encoding names whose Spark spelling differs.
ENCODINGS = {"utf-8-sig": "UTF-8", "utf8": "UTF-8", "latin1": "ISO-8859-1", "latin-1": "ISO-8859-1"}
# Encodings Spark reads only with the session setting for legacy character sets.
LEGACY_ENCODINGS = ("cp1252", "cp1258")
FORMATS = {".csv": "csv", ".tsv": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet"}


@dataclass
class LoadOptions:
    encoding: str = "utf-8-sig"
    delimiter: str | None = None
    decimal: str = "."
    missing_tokens: list[str] = field(default_factory=list)
    json_path: str = ""
    infer_numeric: bool = True
    multi_line: bool | None = None
    max_rows: int | None = None
    max_columns: int | None = None
    max_bytes: int | None = None

    def __post_init__(self):
        if self.decimal not in (".", ","):
            raise TableError("decimal must be '.' or ','")
        if self.delimiter is not None and len(self.delimiter) != 1:
            raise TableError("the delimiter must be one character")

    def spark_encoding(self, spark) -> str:
        name = self.encoding.lower()
        if name in LEGACY_ENCODINGS:
            # Reads are lazy, so the setting has to outlive this call.
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        return ENCODINGS.get(name, self.encoding)


def suffix_of(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).suffix.lower()


def format_of(path: str) -> str:
    if suffix_of(path) not in FORMATS:
        raise TableError("unsupported format; use CSV, TSV, JSON, JSONL or Parquet")
    return FORMATS[suffix_of(path)]
