"""The place of a row in its source: file by name, block, position, packed into one ordered number.

How many bits each part takes follows from the listing, so neither many files nor long ones meet a fixed limit; only
a source with more than 2^63 places in all is refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.errors import TableError
from tabwright.functions.names import q

PLACE = "__place"
ROW_BITS = 40  # rows of one file, for formats that number them


@dataclass(frozen=True)
class Places:
    names: DataFrame  # file, number
    block_bits: int
    index_bits: int

    @property
    def file_shift(self) -> int:
        return self.block_bits + self.index_bits


def one_slash(path: Column) -> Column:
    """Listings and scans write the slashes after a scheme differently."""
    return F.regexp_replace(path, "^([A-Za-z0-9.+-]+):/+", "$1:/")


def place_lines(scan: DataFrame, path: str) -> tuple[DataFrame, Places]:
    """Lines of a text source with PLACE: file, block, and the line's position in its task.

    Positions grow within a block but do not begin at 0, since a task may read several blocks."""
    spark = scan.sparkSession
    conf = spark._jsparkSession.sessionState().conf()
    unit = min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes())  # no block is smaller
    longest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
    block_bits = (longest // unit + 1).bit_length()
    index = F.monotonically_increasing_id() % (1 << 33)

    def inside(bits: int) -> Column:
        checked = F.when(index < 1 << bits, index).otherwise(F.raise_error(F.lit("a task has too many lines; give row_id")).cast("long"))
        return F.floor(F.col("_metadata.file_block_start") / unit) * (1 << bits) + checked

    return _placed(scan, inside, block_bits)


def place_rows(scan: DataFrame) -> tuple[DataFrame, Places]:
    """Rows of a format that numbers them in each file: places do not depend on how files are cut or packed."""
    return _placed(scan, lambda bits: F.col("_metadata.row_index"), 0)


def _placed(scan: DataFrame, inside, block_bits: int) -> tuple[DataFrame, Places]:
    spark = scan.sparkSession
    files = sorted(scan.inputFiles())
    index_bits = min(63 - max(len(files) - 1, 0).bit_length() - block_bits, ROW_BITS)
    if index_bits < 28:
        raise TableError("more files and blocks than places; give row_id")
    # One row per file, as in the listing that the driver holds anyway.
    names = spark.createDataFrame([(name, k) for k, name in enumerate(files)], "file string, number long")
    numbers = F.broadcast(names.select(one_slash(F.col("file")).alias("__file"), F.col("number").alias("__number")))
    rows = scan.select(*[q(name) for name in scan.columns], one_slash(F.col("_metadata.file_path")).alias("__path"), inside(index_bits).alias("__inside"))
    joined = rows.join(numbers, F.col("__path") == F.col("__file"), "left")
    number = F.coalesce("__number", F.raise_error(F.lit("a row of a file that is not listed")).cast("long"))
    place = number * (1 << (block_bits + index_bits)) + F.col("__inside")
    return joined.select(place.cast("long").alias(PLACE), *[q(name) for name in scan.columns]), Places(names, block_bits, index_bits)
