"""Packing of token documents into fixed-length sequences: first-fit decreasing by a tournament tree."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.bytebpe import ByteCodec
from tabwright.session import Scratch

LENGTH = 2048
GROUP_PIECES = 4096  # pieces packed together; groups are random, so each is a fair sample of lengths
END_ID = 1
PIECE = "piece long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Bins:
    """Bins of equal capacity under a tournament tree: every node holds the most free room below it."""

    def __init__(self, count: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(1, count):
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for `size`, and the offset there."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        offset = self.capacity - room[node]
        room[node] -= size
        bin_number = node - self.leaves
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return bin_number, offset


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece. Larger pieces first, equal ones in the given order; every size fits a bin."""
    bins, out = Bins(len(sizes), capacity), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = bins.place(sizes[i])
    return out


def cut(ids: Column, length: int = LENGTH) -> Column:
    """Array of pieces (start, length, ids_crc32) of packed ids; the last piece may be short."""
    tokens = (F.length(ids) / 4).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), tokens - 1, F.lit(length).cast("long"))
    return F.when(
        tokens > 0,
        F.transform(
            starts,
            lambda s: F.struct(
                s.alias("start"),
                F.least(tokens - s, F.lit(length)).cast("long").alias("length"),
                F.crc32(F.substr(ids, (s * 4 + 1).cast("int"), F.lit(length * 4))).alias("ids_crc32"),
            ),
        ),
    )


def token_pieces(docs: DataFrame, codec: ByteCodec, length: int = LENGTH, end: int = END_ID) -> DataFrame:
    """One row per piece of at most `length` ids: doc_id, start, length, ids_crc32, doc_tokens.

    Every row of docs is a document, whatever its id: null and empty texts have the end id alone, null and
    repeated ids are kept. Other columns are not read.
    """
    encoded = docs.select(F.col("doc_id"), codec.encode(F.col("text"), end).alias("ids"))
    pieces = encoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("doc_tokens"), F.explode(cut(F.col("ids"), length)).alias("p"))
    return pieces.select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens")


def pack(pieces: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Give every piece a sequence_id and its offset there; offsets of a sequence leave no gap.

    A piece of full length is a sequence by itself. The others are dealt into random groups, as many as
    the counted pieces ask for, and each group is packed on its own, so no task holds more than a group.
    The pieces are written once to the shared folder, which fixes their numbers whatever executors are lost.
    An empty table gives no rows.
    """
    spark = pieces.sparkSession
    written = Scratch(spark).table(
        pieces.select(F.monotonically_increasing_id().alias("piece"), "doc_id", "start", "length", "ids_crc32", "doc_tokens")
    )
    short = written.where(F.col("length") < length)
    groups = max(1, -(-short.count() // group_pieces))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("piece")
        placed = first_fit_decreasing(rows["length"].to_pylist(), length)
        first = rows["part"][0].as_py() << 24
        rows = rows.drop_columns(["part"]).append_column("sequence_id", pa.array([2 * (first + b) for b, _ in placed], pa.int64()))
        return rows.append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    packed = (
        short.withColumn("part", F.pmod(F.xxhash64("piece", F.lit(20)), F.lit(groups)))
        .groupBy("part")
        .applyInArrow(run, f"{PIECE}, sequence_id long, offset long")
    )
    full = written.where(F.col("length") >= length).select("*", (2 * F.col("piece") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full).drop("piece")
