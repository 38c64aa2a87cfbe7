"""Bottom-k sketches of character shingles: mergeable fingerprints of texts."""

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.text import chunks, code_points, flat_bytes, prepare, span_hashes, window_hashes

SIZE = 128  # kept hashes; the standard error of a likeness is at most 0.5 / sqrt(SIZE)
WIDTH = 12  # code points of a shingle
RANGE = 2.0**64


def bottom(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The smallest distinct hashes, sorted."""
    if len(hashes) > 4 * size:
        cut = 2 * size
        while True:
            low = np.unique(np.partition(hashes, cut)[: cut + 1])
            if len(low) >= size or cut >= len(hashes) - 1:
                return low[:size]
            cut = min(4 * cut, len(hashes) - 1)
    return np.unique(hashes)[:size]


def sketches(points: np.ndarray, offsets: np.ndarray, size: int = SIZE, width: int = WIDTH) -> list[np.ndarray]:
    """Sketch of each text; a text shorter than a shingle is one shingle, an empty text has none."""
    rolled = window_hashes(points, width)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(bottom(rolled[a : b - width + 1], size))
        elif b > a:
            out.append(span_hashes(points[a:b], np.array([0]), np.array([b - a])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def merged(one: np.ndarray, two: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.union1d(one, two)[:size]


def distinct_count(sketch: np.ndarray, size: int = SIZE) -> float:
    """Estimated number of distinct shingles; exact below the sketch size."""
    return float(len(sketch)) if len(sketch) < size else (size - 1) / ((float(sketch[-1]) + 1) / RANGE)


def resemblance(one: np.ndarray, two: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity; two empty sets are alike."""
    both = np.sort(np.concatenate([one, two]))
    if not len(both):
        return 1.0
    twice = both[1:] == both[:-1]
    union = both[np.concatenate([[True], ~twice])][:size]
    shared = both[1:][twice]
    return float(np.searchsorted(shared, union[-1], side="right")) / len(union)


def containment(one: np.ndarray, two: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of the first set that the second holds; nothing is held whole."""
    if not len(one):
        return 1.0
    union = distinct_count(merged(one, two, size), size)
    return min(1.0, resemblance(one, two, size) * union / distinct_count(one, size))


def packed(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def unpacked(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def fingerprint(text: Column, size: int = SIZE, width: int = WIDTH) -> Column:
    """Fingerprint of each whole text, null counting as empty. Equal texts have equal fingerprints."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for _, flat, offsets in chunks(texts):
                out += [packed(s) for s in sketches(*code_points(flat, offsets), size, width)]
            yield pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(text)


def combine(prints: list[str], size: int = SIZE) -> str:
    """Fingerprint of the union of the texts' shingles, from their fingerprints alone."""
    out = np.zeros(0, np.uint64)
    for p in prints:
        out = merged(out, unpacked(p), size)
    return packed(out)


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text, part: each part holds a range of ids in full and the first row of the next range.

    Order is by doc_id, null first, then by the text's hash. Range limits are quantiles of the ids, as many
    as parts; each range's first row is found by an aggregate with map-side combine. The last range gets the
    first row of all.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    limits = sorted(set(rows.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    infinity = float("inf")
    ranges = Bucketizer(splits=[-infinity, *(limits or [0.0]), infinity], inputCol="place", outputCol="range")
    placed = ranges.transform(rows.withColumn("place", F.coalesce(F.col("doc_id").cast("double"), F.lit(-infinity))))
    placed = placed.select("doc_id", "text", F.xxhash64("text").alias("text_key"), F.col("range").cast("int").alias("part"))
    firsts = placed.groupBy("part").agg(F.min(F.struct("doc_id", "text_key")).alias("f"))
    before = F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy()))
    # One row per range: bounded by the number of parts.
    firsts = F.broadcast(firsts.select(F.col("part").alias("of"), F.col("f.doc_id").alias("first_id"), F.col("f.text_key").alias("first_key"), before.alias("before")))
    is_first = (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
    copies = F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("extra")), F.struct(F.col("before").alias("part"), F.lit(1).alias("extra")))
    marked = placed.join(firsts, is_first, "left").withColumn("p", F.explode(F.filter(copies, lambda x: x["part"].isNotNull())))
    return marked.select("doc_id", "text", "text_key", "p.part", "p.extra")


def edited_fingerprints(docs: DataFrame, size: int = SIZE, width: int = WIDTH) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last quarter replaced by as much of the next one.

    The next document is that of the next larger id, after the last the first. Null ids come first; rows of
    one id follow the hash of their text. A table of one row is its own next. Null texts are empty. Columns
    other than doc_id and text are not read. Texts cross the network once, into ranges of ids.
    """
    import hashlib

    spark = docs.sparkSession
    prepare(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def sketch_all(texts: list[str]) -> list[np.ndarray]:
        flat, offsets = flat_bytes(pa.array(texts, pa.large_string()))
        return sketches(*code_points(flat, offsets), size, width)

    def rows_of(held: list[tuple], following: list[tuple]) -> list[tuple]:
        """Result rows of consecutive documents; following: their next ones."""
        texts = [t for _, t in held]
        edited = []
        for (_, text), (_, other) in zip(held, following, strict=True):
            cut = len(text) // 4
            edited.append(text[: len(text) - cut] + other[:cut] if cut else text)
        own, changed, nexts = sketch_all(texts), sketch_all(edited), sketch_all([following[-1][1]])
        nexts = own[1:] + nexts
        return [
            (held[i][0], len(texts[i]), hashlib.sha256(edited[i].encode()).hexdigest(), packed(own[i]), packed(changed[i]),
             resemblance(own[i], changed[i], size), resemblance(own[i], nexts[i], size))
            for i in range(len(held))
        ]

    shape = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task reads whole ranges in order; a row marked extra ends its range and has no result of its own."""
        held, done = [], False

        def emit(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            out = []
            columns = [batch.column(k).to_pylist() for k in range(3)]
            del batch
            for doc_id, text, extra in zip(*columns, strict=True):
                if extra and done:
                    continue  # a repeated row of the next range's first document
                row = (doc_id, text)
                if done:
                    held, done = [], False
                held.append(row)
                if extra or sum(len(t) for _, t in held[:-1]) > (1 << 18):
                    out += rows_of(held[:-1], held[1:])
                    held = [row]
                    done = bool(extra)
            if out:
                yield emit(out)
        if held and not done:
            raise AssertionError("a range ended without its next document")

    ranged = with_next(docs, parts).repartition(parts, "part").sortWithinPartitions("part", "extra", "doc_id", "text_key")
    return ranged.select("doc_id", "text", "extra").mapInArrow(run, shape)
