"""Vectorised text helpers used inside tasks: flat buffers of many texts, words, span hashes.

Everything works on one Arrow batch at a time, in chunks of bounded size; a chunk is larger only
when a single text is.
"""

import pickle
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import SparkSession

CHUNK_BYTES = 1_500_000
BATCH_BYTES = 8 << 20
# Odd multipliers of the polynomial and of the finalising mix.
BASE = 0x9E3779B97F4A7C15 | 1
MIX_1, MIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
POLYNOMIAL_UP_TO = 32  # values of a span
# The separators of a word are space and the code points 9 to 13.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def prepare(spark: SparkSession) -> None:
    """Send texts to Python in batches of bounded bytes, however long the single texts are, and give up the
    shuffle files of a finished write, which nothing reads again."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def share(spark: SparkSession, value) -> Broadcast:
    """Send a value of bounded size to all executors, with the classes of this package it needs."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(value: Broadcast):
    return pickle.loads(value.value)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and the offsets of each; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows holding about `limit` bytes."""
    flat, offsets = flat_bytes(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, flat[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def code_points(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts as code points."""
    points = np.frombuffer(flat.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(flat):
        return points, offsets
    begins = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
    return points, begins[offsets]


def span_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all spans, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over a 64-bit word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(MIX_1)
    h ^= h >> np.uint64(33)
    h *= np.uint64(MIX_2)
    return h ^ (h >> np.uint64(33))


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """64-bit hash of each span of `values`, by its contents and length alone.

    A polynomial modulo 2^64 tells short spans apart; in long ones words of two symbols with a regular structure cancel
    out under any base, so those are digested.
    """
    n = len(values)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(n, base), out=prefix[1:])
    back = powers(n + 1, pow(base, -1, 1 << 64))
    h = (prefix[ends] - prefix[starts]) * back[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(MIX_2))
    long = np.flatnonzero(ends - starts > POLYNOMIAL_UP_TO)
    if len(long):
        data, width, key = memoryview(np.ascontiguousarray(values)).cast("B"), values.itemsize, base.to_bytes(8, "little")
        spans = zip((starts[long] * width).tolist(), (ends[long] * width).tolist(), strict=True)
        h[long] = np.frombuffer(b"".join([blake2b(data[a:b], digest_size=8, key=key).digest() for a, b in spans]), np.uint64)
    return h


def window_hashes(values: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Hash of values[i:i+width] for every i with a whole window."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(n)
    return span_hashes(values, starts, starts + width, base)


def word_spans(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets of each text): maximal runs without separators, never across texts."""
    separator = np.zeros(256, bool)
    separator[list(SEPARATORS)] = True
    gap = separator[flat]
    inside = np.empty(len(flat) + 1, bool)
    inside[:-1] = ~gap
    inside[-1] = False
    begin = inside[:-1].copy()
    begin[1:] &= gap[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(flat)]
    begin[edges] = inside[edges]
    starts = np.flatnonzero(begin)
    finish = np.empty(len(flat) + 1, bool)
    finish[0] = False
    finish[1:] = ~gap
    stop = np.ones(len(flat) + 1, bool)
    stop[:-1] = gap
    stop[edges] = True
    ends = np.flatnonzero(finish & stop)
    return starts, ends, np.searchsorted(starts, offsets)


def strings(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The flat bytes as an Arrow column."""
    data = np.ascontiguousarray(flat, np.uint8)
    return pa.Array.from_buffers(
        pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)]
    )


def binaries(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(flat).view(np.uint8)
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)]
    )


def lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def first_seen(codes: np.ndarray, n: int) -> np.ndarray:
    """Position of the first occurrence of each of n codes."""
    out = np.zeros(n, np.int64)
    out[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return out
