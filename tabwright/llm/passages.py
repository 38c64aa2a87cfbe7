"""Removal of repeated passages: suffix trees over words, partitioned by prefixes of variable length."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.shingles import rolling
from tabwright.llm.text import chunks, prepare, span_hashes, span_index, strings, word_spans
from tabwright.session import Scratch

WINDOW = 35
ANCHOR = 8  # words of an anchor; a window holds WINDOW - ANCHOR + 1 of them and is represented by the least
PREFIXES = (8, 20)  # prefix lengths: a group that is too large is split by the next, at last by the whole window
GROUP = 50_000  # suffixes of one task's trees


def windowed_least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value, the leftmost of equal ones, in every `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, reach = np.arange(len(values)), 1
    while reach < width:  # best[i] covers values[i : i + reach]
        step = min(reach, width - reach)
        one, two = best[: len(best) - step], best[step:]
        best = np.where(values[two] < values[one], two, one)
        reach += step
    return best[:n]


def list_parts(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, values) of a list column; null lists are empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]), column.flatten()


def list_column(parts: list[list[np.ndarray]], sizes: list[int], shape: pa.StructType) -> pa.Array:
    """List column of structs from the fields of each part."""
    fields = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * shape.num_fields
    values = pa.StructArray.from_arrays([pa.array(x, shape[i].type) for i, x in enumerate(fields)], fields=list(shape))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def runs(window: int):
    """Arrow function of texts: runs of consecutive windows with one anchor: first window, windows, anchor,
    hash of all their words."""
    shape = pa.struct([("at", pa.int32()), ("size", pa.int32()), ("anchor", pa.int64()), ("run", pa.int64())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts, sizes = [], []
            for _, flat, offsets in chunks(texts):
                starts, ends, words = word_spans(flat, offsets)
                names = span_hashes(flat, starts, ends)
                grams = rolling(names, ANCHOR)
                least = windowed_least(grams, window - ANCHOR + 1)
                n = len(least)
                # Windows that lie in one text, text by text.
                whole = np.zeros(n, bool)
                counts = np.maximum(np.diff(words) - window + 1, 0)
                own = span_index(words[:-1], counts)
                whole[own] = True
                text = np.repeat(np.arange(len(counts)), counts)
                at = least[own]
                begin = np.ones(len(own), bool)
                begin[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
                first = np.flatnonzero(begin)
                size = np.diff(np.append(first, len(own)))
                begins = own[first]
                hashes = span_hashes(names, begins, begins + size - 1 + window) if len(first) else np.zeros(0, np.uint64)
                parts.append([(begins - words[text[first]]).astype(np.int32), size.astype(np.int32), grams[at[first]].view(np.int64), hashes.view(np.int64)])
                sizes += np.bincount(text[first], minlength=len(counts)).tolist()
            yield list_column(parts, sizes, shape)

    return F.arrow_udf(run, "array<struct<at:int,size:int,anchor:bigint,run:bigint>>")


def suffixes(window: int):
    """Arrow function of texts and some of their runs: one suffix per window: its run, its place there, the
    hashes of its prefixes of growing length, and that of the whole window."""
    fields = [("kind", pa.int64()), ("place", pa.int32()), *((f"p{n}", pa.int64()) for n in PREFIXES), ("leaf", pa.int64())]
    shape = pa.struct(fields)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, some in batches:
            limits, values = list_parts(some)
            at, size, kind = (values.field(x).to_numpy(zero_copy_only=False) for x in ("at", "size", "kind"))
            parts, sizes = [], []
            for first, flat, offsets in chunks(texts):
                starts, ends, words = word_spans(flat, offsets)
                names = span_hashes(flat, starts, ends)
                low, high = limits[first], limits[first + len(offsets) - 1]
                text = np.repeat(np.arange(len(offsets) - 1), np.diff(limits[first : first + len(offsets)]))
                count = size[low:high].astype(np.int64)
                begins = words[text] + at[low:high]
                where = span_index(begins, count)
                of = np.repeat(np.arange(low, high), count)
                hashes = [span_hashes(names, where, where + n).view(np.int64) for n in (*PREFIXES, window)]
                parts.append([kind[of], (where - np.repeat(begins, count)).astype(np.int32), *hashes])
                sizes += np.bincount(np.repeat(text, count), minlength=len(offsets) - 1).tolist()
            yield list_column(parts, sizes, shape)

    shown = "kind:bigint,place:int," + ",".join(f"p{n}:bigint" for n in PREFIXES) + ",leaf:bigint"
    return F.arrow_udf(run, f"array<struct<{shown}>>")


def deep_nodes(rows: pa.Table) -> pa.Table:
    """The suffix trees of one task: suffixes sorted along their prefixes are their leaves in order, and
    neighbours that agree over the whole window hang below one internal node of that depth: they repeat."""
    order = [*(f"p{n}" for n in PREFIXES), "leaf"]
    rows = rows.sort_by([(name, "ascending") for name in order])
    same = np.ones(max(len(rows) - 1, 0), bool)
    for name in order:
        values = rows[name].to_numpy()
        same &= values[1:] == values[:-1]
    deep = np.zeros(len(rows), bool)
    deep[1:] |= same
    deep[:-1] |= same
    return rows.select(["kind", "place"]).filter(pa.array(deep))


def repeated_places(leaves: DataFrame, scratch: Scratch, group: int = GROUP) -> DataFrame:
    """(kind, place) of the suffixes whose window is also that of another suffix.

    The shortest prefix under which there are at most `group` suffixes names a suffix's tree; trees are dealt
    into as many tasks as the suffixes ask for. Suffixes whose whole window is shared by more than `group` are
    one node that needs no tree.
    """
    leaves = scratch.table(leaves)
    tasks = max(1, -(-leaves.count() // group) * 2)
    open_, found = leaves, None
    for name in (*(f"p{n}" for n in PREFIXES), "leaf"):
        # At most one in `group` suffixes: a table so small that it is usually broadcast, and mostly empty.
        large = scratch.table(open_.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).select(name))
        some = not large.isEmpty()
        dealt = open_.join(large, name, "left_anti") if some else open_
        trees = dealt.withColumn("task", F.pmod(F.xxhash64(name), F.lit(tasks))).groupBy("task").applyInArrow(deep_nodes, "kind long, place int")
        found = trees if found is None else found.unionByName(trees)
        if not some:
            return found
        open_ = open_.join(large, name, "left_semi")
    return found.unionByName(open_.select("kind", "place"))


def covered(window: int):
    """Arrow function of texts and their repeated windows: word count, removed words, the text of those kept."""
    shape = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            limits, values = list_parts(found)
            at, size = (values.field(x).to_numpy(zero_copy_only=False) for x in ("at", "size"))
            inner, places = list_parts(values.field("places"))
            places = places.to_numpy(zero_copy_only=False)
            out = []
            for first, flat, offsets in chunks(texts):
                starts, ends, words = word_spans(flat, offsets)
                change = np.zeros(len(starts) + 1, np.int64)
                low, high = limits[first], limits[first + len(offsets) - 1]
                base = np.repeat(words[:-1], np.diff(limits[first : first + len(offsets)])) + at[low:high]
                full = size[low:high] > 0
                some = np.diff(inner)[low:high]
                begin = np.concatenate([base[full], np.repeat(base, some) + places[inner[low] : inner[high]]])
                length = np.concatenate([size[low:high][full] - 1 + window, np.full(len(begin) - int(full.sum()), window)])
                np.add.at(change, begin, 1)
                np.add.at(change, begin + length, -1)
                gone = np.cumsum(change)[:-1] > 0
                keep = np.flatnonzero(~gone)
                kept_words = np.searchsorted(keep, words)
                lengths = (ends - starts)[keep]
                last = np.zeros(len(keep), bool)
                some_kept = np.diff(kept_words) > 0
                last[kept_words[1:][some_kept] - 1] = True
                steps = lengths + ~last
                places_out = np.concatenate([[0], np.cumsum(steps)])
                data = np.full(places_out[-1], 0x20, np.uint8)
                data[span_index(places_out[:-1], lengths)] = flat[span_index(starts[keep], lengths)]
                n_words = np.diff(words)
                out.append(pa.StructArray.from_arrays(
                    [pa.array(n_words, pa.int64()), pa.array(n_words - np.diff(kept_words), pa.int64()), strings(data, places_out[kept_words]).cast(pa.string())],
                    fields=list(shape),
                ))
            yield pa.concat_arrays(out) if out else pa.array([], shape)

    return F.arrow_udf(run, "n_words long, n_removed long, kept string")


def without_repeats(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept: every row of docs without the words of repeated windows.

    1. A window is represented by the least of its anchors, so equal windows have equal anchors. Windows of
    one text with one anchor form a run; an anchor that occurs once in the corpus ends there. 2. Where all
    runs of an anchor are equal, all their windows repeat; no tree is needed. 3. Of every other anchor one
    run of each kind goes into the suffix trees, once, however many copies it has; a kind with copies repeats
    throughout, of a single run those windows that the trees find in another. 4. Texts are read once more and
    lose the covered words. Copies, hot anchors and hot passages are pre-aggregated and never gathered.

    Null and empty texts have no words and give the empty text. Rows that repeat are documents of their own,
    so all their windows repeat; null ids are ids like others. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    found = texts.select("doc_id", "text_key", F.explode(runs(window)(F.col("text"))).alias("r"))
    every = scratch.table(found.select("doc_id", "text_key", "r.*"))
    often = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("run").alias("low"), F.max("run").alias("high"))
    often = often.where("n > 1").select("anchor", (F.col("low") == F.col("high")).alias("alike"))
    shared = scratch.table(every.join(often, "anchor"))
    scratch.drop(every)

    mixed = shared.where("not alike")
    shown = F.min(F.struct("doc_id", "text_key", "at", "size")).alias("shown")
    kinds = mixed.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("n"), shown)
    kinds = scratch.table(kinds.withColumn("kind", F.monotonically_increasing_id()))  # written: the numbers stay
    asked = kinds.groupBy(F.col("shown.doc_id").alias("some_id"), F.col("shown.text_key").alias("some_key")).agg(
        F.collect_list(F.struct("shown.at", "shown.size", "kind")).alias("some")
    )
    same_row = F.col("doc_id").eqNullSafe(F.col("some_id")) & (F.col("text_key") == F.col("some_key"))
    held = texts.join(asked, same_row).dropDuplicates(["doc_id", "text_key"])
    leaves = held.select(F.explode(suffixes(window)(F.col("text"), F.col("some"))).alias("s")).select("s.*")
    places = repeated_places(leaves, scratch, group).groupBy("kind").agg(F.sort_array(F.collect_list("place")).alias("places"))
    none = F.array().cast("array<int>")
    judged = kinds.join(places, "kind", "left").select(
        "anchor", "run", (F.col("n") > 1).alias("whole"), F.when(F.col("n") > 1, none).otherwise(F.coalesce("places", none)).alias("places")
    )
    judged = judged.where(F.col("whole") | (F.size("places") > 0))
    spans = shared.where("alike").select("doc_id", "text_key", "at", "size", none.alias("places")).unionByName(
        mixed.join(judged, ["anchor", "run"]).select("doc_id", "text_key", "at", F.when(F.col("whole"), F.col("size")).otherwise(0).alias("size"), "places")
    )
    spans = spans.groupBy(F.col("doc_id").alias("some_id"), F.col("text_key").alias("some_key")).agg(
        F.collect_set(F.struct("at", "size", "places")).alias("found")
    )
    spans = scratch.table(spans)
    scratch.drop(shared)
    return texts.join(spans, same_row, "left").select("doc_id", covered(window)(F.col("text"), F.col("found")).alias("c")).select("doc_id", "c.*")
