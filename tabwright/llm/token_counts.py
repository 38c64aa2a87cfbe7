"""Token counts by overlap resynchronisation: huge texts are cut into overlapping chunks that are encoded apart,
with offsets, and spliced where both neighbours have a boundary that no context can move.

A text of at most `chunk` code points is counted where it is read. A longer one becomes rows of chunks, dealt over
all tasks, so that one long text takes as many tasks as it has chunks. The splice needs, of each chunk, the stable
boundaries inside its two overlaps and the tokens before each: a few hundred numbers however long the text is.
Texts without a common stable boundary in some overlap are cut again, chunks and overlaps four times as wide, until
all are aligned or the text is one chunk.
"""

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.bytebpe import ByteModel
from tabwright.llm.text import chunks, prepare, share, shared
from tabwright.session import Scratch

CHUNK, OVERLAP = 1 << 15, 1 << 10  # code points
WIDEN = 4
KIND_OF = {"space": 0, "letter": 1, "number": 2, "other": 3}
# Characters that are white space, or of some kind, in one regular-expression library but not in another.
UNSURE = "\x1c\x1d\x1e\x1f\x85\u180e\u200b\ufeff"
KINDS = regex.compile(r"(?P<space>\s+)|(?P<letter>\p{L}+)|(?P<number>\p{N}+)|(?P<other>[^\s\p{L}\p{N}]+)")


class Counter:
    """The byte-pair model of a tokenizer file, and what the proof of its boundaries rests on."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        before = parts.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if parts.get("normalizer") or not plain or parts["model"]["type"] != "BPE":
            raise ValueError("boundaries are proven for byte-level BPE files without normalizer and prefix space alone")
        self.model = ByteModel(path)
        vocabulary, marks = parts["model"]["vocab"], parts.get("added_tokens") or []
        self.added = tuple(t["content"] for t in marks)
        self.reach = max(map(len, self.added), default=1)
        self.sizes = np.zeros(max([*vocabulary.values(), *(t["id"] for t in marks)]) + 1, np.int64)
        for text, k in vocabulary.items():
            self.sizes[k] = len(text)  # one character stands for a byte
        for t in marks:
            self.sizes[t["id"]] = len(t["content"].encode())


def stable_boundaries(text: str, low: int, high: int, added: tuple[str, ...]) -> np.ndarray:
    """Places p in [low, high) at which every text that has these characters around p is split by the tokenizer.

    The pattern that cuts a text before merging takes runs of letters, of numbers and of others as far as they go and
    looks ahead only at the end of white space. So a run that is not white space ends a match where the next
    character is of another kind, whatever stands further off, except after an apostrophe, which may join letters.
    A place inside an added token is no boundary.
    """
    kinds = np.concatenate([np.full(m.end() - m.start(), KIND_OF[m.lastgroup], np.int8) for m in KINDS.finditer(text, max(low - 1, 0), high)] or [np.zeros(0, np.int8)])
    first = max(low - 1, 0)
    at = first + 1 + np.flatnonzero((kinds[1:] != kinds[:-1]) & (kinds[:-1] != KIND_OF["space"]))
    at = at[at >= low]
    sure = [p for p in at.tolist() if text[p - 1] != "'" and text[p - 1] not in UNSURE and text[p] not in UNSURE]
    at = np.array(sure, np.int64)
    for token in added:
        begin = text.find(token, max(low - len(token), 0))
        while 0 <= begin < high:
            at = at[(at <= begin) | (at >= begin + len(token))]
            begin = text.find(token, begin + 1)
    return at


BOUNDS = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
CHUNKS = "array<struct<part:int,start:bigint,size:bigint,last:boolean,text:string>>"


def cut(text: Column, chunk: int, overlap: int) -> Column:
    """Chunks of `chunk` code points, each beginning `overlap` before the end of the one before."""
    shape = pa.list_(pa.struct([("part", pa.int32()), ("start", pa.int64()), ("size", pa.int64()), ("last", pa.bool_()), ("text", pa.string())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for t in texts:
                t = t.as_py() or ""
                starts = range(0, max(len(t) - overlap, 1), chunk - overlap)
                out.append([{"part": k, "start": s, "size": len(t[s : s + chunk]), "last": s == starts[-1], "text": t[s : s + chunk]} for k, s in enumerate(starts)])
            yield pa.array(out, shape)

    return F.arrow_udf(run, CHUNKS)(text)


def count_whole(packed: Broadcast, text: Column) -> Column:
    """Tokens of each text as the library counts them; null counts as empty."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared(packed).model
        for texts in batches:
            counts = [np.diff(model.encode_marked(flat, offsets)[1]) for _, flat, offsets in chunks(texts)]
            yield pa.array(np.concatenate(counts) if counts else [], pa.int64())

    return F.arrow_udf(run, "bigint")(text)


def count_chunk(packed: Broadcast, overlap: int) -> Column:
    """Of a chunk (columns start, size, last, text): all its tokens, and the stable boundaries of its overlaps, as
    places in the whole text with the tokens of the chunk before them."""
    shape = pa.struct([("tokens", pa.int64()), ("left", BOUNDS), ("right", BOUNDS)])

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        known = shared(packed)
        reach = known.reach
        for *columns, texts in batches:
            begins, sizes, lasts = (c.to_pylist() for c in columns)
            out = []
            for first, flat, offsets in chunks(texts):
                ids, stops = known.model.encode_marked(flat, offsets)
                for k in range(len(offsets) - 1):
                    data = flat[offsets[k] : offsets[k + 1]]
                    start, size, last, text = begins[first + k], sizes[first + k], lasts[first + k], data.tobytes().decode()
                    ends = np.cumsum(known.sizes[ids[stops[k] : stops[k + 1]]])  # byte offsets of the tokens' ends
                    byte_of = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))

                    def bounds(low, high):
                        # An added token cut by the chunk's edge would go unseen, so places within its reach are left out.
                        low, high = max(low, reach), min(high, size - reach)
                        at = stable_boundaries(text, low, high, known.added) if high > low else np.zeros(0, np.int64)
                        before = np.searchsorted(ends, byte_of[at])
                        split = ends[np.minimum(before, len(ends) - 1)] == byte_of[at]
                        return [{"at": start + p, "before": b + 1} for p, b in zip(at[split].tolist(), before[split].tolist(), strict=True)]

                    left = bounds(0, min(overlap, size)) if start else []
                    right = [] if last else bounds(size - overlap, size)
                    out.append({"tokens": len(ends), "left": left, "right": right})
            yield pa.array(out, shape)

    kind = "struct<tokens:bigint,left:array<struct<at:bigint,before:bigint>>,right:array<struct<at:bigint,before:bigint>>>"
    return F.arrow_udf(run, kind)(F.col("start"), F.col("size"), F.col("last"), F.col("text"))


def splice(chunks: DataFrame) -> DataFrame:
    """name, n_tokens from the chunks of each text; null where two neighbours share no stable boundary.

    Of the common boundaries the last one counts: a chunk gives its tokens from the boundary with the one before
    to the boundary with the one after. Only neighbours meet in a row, never all chunks of a text."""
    order = Window.partitionBy("name").orderBy("part")
    pairs = chunks.withColumn("above", F.lag("right").over(order))
    common = pairs.withColumn("at", F.array_max(F.array_intersect("above.at", "left.at")))

    def before(side: str) -> Column:
        return F.get(F.filter(side, lambda b: b["at"] == F.col("at")), F.lit(0))["before"]

    moved = common.select("name", F.when(F.col("last"), F.col("tokens")).alias("final"), (before("above") - before("left")).alias("moved"), ((F.col("part") > 0) & F.col("at").isNull()).alias("lost"))
    total = F.max("final") + F.coalesce(F.sum("moved"), F.lit(0))
    return moved.groupBy("name").agg(F.when(~F.max("lost"), total).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, scratch: Scratch, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every row of `docs` (doc_id, text).

    Ids are those of the library with its defaults for special strings inside texts, without added ones. Null and
    empty texts have none. Repeated rows and null ids stay rows of their own. An empty table gives none. Other
    columns are not looked at.
    """
    spark = docs.sparkSession
    prepare(spark)
    packed = share(spark, Counter(path))  # a vocabulary file: fixed size
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    long = F.length("text") > chunk
    size = F.octet_length("text").cast("long").alias("n_bytes")
    counted = rows.where(~long).select("doc_id", size, count_whole(packed, F.col("text")).alias("n_tokens"))

    # Written once, so that the name a row gets here stays; a text holds its place in later rounds by that name.
    todo = scratch.table(rows.where(long).select(F.expr("uuid()").alias("name"), "doc_id", size, "text"))
    while not todo.isEmpty():
        pieces = todo.select("name", F.explode(cut(F.col("text"), chunk, overlap)).alias("c")).select("name", "c.*")
        spread = pieces.repartition("name", "part").withColumn("found", count_chunk(packed, overlap))
        done = scratch.table(splice(spread.select("name", "part", "last", "found.*")))
        spliced = done.where("n_tokens is not null")
        counted = counted.unionByName(todo.select("name", "doc_id", "n_bytes").join(spliced, "name").drop("name"))
        todo = scratch.table(todo.join(done.where("n_tokens is null"), "name", "left_semi"))
        chunk, overlap = chunk * WIDEN, overlap * WIDEN
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
