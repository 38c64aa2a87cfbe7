"""Quality rules: counts per text, and perplexity under a character n-gram model with language-specific bands."""

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.shingles import rolling
from tabwright.llm.text import chunks, code_points, mix, prepare, share, shared, span_hashes, span_index, word_spans
from tabwright.session import Scratch

ORDER = 4
SYMBOL_BITS = 16  # of a code; ORDER symbols fill 64 bits
FOLDED, FOLDS = 0xD800, 2048  # characters beyond U+FFFF take the numbers that surrogates leave free, modulo FOLDS
HELD = 1 << 21  # n-grams a counting task holds before it passes them on
SHARD = 1 << 20  # entries of a model in one file; a scoring task holds CACHED such files at most
CACHED = 12
SALTS = 32  # rows of one model are spread over so many slots wherever its parameters are joined
BAND = 10.0  # a text is rejected beyond so many times the spread of its language's log perplexities on that side
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
MARKS = b"#*$%&|<>"


def symbol_table() -> np.ndarray:
    """The model's symbol of every code point: the character itself in lower case, one digit, one white space.

    0 stands before a text. A character beyond U+FFFF shares its symbol with those FOLDS further on.
    """
    out = np.arange(0x110000, dtype=np.uint32)
    out[0x10000:] = FOLDED + out[0x10000:] % FOLDS
    out[0] = 0x20
    for c in range(1, 0x10000):
        text = chr(c)
        if text.isspace():
            out[c] = 0x20
        elif unicodedata.category(text) == "Nd":
            out[c] = ord("0")
        elif len(low := text.lower()) == 1:
            out[c] = ord(low)
    return out.astype(np.uint16)


def gram_codes(points: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Code of the n-gram that ends at each character; texts begin with empty context."""
    sizes = np.diff(offsets)
    symbols = np.zeros(len(points) + (ORDER - 1) * len(sizes), np.uint64)
    shift = np.repeat((np.arange(len(sizes)) + 1) * (ORDER - 1), sizes)
    where = np.arange(len(points)) + shift
    symbols[where] = table[points]
    code = np.zeros(len(points), np.uint64)
    for k in range(ORDER - 1, -1, -1):
        code = (code << np.uint64(SYMBOL_BITS)) | symbols[where - k]
    return code.view(np.int64)


def context_of(code: np.ndarray) -> np.ndarray:
    return (code.view(np.uint64) >> np.uint64(SYMBOL_BITS)).view(np.int64)


def lowest(code, symbols: int):
    """The last symbols of a code."""
    return code if symbols == ORDER else code & ((1 << SYMBOL_BITS * symbols) - 1)


def fold(text: Column) -> Column:
    """Half of the corpus a text belongs to; equal texts belong together."""
    return F.pmod(F.xxhash64(text), F.lit(2))


def model_name(lang: Column, half: Column) -> Column:
    return F.xxhash64(lang, half)


def count_grams(docs: DataFrame) -> DataFrame:
    """(model, code, n): n-gram counts of all whole texts of (model, text) rows, summed in each task before the shuffle."""

    packed = share(docs.sparkSession, symbol_table())  # of fixed size

    def batch_of(model: int, parts: list) -> pa.RecordBatch:
        codes, counts = _summed(parts)
        names = pa.array(np.full(len(codes), model), pa.int64())
        return pa.RecordBatch.from_arrays([names, pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["model", "code", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = shared(packed), {}, 0
        for batch in batches:
            models = batch.column(0).to_numpy()
            for first, flat, offsets in chunks(batch.column(1)):
                points, ends = code_points(flat, offsets)
                code = gram_codes(points, ends, table)
                own = models[first : first + len(ends) - 1]
                for model in np.unique(own).tolist():
                    rows = np.flatnonzero(own == model)
                    some = code[span_index(ends[rows], ends[rows + 1] - ends[rows])]
                    parts = held.setdefault(model, [])
                    parts.append(np.unique(some, return_counts=True))
                    size += len(parts[-1][0])
                if size > HELD:
                    held = {model: [_summed(parts)] for model, parts in held.items()}
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size > HELD // 2:
                        for model, parts in held.items():
                            yield batch_of(model, parts)
                        held, size = {}, 0
        for model, parts in held.items():
            yield batch_of(model, parts)

    return docs.mapInArrow(count, "model long, code long, n long").groupBy("model", "code").agg(F.sum("n").alias("n"))


def _summed(parts):
    codes, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(inverse, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def spread_join(rows: DataFrame, small: DataFrame, key: str, spread: Column) -> DataFrame:
    """Left join of many rows with a table of one row per key, of which one may hold most rows."""
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed(key, "small_key")
    slots = rows.withColumn("slot", F.pmod(F.hash(spread), F.lit(SALTS)))
    return slots.join(salted, F.col(key).eqNullSafe(F.col("small_key")) & (F.col("slot") == F.col("salt")), "left").drop("slot", "salt", "small_key")


def discounts(counts: list[Column]) -> Column:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from how many n-grams have counts of 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (F.greatest(c, F.lit(1)) for c in counts)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return F.array(*[F.greatest(F.least(d, F.lit(0.9 * (k + 1))), F.lit(0.1)) for k, d in enumerate(raw)])


def kneser_ney(grams: DataFrame, scratch: Scratch) -> DataFrame:
    """(model, kind, code, value) from (model, code, n): interpolated modified Kneser-Ney, by grouping and joins.

    Shorter n-grams count the different symbols seen before them. Kinds 1 to ORDER are n-grams of that length with
    the log of their last symbol's probability, kinds ORDER + 1 to 2 * ORDER their contexts with the log of the
    weight of what is shorter. Below single symbols all symbols of the model and one unknown are equally likely.
    """
    levels = {ORDER: scratch.table(grams)}
    for order in range(ORDER - 1, 0, -1):
        code = F.col("code").bitwiseAND(F.lit((1 << SYMBOL_BITS * order) - 1))
        levels[order] = scratch.table(levels[order + 1].groupBy("model", code.alias("code")).agg(F.count(F.lit(1)).alias("n")))
    sizes = [
        level.groupBy("model").agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)], F.count(F.lit(1)).alias("n_codes")).withColumn("order", F.lit(order))
        for order, level in levels.items()
    ]
    cuts = reduce(DataFrame.unionByName, sizes).withColumn("d", discounts([F.col(f"n{k}") for k in (1, 2, 3, 4)]))
    cuts = scratch.table(cuts.select("model", "order", "d", (1 / (F.col("n_codes") + 1)).alias("uniform")))

    lower, out = None, []
    for order in range(1, ORDER + 1):
        rows = spread_join(levels[order], cuts.where(F.col("order") == order).drop("order"), "model", F.col("code"))
        rows = rows.withColumn("cut", F.element_at("d", F.least("n", F.lit(3)).cast("int"))).withColumn("context", F.shiftrightunsigned("code", SYMBOL_BITS))
        contexts = scratch.table(rows.groupBy("model", "context").agg(F.sum("n").alias("total"), F.log(F.sum("cut") / F.sum("n")).alias("weight")))
        rows = rows.join(contexts, ["model", "context"])
        own = (F.col("n") - F.col("cut")) / F.col("total")
        if lower is None:
            chance = rows.select("model", "code", (own + F.exp("weight") * F.col("uniform")).alias("chance"))
        else:
            rows = rows.withColumn("short", F.col("code").bitwiseAND(F.lit((1 << SYMBOL_BITS * (order - 1)) - 1)))
            below = lower.select("model", F.col("code").alias("short"), F.col("chance").alias("below"))
            chance = rows.join(below, ["model", "short"]).select("model", "code", (own + F.exp("weight") * F.col("below")).alias("chance"))
        lower = scratch.table(chance)
        out.append(lower.select("model", F.lit(order).alias("kind"), "code", F.log("chance").cast("float").alias("value")))
        out.append(contexts.select("model", F.lit(ORDER + order).alias("kind"), F.col("context").alias("code"), F.col("weight").cast("float").alias("value")))
    unknown = cuts.where(F.col("order") == 1).select("model", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("code"), F.log("uniform").cast("float").alias("value"))
    return reduce(DataFrame.unionByName, out, unknown)


def train(docs: DataFrame, scratch: Scratch) -> str:
    """Folder of the models of (model, text) rows: each has files of sorted codes, at most SHARD in one.

    Models grow with the corpus; neither the driver nor any task holds more than some files of one.
    """
    entries = scratch.table(kneser_ney(count_grams(docs), scratch))
    parts = entries.groupBy("model").agg(F.ceil(F.count(F.lit(1)) / SHARD).alias("parts"))
    spread = spread_join(entries, parts, "model", F.col("code")).withColumn("part", F.pmod(F.xxhash64("code"), F.col("parts")))
    target = scratch.path("models")
    files = spread.repartition("model", "part").sortWithinPartitions("model", "part", "kind", "code").drop("parts", "part")
    files.write.partitionBy("model").option("maxRecordsPerFile", SHARD).parquet(target)
    return target


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


@lru_cache(1024)
def model_files(folder: str, model: int) -> list[str]:
    store, root = _store(folder)
    found = store.get_file_info(fs.FileSelector(f"{root}/model={model}", allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith(".parquet"))


@lru_cache(CACHED)
def model_part(folder: str, path: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By kind the sorted codes of one file and their values."""
    with _store(folder)[0].open_input_file(path) as source:
        table = pq.read_table(source, columns=["kind", "code", "value"])
    kinds, codes, values = (table.column(c).to_numpy() for c in ("kind", "code", "value"))
    order = np.lexsort((codes, kinds))  # a task may write rows of one model from several parts into one file
    kinds, codes, values = kinds[order], codes[order], values[order]
    edges = np.searchsorted(kinds, np.arange(2 * ORDER + 2))
    return {k: (codes[a:b], values[a:b]) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b}


def score(folder: str, model: int, code: np.ndarray) -> np.ndarray | None:
    """Log probability of the last symbol of each n-gram, backing off where it was never seen; None without a model.

    The files of the model are gone through one after another.
    """
    files = model_files(folder, model)
    if not files:
        return None
    grams = [lowest(code, order) for order in range(ORDER + 1)]
    logs, weights = np.full((ORDER + 1, len(code)), np.nan), np.zeros((ORDER + 1, len(code)))
    for path in files:
        for kind, (codes, values) in model_part(folder, path).items():
            order = kind if kind <= ORDER else kind - ORDER
            wanted = grams[order] if kind <= ORDER else context_of(grams[order])
            at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
            hit = codes[at] == wanted
            (logs if kind <= ORDER else weights)[order][hit] = values[at[hit]]
    out = logs[0]
    for order in range(1, ORDER + 1):
        out = np.where(np.isnan(logs[order]), weights[order] + out, logs[order])
    return out


def measured(flat: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text: words, their code points, marks, lines equal to an earlier one, words in windows
    of three that the text holds more than once."""
    n = len(offsets) - 1
    starts, ends, words = word_spans(flat, offsets)
    n_words = np.diff(words)
    leads = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
    word_chars = np.concatenate([[0], np.cumsum(leads[ends] - leads[starts])])
    is_mark = np.zeros(256, bool)
    is_mark[list(MARKS)] = True
    marks = np.concatenate([[0], np.cumsum(is_mark[flat])])
    newline = np.flatnonzero(flat == 0x0A)
    tails = np.searchsorted(newline, offsets)
    counts = np.diff(tails) + 1
    line_text = np.repeat(np.arange(n), counts)
    begin = np.empty(int(counts.sum()), np.int64)
    finish = np.empty_like(begin)
    heads = np.cumsum(counts) - counts
    inner = np.ones(len(begin), bool)
    inner[heads] = False
    begin[heads], begin[inner] = offsets[:-1], newline + 1
    last = heads + counts - 1
    outer = np.ones(len(begin), bool)
    outer[last] = False
    finish[last], finish[outer] = offsets[1:], newline
    with_word = np.searchsorted(starts, finish) > np.searchsorted(starts, begin)
    names = mix(span_hashes(flat, begin[with_word], finish[with_word]) + line_text[with_word].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    again = pd.Series(names).duplicated().to_numpy()
    dup_lines = np.bincount(line_text[with_word][again], minlength=n)

    tokens = span_hashes(flat, starts, ends)
    windows = rolling(tokens, 3)
    text = np.repeat(np.arange(n), n_words)
    repeated = np.zeros(len(tokens) + 1, np.int64)
    if len(windows):
        whole = np.flatnonzero(text[2:] == text[:-2])
        keyed = mix(windows[whole] + text[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        twice = whole[pd.Series(keyed).duplicated(keep=False).to_numpy()]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + 3, -1)
    in_repeat = np.concatenate([[0], np.cumsum(np.cumsum(repeated)[:-1] > 0)])
    return {
        "n_words": n_words, "word_chars": np.diff(word_chars[words]), "n_symbols": np.diff(marks[offsets]),
        "n_dup_lines": dup_lines, "n_repeat_words": np.diff(in_repeat[words]),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(spark: SparkSession, folder: str, model: Column, text: Column) -> Column:
    """struct of the counts and log_perplexity (per character; null for empty texts and without a model) of each whole text."""
    packed = share(spark, symbol_table())  # of fixed size
    shape = pa.struct([*((name, pa.int64()) for name in COUNTS), ("log_perplexity", pa.float64())])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        table = shared(packed)
        for models, texts in batches:
            models, out = models.to_numpy(), []
            for first, flat, offsets in chunks(texts):
                counts = measured(flat, offsets)
                points, ends = code_points(flat, offsets)
                code = gram_codes(points, ends, table)
                own = models[first : first + len(ends) - 1]
                sizes = np.diff(ends)
                logs = np.full(len(own), np.nan)
                for name in np.unique(own).tolist():
                    rows = np.flatnonzero((own == name) & (sizes > 0))
                    if len(rows):
                        some, at = np.unique(code[span_index(ends[rows], sizes[rows])], return_inverse=True)
                        values = score(folder, name, some)
                        if values is not None:
                            logs[rows] = -np.add.reduceat(values[at], np.cumsum(sizes[rows]) - sizes[rows]) / sizes[rows]
                out.append(pa.StructArray.from_arrays(
                    [*(pa.array(counts[c], pa.int64()) for c in COUNTS), pa.array(logs, pa.float64(), mask=np.isnan(logs))], fields=list(shape)
                ))
            yield pa.concat_arrays(out) if out else pa.array([], shape)

    kind = ", ".join(f"{c} long" for c in COUNTS) + ", log_perplexity double"
    return F.arrow_udf(run, kind)(model, text)


def judge(docs: DataFrame, band: float = BAND) -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed, perplexity, too_high, too_low, kept.

    Every language, null among them, has two models, each learned from all whole texts of one half of it; a text is
    measured by the half that it does not belong to, so that neither it nor its copies speak for it. A language's
    band goes from its median log perplexity up by 2 * `band` times the distance to the upper quartile, down by as
    many times that to the lower one, over the texts that pass the base rules. Null and empty texts have no words, so they fail the
    base rules; texts of a language that has no other half have no perplexity and are judged by the base rules
    alone. Rows that repeat count as often as they occur. Columns other than doc_id, text and lang are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    folder = train(docs.select(model_name(F.col("lang"), fold(F.col("text"))).alias("model"), "text"), scratch)
    other = model_name(F.col("lang"), 1 - fold(F.col("text")))
    found = docs.select("doc_id", "lang", measure(spark, folder, other, F.col("text")).alias("m")).select("doc_id", "lang", "m.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    found = scratch.table(found.withColumn("base_failed", failed))
    quarters = F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10_000)
    bands = found.where(~F.col("base_failed")).groupBy("lang").agg(quarters.alias("q"))
    joined = spread_join(found, bands, "lang", F.struct("doc_id", "log_perplexity"))
    high = F.coalesce(F.col("log_perplexity") > F.col("q")[1] + 2 * band * (F.col("q")[2] - F.col("q")[1]), F.lit(False))
    low = F.coalesce(F.col("log_perplexity") < F.col("q")[1] - 2 * band * (F.col("q")[1] - F.col("q")[0]), F.lit(False))
    return joined.select(
        "doc_id", *COUNTS, "base_failed", F.exp("log_perplexity").alias("perplexity"), high.alias("too_high"), low.alias("too_low"),
        (~F.col("base_failed") & ~high & ~low).alias("kept"),
    )
