"""Near-duplicate documents: SetSketch registers, banding, joint likelihood estimates, exact confirmation."""

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.components import components
from tabwright.llm.shingles import shingle_sets
from tabwright.llm.text import binaries, chunks, lists, mix, prepare
from tabwright.session import Scratch

BASE = 1.001  # base of the exponential spacing
RATE = 20.0
TOP = (1 << 16) - 2  # registers hold 0 to TOP + 1
BAND_ROWS = 6
MISS = 1e-6  # a link of just the threshold shares no band with this probability at most
RESTS = 2  # times that the texts of a bucket its hub is not linked with get a hub of their own
ESTIMATE_SPREADS = 6  # a pair is confirmed unless its estimate is this many standard errors below the threshold


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** BAND_ROWS))

    @property
    def registers(self) -> int:
        return self.bands * BAND_ROWS


def register_minima(hashes: np.ndarray, offsets: np.ndarray, registers: int) -> np.ndarray:
    """Registers of every set, one row each: an element draws an exponential variate per register, the
    smallest of a set is spaced on a logarithmic scale and truncated. The register of a union is the maximum."""
    filled = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, registers), np.uint16)
    if not len(filled):
        return out
    draw = np.random.default_rng(9)
    factors = draw.integers(0, 1 << 31, registers, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = draw.integers(0, 1 << 32, registers, dtype=np.uint32)
    small, begins = (hashes >> np.uint64(32)).astype(np.uint32), offsets[:-1][filled]
    least = np.empty((registers, len(filled)), np.uint32)
    for j in range(registers):
        least[j] = np.minimum.reduceat(small * factors[j] + shifts[j], begins)
    variate = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2**32) / RATE
    out[filled] = np.clip(np.floor(1 - np.log(variate) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    bands = registers.shape[1] // BAND_ROWS
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(registers), 1))
    values = registers.reshape(len(registers), bands, BAND_ROWS).astype(np.uint64)
    for k in range(BAND_ROWS):
        keys = mix(keys * np.uint64(0x100000001B3) + values[:, :, k] + np.uint64(1))
    return keys.view(np.int64)


def estimated_resemblance(one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity given which register of each pair is greater, and both set sizes."""
    greater, smaller = (one > two).sum(axis=1), (one < two).sum(axis=1)
    equal = one.shape[1] - greater - smaller
    u = n_one / (n_one + n_two)
    v = 1 - u
    slope = (BASE - 1) / BASE

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * slope) / math.log(BASE)

    def likelihood(j):
        more, less = chance(u - v * j), chance(v - u * j)
        tiny = 1e-12
        return greater * np.log(more + tiny) + smaller * np.log(less + tiny) + equal * np.log(np.maximum(1 - more - less, 0) + tiny)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        left, right = low + third, high - third
        up = likelihood(left) < likelihood(right)
        low, high = np.where(up, left, low), np.where(up, high, right)
    return (low + high) / 2


def sketch_texts(settings: Settings, with_sets: bool):
    """Arrow function of whole texts: shingle count, name of the set, band keys, or else the set and registers."""
    kind = "n long, name binary, " + ("members binary, registers binary" if with_sets else "bands array<long>")

    rest = [("members", pa.binary()), ("registers", pa.binary())] if with_sets else [("bands", pa.list_(pa.int64()))]
    shape = pa.struct([("n", pa.int64()), ("name", pa.binary()), *rest])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for _, flat, offsets in chunks(texts):
                hashes, ends = shingle_sets(flat, offsets, settings.words)
                registers = register_minima(hashes, ends, settings.registers)
                rows = len(ends) - 1
                raw = hashes.tobytes()
                names = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                columns = [pa.array(np.diff(ends), pa.int64()), pa.array(names, pa.binary())]
                fields = ["n", "name"]
                if with_sets:
                    columns += [binaries(hashes, ends * 8).cast(pa.binary()), binaries(registers.ravel(), np.arange(rows + 1) * 2 * settings.registers).cast(pa.binary())]
                    fields += ["members", "registers"]
                else:
                    columns.append(lists(pa.array(band_keys(registers).ravel(), pa.int64()), np.arange(rows + 1) * settings.bands))
                    fields.append("bands")
                parts.append(pa.StructArray.from_arrays(columns, fields))
            yield pa.concat_arrays(parts) if parts else pa.array([], shape)

    return F.arrow_udf(run, kind)


def confirm_pairs(settings: Settings):
    """Arrow function of two sets and their registers: whether the pair is linked."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        target = settings.percent / 100
        least = target - ESTIMATE_SPREADS * math.sqrt(target * (1 - target) / settings.registers)
        for set_a, set_b, reg_a, reg_b in batches:
            out = []
            for at in range(0, len(set_a), 512):
                one = [np.frombuffer(x.as_py(), np.uint64) for x in set_a.slice(at, 512)]
                two = [np.frombuffer(x.as_py(), np.uint64) for x in set_b.slice(at, 512)]
                sizes_a, sizes_b = np.array([len(x) for x in one]), np.array([len(x) for x in two])
                registers = [np.array([np.frombuffer(x.as_py(), np.uint16) for x in r.slice(at, 512)]) for r in (reg_a, reg_b)]
                likely = estimated_resemblance(*registers, sizes_a, sizes_b) >= least
                for ok, x, y in zip(likely.tolist(), one, two, strict=True):
                    if not ok or 100 * min(len(x), len(y)) < settings.percent * max(len(x), len(y)):
                        out.append(False)
                        continue
                    both = np.sort(np.concatenate([x, y]))
                    shared = int((both[1:] == both[:-1]).sum())
                    out.append(100 * shared >= settings.percent * (len(x) + len(y) - shared))
            yield pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")


def differences():
    """Arrow function of a set and its hub's: both sizes and the elements that only one of them has."""
    shape = pa.struct([("size", pa.int64()), ("hub_size", pa.int64()), ("delta", pa.list_(pa.int64()))])

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for own, hub in batches:
            parts, sizes = [np.zeros(0, np.uint64)], []
            for x, y in zip(own, hub, strict=True):
                one, two = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                parts.append(np.setxor1d(one, two, assume_unique=True))
                sizes.append((len(one), len(two), len(parts[-1])))
            n = np.array(sizes, np.int64).reshape(-1, 3)
            deltas = lists(pa.array(np.concatenate(parts).view(np.int64), pa.int64()), np.concatenate([[0], np.cumsum(n[:, 2])]))
            yield pa.StructArray.from_arrays([pa.array(n[:, 0]), pa.array(n[:, 1]), deltas], fields=list(shape))

    return F.arrow_udf(run, "size long, hub_size long, delta array<long>")


def open_pairs(apart: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): pairs of one hub's texts, not both linked to it, that may be linked, smaller name first.

    apart: a, b (hub), linked, size, hub_size, delta, and root and hub_root, the components that a and b are known to
    be in. Pairs within one component are left out before anything is joined. With s for the sum of two sizes, a pair is linked if
    its symmetric difference is at most c * s, c = (100 - percent) / (100 + percent). The difference of two
    texts is that of their deltas, so linked texts must share (|da| + |db| - c * s) / 2 elements of delta. As
    one of them differs from the hub by more than c * s, that is more than (|d| + c * (hub_size - size)) / 2 for
    either one, and never less than |d| - c * s. By prefix filtering, of a delta in order of rarity only the first
    elements need be compared. Copies with edits of their own share none of those: no group emits all its pairs.
    """
    c = (100 - settings.percent) / (100 + settings.percent)
    n, tiny = F.size("delta"), 1e-9
    least = F.ceil(n - c * F.col("size") * (1 + 100 / settings.percent) - tiny)
    half = F.floor((n + c * (F.col("hub_size") - F.col("size"))) / 2 - tiny) + 1
    short = (n - F.greatest(half, least, F.lit(1)) + 1).cast("int")
    long_ = (n - F.greatest(least, F.lit(1)) + 1).cast("int")
    rows = apart.select("a", "b", "linked", "root", "hub_root", short.alias("short"), long_.alias("long"), F.explode("delta").alias("e"))
    often = rows.groupBy("b", "e").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # What only one text of the hub has comes first in its order and meets nothing: it only takes places.
    common = rows.join(often, ["b", "e"]).groupBy("a", "b", "linked", "root", "hub_root", "short", "long").agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("d"))
    alone = apart.select("a", "b", F.size("delta").alias("all"), "size")
    left = common.join(alone, ["a", "b"]).withColumn("own", F.col("all") - F.size("d"))

    def first(limit: str) -> DataFrame:
        taken = F.slice("d", 1, F.greatest(F.col(limit) - F.col("own"), F.lit(0)))
        columns = ("a", "b", "linked", "root", "hub_root", "all", "size")
        return left.select(*columns, F.explode(taken).alias("x")).select(*columns, "x.e")

    # Two texts differ by no less than their distances from the hub do.
    reach = F.abs(F.col("all") - F.col("all_z")) <= c * (F.col("size") + F.col("size_z")) + tiny
    as_z = (F.col("a").alias("z"), "b", "e", F.col("all").alias("all_z"), F.col("size").alias("size_z"))

    # What is linked to the hub is in its component, so a text of that component has no open pair with it.
    big_long = first("long").where(~F.col("linked") & (F.col("root") != F.col("hub_root")))
    small_short = first("short").where("linked").select(*as_z)
    mixed = big_long.select("a", "b", "e", "all", "size").join(small_short, ["b", "e"]).where(reach)
    # Of the others only those outside the component that most are in look for partners.
    big_short = first("short").where(~F.col("linked")).select("a", "b", "e", "root", "all", "size")
    parts = big_short.groupBy("b", "e", "root").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("b", "e").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    loose = big_short.join(main.drop("parts"), ["b", "e"])
    other = loose.select(*as_z, F.col("root").alias("root_z"))
    both = loose.where(F.col("root") != F.col("main")).join(other, ["b", "e"]).where(reach)
    both = both.where((F.col("root") != F.col("root_z")) & ((F.col("root_z") == F.col("main")) | (F.col("a") < F.col("z"))))
    found = mixed.select("a", "z").unionByName(both.select("a", "z"))
    return found.select(F.least("a", "z").alias("a"), F.greatest("a", "z").alias("b")).distinct()


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of docs: doc_id, text_key, n_shingles, component_id, kept, root (null without words).

    Documents with the same set are one node. Nodes that share a band key are candidates. Each is first
    confirmed with the most central node of the bucket, its hub: a star. Two nodes of a bucket that are both
    linked to the hub need no link of their own. Any other pair can only be linked if its members differ from
    the hub in the same places, so only pairs that share such a difference are confirmed, see open_pairs. Before
    that, what is not linked to its hub is a bucket again, with a hub of its own, RESTS times: texts of one more template are
    in one component then, and pairs within a component are not formed. The
    components are those of all candidate pairs, without all pairs of a group. Every link is confirmed on the
    full sets. A link of just the threshold is a candidate with a probability of 1 - 1e-6.

    Texts that are null, empty or without words are linked with nothing. Null ids are linked like others but
    never name a component unless it has no other id. Rows that repeat an id share its verdict if they share
    its component. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    sketched = scratch.table(keyed.select("doc_id", "text_key", sketch_texts(settings, False)(F.col("text")).alias("s")).select("doc_id", "text_key", "s.*"))

    nodes = sketched.where("n > 0").groupBy("name").agg(F.first("bands").alias("bands"), F.min(F.struct("doc_id", "text_key")).alias("shown"))
    keys = nodes.select("name", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = scratch.table(keys.join(sizes, "key"))
    # The text that meets most others is the likeliest original of its copies: the best hub of a bucket.
    central = shared.groupBy("name").agg(F.sum("size").alias("central"))
    ranked = scratch.table(shared.join(central, "name"))
    hubs = ranked.groupBy("key").agg(F.max(F.struct("central", "name"))["name"].alias("hub"))
    star = scratch.table(shared.join(hubs, "key").where(F.col("name") != F.col("hub")).select(F.col("name").alias("a"), F.col("hub").alias("b")).distinct())

    active = shared.select("name").distinct()
    shown = sketched.where("n > 0").groupBy("name").agg(F.min(F.struct("doc_id", "text_key")).alias("shown")).join(active, "name", "left_semi")
    shown = shown.select("name", F.col("shown.doc_id").alias("shown_id"), F.col("shown.text_key").alias("shown_key"))
    chosen = keyed.join(shown, keyed["doc_id"].eqNullSafe(shown["shown_id"]) & (keyed["text_key"] == shown["shown_key"]))
    chosen = chosen.select("name", "text").dropDuplicates(["name"])
    sets = scratch.table(chosen.select(sketch_texts(settings, True)(F.col("text")).alias("s")).select("s.name", "s.members", "s.registers"))

    def with_sets(pairs: DataFrame) -> DataFrame:
        side = [sets.select(F.col("name").alias(x), F.col("members").alias(f"m{x}"), F.col("registers").alias(f"r{x}")) for x in "ab"]
        return pairs.join(side[0], "a").join(side[1], "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return with_sets(pairs).withColumn("linked", confirm_pairs(settings)(F.col("ma"), F.col("mb"), F.col("ra"), F.col("rb"))).select("a", "b", "linked")

    tried = scratch.table(confirmed(star))
    scratch.drop(shared)
    links, rest, last = tried.where("linked").select("a", "b"), ranked.join(hubs, "key"), tried
    for _ in range(RESTS):
        failed = last.where(~F.col("linked")).select(F.col("a").alias("name"), F.col("b").alias("hub"))
        rest = rest.join(failed, ["name", "hub"], "left_semi").drop("hub")
        next_hubs = rest.groupBy("key").agg(F.max(F.struct("central", "name"))["name"].alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        rest = scratch.table(rest.join(next_hubs, "key").where(F.col("name") != F.col("hub")))
        last = scratch.table(confirmed(rest.select(F.col("name").alias("a"), F.col("hub").alias("b")).distinct()))
        links = links.unionByName(last.where("linked").select("a", "b"))
    first = scratch.table(components(links, scratch))
    # A hub with one other text, or linked to all others, leaves no pair open.
    some = tried.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("linked").alias("all")).where("n > 1 and not all").select("b")
    apart = with_sets(tried.join(some, "b")).select("a", "b", "linked", differences()(F.col("ma"), F.col("mb")).alias("d")).select("a", "b", "linked", "d.*")
    of_a, of_b = (first.select(F.col("node").alias(x), F.col("root").alias(name)) for x, name in (("a", "root"), ("b", "hub_root")))
    apart = apart.join(of_a, "a", "left").join(of_b, "b", "left")
    apart = scratch.table(apart.withColumn("root", F.coalesce("root", "a")).withColumn("hub_root", F.coalesce("hub_root", "b")))
    crossed = open_pairs(apart, settings)
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = confirmed(crossed.join(known, ["a", "b"], "left_anti")).where("linked").select("a", "b")
    roots = components(links.unionByName(more), scratch)

    rooted = Scratch(spark).table(sketched.drop("bands").join(roots.withColumnRenamed("node", "name"), "name", "left").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("root", "name")).alias("root")
    ))
    scratch.close()
    least = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least_id"))
    named = rooted.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least_id")))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return named.select("doc_id", "text_key", "n_shingles", "component_id", kept, "root")
