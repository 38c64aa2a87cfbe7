"""Prefix trie of conversations by fixed-length block hashing.

A conversation is cut into blocks of four turns, and each block is named by a digest of the name of all blocks before it
and of its own turns. Conversations are grouped by these names first: however many share a block, it is one row from then
on. Only where different blocks follow the same blocks are they opened and grouped turn by turn; a block without a sibling
has the same members at each of its turns.

Sums over subtrees need no walk over the tree. A node belongs to its smallest member; along a conversation the nodes that
belong to it are the last ones. So a conversation saves what it says above the first node of its own, and each subtree
without children is counted by the one conversation that owns its end: plain sums over members, whatever the depth.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.text import prepare
from tabwright.session import Scratch

BLOCK = 4  # turns
NAME = 16  # bytes of a digest
ROOT = bytes(NAME)
HEAD = 64  # code points


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, turn_key, size of every turn: its place from 0, a digest of role and text, UTF-8 bytes of the text.

    Turns are ordered by turn, null first; ties by role, the first 64 code points of the text, then digest. Null roles and
    texts are empty. Turns of no conversation (null conv_id) are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, HEAD).alias("head"),
        name(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("turn_key"),
        F.octet_length(text).cast("long").alias("size"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "head", "turn_key")
    return turns.select("conv_id", (F.row_number().over(order).cast("long") - 1).alias("pos"), "turn_key", "size")


def name(data: Column) -> Column:
    return F.substring(F.unhex(F.sha2(data, 256)), 1, NAME)


def blocks(turns: DataFrame) -> DataFrame:
    """conv_id, block, up, key, keys, sizes, before, last of every block: `up` names all blocks before it, `key` those and
    its own turns, `before` counts the bytes said before it.

    Conversations pass as sorted streams, so nothing but one block is ever held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, up, number, before, keys, sizes, rows = None, ROOT, 0, 0, [], [], []

        def emit(last: bool):
            key = hashlib.sha256(up + b"".join(keys)).digest()[:NAME]
            rows.append((owner, number, up, key, keys, sizes, before, last))
            return key, number + 1, before + sum(sizes), [], []

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SHAPE.types, strict=True)], schema=SHAPE)

        for batch in batches:
            for conv, key, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn_key", "size")), strict=True):
                if conv != owner:
                    if owner is not None:
                        emit(True)
                    owner, up, number, before, keys, sizes = conv, ROOT, 0, 0, [], []
                elif len(keys) == BLOCK:
                    up, number, before, keys, sizes = emit(False)
                keys.append(key)
                sizes.append(size)
            if rows:
                yield packed()
                rows = []
        if owner is not None:
            emit(True)
            yield packed()

    kind = "conv_id bigint, block bigint, up binary, key binary, keys array<binary>, sizes array<bigint>, before bigint, last boolean"
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return ordered.select("conv_id", "turn_key", "size").mapInArrow(run, kind)


SHAPE = pa.schema([
    ("conv_id", pa.int64()), ("block", pa.int64()), ("up", pa.binary()), ("key", pa.binary()), ("keys", pa.list_(pa.binary())),
    ("sizes", pa.list_(pa.int64())), ("before", pa.int64()), ("last", pa.bool_()),
])


def end_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 from (node, conv_id): the ids of a node in order, joined by commas, hashed as they stream by."""
    shape = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, state, rows = None, None, []
        for batch in batches:
            for node, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if node != owner:
                    if owner is not None:
                        rows.append({"node": owner, "ends_sha256": state.hexdigest()})
                    owner, state = node, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            yield pa.RecordBatch.from_pylist(rows, shape)
            rows = []
        if owner is not None:
            yield pa.RecordBatch.from_pylist([{"node": owner, "ends_sha256": state.hexdigest()}], shape)

    return ends.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(run, "node binary, ends_sha256 string")


def opened(rows: DataFrame, *sums: str) -> DataFrame:
    """A row per turn of each block: node, parent, depth, size, before, the single columns `sums` and the element of
    the array `saved` where there is one."""
    arrays = ["names", "sizes", *(["saved"] if "saved" in rows.columns else [])]
    at = rows.select("up", "block", "before", "names", F.col("sizes").alias("all"), *sums, F.posexplode(F.arrays_zip(*arrays)).alias("r", "x"))
    said = F.aggregate(F.slice("all", F.lit(1), F.col("r")), F.col("before"), lambda a, n: a + n)
    return at.select(
        F.col("x.names").alias("node"), F.when(F.col("r") == 0, F.col("up")).otherwise(F.get("names", F.col("r") - 1)).alias("parent"),
        (F.col("block") * BLOCK + F.col("r") + 1).alias("depth"), said.alias("before"), *sums, *(["x.saved"] if len(arrays) == 3 else []),
    )


def trie(ids: DataFrame, turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes of the trie of all conversations `ids` (conv_id) with `turns` (conv_id, pos, turn_key, size).

    Per distinct path of turns, the empty one included: conv_id (the smallest member), depth, parent_conv_id (null for the
    root), n_convs (members), n_children, n_leaves, saved_tokens and ends_sha256. A conversation without turns is a member
    of the root alone. No conversations, no nodes.

    One node's member ids are hashed one after another, as their digest demands, in a task that streams them; everything
    else that a shared path could pile up is summed before it is shuffled.
    """
    prepare(turns.sparkSession)
    rows = scratch.table(blocks(turns))
    ids = ids.distinct()

    # Blocks as groups of conversations; those without a sibling are known by their own name, so hot parents join nothing.
    path = ["key", "up", "block", "keys", "sizes", "before"]
    names = F.transform(F.sequence(F.lit(1), F.size("keys")), lambda r: name(F.aggregate(F.slice("keys", F.lit(1), r), F.col("up"), lambda a, k: F.concat(a, k))))
    groups = scratch.table(rows.groupBy(*path).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv")).withColumn("names", names).drop("keys"))
    alone = groups.groupBy("up").agg(F.count(F.lit(1)).alias("m"), F.min("key").alias("key")).where("m = 1").select("key", F.lit(True).alias("alone"))
    groups = scratch.table(groups.join(alone, "key", "left"))
    single, forked = groups.where("alone"), groups.where("alone is null")

    root = F.lit(ROOT)
    place = ["node", "parent", "depth", "before"]
    refined = opened(forked, "n", "conv").groupBy(*place).agg(F.sum("n").alias("n"), F.min("conv").alias("conv"))
    top = ids.groupBy(root.alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"))
    top = top.select("node", F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("before"), "n", "conv")
    nodes = scratch.table(opened(single, "n", "conv").unionByName(refined).unionByName(top))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = scratch.table(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))

    # What each conversation says above its own first node, and whether it stands for the end of a path.
    owners = tree.groupBy(F.col("conv").alias("conv_id")).agg(F.min("before").alias("own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    said = F.aggregate("sizes", F.col("before"), lambda a, n: a + n)
    ends = rows.where("last").select("conv_id", F.col("key").alias("node"), said.alias("total"))
    limits = scratch.table(ends.join(owners, "conv_id", "left").select("conv_id", F.coalesce("own", "total").alias("limit"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf")))

    above = [F.aggregate(F.slice("sizes", 1, r), F.col("before"), lambda a, n: a + n) for r in range(BLOCK)]
    saved = [F.sum(F.greatest(F.col("limit") - b, F.lit(0).cast("long"))).alias(f"saved_{r}") for r, b in enumerate(above)]
    sums = rows.select("conv_id", "key", "sizes", "before").join(limits, "conv_id").groupBy("key").agg(F.sum("leaf").alias("n_leaves"), *saved)
    joined = groups.join(sums, "key").withColumn("saved", F.slice(F.array(*(f"saved_{r}" for r in range(BLOCK))), F.lit(1), F.size("sizes")))
    single, forked = (opened(joined.where(c), "n_leaves").select("node", "n_leaves", "saved") for c in ("alone", "alone is null"))
    total = [F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")]
    whole = limits.groupBy(root.alias("node")).agg(F.sum("leaf").alias("n_leaves"), F.sum("limit").alias("saved"))
    sums = single.unionByName(forked.groupBy("node").agg(*total)).unionByName(whole)

    turnless = ids.join(ends, "conv_id", "left_anti").select(root.alias("node"), "conv_id")
    digests = end_digests(ends.select("node", "conv_id").unionByName(turnless))
    parents = tree.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    found = tree.join(sums, "node", "left").join(digests, "node", "left").join(parents, "parent", "left")
    return found.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves")).alias("n_leaves"),
        F.coalesce("saved", F.lit(0).cast("long")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text); see `digested` and `trie`. Other columns are not looked at."""
    turns = scratch.table(digested(conversations))
    return trie(turns.select("conv_id"), turns, scratch)
