"""Chat formatting by a prefix tree: shared first turns are emitted once, depth first, with position ids
and the intervals of ancestors that tokens attend to."""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.bytebpe import ByteCodec
from tabwright.llm.text import prepare
from tabwright.session import Scratch

# The marks of the template.
START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    """No mark can appear in the result: in `<`, backslashes, `|` another backslash goes before the bar."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escaped_role(role: Column) -> Column:
    """As a text, and on one line."""
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def unescaped_role(role: str) -> str:
    return unescaped(re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", role))


def turns(conversations: DataFrame, codec: ByteCodec) -> DataFrame:
    """One row per turn: conv_id, depth, role, formatted, mask_start, mask_length, ids, node, parent.

    `node` names the whole path of turns down to this one. Rows of a conversation are ordered by turn, null
    first, then role and text; null roles and texts are empty. Rows with a null conv_id are one conversation.
    The loss mask covers the text of assistant turns, in code points of `formatted`.
    """
    rows = conversations.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def paths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """Running digest of (role, text) along each conversation."""
        for lists in batches:
            out = []
            for conversation in lists.to_pylist():
                key, names = b"", []
                for t in conversation:
                    role, text = t["role"].encode(), t["text"].encode()
                    key = hashlib.blake2b(key + len(role).to_bytes(8, "little") + role + text, digest_size=16).digest()
                    names.append(key)
                out.append(names)
            yield pa.array(out, pa.list_(pa.binary()))

    named = whole.withColumn("path", F.arrow_udf(paths, "array<binary>")(F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))))
    flat = named.select("conv_id", "path", F.posexplode(F.arrays_zip("ts", "path")).alias("depth", "x"))
    role, text = F.col("x.ts.role"), escaped(F.col("x.ts.text"))
    head = F.concat(F.lit(START), escaped_role(role), F.lit("\n"))
    formatted = flat.select(
        "conv_id", "depth", role.alias("role"), F.concat(head, text, F.lit(END + "\n")).alias("formatted"),
        F.length(head).alias("mask_start"), F.when(role == LEARNED, F.length(text)).otherwise(0).alias("mask_length"),
        F.col("x.path").alias("node"), F.when(F.col("depth") > 0, F.col("path")[F.col("depth") - 1]).alias("parent"),
    )
    return formatted.withColumn("ids", codec.encode(F.col("formatted"), plain=True))


def prefix_tree(conversations: DataFrame, codec: ByteCodec, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths) of the forest of all conversations.

    nodes: one row per distinct path of turns: node, parent, depth, role, formatted, mask_start, mask_length,
    ids (packed), n_tokens, start (first token in the depth-first stream), position (id of its first token:
    the tokens above it), conversations, and ancestors: the intervals (start, end) of the stream its tokens
    attend to besides their own node. paths: conv_id, depth, node of every turn.

    Depth-first order is the order of the paths of sibling digests, so it is a sort of conversations by path;
    a conversation emits the turns it does not share with its predecessor. The stream's places are running
    sums inside sorted ranges plus the totals of the ranges before. Nothing larger than one conversation is
    ever in one row.
    """
    spark = conversations.sparkSession
    prepare(spark)
    written = scratch.table(turns(conversations, codec))
    paths = written.select("conv_id", "depth", "node", "parent", (F.length("ids") / 4).cast("long").alias("n_tokens"))
    whole = paths.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "node", "n_tokens"))).alias("p"))
    whole = whole.select("conv_id", F.col("p.node").alias("path"), F.col("p.n_tokens").alias("sizes"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = scratch.table(
        whole.repartitionByRange(parts, "path", "conv_id").withColumn("part", F.spark_partition_id())
    )
    order = Window.partitionBy("part").orderBy("path", "conv_id")
    last = ranged.groupBy("part").agg(F.max("path").alias("last_path"))
    # One row per range: bounded by the number of parts.
    bounds = last.select(F.lead("part").over(Window.orderBy("part")).alias("part"), "last_path").where("part is not null")
    before = ranged.withColumn("above", F.lag("path").over(order)).join(F.broadcast(bounds), "part", "left")
    shared = F.coalesce(
        F.array_position(F.zip_with("path", F.coalesce("above", "last_path"), lambda x, y: x.eqNullSafe(y)), False) - 1,
        F.lit(-1),
    )
    # Equal throughout its length, or without a predecessor; a shorter predecessor ends in nulls and so in False.
    lead = before.withColumn("above", F.coalesce("above", "last_path")).withColumn(
        "shared", F.when(F.col("above").isNull(), 0).when(shared >= 0, shared).otherwise(F.size("path"))
    )
    emitted = lead.withColumn("own", F.aggregate(F.slice("sizes", F.col("shared") + 1, F.size("sizes")), F.lit(0).cast("long"), lambda a, n: a + n))
    local = emitted.withColumn("at", F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    totals = emitted.groupBy("part").agg(F.sum("own").alias("total"))
    totals = totals.select("part", F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("base"))
    placed = local.join(F.broadcast(totals), "part").select(
        "conv_id", "path", "sizes", "shared", (F.coalesce("at", F.lit(0)) + F.coalesce("base", F.lit(0))).alias("at")
    )

    def places(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        """For the turns a conversation emits: depth, node, first token, position."""
        shape = pa.list_(pa.struct([("depth", pa.int32()), ("node", pa.binary()), ("start", pa.int64()), ("position", pa.int64())]))
        for path, sizes, shared, at in batches:
            out = []
            for p, n, s, a in zip(path.to_pylist(), sizes.to_pylist(), shared.to_pylist(), at.to_pylist(), strict=True):
                position = np.concatenate([[0], np.cumsum(n)]).tolist()
                out.append([{"depth": d, "node": p[d], "start": a + position[d] - position[s], "position": position[d]} for d in range(s, len(p))])
            yield pa.array(out, shape)

    owned = placed.select("conv_id", F.explode(
        F.arrow_udf(places, "array<struct<depth:int,node:binary,start:bigint,position:bigint>>")("path", "sizes", "shared", "at")
    ).alias("o")).select("conv_id", "o.*")
    texts = written.select("conv_id", "depth", "parent", "role", "formatted", "mask_start", "mask_length", "ids")
    base = owned.alias("o").join(texts.alias("t"), (F.col("o.depth") == F.col("t.depth")) & F.col("o.conv_id").eqNullSafe(F.col("t.conv_id")))
    base = base.select("o.conv_id", "o.depth", "node", "parent", "role", "formatted", "mask_start", "mask_length", "ids", "start", "position",
                       (F.length("ids") / 4).cast("long").alias("n_tokens"))
    base = scratch.table(base)

    # Ancestors of an emitted turn: those of its conversation, touching intervals joined.
    spans = paths.select("conv_id", "depth", "node").join(base.select("node", "start", "n_tokens"), "node")
    lines = spans.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "start", "n_tokens"))).alias("line"))
    needed = base.groupBy("conv_id").agg(F.sort_array(F.collect_list("depth")).alias("depths"))

    def intervals(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        shape = pa.list_(pa.struct([("depth", pa.int32()), ("ancestors", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))
        for line, depths in batches:
            out = []
            for turns_, wanted in zip(line.to_pylist(), depths.to_pylist(), strict=True):
                rows, open_, at = [], [], 0
                for depth in wanted:
                    while at < depth:
                        t = turns_[at]
                        if open_ and open_[-1]["end"] == t["start"]:
                            open_[-1] = {"start": open_[-1]["start"], "end": t["start"] + t["n_tokens"]}
                        else:
                            open_.append({"start": t["start"], "end": t["start"] + t["n_tokens"]})
                        at += 1
                    rows.append({"depth": depth, "ancestors": list(open_)})
                out.append(rows)
            yield pa.array(out, shape)

    joined = lines.withColumnRenamed("conv_id", "line_id").join(needed, F.col("line_id").eqNullSafe(F.col("conv_id")))
    ancestors = joined.select("conv_id", F.explode(
        F.arrow_udf(intervals, "array<struct<depth:int,ancestors:array<struct<start:bigint,end:bigint>>>>")("line", "depths")
    ).alias("a")).select("conv_id", "a.depth", "a.ancestors")
    nodes = base.alias("b").join(ancestors.alias("a"), (F.col("a.depth") == F.col("b.depth")) & F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")))
    return nodes.select("b.*", "ancestors").drop("conv_id"), paths.select("conv_id", "depth", "node")


def read_back(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Conversations put together again from the emitted nodes: conv_id, roles, texts, loss (text under the
    mask), formatted_chars. Formatted turns are parsed and their escapes undone."""
    joined = paths.join(nodes.select("node", "formatted", "mask_start", "mask_length"), "node")
    whole = joined.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "formatted", "mask_start", "mask_length"))).alias("line"))

    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shape = pa.struct([("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("loss", pa.string()), ("formatted_chars", pa.int64())])
        for lines in batches:
            out = []
            for line in lines.to_pylist():
                formatted = "".join(t["formatted"] for t in line)
                roles, texts = [], []
                for block in formatted.split(START)[1:]:
                    role, _, text = block[: -len(END) - 1].partition("\n")
                    roles.append(unescaped_role(role))
                    texts.append(unescaped(text))
                loss, at = [], 0
                for t in line:
                    low = at + t["mask_start"]
                    loss.append(unescaped(formatted[low : low + t["mask_length"]]))
                    at += len(t["formatted"])
                out.append({"roles": roles, "texts": texts, "loss": "".join(loss), "formatted_chars": len(formatted)})
            yield pa.array(out, shape)

    kind = "roles array<string>, texts array<string>, loss string, formatted_chars long"
    return whole.select("conv_id", F.arrow_udf(parse, kind)("line").alias("r")).select("conv_id", "r.*")
