"""The registered query of every operator, over its whole table, with production parameters."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    from tabwright.llm.pieces import PieceCodec

    codec = PieceCodec(spark, public_tokenizers.path("piece_bpe_32k.model"))
    done = read(spark, folder, "documents").select("doc_id", codec.encode_and_decode(F.col("text")).alias("done"))
    return done.select(
        "doc_id",
        (F.length("done.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("done.ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("done.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    from tabwright.llm.bytebpe import ByteCodec
    from tabwright.llm.packing import pack, token_pieces

    codec = ByteCodec(spark, public_tokenizers.path("byte_bpe_50k.json"))
    return pack(token_pieces(read(spark, folder, "documents"), codec))


def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from tabwright.llm.secrets import BASE_RULES, scan, span_text

    base = F.filter("spans", lambda s: s["kind"] < len(BASE_RULES))
    kinds = F.transform("spans", lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{rule.kind}") for k, rule in enumerate(BASE_RULES)]
    found = scan(read(spark, folder, "documents"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), *count, F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans")
    )


def op2_sql() -> str:
    """The same spans by splitting each text at a rule's matches."""
    from tabwright.llm.secrets import RULES

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    found = ", ".join(
        f"regexp_extract_all(t, {text(r.pattern)}) m{k}, string_split_regex(t, {text(r.pattern)}) g{k}, regexp_extract_all(t, {text(r.pattern)}, {r.group}) v{k}"
        for k, r in enumerate(RULES)
    )
    spans = " UNION ALL ".join(
        f"SELECT doc_id, {k} kind, {text(r.kind)} name, unnest(list_filter(list_transform(range(1, len(m{k}) + 1), lambda i: {{"
        f"'s': coalesce(list_sum(list_transform(g{k}[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(m{k}[1:i-1], lambda x: length(x))), 0)::BIGINT,"
        f" 'n': length(m{k}[i]), 'v': length(v{k}[i])}}), lambda x: x.v >= {r.minimum})) p FROM f"
        for k, r in enumerate(RULES)
    )
    shown = "string_agg({} ORDER BY p.s, kind)".format("name || ':' || p.s || ':' || (p.s + p.n)")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents), f AS (SELECT doc_id, {found} FROM d), s AS ({spans}),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) n_assign, count(*) FILTER (kind = 1) n_access, count(*) FILTER (kind = 2) n_hex,
  {shown.replace("string_agg(", "string_agg(", 1).replace(" ORDER BY", ", ',' ORDER BY")} FILTER (kind < 3) b, {shown.replace(" ORDER BY", ", ',' ORDER BY")} spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(b, '')) base_sha256,
  coalesce(spans, '') spans FROM d LEFT JOIN a USING (doc_id)"""


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    from tabwright.llm.langid import fit, predict

    docs = read(spark, folder, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = fit(docs.where(fold != 2))
    found = docs.select("doc_id", (fold == 2).alias("held_out"), predict(spark, model, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    from tabwright.llm.near_duplicates import Settings, near_duplicates

    return near_duplicates(read(spark, folder, "documents"), Settings(words=3, percent=85)).drop("text_key", "root")


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    from tabwright.llm.fingerprints import edited_fingerprints

    return edited_fingerprints(read(spark, folder, "documents"))


EXTRA_TURN = "<|im_end|><|im_start|>assistant ok"


def op1_chat(spark: SparkSession, folder: str) -> DataFrame:
    from tabwright.llm.bytebpe import ByteCodec
    from tabwright.llm.chat import prefix_tree, read_back
    from tabwright.session import Scratch

    rows = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TURN).alias("text")
    )
    codec = ByteCodec(spark, public_tokenizers.path("byte_bpe_50k.json"))
    back = read_back(*prefix_tree(rows.unionByName(more), codec, Scratch(spark)))
    said = F.concat_ws("", F.flatten(F.zip_with("roles", "texts", lambda r, t: F.array(r, F.lit("\n"), t, F.lit("\n")))))
    return back.select(
        "conv_id",
        F.size("roles").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP1_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{extra}' UNION ALL SELECT -1, 1, 'assistant', '{extra}'),
t AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') e,
  replace(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '\', '\\'), chr(10), '\n') r FROM c),
g AS (SELECT conv_id, count(*) n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') loss,
  sum(length('<|im_start|>' || r || chr(10) || e || '<|im_end|>' || chr(10)))::BIGINT formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) turns_sha256, length(loss)::BIGINT loss_chars, sha256(loss) loss_sha256, formatted_chars FROM g
""".replace("{extra}", EXTRA_TURN)


def op4_lines(spark: SparkSession, folder: str) -> DataFrame:
    from tabwright.llm.lines import without_repeated_lines

    found = without_repeated_lines(read(spark, folder, "documents"), shortest=1)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_passages(spark: SparkSession, folder: str) -> DataFrame:
    from tabwright.llm.passages import without_repeats

    found = without_repeats(read(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    from tabwright.llm.quality import judge

    return judge(read(spark, folder, "documents"))


def op13_tokens(spark: SparkSession, folder: str) -> DataFrame:
    from tabwright.llm.token_counts import token_counts
    from tabwright.session import Scratch

    return token_counts(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), Scratch(spark))


def op12_periodic(spark: SparkSession, folder: str) -> DataFrame:
    from tabwright.llm.periodic import periodic_runs, strongest

    found = repeated(read(spark, folder, "documents")).select("doc_id", periodic_runs(spark, F.col("text")).alias("p"))
    shown = F.transform("p.runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat_ws("", F.transform(shown, lambda r: F.concat(r, F.lit("\n"))))
    best = found.withColumn("best", strongest(F.col("p.runs")))
    return best.select(
        "doc_id",
        F.size("p.runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("p.collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, text: every tenth document by the hash of its id goes on with a stretch of its own words over and over.

    A document without id stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", (h % 10 == 0).alias("chosen"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("w", F.when(F.col("chosen"), words)).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.concat_ws(" ", again)).otherwise(F.col("text")).alias("text"))


def op11_trie(spark: SparkSession, folder: str) -> DataFrame:
    from tabwright.llm.prefix_trie import digested, trie
    from tabwright.session import Scratch

    scratch = Scratch(spark)
    turns = scratch.table(digested(read(spark, folder, "conversations")))
    ids = scratch.table(turns.select("conv_id").distinct())
    return trie(ids, exchanged(ids, turns), scratch)


def exchanged(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """Every conversation with its first turns taken from the one whose id is the multiple of five at or before its own."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    wanted = ids.select(F.col("conv_id").alias("own_id"), (F.col("conv_id") - F.col("conv_id") % 5).alias("conv_id"), h.alias("h"))
    first = turns.where("conv_id % 5 = 0 and pos < 9").join(wanted, "conv_id").where("pos < h")
    rest = turns.where(F.col("pos") >= h)
    return rest.unionByName(first.select(F.col("own_id").alias("conv_id"), "pos", "turn_key", "size"))


# The checksum is worked out bit by bit: a list holds each byte and then eight times -1 for its shifts.
OP11_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 pos, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 5 base, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: list_concat([unicode((conv_id::VARCHAR)[i])::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % 9 h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = base AND pos < h UNION ALL SELECT conv_id, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos >= h),
p AS (SELECT conv_id, row_number() OVER w depth, strlen(text) size, string_agg(sha256(length(role) || ':' || role || text), '/') OVER w || '/' path
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
a AS (SELECT * FROM p UNION ALL SELECT conv_id, 0, 0, '' FROM c),
e AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) ids FROM (SELECT conv_id, arg_max(path, depth) path FROM a GROUP BY conv_id) GROUP BY path),
n AS (SELECT path, min(conv_id) conv_id, min(depth) depth, count(*) n_convs, min(size) size FROM a GROUP BY path),
k AS (SELECT left(path, length(path) - 65) path, count(*) n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) n_children FROM n LEFT JOIN k USING (path)),
s AS (SELECT u.path, count(*) FILTER (v.n_children = 0) n_leaves, sum((v.n_convs - 1) * v.size)::BIGINT saved_tokens FROM m u JOIN m v ON starts_with(v.path, u.path) GROUP BY u.path)
SELECT m.conv_id, m.depth, q.conv_id parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) ends_sha256
FROM m JOIN s USING (path) LEFT JOIN e USING (path) LEFT JOIN n q ON m.depth > 0 AND q.path = left(m.path, length(m.path) - 65)
"""


QUERIES = {"op11_trie": op11_trie, "op12_periodic": op12_periodic, "op13_tokens": op13_tokens, "op4_lines": op4_lines, "op7_passages": op7_passages, "op10_quality": op10_quality, "op1_chat": op1_chat, "op8_fingerprints": op8_fingerprints, "op9_minhash": op9_minhash, "op2_secrets": op2_secrets, "op6_language": op6_language, "op3_pieces": op3_pieces, "op5_packing": op5_packing}
SQL: dict[str, str] = {"op1_chat": OP1_SQL, "op2_secrets": op2_sql(), "op11_trie": OP11_SQL}
