"""Secret scans by a trigram inverted index, with DataFrame functions only."""

from dataclasses import dataclass
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern` whose `group` has at least `minimum` characters."""

    kind: str
    pattern: str
    group: int = 0
    minimum: int = 1


# The patterns of the base kinds. A run of a class that must have n characters is asked for
# with {n,}: the leftmost match takes the whole run either way.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Public token formats of common services.
MORE_RULES = (
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("payment", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    # Header, lines of the key (with their own headers, which hold dashes), and the end mark if the text has one.
    Rule(
        "private_key",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=:,\\\x20\t\r\n]*(?:-[A-Za-z0-9+/=:,\\\x20\t\r\n]+){0,16}(?:-----END [A-Z ]*PRIVATE KEY-----)?",
    ),
)
RULES = BASE_RULES + MORE_RULES
MARK = "[SECRET]"
SMALL_CLASS, MANY = 8, 256  # classes and sets of strings larger than this are not spelled out
MASK_BITS = 62  # trigrams of a clause in one bit set
SPAN = "struct<start:int,kind:int,end:int>"


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of lower-case trigrams: a text matched by the pattern holds all trigrams of some clause.

    An empty clause means that the pattern has no mandatory trigram and every text must be scanned.
    """
    exact, clauses = _query(parser.parse(pattern))
    clauses = _both(clauses, _spelled(exact)) if exact is not None else clauses
    return [c for c in clauses if not any(other < c for other in clauses)]


ANY = [frozenset()]


def _spelled(texts) -> list[frozenset[str]]:
    sets = {frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts}
    return ANY if frozenset() in sets else sorted(sets, key=sorted)


def _both(a, b):
    return sorted({x | y for x in a for y in b}, key=sorted)


def _query(items):
    """(strings the items spell, or None; clauses that hold besides)."""
    strings, clauses = {""}, ANY
    whole = True
    for item in items:
        spelled, more = _one(item)
        clauses = _both(clauses, more)
        if spelled is not None and len(strings) * len(spelled) <= MANY:
            strings = {s + t for s in strings for t in spelled}
        else:
            clauses = _both(clauses, _spelled(strings))
            if spelled is not None:
                strings = set(spelled)
            else:
                strings = {""}
            whole = False
    if whole:
        return strings, clauses
    return None, _both(clauses, _spelled(strings))


def _one(item):
    kind, value = item
    name = str(kind)
    if name == "LITERAL":
        return {chr(value).lower()}, ANY
    if name == "SUBPATTERN":
        return _query(value[-1])
    if name == "BRANCH":
        branches = [_query(b) for b in value[1]]
        if all(s is not None for s, _ in branches):
            return set().union(*(s for s, _ in branches)), ANY
        return None, sorted({c for s, q in branches for c in (_both(q, _spelled(s)) if s is not None else q)}, key=sorted)
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, inner = value
        strings, clauses = _query(inner)
        if strings is not None and high == 1:
            return (strings | {""} if low == 0 else strings), ANY
        if low and strings is not None:
            return None, _both(clauses, _spelled(strings))
        return None, clauses if low else ANY
    if name == "IN" and all(str(k) == "LITERAL" for k, _ in value) and len(value) <= SMALL_CLASS:
        return {chr(c).lower() for _, c in value}, ANY
    if name == "IN" and len(value) == 1 and str(value[0][0]) == "RANGE" and value[0][1][1] - value[0][1][0] < SMALL_CLASS:
        return {chr(c).lower() for c in range(value[0][1][0], value[0][1][1] + 1)}, ANY
    return None, ANY


def _literal(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c not in " _" else c for c in text)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index for the trigrams that rules ask for: one row (trigram, doc_id) per text that holds it.

    Built in one scan; a lookahead finds trigrams that overlap. Letters are indexed in lower case.
    """
    pattern = "(?i)(?=(" + "|".join(map(_literal, trigrams)) + "))"
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(1)), F.lower))
    return docs.select(F.explode(found).alias("trigram"), "doc_id")


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """doc_id and the rules of which some clause has all its trigrams in that document's postings.

    Postings are intersected as bit sets, one for every MASK_BITS trigrams of a clause, combined before the shuffle:
    a row per document and task crosses it, whatever the number of postings or rows of one id.
    """
    clauses = [(kind, sorted(c)) for kind, query in queries.items() for c in query if c]
    masks, full = [], []
    for kind, clause in clauses:
        hit = F.lit(True)
        for first in range(0, len(clause), MASK_BITS):
            bit, part = F.lit(0).cast("long"), clause[first : first + MASK_BITS]
            for k, trigram in enumerate(part):
                bit = F.when(F.col("trigram") == trigram, F.lit(1 << k).cast("long")).otherwise(bit)
            name = f"m{len(masks)}"
            masks.append(F.bit_or(bit).alias(name))
            hit = hit & (F.col(name) == (1 << len(part)) - 1)
        full.append((kind, hit))
    rules = F.array_distinct(F.array_compact(F.array(*[F.when(hit, F.lit(kind)) for kind, hit in full])))
    return index.groupBy("doc_id").agg(*masks).select("doc_id", rules.alias("rules")).where(F.size("rules") > 0)


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """(start, kind, end) of a rule's matches: positions are the lengths of all gaps and matches before."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    parts = F.zip_with(
        F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))),
        value,
        lambda p, v: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), F.length(v).alias("value")),
    )

    def step(state, part):
        start = state["at"] + part["gap"]
        end = start + part["size"]
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        return F.struct(
            end.alias("at"),
            F.when(part["value"] >= rule.minimum, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    spans = F.aggregate(parts, start, step, lambda state: state["out"])
    return F.when(F.rlike(text, F.lit(rule.pattern)), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs as `row` (a struct), and `spans`: array of (start, kind, end), by start, then rule.

    Starts and ends count code points, `kind` is the rule's place in `rules`. Null and empty texts have no
    spans. Rows may repeat and ids may be null or shared: a rule's candidate documents are found by id, and
    every row of such an id is verified on its own text. Columns of docs cannot clash with the result's.
    """
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    indexed = {kind: query for kind, query in queries.items() if all(query)}
    text = F.coalesce(F.col("row.text"), F.lit(""))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id"))
    if indexed:
        trigrams = sorted({t for query in indexed.values() for clause in query for t in clause})
        flagged = candidates(postings(docs.select("doc_id", "text"), trigrams), indexed).withColumnRenamed("doc_id", "flagged_id")
        whole = whole.join(flagged, F.col("doc_id").eqNullSafe(F.col("flagged_id")), "left")
    none = F.array().cast(f"array<{SPAN}>")
    columns = []
    for number, rule in enumerate(rules):
        spans = _spans(text, rule, number)
        columns.append(F.when(F.array_contains("rules", rule.kind), spans).otherwise(none) if rule.kind in indexed else spans)
    return whole.select("row", F.array_sort(F.concat(*columns)).alias("spans"))


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(rule.kind) for rule in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = MARK) -> Column:
    """The text with every stretch of overlapping spans replaced by the mark once."""

    def step(state, span):
        fresh = span["start"] >= state["at"]
        gap = F.when(fresh, F.substring(text, state["at"] + 1, span["start"] - state["at"])).otherwise("")
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.concat(state["out"], gap, F.when(fresh, mark).otherwise("")).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)
