"""The prefix trie against walking every path of every conversation."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from compare import database, difference

from tabwright.llm.prefix_trie import prefix_trie
from tabwright.llm.queries import OP11_SQL, QUERIES
from tabwright.session import Scratch

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def in_order(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [t[1:] for t in sorted(ts)] for c, ts in found.items()}


def brute(talks):
    members = defaultdict(list)
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = sorted(c for c in own if len(talks[c]) == len(path))
        out.append((
            min(own), len(path), min(members[path[:-1]]) if path else None, len(own), sum(len(p) == len(path) + 1 for p in below),
            sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def table(spark, rows):
    data = [(*r, "clash", 1, b"x") for r in rows]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, key string, depth int, node binary")


def random_rows(seed, n):
    """Conversations that leave shared ones at any turn, repeat them, or stop inside a block."""
    draw, talks = random.Random(seed), []
    for _ in range(n):
        base = list(draw.choice(talks)) if talks and draw.random() < 0.8 else []
        base = base[: draw.randint(0, len(base))] if draw.random() < 0.7 else base
        talks.append(base + [(draw.choice(["user", "assistant", None]), draw.choice(["é", "bb", "", None, "c" * 9])) for _ in range(draw.choice([0, 0, 1, 2, 5, 9]))])
    rows = [(c * 3 - 20, d, *t) for c, talk in enumerate(talks) for d, t in enumerate(talk)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_of_any_conversations(spark, seed):
    rows = random_rows(seed, 60)
    found = prefix_trie(table(spark, rows), Scratch(spark))
    assert found.columns == COLUMNS and sorted(map(tuple, found.collect()), key=str) == brute(in_order(rows))


def test_awkward_rows(spark):
    rows = [
        (None, 0, "user", "of no conversation"), (1, None, "user", "a"), (1, 0, None, None), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "assistant", "z"),
        *((9, k, "user", "la") for k in range(300)), *((10, k, "user", "la") for k in range(299)), (11, 0, "user", "x" * 100_000),
    ]
    assert sorted(map(tuple, prefix_trie(table(spark, rows), Scratch(spark)).collect()), key=str) == brute(in_order(rows))
    assert prefix_trie(table(spark, rows).limit(0), Scratch(spark)).collect() == []


def test_query(spark, tmp_path):
    rows = random_rows(7, 90)
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    own = in_order(rows)
    talks = {c: (h := zlib.crc32(str(c).encode()) % 9, own.get(c - (abs(c) % 5) * (1 if c > 0 else -1), [])[:h] + own[c][h:])[1] for c in own}
    assert any(not t for t in talks.values())
    found = QUERIES["op11_trie"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == brute(talks)


def test_definition(spark, data):
    assert difference(spark, database(data), QUERIES["op11_trie"], OP11_SQL, data) is None
