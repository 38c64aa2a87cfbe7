"""Periodic runs against trying every period at every place."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabwright.llm.periodic import describe, periodic_runs
from tabwright.llm.queries import QUERIES


def brute(words):
    """All maximal stretches for every period, those whose smallest period it is."""
    n, runs = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i + q
            while end < n and words[end] == words[end - q]:
                end += 1
            length = end - i
            smaller = any(all(words[k] == words[k + p] for k in range(i, end - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                runs.append((i, length, q))
            i = end - q + 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def check(texts):
    for text, found in zip(texts, describe([t.encode() for t in texts]), strict=True):
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        runs = brute(words)
        assert [tuple(r.values()) for r in found["runs"]] == runs, text
        assert found["n_words"] == len(words) and found["collapsed"] == " ".join(kept(words, runs))


def periodic(draw):
    """Stretches over and over, with breaks, inside one another."""
    words = []
    for _ in range(draw.randint(1, 4)):
        unit = [draw.choice("abc") for _ in range(draw.randint(1, 7))]
        words += [draw.choice("abcdefg") for _ in range(draw.randint(0, 5))]
        words += (unit * draw.randint(1, 9))[: draw.randint(1, 60)]
    return " ".join(words)


def test_random_texts():
    draw = random.Random(11)
    check([periodic(draw) for _ in range(400)])
    check([" ".join(draw.choice("ab") for _ in range(draw.randint(0, 60))) for _ in range(400)])


@given(st.lists(st.sampled_from("ab c"), max_size=90))
@settings(max_examples=150, deadline=None)
def test_any_text(letters):
    check([" ".join(letters)])


def test_words_with_structure():
    fibonacci, thue = ["a", "b"], "a"
    for _ in range(10):
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for _ in range(8):
        thue += thue.translate(str.maketrans("ab", "ba"))
    check([" ".join(fibonacci[-1]), " ".join(thue), " ".join("aaab" * 12 + "aaac" * 12), "x " * 500, " ".join(("a" * 7 + "b") * 9)])
    check(["", " \n ", "a", "a a a a a", "a a a a a a", "a\x0ba\x0ca\x1ca", "é é é é é é é"])


def test_long_texts():
    words = [f"w{k}" for k in range(40_000)]
    (found,) = describe([" ".join(words + words[:900] * 60 + ["x"] * 100_000).encode()])
    assert [tuple(r.values()) for r in found["runs"]] == [(40_000, 54_000, 900), (94_000, 100_000, 1)]


def test_awkward_rows(spark, docs_of, awkward):
    docs = docs_of(awkward + [(11, "la " * 9, "fr"), (11, "la " * 9, "fr")])
    got = docs.select("doc_id", "text", periodic_runs(spark, F.col("text")).alias("p")).select("doc_id", "text", "p.*").collect()
    assert len(got) == len(awkward) + 2
    for r in got:
        words = (r.text or "").encode().split()
        assert r.n_words == len(words)
        if len(words) < 1000:
            assert [tuple(x) for x in r.runs] == brute(words)
        if r.doc_id == 11:
            assert r.collapsed == "la" and [tuple(x) for x in r.runs] == [(0, 9, 1)]
    assert docs.limit(0).select(periodic_runs(spark, F.col("text"))).collect() == []


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    draw, folder = random.Random(2), str(tmp_path_factory.mktemp("periodic"))
    rows = [(k, f"{periodic(draw)} one two three four" if k % 7 else None) for k in range(400)] + [(None, "a a a a a a a"), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def test_query(spark, small):
    folder, rows = small

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = []
    for doc_id, text in rows:
        words = (text or "").split()
        n = len(words)
        if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        shown = [*best, 1000 * best[1] // best[2]] if best else [None] * 4
        want.append((doc_id, len(runs), *shown, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(kept(words, runs)))))
    got = QUERIES["op12_periodic"](spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 50
