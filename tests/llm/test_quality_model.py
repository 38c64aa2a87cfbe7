"""The n-gram model against a plain one, its sums, and what the bands of the registered query reject in several scripts."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm.quality import ORDER, SYMBOL_BITS, count_grams, gram_codes, judge, kneser_ney, score, symbol_table, train
from tabwright.session import Scratch


def plain_model(texts):
    """Interpolated modified Kneser-Ney over tuples of symbols: a function of (context, symbol)."""
    table = symbol_table()
    counts = {ORDER: Counter()}
    for text in texts:
        symbols = [0] * (ORDER - 1) + [int(table[ord(c)]) for c in text]
        counts[ORDER].update(tuple(symbols[i : i + ORDER]) for i in range(len(symbols) - ORDER + 1))
    for order in range(ORDER - 1, 0, -1):
        counts[order] = Counter(gram[1:] for gram in counts[order + 1])
    cuts, children = {}, {}
    for order, found in counts.items():
        n1, n2, n3, n4 = (max(sum(n == k for n in found.values()), 1) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        cuts[order] = [max(min(d, 0.9 * (k + 1)), 0.1) for k, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]
        children[order] = defaultdict(list)
        for gram, n in found.items():
            children[order][gram[:-1]].append(n)

    def chance(context, symbol):
        order = len(context) + 1
        below = chance(context[1:], symbol) if context else 1 / (len(counts[1]) + 1)
        seen = children[order].get(context)
        if not seen:
            return below
        cut = [cuts[order][min(n, 3) - 1] for n in seen]
        n = counts[order].get((*context, symbol), 0)
        return (n - cuts[order][min(n, 3) - 1] if n else 0) / sum(seen) + sum(cut) / sum(seen) * below

    return chance


def code_of(gram):
    value = 0
    for symbol in gram:
        value = value << SYMBOL_BITS | symbol
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("shard", [1 << 20, 50])
def test_model_against_a_plain_one(spark, shard, monkeypatch):
    monkeypatch.setattr("tabwright.llm.quality.SHARD", shard)
    draw = random.Random(5)
    texts = ["".join(draw.choices("ab cé日一￮", (9, 8, 7, 6, 5, 4, 3, 2), k=draw.randint(0, 60))) for _ in range(40)] + ["🙂" * 5, "", "\x00\t 7٣"]
    folder = train(spark.createDataFrame([(-7, t) for t in texts] + [(9, "other"), (9, None)], "model long, text string"), Scratch(spark))
    chance, table = plain_model(texts), symbol_table()
    seen = sorted({int(table[ord(c)]) for t in texts for c in t})
    context = [tuple(draw.choice([0, *seen, 0x10]) for _ in range(ORDER - 1)) for _ in range(60)]
    context += [tuple(int(table[ord(c)]) for c in t[k : k + ORDER - 1]) for t in texts[:20] for k in range(3) if len(t) > 6]
    for c in context:
        codes = np.array([code_of((*c, s)) for s in [*seen, 0x11]], np.int64)
        got = score(folder, -7, codes)
        assert np.allclose(got, [math.log(chance(c, s)) for s in [*seen, 0x11]], atol=1e-5)
        assert math.isclose(np.exp(got).sum(), 1, abs_tol=1e-5)  # over all symbols and one unknown
    assert score(folder, 1, codes) is None


def test_codes_are_exact_for_every_script():
    table = symbol_table()
    letters = "abyzабяαβωאבتثकखกขあい日本語漢字ー"
    assert len({int(table[ord(c)]) for c in letters}) == len(letters)
    points = np.array([ord(c) for c in "日本語é"], np.uint32)
    codes = gram_codes(points, np.array([0, 3, 3, 4]), table)
    assert codes.tolist() == [code_of((0,) * (3 - k) + tuple(map(ord, "日本語"[: k + 1]))) for k in range(3)] + [code_of((0, 0, 0, ord("é")))]


def test_counts_grow_with_the_corpus(spark):
    def distinct(n):
        draw = random.Random(2)
        rows = [(1, "".join(chr(draw.randint(0x4E00, 0x9000)) for _ in range(200))) for _ in range(n)]
        return count_grams(spark.createDataFrame(rows, "model long, text string")).count()

    assert distinct(80) > 3.9 * distinct(20)


ALPHABETS = {"en": "abcdefghijklmnopqrstuvwxyz", "ru": "абвгдежзийклмнопрстуфхцчшщыьэюя", "el": "αβγδεζηθικλμνξοπρστυφχψω", "he": "אבגדהוזחטיכלמנסעפצקרשת"}


def written(draw, letters, n_words):
    """Fluent text: words of a skewed vocabulary; and its shuffled letters in words of the same lengths."""
    own = random.Random(letters)
    vocabulary = ["".join(own.choices(letters, [1 / (k + 1) for k in range(len(letters))], k=own.randint(2, 9))) for _ in range(600)]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    fluent = " ".join(draw.choices(vocabulary, weights, k=n_words))
    mash = "".join(c if c == " " else draw.choice(letters) for c in fluent)
    return fluent, mash


def test_gibberish_in_every_script_is_rejected(docs_of):
    draw, rows, mashed = random.Random(8), [], set()
    for number, (lang, letters) in enumerate(ALPHABETS.items()):
        for k in range(300):
            rows.append((1000 * number + k, written(draw, letters, draw.randint(80, 160))[0], lang))
        for k in range(50):
            rows.append((1000 * number + 500 + k, written(draw, letters, draw.randint(80, 160))[1], lang))
            mashed.add(1000 * number + 500 + k)
    # Chinese without spaces has words of punctuation only; spaces stand for it here.
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 1200)]
    for k in range(300):
        rows.append((90_000 + k, written(draw, "".join(signs), draw.randint(80, 160))[0], "zh"))
    for k in range(50):
        rows.append((90_500 + k, written(draw, "".join(signs), draw.randint(80, 160))[1], "zh"))
        mashed.add(90_500 + k)
    found = judge(docs_of(rows)).select("doc_id", "kept", "too_high", "base_failed").collect()
    assert {r.doc_id for r in found if r.too_high} == mashed
    assert not [r.doc_id for r in found if r.doc_id not in mashed and not r.kept and not r.base_failed]


def test_one_letter_over_and_over_is_too_low(docs_of):
    draw = random.Random(4)
    rows = [(k, written(draw, ALPHABETS["en"], 120)[0], None) for k in range(200)]
    common = written(random.Random(1), ALPHABETS["en"], 4000)[0].split()
    top = max(set(common), key=common.count)
    rows.append((900, " ".join([top] * 120), None))
    rows += [(901 + k, written(draw, ALPHABETS["ru"], 120)[0], "rare") for k in range(1)]
    found = {r.doc_id: r for r in judge(docs_of(rows), band=2.0).collect()}
    assert found[900].too_low and not found[900].kept
    assert found[901].perplexity is None and found[901].kept  # there is no other half to measure it


def test_many_languages_each_have_a_model(docs_of):
    draw, rows = random.Random(6), []
    for k in range(150):
        letters = "".join(chr(0x100 + (13 * k + j) % 1500) for j in range(13)).lower()
        rows += [(100 * k + j, written(draw, letters, 60)[0], f"l{k}") for j in range(6)]
    found = judge(docs_of(rows)).where(F.col("perplexity") > 40).count()
    assert found < 30  # a shared model of 150 alphabets, or one of strangers, is at hundreds


def test_estimation_writes_tables_only(spark):
    plan = kneser_ney(spark.createDataFrame([(1, 5, 2), (1, 6, 1)], "model long, code long, n long"), Scratch(spark))
    assert set(plan.columns) == {"model", "kind", "code", "value"}
