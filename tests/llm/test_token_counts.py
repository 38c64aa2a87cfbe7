"""Token counts: every way of cutting against the library on the whole text."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabwright.llm.queries import QUERIES
from tabwright.llm.token_counts import Counter, stable_boundaries, token_counts
from tabwright.session import Scratch

BYTES = public_tokenizers.path("byte_bpe_50k.json")
ADDED = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def texts():
    draw = random.Random(5)
    bits = ["the ", "it's", "''ll", "  \n\n", " 12345", "über", "日本語。", "🙂", ADDED, "<|endof", "text|>", "...", "\x1c ", "'", "\t", "don't've"]
    return [
        "", None, "one", "a" * 5000, " " * 3000 + "x", "'" * 900, "日本語" * 700, ADDED * 120, "0123456789" * 200, "word " * 900, "x\n" * 800, "ab' s're" * 200,
        *("".join(draw.choice(bits) for _ in range(draw.randint(1, 400))) for _ in range(60)),
    ]


@pytest.mark.parametrize("chunk, overlap", [(64, 32), (200, 40), (1000, 300), (1 << 15, 1 << 10)])
def test_counts_are_those_of_the_library(spark, library, chunk, overlap):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in token_counts(docs, BYTES, Scratch(spark), limit=100, chunk=chunk, overlap=overlap).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((text or "").encode()), n > 100), text


def test_stable_boundaries_split_every_text(library):
    """Encoding both sides of a stable boundary apart gives the ids of the whole."""
    for text in texts()[-20:]:
        whole = library.encode(text, add_special_tokens=False).ids
        for p in stable_boundaries(text, 1, len(text), (ADDED,)).tolist()[::7]:
            assert library.encode(text[:p], add_special_tokens=False).ids + library.encode(text[p:], add_special_tokens=False).ids == whole


def test_no_boundary_inside_added_tokens_apostrophes_and_white_space():
    assert stable_boundaries(f"a{ADDED}b", 1, 15, (ADDED,)).tolist() == [1, 14]
    assert stable_boundaries("it's  x", 1, 7, ()).tolist() == [2, 4]


def test_awkward_rows(spark, docs_of, awkward, library):
    docs = docs_of(awkward + [(7, "word " * 30_000, "de")])
    got = token_counts(docs, BYTES, Scratch(spark), chunk=5000, overlap=100).collect()
    want = sorted((-1 if i is None else i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in [*awkward, (7, "word " * 30_000, "de")])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == want
    assert token_counts(docs.limit(0), BYTES, Scratch(spark)).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="boundaries"):
        Counter(public_tokenizers.path("word_bpe_49k.json"))


def test_query(spark, data, library):
    texts_ = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op13_tokens"](spark, data).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in texts_.items()}
