"""Regular words of two letters, whose polynomial hashes modulo a power of two are equal, are different texts to every operator."""

import pyarrow as pa
import numpy as np
import pytest

from tabwright.llm.lines import without_repeated_lines
from tabwright.llm.near_duplicates import Settings, near_duplicates
from tabwright.llm.passages import without_repeats
from tabwright.llm.quality import measured
from tabwright.llm.shingles import shingle_sets
from tabwright.llm.text import flat_bytes, span_hashes


def twins(n, a="a", b="b"):
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word, word.translate(str.maketrans(a + b, b + a))


@pytest.mark.parametrize("n", [64, 128, 256, 1024, 8192])
def test_names_of_twins_differ(n):
    values = np.frombuffer("".join(twins(n)).encode(), np.uint8)
    one, two = span_hashes(values, np.array([0, n]), np.array([n, 2 * n]))
    assert one != two
    # A hash follows the contents alone, wherever a span lies.
    moved = span_hashes(np.concatenate([values[:7], values]), np.array([7, n + 7]), np.array([n + 7, 2 * n + 7]))
    assert moved.tolist() == [one, two]


def test_operators_tell_twins_apart(docs_of):
    one, two = twins(1024)
    words = " ".join(f"w{k}" for k in range(34))
    docs = docs_of([(1, one, "en"), (2, two, "en"), (3, f"{words} {one}", "en"), (4, f"{words} {two}", "en")])
    assert {r.n_removed for r in without_repeats(docs).collect()} == {0}
    found = {r.doc_id: r.component_id for r in near_duplicates(docs.where("doc_id < 3"), Settings(words=3, percent=85)).collect()}
    assert found == {1: 1, 2: 2}
    assert {r.n_removed for r in without_repeated_lines(docs.where("doc_id < 3"), shortest=1).select("n_removed").collect()} == {0}


def test_counts_tell_twins_apart():
    one, two = twins(1024)
    flat, offsets = flat_bytes(pa.array([f"{one}\n{two}", f"{one}\n{one}", f"{one} x y {two} x y"]))
    assert measured(flat, offsets)["n_dup_lines"].tolist() == [0, 1, 0]
    assert len(shingle_sets(*flat_bytes(pa.array([f"{one} {two} {one}"])), 1)[0]) == 2
