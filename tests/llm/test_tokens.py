"""Encoding, packing: against the tokenizer libraries and exact accounting of every id."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabwright.llm.bpe import merge_by_queue, merge_words
from tabwright.llm.bytebpe import ByteCodec, ByteModel
from tabwright.llm.packing import first_fit_decreasing, pack, token_pieces
from tabwright.llm.pieces import PieceCodec, PieceModel
from tabwright.llm.text import chunks

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def piece_model():
    return PieceModel(PIECES)


@pytest.fixture(scope="module")
def byte_model():
    return ByteModel(BYTES)


def encoded(model, texts):
    out = []
    for _, flat, offsets in chunks(pa.array(texts, pa.string())):
        ids, ends = model.encode(flat, offsets)
        out += [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


ODD = ["", " ", "  a  b ", "▁▁ x", "日本語🙂 x", "\n\n\t", "a" * 3000, " " * 700 + "the", "aaab" * 300, "<s> </s>", "\x00 a", "it's we'll ''s 'S", "0123456789" * 50, "�"]


def test_pieces_match_library(piece_model):
    library, draw = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(3)
    texts = ODD + ["".join(draw.choice("aabe ▁thinger.\nés") for _ in range(draw.randint(1, 300))) for _ in range(200)]
    got = encoded(piece_model, texts)
    assert got == [library.encode(t, add_bos=True, add_eos=True) for t in texts]
    ids = np.concatenate([np.array(g) for g in got])
    flat, ends = piece_model.decode(ids, np.concatenate([[0], np.cumsum([len(g) for g in got])]))
    assert [flat[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [library.decode(g) for g in got]


def test_broken_bytes_decode_to_replacement(piece_model):
    ids = np.array([1, piece_model.byte_ids[0xC3], 2])
    flat, _ = piece_model.decode(ids, np.array([0, 3]))
    assert flat.tobytes().decode() == "�"


def test_byte_ids_match_library(byte_model):
    library, draw = Tokenizer.from_file(BYTES), random.Random(4)
    library.encode_special_tokens = True
    texts = ODD + ["<|endoftext|>"] + ["".join(draw.choice("aabe thi.\nés'\t 1½² lvdmr") for _ in range(draw.randint(1, 200))) for _ in range(300)]
    assert encoded(byte_model, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_match_library_default(spark, byte_model, docs_of):
    library, draw, mark = Tokenizer.from_file(BYTES), random.Random(5), "<|endoftext|>"
    texts = [f"a{mark}b", mark, mark * 3, f" {mark} ", f"a  {mark}  b\n{mark}", "<|endof", "text|>", "", f"é{mark[:-1]}{mark}it's{mark}'s", mark[:-1], ">"]
    texts += ["".join(draw.choice([mark, "<|", "ab", " ", "\n", "é", "'s", "1"]) for _ in range(draw.randint(0, 30))) for _ in range(200)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    flat, offsets = next((flat, offsets) for _, flat, offsets in chunks(pa.array(texts, pa.string())))
    ids, ends = byte_model.encode_marked(flat, offsets)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want and want[0] == [64, 50256, 65]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in token_pieces(docs_of(rows), ByteCodec(spark, BYTES)).collect()}
    assert got == {i: (len(w) + 1, zlib.crc32(np.array([*w, 1], "<u4").tobytes())) for i, w in enumerate(want)}
    library.encode_special_tokens = True
    codec = ByteCodec(spark, BYTES)
    plain = docs_of(rows).select("doc_id", codec.encode(F.col("text"), plain=True).alias("ids")).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in plain} == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab enth", min_size=1, max_size=40), min_size=1, max_size=8))
def test_rounds_equal_queue(byte_model, words):
    symbols = [[int(byte_model.byte_ids[b]) for b in w.encode()] for w in words]
    ids, counts = merge_words(np.array(sum(symbols, [])), np.array([len(s) for s in symbols]), byte_model.merges)
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [merge_by_queue(s, byte_model.merges) for s in symbols]


def test_codecs_on_awkward_rows(spark, docs_of, awkward):
    docs = docs_of(awkward)
    both = docs.select("doc_id", PieceCodec(spark, PIECES).encode_and_decode(F.col("text")).alias("r"), "text").select("doc_id", "text", "r.*").collect()
    for row in both:
        assert row.decoded == (row.text or "").replace("▁", " ")
    codec = PieceCodec(spark, PIECES)
    apart = docs.select(codec.decode(codec.encode(F.col("text"))).alias("t")).collect()
    assert sorted(r.t for r in apart) == sorted(r.decoded for r in both)


@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit_decreasing(sizes):
    plain, places = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for b, used in enumerate(plain):
            if used + sizes[i] <= 64:
                places[i], plain[b] = (b, used), used + sizes[i]
                break
        else:
            places[i] = (len(plain), 0)
            plain.append(sizes[i])
    assert first_fit_decreasing(sizes, 64) == [places[i] for i in range(len(sizes))]


def test_packing_accounts_for_every_id(spark, docs_of, awkward):
    rows = awkward + [(100 + k, "some words of a text " * (k % 40), "en") for k in range(300)]
    packed = pack(token_pieces(docs_of(rows), ByteCodec(spark, BYTES)), group_pieces=50).collect()
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    want = []
    for doc_id, text, _ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            want.append((doc_id is None, doc_id or 0, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed) == sorted(want)
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert sum(r.length for r in packed) > 0.9 * 2048 * len(sequences)


def test_packing_of_nothing(spark, docs_of):
    assert pack(token_pieces(docs_of([]), ByteCodec(spark, BYTES))).count() == 0
