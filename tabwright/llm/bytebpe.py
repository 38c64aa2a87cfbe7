"""Encoding with a byte-level byte-pair vocabulary (tokenizers file), on columns of whole texts."""

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.bpe import Merges, adjacency, breaks, encode_spans
from tabwright.llm.text import binaries, chunks, code_points, prepare, share, shared, span_index

OTHER, LETTER, NUMBER, WHITE = 0, 1, 2, 3
APOSTROPHE = 0x27
# The endings that split off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def character_kinds() -> np.ndarray:
    """Letter, number, white space or other, for every code point."""
    out = np.zeros(0x110000, np.uint8)
    for low in range(0, 0x110000, 0x10000):
        text = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(low, low + 0x10000))
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
            out[[low + m.start() for m in regex.finditer(pattern, text)]] = kind
    return out


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteModel:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, added = content["model"], content.get("added_tokens") or []
        if odd := [t["content"] for t in added if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]:
            raise ValueError(f"added tokens that depend on their surroundings are not supported: {odd}")
        self.added = {t["content"].encode(): t["id"] for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.mark = re.compile(b"|".join(map(re.escape, longest_first))) if added else None
        vocabulary = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(
            [vocabulary[a] for a, _ in merges], [vocabulary[b] for _, b in merges], [vocabulary[a + b] for a, b in merges], range(len(merges))
        )
        symbols = byte_symbols()
        self.byte_ids = np.zeros(256, np.int64)
        for text, b in symbols.items():
            self.byte_ids[b] = vocabulary[text]
        self.joined = adjacency([[symbols[c] for c in a + b] for a, b in merges], 256)
        self.kinds = character_kinds()

    def starts(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the parts begin that no merge crosses: runs of letters, of numbers, of others, each with
        the one space before it, white space, and the endings after an apostrophe."""
        n = len(points)
        kind = self.kinds[points]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        run = edge.copy()
        run[1:n] |= kind[1:] != kind[:-1]
        begin = run[:n].copy()
        # Of a white run before something else, the last character goes apart; a plain space joins what follows.
        last = np.flatnonzero((kind == WHITE) & run[1:] & ~edge[1:])
        begin[last] = True
        spaces = last[points[last] == 0x20]
        begin[spaces + 1] = False
        for ending in ENDINGS:
            at = np.flatnonzero((points == APOSTROPHE) & begin)
            at = at[at + len(ending) < n]
            for k, letter in enumerate(ending, 1):
                at = at[(points[at + k] == ord(letter)) & ~edge[at + k]]
            after = at + 1 + len(ending)
            begin[at + 1] = False
            begin[after[after < n]] = True
        return np.flatnonzero(begin)

    def marks(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, ids) of the added tokens in the texts, the first and longest ones; none crosses texts."""
        data, at, found = flat.tobytes(), 0, []
        while self.mark and (m := self.mark.search(data, at)):
            stop = int(offsets[np.searchsorted(offsets, m.start(), side="right")])
            if m.end() > stop:
                m = self.mark.search(data, m.start(), stop)
            if m:
                found.append((m.start(), m.end(), self.added[m.group()]))
            at = m.end() if m else stop
        return tuple(np.array(found, np.int64).reshape(-1, 3).T)

    def encode_marked(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode, but added tokens of the file have their own ids."""
        starts, ends, own = self.marks(flat, offsets)
        if not len(own):
            return self.encode(flat, offsets)
        edges = np.unique(np.concatenate([offsets, starts, ends]))
        ids, bounds = self.encode(flat, edges)
        at = np.searchsorted(edges, starts)
        counts = np.diff(bounds)
        rest = np.ones(len(ids), bool)
        rest[span_index(bounds[at] + 1, counts[at] - 1)] = False
        ids[bounds[at]] = own
        counts[at] = 1
        return ids[rest], np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(edges, offsets)]

    def encode(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and their offsets; added tokens of the file are ordinary text."""
        points, begins = code_points(flat, offsets)
        parts = self.starts(points, begins)
        edge = breaks(self.joined, flat, offsets)
        if len(points) == len(flat):
            edge[parts] = True
        else:
            edge[np.flatnonzero((flat & 0xC0) != 0x80)[parts]] = True
        starts = np.flatnonzero(edge)
        ids, counts = encode_spans(self.byte_ids[flat], starts, self.merges)
        return ids, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, offsets)]


class ByteCodec:
    """Column function of one vocabulary. Null and empty texts have no ids."""

    def __init__(self, spark: SparkSession, path: str):
        prepare(spark)
        self._model = share(spark, ByteModel(path))  # a vocabulary file: fixed size

    def encode(self, text: Column, end: int | None = None, plain: bool = False) -> Column:
        """Ids packed as little-endian unsigned 32-bit integers, `end` after each text if given.

        Added tokens of the file, such as <|endoftext|>, have their own ids as in the library, or are ordinary text if `plain`.
        """
        packed = self._model

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = shared(packed)
            for texts in batches:
                parts = []
                for _, flat, offsets in chunks(texts):
                    ids, ends = (model.encode if plain else model.encode_marked)(flat, offsets)
                    if end is not None:
                        ids, ends = np.insert(ids, ends[1:], end), ends + np.arange(len(ends))
                    parts.append(binaries(ids.astype("<u4"), ends * 4).cast(pa.binary()))
                yield pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

        return F.arrow_udf(run, "binary")(text)
