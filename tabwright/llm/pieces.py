"""Encoding to and decoding from the ids of a SentencePiece byte-pair model, on columns of whole texts."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.bpe import Merges, adjacency, breaks, encode_spans
from tabwright.llm.text import binaries, chunks, code_points, prepare, share, shared, span_index, strings

SPACE = 0x2581  # the character that stands for a space
# Kinds of pieces in the model file.
NORMAL, CONTROL, BYTE = 1, 3, 6


class PieceModel:
    """Tables of a model file: byte-pair pieces with byte fallback, identity normalisation, dummy prefix."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        supported = model.trainer_spec.model_type == 2 and model.trainer_spec.byte_fallback and not rules.precompiled_charsmap
        if not supported or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
            raise ValueError("only byte-pair models with byte fallback, identity normalisation and a dummy prefix are supported")
        pieces = model.pieces
        self.begin, self.end = (next(i for i, p in enumerate(pieces) if p.piece == x) for x in ("<s>", "</s>"))
        normal = {p.piece: i for i, p in enumerate(pieces) if p.type == NORMAL}
        order = {s: i for i, s in enumerate(sorted({-p.score for p in pieces if p.type == NORMAL}))}
        pairs = [
            (normal[text[:k]], normal[text[k:]], i, order[-pieces[i].score])
            for text, i in normal.items()
            for k in range(1, len(text))
            if text[:k] in normal and text[k:] in normal
        ]
        self.merges = Merges(*zip(*pairs, strict=True))
        singles = sorted((ord(text), i) for text, i in normal.items() if len(text) == 1)
        self.points = np.array([c for c, _ in singles], np.uint32)
        self.single_ids = np.array([i for _, i in singles], np.int32)
        place = {chr(c): k for k, (c, _) in enumerate(singles)}
        n = len(singles)
        # Row n stands for every character without a piece of its own: nothing joins it.
        self.joined = adjacency([[place.get(c, n) for c in text] for text in normal], n + 1)
        self.joined[n, :] = self.joined[:, n] = False
        self.byte_ids = np.zeros(256, np.int32)
        shown = []
        for i, p in enumerate(pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                shown.append(bytes([int(p.piece[3:5], 16)]))
            else:
                shown.append(p.piece.replace(chr(SPACE), " ").encode() if p.type == NORMAL else b"")
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_lengths = np.array([len(x) for x in shown], np.int64)
        self.shown_starts = np.cumsum(self.shown_lengths) - self.shown_lengths

    def encode(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, begin and end included, and their offsets."""
        points, offsets = code_points(flat, offsets)
        sizes = np.diff(offsets)
        filled = np.flatnonzero(sizes > 0)
        points = np.insert(np.where(points == 0x20, np.uint32(SPACE), points), offsets[:-1][filled], np.uint32(SPACE))
        offsets = np.concatenate([[0], np.cumsum(sizes + (sizes > 0))])
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        known = self.points[at] == points
        at[~known] = len(self.points)
        starts = np.flatnonzero(breaks(self.joined, at, offsets))
        symbols = np.where(known, self.single_ids[np.minimum(at, len(self.points) - 1)], -1 - points.astype(np.int64))
        # A character without a piece is a span of its own; it keeps a negative symbol that no pair has.
        ids, counts = self._spans(symbols, starts)
        span_offsets = np.searchsorted(starts, offsets)
        ends = np.concatenate([[0], np.cumsum(counts)])[span_offsets]
        ids, ends = self._bytes(ids, ends)
        n = len(ends) - 1
        out = np.empty(len(ids) + 2 * n, np.uint32)
        limits = ends + 2 * np.arange(n + 1)
        inner = np.ones(len(out), bool)
        inner[limits[:-1]] = inner[limits[1:] - 1] = False
        out[inner], out[limits[:-1]], out[limits[1:] - 1] = ids, self.begin, self.end
        return out, limits

    def _spans(self, symbols, starts):
        unknown = symbols < 0
        shifted = np.where(unknown, -symbols + (1 << 20), symbols)  # above every id, so no pair is found
        return encode_spans(shifted.astype(np.int64), starts, self.merges)

    def _bytes(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace characters without a piece by their bytes."""
        where = np.flatnonzero(ids > (1 << 20))
        if not len(where):
            return ids, ends
        points = (ids[where] - (1 << 20) - 1).astype(np.uint32)
        raw = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)
        sizes = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        counts = np.ones(len(ids), np.int64)
        counts[where] = sizes
        places = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(places[-1], np.int32)
        plain = np.ones(len(ids), bool)
        plain[where] = False
        out[places[:-1][plain]] = ids[plain]
        out[span_index(places[where], sizes)] = self.byte_ids[raw]
        return out, places[ends]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts and their offsets; bytes that are no valid UTF-8 become U+FFFD."""
        ids = ids.astype(np.int64)
        lengths = self.shown_lengths[ids]
        flat = self.shown[span_index(self.shown_starts[ids], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        filled = np.flatnonzero(np.diff(ends) > 0)
        dummy = filled[flat[ends[:-1][filled]] == 0x20]
        keep = np.ones(len(flat), bool)
        keep[ends[:-1][dummy]] = False
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        flat = flat[keep]
        try:
            flat.tobytes().decode()
        except UnicodeDecodeError:
            texts = [flat[a:b].tobytes().decode(errors="replace").encode() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            flat = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        return flat, ends


class PieceCodec:
    """Column functions of one model. The model's tables are read once on the driver and sent to the tasks.

    Null and empty texts encode to the begin and end ids alone and decode to the empty text. Equal
    texts give equal ids. Ids are packed as little-endian unsigned 32-bit integers.
    """

    def __init__(self, spark: SparkSession, path: str):
        prepare(spark)
        self._model = share(spark, PieceModel(path))  # a vocabulary file: fixed size

    def encode(self, text: Column) -> Column:
        packed = self._model

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = shared(packed)
            for texts in batches:
                parts = []
                for _, flat, offsets in chunks(texts):
                    ids, ends = model.encode(flat, offsets)
                    parts.append(binaries(ids.astype("<u4"), ends * 4).cast(pa.binary()))
                yield pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

        return F.arrow_udf(run, "binary")(text)

    def encode_and_decode(self, text: Column) -> Column:
        """struct(ids, decoded): both directions in one pass over the texts."""
        packed = self._model

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = shared(packed)
            for texts in batches:
                ids_parts, text_parts = [pa.array([], pa.binary())], [pa.array([], pa.string())]
                for _, flat, offsets in chunks(texts):
                    ids, ends = model.encode(flat, offsets)
                    ids_parts.append(binaries(ids.astype("<u4"), ends * 4).cast(pa.binary()))
                    text_parts.append(strings(*model.decode(ids, ends)).cast(pa.string()))
                yield pa.StructArray.from_arrays([pa.concat_arrays(ids_parts), pa.concat_arrays(text_parts)], ["ids", "decoded"])

        return F.arrow_udf(run, "ids binary, decoded string")(text)

    def decode(self, ids: Column) -> Column:
        packed = self._model

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = shared(packed)
            for rows in batches:
                parts = []
                for at in range(0, len(rows), 256):
                    raw = [x.as_py() or b"" for x in rows.slice(at, 256)]
                    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw], dtype=np.int64)])
                    flat, ends = model.decode(np.frombuffer(b"".join(raw), "<u4"), offsets)
                    parts.append(strings(flat, ends).cast(pa.string()))
                yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

        return F.arrow_udf(run, "string")(ids)
