"""Language identification: nearest of several TF-IDF n-gram centroids per language, with rejection by distance."""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.text import chunks, code_points, mix, prepare, share, shared

DIMENSIONS = 1 << 13
GRAMS = (2, 3)
SAMPLE_PER_LANGUAGE = 600  # documented bound of the labelled rows that the centroids are fitted on
ROWS = 256  # count vectors held at once
CENTROIDS = 4
ROUNDS = 12
REJECT_SHARE = 0.25  # a text is rejected below this share of the median cosine that texts of its language have,
FULL_GRAMS = 300  # in proportion for a text with fewer distinct n-grams than these: its cosine is small by nature
UNKNOWN = "und"
LOWER = 0x110000


def letter_tables() -> np.ndarray:
    """For every code point its lower-case form, 0 for what is no letter."""
    out = np.zeros(LOWER, np.uint32)
    for c in range(LOWER):
        text = chr(c)
        if text.isalpha():
            low = text.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Grams:
    """Hashed n-gram counts of texts, and `has`: which have a letter. Runs of other characters are one gap."""

    def __init__(self, points: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        letters = table[points]
        n = len(letters)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        keep = np.ones(n, bool)
        if n > 1:
            keep[1:] = (letters[1:] > 0) | (letters[:-1] > 0) | edge[1:n]
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[keep]
        letters = letters[keep].astype(np.uint64)
        self.ends = np.searchsorted(text, np.arange(len(offsets)))
        self.has = np.bincount(text[letters > 0], minlength=len(offsets) - 1) > 0
        self.slots = []
        for width in GRAMS:
            m = len(letters) - width + 1
            if m < 1:
                continue
            code = np.zeros(m, np.uint64)
            for k in range(width):
                code = code * np.uint64(LOWER) + letters[k : k + m]
            self.slots.append((width, (mix(code + np.uint64(width)) >> np.uint64(51)).astype(np.int64)))

    def counts(self, first: int, last: int) -> np.ndarray:
        """A row of counts for each text of a range; few at a time, since a row has all slots."""
        out = np.zeros((last - first, DIMENSIONS), np.float32)
        for i in range(first, last):
            for width, slot in self.slots:
                a, b = self.ends[i], self.ends[i + 1] - width + 1
                if b > a:
                    out[i - first] += np.bincount(slot[a:b], minlength=DIMENSIONS)
        return out


@dataclass
class LanguageModel:
    labels: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one unit row per centroid
    owner: np.ndarray  # the label of each centroid
    usual: np.ndarray  # median cosine of each label's texts

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        weighted = np.log1p(counts) * self.idf
        norms = np.linalg.norm(weighted, axis=1, keepdims=True)
        return weighted / np.maximum(norms, 1e-12)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label number and cosine of the nearest centroid; ties go to the smaller label."""
        cosines = self.vectors(counts) @ self.centroids.T
        nearest = cosines.argmax(axis=1)
        return self.owner[nearest], np.clip(cosines[np.arange(len(nearest)), nearest], 0, 1)


def clustered(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of spherical k-means; the first is the mean's nearest, each next the farthest from those before."""
    centers = [vectors[(vectors @ vectors.mean(axis=0)).argmax()]]
    while len(centers) < min(k, len(vectors)):
        nearest = (vectors @ np.array(centers).T).max(axis=1)
        if nearest.min() > 1 - 1e-6:
            break
        centers.append(vectors[nearest.argmin()])
    centers = np.array(centers)
    for _ in range(rounds):
        owner = (vectors @ centers.T).argmax(axis=1)
        sums = np.array([vectors[owner == j].sum(axis=0) if (owner == j).any() else centers[j] for j in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centers


def sample(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """About per_language rows of each language: those whose hash is lowest, by a share from counted rows.

    Rows with null labels, or texts that are null, are no examples.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    shares = rows.groupBy("lang").agg((per_language / F.count(F.lit(1))).alias("share"))
    place = F.pmod(F.xxhash64("doc_id", "lang", F.lit(6)), F.lit(1 << 40)) / float(1 << 40)
    # A number per language, of which the model has whole vectors; languages are not limited otherwise.
    return rows.join(F.broadcast(shares), "lang").where(place < F.col("share")).select("doc_id", "lang", "text")


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS) -> LanguageModel:
    """Fit on a bounded sample; n-grams are counted in the tasks, only hashed count vectors reach the driver."""
    table = letter_tables()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for first, flat, offsets in chunks(pa.array(frame["text"], pa.large_string())):
                grams = Grams(*code_points(flat, offsets), table)
                keep, packed = np.flatnonzero(grams.has).tolist(), []
                for i in keep:
                    row = grams.counts(i, i + 1)[0]
                    packed.append(np.packbits(row > 0).tobytes() + np.log1p(row[row > 0]).astype("<f2").tobytes())
                langs = [frame["lang"].iloc[first + i] for i in keep]
                yield pd.DataFrame({"lang": langs, "packed": packed, "name": [hashlib.sha1(p).hexdigest() for p in packed]})

    found = sample(labelled, per_language).mapInPandas(count, "lang string, packed binary, name string").toPandas()
    found = found.sort_values(["lang", "name"], ignore_index=True)
    if not len(found):
        return LanguageModel([], np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(0))
    bits = DIMENSIONS // 8
    documents = np.zeros(DIMENSIONS, np.int64)
    for packed in found["packed"]:
        documents += np.unpackbits(np.frombuffer(packed[:bits], np.uint8))
    idf = (np.log((1 + len(found)) / (1 + documents)) + 1).astype(np.float32)
    labels = sorted(found["lang"].unique())
    model = LanguageModel(labels, idf, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(len(labels)))
    rows, owner = [], []
    for i, (_, some) in enumerate(found.groupby("lang", sort=True)):
        # The vectors of one language at a time: about per_language rows, however many languages there are.
        own = np.zeros((len(some), DIMENSIONS), np.float32)
        for k, packed in enumerate(some["packed"]):
            present = np.unpackbits(np.frombuffer(packed[:bits], np.uint8)).astype(bool)
            own[k, present] = np.frombuffer(packed[bits:], "<f2")
        own *= idf
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
        centers = clustered(own, centroids)
        rows.append(centers)
        owner += [i] * len(centers)
        model.usual[i] = np.median((own @ centers.T).max(axis=1))
    model.centroids, model.owner = np.concatenate(rows).astype(np.float32), np.array(owner)
    return model


def predict(spark: SparkSession, model: LanguageModel, text: Column, reject_share: float = REJECT_SHARE) -> Column:
    """struct(lang_pred, score, rejected) of each whole text.

    lang_pred is the nearest learned language, `und` if the text is null, has no letter, or nothing was
    learned; score is the cosine of the nearest centroid, 0 for `und`. `rejected` is true for `und` and for
    texts whose cosine is below reject_share of the usual one, in proportion for short texts. Equal texts have equal results.
    """
    prepare(spark)
    packed = share(spark, (model, letter_tables()))  # bounded: languages x centroids x dimensions

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, table = shared(packed)
        for texts in batches:
            labels, scores, rejected = [], [], []
            for _, flat, offsets in chunks(texts):
                grams = Grams(*code_points(flat, offsets), table)
                for at in range(0, len(grams.has), ROWS):
                    some = grams.has[at : at + ROWS] & bool(model.labels)
                    counts = grams.counts(at, at + len(some))
                    label, score = model.predict(counts) if model.labels else (np.zeros(len(some), int), np.zeros(len(some)))
                    full = np.minimum(1, (counts > 0).sum(axis=1) / FULL_GRAMS)
                    near = score >= reject_share * full * (model.usual[label] if model.labels else 1)
                    labels += [model.labels[x] if ok else UNKNOWN for x, ok in zip(label, some, strict=True)]
                    scores += np.where(some, score, 0).tolist()
                    rejected += (~(some & near)).tolist()
            yield pa.StructArray.from_arrays(
                [pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"]
            )

    return F.arrow_udf(run, "lang_pred string, score double, rejected boolean")(text)
