"""Language ID: nearest centroid, cosine and rejection worked out once more with plain dictionaries."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tabwright.llm.langid import DIMENSIONS, FULL_GRAMS, GRAMS, LOWER, REJECT_SHARE, fit, predict
from tabwright.llm.text import mix


def slot(letters):
    code = 0
    for c in letters:
        code = (code * LOWER + c) % (1 << 64)
    return int(mix(np.array([(code + len(letters)) % (1 << 64)], np.uint64))[0] >> np.uint64(51))


def grams(text):
    """Letters in lower case; everything between them is one gap."""
    line, gap = [], False
    for c in text or "":
        low = c.lower() if len(c.lower()) == 1 else c
        if c.isalpha():
            line.append(ord(low))
        elif not line or not gap:
            line.append(0)
        gap = not c.isalpha()
    return Counter(slot(line[i : i + w]) for w in GRAMS for i in range(len(line) - w + 1))


def judged(model, text):
    counts = grams(text)
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, True
    weights = {k: math.log1p(n) * float(model.idf[k]) for k, n in counts.items()}
    norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
    cosines = [sum(w * float(row[k]) for k, w in weights.items()) / norm for row in model.centroids]
    best = max(range(len(cosines)), key=lambda j: (cosines[j], -j))
    label = int(model.owner[best])
    share = min(1, len(counts) / FULL_GRAMS)
    return model.labels[label], min(max(cosines[best], 0), 1), cosines[best] < REJECT_SHARE * share * model.usual[label]


def test_predictions_equal_plain_cosines(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs, per_language=30)
    assert model.centroids.shape[1] == DIMENSIONS and np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4)
    extra = spark.createDataFrame([(-1, None, "en"), (-2, "漢字 かな " * 9, "en"), (-3, "a", "en"), (-4, "12 !!", "en"), (-5, "ÄÖ ß İ x", "de")], docs.schema)
    rows = docs.where("length(text) < 1500").unionByName(extra)
    found = rows.select("text", predict(spark, model, F.col("text")).alias("p")).select("text", "p.*").collect()
    for r in found:
        label, score, rejected = judged(model, r.text)
        assert abs(r.score - score) < 1e-4, r.text
        assert (r.lang_pred, r.rejected) == (label, rejected) or score < 1e-3, r.text


def test_every_language_is_learned(spark):
    """More languages than any fixed number of them."""
    rows = [(k * 3 + j, f"{'ab' * (k % 5 + 1)} {chr(0x4E00 + k) * 6} text", f"l{k:03}") for k in range(600) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(docs, per_language=2, centroids=1)
    assert len(model.labels) == 600
