"""Periodic runs of words by descending-LCP Kruskal.

The suffixes of a text's words are classes of a forest: they are united by decreasing common prefix, and every class
keeps its positions in order. When two classes meet at a common prefix of L words, each pair of positions i < j that
become neighbours has exactly L words in common, so from i on j - i is a period of j - i + L words. A pair at a
distance within L thus seeds a run; a run that repeats at least four times is met once at its first position, with its
smallest period, since a position between the two would have been nearer.

Only positions whose next four words occur again in their text enter the sort and the forest: a run needs five common words
at least. Everything is worked out for many texts at once; words of different texts are never equal.
"""

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.text import chunks, prepare

TIMES, SHORTEST = 4, 6  # a run has at least so many periods, and words
LEAST = 5  # common words that seed a run: SHORTEST - 1 at period 1, and (TIMES - 1) * period beyond
ENTER = 4  # positions with so many words in common take part: a power of two below LEAST
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])


def sorted_positions(words: np.ndarray, enter: int) -> np.ndarray:
    """Positions whose next `enter` words occur again, in the order of the suffixes that begin there.

    `words` are dense codes and every text ends in one that is unique. `enter` is a power of two. Ranks are refined by
    doubling, only where they are still shared.
    """
    counts = np.bincount(words)
    rank = (np.cumsum(counts) - counts)[words]
    live, width, chosen = np.flatnonzero(counts[words] > 1), 1, np.zeros(0, np.int64)
    while True:
        if width == enter:
            chosen = live
        if not len(live):
            break
        key = rank[live] * (len(words) + 1) + rank[live + width]
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        at = np.arange(len(live))
        old = np.concatenate([[True], rank[live][1:] != rank[live][:-1]])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        place = rank[live] + at - np.maximum.accumulate(np.where(old, at, 0))
        rank[live] = place[np.maximum.accumulate(np.where(new, at, 0))]
        alone = new & np.append(new[1:], True)
        live = np.sort(live[~alone])
        width *= 2
    return chosen[np.argsort(rank[chosen], kind="stable")]


def common_prefixes(words: list[int], order: list[int], enter: int) -> list[int]:
    """Common words of each position in suffix order with the one before; 0 for the first."""
    before, out = dict(zip(order[1:], order[:-1], strict=True)), {}
    last, h = -2, 0
    for i in sorted(order):
        # One less than at the position before, where that is known to be exact.
        h = h - 1 if last == i - 1 and h > enter else 0
        last, j = i, before.get(i, -1)
        if j < 0:
            h = 0
        else:
            while words[i + h] == words[j + h]:
                h += 1
        out[i] = h
    return [out[i] for i in order]


def merged(large: list[int], small: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """Both ordered sets as one (the larger grows), and the pairs that are neighbours only now."""
    pairs, low, n = [], 0, len(large)
    for k, x in enumerate(small):
        low = bisect(large, x, low)
        if low and (k == 0 or small[k - 1] < large[low - 1]):
            pairs.append((large[low - 1], x))
        if low < n and (k + 1 == len(small) or small[k + 1] > large[low]):
            pairs.append((x, large[low]))
    if len(small) * 8 < n:
        for x in small:
            large.insert(bisect(large, x), x)
    else:
        large.extend(small)
        large.sort()  # two ordered parts: linear
    return large, pairs


def find_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs with at least TIMES periods and SHORTEST words, by start, then period."""
    order = sorted_positions(codes, ENTER)
    if len(order) < 2:
        return []
    words, order = codes.tolist(), order.tolist()
    common = np.array(common_prefixes(words, order, ENTER))
    edges = np.flatnonzero(common >= LEAST)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    parent, members, runs = list(range(len(order))), {}, []

    def root(k):
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for k, shared in zip(edges.tolist(), common[edges].tolist(), strict=True):
        a, b = root(k - 1), root(k)
        large, small = members.pop(a, None) or [order[a]], members.pop(b, None) or [order[b]]
        if len(large) < len(small):
            large, small = small, large
        parent[a] = b
        members[b], pairs = merged(large, small)
        for i, j in pairs:
            period = j - i
            if (TIMES - 1) * period <= shared and period + shared >= SHORTEST and words[i - 1] != words[j - 1]:
                runs.append((i, period + shared, period))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def describe(texts: list[bytes]) -> list[dict]:
    """n_words, runs and the words left, of each text."""
    split, codes, starts, base = [t.split() for t in texts], [np.zeros(1, np.int64)], [], 1
    at = 1
    for words in split:
        starts.append(at)
        if len(words) >= SHORTEST:
            known: dict[bytes, int] = {}
            codes.append(np.array([known.setdefault(w, len(known)) for w in words], np.int64) + base)
            codes.append(np.array([base + len(known)]))  # the end: equal to nothing
            base += len(known) + 1
            at += len(words) + 1
    found: dict[int, list] = {}
    for start, length, period in find_runs(np.concatenate(codes)):
        # A text too short for a run has no place of its own and begins where the next one does: the last of equals is meant.
        k = int(np.searchsorted(starts, start, side="right")) - 1
        found.setdefault(k, []).append((start - starts[k], length, period))
    out = []
    for k, words in enumerate(split):
        runs, kept = found.get(k, []), words
        if runs:
            step = np.zeros(len(words) + 1, np.int64)
            for start, length, period in runs:
                step[start + period] += 1
                step[start + length] -= 1
            kept = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
        shown = [{"start": s, "length": n, "period": p} for s, n, p in runs]
        out.append({"n_words": len(words), "runs": shown, "collapsed": b" ".join(kept).decode()})
    return out


def periodic_runs(spark: SparkSession, text: Column) -> Column:
    """struct<n_words, runs: array<struct<start, length, period>>, collapsed> of each text.

    Words are what space and the code points 9 to 13 separate, unchanged, numbered from 0. A run is a stretch with
    smallest period `period`, of at least 4 periods and 6 words, that no neighbouring word extends; runs are ordered by
    start, then period. `collapsed` has the words that lie in no run after its first period, joined by one space. Null
    and empty texts have no words. Rows are worked out on their own, so repeated ones get the same result.
    """
    prepare(spark)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for _, flat, offsets in chunks(texts):
                data, ends = flat.tobytes(), offsets.tolist()
                parts.append(pa.array(describe([data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]), RESULT))
            yield pa.concat_arrays(parts) if parts else pa.array([], RESULT)

    kind = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"
    return F.arrow_udf(run, kind)(text)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equals the first one; null without runs."""

    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, better)
