"""Byte-pair merges for many words at once.

The symbols of all words lie in one flat array. In each round every word finds its best pair by a
segmented minimum of pair ranks, all words merge theirs at the same time, finished words leave and
the array is compacted. A word merges all occurrences of its best pair from the left when the new
symbol cannot form a pair that is as good; otherwise only the leftmost, which is the order of the
usual priority queue.
"""

import heapq
from itertools import pairwise

import numpy as np
import pandas as pd

from tabwright.llm.text import first_seen, span_hashes, span_index

NONE = np.int32(2**31 - 1)
EMPTY = np.int64(-1)
SHARED_UP_TO = 512  # longer words are merged one by one: their hash never stands for them
QUEUE_AFTER = 256  # rounds after which a priority queue finishes the few words left, with the same result


class Merges:
    """Pairs of symbols, the symbol each becomes, and its rank (smaller merges first)."""

    def __init__(self, left, right, merged, rank):
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        self.merged, self.rank = np.asarray(merged, np.int32), np.asarray(rank, np.int32)
        self.keys = (left << np.int64(32)) | right
        made = np.full(int(max(left.max(), right.max(), self.merged.max())) + 1, -1, np.int64)
        made[self.merged] = self.rank
        careful = np.zeros(len(made), bool)  # symbols that can at once form a pair as good as their own
        careful[left[self.rank <= made[left]]] = True
        careful[right[self.rank <= made[right]]] = True
        self.together = ~careful[self.merged]
        self.bits = max(12, int(len(self.keys) * 8).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        for i, slot in enumerate(self._slot(self.keys).tolist()):
            while self.slots[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.slots[slot] = i

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left, right):
        """Index of each pair, -1 if it never merges."""
        keys = (left.astype(np.int64) << np.int64(32)) | right.astype(np.int64)
        slot = self._slot(keys)
        out = self.slots[slot]
        ask = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(ask):
            slot[ask] = (slot[ask] + 1) & ((1 << self.bits) - 1)
            out[ask] = got = self.slots[slot[ask]]
            ask = ask[(got >= 0) & (self.keys[got] != keys[ask])]
        return out


def merge_words(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Merge every word of the flat array; returns the new flat array and lengths, words in the same order."""
    word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    symbol = symbols.astype(np.int32)
    pair = np.full(len(symbol), -1, np.int32)
    if len(symbol) > 1:
        same = word[:-1] == word[1:]
        found = merges.find(symbol[:-1][same], symbol[1:][same])
        pair[:-1][same] = found
    rank = np.where(pair >= 0, merges.rank[pair], NONE)
    done_symbols, done_words, rounds = [], [], 0
    while len(symbol):
        begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        best = np.minimum.reduceat(rank, begins)
        sizes = np.diff(np.append(begins, len(symbol)))
        live = best < NONE
        if not live.all():
            stay = np.repeat(live, sizes)
            done_symbols.append(symbol[~stay])
            done_words.append(word[~stay])
            symbol, word, pair, rank = symbol[stay], word[stay], pair[stay], rank[stay]
            best, sizes = best[live], sizes[live]
            if not len(symbol):
                break
        if rounds >= QUEUE_AFTER:
            for part, name in zip(np.split(symbol, np.cumsum(sizes)[:-1]), word[np.cumsum(sizes) - sizes], strict=True):
                out = merge_by_queue(part.tolist(), merges)
                done_symbols.append(np.array(out, np.int32))
                done_words.append(np.full(len(out), name, np.int32))
            break
        rounds += 1
        at = np.flatnonzero(rank == np.repeat(best, sizes))
        first = np.concatenate([[True], word[at][1:] != word[at][:-1]])
        run = np.concatenate([[True], np.diff(at) > 1]) | first
        order = np.arange(len(at))
        odd = (order - np.maximum.accumulate(np.where(run, order, 0))) & 1
        at = at[np.where(merges.together[pair[at]], odd == 0, first)]
        symbol[at] = merges.merged[pair[at]]
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        symbol, word, pair, rank = symbol[keep], word[keep], pair[keep], rank[keep]
        new = moved[at]
        changed = np.zeros(len(symbol), bool)
        changed[new] = True
        changed[new[new > 0] - 1] = True
        ask = np.flatnonzero(changed)
        inner = ask[ask < len(symbol) - 1]
        inner = inner[word[inner] == word[inner + 1]]
        pair[ask] = -1
        rank[ask] = NONE
        pair[inner] = found = merges.find(symbol[inner], symbol[inner + 1])
        rank[inner] = np.where(found >= 0, merges.rank[found], NONE)
    if not done_words:
        return symbol, np.zeros(len(lengths), np.int64)
    words = np.concatenate(done_words)
    order = np.argsort(words, kind="stable")
    return np.concatenate(done_symbols)[order], np.bincount(words, minlength=len(lengths))


def merge_by_queue(symbols: list[int], merges: Merges) -> list[int]:
    """One word by a priority queue of (rank, position); the plain definition of the merge order."""
    n = len(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    symbols, queue = list(symbols), []

    def offer(starts):
        starts = [i for i in starts if i >= 0 and after[i] < n]
        if starts:
            found = merges.find(np.array([symbols[i] for i in starts]), np.array([symbols[after[i]] for i in starts]))
            for i, k in zip(starts, found.tolist(), strict=True):
                if k >= 0:
                    heapq.heappush(queue, (int(merges.rank[k]), i, symbols[i], symbols[after[i]], k))

    offer(range(n))
    while queue:
        _, i, left, right, k = heapq.heappop(queue)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue
        symbols[i], symbols[j] = int(merges.merged[k]), -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer([before[i], i])
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


def encode_spans(symbols: np.ndarray, starts: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids and id counts of the spans that begin at `starts` and cover the flat symbols. Equal spans are merged once."""
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(symbols))
    lengths = ends - starts
    names = span_hashes(symbols, starts, ends)
    long = np.flatnonzero(lengths > SHARED_UP_TO)
    codes, distinct = pd.factorize(names)
    if len(long):
        codes[long] = len(distinct) + np.arange(len(long))
        codes, distinct = pd.factorize(codes)
    seen = first_seen(codes, len(distinct))
    ids, counts = merge_words(symbols[span_index(starts[seen], lengths[seen])], lengths[seen], merges)
    offsets = np.cumsum(counts) - counts
    return ids[span_index(offsets[codes], counts[codes])], counts[codes]


def breaks(joined: np.ndarray, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a merged symbol can never reach across: joined[a, b] tells whether any has a beside b."""
    edge = np.ones(len(symbols), bool)
    if len(symbols) > 1:
        edge[1:] = ~joined[symbols[:-1], symbols[1:]]
    inside = offsets[offsets < len(symbols)]
    edge[inside] = True
    return edge


def adjacency(pieces: list[list[int]], size: int) -> np.ndarray:
    joined = np.zeros((size, size), bool)
    for piece in pieces:
        for a, b in pairwise(piece):
            joined[a, b] = True
    return joined
