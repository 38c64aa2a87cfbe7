"""Sets of word shingles of many texts at once, as sorted distinct 64-bit hashes."""

import numpy as np

from tabwright.llm.text import MIX_1, MIX_2, mix, span_hashes, word_spans

LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[ord("A") : ord("Z") + 1] += 32


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingles of `width` words of each text, sorted.

    A text with fewer words has its whole sequence as its one shingle; without words it has none.
    """
    if lower:
        flat = LOWER_ASCII[flat]
    starts, ends, words = word_spans(flat, offsets)
    names = span_hashes(flat, starts, ends)
    counts = np.diff(words)
    rolled = rolling(names, width)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for i, (a, n) in enumerate(zip(words[:-1].tolist(), counts.tolist(), strict=True)):
        if n >= width:
            own = np.sort(rolled[a : a + n - width + 1])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            own = mix(rolling(names[a : a + n], n) + np.uint64(n))
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def rolling(names: np.ndarray, width: int) -> np.ndarray:
    """One hash for every `width` consecutive names."""
    n = len(names) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ names[k : k + n]) * np.uint64(MIX_1)
        h ^= h >> np.uint64(31)
    return mix(h * np.uint64(MIX_2))
