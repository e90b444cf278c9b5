"""Hashed word shingles of whole texts, vectorised over an Arrow chunk."""

from __future__ import annotations

import numpy as np

from meridia.llm.common import LOWER, mix, prefix_hash, span_hash, word_spans

#: Words are runs of bytes other than space and tab to carriage return.
WORD = np.ones(256, bool)
WORD[[0x20, 9, 10, 11, 12, 13]] = False
_STEP = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row, joined, and their offsets.

    A row with fewer than k words, but some, has its whole sequence as its one shingle; without words it has none.
    """
    data = LOWER[data]
    start, end, first = word_spans(data, offsets, WORD)
    n_rows = len(offsets) - 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64)
    words = span_hash(prefix_hash(data), start, end)
    n_words = np.diff(first)
    n_sh = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    row = np.repeat(np.arange(n_rows), n_sh)
    sh_first = np.concatenate([[0], np.cumsum(n_sh)])
    at = np.arange(sh_first[-1]) - sh_first[row] + first[row]
    size = np.minimum(n_words, k)[row]
    h = np.zeros(len(at), np.uint64)
    top = len(words) - 1
    for j in range(k):
        h = np.where(size > j, mix((h + words[np.minimum(at + j, top)]) * _STEP + np.uint64(j + 1)), h)
    for r in range(n_rows):
        h[sh_first[r] : sh_first[r + 1]].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=n_rows))]).astype(np.int64)
