"""The binary Golay code of length 23: codeword indices near a word, from syndrome tables built by rule."""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: Fixed value: the generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, highest power first.
GENERATOR = 0b101011100011
N, K = 23, 12


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    r = words.astype(np.int64)
    for i in range(N - 1, N - K - 1, -1):
        r = np.where((r >> i) & 1 == 1, r ^ (GENERATOR << (i - (N - K))), r)
    return r


def _leaders() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the one error pattern of weight 3 or less; all six patterns of weight 4 or less (or that one six times)."""
    patterns = np.array([sum(1 << i for i in c) for w in range(5) for c in combinations(range(N), w)], np.int64)
    syn = syndromes(patterns)
    order = np.argsort(syn, kind="stable")  # light patterns first
    first = np.searchsorted(syn[order], np.arange(1 << (N - K)))
    count = np.bincount(syn, minlength=1 << (N - K))
    take = np.where(np.arange(6) < count[:, None], np.arange(6), 0)
    return patterns[order][first], patterns[order][first[:, None] + take]


NEAREST, NEAR = _leaders()
_LOW = syndromes(np.arange(1 << 12))
_HIGH = syndromes(np.arange(1 << 11) << 12)


def _syndrome(words: np.ndarray) -> np.ndarray:
    return _LOW[words & 0xFFF] ^ _HIGH[words >> 12]


def nearest(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword within 3 bits of each word: there is exactly one."""
    words = words.astype(np.int64)
    return (words ^ NEAREST[_syndrome(words)]) >> (N - K)


def near(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within 4 bits of each word, one or six, as rows of six (a single one repeats).

    Two words within 2 bits share an index: some word lies within 1 bit of both, and its codeword within 4.
    """
    words = words.astype(np.int64)
    return (words[:, None] ^ NEAR[_syndrome(words)]) >> (N - K)
