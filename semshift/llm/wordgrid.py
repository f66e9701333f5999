"""Words of many texts at once, in numpy: where they are, their hashes, hashes of their sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

pa.set_memory_pool(pa.system_memory_pool())  # workers give memory back between stages

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
_powers = {"n": 0}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] <= n:
        size = n + n // 4 + 1
        for name, r in (("up", _R), ("down", _R_INV)):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray, k: int = 0xBF58476D1CE4E5B9) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(k)
    return x ^ (x >> np.uint64(29))


class Grid:
    """The words of a binary array: start and end of each in `data`, its text's number, its hash.

    A word's hash is a polynomial of its bytes modulo 2^64, taken from running sums over all bytes, then mixed.
    """

    def __init__(self, texts: pa.Array) -> None:
        if texts.null_count:
            texts = texts.fill_null(b"")
        wide = pa.types.is_large_binary(texts.type)
        off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
        off = off - off[0]
        self.data, self.offsets, self.n = data, off, len(texts)
        solid = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True  # a text's first byte, and what is past its last one
        before = np.zeros(len(data), bool)
        before[1:] = solid[:-1]
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.zeros(len(data), bool)
        after[:-1] = solid[1:]
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, off)  # each text's first word, and one past the last text's
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(self.n), self.counts)

    def hashes(self) -> np.ndarray:
        up, down = _power(len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        part = sums[1:]
        part[:] = self.data
        part += np.uint64(1)
        part *= up[: len(self.data)]
        np.cumsum(part, out=part)
        return mixed((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def joined(self, i: np.ndarray, j: np.ndarray) -> list[bytes]:
        """The bytes from the start of word i to the end of word j, as they stand."""
        d = self.data.tobytes()
        return [d[a:b] for a, b in zip(self.starts[i].tolist(), self.ends[j].tolist(), strict=True)]


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each k consecutive word hashes (whatever texts they are in)."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        m = pow(_R ^ (seed * 0x51_7CC1B727220A95), i + 1, 1 << 64) | 1
        out += h[i : i + n] * np.uint64(m)
    return mixed(out, 0x94D049BB133111EB)


def gathered(parts: Iterator[pa.RecordBatch], rows: int = 1 << 18, most: int = 1 << 21, step: int = 128) -> Iterator[pa.RecordBatch]:
    """The batches joined into larger ones, up to so many rows or bytes."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for b in parts:
        for at in range(0, b.num_rows, step):
            s = b.slice(at, step)
            if held and (n + s.num_rows > rows or size + s.nbytes > most):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n, size = [], 0, 0
            held.append(s)
            n, size = n + s.num_rows, size + s.nbytes
    if held and n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
