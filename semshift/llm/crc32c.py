"""CRC-32C of many byte strings at once, in numpy, and the masking that record files use."""

from __future__ import annotations

import numpy as np

#: The reflected Castagnoli polynomial, and the mask's added constant.
POLY, MASK = 0x82F63B78, 0xA282EAD8


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLY), t >> np.uint32(1))
    return t


_T = [_byte_table()]
for _ in range(7):  # _T[k]: a byte followed by k zero bytes
    _T.append((_T[-1] >> np.uint32(8)) ^ _T[0][_T[-1] & np.uint32(255)])


def _after(x: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][x & np.uint32(255)] ^ tables[1][(x >> np.uint32(8)) & np.uint32(255)] ^ tables[2][(x >> np.uint32(16)) & np.uint32(255)] ^ tables[3][x >> np.uint32(24)]


def _zeros() -> list[np.ndarray]:
    """Tables that advance a register by 2^k zero bytes."""
    b = np.arange(256, dtype=np.uint32)
    step = lambda x: (x >> np.uint32(8)) ^ _T[0][x & np.uint32(255)]
    out = [np.stack([step(b << np.uint32(8 * i)) for i in range(4)])]
    for _ in range(39):
        out.append(np.stack([_after(out[-1][i], out[-1]) for i in range(4)]))
    return out


_Z = _zeros()


def crc32c(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The checksums of buf[starts[i] : starts[i] + lengths[i]].

    A register that begins at 0 doesn't see leading zeros, so strings are padded in front to whole words of 8 bytes; the
    words' registers are joined pairwise, the right one complete, level by level.
    """
    starts, lengths = np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
    n = len(starts)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for k in range(40):  # what the first register becomes after all bytes
        if (m := (lengths >> k) & 1 == 1).any():
            out[m] = _after(out[m], _Z[k])
    words = -(-lengths // 8)
    if words.sum():
        ends = np.cumsum(words)
        padded = np.zeros(int(ends[-1]) * 8, np.uint8)
        total = int(lengths.sum())
        first = np.cumsum(lengths) - lengths
        inside = np.arange(total) - np.repeat(first, lengths)
        padded[inside + np.repeat(ends * 8 - lengths, lengths)] = buf[inside + np.repeat(starts, lengths)]
        p = padded.reshape(-1, 8)
        r = _T[7][p[:, 0]].copy()
        for i in range(1, 8):
            r ^= _T[7 - i][p[:, i]]
        level = 3
        while (words > 1).any():
            half = (words + 1) // 2
            new_ends = np.cumsum(half)
            back = np.repeat(new_ends, half) - 1 - np.arange(int(new_ends[-1]))  # from the right
            right = np.repeat(ends, half) - 1 - 2 * back
            has = right - 1 >= np.repeat(ends - words, half)
            left = np.where(has, r[right - 1], np.uint32(0))
            r = _after(left, _Z[level]) ^ r[right]
            words, ends, level = half, new_ends, level + 1
        has = words > 0
        out[has] ^= r[ends[has] - 1]
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)
