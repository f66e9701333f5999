"""A bounded memory of encoded chunks of text that a Python worker keeps from batch to batch of one task."""

from __future__ import annotations

from collections.abc import Callable


class ChunkCache:
    """Maps chunks to their ids as bytes. Two generations of at most `size` new chunks each: what is met again moves to the young one, the old one goes when that is full."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], size: int = 250_000) -> None:
        self.encode, self.size = encode, size
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def clear(self) -> None:
        """Gives the memory back: workers live on through other stages, which need it."""
        self.young, self.old = {}, {}

    def look_up(self, lists: list[list[bytes]]) -> list[list[bytes]]:
        """The ids of every chunk of the lists."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        get, old = self.young.get, self.old
        out = [list(map(get, chunks)) for chunks in lists]
        holes = [[i for i, v in enumerate(vals) if v is None] for vals in out]
        fresh: dict[bytes, bytes | None] = {}
        for chunks, where in zip(lists, holes, strict=True):
            for i in where:
                fresh[chunks[i]] = None
        if fresh:
            new = [c for c in fresh if (v := old.get(c)) is None or fresh.__setitem__(c, v)]
            if new:
                fresh.update(zip(new, self.encode(new), strict=True))
            self.young.update(fresh)
            for chunks, vals, where in zip(lists, out, holes, strict=True):
                for i in where:
                    vals[i] = fresh[chunks[i]]
        return out


def batches(texts: list[bytes], most: int = 1 << 21):
    """Index ranges whose texts have about that many bytes."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= most):
            n += len(texts[j])
            j += 1
        yield i, j
        i = j
