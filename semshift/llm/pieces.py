"""SentencePiece encoding and decoding by suffix-array matching.

For the distinct chunks of a batch (a chunk is a run of spaces and what follows up to the next space; no piece reaches
over its end), their concatenated characters are indexed by a suffix array, cut at the longest piece. Binary search of
every piece gives its range of occurrences; these are the edges (start, end, rank). Sorted by position, they are relaxed:
in each round every chunk joins the two neighbouring symbols whose edge has the best score, leftmost first, until none is
left. (A shortest path over the edges, as for unigram models, gives other pieces than this model's merges; relaxing edges
in order of score gives the model's own.) Characters without a piece become bytes.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .wordcache import ChunkCache, batches

MARK = "▁"
#: Characters from which a chunk is relaxed by a heap of its own.
LONG = 96
#: Codes of characters are shifted, so that 0 fills short pieces and END, which no text holds, ends chunks.
SHIFT, END = 2, 1
_CHUNK = re.compile(rb" *[^ ]+| +").findall
_MODELS: dict[str, Model] = {}


class Model:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        texts = [sp.id_to_piece(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        normal = [i for i in range(n) if not (byte[i] or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.longest = max(len(texts[i]) for i in normal)
        self.whole = any(MARK in texts[i].lstrip(MARK) for i in normal)  # then chunks can't be told apart
        rows = sorted(normal, key=lambda i: texts[i])
        self.piece_ids = np.array(rows, np.int64)
        self.piece_len = np.array([len(texts[i]) for i in rows], np.int64)
        codes = np.frombuffer("".join(texts[i].ljust(self.longest, "\0") for i in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), -1)
        self.grid = np.where(np.arange(self.longest) < self.piece_len[:, None], codes + SHIFT, 0)
        scores = np.array([sp.get_score(i) for i in rows])
        self.rank = np.empty(len(rows), np.int64)
        self.rank[np.argsort(-scores, kind="stable")] = np.arange(len(rows))
        order = np.sort(-scores)
        self.rank = np.searchsorted(order, -scores)  # equal scores, equal rank
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(n):
            if byte[i]:
                self.byte_ids[int(texts[i][3:-1], 16)] = i
        self.unknown = sp.unk_id()
        self.fallback = any(byte)
        self.out = [b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else bytes([int(t[3:-1], 16)]) if byte[i] else t.replace(MARK, " ").encode() for i, t in enumerate(texts)]
        self.cache = ChunkCache(self.encode_chunks, 150_000)

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """start, end, rank and id of every occurrence of a piece in the text, in order of position."""
        n, k = len(codes), self.longest
        # characters by their rank among those that occur, so that a suffix is a row of bytes where they are few enough
        place = np.zeros(0x110000 + SHIFT + 1, np.uint32)
        place[codes] = 1
        place[0] = 0
        np.cumsum(place, out=place)
        few = place[-1] < 254
        dtype, code = (np.uint8, "S") if few else (np.uint32, "U")
        seen = np.zeros(len(place), bool)
        seen[codes] = True
        pieces = np.flatnonzero((seen[self.grid] | (self.grid == 0)).all(1))
        grid = np.where(self.grid[pieces] == 0, 0, place[self.grid[pieces]]).astype(dtype)
        beyond = np.concatenate([grid, np.zeros((len(grid), 1), dtype)], 1)
        beyond[np.arange(len(grid)), self.piece_len[pieces]] = 255 if few else 0x10FFFF
        text = np.concatenate([place[codes], np.ones(k + 8, np.uint32)]).astype(dtype)
        text[n:] = place[END]
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, k)[:n])
        suffixes = rows.view(f"{code}{k}")[:, 0]
        if few:
            wide = np.zeros((n, -(-k // 8) * 8), np.uint8)
            wide[:, :k] = rows
            index = _order(wide.view(">u8").astype(np.uint64))
        else:
            index = np.argsort(suffixes, kind="stable")
        ordered = suffixes[index]
        lo = np.searchsorted(ordered, np.ascontiguousarray(grid).view(f"{code}{k}")[:, 0], "left")
        count = np.searchsorted(ordered, np.ascontiguousarray(beyond).view(f"{code}{k + 1}")[:, 0], "left") - lo
        which = np.repeat(pieces, count)
        start = index[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - lo, count)]
        order = np.argsort(start * np.int64(self.longest + 1) + self.piece_len[which])
        which, start = which[order], start[order]
        return start, start + self.piece_len[which], self.rank[which], self.piece_ids[which]

    def encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk as bytes of 4-byte integers."""
        out: list[bytes] = []
        for i, j in batches(chunks, 1 << 18):
            out += self._batch(chunks[i:j])
        return out

    def _batch(self, chunks: list[bytes]) -> list[bytes]:
        texts = [c.decode("utf-8", "replace").replace(" ", MARK) for c in chunks]
        codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32) + np.uint32(SHIFT)
        length = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(length + 1) - length - 1
        codes[first + length] = END
        n = len(codes)
        chunk_of = np.repeat(np.arange(len(texts)), length + 1)
        start, end, rank, ids = self._edges(codes)
        bound = np.ones(n + 1, bool)  # where symbols begin
        is_long = length > LONG
        pair = (end - start > 1) & ~is_long[chunk_of[start]]
        es, ee, er = start[pair], end[pair], rank[pair]
        while len(es):
            inner = np.cumsum(bound, dtype=np.int64)
            open_ = inner[ee - 1] - inner[es]  # symbols that begin inside
            alive = bound[es] & bound[ee] & (open_ >= 1)
            es, ee, er, open_ = es[alive], ee[alive], er[alive], open_[alive]
            two = open_ == 1
            if not two.any():
                break
            s, e = es[two], ee[two]
            c = chunk_of[s]
            cut = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            key = (er[two] << 32) | s  # best score, then leftmost
            best = key == np.repeat(np.minimum.reduceat(key, cut), np.diff(np.r_[cut, len(c)]))
            s, e = s[best], e[best]
            keep = np.zeros(n + 1, bool)
            m = e - s - 1
            inside = np.repeat(s + 1, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            keep[inside] = True
            bound &= ~keep
        if is_long.any():
            of = chunk_of[start]
            for k in np.flatnonzero(is_long):
                a, b = np.searchsorted(of, [k, k + 1])
                _relax_long(bound, start[a:b], end[a:b], rank[a:b], int(first[k]), int(first[k] + length[k]))
        bound[first + length] = True
        # ids of what is left
        symbol = np.flatnonzero(bound[:n])
        symbol = symbol[codes[symbol] != END]
        stop = np.append(np.flatnonzero(bound[:n]), n)
        nxt = stop[np.searchsorted(stop, symbol, "right")]
        edge_key = start * np.int64(self.longest + 1) + (end - start)
        want = symbol * np.int64(self.longest + 1) + (nxt - symbol)
        pos = np.minimum(np.searchsorted(edge_key, want), max(0, len(edge_key) - 1))
        got = np.where(edge_key[pos] == want, ids[pos], -1) if len(edge_key) else np.full(len(want), -1)
        width = np.ones(len(got), np.int64)
        lost = np.flatnonzero(got < 0)
        raw = {int(i): texts[chunk_of[symbol[i]]][symbol[i] - first[chunk_of[symbol[i]]]].encode() for i in lost} if self.fallback else {}
        flat = np.where(got < 0, self.unknown, got)
        if raw:
            width[lost] = [len(raw[int(i)]) for i in lost]
            flat = np.repeat(flat, width)
            at = np.cumsum(width) - width
            for i in lost:
                flat[at[i] : at[i] + width[i]] = self.byte_ids[list(raw[int(i)])]
        per = np.bincount(chunk_of[symbol], width, minlength=len(texts)).astype(np.int64)
        data, cuts = flat.astype("<i4").tobytes(), (np.concatenate([[0], np.cumsum(per)]) * 4).tolist()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def chunks(self, text: bytes) -> list[bytes]:
        if not text:
            return []
        text = b" " + text.replace(MARK.encode(), b" ")
        return [text] if self.whole else _CHUNK(text)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        for i, j in batches(texts):
            for ids in self.cache.look_up([self.chunks(t) for t in texts[i:j]]):
                yield b"".join(ids)

    def decode(self, ids: np.ndarray) -> bytes:
        text = b"".join(map(self.out.__getitem__, ids.tolist()))
        return text[1:] if text[:1] == b" " else text


def _order(keys: np.ndarray) -> np.ndarray:
    """An order of rows by their columns in turn: by the first, then only within its ties by the next ones."""
    index = np.argsort(keys[:, 0])
    if keys.shape[1] > 1:
        k = keys[index, 0]
        same = k[1:] == k[:-1]
        tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
        if len(tied):
            group = np.cumsum(np.r_[True, ~same])[tied]
            rest = keys[index[tied], 1:]
            sub = np.lexsort((*rest.T[::-1], group))
            index[tied] = index[tied][sub]
    return index


def _relax_long(bound: np.ndarray, start: np.ndarray, end: np.ndarray, rank: np.ndarray, lo: int, hi: int) -> None:
    """The same for one long chunk: a heap of neighbouring symbols that join, and links to neighbours."""
    known = {(int(a), int(b)): int(r) for a, b, r in zip(start, end, rank, strict=True)}
    nxt, prv = list(range(1, hi - lo + 2)), list(range(-1, hi - lo + 1))
    at = lambda i: i + lo
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and i < hi - lo and (j := nxt[i]) < hi - lo and (r := known.get((at(i), at(nxt[j])))) is not None:
            heapq.heappush(heap, (r, i, nxt[j]))

    for i in range(hi - lo - 1):
        offer(i)
    gone = bytearray(hi - lo + 1)
    while heap:
        _, i, e = heapq.heappop(heap)
        if gone[i] or (j := nxt[i]) >= hi - lo or nxt[j] != e:
            continue
        gone[j] = 1
        bound[at(j)] = False
        nxt[i] = e
        if e <= hi - lo:
            prv[e] = i
        offer(i)
        offer(prv[i])


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids (array), ids_crc32 (of the ids as little-endian unsigned 32-bit integers), round_trip: whether decoding the ids gives the text.

    A null or empty text has no ids. A text that holds U+2581, the model's sign for a space, decodes with a space there.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in parts:
            texts = b.column(1).to_pylist()
            for i, j in batches(texts):
                ids, crc, same = [], [], []
                for t, raw in zip(texts[i:j], m.encode(texts[i:j]), strict=True):
                    a = np.frombuffer(raw, "<i4")
                    ids.append(a)
                    crc.append(zlib.crc32(raw))
                    same.append(m.decode(a) == t)
                off = np.cumsum([0] + [len(a) for a in ids])
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(off), pa.int64()), lists, pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_tokens", "ids", "ids_crc32", "round_trip"])
        m.cache.clear()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, round_trip boolean")


def decode(tokens: DataFrame, path: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text of token lists. A null list gives an empty text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in parts:
            texts = [m.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
