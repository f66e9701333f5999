"""Token ids as length-delimited binary records with masked checksums, and a separate offset index.

A record: length (8 bytes), masked CRC-32C of the length, payload, masked CRC-32C of the payload, all little-endian. The
payload is a document's ids, 2 bytes each if the vocabulary allows, else 4. The index: 32 bytes for each record (doc_id,
offset of the payload, its length, 1 if doc_id is null), so that shuffled readers can fetch any record by itself.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, stored, table
from .crc32c import crc32c, masked
from .wordcache import ChunkCache, batches

INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("null", "<u8")])
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """A tokenizer file's ids for texts, the same as the library's encode() of the whole text without special tokens.

    Its normalizer and pattern treat white space as a bare separator, so chunks between ASCII white space are encoded
    apart and remembered. Chunks of Latin letters go to the library's model straight away, after the same lowering and
    splitting; any other chunk, and any that might hold a special token, goes through the library's full path.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.wide = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.wide}")
        self.sep = np.array([(1 << 8 * self.wide) - 1], self.dtype)
        self.split = regex.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.plain = regex.compile(r"[\x20-\x3b\x3d-\x7e\xa1-\xac\xae-\xffŒœ]*+").fullmatch
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: bytes that show as themselves
        rest = [b for b in range(256) if b not in shown]
        table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.by_char = {i: "".join(table[b] for b in chr(i).encode()) for i in [*range(33, 256), 0x152, 0x153]}
        last = np.zeros(self.tok.get_vocab_size(), bool)
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        if suffix:
            last[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True
        self.last = last
        self.by_piece = Tokenizer.from_file(path)
        self.by_piece.normalizer = None
        self.by_piece.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.simple = bool(suffix) and self._simple()
        self.cache = ChunkCache(self._encode, 150_000)

    def _simple(self) -> bool:
        """Whether this file's normalizer and pre-tokenizer are those that the fast path stands in for."""
        sample = "It's DON'T ÀÉÎ œuvre 12a3 x--y!? ß½ we'll"
        want = self.tok.encode(sample, add_special_tokens=False).ids
        return np.frombuffer(b"".join(self._latin(sample)), self.dtype).tolist() == want

    def _latin(self, joined: str) -> list[bytes]:
        """Ids of the chunks of Latin letters, joined by spaces. Each distinct piece goes through the merges once; the last token of a piece carries the end-of-word suffix, which tells pieces apart."""
        pieces = self.split(joined.lower())
        known = dict.fromkeys(pieces)
        known.pop(" ", None)
        ids = np.array(self.by_piece.encode_batch_fast([" ".join(known).translate(self.by_char)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(known) or (len(ends) and ends[-1] != len(ids)):
            raise ValueError("pieces and ends of words differ")
        raw, at = ids.astype(self.dtype).tobytes(), (ends * self.wide).tolist()
        known = dict(zip(known, (raw[a:b] for a, b in zip([0, *at], at, strict=False)), strict=True))
        known[" "] = self.sep.tobytes()
        raw = b"".join(map(known.__getitem__, pieces))
        cuts = np.flatnonzero(np.frombuffer(raw, self.dtype) == self.sep[0]) * self.wide
        return [raw[a:b] for a, b in zip([0, *(cuts + self.wide).tolist()], [*cuts.tolist(), len(raw)], strict=True)]

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        joined = b" ".join(chunks).decode("utf-8", "replace")
        if self.simple and self.plain(joined):
            return self._latin(joined)
        texts = [c.decode("utf-8", "replace") for c in chunks]
        latin = [i for i, s in enumerate(texts) if self.simple and self.plain(s)]
        out: list[bytes] = [b""] * len(chunks)
        for i, v in zip(latin, self._latin(" ".join(texts[i] for i in latin)) if latin else [], strict=True):
            out[i] = v
        slow = sorted({*range(len(chunks))} - {*latin})
        for k in range(0, len(slow), 4096):
            part = slow[k : k + 4096]
            for i, e in zip(part, self.tok.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, self.dtype).tobytes()
        return out

    def payloads(self, texts: list[bytes], end: bytes) -> Iterator[bytes]:
        for i, j in batches(texts):
            # the normalizer lowers anyway; a text that might hold a special token is left as it is
            chunks = [(t.lower() if b"<|" not in t else t).split() for t in texts[i:j]] if self.simple else [[t] if t else [] for t in texts[i:j]]
            for ids in self.cache.look_up(chunks):
                yield b"".join(ids) + end


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def _frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The records of the payloads, and where each payload begins."""
    lengths = np.array([len(p) for p in payloads], np.int64)
    head = lengths.astype("<u8").view(np.uint8)
    head_crc = masked(crc32c(head, np.arange(len(lengths)) * 8, np.full(len(lengths), 8))).astype("<u4").tobytes()
    data = np.frombuffer(b"".join(payloads), np.uint8)
    data_crc = masked(crc32c(data, np.cumsum(lengths) - lengths, lengths)).astype("<u4").tobytes()
    heads = head.tobytes()
    out = b"".join(x for i, p in enumerate(payloads) for x in (heads[8 * i : 8 * i + 8], head_crc[4 * i : 4 * i + 4], p, data_crc[4 * i : 4 * i + 4]))
    return out, np.cumsum(lengths + 16) - lengths - 4


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes part-N.rec and part-N.idx files in ascending doc_id order (null first) and returns their stored manifest: part, records, tokens, wide.

    A null text is empty. Repeated doc_ids follow each other, ordered by text. A task writes under a name of its own and
    renames when whole, so a task that runs again replaces its file by the same one.
    """

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        files, base = _files(folder)
        files.create_dir(base, recursive=True)
        temp = f"{base}/.{part}-{uuid.uuid4().hex}"
        at = records = tokens = 0
        with files.open_output_stream(f"{temp}.rec") as rec, files.open_output_stream(f"{temp}.idx") as idx:
            for b in parts:
                texts, ids = b.column(1).to_pylist(), b.column(0)
                done = 0
                hold: list[bytes] = []
                size = 0
                for n, p in enumerate(enc.payloads(texts, end), 1):
                    hold.append(p)
                    size += len(p)
                    if size > 1 << 22 or n == len(texts):
                        data, offsets = _frame(hold)
                        rec.write(data)
                        x = np.zeros(len(hold), INDEX)
                        own = ids.slice(done, len(hold))
                        x["doc_id"], x["null"] = own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False)
                        x["offset"], x["length"] = offsets + at, [len(p) for p in hold]
                        idx.write(x.tobytes())
                        at, done, records, tokens = at + len(data), done + len(hold), records + len(hold), tokens + size // enc.wide
                        hold, size = [], 0
        if records:
            for kind in ("rec", "idx"):
                files.move(f"{temp}.{kind}", f"{base}/part-{part:06d}.{kind}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "records": pa.array([records], pa.int64()), "tokens": pa.array([tokens], pa.int64()), "wide": pa.array([enc.wide], pa.int32())})
        else:
            for kind in ("rec", "idx"):
                files.delete_file(f"{temp}.{kind}")

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(rows.mapInArrow(write, "part int, records long, tokens long, wide int"), "records-manifest")


def read_batches(folder: str, part: int, wide: int, most: int = 1 << 23) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index rows, ids of all their records, ids before each record) in file order; every checksum is tested."""
    files, base = _files(folder)
    with files.open_input_stream(f"{base}/part-{part:06d}.idx") as f:
        index = np.frombuffer(f.read(), INDEX)
    with files.open_input_file(f"{base}/part-{part:06d}.rec") as f:
        i = 0
        ends = index["offset"].astype(np.int64) + index["length"].astype(np.int64) + 4
        while i < len(index):
            begin = int(index["offset"][i]) - 12
            j = max(i + 1, int(np.searchsorted(ends, begin + most, "right")))
            f.seek(begin)
            buf = np.frombuffer(f.read(int(ends[j - 1]) - begin), np.uint8)
            rows = index[i:j]
            at, size = rows["offset"].astype(np.int64) - begin, rows["length"].astype(np.int64)
            word = lambda p: np.ascontiguousarray(buf[p[:, None] + np.arange(4)]).view("<u4")[:, 0]
            heads = np.ascontiguousarray(buf[(at - 12)[:, None] + np.arange(8)]).view("<u8")[:, 0]
            good = (heads == rows["length"]) & (word(at - 4) == masked(crc32c(buf, at - 12, np.full(j - i, 8)))) & (word(at + size) == masked(crc32c(buf, at, size)))
            if not good.all():
                raise ValueError(f"part {part}: record {i + int(np.argmin(good))} is damaged")
            before = np.cumsum(size) - size
            inside = np.arange(int(size.sum())) + np.repeat(at - before, size)
            yield rows, np.ascontiguousarray(buf[inside]).view(f"<u{wide}"), np.append(before, size.sum()) // wide
            i = j


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every record, read from the files; start counts the ids of all records before it."""
    from pyspark.sql import Window

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for part, wide, base in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for rows, ids, at in read_batches(folder, part, wide):
                    raw = ids.astype("<u4").tobytes()
                    crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], mask=rows["null"] > 0), pa.array(base + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    base += int(at[-1])

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    m = manifest.select("part", "wide", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    n = max(1, manifest.count())
    return m.repartitionByRange(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "records")
    manifest = write_records(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_records(manifest, folder)
