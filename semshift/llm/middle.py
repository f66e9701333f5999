"""Fill-in-middle: documents cut in three at token boundaries, by an automaton that runs over pieces of texts at once.

A token is a run of letters or any other code point. The automaton reads code points and has four states: behind no letter,
in a run of letters, behind "<", behind "<" and P, S or M. It counts where tokens begin and where markers end. A chunk of a
text does not know the state it is entered in, so it emits, for each start state, the state it ends in and both counts.
Such functions compose associatively: chunks to blocks of FAN, blocks to documents, and back down as each chunk's entry
state and the tokens before it. The counts then tell which chunks hold a document's two cuts; only those are read again for the places.

A text of one chunk starts in the first state and is done where it stands, without a shuffle; the text itself never comes back from
Python. Longer ones are dealt as chunks, so that no task holds more of them than a chunk, but for the scan that cuts them. Their output is rows in
order, and their checksums are taken as the rows stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_free, stored, table

#: Bytes of a chunk at most; chunks of a block.
CHUNK, FAN = 1 << 16, 256

#: The markers.
P, S, M = "<P>", "<S>", "<M>"

# classes of bytes: 0 other, 1 letter, 2 "<", 3 one of P, S, M, 4 ">", 5 inside a code point
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[list(b"PSM")], _CLASS[ord("<")], _CLASS[ord(">")], _CLASS[128:192] = 3, 2, 4, 5
_IN_WORD = np.array([0, 1, 0, 1], bool)  # states in a run of letters


def step(state: int, kind: int) -> tuple[int, int, int]:
    """The automaton: next state, tokens begun, markers ended by a code point of that class."""
    if kind in (1, 3):
        return (3 if state == 2 and kind == 3 else 1), int(not _IN_WORD[state]), 0
    return (2 if kind == 2 else 0), 1, int(kind == 4 and state == 3)


class Scan:
    """Chunks of UTF-8 in one array, each entered in the first state."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pa.array(texts.fill_null(b"") if texts.null_count else texts, pa.large_binary())
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
        self.off = off - off[0]
        kind = _CLASS[data]
        self.at = np.flatnonzero(kind != 5)  # where code points begin
        self.kind = kind = kind[self.at]
        self.first = np.searchsorted(self.at, self.off)  # each chunk's first code point
        self.chars = np.diff(self.first)
        letter = (kind == 1) | (kind == 3)
        fresh = np.zeros(len(kind) + 1, bool)
        fresh[self.first] = True  # nothing stands before a chunk
        one, two = (np.r_[np.zeros(k, np.uint8), kind][: len(kind)] for k in (1, 2))
        one = np.where(fresh[:-1], 0, one)
        two = np.where(fresh[:-1] | np.r_[False, fresh][: len(kind)], 0, two)
        self.begins = np.flatnonzero(~letter | (one != 1) & (one != 3))  # code points at which tokens begin
        ends = np.flatnonzero((kind == 4) & (one == 3) & (two == 2))
        self.token = np.searchsorted(self.begins, self.first)
        self.tokens = np.diff(self.token)
        self.markers = np.diff(np.searchsorted(ends, self.first))

    def functions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each chunk and start state: the end state, tokens begun, markers ended. Only the first two code points and the last two depend on more than their neighbours."""
        n = len(self.chars)
        to, tokens, markers = np.tile(np.arange(4), (n, 1)), np.repeat(self.tokens[:, None], 4, 1), np.repeat(self.markers[:, None], 4, 1)
        for i, (a, m) in enumerate(zip(self.first, self.chars, strict=False)):
            head = self.kind[a : a + min(2, m)].tolist()
            tail = self.kind[max(a, a + m - 2) : a + m].tolist()
            for s in range(4):
                run = [s, 0]
                for x in (s, 0):
                    t = k = 0
                    for c in head:
                        x, u, v = step(x, c)
                        t, k = t + u, k + v
                    run.append((t, k))
                tokens[i, s] += run[2][0] - run[3][0]
                markers[i, s] += run[2][1] - run[3][1]
                x = s if m <= 2 else 0
                for c in tail:
                    x, _, _ = step(x, c)
                to[i, s] = x
        return to, tokens, markers

    def cut(self, i: np.ndarray, token: np.ndarray, entry: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and code points of chunk i, entered in that state, that stand before the token of that number; all of them if it has no such token, none if the number is negative."""
        lead = np.minimum(self.first[i], max(0, len(self.kind) - 1))
        if len(self.kind):
            glued = _IN_WORD[entry] & (self.chars[i] > 0) & ((self.kind[lead] == 1) | (self.kind[lead] == 3))
        else:
            glued = np.zeros(len(i), bool)
        token = np.where(token < 0, token, token + glued)
        inside = (token >= 0) & (token < self.tokens[i])
        char = np.where(token < 0, self.first[i], self.first[i + 1])
        char[inside] = self.begins[self.token[i[inside]] + token[inside]]
        where = np.r_[self.at, self.off[-1]]
        byte = np.where(char == self.first[i], self.off[i], np.where(char == self.first[i + 1], self.off[i + 1], where[np.minimum(char, len(self.at))]))
        return byte - self.off[i], char - self.first[i]


_CUTS = "n long, markers long, a int, b int, a_chars long, b_chars long"


def _whole(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """Texts of one chunk: tokens, markers, bytes and code points before either cut."""
    x = Scan(text)
    n = x.tokens
    h = np.sort(np.stack([h.to_numpy() % (n + 1) for h in (h1, h2)]), axis=0)
    i = np.arange(len(n))
    (a, ac), (b, bc) = (x.cut(i, k) for k in h)
    cols = [n, x.markers, a.astype(np.int32), b.astype(np.int32), ac, bc]
    return pa.StructArray.from_arrays([pa.array(c) for c in cols], ["n", "markers", "a", "b", "a_chars", "b_chars"])


def _places(body: pa.Array, entry: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    """Chunks that hold cuts: bytes and code points of the chunk before either."""
    x = Scan(body)
    i, e = np.arange(len(x.chars)), entry.to_numpy()
    (ab, ac), (bb, bc) = (x.cut(i, k.to_numpy(), e) for k in (a, b))
    return pa.StructArray.from_arrays([pa.array(c) for c in (ab.astype(np.int32), bb.astype(np.int32), ac, bc)], ["a", "b", "a_chars", "b_chars"])


def draws(doc_id: Column) -> list[Column]:
    """Four numbers below 2^32 from an id; a null id counts as empty text."""
    hexed = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _form(h3: Column, h4: Column, empty: Column, markers: Column) -> Column:
    return F.when(empty | (markers > 0) | (h3 % 100 >= 90), "plain").when(h4 % 100 < 20, "spm").otherwise("psm")


def _within(docs: DataFrame, text: str, doc_id: str, chunk: int) -> DataFrame:
    """Documents of one chunk, with n, form, prefix_chars, middle_chars, document (null), section, part (0) and output."""
    h1, h2, h3, h4 = draws(F.col(doc_id))
    t = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    cuts = F.arrow_udf(_whole, _CUTS)
    d = docs.where(F.octet_length(t) <= chunk).withColumns({"__t": t, "__h1": h1, "__h2": h2})
    d = d.withColumn("__c", cuts("__t", "__h1", "__h2"))
    d = d.withColumns({"n": F.col("__c.n"), "form": _form(h3, h4, F.octet_length("__t") == 0, F.col("__c.markers"))})
    piece = lambda a, b: F.substring(F.col("__t"), a + 1, b - a)
    a, b, end = F.col("__c.a"), F.col("__c.b"), F.octet_length("__t")
    prefix, middle, suffix = piece(F.lit(0), a), piece(a, b), piece(b, end)
    mark = lambda x: F.lit(x).cast("binary")
    made = F.when(F.col("form") == "plain", F.col("__t")).when(F.col("form") == "psm", F.concat(mark(P), prefix, mark(S), suffix, mark(M), middle)).otherwise(F.concat(mark(S), suffix, mark(P), prefix, mark(M), middle))
    cut = F.col("form") != "plain"
    d = d.withColumns({
        "prefix_chars": F.when(cut, F.col("__c.a_chars")), "middle_chars": F.when(cut, F.col("__c.b_chars") - F.col("__c.a_chars")),
        "document": F.lit(None).cast("long"), "section": F.lit(0), "part": F.lit(0), "output": made.cast("string"),
    })
    return d.drop("__t", "__h1", "__h2", "__c", text)


def chunks_of(data: bytes, size: int) -> Iterator[bytes]:
    """UTF-8 in pieces of at most `size` (4 or more) bytes that end with a code point."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and 128 <= data[end] < 192:
            end -= 1
        yield data[at:end]
        at = end


def _chunked(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held: list[bytes] = []
                no = 0
                for c in chunks_of(text.as_py(), size):
                    held.append(c)
                    if len(held) == 16:
                        yield emit(row, no, held)
                        no, held = no + 16, []
                if held:
                    yield emit(row, no, held)

    def emit(row: int, no: int, held: list[bytes]) -> pa.RecordBatch:
        body = pa.array(held, pa.binary())
        x = Scan(body)
        fours = [pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * 4, pa.int32()), pa.array(f.astype(np.int64).ravel())) for f in x.functions()]
        k = len(held)
        return pa.RecordBatch.from_arrays([pa.array([row] * k), pa.array(np.arange(no, no + k), pa.int32()), body, pa.array([len(h) for h in held], pa.int32()), pa.array(x.chars), *fours], ["document", "no", "body", "size", "chars", "to", "tokens", "markers"])

    return run


def compose(f: Column, g: Column) -> Column:
    """First f, then g: functions as structs of to, tokens, markers, each an array over start states."""
    each = lambda of: F.transform(F.sequence(F.lit(0), F.lit(3)), of)
    then = lambda x, s: F.get(g[x], F.get(f["to"], s).cast("int"))
    return F.struct(
        each(lambda s: then("to", s)).alias("to"), each(lambda s: F.get(f["tokens"], s) + then("tokens", s)).alias("tokens"), each(lambda s: F.get(f["markers"], s) + then("markers", s)).alias("markers")
    )


def _identity() -> Column:
    longs = lambda *x: F.array(*[F.lit(v).cast("long") for v in x])
    return F.struct(longs(0, 1, 2, 3).alias("to"), longs(0, 0, 0, 0).alias("tokens"), longs(0, 0, 0, 0).alias("markers"))


def _down(items: Column, entry: Column, before: Column, key: str) -> Column:
    """From a list of (key, f) in order and what it is entered with: an array of key, entry and tokens before each, and its own tokens."""
    start = F.struct(entry.cast("long").alias("entry"), before.cast("long").alias("before"), F.array().cast(f"array<struct<{key}:int,entry:int,before:long,own:long>>").alias("out"))

    def go(acc: Column, x: Column) -> Column:
        own = F.get(x["f"]["tokens"], acc["entry"].cast("int"))
        one = F.struct(x[key].cast("int").alias(key), acc["entry"].cast("int").alias("entry"), acc["before"].alias("before"), own.alias("own"))
        return F.struct(F.get(x["f"]["to"], acc["entry"].cast("int")).alias("entry"), (acc["before"] + own).alias("before"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(items, start, go, lambda acc: acc["out"])


def _beyond(docs: DataFrame, text: str, doc_id: str, chunk: int) -> DataFrame:
    """Documents of several chunks: the same columns, output in rows that are read in order of section and part."""
    t = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    others = [c for c in docs.columns if c != text]
    big = stored(docs.where(F.octet_length(t) > chunk).select(*others, t.alias("__t")).withColumn("document", F.monotonically_increasing_id()), "fim-long")
    fours = "array<long>"
    parts = stored(big.select("document", "__t").mapInArrow(_chunked(chunk), f"document long, no int, body binary, size int, chars long, to {fours}, tokens {fours}, markers {fours}"), "fim-chunks")
    known = big.drop("__t")

    # up: chunks to blocks of FAN, blocks to documents; a list has at most FAN chunks or the blocks of one document
    f = F.struct("to", "tokens", "markers")
    blocks = parts.groupBy("document", F.expr(f"no div {FAN}").cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("no", f.alias("f")))).alias("list"))
    blocks = stored(blocks.withColumn("f", F.aggregate("list", _identity(), lambda acc, x: compose(acc, x["f"]))), "fim-blocks")
    tops = blocks.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("block", "f"))).alias("list"))
    tops = tops.withColumn("f", F.aggregate("list", _identity(), lambda acc, x: compose(acc, x["f"])))
    h1, h2, h3, h4 = draws(F.col(doc_id))
    n = F.get("f.tokens", F.lit(0))
    tops = tops.join(known.select("document", doc_id), "document").withColumns({"n": n, "form": _form(h3, h4, F.lit(False), F.get("f.markers", F.lit(0)))})
    tops = tops.withColumns({"x": F.least(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)), "y": F.greatest(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1))})
    # and down: entry states and tokens before each block and chunk
    at_block = tops.select("document", "n", "form", "x", "y", F.explode(_down(F.col("list"), F.lit(0), F.lit(0), "block")).alias("e")).select("document", "n", "form", "x", "y", F.col("e.block"), F.col("e.entry"), F.col("e.before"))
    at_chunk = at_block.join(blocks, ["document", "block"]).select("document", "n", "form", "x", "y", F.explode(_down(F.col("list"), F.col("entry"), F.col("before"), "no")).alias("e"))
    at_chunk = at_chunk.select("document", "n", "form", F.col("e.no"), F.col("e.entry"), F.col("e.own"), (F.col("x") - F.col("e.before")).alias("x"), (F.col("y") - F.col("e.before")).alias("y"))
    at_chunk = stored(at_chunk.where("form <> 'plain'"), "fim-entries")
    holds = lambda k: (F.col(k) >= 0) & (F.col(k) < F.col("own"))
    picked = parts.select("document", "no", "body").join(at_chunk.where(holds("x") | holds("y")), ["document", "no"])
    picked = stored(picked.select("document", "no", F.arrow_udf(_places, "a int, b int, a_chars long, b_chars long")("body", "entry", "x", "y").alias("c")), "fim-cuts")
    before = lambda k, cut, all_: F.when(holds(k), F.col(cut)).when(F.col(k) < 0, 0).otherwise(F.col(all_))
    placed = parts.select("document", "no", "size", "chars").join(at_chunk, ["document", "no"]).join(picked, ["document", "no"], "left")
    placed = placed.select("document", "no", *[before(k, f"c.{v}", "size").alias(v) for k, v in (("x", "a"), ("y", "b"))], *[before(k, f"c.{v}_chars", "chars").alias(f"{v}_chars") for k, v in (("x", "a"), ("y", "b"))])
    placed = stored(placed, "fim-places")

    shown = placed.groupBy("document").agg(F.sum("a_chars").alias("prefix_chars"), F.sum(F.col("b_chars") - F.col("a_chars")).alias("middle_chars"))
    about = stored(tops.select("document", "n", "form").join(shown, "document", "left"), "fim-documents")
    whole = (F.col("form") == "plain").alias("plain")
    piece = lambda a, b: F.substring(F.col("body"), a + 1, b - a)
    a, b, end = F.col("a"), F.col("b"), F.octet_length("body")
    rows = parts.select("document", "no", "body").join(placed, ["document", "no"], "left").join(about.select("document", "form", whole), "document")
    # sections in order: psm has prefix, suffix, middle at 1, 3, 5 behind their markers, spm suffix, prefix, middle
    put = lambda psm, spm, x: F.struct(F.when(F.col("form") == "psm", psm).otherwise(spm).alias("section"), x.alias("output"))
    three = F.array(put(1, 3, piece(F.lit(0), a)), put(3, 1, piece(b, end)), put(5, 5, piece(a, b)))
    rows = rows.select("document", F.col("no").alias("part"), F.explode(F.when(F.col("plain"), F.array(F.struct(F.lit(1).alias("section"), F.col("body").alias("output")))).otherwise(three)).alias("o")).where(F.octet_length("o.output") > 0)
    marks = F.array(*[F.struct(F.lit(i).alias("section"), m.cast("binary").alias("output")) for i, m in ((0, F.when(F.col("form") == "psm", P).otherwise(S)), (2, F.when(F.col("form") == "psm", S).otherwise(P)), (4, F.lit(M)))])
    signs = about.where("form <> 'plain'").select("document", F.lit(0).alias("part"), F.explode(marks).alias("o"))
    rows = rows.unionByName(signs).select("document", "part", F.col("o.section").alias("section"), F.col("o.output").cast("string").alias("output"))
    return rows.join(about.join(known, "document"), "document").select(*others, "n", "form", "prefix_chars", "middle_chars", "document", "section", "part", "output")


_NEW = ["n", "form", "prefix_chars", "middle_chars", "document", "section", "part", "output"]


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """The documents' columns without their text, and n, form, prefix_chars, middle_chars, document, section, part, output.

    A document of at most `chunk` bytes is one row, with `document` null. A longer one is several, which share a number
    `document` and make up the output in order of section and part: markers in rows of their own, pieces of the text between them.
    A null text is empty, and empty texts stay plain; a null id counts as empty text. Rows that repeat come out as often as they
    stand; columns whose names clash (n, form, ...) move aside to name_in.
    """
    docs = columns_free(docs, *_NEW)
    return _within(docs, text, doc_id, chunk).unionByName(_beyond(docs, text, doc_id, chunk))


def restored(output: Column, form: Column) -> Column:
    """The text of a whole document from its output and form: no text that is cut holds a marker, so markers part the pieces."""
    piece = F.split(output, "<[PSM]>")
    at = lambda i: F.coalesce(F.get(piece, F.lit(i)), F.lit(""))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))


def restored_rows(rows: DataFrame) -> DataFrame:
    """Rows of documents in several rows (document, form, section, part, output) to rows of their texts, read in order of section and part: each section's
    place follows from the marker before it; markers go."""
    mark = F.when(F.col("form") != "plain", F.when(F.col("output").isin(P, S, M), F.col("output")))
    signs = rows.withColumn("m", mark).where("m is not null").select(F.col("document").alias("d"), (F.col("section") + 1).alias("s"), "m")
    j = rows.where(mark.isNull()).join(signs, (F.col("document") == F.col("d")) & (F.col("section") == F.col("s")), "left")
    place = F.when(F.col("m") == P, 0).when(F.col("m") == M, 1).when(F.col("m") == S, 2).otherwise(F.col("section"))
    return j.select("document", "form", place.alias("section"), "part", "output")


def checksums(rows: DataFrame, name: str) -> DataFrame:
    """document and the SHA-256 of its rows' output in order of section and part, taken as the sorted rows stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h = None, hashlib.sha256()
        one = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([h.hexdigest()])], ["document", name])
        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if d != at:
                    if at is not None:
                        yield one()
                    at, h = d, hashlib.sha256()
                h.update(x.as_py())
        if at is not None:
            yield one()

    s = rows.select("document", "section", "part", F.col("output").cast("binary").alias("output"))
    return s.repartition("document").sortWithinPartitions("document", "section", "part").select("document", "output").mapInArrow(run, f"document long, {name} string")


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    small = _within(docs, "text", "doc_id", CHUNK).withColumns({"output_sha256": sha(F.col("output")), "restored_sha256": sha(restored(F.col("output"), F.col("form")))})
    rows = stored(_beyond(docs, "text", "doc_id", CHUNK), "fim-rows")
    big = rows.select(*out[:5], "document").distinct().join(checksums(rows, "output_sha256"), "document").join(checksums(restored_rows(rows), "restored_sha256"), "document")
    return small.select(*out).unionByName(big.select(*out))
