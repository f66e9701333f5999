"""Substring dedup: repeats of whole word windows across documents, from prefix-partitioned suffix trees.

A suffix is read to depth `span`: a node at that depth with leaves of several documents is a repeat, and neighbouring
ones make up the maximal repeats. The prefix that deals a suffix into a group is the rarest-looking one of its window,
the word sequence of GRAM words with the least hash (the window's anchor): equal windows have equal anchors, and as
neighbouring windows mostly share theirs, one text segment carries many suffixes, where a prefix at the suffix's own
start would send every word `span` times.

1. Each document's distinct anchors, sorted by (anchor, doc_id); anchors of a single document go. (No repeat is lost: an
   equal window elsewhere brings the same anchor there.)
2. Documents that still have anchors yield, for each run of windows with one anchor, one text segment.
3. Suffixes under a prefix with more than GROUP segments are dealt by it and by parts of its documents. Groups come in
   batches, in order of their documents, so that of one only its distinct leaves are held.
4. A group's suffixes are sorted, and common-prefix lengths of neighbours give the tree's deep nodes: below each, leaves of
   documents behind the first one are repeats. Of a prefix that is dealt in parts, each part's first documents are
   compared afterwards, leaf by leaf: a leaf has one of them in a part at most.
5. Covered word ranges go back to their documents.

Words are compared as 64-bit hashes of runs of five words or fewer, all of a suffix's runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns_free, forget, stored, table
from .wordgrid import Grid, gathered, grams, mixed

#: Words of the sequences that anchors are taken from; segments under one anchor from which its suffixes are dealt in parts.
GRAM, GROUP = 5, 1 << 13
#: Bytes of segments that are sorted at once.
BATCH = 1 << 20


def _windows(g: Grid, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each window, the word its anchor begins at, the anchor's hash."""
    h = g.hashes()
    n = max(0, len(h) - span + 1)
    start = np.flatnonzero(g.text[:n] == g.text[span - 1 :]) if n else np.zeros(0, np.int64)
    k = grams(h, min(GRAM, span))
    best = k[:n].copy()
    at = np.arange(n, dtype=np.int64)
    for i in range(1, span - min(GRAM, span) + 1):
        x = k[i : i + n]
        less = x < best
        best[less] = x[less]
        at[less] = np.flatnonzero(less) + i
    return start, at[start], best[start].view(np.int64)


def _pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    z = zstandard.ZstdCompressor(level=1, write_content_size=True)
    for b in parts:
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([z.compress(t.as_py()) for t in b.columns[-1]], pa.binary())], b.schema.names)


def _unpacked(b: pa.RecordBatch, column: int) -> pa.Array:
    import zstandard

    z = zstandard.ZstdDecompressor()
    return pa.array([z.decompress(t.as_py()) for t in b.columns[column]], pa.large_binary())


def _slices(b: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of so many bytes of text at most, as the packed column's frames state them, or of one row."""
    import zstandard

    size = np.array([zstandard.frame_content_size(t.as_py()) for t in b.columns[column]], np.int64)
    at = 0
    while at < len(size):
        n = max(1, int(np.searchsorted(np.cumsum(size[at:]), most, "right")))
        yield b.slice(at, n)
        at += n


def _anchors(span: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(parts):
            g = Grid(b.column(1).cast(pa.large_binary()))
            _, at, anchor = _windows(g, span)
            new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else at
            text, anchor = g.text[at[new]], anchor[new]
            order = np.lexsort((anchor, text))
            text, anchor = text[order], anchor[order]
            keep = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])]) if len(text) else np.zeros(0, np.int64)
            runs = np.diff(np.r_[keep, len(text)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[keep]), b.column(0).take(pa.array(text[keep])), pa.array(runs)], ["anchor", "doc_id", "runs"])

    return run


def _shared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (anchor, doc_id), those whose anchor has two documents at least. The last group's first row waits for the next batch."""
    last: tuple[int, int, bool, int] | None = None  # anchor, its first document, whether that is out, its runs
    for b in gathered(parts):
        a, d, n = (b.column(k).to_numpy() for k in range(3))
        if not len(a):
            continue
        if last is not None:
            a, d, n = np.r_[np.int64(last[0]), a], np.r_[np.int64(last[1]), d], np.r_[np.int32(last[3]), n]
        cut = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        size = np.diff(np.r_[cut, len(a)])
        many = d[cut] != d[cut + size - 1]
        out = np.repeat(many, size)
        if last is not None and last[2]:
            out[: size[0]] = True
            out[0] = False
            many[0] = True
        last = (int(a[cut[-1]]), int(d[cut[-1]]), bool(many[-1]), int(n[cut[-1]]))
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(a[out]), pa.array(d[out]), pa.array(n[out])], ["anchor", "doc_id", "runs"])


def _segments(span: int):
    """One row for each run of windows whose anchor is among the document's shared ones: anchor, part, row, first word, the run's text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in gathered(parts, most=1 << 19) for x in _slices(whole, 2)):
            g = Grid(_unpacked(b, 2))
            start, at, anchor = _windows(g, span)
            lists = b.column(3)
            own = lists.flatten()
            dealt = np.ascontiguousarray(own.field(1).to_numpy(zero_copy_only=False))
            own = np.ascontiguousarray(own.field(0).to_numpy(zero_copy_only=False))
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            # membership of (text, anchor) by a mixed hash of both
            tag = lambda t, x: mixed(x.view(np.uint64) + t.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            have = tag(owner, own)
            by = np.argsort(have)
            have, dealt = have[by], dealt[by]
            want = tag(g.text[start], anchor)
            i = np.minimum(np.searchsorted(have, want), max(0, len(have) - 1))
            keep = have[i] == want if len(have) else np.zeros(len(want), bool)
            start, at, anchor, i = start[keep], at[keep], anchor[keep], i[keep]
            if not len(start):
                continue
            cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
            end = np.r_[cut[1:], len(start)] - 1
            text = g.text[start[cut]]
            words = g.joined(start[cut], start[end] + span - 1)
            rows = pa.array(text)
            doc = b.column(0).take(rows)
            parts_of = dealt[i[cut]]
            part = np.where(parts_of > 1, (mixed(doc.to_numpy().astype(np.uint64)) % parts_of.astype(np.uint64)).astype(np.int32), -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[cut]), pa.array(part), doc, b.column(1).take(rows), pa.array((start[cut] - g.first[text]).astype(np.int32)), pa.array(words, pa.binary())], ["anchor", "part", "doc_id", "row", "at", "words"])

    return run


def _suffixes(g: Grid, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each suffix that is `span` words long at least, and those words, in runs of five or fewer that stand as numbers: equal runs of a batch have equal ones."""
    h = g.hashes()
    n = max(0, len(h) - span + 1)
    start = np.flatnonzero(g.text[:n] == g.text[span - 1 :]) if n else np.zeros(0, np.int64)
    runs = -(-span // 5)
    sizes = [span // runs + (i < span % runs) for i in range(runs)]
    out = np.zeros((len(start), runs), ">u4")
    if len(start):
        names = {k: np.unique(grams(h, k), return_inverse=True)[1] for k in set(sizes)}
        at = 0
        for i, k in enumerate(sizes):
            out[:, i] = names[k][start + at]
            at += k
    return start, out


def _sorted(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by group and words, stable, and where a suffix differs from the one before it: a new node of the whole depth begins."""
    both = np.concatenate([np.unique(group, return_inverse=True)[1].astype(">u4")[:, None], words], 1)
    order = np.argsort(np.ascontiguousarray(both).view(f"S{4 * both.shape[1]}").ravel(), kind="stable")
    both = both[order]
    new = np.ones(len(both), bool)
    common = np.minimum.accumulate(both[1:] == both[:-1], axis=1).sum(1)  # the common prefix of neighbours, in runs
    new[1:] = common < both.shape[1]
    return order, np.flatnonzero(new)


def _groups(b: pa.RecordBatch, seg: np.ndarray) -> np.ndarray:
    """A number for (anchor, part) of each suffix."""
    return mixed(b.column(0).to_numpy().view(np.uint64) + b.column(1).to_numpy().astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[seg]


def _trees(span: int):
    """Of segments sorted by (anchor, part, doc_id): the word ranges of suffixes that a smaller document has too.

    A group that doesn't end with its batch goes on in the next one with its leaves, each as two hashes of its words and its
    first document. Of parts also the ranges of each leaf's first document are given, with those hashes.
    """

    def tree(b: pa.RecordBatch, held: tuple | None) -> tuple[list[pa.RecordBatch], tuple]:
        g = Grid(b.column(5).cast(pa.large_binary()))
        start, words = _suffixes(g, span)
        anchors, parts_ = b.column(0).to_numpy(), b.column(1).to_numpy()
        last = (int(anchors[-1]), int(parts_[-1]))
        if not len(start):
            return [], held if held is not None and held[0] == last else (last, *(np.zeros(0, np.int64),) * 3)
        seg = g.text[start]
        doc = b.column(2).to_numpy()[seg]
        order, node = _sorted(_groups(b, seg), words)
        least = np.minimum.reduceat(doc[order], node)
        h = g.hashes()
        hashes = [grams(h, span, k).view(np.int64) for k in (1, 2)]
        one = order[node]  # a suffix of each node
        leaf = np.rec.fromarrays([x[start[one]] for x in hashes])
        of = lambda key: (anchors[seg[one]] == key[0]) & (parts_[seg[one]] == key[1])
        if held is not None and len(held[1]):
            mine = np.flatnonzero(of(held[0]))
            old = np.rec.fromarrays(held[1:3])
            by = np.argsort(old, kind="stable")
            i = by[np.minimum(np.searchsorted(old[by], leaf[mine]), len(old) - 1)]
            same = old[i] == leaf[mine]
            least[mine[same]] = np.minimum(least[mine[same]], held[3][i[same]])
        keep = np.flatnonzero(of(last))
        new = (last, leaf.f0[keep], leaf.f1[keep], least[keep])
        if held is not None and held[0] == last:
            rest = ~np.isin(np.rec.fromarrays(held[1:3]), leaf[keep]) if len(held[1]) else np.zeros(0, bool)
            new = (last, *(np.r_[x, y[rest]] for x, y in zip(new[1:], held[1:], strict=True)))
        repeat = np.zeros(len(order), bool)
        repeat[order] = doc[order] > np.repeat(least, np.diff(np.r_[node, len(order)]))
        base = b.column(4).to_numpy().astype(np.int64) - g.first[:-1]

        def rows(s: np.ndarray, lo: np.ndarray, hi: np.ndarray, *xy: np.ndarray) -> pa.RecordBatch:
            t = pa.array(s)
            none = pa.nulls(len(s), pa.int64())
            return pa.RecordBatch.from_arrays([b.column(2).take(t), b.column(3).take(t), pa.array((base[s] + lo).astype(np.int32)), pa.array((base[s] + hi).astype(np.int32)), *(map(pa.array, xy) if xy else (none, none))], ["doc_id", "row", "lo", "hi", "x", "y"])

        out = []
        hit = np.flatnonzero(repeat)
        if len(hit):
            s, w = seg[hit], start[hit]
            cut = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (w[1:] != w[:-1] + 1)])
            end = np.r_[cut[1:], len(hit)] - 1
            out.append(rows(s[cut], w[cut], w[end] + span))
        first = np.flatnonzero(~repeat & (parts_[seg] >= 0))
        if len(first):
            w = start[first]
            out.append(rows(seg[first], w, w + span, *(x[w] for x in hashes)))
        return out, new

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in gathered(parts, most=BATCH, step=min(128, BATCH >> 7)):
            if held is not None and held[0] != (b.column(0)[0].as_py(), b.column(1)[0].as_py()):
                held = None
            out, held = tree(b, held)
            yield from out

    return run


def repeats(docs: DataFrame, span: int = 13, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, row (hash of the text), ranges (array of lo, hi: words covered by repeats) for documents that have any."""
    t = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("t"))
    anchors = rows.mapInArrow(_anchors(span), "anchor long, doc_id long, runs int")
    shared = anchors.repartition("anchor").sortWithinPartitions("anchor", "doc_id").mapInArrow(_shared, "anchor long, doc_id long, runs int")
    kept = stored(shared, "shared-anchors")
    crowded = kept.groupBy("anchor").agg(F.sum("runs").alias("c")).where(F.col("c") > GROUP)
    crowded = stored(crowded.select("anchor", F.ceil(F.col("c") / GROUP).cast("int").alias("dealt")), "crowded-anchors")
    shared = kept.join(crowded, "anchor", "left").select("doc_id", F.struct("anchor", F.coalesce("dealt", F.lit(1)).alias("dealt")).alias("a"))
    shared = shared.groupBy("doc_id").agg(F.collect_set("a").alias("anchors"))
    packed = rows.select("doc_id", F.xxhash64("t").alias("row"), "t").mapInArrow(_pack, "doc_id long, row long, t binary")
    own = packed.join(shared, "doc_id").select("doc_id", "row", "t", "anchors")
    segments = own.mapInArrow(_segments(span), "anchor long, part int, doc_id long, row long, at int, words binary")
    segments = segments.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "doc_id")
    found = stored(segments.mapInArrow(_trees(span), "doc_id long, row long, lo int, hi int, x long, y long"), "repeat-ranges")
    forget(kept, crowded)
    first = found.where("x is not null").withColumn("first", F.min("doc_id").over(Window.partitionBy("x", "y")))  # a document for each part at most
    found = found.where("x is null").unionByName(first.where("doc_id > first").drop("first"))
    return found.groupBy("doc_id", "row").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))


def remove_repeats(docs: DataFrame, span: int = 13, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, words, removed, kept (binary: what is left of the text) for every row.

    Words under a window whose sequence also starts in a document with a smaller doc_id go; what is left is joined by
    single spaces, and a text that loses nothing stays as it is in `kept` (null text: empty). Rows without a doc_id are
    compared with nothing and lose nothing. Rows that repeat a doc_id count as one document, each by its own text. Other
    columns stay; one that is called like a result gets _in at its end.
    """

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in parts for x in _slices(whole, 1, 1 << 21)):
            ranges = b.column(2).to_pylist()
            texts = _unpacked(b, 1).to_pylist()
            words, removed, kept = [], [], []
            for t, r in zip(texts, ranges, strict=True):
                w = t.split()
                gone = 0
                if r:
                    gaps, at = [], 0
                    for x in sorted((x["lo"], x["hi"]) for x in r):
                        if x[0] > at:
                            gaps.append((at, x[0]))
                        at = max(at, x[1])
                    gaps.append((at, len(w)))
                    rest = [x for lo, hi in gaps for x in w[lo:hi]]
                    gone = len(w) - len(rest)
                    t = b" ".join(rest)
                words.append(len(w))
                removed.append(gone)
                kept.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), *b.columns[3:]], ["doc_id", "words", "removed", "kept", *b.schema.names[3:]])

    docs = columns_free(docs, "__words", "__removed", "__kept")
    others = [c for c in docs.columns if c not in (text, doc_id)]
    t = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("row"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(others)], t.alias("t"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    packed = rows.mapInArrow(_pack, schema)
    j = packed.join(repeats(docs, span, text, doc_id), ["doc_id", "row"], "left").select("doc_id", "t", "ranges", *[f"o{i}" for i in range(len(others))])
    tail = "".join(f", o{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others))
    out = j.mapInArrow(cut, "doc_id long, words long, removed long, kept binary" + tail)
    return out.select("doc_id", F.col("words").alias("__words"), F.col("removed").alias("__removed"), F.col("kept").alias("__kept"), *[F.col(f"o{i}").alias(c) for i, c in enumerate(others)])


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            sha = [hashlib.sha256(b" ".join(t.as_py().split())).hexdigest() for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 13)
    return out.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


#: The same by whole windows: every window's first document, the words that later documents' windows cover, what is left.
ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w)),
hit AS (SELECT win.doc_id, win.i FROM win JOIN (SELECT s, min(doc_id) AS d FROM win GROUP BY s) f ON win.s = f.s AND f.d < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
pos AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.p) AS t, count(*) AS n FROM pos ANTI JOIN gone ON pos.doc_id = gone.doc_id AND pos.p = gone.p GROUP BY pos.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
