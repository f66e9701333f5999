"""SimHash near-duplicates by Golay-code fuzzy hashing.

Two ways to candidates, of which `linked` takes codeword indices of 23-bit fingerprint segments:

* `linked` finds all pairs of 64-bit fingerprints within 2 bits. Of three segments (23, 23, 18 bits) one is free of
  errors (pigeonhole); the next one has at most two, so the lists of its near codewords share an index. Key: the exact
  segment with each near index of the next. A crowded key is made longer by the near indices of the third segment, which
  loses no pair either.
* `near_copies` is for similarities of shingle sets, which fingerprints only guess at: at a similarity of 0.8 some 10 of 64
  bits differ. What `linked` finds is compared set by set and links first; whatever the fingerprints miss is found among the sets
  that share one of their first shingles, again by exact Jaccard similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import golay
from .common import forget, stored, table
from .graph import components

#: Fingerprints under one key from which the key is made longer.
CROWDED = 64


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the lower-cased text's shingles, repeats included; of the whole sequence where words are fewer; of nothing where there are none."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        return np.array([xxh64_intdigest(b" ".join(w), seed)], np.uint64)
    rows = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    return np.fromiter((xxh64_intdigest(s, seed) for s in rows), np.uint64, len(w) - words + 1)


def _set_bits(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of 64 bits."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 240):  # sums that fit a byte
        total += np.unpackbits(h[i : i + 240].astype("<u8")[:, None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return total


def majority(h: np.ndarray) -> np.ndarray:
    """The bits that over half of the hashes have set, as one unsigned 64-bit word."""
    if not len(h):
        return np.zeros(1, "<u8")
    return np.packbits(_set_bits(h) * 2 > len(h), bitorder="little").view("<u8")


def _text(docs: DataFrame, text: str) -> F.Column:
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp: 64 bits as a long. A null or empty text has fingerprint 0."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            fp = np.array([majority(shingle_hashes(t.as_py(), words))[0] for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), _text(docs, text).alias("t")).mapInArrow(run, "doc_id long, fp long")


#: Bits of the three segments: where each begins, and its length.
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def _segment(fp: np.ndarray, i: int) -> np.ndarray:
    at, n = SEGMENTS[i]
    return ((fp.view(np.uint64) >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)


def _keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key (long) of each fingerprint: number of the exact segment, that segment, a near index of the next."""
    for b in parts:
        fp = b.column(0).to_numpy()
        for i in range(3):
            near = golay.near(_segment(fp, (i + 1) % 3))
            keys = ((np.int64(i) << 40) | (_segment(fp, i) << 12))[:, None] | near
            keep = np.ones_like(near, bool)
            keep[:, 1:] = near[:, 1:] != near[:, :1]  # a single near codeword stands six times
            row, _ = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(fp[row])], ["key", "fp"])


def _longer(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key made longer by each near index of the third segment."""
    for b in parts:
        key, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
        which = key >> 40
        third = np.choose(which, [_segment(fp, (i + 2) % 3) for i in range(3)])
        near = golay.near(third)
        keep = np.ones_like(near, bool)
        keep[:, 1:] = near[:, 1:] != near[:, :1]
        row, _ = np.nonzero(keep)
        yield pa.RecordBatch.from_arrays([pa.array(((key[:, None] << 12) | near | (np.int64(1) << 62))[keep]), pa.array(fp[row])], ["key", "fp"])


def linked(nodes: DataFrame) -> DataFrame:
    """All pairs a < b of the distinct fingerprints in column fp that differ in 1 or 2 bits."""
    keys = stored(nodes.select("fp").mapInArrow(_keys, "key long, fp long"), "golay-keys")
    crowded = stored(keys.groupBy("key").count().where(F.col("count") > CROWDED).select("key"), "golay-crowded")
    cold = keys.join(crowded, "key", "left_anti")
    hot = keys.join(crowded, "key", "left_semi").mapInArrow(_longer, "key long, fp long")
    k = cold.unionByName(hot)
    x, y = k.select("key", F.col("fp").alias("a")), k.select("key", F.col("fp").alias("b"))
    pairs = x.join(y, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b").distinct()
    pairs = stored(pairs, "golay-pairs")
    forget(keys, crowded)
    return pairs


def near_groups(docs: DataFrame, words: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp, component_id for every row: the least doc_id reachable over fingerprints within 2 bits.

    Null and empty texts share the fingerprint 0 and are linked like any other; repeated rows keep their repetitions; an
    empty table gives no rows. Equal fingerprints are one node however many documents have them.
    """
    fps = stored(fingerprints(docs, words, text, doc_id), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-nodes")
    pairs = linked(nodes)
    na, nb = nodes.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), nodes.select(F.col("fp").alias("b"), F.col("rep").alias("rb"))
    comp = components(pairs.join(na, "a").join(nb, "b"), "ra", "rb")
    of = nodes.join(comp, nodes.rep == comp.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


#: One document in so many gives the common shingles; rows there from which one is common; the most that are remembered.
SAMPLE, COMMON, REMEMBERED = 16, 8, 1 << 16
#: How often rows outside a key's first group meet others outside it, and twice how many.
ROUNDS, HUBS = 2, 4
#: Rows of a common key that are dealt together, as the sample has it.
CROWD = 4096
#: Rows of numbers that may be broadcast: some 20 MB.
FEW = 1 << 18
#: Bytes of the bitmap of a set's hashes, and bits for each of them where that is more: elements whose bit the other set lacks aren't
#: shared, which bounds what two sets share.
BITMAP, SPARSE = 256, 4
#: Longs of the smaller bitmap that the last join compares before a pair is made.
FOLDED = 16
#: Pairs that are compared at once; of more, the sixteenths that are compared at a time: what the first ones connect, the later ones leave out.
AT_ONCE, SHARES = 1 << 14, ((0, 1), (1, 4), (4, 16))


def _ordered(h: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A set's shingles in the order that all sets share: those not known as common by hash, then the common ones, rarer first."""
    if not len(common):
        return h
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    return h[np.lexsort((h, np.where(common[at] == h, rank[at], -1)))]


def _bitmap(h: np.ndarray) -> np.ndarray:
    """Which low bits the hashes have: as many places, a power of two, as keep the bitmap of a long set sparse too."""
    own = np.zeros(max(8 * BITMAP, 1 << (SPARSE * len(h)).bit_length()), bool)
    own[h & np.uint64(len(own) - 1)] = True
    return own


def _lacks(x: bytes, y: bytes) -> tuple[int, int]:
    """How many elements of either bitmap's set the other can't have, at least; the longer bitmap is folded to the length of the other."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    p, q = (np.bitwise_or.reduce(b.reshape(-1, min(len(p), len(q))), axis=0) for b in (p, q))
    return np.bitwise_count(p & ~q).sum(), np.bitwise_count(q & ~p).sum()


def _likely(pairs: DataFrame, marked: DataFrame, least: float) -> DataFrame:
    """Those pairs whose bitmaps leave a similarity of `least` possible; none that has it goes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            if not b.num_rows:
                continue
            n, m = (b.column(k).to_numpy().astype(np.int64) for k in (2, 4))
            x, y = np.array([_lacks(x.as_py(), y.as_py()) for x, y in zip(b.column(3), b.column(5), strict=True)], np.int64).T
            most = np.minimum(n - x, m - y)
            yield b.select([0, 1]).filter(pa.array(most * (1 + least) >= least * (n + m) - 1e-6))

    def end(e: str) -> DataFrame:
        return marked.select(F.col("row").alias(e), F.col("n").alias("n" + e), F.col("bits").alias("bits" + e))

    j = pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "na", "bitsa", "nb", "bitsb")
    return stored(j.mapInArrow(run, "a long, b long"), "near-likely")


def _sets(pairs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """row, s: the whole shingle sets of the pairs' rows."""

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            s = [np.unique(shingle_hashes(t.as_py(), words)).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.binary())], ["row", "s"])

    need = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
    need = stored(need, "near-need")
    out = stored(rows.select("row", "t").join(_small(need), "row").mapInArrow(sets, "row long, s binary"), "shingle-sets")
    forget(need)
    return out


def _alike(pairs: DataFrame, s: DataFrame, least: float) -> DataFrame:
    """Those pairs a, b of row numbers whose shingle sets have Jaccard similarity `least` or more."""

    def same(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            p = b.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            if p.num_rows:
                yield p

    both = pairs.join(s.select(F.col("row").alias("a"), F.col("s").alias("x")), "a").join(s.select(F.col("row").alias("b"), F.col("s").alias("y")), "b")
    return stored(both.select("a", "b", "x", "y").mapInArrow(same, "a long, b long"), "near-links")


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends the components don't connect."""
    ca, cb = comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), comp.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(ca, "a", "left").join(cb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _compared(pairs: DataFrame, rows: DataFrame, words: int, least: float, links: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links and their groups with those that the likely pairs add: a share of the pairs at a time, and of it those that are still apart.

    So the whole sets stored and sent are those of one share. Reads the pairs for each share; deletes the groups before.
    """
    share = F.pmod(F.xxhash64("a", "b"), F.lit(SHARES[-1][1]))
    for lo, hi in SHARES if pairs.count() > AT_ONCE else ((0, SHARES[-1][1]),):
        part = stored(_apart(pairs.where((share >= lo) & (share < hi)), comp), "near-part")
        if not part.isEmpty():
            sets = _sets(part, rows, words)
            links = links.unionByName(_alike(part, sets, least))
            old, comp = comp, stored(components(links), "near-groups")
            forget(sets, old)
        forget(part)
    return links, comp


def _small(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has few rows, so that the texts it is joined with stay where they are; as it is otherwise."""
    return F.broadcast(df) if df.count() <= FEW else df


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, component_id, stays and the columns `keep` for every row: groups linked by Jaccard similarity `least` or more of word shingle sets.

    component_id is the group's least doc_id (null if no row has one); `stays` is true for one row of each group, the first
    with that doc_id. Texts without words are copies of each other. Repeated and null doc_ids are rows of their own. An empty
    table gives no rows.

    Golay keys give the first links: fingerprints within 2 bits, sets compared. No pair is missed, though: in any order that
    all sets share, two sets with similarity `least` have one of the first n - ceil(least * n) + 1 shingles in common, so
    these are keys, common shingles last. Under each key the first and the last row meet all others; rows that this doesn't
    connect meet a few of each other; then, wherever a key has further rows that aren't connected yet, those pairs whose bitmaps leave the similarity possible.
    """
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _text(docs, text).alias("t"), *[F.col(c).alias(f"k_{c}") for c in keep])
    rows = stored(picked.withColumn("row", F.monotonically_increasing_id()), "near-rows")
    # equal texts but for case are one node, whose first row has its work done for all
    lower = F.translate(F.col("t").cast("string"), ascii_uppercase, ascii_lowercase).cast("binary")
    of_text = stored(rows.select("row", "doc_id", F.unhex(F.md5(lower)).alias("digest")), "near-digests")
    nodes = stored(of_text.groupBy("digest").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("rows")), "near-nodes")
    doubles = of_text.join(nodes, "digest").where("row > rep").select("row")
    alone = rows.select("row", "t").join(_small(stored(doubles, "near-doubles")), "row", "left_anti")

    def every(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t.as_py(), words)).view(np.int64))], ["h"])

    some = rows.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).select("t").mapInArrow(every, "h long")
    often = some.groupBy("h").count().where(F.col("count") >= COMMON).orderBy(F.col("count").desc(), "h").limit(REMEMBERED).collect()
    common = np.array([r[0] for r in often], np.int64).view(np.uint64)
    by = np.argsort(common)
    deals = np.array([-(-SAMPLE * r[1] // CROWD) for r in often], np.int64)[by]  # parts that a common key's rows are dealt into
    common, rank = common[by], len(by) - by

    def prefixes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            size, first, bits, folded, fp, dealt = [], [], [], [], [], []
            for t in b.column(1):
                h = np.unique(shingle_hashes(t.as_py(), words))
                size.append(len(h))
                own = _bitmap(h)
                bits.append(np.packbits(own).tobytes())
                folded.append(np.packbits(own.reshape(-1, 64 * FOLDED).any(0)).view(np.int64))
                fp.append(majority(h)[0])
                k = _ordered(h, common, rank)[: len(h) - math.ceil(least * len(h) - 1e-9) + 1]
                at = np.minimum(np.searchsorted(common, k), max(0, len(common) - 1))
                dealt.append(np.where(common[at] == k, deals[at], 1).astype(np.int32) if len(common) else np.ones(len(k), np.int32))
                first.append(k.view(np.int64))
            off = pa.array(np.r_[0, np.cumsum([len(f) for f in first])].astype(np.int32))
            lists = pa.ListArray.from_arrays(off, pa.array(np.concatenate([np.zeros(0, np.int64), *first])))
            parts_of = pa.ListArray.from_arrays(off, pa.array(np.concatenate([np.zeros(0, np.int32), *dealt])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(size, pa.int32()), lists, parts_of, pa.array(bits, pa.binary()), pa.array(folded, pa.list_(pa.int64()))], ["row", "fp", "n", "keys", "deals", "bits", "folded"])

    marked = stored(alone.mapInArrow(prefixes, "row long, fp long, n int, keys array<long>, deals array<int>, bits binary, folded array<long>"), "near-prefixes")

    # fingerprints under one Golay key meet the key's least one, equal ones their first row: a star, whatever their number
    fps = stored(marked.groupBy("fp").agg(F.min("row").alias("rep")), "near-fingerprints")
    golay_keys = stored(fps.select("fp").mapInArrow(_keys, "key long, fp long"), "golay-keys")
    hubs = golay_keys.groupBy("key").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1")
    star = golay_keys.join(hubs, "key").where((F.col("hub") < F.col("fp")) & (F.bit_count(F.col("hub").bitwiseXOR(F.col("fp"))) <= 2)).select("hub", "fp").distinct()
    row_of = lambda c: fps.select(F.col("fp").alias(c), F.col("rep").alias(f"r{c}"))
    met = star.join(row_of("hub"), "hub").join(row_of("fp"), "fp").select(F.least("rhub", "rfp").alias("a"), F.greatest("rhub", "rfp").alias("b"))
    same = marked.select("row", "fp").join(fps, "fp").where("row > rep").select(F.col("rep").alias("a"), F.col("row").alias("b"))
    golay_ = stored(met.unionByName(same), "near-golay")
    likely = _likely(golay_, marked, least)
    sets = _sets(likely, rows, words)
    links = _alike(likely, sets, least)
    comp = stored(components(links), "near-groups")
    forget(fps, golay_keys, golay_, likely, sets)

    # how many shingles a set has, and where in its order the key stands
    keys = marked.select(F.posexplode(F.arrays_zip("keys", "deals")).alias("at", "k"), "row", "n").select("k.keys", "k.deals", "row", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("at")).alias("m"))
    keys = keys.select(F.col("keys").alias("key"), F.when(F.col("deals") > 1, F.pmod(F.xxhash64("row"), F.col("deals")).cast("int")).otherwise(-1).alias("part"), "row", "m")
    own = Window.partitionBy("key", "part")  # a crowded key's rows meet the ends of their part here, and those of the key below
    me = F.struct("row", "m")
    met = keys.select("key", "part", "row", "m", F.min(me).over(own).alias("lo"), F.max(me).over(own).alias("hi"), F.count(F.lit(1)).over(own).alias("c")).where("c > 1 or part >= 0")
    met = stored(met.select("key", "part", "row", "m", F.col("lo.row").alias("lo"), F.col("lo.m").alias("lo_m"), F.col("hi.row").alias("hi"), F.col("hi.m").alias("hi_m"), "c"), "near-keys")
    crowd = met.where("part >= 0")
    end = lambda f, e: f(F.struct(F.col(e).alias("row"), F.col(f"{e}_m").alias("m")))
    hubs = crowd.groupBy("key").agg(end(F.min, "lo").alias("l"), end(F.max, "hi").alias("h"))
    hubs = stored(hubs.select("key", F.col("l.row").alias("hub"), F.col("l.m").alias("hub_m"), F.col("h.row").alias("top"), F.col("h.m").alias("top_m")), "near-hubs")
    crowd = crowd.select("key", "row", "m").join(_small(hubs), "key")

    # what two sets can share from a key on, as it is the first one they share, against what they must share
    def can(a: str, b: str) -> F.Column:
        n, at = (lambda x: F.shiftright(F.col(x), 32)), (lambda x: F.col(x).bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.least(n(a) - at(a), n(b) - at(b)) * (1 + least) >= least * (n(a) + n(b)) - 1e-6

    ends = [met.where((F.col(e) != F.col("row")) & can("m", f"{e}_m")).select(F.least("row", e).alias("a"), F.greatest("row", e).alias("b")) for e in ("lo", "hi")]
    ends += [crowd.where((F.col(e) != F.col("row")) & can("m", f"{e}_m")).select(F.least("row", e).alias("a"), F.greatest("row", e).alias("b")) for e in ("hub", "top")]
    ends = stored(reduce(DataFrame.unionByName, ends).distinct(), "near-ends")
    apart = _apart(ends, comp)
    likely = _likely(apart, marked, least)
    links, comp = _compared(likely, rows, words, least, links, comp)
    forget(ends, likely)

    # keys with four rows or more have pairs that haven't met; one that is still apart has an end outside the group of the key's first row
    rest = met.where("part < 0 and c > 3 and row <> lo and row <> hi").select("key", "row", "m", "lo")
    rest = rest.unionByName(crowd.select("key", "row", "m", F.col("hub").alias("lo")))  # of crowded keys any row may have partners in other parts
    rest = stored(rest, "near-rest")
    forget(met, hubs)

    def placed() -> DataFrame:
        of = comp.select(F.col("node").alias("row"), F.col("component").alias("own"))
        first = comp.select(F.col("node").alias("lo"), F.col("component").alias("main"))
        j = rest.join(of, "row", "left").join(first, "lo", "left").select("key", "row", "m", F.coalesce("own", "row").alias("own"), F.coalesce("main", "lo").alias("main"))
        return stored(j, "near-keys-named")

    # rows outside their key's first group meet a few of each other, drawn by one hash for all keys: most groups of them come together
    # here, before pairs are made
    for turn in range(ROUNDS):
        named = placed()
        u = lambda j: F.struct(F.xxhash64("row", F.lit(turn * HUBS + j)).alias("u"), "row", "m")  # noqa: B023, E731
        drawn = named.where("own <> main").groupBy("key").agg(F.array(*[F.min(u(j)) for j in range(HUBS)], *[F.max(u(j)) for j in range(HUBS)]).alias("hubs"))
        outside = named.where("own <> main").join(drawn, "key").select("row", "m", F.explode("hubs").alias("h")).select("row", "m", F.col("h.row").alias("hub"), F.col("h.m").alias("hub_m"))
        more = stored(outside.where(can("m", "hub_m")).select(F.least("row", "hub").alias("a"), F.greatest("row", "hub").alias("b")).distinct(), "near-more")
        likely = _likely(_apart(more, comp), marked, least)
        links, comp = _compared(likely, rows, words, least, links, comp)
        forget(named, more, likely)
    named = placed()
    forget(rest)
    # a key's rows meet where some row is outside its first group; bitmaps are compared within the join, so that it makes no pair they rule out
    keys_open = stored(named.where("own <> main").select("key").distinct(), "near-open-keys")
    marks = [F.col("folded")[i].alias(f"f{i}") for i in range(FOLDED)]
    named_open = stored(named.join(_small(keys_open), "key", "left_semi").join(marked.select("row", *marks), "row"), "near-open-rows")
    x = named_open.where("own <> main").select("key", F.col("row").alias("r"), F.col("m").alias("to"), F.col("own").alias("g"), *[F.col(f"f{i}").alias(f"g{i}") for i in range(FOLDED)])
    other = (F.col("own") != F.col("g")) & can("m", "to") & ((F.col("own") == F.col("main")) | (F.col("row") < F.col("r")))
    lacks = lambda p, q: reduce(lambda c, d: c + d, [F.bit_count(F.col(f"{p}{i}").bitwiseAND(F.bitwise_not(f"{q}{i}"))) for i in range(FOLDED)])
    n, n_to = F.shiftright("m", 32), F.shiftright("to", 32)
    fits = F.least(n - lacks("f", "g"), n_to - lacks("g", "f")) * (1 + least) >= least * (n + n_to) - 1e-6
    open_ = stored(x.join(named_open, "key").where(other & fits).select(F.least("row", "r").alias("a"), F.greatest("row", "r").alias("b")).distinct(), "open-pairs")
    likely = _likely(open_, marked, least)
    forget(named, keys_open, named_open, open_, marked)
    links, comp = _compared(likely, rows, words, least, links, comp)
    forget(likely)

    # rows that are alone in their group are what they are; only the others travel
    of = nodes.join(comp, F.col("rep") == F.col("node"), "left").where("rows > 1 or component is not null").select("digest", F.coalesce("component", "rep").alias("group"))
    grouped = stored(of_text.join(of, "digest").select("row", "group", "doc_id"), "near-rows-grouped")
    best = grouped.groupBy("group").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("stays"))
    found = stored(grouped.join(best, "group").select("row", F.col("component_id").alias("least_id"), (F.col("row") == F.col("stays")).alias("first")), "near-found")
    forget(of_text, nodes, comp, grouped)
    out = rows.join(_small(found), "row", "left")
    return out.select("doc_id", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"), F.coalesce("first", F.lit(True)).alias("stays"), *[F.col(f"k_{c}").alias(c) for c in keep if c != "doc_id"])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"), 3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
