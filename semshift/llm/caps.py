"""Embedding near-duplicates by spherical-cap filters.

Filter directions are a random product code: the space, after a random rotation, is cut into blocks, each with its own
code of random unit vectors; a direction joins one code vector of each block. A vector belongs to every filter whose
direction exceeds its cap height, the height that `lists` directions reach (one height for all leaves many vectors of a
structured code without any filter). Their number grows with the table, as the same number of ever more directions would share ever
fewer. List decoding meets the best partial sums of the two halves of the blocks, so few directions are touched. Vectors meet on
common filters; each pair is compared in double precision and counted in the least filter that both have, so no list of
pairs has to be made distinct. Measured recall: 0.993 at cosine 0.905, 1.0 above 0.97.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .graph import components

#: Blocks of the product code.
BLOCKS = 4
#: Vectors of one filter that are compared as one block; more are cut into several, compared two by two.
BLOCK = 512


def lists(n: int) -> int:
    """Filters that each of n vectors belongs to."""
    return max(32, math.ceil(48 * (n / 50000) ** 0.2))


class Code:
    """A product code for n vectors: about as many filters as vectors, so one filter has about as many vectors as a vector has filters."""

    def __init__(self, dim: int, n: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.dim, self.m = dim, BLOCKS
        width = -(-dim // self.m)
        self.size = max(2, math.ceil(max(1, n) ** (1 / self.m)))
        self.lists = min(lists(n), self.size**self.m)
        self.rotation = np.linalg.qr(rng.standard_normal((width * self.m, width * self.m)))[0][:, :dim]
        c = rng.standard_normal((self.m, self.size, width))
        self.codes = c / np.linalg.norm(c, axis=2, keepdims=True) / math.sqrt(self.m)

    def partial(self, rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = np.einsum("nmw,mcw->nmc", rotated.reshape(len(rotated), self.m, -1), self.codes)
        return tuple((p[:, i, :, None] + p[:, i + 1, None, :]).reshape(len(p), -1) for i in (0, 2))

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """For each vector the ids of its `lists` best filters, in ascending order.

        Of two halves in falling order the i-th and j-th make one of the best k sums only if (i + 1) * (j + 1) <= k.
        """
        out = []
        k = self.lists
        m = min(k, self.size**2)
        i, j = np.array([(i, j) for i in range(m) for j in range(min(m, k // (i + 1)))]).T
        for at in range(0, len(unit), 512):
            halves = self.partial(unit[at : at + 512] @ self.rotation.T)
            tops = [np.argpartition(-h, m - 1, axis=1)[:, :m] for h in halves]
            tops = [np.take_along_axis(t, np.argsort(-np.take_along_axis(h, t, 1), axis=1, kind="stable"), 1) for h, t in zip(halves, tops, strict=True)]
            a, b = (np.take_along_axis(h, t, 1) for h, t in zip(halves, tops, strict=True))
            best = np.argsort(-(a[:, i] + b[:, j]), axis=1, kind="stable")[:, :k]
            ids = np.take_along_axis(tops[0], i[best], 1) * np.int64(self.size**2) + np.take_along_axis(tops[1], j[best], 1)
            out.append(np.sort(ids, axis=1))
        return np.concatenate(out) if out else np.zeros((0, k), np.int64)


def _units(column: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(v: F.Column) -> F.Column:
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return v.isNotNull() & F.coalesce(good, F.lit(False))


#: Filters of vectors of the k-th length are numbered from k * SPAN on.
SPAN = 1 << 44


def _pairs(least: float, dims: list[int]):
    """Within each (filter, block pair), rows sorted: vectors of the left block, then of the right one."""

    def block(f: int, x: dict) -> tuple[np.ndarray, np.ndarray]:
        side = x["side"]
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = not len(r)
        r = l if same else r
        i, j = np.nonzero(x["unit"][l] @ x["unit"][r].T >= least)
        i, j = l[i], r[j]
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):  # only pairs that have no common filter below this one
            lists = x["lists"]
            lower = [p[: np.searchsorted(p, f)] for p in lists]
            all_f, inv = np.unique(np.concatenate(lower), return_inverse=True) if lower else (np.zeros(0), np.zeros(0, int))
            has = np.zeros((len(lists), len(all_f)), np.float32)
            has[np.repeat(np.arange(len(lists)), [len(p) for p in lower]), inv] = 1
            new = np.concatenate([(has[i[k : k + 65536]] * has[j[k : k + 65536]]).sum(1) == 0 for k in range(0, len(i), 65536)])
            i, j = i[new], j[new]
        return i, j

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            rep, n, side = t["rep"].to_numpy(), t["n"].to_numpy(), t["side"].to_numpy()
            lists = t["filters"].combine_chunks()
            off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            x = {"side": side, "unit": _units(t["v"].combine_chunks(), dims[at[0] // SPAN]), "lists": [flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]}
            i, j = block(at[0], x)
            if not len(i):
                return
            # counts for both ends; of the links a spanning forest of the block is enough
            ends = np.concatenate([i, j])
            cnt = np.bincount(ends, np.concatenate([n[j], n[i]]), minlength=len(rep)).astype(np.int64)
            root = _forest(len(rep), i, j)
            hit = np.flatnonzero(cnt)
            yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(cnt[hit]), pa.array(rep[root[hit]])], ["rep", "links", "root"])

        for b in parts:
            f, l, r = (b.column(k).to_numpy() for k in range(3))
            cut = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (l[1:] != l[:-1]) | (r[1:] != r[:-1])]) if len(f) else np.zeros(0, int)
            for a, z in zip(cut, [*cut[1:], len(f)], strict=False):
                k = (int(f[a]), int(l[a]), int(r[a]))
                if at is not None and k != at and held:
                    yield from flush()
                    held = []
                at = k
                held.append(b.slice(a, z - a))
        if held:
            yield from flush()

    return run


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node it reaches over the links."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(vectors: DataFrame, least: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors that are null, zero, or hold null or non-finite components link with nothing. Vectors of each length have a
    code of their own and link among themselves. Equal vectors are one node with a count. Empty tables give no rows.
    """
    kind = "array<float>" if dict(vectors.dtypes)[embedding] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast(kind).alias("v"))
    rows = rows.withColumn("v", F.when(_usable(F.col("v")), F.col("v")))
    nodes = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    nodes = stored(nodes, "cap-nodes")
    found = nodes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy("d").collect()  # lengths, not vectors
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dims, counts = [r["d"] for r in found], {r["d"]: r["c"] for r in found}

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Code] = {}
        for b in parts:
            size = np.diff(b.column(0).offsets.to_numpy())
            for d in np.unique(size):
                d = int(d)
                if d not in codes:
                    codes[d] = Code(d, counts[d])
                own = b.filter(pa.array(size == d))
                lists = codes[d].decode(_units(own.column(0), d)) + dims.index(d) * SPAN
                f = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * lists.shape[1], pa.int32()), pa.array(lists.ravel()))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), f], ["v", "rep", "n", "filters"])

    marked = stored(nodes.repartition("rep").mapInArrow(decode, f"v {kind}, rep long, n long, filters array<long>"), "cap-filters")
    at = marked.select("rep", F.explode("filters").alias("f"))
    sizes = stored(at.groupBy("f").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "cap-sizes")
    # a crowded filter is cut into blocks by hash; each pair of blocks is a unit of work of its own
    at = at.join(sizes, "f").withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("k", F.pmod(F.xxhash64("rep", "f"), F.col("blocks")).cast("int"))
    units = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("k", o).alias("l"), F.greatest("k", o).alias("r"), (F.col("k") > o).cast("int").alias("side")))
    at = at.select("rep", "f", F.explode(units).alias("u")).select("rep", "f", "u.*")
    # of a vector's filters only those below this one are asked for
    work = at.join(marked, "rep").select("f", "l", "r", "side", "rep", "n", "v", F.filter("filters", lambda x: x < F.col("f")).alias("filters"))
    work = work.repartition("f", "l", "r").sortWithinPartitions("f", "l", "r")
    found = stored(work.mapInArrow(_pairs(least, dims), "rep long, links long, root long"), "cap-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found, "rep", "root")
    of = nodes.join(links, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    of = of.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(of, "v", "left")
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), (F.col("vec_id") == comp_id).alias("kept"))


def op10_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
