"""Vector code compression: product codes whose nearest entries are found by float32 matrix products, without a doubt left.

A component x becomes the integer floor(256 * x). For each part of a block of vectors one float32 product with the part's
codebook gives |c|^2 - 2 x.c, which differs from the squared distance by |x|^2 alone, for all entries. Each figure has an
interval that holds the true one whatever the order of the product's additions: of w terms, with both factors rounded to
float32, a sum is off by at most g(w + 2) * |x| * |c|, where g(n) = n u / (1 - n u) and u = 2^-24. An entry whose interval
ends above the least upper end can't be nearest. What is left, mostly one entry, is computed again in int64; of equal distances the
lowest index wins.

Codebooks are fitted by rounds over all vectors: every task adds up its vectors by part and entry, so that a task sends
parts x entries rows whatever it reads, and codebooks go to tasks by value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Half a unit in the last place of 1 in float32; vectors screened at once.
U, BLOCK = 2.0**-24, 4096


def _usable(v: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def most(dim: int) -> int:
    """The largest magnitude of an integer component for which all distances of `dim` components fit in a long."""
    return int((2.0**62 / max(1, dim)) ** 0.5 / 2)


def integers(v: np.ndarray) -> np.ndarray:
    """floor(256 * x); float64 holds 256 * x exactly."""
    return np.floor(v.astype(np.float64) * 256).astype(np.int64)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x (integers) the index of the nearest row of c and its squared distance, exact; ties to the lower index."""
    n, w = x.shape
    out, dist = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return out, dist
    cf = c.astype(np.float64)
    c2 = (cf * cf).sum(1)
    length = np.sqrt(c2)
    g = (w + 2) * U / (1 - (w + 2) * U)
    c32 = c.astype(np.float32).T
    for at in range(0, n, BLOCK):
        b = x[at : at + BLOCK]
        bf = b.astype(np.float64)
        both = np.sqrt((bf * bf).sum(1))[:, None] * length[None, :]
        score = c2[None, :] - 2.0 * (b.astype(np.float32) @ c32).astype(np.float64)
        # float64 steps have errors of their own, some 2^-50 of the terms: the second summand holds them by far
        slack = 2.02 * g * both + 2.0**-46 * (c2[None, :] + 2 * both)
        row, entry = np.nonzero(score - slack <= (score + slack).min(axis=1, keepdims=True))
        diff = b[row] - c[entry]
        d = (diff * diff).sum(1)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])  # every row has an entry left
        low = np.minimum.reduceat(d, first)
        hit = np.flatnonzero(d == low[row])
        hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]
        out[at : at + BLOCK], dist[at : at + BLOCK] = entry[hit], d[hit]
    return out, dist


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return integers(np.asarray(column.flatten()).reshape(-1, dim))


def _sums(books: np.ndarray):
    """(part, entry, n, total): over a task's vectors, those of each part that are nearest to each entry."""
    parts, k, w = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, w), np.int64)
        for b in batches:
            x = _matrix(b.column(0), parts * w)
            for p in range(parts):
                own = x[:, p * w : (p + 1) * w]
                i, _ = nearest(own, books[p])
                n[p] += np.bincount(i, minlength=k)
                np.add.at(total[p], i, own)
        p, e = np.nonzero(n)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * w, pa.int32()), pa.array(total[p, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), flat], ["part", "entry", "n", "total"])

    return run


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, vec_id: str = "vec_id", embedding: str = "embedding") -> np.ndarray:
    """Codebooks (part, entry, position) of integers: those of the vectors with the `entries` least ids (fewer if there are
    fewer; ties by the vectors themselves, null ids last), after so many rounds over all vectors. All vectors have one
    length, which `parts` divides, as `kept` leaves them."""
    v = F.col(embedding)
    seeds = vectors.orderBy(F.col(vec_id).asc_nulls_last(), v).limit(entries).select(v.alias("v")).collect()  # `entries` vectors at most
    if not seeds:
        return np.zeros((parts, 0, 0), np.int64)
    x = integers(np.array([r["v"] for r in seeds], np.float64))
    books = np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))
    w = books.shape[2]
    for _ in range(rounds):
        found = vectors.select(v).mapInArrow(_sums(books), "part int, entry int, n long, total array<long>")
        each = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(w)]
        books = books.copy()
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():  # parts x entries rows at most
            books[r["part"], r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(w)]
    return books


def encode(vectors: DataFrame, books: np.ndarray, embedding: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """The vectors' other columns, with their code (binary, an entry's index for each part) and squared distance to what it stands for."""
    parts, _, w = books.shape
    names = [c for c in vectors.columns if c not in (embedding, code, error)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0), parts * w)
            codes, far = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                i, d = nearest(x[:, p * w : (p + 1) * w], books[p])
                codes[:, p] = i
                far += d
            flat = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(1 + i) for i in range(len(names))], flat, pa.array(far)], [*names, code, error])

    types = dict(vectors.dtypes)
    schema = ", ".join([*[f"`{n}` {types[n]}" for n in names], f"`{code}` binary, `{error}` long"])
    return vectors.select(embedding, *names).mapInArrow(run, schema)


def decode(codes: DataFrame, books: np.ndarray, code: str = "code") -> DataFrame:
    """The codes' rows with `decoded`: the integers that a code stands for, or null where it is."""
    flat = F.lit([[e.tolist() for e in p] for p in books]) if books.size else None
    if flat is None:
        return codes.withColumn("decoded", F.lit(None).cast("array<bigint>"))
    part = F.sequence(F.lit(0), F.lit(len(books) - 1))
    at = lambda p: F.conv(F.hex(F.substring(code, p + 1, 1)), 16, 10).cast("int")
    return codes.withColumn("decoded", F.when(F.col(code).isNotNull(), F.flatten(F.transform(part, lambda p: F.element_at(F.element_at(flat, p + 1), at(p) + 1)))))


def kept(vectors: DataFrame, parts: int = 16, embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(vectors to fit on and to encode, other vectors that have no null or non-finite component).

    The first have the commonest length that `parts` divides (of equally common ones the least, never 0) and no component
    so large that a distance leaves the range of a long; the others can't be encoded.
    """
    v = F.col(embedding)
    usable = vectors.where(_usable(v))
    sizes = usable.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n")).where((F.col("d") > 0) & (F.col("d") % parts == 0))
    first = sizes.orderBy(F.desc("n"), "d").limit(1).collect()
    if not first:
        return usable.limit(0), usable
    dim = first[0]["d"]
    fits = (F.size(v) == dim) & F.forall(v, lambda x: F.abs(x.cast("double") * 256) < most(dim) - 1)
    return usable.where(fits), usable.where(~fits)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


#: Labels whose sums are broadcast; beyond it they are joined by label and one of SALTS salts, as a label may be hot.
FEW, SALTS = 100_000, 32


def with_label_error(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows (stored, with `error`) and label_error: the sum of error over equal labels, null labels together; null if it leaves the range of a long."""
    sums = stored(rows.groupBy(F.col(label).alias("__label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")), "code-labels")
    if sums.count() <= FEW:
        return rows.join(F.broadcast(sums), F.col(label).eqNullSafe(F.col("__label")), "left").drop("__label")
    salted = sums.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = rows.withColumn("__s", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return own.join(salted, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__s") == F.col("__salt")), "left").drop("__label", "__salt", "__s")


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of every vector that has no null or non-finite component, codebooks).

    Vectors of another length than the commonest, or with components beyond `most`, have a null code and error and take
    no part in codebooks. Null and repeated ids are rows like others; an empty table has empty codebooks. Other columns of the table,
    whatever their names, aren't read. `entries` is at most 256, as an index is a byte.
    """
    if not 0 < entries <= 256:
        raise ValueError("from 1 to 256 entries")
    own = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    fine, rest = kept(own, parts)
    books = fit(fine, parts, entries, rounds)
    none = rest.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    return (encode(fine, books).unionByName(none) if books.size else none), books


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compress(table(spark, sf_dir, "embeddings"))
    out = with_label_error(stored(rows, "codes"))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
