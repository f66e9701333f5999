"""Toxicity by class-conditional Kneser-Ney models of words' bytes.

Two models, of toxic and of ordinary documents, give each byte of a word from the four before it. Their counts come from
a bounded sample of labelled documents. Both back off to one shared model, whose trigram and continuation counts cover
all documents, so that what a class has hardly seen costs both alike. A document is compared by length-normalised
log-likelihood ratios: of all its words, of its best stretch of eight words, and of its two best words; a logistic
curve, fitted on sample documents that the models haven't seen, makes one score of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_free, stored, table
from .labelled import held_out, sample
from .wordgrid import Grid, gathered

#: Documents of each class that are sampled; bytes of an n-gram; words of a stretch; discount.
PER_CLASS, ORDER, STRETCH, DISCOUNT = 4000, 5, 8, 0.75
_FIRST, _LAST = 1, 2  # stand for a word's ends; no word holds these bytes' roles
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The distinct words of a batch, lower-cased, as bytes with their ends marked."""

    def __init__(self, texts: pa.Array) -> None:
        self.grid = Grid(texts)
        self.grid.data = _LOWER[self.grid.data]
        self.keys, first, self.of = np.unique(self.grid.hashes(), return_index=True, return_inverse=True)
        start, end = self.grid.starts[first], self.grid.ends[first]
        length = end - start + 1  # and the end mark
        self.word = np.repeat(np.arange(len(first)), length)
        self.at = np.cumsum(length) - length
        inside = np.arange(int(length.sum())) - np.repeat(self.at, length)
        data = np.append(self.grid.data, np.uint8(0))
        codes = data[np.minimum(np.repeat(start, length) + inside, len(data) - 1)].astype(np.uint64)
        codes[self.at + length - 1] = _LAST
        self.codes = codes
        before = np.full(len(codes) + ORDER - 1, _FIRST, np.uint64)
        before[ORDER - 1 :] = codes
        gram = codes.copy()
        for k in range(1, ORDER):
            prev = before[ORDER - 1 - k : len(before) - k]
            gram |= np.where(inside >= k, prev, np.uint64(_FIRST)) << np.uint64(8 * k)
        self.gram = gram  # the last byte lowest


def _counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte trigrams of all words with their counts; there are at most 2^24."""
    for b in gathered(parts):
        w = Words(b.column(0).cast(pa.large_binary()))
        if not len(w.codes):
            continue
        times = np.bincount(w.of, minlength=len(w.keys))[w.word]
        tri, inv = np.unique((w.gram & np.uint64(0xFFFFFF)).astype(np.int32), return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(tri), pa.array(np.bincount(inv, times).astype(np.int64))], ["tri", "n"])


class Shared:
    """Interpolated Kneser-Ney trigrams of bytes over the corpus."""

    def __init__(self, tri: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(tri)
        self.tri, self.n = tri[order].astype(np.int64), n[order].astype(np.float64)
        ctx = self.tri >> 8
        self.ctx, inv = np.unique(ctx, return_inverse=True)
        self.total, self.types = np.bincount(inv, self.n), np.bincount(inv).astype(float)
        bi, cont = np.unique(self.tri & 0xFFFF, return_counts=True)  # continuation counts: distinct bytes before
        self.bi, self.bi_n = bi, cont.astype(float)
        self.mid, inv = np.unique(bi >> 8, return_inverse=True)
        self.mid_total, self.mid_types = np.bincount(inv, self.bi_n), np.bincount(inv).astype(float)
        uni, cont = np.unique(bi & 0xFF, return_counts=True)
        self.uni = np.full(256, 0.5)
        self.uni[uni] += cont
        self.uni /= self.uni.sum()

    @staticmethod
    def _get(keys: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(x))
        i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return np.where(keys[i] == x, values[i], 0.0)

    def __call__(self, tri: np.ndarray) -> np.ndarray:
        tri = tri.astype(np.int64)
        d = DISCOUNT
        p = self.uni[tri & 0xFF]
        m = (tri >> 8) & 0xFF
        t, k = self._get(self.mid, self.mid_total, m), self._get(self.mid, self.mid_types, m)
        p = np.where(t > 0, (np.maximum(self._get(self.bi, self.bi_n, tri & 0xFFFF) - d, 0) + d * k * p) / np.maximum(t, 1e-9), p)
        t, k = self._get(self.ctx, self.total, tri >> 8), self._get(self.ctx, self.types, tri >> 8)
        return np.where(t > 0, (np.maximum(self._get(self.tri, self.n, tri) - d, 0) + d * k * p) / np.maximum(t, 1e-9), p)


class Ratios:
    """Log-likelihood ratios of n-grams (toxic over ordinary), and of contexts for n-grams that neither class has seen."""

    def __init__(self, shared: Shared, grams: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.gram = np.unique(np.concatenate([g for g, _ in grams]))
        self.ctx = np.unique(self.gram >> np.uint64(8))
        own = np.searchsorted(self.ctx, self.gram >> np.uint64(8))
        base = shared(self.gram & np.uint64(0xFFFFFF))
        self.value, self.back = np.zeros(len(self.gram)), np.zeros(len(self.ctx))
        for sign, (g, n) in zip((-1, 1), grams, strict=True):
            c = np.zeros(len(self.gram))
            c[np.searchsorted(self.gram, g)] = n
            total, types = np.bincount(own, c, len(self.ctx)), np.bincount(own, c > 0, len(self.ctx))
            weight = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
            p = np.maximum(c - DISCOUNT, 0) / np.maximum(total[own], 1) + weight[own] * base
            self.value += sign * np.log(p)
            self.back += sign * np.log(weight)
        self.value, self.back = self.value.astype(np.float32), self.back.astype(np.float32)

    def words(self, w: Words) -> np.ndarray:
        """The ratio of each distinct word."""
        if not len(w.keys):
            return np.zeros(0)
        gram, inv = np.unique(w.gram, return_inverse=True)
        r = np.zeros(len(gram))
        if len(self.gram):
            i = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
            j = np.minimum(np.searchsorted(self.ctx, gram >> np.uint64(8)), len(self.ctx) - 1)
            r = np.where(self.gram[i] == gram, self.value[i], np.where(self.ctx[j] == gram >> np.uint64(8), self.back[j], 0.0))
        return np.add.reduceat(r[inv], w.at)


def features(w: Words, ratios: Ratios) -> np.ndarray:
    """Of each text: mean ratio of its words, of its best stretch, of its best word and of its next best one; 0 where there is none."""
    g = w.grid
    out = np.zeros((g.n, 4))
    s = ratios.words(w)[w.of] if len(w.of) else np.zeros(0)
    full = np.flatnonzero(g.counts)
    if not len(full):
        return out
    at = g.first[full]
    out[full, 0] = np.add.reduceat(s, at) / g.counts[full]
    sums = np.concatenate([[0.0], np.cumsum(s)])
    begin = np.arange(len(s))
    end = np.minimum(begin + STRETCH, g.first[g.text + 1])
    out[full, 1] = np.maximum.reduceat((sums[end] - sums[begin]) / STRETCH, at)
    best = np.maximum.reduceat(s, at)
    out[full, 2] = best
    where = np.flatnonzero(s == np.repeat(best, g.counts[full]))
    where = where[np.unique(g.text[where], return_index=True)[1]]
    rest = s.copy()
    rest[where] = -np.inf
    second = np.maximum.reduceat(rest, at)
    out[full, 3] = np.where(np.isfinite(second), second, 0.0)
    return np.clip(out, -30, 30)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights (the last is the constant), by Newton steps."""
    mid, wide = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.c_[(x - mid) / wide, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * max(1, len(x)) * np.eye(len(w)), z.T @ (p - y) + ridge * max(1, len(x)) * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mid, wide, w


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, label: str = "toxic", per_class: int = PER_CLASS, text: str = "text", doc_id: str = "doc_id") -> tuple[Ratios, tuple]:
    """Ratios and logistic curve. Four in five sample documents give the models' counts, the others fit the curve. Of a labelled text longer than 256 KiB the
    sample takes so much (labelled.sample); scores are of whole texts."""
    t = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    tri = docs.select(t.alias("t")).mapInArrow(_counts, "tri int, n long").groupBy("tri").agg(F.sum("n").alias("n")).toPandas()
    shared = Shared(tri["tri"].to_numpy(), tri["n"].to_numpy())
    rows = stored(sample(docs, labels, label, folds, fold, per_class, text, doc_id), "toxic-sample")

    def grams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(parts):
            y = b.column(0).to_numpy()
            for c in (0, 1):
                w = Words(b.column(1).filter(pa.array(y == c)).cast(pa.large_binary()))
                if len(w.codes):
                    g, inv = np.unique(w.gram, return_inverse=True)
                    n = np.bincount(inv, np.bincount(w.of, minlength=len(w.keys))[w.word])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), c, np.int32)), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["label", "gram", "n"])

    counts = rows.where("u < 800").select("label", "t").mapInArrow(grams, "label int, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n")).toPandas()
    ratios = Ratios(shared, [(d["gram"].to_numpy().view(np.uint64), d["n"].to_numpy()) for d in (counts[counts.label == c] for c in (0, 1))])

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(parts):
            f = features(Words(b.column(1).cast(pa.large_binary())), ratios)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(f[:, i]) for i in range(4))], ["label", "a", "b", "c", "d"])

    x = rows.where("u >= 800").select("label", "t").mapInArrow(measure, "label int, a double, b double, c double, d double").toPandas()
    return ratios, fit_logistic(x[["a", "b", "c", "d"]].to_numpy(), x["label"].to_numpy())


def score(docs: DataFrame, ratios: Ratios, curve: tuple, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (by default all; one called __score gets _in at its end) and __score (0 to 1) for every row. A null text is scored as an empty one."""
    docs = columns_free(docs, "__score")
    mid, wide, weights = curve
    model = docs.sparkSession.sparkContext.broadcast(ratios)  # bounded by the sample
    others = docs.columns if keep is None else keep

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(parts):
            f = features(Words(b.column(b.num_columns - 1).cast(pa.large_binary())), model.value)
            p = 1 / (1 + np.exp(-np.clip(np.c_[(f - mid) / wide, np.ones(len(f))] @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p)], [*b.schema.names[:-1], "__score"])

    t = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], t.alias("__t"))
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others))
    out = rows.mapInArrow(run, (schema + ", " if schema else "") + "__score double")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], F.col("__score"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratios, curve = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs, ratios, curve, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.7).cast("int").alias("predicted"))
