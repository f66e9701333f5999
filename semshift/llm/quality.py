"""Quality by random-indexing word vectors, pooled per document, and a two-layer network.

A word's index vector is the sum of sparse random vectors of its byte trigrams; its context vector is the sum of the
index vectors of its neighbours over all documents, kept for hashed words in a table of fixed size. A document's pool
holds, for each dimension, the mean of its words' vectors, of their squares, and of the products of neighbours. The
network is fitted on a bounded sample of labelled documents; a temperature, fitted on sample documents it hasn't seen,
calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .labelled import held_out, sample
from .toxicity import Words
from .wordgrid import gathered, mixed

#: Documents of each class that are sampled; dimensions of each half of a vector; rows of the tables; hidden units.
PER_CLASS, DIM, TRIGRAMS, BUCKETS, HIDDEN = 6000, 24, 1 << 14, 1 << 15, 32
#: Rows of the context table that travel together; lanes in which the tasks' sums are added up first.
_PART, LANES = 1 << 10, 64


def _index_table(seed: int = 11) -> np.ndarray:
    """Sparse ternary vectors: four entries of each row are 1 or -1."""
    rng = np.random.default_rng(seed)
    t = np.zeros((TRIGRAMS, DIM), np.float32)
    for k in range(4):
        np.put_along_axis(t, rng.integers(0, DIM, (TRIGRAMS, 1)), rng.choice([-1.0, 1.0], (TRIGRAMS, 1)).astype(np.float32), 1)
    return t


_INDEX = _index_table()


def index_vectors(w: Words) -> np.ndarray:
    """Unit index vector of each distinct word."""
    if not len(w.keys):
        return np.zeros((0, DIM), np.float32)
    row = (mixed(w.gram & np.uint64(0xFFFFFF)) >> np.uint64(40)).astype(np.int64) % TRIGRAMS
    v = np.add.reduceat(_INDEX[row], w.at, axis=0)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6)


def _buckets(w: Words) -> np.ndarray:
    return (w.keys >> np.uint64(20)).astype(np.int64) % BUCKETS


def _contexts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's sums of neighbours' index vectors, by parts of the table."""
    sums = np.zeros((BUCKETS, DIM), np.float64)
    for b in gathered(parts):
        w = Words(b.column(0).cast(pa.large_binary()))
        if len(w.of) < 2:
            continue
        x = index_vectors(w)
        text = w.grid.text
        near = np.zeros((len(w.of), DIM), np.float32)
        same = text[1:] == text[:-1]
        v = x[w.of]
        near[1:] += v[:-1] * same[:, None]
        near[:-1] += v[1:] * same[:, None]
        own = _buckets(w)[w.of].astype(np.uint16)
        order = np.argsort(own, kind="stable")
        cut = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]])
        sums[own[order][cut]] += np.add.reduceat(near[order], cut, axis=0)
    for k in range(0, BUCKETS, _PART):
        yield pa.RecordBatch.from_pydict({"part": pa.array([k // _PART], pa.int32()), "sums": pa.array([sums[k : k + _PART].astype("<f8").tobytes()], pa.binary())})


def _added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in parts:
        for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total[k] = total.get(k, 0.0) + np.frombuffer(s, "<f8")
    if total:
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()), "sums": pa.array([v.astype("<f8").tobytes() for v in total.values()], pa.binary())})


def context_table(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit context vectors of the hashed words, over all documents: BUCKETS x DIM numbers, whatever the corpus."""
    t = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    sums = docs.select(t.alias("t")).mapInArrow(_contexts, "part int, sums binary").withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES)))
    sums = sums.repartition("part", "lane").select("part", "sums").mapInArrow(_added, "part int, sums binary")
    got = sums.repartition("part").mapInArrow(_added, "part int, sums binary").collect()
    c = np.zeros((BUCKETS, DIM))
    for r in got:
        c[r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(r["sums"], "<f8").reshape(_PART, DIM)
    return (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-6)).astype(np.float32)


def pools(w: Words, contexts: np.ndarray) -> np.ndarray:
    """Each text's pool; zeros where it has no words."""
    g = w.grid
    out = np.zeros((g.n, 6 * DIM + 1), np.float32)
    full = np.flatnonzero(g.counts)
    if not len(full):
        return out
    distinct = np.concatenate([index_vectors(w), contexts[_buckets(w)]], 1)
    n = g.counts[full].astype(np.float32)[:, None]
    v = distinct[w.of]
    at = g.first[full]
    out[full, : 2 * DIM] = np.add.reduceat(v, at, axis=0) / n
    out[full, 2 * DIM : 4 * DIM] = np.add.reduceat(v * v, at, axis=0) / n
    v[:-1] *= v[1:]
    v[g.first[full + 1] - 1] = 0  # a text's last word has no next one
    out[full, 4 * DIM : 6 * DIM] = np.add.reduceat(v, at, axis=0) / np.maximum(n - 1, 1)
    out[full, -1] = np.log1p(n[:, 0])
    return out


class Network:
    """x -> tanh layer -> logit, trained by Adam on the log loss; then one temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 60, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.mid, self.wide = x.mean(0), x.std(0) + 1e-4
        x = (x - self.mid) / self.wide
        held = np.arange(len(x)) % 5 == 4
        a, b = x[~held], y[~held]
        p = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
        m, s, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for _ in range(epochs):
            order = rng.permutation(len(a))
            for k in range(0, len(a), 128):
                i = order[k : k + 128]
                h = np.tanh(a[i] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - b[i]) / len(i)
                dh = np.outer(d, p[2]) * (1 - h * h)
                grads = [a[i].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
                step += 1
                for q, g, u, v in zip(p, grads, m, s, strict=True):
                    u += 0.1 * (g - u)
                    v += 0.001 * (g * g - v)
                    q -= 0.003 * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        z, t = self.logits(x[held] * self.wide + self.mid), y[held]
        if len(z):
            loss = lambda c: float(np.mean(np.logaddexp(0, z / c) - t * z / c))
            self.temperature = min(np.exp(np.linspace(-1.5, 2.5, 161)), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mid) / self.wide) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, label: str = "quality", per_class: int = PER_CLASS, text: str = "text", doc_id: str = "doc_id") -> tuple[np.ndarray, Network | None]:
    """The context table and the network; none where the sample has no row. Of a labelled text longer than 256 KiB the sample takes
    so much (labelled.sample); the table is of whole texts, and so are scores."""
    contexts = context_table(docs, text)
    own = docs.sparkSession.sparkContext.broadcast(contexts)

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(parts, most=1 << 20):
            x = pools(Words(b.column(2).cast(pa.large_binary())), own.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "u", "x"])

    rows = stored(sample(docs, labels, label, folds, fold, per_class, text, doc_id).mapInArrow(measure, "label int, u int, x binary"), "quality-sample").toPandas()
    if not len(rows):
        return contexts, None
    rows = rows.sort_values(["u", "x"])
    x = np.stack([np.frombuffer(r, np.float32) for r in rows["x"]]).astype(np.float64)
    return contexts, Network(x, rows["label"].to_numpy(np.float64))


def score(docs: DataFrame, contexts: np.ndarray, network: Network | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score for every row; a null text is an empty one. Without a network the score is 0.5."""
    model = docs.sparkSession.sparkContext.broadcast((contexts, network))  # of fixed size

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, net = model.value
        for b in gathered(parts, most=1 << 20):
            p = np.full(b.num_rows, 0.5) if net is None else net(pools(Words(b.column(1).cast(pa.large_binary())), c))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], ["doc_id", "score"])

    t = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("t")).mapInArrow(run, "doc_id long, score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, *fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
