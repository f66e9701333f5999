"""Vector codes against brute force in int64."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from semshift.llm import codes


def brute(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector) of kept vectors. Codes, errors and codebooks by the plain way."""
    rows = sorted(rows)
    x = [[int(np.floor(256 * np.float64(c))) for c in v] for _, v in rows]
    w = len(x[0]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[list(cut(v, p)) for v in x[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    near = lambda v, p: min((dist(cut(v, p), e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [[] for _ in books[p]]
            for v in x:
                own[near(v, p)[1]].append(cut(v, p))
            new.append([[sum(c) // len(o) for c in zip(*o, strict=True)] if o else e for o, e in zip(own, books[p], strict=True)])
        books = new
    best = [[near(v, p) for p in range(parts)] for v in x]
    sha = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    return {i: ("".join(f"{e:02x}" for _, e in b), sum(d for d, _ in b)) for (i, _), b in zip(rows, best, strict=True)}, sha


def test_nearest_is_exact_for_ties_and_large_numbers():
    rng = np.random.default_rng(3)
    for top in (2, 300, 1 << 20, codes.most(4) - 1):
        c = rng.integers(-top, top + 1, (64, 4))
        c[40:] = c[:24]  # equal entries: the first wins
        x = np.concatenate([rng.integers(-top, top + 1, (3000, 4)), (c[rng.integers(0, 64, 3000)] + c[rng.integers(0, 64, 3000)]) // 2])  # between two entries
        i, d = codes.nearest(x, c)
        full = ((x[:, None, :] - c[None]) ** 2).sum(2)
        assert (i == full.argmin(1)).all() and (d == full.min(1)).all()


def test_codes_like_brute_force(spark):
    rng = np.random.default_rng(5)
    v = (rng.standard_normal((150, 32)) / 2).round(2)
    v[60:90] = v[:30]  # repeated vectors
    v[100:120, :8] = 0
    rows = [(i * 3 % 151, v[i].tolist(), i % 4 if i % 5 else None) for i in range(150)]
    odd = [(900, None, 1), (901, [1.0] * 31 + [None], 1), (902, [float("nan")] * 32, 2), (903, [float("inf")] + [0.0] * 31, 2)]
    other = [(910, [], 0), (911, [1.0] * 16, 0), (912, [1e30] + [0.0] * 31, 0)]
    df = spark.createDataFrame(rows + odd + other, "vec_id long, embedding array<double>, label int").withColumns({"Code": F.lit("x"), "ERROR": F.lit(1), "part": F.lit(2)}).repartition(5)
    got, books = codes.compress(df)
    out = {r.vec_id: r for r in codes.with_label_error(codes.stored(got, "t")).collect()}
    want, sha = brute([r[:2] for r in rows])
    assert codes.digest(books) == sha and set(out) == set(want) | {910, 911, 912}
    for i, (code, error) in want.items():
        assert (out[i].code.hex(), out[i].error) == (code, error)
    for label in (None, 0, 1, 2, 3):
        assert {r.label_error for r in out.values() if r.label == label} == {sum(want[i][1] for i, _, l in rows if l == label)}
    assert all(out[i].code is None and out[i].error is None for i in (910, 911, 912))
    back = {r.vec_id: r.decoded for r in codes.decode(got, books).collect()}
    w = books.shape[2]
    assert back[0] == [c for p, e in enumerate(bytes.fromhex(want[0][0])) for c in books[p, e].tolist()] and len(back[0]) == 16 * w and back[910] is None


def test_salted_labels_and_few_vectors(spark, monkeypatch):
    monkeypatch.setattr(codes, "FEW", 0)
    rows = [(i % 4 if i < 8 else None, [float(i), -i / 3] * 8, None if i % 2 else 7) for i in range(10)]  # repeated and null ids
    got, books = codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    out = codes.with_label_error(codes.stored(got, "t")).collect()
    assert len(out) == 10 and books.shape == (16, 10, 1) and all(r.error == 0 == r.label_error for r in out)
    nothing, books = codes.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert nothing.count() == 0 and books.size == 0 and codes.digest(books) == hashlib.sha256(b"").hexdigest()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.vec_id: r for r in codes.op12_codes(spark, sf).collect()}
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, sha = brute(rows)
    assert {i: (r.code, r.error) for i, r in got.items()} == want and {r.codebooks_sha256 for r in got.values()} == {sha}
