"""Empty tables, missing labels, mixed lengths, odd files; and what laws alone don't show: rates against another solver, treaps against sorted lists."""

import bisect
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from semshift.llm import caps, common, images, mixing, pieces, quality, records, shards, simhash, substring, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def test_empty_tables(spark, none, tmp_path):
    import public_tokenizers

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert shards.assign_shards(none, 8).count() == mixing.mix(none).count() == simhash.near_groups(none).count() == simhash.near_copies(none).count() == substring.remove_repeats(none).count() == 0
    manifest = records.write_records(none, f"file://{tmp_path}/rec", public_tokenizers.path("word_bpe_49k.json"), 2)
    assert records.read_records(manifest, f"file://{tmp_path}/rec").count() == 0
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert pieces.encode(none, path).count() == pieces.decode(pieces.encode(none, path), path).count() == 0
    assert toxicity.score(none, *toxicity.fit(none, labels)).count() == 0
    assert quality.score(none, *quality.fit(none, labels)).count() == 0
    assert caps.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    nothing = spark.createDataFrame([], "image_id long, image binary")
    assert images.find_copies(nothing, nothing).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["__score"] for r in toxicity.score(docs, *toxicity.fit(docs, labels)).collect()} == {0.5}
    assert {r.score for r in quality.score(docs, *quality.fit(docs, labels)).collect()} == {0.5}


def test_repeated_ids_do_not_swell_a_sample(spark):
    from semshift.llm.labelled import sample

    docs = spark.createDataFrame([(i % 10, f"text {i}") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    got = sample(docs, labels, "toxic", 3, 1, 100).collect()
    assert len(got) <= 10 and {r.label for r in got} == {0, 1}
    few = sample(docs, labels, "toxic", 3, 1, 100, most_bytes=128).collect()
    assert len(few) == len(got) and all(len(r.t) <= 2 for r in few)


def test_one_long_text_keeps_no_other_out_of_a_sample(spark):
    """Its class has as many documents as before, whatever its place in hash order; a model fitted on it still tells the classes apart."""
    from semshift.llm.labelled import MOST_BYTES, SHARE, sample

    rows = [(i, ("you vile rotten fool " if i % 2 else "calm kind gentle friend ") * 3 + str(i)) for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    base = sample(docs, labels, "toxic", 3, 1, 1000)
    least = base.where("label = 1").orderBy("u").count()
    first = labels.where("toxic = 1 and pmod(crc32(cast(doc_id as string)), 3) <> 1").orderBy(F.xxhash64("doc_id", F.lit(5))).first().doc_id
    long = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("you vile rotten fool "), 17 * 50_000)).otherwise(F.col("text")))
    got = sample(long, labels, "toxic", 3, 1, 1000).collect()
    assert sum(r.label for r in got) == least and max(len(r.t) for r in got) == MOST_BYTES // SHARE
    scores = toxicity.score(docs, *toxicity.fit(long, labels)).collect()
    assert all((r["__score"] >= 0.5) == bool(r.doc_id % 2) for r in scores)


def test_score_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "mine")], "doc_id long, text string, __Score string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    r = toxicity.score(docs, *toxicity.fit(docs, labels)).collect()[0]
    assert r["__Score_in"] == "mine" and r["__score"] == 0.5


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((2, 30, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(a)] + [(100, [1.0, 0.01]), (101, [1.0, 0.0]), (102, [0.0, 1.0]), (200, (a[0] * 3).tolist()), (300, [5.0])]
    got = {r.vec_id: r for r in caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert (got[100].n_links, got[101].n_links, got[102].n_links) == (1, 1, 0) and got[101].component_id == 100
    assert got[200].component_id == 0 and got[200].n_links == 1 and got[300].n_links == 0


def test_rates_against_another_solver(spark):
    rng = np.random.default_rng(7)
    rows = [(s, int(z), int(n)) for s in ("a", "b", None) for z, n in zip(rng.choice(500, 40, replace=False), rng.integers(1, 50, 40), strict=True)]
    hist = spark.createDataFrame(rows, "source string, size long, n long")
    goal = mixing.targets(hist, (5, 2, 1), 1.5)
    want = {r.source: r.target for r in goal.collect()}
    dual = mixing.solve(hist, common.stored(goal, "goal"))
    lam = {r.source: (r.lam, r.mean) for r in dual.collect()}
    got = {(r.source, r["size"]): r.k for r in mixing.copies(hist, dual).collect()}
    for s, target in want.items():
        z, n = (np.array([r[k] for r in rows if r[0] == s], float) for k in (1, 2))
        x = z / (z @ n / n.sum())
        if target >= 2 * (z @ n) * (1 - 1e-6):
            assert all(got[(s, int(a))] == 2 * b for a, b in zip(z, n, strict=True) if a)
            continue
        rate = lambda l: 2 / (1 + np.exp(-l * x))  # noqa: B023, E731, E741
        lo, hi = -60.0, 60.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (n * z) @ rate(mid) < target else (lo, mid)  # noqa: B023
        assert lam[s][0] == pytest.approx(mid, abs=1e-6)
        order = np.argsort(z)
        k = np.array([got[(s, int(v))] for v in z[order]])
        assert np.abs(np.cumsum(k) - np.cumsum((n * rate(mid))[order])).max() <= 1 + 1e-6  # any run of sizes gets its rates


def test_short_documents_keep_their_rates(spark):
    """Sources of short and long documents below their limits: rounding leaves the short ones' rates alone."""
    sources = "aaaaabbc"
    rows = [(i, " ".join(["w"] * (1 + i % 2)) if i % 4 < 2 else " ".join(["w"] * (3200 + i)), sources[i // 4 % 8]) for i in range(960)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "ab":
        assert {r.target < 1.9 * r.source_size for r in out if r.source == s} == {True}
        short = [r.copies for r in out if r.source == s and r["size"] < 5]
        assert 0.9 <= np.mean(short) <= 1.1


def test_treap_is_a_sorted_list():
    rng = np.random.default_rng(2)
    bins, plain = shards._Bins(), []
    for step in range(4000):
        if rng.random() < 0.6 or not plain:
            item = (int(rng.integers(0, 200)), step)
            bins.put(item)
            bisect.insort(plain, item)
        else:
            room = int(rng.integers(0, 220))
            i = bisect.bisect_left(plain, (room, -1))
            assert bins.take(room) == (plain.pop(i) if i < len(plain) else None)


def png(pixels: np.ndarray, filters: list[int]) -> bytes:
    h, w, c = pixels.shape
    x = pixels.astype(int)
    lines = b""
    for y in range(h):
        f = filters[y % len(filters)]
        left = np.vstack([np.zeros((1, c), int), x[y, :-1]])
        up = x[y - 1] if y else np.zeros((w, c), int)
        corner = np.vstack([np.zeros((1, c), int), up[:-1]])
        p = left + up - corner
        d = [np.abs(p - v) for v in (left, up, corner)]
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
        guess = [0, left, up, (left + up) // 2, paeth][f]
        lines += bytes([f]) + ((x[y] - guess) & 255).astype(np.uint8).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[c]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_image_files():
    rng = np.random.default_rng(3)
    grey = rng.integers(0, 256, (7, 5), np.uint8)
    for head in (b"P5\n5 7\n255\n", b"P5 5 7 255 ", b"P5\n# a comment\n5\n# another 9 9\n7 255\n"):
        assert (images.decode(head + grey.tobytes()) == grey).all()
    assert (images.decode(images.encode_pgm(grey)) == grey).all()
    for c in (1, 2, 3, 4):
        p = rng.integers(0, 256, (9, 6, c), np.uint8)
        got = images.decode(png(p, [0, 1, 2, 3, 4]))
        want = p[:, :, :3] @ np.array([0.299, 0.587, 0.114]) if c >= 3 else p[:, :, 0]
        assert np.allclose(got, want, atol=1e-3)
    for bad in (None, b"", b"P5", b"P5\n5 7\n255\nxx", b"P5\n0 0\n255\n", b"\x89PNG\r\n\x1a\n", b"\x89PNG\r\n\x1a\njunkjunkjunkjunk", b"GIF89a", png(p, [0])[:60], b"P5\n5 7\n65535\n" + bytes(70)):
        assert images.decode(bad) is None
    assert len(images.describe(np.zeros((2, 8, 8)))["y"]) == 0 and len(images.describe(np.full((1, 90, 90), 7.0))["y"]) == 0


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_records_tokens_are_the_library_s(spark, tmp_path):
    """Every document of the middle tables, and texts of random code points."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rng = np.random.default_rng(4)
    odd = ["".join(chr(int(c)) for c in rng.choice(np.r_[32:127, 0xA0:0x250, 0x300:0x370, 0x400:0x460, 0x2000:0x2070, 0x3040:0x3100, 0x4E00:0x4F00, 0x1F600:0x1F640, 9, 10, 13, 0x85, 0x130, 0x1E9E], 60)) for _ in range(300)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text or "" for r in docs} | {10**9 + i: t for i, t in enumerate(odd)}
    manifest = records.write_records(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), f"file://{tmp_path}/rec", path, 2)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in records.read_records(manifest, f"file://{tmp_path}/rec").collect()}
    for i, t in texts.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(t[:80])


@pytest.mark.parametrize("stage", ["drop_toxic", "drop_near_copies", "cut_repeats", "mix_sources", "tokenize"])
def test_stages_of_an_empty_table(spark, none, stage):
    import corpus_pipeline

    assert getattr(corpus_pipeline, stage)(spark, none, "/root/testdata/sf0.001").count() == 0


def test_stage_toxicity_keeps_rows(spark):
    """Nulls, repeated rows and long texts pass; what the models reject goes, whatever its id."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    toxic = [r.text for r in docs.collect() if labels.get(r.doc_id) == 1][:5]
    more = [(None, None, None, None, None), (None, "", "en", "s", 0), (7, "a quiet line", "en", "s", 12), (7, "a quiet line", "en", "s", 12), *[(None, t, "en", "s", len(t)) for t in toxic]]
    out = corpus_pipeline.drop_toxic(spark, docs.unionByName(spark.createDataFrame(more, DOC)), sf).collect()
    assert sum(r.text == "a quiet line" for r in out) == 2 and sum(r.text is None for r in out) >= 1
    assert not [r for r in out if r.doc_id is None and r.text in toxic]
    clean = [i for i, v in labels.items() if v == 0]
    assert len({r.doc_id for r in out} & set(clean)) >= 0.98 * len(clean)
