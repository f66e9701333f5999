"""Fill-in-middle against a plain reading of the tokens; chunks' functions against the automaton run step by step."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semshift.llm import middle


def brute(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def random_texts(n, top, seed=1):
    rng = np.random.default_rng(seed)
    parts = ["a", "word", "LongerWord", " ", "\n", "<", ">", "<P", "S>", "<Q>", "é", "日本", "😀", "P", "M>", "0", ".", "<P>", "<M>"]
    weight = np.array([4.0] * 17 + [0.05, 0.05])
    return ["".join(rng.choice(parts, rng.integers(0, top), p=weight / weight.sum())) for _ in range(n)]


def test_functions_of_chunks():
    pieces = [c for t in random_texts(60, 12) for c in middle.chunks_of(t.encode(), 4)] + [b"", b">", b"P", b"P>", b"<", b"ab", b"P<P>"]
    assert all(len(c) <= 4 for c in pieces)
    to, tokens, markers = middle.Scan(pa.array(pieces, pa.binary())).functions()
    for i, c in enumerate(pieces):
        for s in range(4):
            x, t, m = s, 0, 0
            for b in c:
                if not 128 <= b < 192:
                    x, u, v = middle.step(x, int(middle._CLASS[b]))
                    t, m = t + u, m + v
            assert (to[i, s], tokens[i, s], markers[i, s]) == (x, t, m), (c, s)


@pytest.mark.parametrize("chunk", [5, 40, 1 << 16])
def test_like_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(middle, "FAN", 4)
    texts = random_texts(150, 60) + [None, "", "x", "<P>", "a<S", ">b", "P>", "é", "a" * 3000, "日" * 500, "ab " * 400, "x" * 39 + "<M>" + "y" * 50]
    rows = [(i if i % 50 else None, t, "s") for i, t in enumerate(texts)] + [(7, "twice twice <twice> twice", "s")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"N": F.lit("n"), "Part": F.lit("p"), "document": F.lit("d"), "body": F.lit("b"), "block": F.lit(1), "x": F.lit(2), "no": F.lit(3)})
    out = middle.stored(middle.fill_in_middle(docs, chunk=chunk), "t")
    assert {"N_in", "Part_in", "document_in", "body"} <= set(out.columns)

    def gathered(df):
        found = {}
        for r in df.collect():
            found.setdefault((r.doc_id, r.document, r.form), []).append(r)
        return found

    got = []
    for (i, d, form), rs in gathered(out).items():
        if d is None:
            got += [(i, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rs]
        else:
            rs.sort(key=lambda r: (r.section, r.part))
            assert all(len(r.output.encode()) <= chunk for r in rs) and len({(r.n, r.prefix_chars, r.middle_chars, r.N_in) for r in rs}) == 1
            got.append((i, rs[0].n, form, rs[0].prefix_chars, rs[0].middle_chars, "".join(r.output for r in rs)))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted([(i, *brute(i, t)) for i, t, _ in rows], key=key)
    big = out.where("document is not null")
    assert (big.count() > 0) == (chunk < 1 << 16)
    back = {}
    for r in sorted(middle.restored_rows(big).collect(), key=lambda r: (r.document, r.section, r.part)):
        back[r.document] = back.get(r.document, "") + r.output
    small = [r.t for r in out.where("document is null").select(middle.restored(F.col("output"), F.col("form")).alias("t")).collect()]
    assert sorted([*back.values(), *small]) == sorted(t or "" for _, t, _ in rows)
    sums = {r.document: r.h for r in middle.checksums(middle.restored_rows(big), "h").collect()}
    assert sums == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in back.items()}


def test_empty_table_and_query(spark, monkeypatch):
    assert middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    monkeypatch.setattr(middle, "CHUNK", 4000)
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in middle.op13_middle(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        n, form, p, m, out = brute(r.doc_id, r.text)
        g = got[r.doc_id]
        assert (g.n, g.form, g.prefix_chars, g.middle_chars) == (n, form, p, m)
        assert g.output_sha256 == hashlib.sha256(out.encode()).hexdigest() and g.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
