"""Strict spans against the plain expressions; votes, reliabilities and what the classifier adds on planted texts."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from semshift.llm import private

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(t):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and sum(x // 10 + x % 10 for x in double) % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_strict_spans_like_the_expressions():
    rng = np.random.default_rng(2)
    parts = ["a", "b.c", "@", ".", "-", "+", "1", "25", "300", "4111111111111111", "4111 1111 1111 1111", " ", "(", ")", "é", "日本", "x@y.de", "_", "%", "1.2.3.4", "+49 30 1234567", "0", "１"]
    for _ in range(4000):
        t = "".join(rng.choice(parts, rng.integers(1, 14)))
        got = [(private.KINDS[k], a, z) for k, a, z in private.strict(t)[0]]
        assert got == brute(t), t


def test_long_texts_take_linear_time():
    for t in ("9" * 400_000, "a" * 400_000, "a." * 200_000 + "@", "1." * 200_000, "+1" * 200_000, "(1) " * 100_000, " at " * 100_000, "x at y." * 50_000, "1 2-3 " * 60_000, "4111 " * 80_000):
        private.candidates(t)


def corpus(n=400):
    rng = np.random.default_rng(4)
    words = "the quick brown fox went over lazy dogs while rain fell on old stones and nobody spoke again".split()
    said = lambda k: " ".join(rng.choice(words, k))

    def card():
        head = f"4{rng.integers(10**13, 10**14)}"
        return next(head + c for c in "0123456789" if private.luhn(head + c))

    rows, odd = [], {}
    for i in range(n):
        t = said(8)
        k = i % 10
        if k == 0:
            t += f" mail {rng.choice(words)}.{i}@host{i % 7}.example.com"
        elif k == 1:
            t += f" from {rng.integers(21, 255)}.{rng.integers(255)}.{rng.integers(255)}.{rng.integers(255)}"
        elif k == 2:
            t += f" card {card()}"
        elif k == 3:
            t += f" call +1 (555) {rng.integers(200, 999)}-{rng.integers(1000, 9999)}"
        elif k == 4:
            odd[i] = ("email", f"{rng.choice(words)}{i} [at] host{i % 7} [dot] com")
            t += " contact " + odd[i][1]
        elif k == 5:
            odd[i] = ("phone", f"(555) {rng.integers(200, 999)}-{rng.integers(1000, 9999)}")
            t += " phone " + odd[i][1]
        elif k == 6:
            c = card()
            odd[i] = ("card", f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}")
            t += " visa card " + odd[i][1]
        elif k == 7:
            t += f" version {i % 9}.{i % 7}.{i % 300} section {i % 30} and order id {rng.integers(10**12, 10**13)}"
        rows.append((i, t + " " + said(5)))
    return rows, odd


def test_added_spans(spark):
    rows, odd = corpus()
    more = [(1000, None), (1001, ""), (None, "write to a.b@c.de"), (1002, "x" * 100_000), (1003, rows[0][1]), (1003, rows[0][1])]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string").withColumns({"Spans": F.lit("mine"), "kind": F.lit(1)})
    model = private.fit(docs)
    for kind, t in model.tables.items():  # the strict expression is right more often than wrong
        assert t[1, 0, 2] > t[0, 0, 2] and np.allclose(t.sum(2), 1), kind
    out = private.find(docs, model).collect()
    assert len(out) == len(rows) + len(more) and all(r.Spans_in == "mine" for r in out)
    hits = clean = 0
    for r in out:
        base = [(s["kind"], s["start"], s["end"]) for s in r.spans if s["base"]]
        assert base == brute(r.text)
        added = [(s["kind"], r.text[s["start"] : s["end"]]) for s in r.spans if not s["base"]]
        if r.doc_id in odd:
            hits += odd[r.doc_id] in added
        else:
            clean += not added
    assert hits >= 0.9 * len(odd) and clean >= 0.98 * (len(out) - len(odd))
    again = private.fit(docs.repartition(7))
    assert again.probability == model.probability and np.allclose(again.weights, model.weights)
    text = docs.where("doc_id = 0")
    shown = private.find(text, model).select(private.redacted(F.col("text"), F.col("spans")).alias("t")).collect()[0].t
    assert shown == re.sub(PLAIN["email"], "[email]", rows[0][1])


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = private.fit(none)
    assert private.find(none, model).count() == 0
    t = "call (555) 123-4567 or a@b.de"
    r = private.find(spark.createDataFrame([(1, t)], "doc_id long, text string"), model).collect()[0]
    assert [(s["kind"], t[s["start"] : s["end"]]) for s in r.spans] == [("email", "a@b.de")]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in private.op11_private(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = [f"{k}:{a}:{z}" for k, a, z in brute(r.text)]
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(g.spans.split(",") if g.spans else []) and [g[f"n_{k}"] for k in private.KINDS] == [sum(w.startswith(k) for w in want) for k in private.KINDS]
