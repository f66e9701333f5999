"""Pairs of one written form, by runs, against loops."""

from types import SimpleNamespace

import pytest

from semshift.operators import questions as q


@pytest.fixture(scope="module")
def e(spark):
    """Two words of the form `a`, one of them in two languages; many events of one word, type and year; years that are null."""
    words = [(1, "a", "en"), (1, "a", "de"), (2, "b", "de"), (10, "a", "de"), (3, "c", "en"), (4, "c", None), (5, None, "de")]
    events = [(i, [1, 2, 3, 10, 4, 5][i % 6], "t1" if i % 4 else "t2", [None, 1900, 1901][i % 5 % 3]) for i in range(60)] + [(i, 2, "t1", 1900) for i in range(60, 90)]
    made = SimpleNamespace()
    made.word = spark.createDataFrame(words, "word_id long, written string, lang string")
    made.event = spark.createDataFrame([(i, w, y) for i, w, _, y in events], "event_id long, word_id long, drift_year int")
    made.event_type = spark.createDataFrame([(i, t, t.upper()) for i, _, t, _ in events], "event_id long, type_id string, type_en string")
    typed = [(t, i, y, f, n) for _, i, t, y in events for j, f, n in words if i == j and f and n]
    made.want = [(t.upper(), f, n, y, g, m, z) for t, i, y, f, n in typed for u, j, z, g, m in typed if t == u and n != m and str(i) < str(j) and "a" in (f, g)]
    return made


@pytest.mark.parametrize("run", [1, 4, 1024])
def test_runs_give_every_pair_as_often_as_it_is_there(e, monkeypatch, run):
    """A word of two languages is no pair with itself; runs of any length give the same pairs."""
    monkeypatch.setattr(q, "RUN", run)
    by = lambda rows: sorted(map(tuple, rows), key=repr)
    got = q.cq04(e, "a").collect()
    assert by(got) == by(e.want) and len(got) > 300
    keys = [(r.driftTypeLabel, r.lang1, r.word1) for r in got]
    assert keys == sorted(keys)
    assert by(q.pairs_by_form(e).where("form = 'a'").selectExpr("label1", "word1", "lang1", "year1", "word2", "lang2", "year2").collect()) == by(e.want)


def test_runs_are_ordered_not_pairs(e):
    """What is sorted and dealt is runs: their years are taken apart after it, and no join goes by the type alone."""
    lines = q.cq04(e, "a")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = lambda name: [i for i, line in enumerate(lines) if name in line]
    assert at("Generate explode(years2") and max(at("Generate explode(years")) < min(at("Sort "))
    assert any("part#" in lines[i] for i in at("Join Inner"))


def test_function_deals_a_type_into_parts(spark, e):
    """The table function's pairs are the loops' pairs, by a join on type and part."""
    from semshift.plans import functions

    e.trigger = SimpleNamespace(sparkSession=spark)
    got = functions.called(e, "cq_cross_lingual", "word => 'a'")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, e.want), key=repr)
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert any("part#" in line for line in joins)


def test_like_pairs_are_counted_and_made_last(spark):
    """Pairs that read alike come of a number, so that what is joined grows with events; words of two forms, of repeated rows and of two languages."""
    from collections import Counter

    from semshift.plans import functions

    words = [(1, "a", "en"), (1, "b", "en"), (2, "a", "de"), (2, "a", "de"), (3, "b", "de"), (3, "b", "en"), (10, "a", "en"), (20, "c", "de")]
    events = [(i, [1, 2, 3, 10, 20][i % 5], None if i % 15 == 0 else 1900) for i in range(200)]
    g = SimpleNamespace(trigger=SimpleNamespace(sparkSession=spark))
    g.word = spark.createDataFrame(words, "word_id long, written string, lang string")
    g.event = spark.createDataFrame(events, "event_id long, word_id long, drift_year int")
    g.event_type = spark.createDataFrame([(i, "t", None) for i, _, _ in events], "event_id long, type_id string, type_en string")
    typed = [(i, y, f, n) for _, i, y in events for j, f, n in words if i == j]
    want = Counter((None, f, n, y, h, m, z) for i, y, f, n in typed for j, z, h, m in typed if n != m and str(i) < str(j) and "a" in (f, h))
    got = functions.called(g, "cq_cross_lingual", "word => 'a'")
    assert Counter(map(tuple, got.collect())) == want and want.total() > 20 * len(want)
    lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = lambda name: min(i for i, line in enumerate(lines) if name in line)
    assert at("Generate explode(array_repeat") < at("Aggregate ") < at("Join Inner")


def test_what_is_ordered_does_not_grow_with_pairs(spark):
    """Many words of one form: what is dealt and sorted is numbers of like pairs, in full runs, and the order leaves no tie of unlike rows."""
    g = SimpleNamespace()
    g.word = spark.range(200).selectExpr("id AS word_id", "'a' AS written", "if(id % 2 = 0, 'en', 'de') AS lang")
    g.event = spark.range(800).selectExpr("id AS event_id", "id % 200 AS word_id", "if(id % 7 = 0, null, cast(1900 + id % 3 AS int)) AS drift_year")
    g.event_type = spark.range(800).selectExpr("id AS event_id", "'t' AS type_id", "'T' AS type_en")
    got = q.cq04(g, "a")
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 400 * 400 and rows == sorted(rows, key=lambda r: [(x is not None, x) for x in r])
    deep = got._jdf.queryExecution().optimizedPlan()
    while "Sort" not in deep.nodeName():
        deep = deep.children().head()
    jvm = spark.sparkContext._jvm
    sent = jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, deep).count()
    assert sent <= 2 * 4 * 4 + len(rows) // q.RUN  # like pairs by years and direction, cut into runs
