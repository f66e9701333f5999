"""Graphs in buckets by subject: the same rows as from a folder, and no exchange for what is joined by subject."""

import pytest

from semshift import sparql
from semshift.sources import graph, turtle
from test_graph import A, B, PREFIX


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    f = tmp_path_factory.mktemp("buckets")
    (f / "a.ttl").write_text(A)
    (f / "b.ttl").write_text(B)
    t = turtle.distinct_triples(turtle.read_turtle(spark, str(f)))
    graph.write_graph(t, str(f / "folder"))
    graph.save_graph(t, "bucketed", str(f / "table"), 4)
    yield spark.read.parquet(str(f / "folder")), graph.open_graph(spark, "bucketed", str(f / "table"), 4), str(f / "table")
    spark.sql("DROP TABLE IF EXISTS bucketed")


@pytest.fixture
def shuffled(spark):
    """No broadcasts, as with large tables."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


STAR = PREFIX + "SELECT ?h ?e ?t ?c ?x { ?h a v:CausalHypothesis ; v:aboutDrift ?e ; v:proposedTrigger ?t ; v:confidence ?c ; v:evidenceType ?x }"


def test_star_of_five_patterns_has_no_exchange(stored, shuffled):
    folder, table, _ = stored
    got = sparql.query(table, STAR)
    assert exchanges(got) == 0 and exchanges(sparql.query(folder, STAR)) >= 5
    assert rows(got) == rows(sparql.query(folder, STAR)) and got.count() == 4


@pytest.mark.parametrize("name", ["word", "event", "trigger", "claim", "sense", "event_sense", "frequency"])
def test_entity_tables(stored, shuffled, name):
    """Only what goes by another node (intervals, categories, evidence, concepts) is exchanged."""
    folder, table, _ = stored
    a, b = (getattr(graph.Graph(t), name) for t in (table, folder))
    assert rows(a) == rows(b)
    left = exchanges(a)
    assert left < exchanges(b)
    if name in ("word", "event_sense", "frequency"):
        assert left == 0


def test_a_subject_with_several_objects_and_one_repeated_variable(stored):
    """All pairs of a subject's objects; a variable used twice must be one term, in a star or beside it."""
    folder, table, _ = stored
    for text, n in (
        ("SELECT ?a ?b { ?w o:sense ?a ; o:sense ?b }", 4 + 3),
        ("SELECT ?w { ?w o:sense ?a ; v:writtenForm ?f ; v:crossLingualOf ?w }", 0),
        ("SELECT ?w ?a { ?w o:sense ?a ; o:sense ?a ; v:language ?l }", 4),
        ('SELECT ?w { ?w v:language "en" ; v:writtenForm "cloud"@en ; a v:Word }', 1),
        ('SELECT ?w { ?w v:language "en" ; v:writtenForm "cloud" ; a v:Word }', 0),
        ("SELECT ?s ?y { ?w o:sense ?s ; v:language ?l . ?s v:firstAttested ?y ; v:attestedDuring ?i . ?i <http://www.w3.org/2006/time#hasBeginning> ?b }", 1),
    ):
        got = rows(sparql.query(table, PREFIX + text))
        assert got == rows(sparql.query(folder, PREFIX + text)) and len(got) == n, text


def test_open_in_a_catalog_that_does_not_know_the_table(spark, stored, shuffled):
    folder, table, path = stored
    again = graph.open_graph(spark, "bucketed_again", path, 4)
    assert rows(again.select(sorted(again.columns))) == rows(folder.select(sorted(folder.columns)))
    assert exchanges(sparql.query(again, STAR)) == 0
    spark.sql("DROP TABLE bucketed_again")
