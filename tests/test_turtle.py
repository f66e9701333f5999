"""Turtle and N-Triples in and out, and the analytics on a graph read from them."""

import pytest

from semshift.operators import document as d
from semshift.operators import questions as q
from semshift.operators import views as v
from semshift.sources import graph, turtle

BASIC = '''
@prefix v: <http://example.org/v#> . @prefix r: <http://example.org/r/> .
PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>
@prefix skos: <http://www.w3.org/2004/02/skos/core#> . # a comment
@prefix ontolex: <http://www.w3.org/ns/lemon/ontolex#> .
@prefix time: <http://www.w3.org/2006/time#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
r:word-lamp a v:Word ; v:writtenForm "Lamp"@en ; v:language "en" ; ontolex:sense r:s1 , r:s2 .
r:word-lamp-dwug-2 a v:Word ; v:writtenForm "lamp"@en ; v:language "en" ; v:crossLingualOf r:word-lampe .
r:word-lampe a v:Word ; v:writtenForm "Lampe"@de ; v:language "de" .
r:s1 a v:Sense ; v:connotation v:Positive ; v:firstAttested "+1700"^^xsd:gYear ; v:gloss "ein Licht"@de , "a \\"light\\""@en .
r:s2 a v:Sense ; v:connotation v:Negative ; v:firstAttested "-0044"^^xsd:gYear .
v:Positive skos:prefLabel "positiv"@de , "positive"@en . v:Negative skos:prefLabel "negative"@en .
r:e1 a v:DriftEvent ; v:affectsWord r:word-lamp ; v:senseFrom r:s1 ; v:senseTo r:s2 ; v:driftType v:A , v:B ; v:driftYear "1901"^^xsd:gYear .
r:e2 a v:DriftEvent ; v:affectsWord r:word-lampe ; v:driftType v:A ;
  v:driftInterval [ a time:Interval ; time:hasBeginning [ time:inXSDgYear "1850"^^xsd:gYear ] ; time:hasEnd [ time:inXSDgYear "1860"^^xsd:gYear ] ] ; .
v:A skos:prefLabel "kind a"@en .
r:t1 a v:TriggerEvent ; rdfs:label "Strom"@de , "Power"@en ; v:eventDate "1880"^^xsd:gYear ; v:triggerCategory v:Cat .
r:t2 a v:TriggerEvent ; rdfs:label "Krieg"@de .
r:h1 a v:CausalHypothesis ; v:aboutDrift r:e1 ; v:proposedTrigger r:t1 ; v:confidence 0.9 ; v:evidenceType v:Speculative , v:ScholarlyAttestation .
r:h2 a v:CausalHypothesis ; v:aboutDrift r:e1 ; v:proposedTrigger r:t2 ; v:confidence 5e-1 ; v:evidenceType v:Speculative .
r:f1 a v:FrequencyObservation ; v:ofWord r:word-lamp ; v:observedYear "1999"^^xsd:gYear ; v:relativeFrequency 1.5 .
'''


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    f = tmp_path_factory.mktemp("ttl")
    (f / "sub").mkdir()
    (f / "basic.ttl").write_text(BASIC)
    (f / "sub" / "again.ttl").write_text(BASIC)
    (f / "broken.ttl").write_text('<http://e/a> <http://e/b> "open .\n')
    (f / "empty.ttl").write_text("# nothing\n")
    (f / "other.txt").write_text("not turtle")
    return f


@pytest.fixture(scope="module")
def g(spark, folder):
    path = str(folder / "graph")
    graph.write_graph(turtle.distinct_triples(turtle.read_turtle(spark, str(folder))), path)
    return graph.Graph(spark.read.parquet(path))


def test_syntax():
    t = turtle.parse('''@base <http://e/> . @prefix : <http://e/#> .
    <a> :p ( 1 -2.5 "x"^^:t ) , true, """two
"lines" \\u00e9""" ; ; :q [] . [ :p :a.b ] . _:n1 :p _:n1 . :x a :C; :esc :a\\,b .''')
    values = [o[1] for _, _, o in t]
    assert "two\n\"lines\" é" in values and "http://e/#a.b" in values and "http://e/#a,b" in values and "-2.5" in values
    assert sum(p.endswith("#first") for _, p, _ in t) == 3 and t[-2][1].endswith("#type")
    loop = next(x for x in t if x[0][0] == "blank" and x[0] == x[2])
    assert loop[0][1].endswith("xn1")
    assert turtle.parse("") == []


@pytest.mark.parametrize("bad", ['<a> <b> "x', "x:a <b> <c> .", '"lit" <b> <c> .', "<a> <b> <c>", "<a> <b> ( 1 .", "<a> .", "@prefix x <b> ."])
def test_errors(bad):
    with pytest.raises(turtle.TurtleError, match="line 1"):
        turtle.parse(bad)


def test_faulty_file_is_skipped(spark, folder):
    raw = turtle.read_turtle(spark, str(folder))
    found = turtle.failed(raw).collect()
    assert [r.file.rsplit("/", 1)[-1] for r in found] == ["broken.ttl"]
    n = len(turtle.parse(BASIC))
    assert raw.where("s is not null").count() == 2 * n
    # only the blank nodes of the two equal files differ
    assert n < turtle.distinct_triples(raw).count() < n + 10


def test_round_trip(spark, folder, tmp_path):
    t = turtle.distinct_triples(turtle.read_turtle(spark, str(folder / "basic.ttl"), pattern="*"))
    want = sorted(map(tuple, t.collect()), key=repr)
    turtle.write_ntriples(t, str(tmp_path / "nt"))
    back = turtle.read_ntriples(spark, str(tmp_path / "nt"))
    assert back.where("error is not null").count() == 0
    assert sorted(map(tuple, turtle.distinct_triples(back).collect()), key=repr) == want
    turtle.write_turtle(t.where("kind <> 'blank' and s not like '\\_:%'"), str(tmp_path / "out"))
    again = turtle.distinct_triples(turtle.read_turtle(spark, str(tmp_path / "out"), pattern="part-*"))
    assert sorted(map(tuple, again.collect()), key=repr) == [x for x in want if not x[0].startswith("_:") and x[3] != "blank"]


def test_ntriples_lines(spark, tmp_path):
    (tmp_path / "x.nt").write_text('# c\n\n<http://a> <http://b> "q\\"t\\n\\u00e9\\U0001F600 \\\\U0001F600\\\'"@EN-gb . # end\n_:x <http://b> _:y .\nbroken line\n')
    rows = {r.s: r for r in turtle.read_ntriples(spark, str(tmp_path / "x.nt")).collect()}
    assert rows["http://a"].o == 'q"t\né\U0001f600 \\U0001F600\'' and rows["http://a"].lang == "en-gb"
    assert rows["_:x"].kind == "blank" and rows[None].error == "not a triple: broken line"


def test_entities(g):
    assert {(r.form, r.lang, r.source, r.quality) for r in g.word.collect()} == {("Lamp", "en", "Curated", "high"), ("lamp", "en", "DWUG", "benchmark"), ("Lampe", "de", "Curated", "high")}
    assert {(r.event_id[-2:], r.year, r.year_end, r.drift_year) for r in g.event.collect()} == {("e1", 1901, None, 1901), ("e2", 1850, 1860, None)}
    assert {(r.event_id[-2:], r.type) for r in g.event_label.collect()} == {("e1", "kind a, B"), ("e2", "kind a")}
    assert {(r.label, r.label_en, r.date, r.category) for r in g.trigger.collect()} == {("Power", "Power", 1880, None), ("Krieg", None, None, None)}
    assert {(r.connotation, r.gloss, r.first_attested) for r in g.sense.collect()} == {("positive", 'a "light"', 1700), ("negative", None, -44)}
    assert [(r.year, r.value) for r in g.frequency.collect()] == [(1999, 1.5)]


def test_analytics_on_a_graph(g):
    assert [tuple(r) for r in q.cq09(g).collect()] == [("Lamp", 2, 0.5, 0.9)]
    assert [(r.word, r.confidence) for r in q.cq07(g).collect()] == [("Lamp", 0.5)]
    assert [tuple(r) for r in q.cq05(g).collect()] == [("Lamp", "positive", "negative", 1901)]
    assert {(r.decade, r.type, r.n) for r in d.by_decade_type(g).collect()} == {(1900, "B", 1), (1900, "kind a", 1), (1850, "kind a", 1)}
    assert d.words_merged(g).count() == 2
    assert [(r.word, r.confidence) for r in v.trigger_hypotheses(g, "http://example.org/r/t1").collect()] == [("Lamp", 0.9)]


def test_coords(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"triggerId": "t1", "lat": 1.5, "lon": 2}, {"triggerId": "t2", "lat": null, "lon": 2}]')
    (tmp_path / "b.json").write_text('{"n": 1, "triggers": [{"triggerId": "t3", "lat": 3, "lon": 4, "coordSource": "P625"}]}')
    found = {(r.triggerId, r.lat, r.lon, r.coordSource) for p in ("a", "b") for r in graph.read_coords(spark, str(tmp_path / f"{p}.json")).collect()}
    assert found == {("t1", 1.5, 2.0, None), ("t2", None, 2.0, None), ("t3", 3.0, 4.0, "P625")}
