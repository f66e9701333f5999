"""Operators on triples themselves, and on entity tables before anything is built of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bucket_label, csv_field, gyear, local_name, parse_year, quality_of, read_year, slug, source_of, turtle_literal
from ..sources.graph import Graph, by_predicate
from ..sources.lens import LABEL, PREF, RESOURCE, VOCAB, Entities
from ..sources.turtle import TRIPLE
from . import shapes


def triple_count(t: DataFrame) -> DataFrame:
    """n: how many triples there are; 0 for an empty graph."""
    return t.agg(F.count(F.lit(1)).alias("n"))


def triples_distinct(t: DataFrame) -> DataFrame:
    """Triples by predicate after insertion as a set: doubled ones count once."""
    both = t.select(*TRIPLE).unionByName(t.select(*TRIPLE).where(F.pmod(F.xxhash64("s"), F.lit(3)) == 0)).dropDuplicates()
    return both.groupBy(local_name(F.col("p")).alias("predicate")).agg(F.count(F.lit(1)).alias("n"))


def scan_class(t: DataFrame, kind: str = "TriggerEvent") -> DataFrame:
    return Graph(by_predicate(t)).a(kind, "id")


def entity_counts(t: DataFrame) -> DataFrame:
    """class, n: distinct members of each class."""
    types = t.where(local_name(F.col("p")) == "type").select("s", local_name(F.col("o")).alias("class")).distinct()
    return types.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def lang_filter(t: DataFrame, lang: str = "en") -> DataFrame:
    """Written forms in one language."""
    return t.where((local_name(F.col("p")) == "writtenForm") & (F.col("lang") == lang)).select(F.col("s").alias("id"), F.col("o").alias("form"))


def label_fallback(t: DataFrame) -> DataFrame:
    """Triggers and categories with their label: English, any, or else the local name."""
    g = Graph(by_predicate(t))
    concept = g.triples.where("name = 'triggerCategory'").select(F.col("o").alias("s")).distinct().join(g.text("prefLabel", "label"), "s", "left")
    trig = g.a("TriggerEvent", "s").join(g.text("label", "label"), "s", "left")
    return trig.unionByName(concept).select(F.col("s").alias("id"), F.coalesce("label", local_name(F.col("s"))).alias("label"), F.coalesce("label_en", F.lit("-")).alias("labelEn"))


# on entity tables


def distinct_words(e: Entities) -> DataFrame:
    return e.word.select(F.lower("written").alias("form"), "lang").distinct()


def optional_left(e: Entities) -> DataFrame:
    """Triggers with their category, if they have one."""
    return e.trigger.select("trigger_id", "label", "category")


def optional_filtered(e: Entities, least: float = 0.9) -> DataFrame:
    """Every trigger with the number of its hypotheses of at least that confidence: the test belongs to the optional part."""
    h = e.claim.where(F.col("confidence") >= least).groupBy("trigger_id").agg(F.count(F.lit(1)).alias("n"))
    return e.trigger.select("trigger_id").join(h, "trigger_id", "left").select("trigger_id", "n")


def interval_chain(e: Entities) -> DataFrame:
    """Events dated by an interval: its first and last year."""
    return e.event.where("drift_year is null").select("event_id", F.col("year").alias("begin"), F.col("year_end").alias("end"))


def sense_rows(e: Entities) -> DataFrame:
    s = e.word_sense.select("sense_id").distinct()
    return e.sense.join(s, "sense_id", "left_semi").select("sense_id", "gloss", "connotation", "first_attested")


def word_senses(e: Entities) -> DataFrame:
    """Each word's senses by year (none counts as 0)."""
    j = e.word_sense.join(e.sense.select("sense_id", "first_attested"), "sense_id")
    g = j.groupBy("word_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("first_attested", F.lit(0)).alias("y"), "sense_id"))).alias("s"))
    return g.select("word_id", F.size("s").alias("n"), F.array_join(F.transform("s", lambda x: x["sense_id"].cast("string")), " ").alias("senses"))


def words_admissible(e: Entities) -> DataFrame:
    """Words that have a form or a sense, and what they are called."""
    return e.word.select("word_id", "form", "lang", "source", "quality")


def hyp_evidence(e: Entities) -> DataFrame:
    """Evidence of each event and trigger, each kind once."""
    return e.hypothesis.select("event_id", "trigger_id", F.array_join("evidence", "; ").alias("evidence"))


def trigger_collapse(e: Entities) -> DataFrame:
    """Triggers that several files declare, in one row: here those of one date and category, with the first label and what the others fill in."""
    t = e.trigger.groupBy("date", F.coalesce("category", F.lit("-")).alias("category"))
    return t.agg(F.min("trigger_id").alias("trigger_id"), F.min_by("label", "trigger_id").alias("label"), F.min("same_as").alias("same_as"), F.count(F.lit(1)).alias("n"))


def derive_source(e: Entities) -> DataFrame:
    """Source and quality from marks in a word's name."""
    mark = F.element_at(F.array(*map(F.lit, ("gfds", "freq", "owid", "dwug", "semeval", "dwds"))), (F.col("word_id") % 6 + 1).cast("int"))
    iri = F.concat(F.lit(RESOURCE + "word-"), mark, F.lit("-"), F.col("word_id").cast("string"))
    d = e.word.select("word_id", source_of(iri).alias("source"))
    return d.withColumn("quality", quality_of(F.col("source")))


def parsed_years(e: Entities) -> DataFrame:
    """Years from text with signs, zeros and junk."""
    k = F.col("trigger_id")
    text = F.when(k % 4 == 0, F.concat(F.lit("+"), F.col("date").cast("string"))).when(k % 4 == 1, F.concat(F.lit("-0"), (F.col("date") - 1500).cast("string"))).when(k % 4 == 2, F.concat(F.lit("0"), F.col("date").cast("string"))).otherwise("c. 1900")
    t = e.trigger.select("trigger_id", text.alias("text"))
    return t.select("trigger_id", "text", parse_year(F.col("text")).alias("year"), read_year(F.col("text")).alias("shown"), F.coalesce(bucket_label(parse_year(F.col("text"))), F.lit("-")).alias("bucket"))


def local_names(e: Entities) -> DataFrame:
    iri = F.concat(F.lit("http://example.org/a#b/"), F.col("word_id").cast("string"), F.when(F.col("word_id") % 2 == 0, "#x").otherwise(""))
    return e.word.select("word_id", local_name(iri).alias("name"))


def gyears(e: Entities) -> DataFrame:
    return e.trigger.select("trigger_id", gyear((F.col("date") - 1980) * 7).alias("gyear"))


def slugs(e: Entities) -> DataFrame:
    """Names for files and quoted fields of texts with signs in them."""
    t = F.concat(F.lit('Ä "x", '), F.col("label"), F.lit(" \\ no. "), F.col("trigger_id").cast("string"), F.lit("!"))
    return e.trigger.select("trigger_id", slug(t).alias("slug"), csv_field(t).alias("csv"), turtle_literal(t).alias("turtle"))


def shacl_report(t: DataFrame) -> DataFrame:
    """Violations by shape, path and constraint."""
    return shapes.summary(shapes.report(t))


def shacl_focus(t: DataFrame) -> DataFrame:
    """The focus nodes that break the honesty guard, the anchor or a class."""
    found = shapes.report(t, [r for r in shapes.SHAPES if r.path == "triggerCategory"])
    return found.select("shape", F.regexp_replace("focus", RESOURCE, "").alias("focus"), F.coalesce("path", F.lit("-")).alias("path"), "constraint")


_P = f"PREFIX v: <{VOCAB}> PREFIX r: <{RESOURCE}> PREFIX rdfs: <{LABEL.rsplit('#', 1)[0]}#> PREFIX skos: <{PREF.rsplit('#', 1)[0]}#> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"

#: Ad-hoc queries over the lens's triples.
SPARQL = {
    "sparql_select": _P + """SELECT ?name (xsd:integer(STR(?date)) + 1 AS ?next) WHERE { ?t a v:TriggerEvent ; rdfs:label ?name ; v:eventDate ?date .
        FILTER(xsd:integer(STR(?date)) >= 1950 && STR(?name) != "Supplier#000000003") } ORDER BY DESC(xsd:integer(STR(?date))) ?name""",
    "sparql_optional": _P + """SELECT ?name ?category WHERE { ?t a v:TriggerEvent ; rdfs:label ?name . OPTIONAL { ?t v:triggerCategory ?c . ?c skos:prefLabel ?category . FILTER(lang(?category) = "en") } }""",
    "sparql_union": _P + """SELECT ?kind ?label WHERE { { ?w v:writtenForm ?label BIND("word" AS ?kind) FILTER(STRSTARTS(STR(?label), "W1")) } UNION { ?t a v:TriggerEvent ; rdfs:label ?label BIND("trigger" AS ?kind) } }""",
    "sparql_minus": _P + """SELECT ?e WHERE { ?e a v:DriftEvent ; v:driftType ?k . ?k skos:prefLabel "1-URGENT"@en . MINUS { ?e v:driftYear ?y } }""",
    "sparql_not_exists": _P + """SELECT ?h ?confidence WHERE { ?h a v:CausalHypothesis ; v:confidence ?confidence . FILTER NOT EXISTS { ?h v:evidenceType ?x . FILTER(?x != <http://example.org/r/evidence/Speculative>) } }""",
    "sparql_group_having": _P + """SELECT ?form (COUNT(DISTINCT ?t) AS ?triggers) (MAX(?c) AS ?most) (GROUP_CONCAT(DISTINCT ?kind; SEPARATOR=" ") AS ?kinds) WHERE {
        ?h v:aboutDrift ?e ; v:proposedTrigger ?t ; v:confidence ?c . ?e v:affectsWord ?w ; v:driftType/skos:prefLabel ?kind . ?w v:writtenForm ?form }
        GROUP BY ?form HAVING (COUNT(DISTINCT ?t) > 20) ORDER BY DESC(?triggers) ?form""",
    "sparql_exists_or": _P + """SELECT ?name WHERE { ?t a v:TriggerEvent ; rdfs:label ?name ; v:eventDate ?d BIND(xsd:integer(STR(?d)) AS ?year)
        FILTER(EXISTS { { ?h v:proposedTrigger ?t ; v:confidence ?c FILTER(?c >= 0.9 && ?year > 1950) } UNION { ?t v:triggerCategory ?k FILTER(?k = <http://example.org/r/category-ASIA> && ?year < 1930) } } || STRENDS(STR(?name), "7")) }""",
    "sparql_not_exists_later": _P + """SELECT ?name WHERE { ?t a v:TriggerEvent ; rdfs:label ?name ; v:eventDate ?d BIND(xsd:integer(STR(?d)) AS ?year) FILTER NOT EXISTS { ?e v:driftYear ?y FILTER(xsd:integer(STR(?y)) < ?year) } }""",
    "sparql_filter_join": _P + """SELECT ?name (COUNT(*) AS ?n) WHERE { ?e v:driftYear ?y . ?t v:eventDate ?d ; rdfs:label ?name FILTER(?y = ?d) } GROUP BY ?name""",
    "sparql_band_join": _P + """SELECT ?a ?b WHERE { ?t v:eventDate ?d ; rdfs:label ?a . ?u v:eventDate ?f ; rdfs:label ?b FILTER(ABS(xsd:integer(STR(?d)) - xsd:integer(STR(?f))) <= 1) FILTER(STR(?a) < STR(?b)) }""",
    "sparql_values": _P + """SELECT ?name ?n WHERE { VALUES ?name { "Supplier#000000001"@en "Supplier#000000002"@en "nobody"@en } ?t rdfs:label ?name . { SELECT ?t (COUNT(*) AS ?n) WHERE { ?h v:proposedTrigger ?t } GROUP BY ?t } }""",
}

#: The lens's triples as SQL: s, p (local names), o.
_R = RESOURCE
TRIPLES_SQL = f""", tr AS (SELECT '{_R}word-' || word_id AS s, unnest(['type', 'writtenForm', 'language']) AS p, unnest(['Word', form, lang]) AS o FROM word
UNION ALL SELECT '{_R}event-' || event_id, unnest(['type', 'affectsWord', 'driftType']), unnest(['DriftEvent', '{_R}word-' || word_id, type]) FROM event
UNION ALL SELECT '{_R}event-' || event_id, 'driftYear', CAST(drift_year AS VARCHAR) FROM event WHERE drift_year IS NOT NULL
UNION ALL SELECT '{_R}event-' || event_id, 'driftInterval', '' FROM event WHERE drift_year IS NULL AND event_id % 2 = 0
UNION ALL SELECT '{_R}trigger-' || trigger_id, unnest(['type', 'label', 'eventDate']), unnest(['TriggerEvent', label, CAST(date AS VARCHAR)]) FROM trig
UNION ALL SELECT '{_R}trigger-' || trigger_id, 'triggerCategory', category FROM trig WHERE category IS NOT NULL
UNION ALL SELECT '{_R}hyp-' || event_id || '-' || trigger_id, unnest(['type', 'aboutDrift', 'proposedTrigger', 'confidence']), unnest(['CausalHypothesis', '', '', '']) FROM hyp
UNION ALL SELECT '{_R}hyp-' || event_id || '-' || trigger_id, 'evidenceType', evidence FROM ev
UNION ALL SELECT type, unnest(['type', 'prefLabel']), 'Concept' FROM (SELECT DISTINCT type FROM event)
UNION ALL SELECT category, unnest(['type', 'prefLabel']), 'Concept' FROM (SELECT DISTINCT category FROM trig WHERE category <> 'AFRICA')
UNION ALL SELECT e, unnest(['type', 'prefLabel']), 'Concept' FROM (SELECT unnest(range(5)) AS e))"""

_TEXT = "(CASE trigger_id % 4 WHEN 0 THEN '+' || date WHEN 1 THEN '-0' || (date - 1500) WHEN 2 THEN '0' || date ELSE 'c. 1900' END)"
_N = "CAST(abs(y) AS INT)"
_ORD = lambda n: f"({n} || CASE WHEN {n} % 100 BETWEEN 11 AND 13 THEN 'th' WHEN {n} % 10 = 1 THEN 'st' WHEN {n} % 10 = 2 THEN 'nd' WHEN {n} % 10 = 3 THEN 'rd' ELSE 'th' END)"
_ODD = "'Ä \"x\", ' || label || ' \\ no. ' || trigger_id || '!'"

SQL = {
    "triple_count": TRIPLES_SQL + " SELECT count(*) AS n FROM tr",
    "triples_distinct": TRIPLES_SQL + " SELECT p AS predicate, count(*) AS n FROM tr GROUP BY p",
    "scan_class": f"SELECT '{_R}trigger-' || s_suppkey AS id FROM supplier",
    "entity_counts": "SELECT 'Word' AS class, count(*) AS n FROM customer UNION ALL SELECT 'DriftEvent', count(*) FROM orders UNION ALL SELECT 'TriggerEvent', count(*) FROM supplier UNION ALL SELECT 'CausalHypothesis', count(*) FROM hyp UNION ALL SELECT 'Concept', 5 + count(DISTINCT o_orderpriority) + (SELECT count(DISTINCT category) FROM trig WHERE category <> 'AFRICA') FROM orders",
    "lang_filter": f"SELECT '{_R}word-' || word_id AS id, form FROM word WHERE lang = 'en'",
    "label_fallback": f"SELECT '{_R}trigger-' || trigger_id AS id, label, label AS \"labelEn\" FROM trig UNION ALL SELECT DISTINCT '{_R}category-' || category, CASE WHEN category = 'AFRICA' THEN 'category-AFRICA' ELSE category END, CASE WHEN category = 'AFRICA' THEN '-' ELSE category END FROM trig WHERE category IS NOT NULL",
    "distinct_words": "SELECT DISTINCT lower(form) AS form, lang FROM word",
    "optional_left": "SELECT trigger_id, label, category FROM trig",
    "optional_filtered": "SELECT trig.trigger_id, n FROM trig LEFT JOIN (SELECT trigger_id, count(*) AS n FROM hyp WHERE confidence >= 0.9 GROUP BY trigger_id) h ON h.trigger_id = trig.trigger_id",
    "interval_chain": "SELECT event_id, year AS begin, year_end AS \"end\" FROM event WHERE drift_year IS NULL",
    "sense_rows": "SELECT sense_id, gloss, connotation, first_attested FROM sense WHERE sense_id IN (SELECT unnest([sense_from, sense_to]) FROM es JOIN event USING (event_id))",
    "word_senses": "SELECT word_id, CAST(count(*) AS INT) AS n, string_agg(CAST(sense_id AS VARCHAR), ' ' ORDER BY first_attested, sense_id) AS senses FROM (SELECT DISTINCT word_id, unnest([sense_from, sense_to]) AS sense_id FROM es JOIN event USING (event_id)) JOIN sense USING (sense_id) GROUP BY word_id",
    "words_admissible": "SELECT word_id, form, lang, source, quality FROM word",
    "hyp_evidence": "SELECT event_id, trigger_id, string_agg(evidence, '; ' ORDER BY evidence) AS evidence FROM ev GROUP BY ALL",
    "trigger_collapse": "SELECT date, coalesce(category, '-') AS category, min(trigger_id) AS trigger_id, arg_min(label, trigger_id) AS label, min('http://example.org/entity/Q' || trigger_id) AS same_as, count(*) AS n FROM trig GROUP BY 1, 2",
    "derive_source": "SELECT word_id, (['GfdS', 'Frequency', 'OWID', 'DWUG', 'SemEval', 'Curated'])[word_id % 6 + 1] AS source, (['high', 'detected', 'high', 'benchmark', 'benchmark', 'high'])[word_id % 6 + 1] AS quality FROM word",
    "parse_year": f", y AS (SELECT trigger_id, {_TEXT} AS text, CASE trigger_id % 4 WHEN 0 THEN date WHEN 1 THEN 1500 - date WHEN 2 THEN date END AS y FROM trig) SELECT trigger_id, text, CAST(y AS INT) AS year, CASE WHEN y IS NULL THEN text WHEN y < 0 THEN -y || ' BC' ELSE CAST(y AS VARCHAR) END AS shown, CASE WHEN y IS NULL THEN '-' WHEN y < 0 THEN {_ORD('CAST(ceil(abs(y) / 100.0) AS INT)')} || ' c. BC' ELSE CAST(floor(y / 10.0) * 10 AS INT) || 's' END AS bucket FROM y",
    "local_name": "SELECT word_id, CASE WHEN word_id % 2 = 0 THEN 'x' ELSE CAST(word_id AS VARCHAR) END AS name FROM word",
    "fmt_gyear": "SELECT trigger_id, CASE WHEN date < 1980 THEN '-' ELSE '' END || lpad(CAST(abs(date - 1980) * 7 AS VARCHAR), 4, '0') AS gyear FROM trig",
    "slugify": f"SELECT trigger_id, trim(regexp_replace(lower({_ODD}), '[^a-z0-9]+', '-', 'g'), '-') AS slug, '\"' || replace({_ODD}, '\"', '\"\"') || '\"' AS csv, '\"' || replace(replace({_ODD}, '\\', '\\\\'), '\"', '\\\"') || '\"' AS turtle FROM trig",
    "shacl_report": ", v AS (SELECT 'WordShape' AS shape, 'sense' AS path, 'minCount' AS \"constraint\", count(*) AS n FROM word UNION ALL SELECT 'DriftEventShape', 'senseTo', 'minCount', count(*) FROM event UNION ALL SELECT 'DriftEventShape', 'hasSource', 'minCount', count(*) FROM event UNION ALL SELECT 'CausalHypothesisShape', 'hasSource', 'minCount', count(*) FROM hyp UNION ALL SELECT 'DriftEventShape', NULL, 'or', count(*) FROM event WHERE drift_year IS NULL AND event_id % 2 = 1 UNION ALL SELECT 'TriggerEventShape', 'triggerCategory', 'minCount', count(*) FROM trig WHERE category IS NULL UNION ALL SELECT 'TriggerEventShape', 'triggerCategory', 'class', count(*) FROM trig WHERE category = 'AFRICA' UNION ALL SELECT 'CausalHypothesisShape', 'evidenceType', 'class', count(*) FROM ev WHERE evidence = 'Other' UNION ALL SELECT 'CausalHypothesisShape', 'confidence', 'maxInclusive', count(*) FROM hyp WHERE confidence > 1 UNION ALL SELECT 'CausalHypothesisShape', 'confidence', 'sparql', count(*) FROM hyp h WHERE confidence >= 0.66 AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.event_id = h.event_id AND ev.trigger_id = h.trigger_id AND evidence <> 'Speculative')) SELECT * FROM v WHERE n > 0",
    "shacl_focus": "SELECT 'TriggerEventShape' AS shape, 'trigger-' || trigger_id AS focus, 'triggerCategory' AS path, CASE WHEN category IS NULL THEN 'minCount' ELSE 'class' END AS \"constraint\" FROM trig WHERE category IS NULL OR category = 'AFRICA' UNION ALL SELECT 'DriftEventShape', 'event-' || event_id, '-', 'or' FROM event WHERE drift_year IS NULL AND event_id % 2 = 1 UNION ALL SELECT 'CausalHypothesisShape', 'hyp-' || event_id || '-' || trigger_id, 'confidence', 'sparql' FROM hyp h WHERE confidence >= 0.66 AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.event_id = h.event_id AND ev.trigger_id = h.trigger_id AND evidence <> 'Speculative')",
    "sparql_select": "SELECT label AS name, CAST(date + 1 AS VARCHAR) AS next FROM trig WHERE date >= 1950 AND label <> 'Supplier#000000003'",
    "sparql_optional": "SELECT label AS name, CASE WHEN category <> 'AFRICA' THEN category END AS category FROM trig",
    "sparql_union": "SELECT 'word' AS kind, form AS label FROM word WHERE form LIKE 'W1%' UNION ALL SELECT 'trigger', label FROM trig",
    "sparql_minus": f"SELECT '{_R}event-' || event_id AS e FROM event WHERE type = '1-URGENT' AND drift_year IS NULL",
    "sparql_not_exists": f"SELECT '{_R}hyp-' || event_id || '-' || trigger_id AS h, CAST(confidence AS VARCHAR) AS confidence FROM hyp WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.event_id = hyp.event_id AND ev.trigger_id = hyp.trigger_id AND evidence <> 'Speculative')",
    "sparql_group_having": "SELECT form, CAST(count(DISTINCT trigger_id) AS VARCHAR) AS triggers, CAST(max(confidence) AS VARCHAR) AS most, string_agg(DISTINCT type, ' ' ORDER BY type) AS kinds FROM hyp JOIN event USING (event_id) JOIN word USING (word_id) GROUP BY form, lang HAVING count(DISTINCT trigger_id) > 20",
    "sparql_exists_or": "SELECT label AS name FROM trig WHERE (date > 1950 AND trigger_id IN (SELECT trigger_id FROM hyp WHERE confidence >= 0.9)) OR (category = 'ASIA' AND date < 1930) OR label LIKE '%7'",
    "sparql_not_exists_later": "SELECT label AS name FROM trig WHERE NOT EXISTS (SELECT 1 FROM event WHERE drift_year < date)",
    "sparql_filter_join": "SELECT label AS name, CAST(count(*) AS VARCHAR) AS n FROM event JOIN trig ON drift_year = date GROUP BY label, trigger_id",
    "sparql_band_join": "SELECT x.label AS a, y.label AS b FROM trig x JOIN trig y ON abs(x.date - y.date) <= 1 AND x.label < y.label",
    "sparql_values": "SELECT label AS name, CAST(count(*) AS VARCHAR) AS n FROM hyp JOIN trig USING (trigger_id) WHERE label IN ('Supplier#000000001', 'Supplier#000000002') GROUP BY label",
}
