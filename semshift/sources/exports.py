"""What leaves the graph: CSV tables, the ledger of claims, and Turtle and JSON of words and triggers, as rows of text that are written where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_field, gyear, qid, slug, turtle_literal
from ..operators.document import detail, flat, full_words, impact, words_light
from .lens import Entities
from .single import write_single

#: The columns of the table of words and of the ledger.
WORD_COLUMNS = ("writtenForm", "language", "source", "quality", "driftTypeLabels", "yearStart", "yearEnd", "hasTrigger")
LEDGER_COLUMNS = (
    "hypothesis_id", "word", "language", "sense_from", "sense_to", "drift_type", "drift_year", "proposed_trigger", "trigger_date", "trigger_category", "wikidata_qid", "evidence_types", "confidence", "source_urls", "source_titles", "attributed_to", "date",
)


def csv_lines(df: DataFrame, columns: tuple[str, ...] | None = None) -> Column:
    """A row's fields as one line, quoted where they have to be; missing ones are empty, truth values are words."""
    return F.concat_ws(",", *[csv_field(F.col(c).cast("string")) for c in columns or df.columns])


def write_csv(df: DataFrame, path: str, order: list, columns: tuple[str, ...] | None = None, bom: bool = True) -> None:
    """A folder of parts that make one file in order: a byte order mark, the header, lines that end in CR LF."""
    columns = columns or tuple(df.columns)
    keys = [o.alias(f"__k{i}") if isinstance(o, Column) else F.col(o).alias(f"__k{i}") for i, o in enumerate(order)]
    rows = df.select(F.lit(1).alias("__part"), *keys, csv_lines(df, columns).alias("line"))
    head = df.sparkSession.range(1).select(F.lit(0).alias("__part"), *[F.lit(None).cast(rows.schema[f"__k{i}"].dataType).alias(f"__k{i}") for i in range(len(keys))], F.lit(("﻿" if bom else "") + ",".join(columns)).alias("line"))
    head.unionByName(rows).orderBy("__part", *[f"__k{i}" for i in range(len(keys))]).select("line").write.option("lineSep", "\r\n").text(path)


def word_table(e: Entities) -> DataFrame:
    """The eight columns of the table of words, and the id."""
    return words_light(e).select("id", "writtenForm", "language", "source", "quality", F.array_join("driftTypeLabels", "; ").alias("driftTypeLabels"), "yearStart", "yearEnd", "hasTrigger")


def csv_words(e: Entities) -> DataFrame:
    """The lines of the table of words."""
    w = word_table(e)
    return w.select("id", csv_lines(w, WORD_COLUMNS).alias("line"))


def write_csv_words(e: Entities, path: str) -> None:
    w = word_table(e)
    write_csv(w, path, [F.coalesce(F.col("language") != "en", F.lit(True)), F.lower("writtenForm"), "id"], WORD_COLUMNS)


def write_csv_words_file(e: Entities, path: str) -> None:
    """The table of words as one file: byte order mark, header, rows in order, CR LF."""
    w = word_table(e).orderBy(F.coalesce(F.col("language") != "en", F.lit(True)), F.lower("writtenForm"), "id")
    write_single(w.sparkSession, path, ["\ufeff" + ",".join(WORD_COLUMNS) + "\r\n", w.select(csv_lines(w, WORD_COLUMNS).alias("line")), "\r\n"], "\r\n")


def claims_ledger(e: Entities) -> DataFrame:
    """A row for each hypothesis, with all that bears on it. Lists are joined by "; "."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ").alias(f"source_{c}s")
    cited = e.claim_source.groupBy("hyp_id").agg(listed("title"), listed("url"))
    said = [F.col(c) if c in e.claim.columns else F.lit(None).cast("string").alias(c) for c in ("attributed_to", "stated")]
    h = e.claim.select("hyp_id", "event_id", "trigger_id", "confidence", F.array_join("evidence", "; ").alias("evidence_types"), *said)
    ev = e.event.select("event_id", "word_id", "year").join(e.word.select("word_id", "form", "lang"), "word_id").join(e.event_label, "event_id", "left").join(e.event_sense, "event_id", "left")
    j = h.join(cited, "hyp_id", "left").join(ev, "event_id").join(e.trigger, "trigger_id", "left")
    cols = {
        "hypothesis_id": F.col("hyp_id"), "word": F.col("form"), "language": F.col("lang"), "sense_from": F.col("sense_from").cast("string"), "sense_to": F.col("sense_to").cast("string"), "drift_type": F.col("type"), "drift_year": F.col("year"), "proposed_trigger": F.col("label"),
        "trigger_date": F.col("date"), "trigger_category": F.col("category"), "wikidata_qid": qid(F.col("same_as")), "source_urls": F.coalesce("source_urls", F.lit("")), "source_titles": F.coalesce("source_titles", F.lit("")), "date": F.col("stated"),
    }
    return j.select(*[cols.get(c, F.col(c)).alias(c) for c in LEDGER_COLUMNS])


def words_csv(e: Entities) -> DataFrame:
    """word_id, written_form, language, n_senses."""
    n = e.word_sense.groupBy("word_id").agg(F.count(F.lit(1)).alias("n"))
    return e.word.join(n, "word_id", "left").select("word_id", F.col("form").alias("written_form"), F.col("lang").alias("language"), F.coalesce("n", F.lit(0)).cast("long").alias("n_senses"))


def triggers_csv(e: Entities) -> DataFrame:
    """trigger_id, label, event_date, category, wikidata_qid."""
    return e.trigger.select("trigger_id", "label", F.col("date").alias("event_date"), "category", qid(F.col("same_as")).alias("wikidata_qid"))


# Turtle in the viewer's layout


def prefixes(vocabulary: str) -> str:
    """The head of an exported file."""
    known = {"drift": vocabulary, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", "xsd": "http://www.w3.org/2001/XMLSchema#", "prov": "http://www.w3.org/ns/prov#"}
    return "# Drawn from the graph document: hypotheses are stubs, and sources are left out.\n" + "\n".join(f"@prefix {k}: <{v}> ." for k, v in known.items())


def _iri(c: str | Column) -> Column:
    return F.concat(F.lit("<"), (F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(">"))


def _text(c: Column, lang: Column | None = None) -> Column:
    """A literal, null for null, with its language if there is one."""
    return turtle_literal(c) if lang is None else F.concat(turtle_literal(c), F.coalesce(F.concat(F.lit("@"), lang), F.lit("")))


def _year(c: Column) -> Column:
    return F.concat(F.lit('"'), gyear(c), F.lit('"^^xsd:gYear'))


def _said(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"    {name} "), value)


def _block(subject: Column, kind: str, *lines: Column | tuple[Column]) -> Column:
    """One statement; a line whose value is missing is left out. A tuple holds a column of many lines."""
    all_ = F.array_compact(F.concat(*[x[0] if isinstance(x, tuple) else F.array(x) for x in lines]))
    return F.concat(subject, F.lit(f" a drift:{kind}"), F.when(F.size(all_) > 0, F.concat(F.lit(" ;\n"), F.array_join(all_, " ;\n"))).otherwise(""), F.lit(" ."))


def _many(c: Column) -> tuple[Column]:
    return (c,)


def _trigger_block(t: dict[str, Column]) -> Column:
    return _block(_iri(t["id"]), "TriggerEvent", _said("rdfs:label", _text(t["label"])), _said("drift:triggerCategory", _text(t["category"])), _said("drift:eventDate", _year(t["date"])), _said("owl:sameAs", _iri(t["same_as"])), _said("drift:description", _text(t["description"])))


def word_turtle(e: Entities, namespace: str = "http://example.org/r/") -> DataFrame:
    """id, turtle: each merged word with its senses, its events, a stub for each event's triggers, and those triggers, once each."""
    w = words_light(e).select("id", "writtenForm", "language").join(detail(e), "id")
    word = _block(_iri("id"), "Word", _said("drift:writtenForm", _text(F.col("writtenForm"), F.col("language"))), _said("drift:language", _text(F.col("language"))), _many(F.transform("senses", lambda s: _said("drift:hasSense", _iri(s["id"])))))
    senses = F.transform("senses", lambda s: _block(_iri(s["id"]), "Sense", _said("drift:gloss", _text(s["glossEn"], F.lit("en"))), F.when(s["connotationId"].isNotNull(), _said("drift:connotation", _iri(s["connotationId"]))).otherwise(_said("drift:connotationLabel", _text(s["connotation"]))), _said("drift:firstAttested", _year(s["firstAttested"]))))

    def event(d: Column) -> Column:
        kinds = F.when(F.size(d["driftTypeIds"]) > 0, F.transform(d["driftTypeIds"], lambda t: _said("drift:driftType", _iri(t)))).otherwise(F.array(_said("drift:driftTypeLabel", _text(d["driftTypeLabel"]))))
        return _block(_iri(d["id"]), "DriftEvent", _said("drift:affectsWord", _iri("id")), _said("drift:senseFrom", _iri(d["senseFromId"])), _said("drift:senseTo", _iri(d["senseToId"])), _many(kinds), _said("drift:year", _year(d["year"])), _said("drift:confidence", d["confidence"].cast("string")))

    events = F.transform("driftEvents", event)
    head = w.select("id", F.array_join(F.concat(F.array(word), senses, events), "\n\n").alias("head"))
    # stubs and triggers: a row for each event and trigger of the word, numbered within the word
    ev = w.select("id", "writtenForm", F.posexplode("driftEvents").alias("i", "d")).select("id", "writtenForm", "i", F.col("d.id").alias("event_id"), F.posexplode("d.triggerIds").alias("k", "trigger_id"))
    h = e.hypothesis.select(F.col("event_id").alias("he"), F.col("trigger_id").alias("ht"), "confidence", "evidence")
    ev = ev.join(h, (F.col("event_id") == F.col("he")) & (F.col("trigger_id") == F.col("ht")), "left").drop("he", "ht").join(e.trigger, "trigger_id", "left")
    name = F.concat(F.lit(namespace + "hyp-"), slug(F.col("writtenForm")), F.lit("-"), (F.col("i") + 1).cast("string"), F.when(F.col("k") > 0, F.concat(F.lit("-"), (F.col("k") + 1).cast("string"))).otherwise(""))
    stub = _block(_iri(name), "CausalHypothesis", _said("drift:aboutDrift", _iri("event_id")), _said("drift:proposedTrigger", _iri("trigger_id")), _said("drift:confidence", F.col("confidence").cast("string")), _many(F.transform(F.coalesce("evidence", F.array().cast("array<string>")), lambda x: _said("drift:evidenceType", _text(x)))), _said("prov:wasInfluencedBy", _iri("trigger_id")))
    trig = _trigger_block({"id": F.col("trigger_id"), "label": F.col("label"), "category": F.col("category"), "date": F.col("date"), "same_as": F.col("same_as"), "description": F.col("description")})
    stubs = ev.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "k", stub.alias("t")))).alias("h"), F.array_sort(F.collect_set(F.struct("trigger_id", trig.alias("t")))).alias("t"))
    tail = stubs.select("id", F.array_join(F.concat(F.col("h.t"), F.col("t.t")), "\n\n").alias("tail"))
    return head.join(tail, "id", "left").select("id", F.concat_ws("\n\n", "head", "tail").alias("turtle"))


def trigger_turtle(e: Entities, namespace: str = "http://example.org/r/") -> DataFrame:
    """id, turtle: each trigger, the merged words that it affects, and a stub for each of their events that it is proposed for."""
    t = e.trigger.select(F.col("trigger_id").alias("id"), _trigger_block({"id": F.col("trigger_id"), "label": F.col("label"), "category": F.col("category"), "date": F.col("date"), "same_as": F.col("same_as"), "description": F.col("description")}).alias("head"))
    f = e.pair.join(flat(e, with_causes=False).select("event_id", "canon", "word", "lang"), "event_id")
    word = _block(_iri("canon"), "Word", _said("drift:writtenForm", _text(F.col("word"), F.when(F.col("lang") != "?", F.col("lang")))))
    name = F.concat(F.lit(namespace + "hyp-"), slug(F.col("word")), F.lit("-to-"), slug(F.substring_index(F.col("trigger_id").cast("string"), "/", -1)))
    stub = _block(_iri(name), "CausalHypothesis", _said("drift:aboutDrift", _iri("event_id")), _said("drift:proposedTrigger", _iri("trigger_id")), _said("prov:wasInfluencedBy", _iri("trigger_id")))
    g = f.groupBy("trigger_id").agg(F.array_sort(F.collect_set(F.struct("word", "canon", word.alias("t")))).alias("w"), F.array_sort(F.collect_set(F.struct("word", "event_id", stub.alias("t")))).alias("h"))
    g = g.select(F.col("trigger_id").alias("id"), F.array_join(F.concat(F.col("w.t"), F.col("h.t")), "\n\n").alias("tail"))
    return t.join(g, "id", "left").select("id", F.concat_ws("\n\n", "head", "tail").alias("turtle"))


def word_json(e: Entities) -> DataFrame:
    """id, json: each merged word in full with its flat events."""
    f = flat(e).groupBy(F.col("canon").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("year", F.lit(0)).alias("ord"), "event_id", F.struct("word", "lang", "type", "year", "fromConn", "toConn", "hasTrigger", "causes", "source", "quality").alias("x")))).alias("x"))
    w = full_words(e)
    j = w.select("id", F.struct(*w.columns).alias("word")).join(f.select("id", F.col("x.x").alias("flatEvents")), "id", "left")
    return j.select("id", F.to_json(F.struct("word", "flatEvents", F.col("id").alias("datasetEntry")), {"ignoreNullFields": "false"}).alias("json"))


def trigger_json(e: Entities) -> DataFrame:
    """id, json: each trigger with the forms of the words that it affects."""
    i = impact(e).select(F.col("trigger").alias("trigger_id"), "words")
    t = e.trigger.join(i, "trigger_id", "left")
    trig = F.struct(F.col("trigger_id").alias("id"), "label", "date", "category", F.col("same_as").alias("wikidataSameAs"), "description")
    return t.select(F.col("trigger_id").alias("id"), F.to_json(F.struct(trig.alias("trigger"), F.col("words").alias("affectedWords"), F.col("trigger_id").alias("datasetEntry")), {"ignoreNullFields": "false"}).alias("json"))


def _q(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '' WHEN contains({c}, '\"') OR contains({c}, ',') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"


def sql(flat_: str, light: str) -> dict[str, str]:
    """Twins on the lens."""
    fields = " || ',' || ".join([_q("form"), _q("lang"), _q("source"), _q("quality"), _q("coalesce(types, '')"), "coalesce(CAST(y0 AS VARCHAR), '')", "coalesce(CAST(y1 AS VARCHAR), '')", "CASE WHEN has THEN 'true' ELSE 'false' END"])
    return {
        "csv_words": f", {flat_}, {light} SELECT id, {fields} AS line FROM light",
        "claims_ledger": ", x AS (SELECT event_id, trigger_id, string_agg(evidence, '; ' ORDER BY evidence) AS evidence FROM ev GROUP BY ALL), src AS (SELECT l_orderkey AS event_id, l_suppkey AS trigger_id, string_agg(DISTINCT 'S' || year(l_shipdate), '; ' ORDER BY 'S' || year(l_shipdate)) AS titles FROM lineitem GROUP BY ALL) SELECT h.event_id || '-' || h.trigger_id AS hypothesis_id, form AS word, lang AS language, CAST(sense_from AS VARCHAR) AS sense_from, CAST(sense_to AS VARCHAR) AS sense_to, type AS drift_type, year AS drift_year, label AS proposed_trigger, date AS trigger_date, category AS trigger_category, 'Q' || t.trigger_id AS wikidata_qid, evidence AS evidence_types, confidence, '' AS source_urls, titles AS source_titles, CAST(NULL AS VARCHAR) AS attributed_to, CAST(NULL AS VARCHAR) AS date FROM hyp h JOIN x ON x.event_id = h.event_id AND x.trigger_id = h.trigger_id JOIN event e ON e.event_id = h.event_id JOIN word w ON w.word_id = e.word_id JOIN trig t ON t.trigger_id = h.trigger_id JOIN es ON es.event_id = h.event_id JOIN src ON src.event_id = h.event_id AND src.trigger_id = h.trigger_id",
        "words_csv": "SELECT word_id, form AS written_form, lang AS language, coalesce(n, 0) AS n_senses FROM word LEFT JOIN (SELECT word_id, count(DISTINCT sense_id) AS n FROM (SELECT word_id, unnest([sense_from, sense_to]) AS sense_id FROM es JOIN event USING (event_id)) GROUP BY word_id) USING (word_id)",
        "triggers_csv": "SELECT trigger_id, label, date AS event_date, category, 'Q' || trigger_id AS wikidata_qid FROM trig",
    }
