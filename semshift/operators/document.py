"""The graph document: triggers, events, merged words, flat events with their causes, aggregates, facets; its core and detail halves and their sinks.

Everything is built from re-keyed entity tables and nested last. Rows that tie are told apart by their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import QUALITIES, SOURCES, decade, rank_in
from ..sources.lens import Entities
from ..sources.single import write_single
from .questions import connotations


def triggers(e: Entities) -> DataFrame:
    """id, label, date, category, wikidataSameAs, description, by date (none counts as 0)."""
    t = e.trigger.select(F.col("trigger_id").alias("id"), "label", "date", "category", F.col("same_as").alias("wikidataSameAs"), "description")
    return t.orderBy(F.coalesce("date", F.lit(0)), "id")


def drift_types(e: Entities) -> DataFrame:
    return e.drift_type.orderBy(F.coalesce("broaderLabel", F.lit("")), F.coalesce("label", F.lit("")), "id")


def drift_events(e: Entities) -> DataFrame:
    """id, wordId (as stated), senseFromId, senseToId, driftTypeLabel, driftTypeIds, year, yearEnd, confidence, triggerIds."""
    types = e.event_type.groupBy("event_id").agg(F.array_sort(F.collect_set("type_id")).alias("driftTypeIds"))
    trigs = e.pair.groupBy("event_id").agg(F.array_sort(F.collect_set("trigger_id")).alias("triggerIds"))
    j = e.event.join(e.event_label, "event_id", "left").join(types, "event_id", "left").join(trigs, "event_id", "left").join(e.event_sense, "event_id", "left")
    return j.select(
        F.col("event_id").alias("id"), F.col("word_id").alias("wordId"), F.col("sense_from").alias("senseFromId"), F.col("sense_to").alias("senseToId"), F.col("type").alias("driftTypeLabel"),
        F.coalesce("driftTypeIds", F.array().cast(types.schema["driftTypeIds"].dataType)).alias("driftTypeIds"), "year", F.col("year_end").alias("yearEnd"), "confidence",
        F.coalesce("triggerIds", F.array().cast(trigs.schema["triggerIds"].dataType)).alias("triggerIds"),
    )


def words_merged(e: Entities) -> DataFrame:
    """Words by (lower form, language): the lowest id stands for all, the best quality brings its source, sources unite."""
    g = e.word.groupBy(F.lower("form").alias("key"), "lang").agg(
        F.min("word_id").alias("id"), F.min_by("form", "word_id").alias("form"), F.count(F.lit(1)).alias("merged"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.min_by(F.struct("quality", "source"), F.struct(rank_in(F.col("quality"), QUALITIES), "word_id")).alias("best"),
    )
    return g.select("id", "form", "lang", "merged", "sources", F.col("best.quality").alias("quality"), F.col("best.source").alias("source"))


def word_dedup(e: Entities) -> DataFrame:
    return words_merged(e).withColumn("sources", F.array_join("sources", "; "))


def canonical(e: Entities) -> DataFrame:
    """raw word_id -> id of the word it is merged into."""
    ids = e.word.select(F.col("word_id").alias("id"), F.lower("form").alias("key"), "lang")
    least = ids.groupBy("key", "lang").agg(F.min("id").alias("canon"))
    return ids.alias("i").join(least.alias("l"), (F.col("i.key") == F.col("l.key")) & F.col("i.lang").eqNullSafe(F.col("l.lang"))).select(F.col("i.id").alias("word_id"), "canon")


def words_order(e: Entities) -> DataFrame:
    """Merged words, English ones first, then by form whatever its case."""
    w = words_merged(e)
    return w.orderBy(F.coalesce(F.col("lang") != "en", F.lit(True)), F.lower("form"), "id").select("id", "form", "lang")


def _keyed(e: Entities) -> DataFrame:
    """word_id, canon, form, lang, source, quality: each word with what it is merged into."""
    w = words_merged(e).select(F.col("id").alias("canon"), "form", "lang", "source", "quality")
    return canonical(e).join(w, "canon")


def causes(e: Entities) -> DataFrame:
    """event_id, causes: trigger label, year and category, evidence, confidence; most confident first (none counts as 0)."""
    t = e.trigger.select("trigger_id", "label", "date", "category")
    j = e.hypothesis.join(t, "trigger_id", "left")
    c = F.struct(
        (-F.coalesce("confidence", F.lit(0.0))).alias("ord"), "trigger_id", F.coalesce("label", F.substring_index(F.col("trigger_id").cast("string"), "/", -1)).alias("triggerLabel"),
        F.col("date").alias("triggerYear"), "category", "evidence", "confidence",
    )
    g = j.groupBy("event_id").agg(F.array_sort(F.collect_list(c)).alias("c"))
    return g.select("event_id", F.transform("c", lambda x: F.struct(*[x[n].alias(n) for n in ("triggerLabel", "triggerYear", "category", "evidence", "confidence")])).alias("causes"))


def flat(e: Entities, with_causes: bool = True) -> DataFrame:
    """event_id, canon, word, lang, type, year, fromConn, toConn, hasTrigger, source, quality and causes: a row for each event of a merged word."""
    j = e.event.select("event_id", "word_id", "year").join(_keyed(e), "word_id").join(e.event_label, "event_id", "left").join(connotations(e).select("event_id", "from_conn", "to_conn"), "event_id", "left")
    has = e.pair.select("event_id").distinct().withColumn("has", F.lit(True))
    j = j.join(has, "event_id", "left")
    if with_causes:
        j = j.join(causes(e), "event_id", "left")
    cols = ["event_id", "canon", F.col("form").alias("word"), F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("type", F.lit("unknown")).alias("type"), "year", F.col("from_conn").alias("fromConn"), F.col("to_conn").alias("toConn"), F.coalesce("has", F.lit(False)).alias("hasTrigger"), "source", "quality"]
    return j.select(*cols, *(["causes"] if with_causes else []))


def flat_events(e: Entities) -> DataFrame:
    """Flat events in order of year (none counts as 0) and word; causes as one text, label and confidence of each."""
    shown = F.array_join(F.transform("causes", lambda c: F.concat(c["triggerLabel"], F.lit(" "), F.coalesce(c["confidence"].cast("string"), F.lit("?")))), "; ")
    return flat(e).orderBy(F.coalesce("year", F.lit(0)), "word", "event_id").select("event_id", "word", "lang", "type", "year", "fromConn", "toConn", "hasTrigger", F.coalesce(shown, F.lit("")).alias("causes"), "source", "quality")


def _types(column: str | Column) -> Column:
    """The types of a joined label: split at commas, trimmed, none empty."""
    return F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda x: x != "")


def by_decade_type(e: Entities) -> DataFrame:
    d = flat(e, with_causes=False).where("year is not null").select(decade(F.col("year")).alias("decade"), F.explode(_types("type")).alias("type"))
    return d.groupBy("decade", "type").agg(F.count(F.lit(1)).alias("n"))


def impact(e: Entities) -> DataFrame:
    """trigger, label, year, category, wordCount, words: distinct forms of merged words for each trigger; triggers without words count 0."""
    forms = e.pair.join(e.event.select("event_id", "word_id"), "event_id").join(_keyed(e).select("word_id", "form"), "word_id").select("trigger_id", "form").distinct()
    g = forms.groupBy("trigger_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("form")).alias("words"))
    t = e.trigger.join(g, "trigger_id", "left")
    return t.select(F.col("trigger_id").alias("trigger"), "label", F.col("date").alias("year"), "category", F.coalesce("n", F.lit(0)).cast("long").alias("wordCount"), F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def trigger_impact(e: Entities) -> DataFrame:
    """The impact of triggers, most words first."""
    return impact(e).orderBy(F.desc("wordCount"), F.coalesce("year", F.lit(0)), "trigger").withColumn("words", F.array_join("words", ", "))


def facets(e: Entities) -> DataFrame:
    """facet, value, ord: the distinct values of each facet in its own order."""

    def one(name: str, df: DataFrame, col: str, order: tuple | None = None) -> DataFrame:
        d = df.select(F.col(col).alias("value")).where("value is not null").distinct()
        return d.select(F.lit(name).alias("facet"), "value", (rank_in(F.col("value"), order) if order else F.lit(0)).alias("k"))

    w = words_merged(e).select(F.coalesce("lang", F.lit("?")).alias("lang"), "source", "quality")
    senses = e.sense.join(e.word_sense.select("sense_id").distinct(), "sense_id", "left_semi")
    types = e.event.select("event_id", "word_id").join(canonical(e), "word_id", "left_semi").join(e.event_label, "event_id", "left").select(F.coalesce("type", F.lit("unknown")).alias("type")).distinct()
    parts = [one("language", w, "lang"), one("driftType", types.select(F.explode(_types("type")).alias("type")), "type"), one("connotation", senses, "connotation"), one("evidenceType", e.evidence_type, "label"), one("source", w, "source", SOURCES), one("quality", w, "quality", QUALITIES)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("facet", "value", F.row_number().over(Window.partitionBy("facet").orderBy("k", "value")).alias("ord"))  # labels of vocabularies


def meta_counts(e: Entities) -> DataFrame:
    """facet, value, n: merged words by language (none is ?), source and quality; and the totals."""
    w = words_merged(e).select(F.coalesce("lang", F.lit("?")).alias("lang"), "source", "quality", "merged")
    cols = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(c).alias("value")) for f, c in (("byLanguage", "lang"), ("bySource", "source"), ("byQuality", "quality"))]))
    by = w.select(cols.alias("x")).groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"))
    sums = w.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum(F.col("merged") - 1), F.lit(0)).alias("mergedDuplicates")).select(F.explode(F.create_map(F.lit("words"), "words", F.lit("mergedDuplicates"), "mergedDuplicates")).alias("value", "n"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("value"), "n")
    events = e.event.select("word_id").join(canonical(e), "word_id", "left_semi")
    totals = sums.unionByName(one(e.word_node, "rawWordNodes")).unionByName(one(events, "driftEvents")).unionByName(one(e.trigger, "triggers"))
    return by.unionByName(totals.select(F.lit("totals").alias("facet"), "value", "n"))


def xling_symmetric(e: Entities) -> DataFrame:
    """Cross-lingual links between merged words, both ways, without self-links."""
    c = canonical(e)
    x = e.xling.join(c.select(F.col("word_id").alias("a"), F.col("canon").alias("ca")), "a").join(c.select(F.col("word_id").alias("b"), F.col("canon").alias("cb")), "b").select("ca", "cb")
    both = x.unionByName(x.select(F.col("cb").alias("ca"), F.col("ca").alias("cb")))
    return both.where("ca <> cb").select(F.col("ca").alias("word_id"), F.col("cb").alias("other_id")).distinct()


def freq_series(e: Entities) -> DataFrame:
    """id, year, value of merged words: where several of its words have a year, that of the lowest id; a word's own repeated years stay."""
    f = e.frequency.where("year is not null and value is not null").join(canonical(e), "word_id")
    first = f.groupBy("canon", "year").agg(F.min("word_id").alias("word_id"))
    return f.join(first, ["canon", "year", "word_id"]).select(F.col("canon").alias("id"), "year", "value")


def words_light(e: Entities) -> DataFrame:
    """id, writtenForm, language, source, quality, sources, driftTypeLabels, yearStart, yearEnd, hasTrigger: what the first view of a word needs.

    The years are those of its senses, events and frequencies. Events, senses and frequencies are reduced before they meet.
    """
    c = canonical(e)
    has = e.pair.select("event_id").distinct().withColumn("has", F.lit(True))
    ev = e.event.select("event_id", "word_id", "year", "year_end").join(c, "word_id").join(e.event_label, "event_id", "left").join(has, "event_id", "left")
    ev = ev.groupBy(F.col("canon").alias("id")).agg(F.min(F.least("year", "year_end")).alias("e0"), F.max(F.greatest("year", "year_end")).alias("e1"), F.coalesce(F.bool_or("has"), F.lit(False)).alias("has"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(_types("type"))))).alias("types"))
    s = e.word_sense.join(c, "word_id").join(e.sense.select("sense_id", F.least("first_attested", "att_begin", "att_end").alias("y0"), F.greatest("first_attested", "att_begin", "att_end").alias("y1")), "sense_id")
    s = s.groupBy(F.col("canon").alias("id")).agg(F.min("y0").alias("s0"), F.max("y1").alias("s1"))
    f = e.frequency.join(c, "word_id").groupBy(F.col("canon").alias("id")).agg(F.min("year").alias("f0"), F.max("year").alias("f1"))
    j = words_merged(e).join(ev, "id", "left").join(s, "id", "left").join(f, "id", "left")
    return j.select(
        "id", F.col("form").alias("writtenForm"), F.col("lang").alias("language"), "source", "quality", "sources", F.coalesce("types", F.array().cast("array<string>")).alias("driftTypeLabels"),
        F.least("e0", "s0", "f0").alias("yearStart"), F.greatest("e1", "s1", "f1").alias("yearEnd"), F.coalesce("has", F.lit(False)).alias("hasTrigger"),
    )


def word_span(e: Entities) -> DataFrame:
    return words_light(e).select("id", "writtenForm", "language", "source", "quality", F.array_join("driftTypeLabels", "; ").alias("driftTypeLabels"), "yearStart", "yearEnd", "hasTrigger")


def detail(e: Entities) -> DataFrame:
    """id, senses, driftEvents, frequencyObservations, sources, crossLingualOf of each merged word, in order of year (none counts as 0)."""
    c = canonical(e)
    key = lambda year, i: (F.coalesce(year, F.lit(0)).alias("ord"), F.col(i).alias("tie"))
    bare = lambda col, names: F.transform(col, lambda x: F.struct(*[x[n].alias(n) for n in names]))
    s_names = ["id", "glossEn", "connotation", "connotationId", "firstAttested", "attestedIntervalStart", "attestedIntervalEnd"]
    s = e.word_sense.join(c, "word_id").select("canon", "sense_id").distinct().join(e.sense, "sense_id", "left")
    s = s.select("canon", F.struct(*key("first_attested", "sense_id"), F.col("sense_id").alias("id"), F.col("gloss").alias("glossEn"), "connotation", F.col("connotation_id").alias("connotationId"), F.col("first_attested").alias("firstAttested"), F.col("att_begin").alias("attestedIntervalStart"), F.col("att_end").alias("attestedIntervalEnd")).alias("x"))
    s = s.groupBy(F.col("canon").alias("id")).agg(bare(F.array_sort(F.collect_list("x")), s_names).alias("senses"))
    d = drift_events(e)
    ev = d.join(c, d.wordId == c.word_id).select("canon", F.struct(*key("year", "id"), *d.columns).alias("x"))
    ev = ev.groupBy(F.col("canon").alias("id")).agg(bare(F.array_sort(F.collect_list("x")), d.columns).alias("driftEvents"))
    f = freq_series(e).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("year", "value"))).alias("frequencyObservations"))
    x = xling_symmetric(e).groupBy(F.col("word_id").alias("id")).agg(F.array_sort(F.collect_set("other_id")).alias("crossLingualOf"))
    j = words_merged(e).select("id", "sources").join(s, "id", "left").join(ev, "id", "left").join(f, "id", "left").join(x, "id", "left")
    some = lambda n: F.coalesce(n, F.array().cast(j.schema[n].dataType)).alias(n)
    return j.select("id", *[some(n) for n in ("senses", "driftEvents", "frequencyObservations", "sources", "crossLingualOf")])


def core_words(e: Entities) -> DataFrame:
    return words_light(e).join(detail(e).select("id", "crossLingualOf"), "id")


def full_words(e: Entities) -> DataFrame:
    """Core words with all their detail."""
    return words_light(e).join(detail(e).drop("sources"), "id")


def flat_document(e: Entities) -> DataFrame:
    return flat(e).orderBy(F.coalesce("year", F.lit(0)), "word", "event_id").select("word", "lang", "type", "year", "fromConn", "toConn", "hasTrigger", "causes", "source", "quality")


def _common(e: Entities) -> dict[str, DataFrame]:
    return {"meta": meta_counts(e), "driftTypes": drift_types(e), "facets": facets(e), "byDecadeType": by_decade_type(e).orderBy("decade", "type"), "triggerImpact": impact(e).orderBy(F.desc("wordCount"), F.coalesce("year", F.lit(0)), "trigger"), "triggers": triggers(e), "driftEventsFlat": flat_document(e)}


def documents(e: Entities) -> dict[str, dict[str, DataFrame]]:
    """The parts of the core, detail and full document. Words are in their order; detail is keyed by word id."""
    order = [F.coalesce(F.col("language") != "en", F.lit(True)), F.lower("writtenForm"), "id"]
    common = _common(e)
    return {"core": common | {"words": core_words(e).orderBy(*order)}, "detail": {"words": detail(e).drop("crossLingualOf")}, "full": common | {"words": full_words(e).orderBy(*order)}}


def write_documents(e: Entities, path: str) -> None:
    """core, detail and full as folders of JSON lines, one for each part, written where the data are."""
    for name, parts in documents(e).items():
        for part, df in parts.items():
            df.write.json(f"{path}/{name}/{part}", ignoreNullFields=False)


def write_document(e: Entities, path: str, which: str = "core") -> None:
    """The core, detail or full document as one JSON file: an object of lists, or for detail of words by id. Rows are written where they are."""
    as_json = lambda df: df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))
    parts = documents(e)[which]
    spark = e.word.sparkSession
    if which == "detail":
        words = parts["words"]
        key = F.to_json(F.array(F.col("id").cast("string")))
        line = F.concat(F.expr("substring(k, 2, length(k) - 2)"), F.lit(":"), F.to_json(F.struct(*[c for c in words.columns if c != "id"]), {"ignoreNullFields": "false"}))
        write_single(spark, path, ["{\n", words.withColumn("k", key).select(line.alias("line")), "\n}\n"])
        return
    total = lambda n: F.coalesce(F.max(F.when((F.col("facet") == "totals") & (F.col("value") == n), F.col("n"))), F.lit(0)).alias(n)
    by = lambda n: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("facet") == n, F.struct("value", "n"))))).alias(n)
    meta = parts["meta"].agg(*map(total, ("words", "rawWordNodes", "mergedDuplicates", "driftEvents", "triggers")), *map(by, ("byLanguage", "bySource", "byQuality")))
    values = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("facet") == n, F.struct("ord", "value")))), lambda x: x["value"]).alias(n)
    facet = parts["facets"].agg(*map(values, ("language", "driftType", "connotation", "evidenceType", "source", "quality")))
    pieces: list = ['{\n"meta":', as_json(meta), ',\n"facets":', as_json(facet)]
    for name, df in parts.items():
        if name not in ("meta", "facets"):
            pieces += [f',\n"{name}":[\n', as_json(df), "\n]"]
    write_single(spark, path, [*pieces, "\n}\n"])


def single_document(e: Entities, which: str = "core") -> dict:
    """The core, detail or full document as one object on the driver, for graphs that a browser can load anyway."""
    parts = {k: [r.asDict(recursive=True) for r in df.collect()] for k, df in documents(e)[which].items()}
    if which == "detail":
        return {r.pop("id"): r for r in parts["words"]}
    meta: dict = {}
    for r in parts["meta"]:
        if r["facet"] == "totals":
            meta[r["value"]] = r["n"]
        else:
            meta.setdefault(r["facet"], {})[r["value"]] = r["n"]
    kinds: dict[str, list] = {n: [] for n in ("language", "driftType", "connotation", "evidenceType", "source", "quality")}
    for r in sorted(parts["facets"], key=lambda r: r["ord"]):
        kinds[r["facet"]].append(r["value"])
    return parts | {"meta": meta, "facets": kinds}


_FLAT = "flat AS (SELECT e.event_id, c.canon, m.form AS word, m.lang, type, year, year_end, f.connotation AS fc, t.connotation AS tc, h.event_id IS NOT NULL AS has, m.source, m.quality FROM event e JOIN canon c ON c.word_id = e.word_id JOIN merged m ON m.id = c.canon LEFT JOIN es ON es.event_id = e.event_id LEFT JOIN sense f ON f.sense_id = sense_from LEFT JOIN sense t ON t.sense_id = sense_to LEFT JOIN (SELECT DISTINCT event_id FROM hyp) h ON h.event_id = e.event_id)"
_LIGHT = "light AS (SELECT id, form, lang, source, quality, y0, y1, has, types FROM merged LEFT JOIN (SELECT canon AS id, min(y) AS y0, max(y) AS y1 FROM (SELECT word_id, year AS y FROM event UNION ALL SELECT word_id, year_end FROM event UNION ALL SELECT word_id, year FROM freq UNION ALL SELECT word_id, first_attested FROM (SELECT DISTINCT word_id, unnest([sense_from, sense_to]) AS sense_id FROM es JOIN event USING (event_id)) JOIN sense USING (sense_id)) JOIN canon USING (word_id) GROUP BY canon) USING (id) LEFT JOIN (SELECT canon AS id, bool_or(has) AS has, string_agg(DISTINCT type, '; ' ORDER BY type) AS types FROM flat GROUP BY canon) USING (id))"
_IMPACT = "impact AS (SELECT t.trigger_id AS trigger, label, date AS year, category, count(DISTINCT m.form) AS n, coalesce(string_agg(DISTINCT m.form, ', ' ORDER BY m.form), '') AS words FROM trig t LEFT JOIN (hyp JOIN event USING (event_id) JOIN canon USING (word_id) JOIN merged m ON m.id = canon) ON hyp.trigger_id = t.trigger_id GROUP BY ALL)"
_XLING = "twoway AS (SELECT x.canon AS a, y.canon AS b FROM xling JOIN canon x ON x.word_id = a JOIN canon y ON y.word_id = b), sym AS (SELECT a AS word_id, b AS other_id FROM twoway WHERE a <> b UNION SELECT b, a FROM twoway WHERE a <> b)"

SQL = {
    "word_dedup": "SELECT id, form, lang, merged, sources, quality, source FROM merged",
    "words_order": "SELECT id, form, lang FROM merged ORDER BY lang <> 'en', lower(form), id",
    "flat_events": f", {_FLAT} SELECT flat.event_id, word, lang, type, year, fc AS \"fromConn\", tc AS \"toConn\", has AS \"hasTrigger\", coalesce(causes, '') AS causes, source, quality FROM flat LEFT JOIN (SELECT event_id, string_agg(label || ' ' || CAST(confidence AS VARCHAR), '; ' ORDER BY confidence DESC, trigger_id) AS causes FROM hyp JOIN trig USING (trigger_id) GROUP BY event_id) c ON c.event_id = flat.event_id",
    "by_decade_type": "SELECT CAST(floor(year / 10.0) * 10 AS INT) AS decade, type, count(*) AS n FROM event GROUP BY ALL",
    "trigger_impact": f", {_IMPACT} SELECT trigger, label, year, category, n AS \"wordCount\", words FROM impact",
    "facets": ", v AS (SELECT DISTINCT 'language' AS facet, lang AS value, 0 AS k FROM merged UNION SELECT DISTINCT 'driftType', type, 0 FROM event UNION SELECT DISTINCT 'connotation', connotation, 0 FROM sense WHERE sense_id IN (SELECT unnest([sense_from, sense_to]) FROM es JOIN event USING (event_id)) UNION SELECT unnest(['evidenceType', 'evidenceType', 'evidenceType', 'evidenceType', 'evidenceType']), unnest(['ScholarlyAttestation', 'LexicographicNote', 'ChangeSignalAlignment', 'FrequencyCorrelation', 'Speculative']), 0 UNION SELECT DISTINCT 'source', source, list_position(['Curated', 'GfdS', 'OWID', 'DWUG', 'SemEval', 'Frequency'], source) FROM merged UNION SELECT DISTINCT 'quality', quality, list_position(['high', 'benchmark', 'detected'], quality) FROM merged) SELECT facet, value, CAST(row_number() OVER (PARTITION BY facet ORDER BY k, value) AS INT) AS ord FROM v WHERE value IS NOT NULL",
    "meta_counts": "SELECT 'byLanguage' AS facet, lang AS value, count(*) AS n FROM merged GROUP BY ALL UNION ALL SELECT 'bySource', source, count(*) FROM merged GROUP BY ALL UNION ALL SELECT 'byQuality', quality, count(*) FROM merged GROUP BY ALL UNION ALL SELECT 'totals', 'words', count(*) FROM merged UNION ALL SELECT 'totals', 'rawWordNodes', count(*) FROM customer UNION ALL SELECT 'totals', 'mergedDuplicates', (SELECT count(*) FROM customer) - (SELECT count(*) FROM merged) UNION ALL SELECT 'totals', 'driftEvents', count(*) FROM event JOIN word USING (word_id) UNION ALL SELECT 'totals', 'triggers', count(*) FROM trig",
    "freq_series": "SELECT c.canon AS id, f.year, f.value FROM freq f JOIN canon c USING (word_id) WHERE NOT EXISTS (SELECT 1 FROM freq g JOIN canon d USING (word_id) WHERE d.canon = c.canon AND g.year = f.year AND g.word_id < f.word_id)",
    "word_span": f", {_FLAT}, {_LIGHT} SELECT id, form AS \"writtenForm\", lang AS language, source, quality, coalesce(types, '') AS \"driftTypeLabels\", y0 AS \"yearStart\", y1 AS \"yearEnd\", coalesce(has, false) AS \"hasTrigger\" FROM light",
    "xling_symmetric": f", {_XLING} SELECT word_id, other_id FROM sym",
}
