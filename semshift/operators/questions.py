"""The twelve competency questions over the entity tables.

Labels that a question asks for are English ones; where it needs a label, rows without one are dropped. Years of events are
their own, not an interval's. Every answer is ordered, with ids as the last keys, so that reruns agree; cq04, whose rows are very many, by all that it shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ladder, local_after
from ..sources.lens import Entities


def _joined(values: str, sep: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(values)), sep)


def _written(e: Entities) -> DataFrame:
    """word_id, word of the words that have a written form."""
    return e.word.where("written is not null").select("word_id", F.col("written").alias("word"))


def cq01(e: Entities, limit: int = 10) -> DataFrame:
    """Triggers by number of distinct words that their hypotheses reach. Forms are joined for the ones that are listed only."""
    claims = e.claim.select("event_id", "trigger_id").distinct()
    pairs = claims.join(e.event.select("event_id", "word_id"), "event_id").select("trigger_id", "word_id").distinct().join(_written(e), "word_id", "left_semi")
    best = pairs.groupBy("trigger_id").agg(F.count(F.lit(1)).alias("wordCount"))
    best = best.join(e.trigger.select("trigger_id", F.col("label_en").alias("triggerLabel"), F.col("date").alias("eventYear")), "trigger_id", "left")
    best = best.orderBy(F.desc("wordCount"), "eventYear", "triggerLabel", "trigger_id").limit(limit)
    forms = pairs.join(F.broadcast(best.select("trigger_id")), "trigger_id").join(_written(e), "word_id")  # `limit` rows
    words = forms.groupBy("trigger_id").agg(_joined("word", ", ").alias("words"))
    return best.join(words, "trigger_id").orderBy(F.desc("wordCount"), "eventYear", "triggerLabel", "trigger_id").select("triggerLabel", "eventYear", "wordCount", "words")


def cq02(e: Entities, word: str | None = "w7") -> DataFrame:
    """A row for each hypothesis and evidence type about one written form; about every form for None."""
    w = _written(e) if word is None else _written(e).where(F.col("word") == F.lit(word))
    j = e.event.select("event_id", "word_id").join(w, "word_id").join(e.claim.where("confidence is not null").select("hyp_id", "event_id", "trigger_id", "confidence", F.explode("evidence_en").alias("evidence")), "event_id")
    j = j.join(e.trigger.where("label_en is not null").select("trigger_id", F.col("label_en").alias("trigger")), "trigger_id")
    return j.orderBy(F.desc("confidence"), "evidence", "hyp_id").select("word", "trigger", "evidence", "confidence")


def cq03(e: Entities) -> DataFrame:
    """Hypotheses by trigger category and drift type; what has no label vanishes."""
    t = e.trigger.where("category_en is not null").select("trigger_id", F.col("category_en").alias("category"))
    j = e.claim.select("event_id", "trigger_id").join(t, "trigger_id").join(e.event_type.where("type_en is not null").select("event_id", F.col("type_en").alias("driftType")), "event_id")
    return j.groupBy("category", "driftType").agg(F.count(F.lit(1)).alias("n")).orderBy("category", F.desc("n"), "driftType")


def _typed(e: Entities) -> DataFrame:
    """type_id, label, word_id, word, lang, year of every event of a word that has form and language."""
    w = e.word.where("written is not null and lang is not null").select("word_id", F.col("written").alias("word"), "lang")
    return e.event.select("event_id", "word_id", F.col("drift_year").alias("year")).join(e.event_type.select("event_id", "type_id", F.col("type_en").alias("label")), "event_id").join(w, "word_id")


#: Like pairs that are made at once; parts that words, and the pairs' numbers, are dealt into; parts that a type's events are dealt into
#: where like pairs are counted, so that no join has a task a type.
RUN, PARTS, DEALT = 1024, 256, 32


def _side(typed: DataFrame, k: int) -> DataFrame:
    return typed.select("type_id", F.col("word_id").alias(f"i{k}"), F.col("word").alias(f"word{k}"), F.col("lang").alias(f"lang{k}"), F.col("year").alias(f"year{k}"), F.col("label").alias(f"label{k}"))


def _placed(e: Entities) -> DataFrame:
    """word_id, word, lang of the words that have both, under each written form: place, the number of the form's words whose ids come
    before it as texts, last, the number of them all, and own, whether it is one of them. Words are dealt into parts, which the form's
    words all go to."""
    w = e.word.where("written is not null and lang is not null").select("word_id", F.col("written").alias("word"), "lang", F.col("word_id").cast("string").alias("text"))
    words = w.select("text").distinct().crossJoin(w.select(F.col("word").alias("form")).distinct())
    words = words.select("form", F.pmod(F.xxhash64("text"), F.lit(PARTS)).cast("int").alias("part"), "text", F.lit(0).alias("mark"))
    marks = w.select(F.col("word").alias("form"), "text").distinct().select("form", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), "text", F.lit(1).alias("mark"))
    by = Window.partitionBy("form", "part").orderBy("text", "mark")  # a word, then the mark of its own
    places = words.unionByName(marks).select("form", "text", "mark", F.sum("mark").over(by).alias("place"), F.sum("mark").over(Window.partitionBy("form", "part")).alias("last"), F.coalesce(F.lead("text").over(by) == F.col("text"), F.lit(False)).alias("own"))
    return w.join(places.where("mark = 0").drop("mark"), "text").drop("text")


def _counted(e: Entities) -> DataFrame:
    """The pairs of cq04 under each written form of theirs (form), those that read alike as their number, n, in runs of RUN at most (run).

    Pairs are not made to be counted: an event precedes or follows as many of a form's events of one type, language and year as its
    word's place tells.
    """
    x = e.event.select("event_id", "word_id", F.col("drift_year").alias("year")).join(_placed(e), "word_id")
    x = x.join(e.event_type.select("event_id", "type_id", F.col("type_en").alias("label")), "event_id")
    kind = ["form", "type_id", "label", "lang", "year"]
    n = x.where("word = form").groupBy(*kind, "last", "place").agg(F.count(F.lit(1)).alias("n"))
    none = n.select(*kind, "last").distinct().select(*kind, F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("place"), F.lit(0).cast("long").alias("n"))
    n = n.drop("last").unionByName(none).groupBy(*kind, "place").agg(F.sum("n").alias("n"))
    n = n.withColumn("until", F.sum("n").over(Window.partitionBy(*kind).orderBy("place")))
    y = n.groupBy(*kind).agg(F.array_sort(F.collect_list(F.struct("place", "until", "n"))).alias("at"), F.sum("n").alias("all"))
    y = y.select("form", "type_id", *[F.col(c).alias("y_" + c) for c in ("label", "lang", "year")], F.col("at.until").alias("until"), F.col("at.n").alias("n"), "all", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("part"))
    x = x.withColumn("part", F.pmod(F.xxhash64("word", "lang", "year"), F.lit(DEALT)).cast("int"))
    j = x.join(y.hint("shuffle_hash"), ["form", "type_id", "part"]).where("lang <> y_lang")
    at = lambda c: F.get(c, F.col("place").cast("int"))
    before = F.when(F.col("word") == F.col("form"), 0).otherwise(at("until") - at("n"))  # both ends have the form: the pair is there the other way round
    after = F.col("all") - at("until") + F.when(F.col("own"), 0).otherwise(at("n"))
    c = j.groupBy("form", "label", "word", "lang", "year", "y_label", "y_lang", "y_year").agg(F.sum(after).alias("after"), F.sum(before).alias("before"))
    side = lambda k, label, word, lang, year: [F.col(a).alias(f"{b}{k}") for a, b in ((label, "label"), (word, "word"), (lang, "lang"), (year, "year"))]
    ends = (("label", "word", "lang", "year"), ("y_label", "form", "y_lang", "y_year"))
    both = F.array(*[F.struct(F.col(m).alias("n"), *side(1, *first), *side(2, *second)) for m, first, second in (("after", *ends), ("before", *ends[::-1]))])
    c = c.select("form", F.explode(both).alias("p")).select("form", "p.*").where("n > 0")
    c = c.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))).alias("run"))
    return c.withColumn("n", F.least(F.lit(RUN), F.col("n") - F.col("run") * RUN).cast("int"))


def pairs_by_form(e: Entities) -> DataFrame:
    """The pairs of cq04 under each written form of theirs (form): to be filtered by it, which reaches its words before any join.

    Pairs that read alike are counted, not made one by one. A row for each pair comes of these numbers at the end.
    """
    c = _counted(e)
    c = c.repartition(PARTS, *c.columns)  # many like pairs are made by many tasks
    return c.select(*[x for x in c.columns if x not in ("n", "run")], F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("one")).drop("one")


def cq04(e: Entities, word: str | None = None) -> DataFrame:
    """Pairs of events of one type whose words are of different languages, each pair once, the lesser word id first.

    As many rows as there are pairs, so quadratic in a type's events; with `word` only pairs in which that form takes part.
    Ordered by all that is shown, so that no tie of unlike rows is left. `cq04_classes` says the same in one row for each event.
    """
    shown = [F.col("label1").alias("driftTypeLabel"), "word1", "lang1", "year1", "word2", "lang2", "year2"]
    order = ("label1", "lang1", "word1", "year1", "word2", "lang2", "year2")
    if word is None:
        x = _typed(e)
        j = _side(x, 1).join(_side(x, 2), "type_id").where("lang1 <> lang2 and cast(i1 as string) < cast(i2 as string)")
        return j.orderBy(*order).select(*shown)
    c = _counted(e).where(F.col("form") == F.lit(word)).select(*order, "n", "run")
    c = c.repartitionByRange(PARTS, *order, "run").sortWithinPartitions(*order)  # numbers are sent and ordered, not pairs; each range makes its own
    c = c.withColumn("years2", F.array_repeat("year2", F.col("n"))).drop("year2")
    return c.withColumn("year2", F.explode("years2")).select(*shown)


def cq04_classes(e: Entities) -> DataFrame:
    """The pairs of cq04 as classes: a row for each event of a type, with the number of the type's events in other languages.

    Each event pairs with all events of its type in other languages, and with no other one, so no pair is lost: those of an event are
    the rows of its type whose language differs.
    """
    x = _typed(e)
    n = x.groupBy("type_id", "lang").agg(F.count(F.lit(1)).alias("n"))
    all_ = n.groupBy("type_id").agg(F.sum("n").alias("all"))
    other = n.join(all_, "type_id").select("type_id", "lang", (F.col("all") - F.col("n")).alias("partners"))
    return x.join(F.broadcast(other), ["type_id", "lang"]).select(F.col("label").alias("driftTypeLabel"), "word_id", "word", "lang", "year", "partners")  # types x languages


def connotations(e: Entities) -> DataFrame:
    """event_id, from_conn, to_conn (labels to show), from_key, to_key (what concept), from_en, to_en."""
    key = F.lower(F.element_at(F.split(F.col("connotation_id").cast("string"), "[#/]"), -1))
    s = e.sense.select("sense_id", "connotation", key.alias("key"), "connotation_en")
    side = lambda k: s.select(F.col("sense_id").alias(f"sense_{k}"), F.col("connotation").alias(f"{k}_conn"), F.col("key").alias(f"{k}_key"), F.col("connotation_en").alias(f"{k}_en"))
    j = e.event_sense.join(side("from"), "sense_from", "left").join(side("to"), "sense_to", "left")
    return j.select("event_id", "from_conn", "to_conn", "from_key", "to_key", "from_en", "to_en")


def cq05(e: Entities) -> DataFrame:
    """Events whose connotation turned from positive to negative or back."""
    turned = "(from_key = 'positive' and to_key = 'negative') or (from_key = 'negative' and to_key = 'positive')"
    j = connotations(e).where(turned).where("from_en is not null and to_en is not null").join(e.event.select("event_id", "word_id", F.col("drift_year").alias("year")), "event_id").join(_written(e), "word_id")
    return j.orderBy("year", "word", "event_id").select("word", F.col("from_en").alias("fromConn"), F.col("to_en").alias("toConn"), "year")


def cq06(e: Entities, year_from: int = 1900, year_to: int = 1999) -> DataFrame:
    """Triggers dated within the years, both included, with the number of distinct words; those without words stay."""
    t = e.trigger.where(F.col("date").between(year_from, year_to)).select("trigger_id", F.col("label_en").alias("triggerLabel"), F.col("date").alias("year"), F.col("category_en").alias("category"))
    words = e.claim.select("event_id", "trigger_id").distinct().join(e.event.select("event_id", "word_id"), "event_id").select("trigger_id", "word_id").distinct().groupBy("trigger_id").agg(F.count(F.lit(1)).alias("words"))
    return t.join(words, "trigger_id", "left").orderBy("year", "triggerLabel", "trigger_id").select("triggerLabel", "year", "category", F.coalesce("words", F.lit(0)).cast("long").alias("words"))


def cq07(e: Entities) -> DataFrame:
    """Hypotheses with no evidence but speculation, or none at all."""
    weak = e.claim.where(F.col("confidence").isNotNull() & ~F.exists("evidence", lambda x: x != "Speculative"))
    j = weak.join(e.event.select("event_id", "word_id"), "event_id").join(_written(e), "word_id")
    name = F.col("hyp_id").cast("string")
    shown = F.when(name.contains("/"), local_after(name, "resource/")).otherwise(name)
    return j.orderBy(F.desc("confidence"), "word", "hyp_id").select(shown.alias("hypothesis"), "word", "confidence")


def cq08(e: Entities) -> DataFrame:
    """The strongest evidence rank of each written form."""
    best = F.array_max(F.transform("evidence", ladder))
    r = e.claim.where(F.size("evidence") > 0).select("event_id", best.alias("rank")).groupBy("event_id").agg(F.max("rank").alias("rank"))
    j = r.join(e.event.select("event_id", "word_id"), "event_id").join(_written(e), "word_id")
    return j.groupBy("word").agg(F.max("rank").alias("strongestTier")).orderBy(F.desc("strongestTier"), "word")


def cq09(e: Entities) -> DataFrame:
    """Events with several triggers, by event and form, and their confidences."""
    g = e.claim.where("confidence is not null").groupBy("event_id").agg(F.countDistinct("trigger_id").alias("nTriggers"), F.min("confidence").alias("minConf"), F.max("confidence").alias("maxConf")).where("nTriggers > 1")
    j = g.join(e.event.select("event_id", "word_id"), "event_id").join(_written(e), "word_id")
    return j.orderBy(F.desc("nTriggers"), "word", "event_id").select("word", "nTriggers", "minConf", "maxConf")


def cq10(e: Entities) -> DataFrame:
    """The timeline of senses of each word: those with an English gloss and a connotation with an English label."""
    s = e.sense.where("gloss_en is not null and connotation_en is not null")
    j = e.word_sense.join(_written(e), "word_id").join(s, "sense_id")
    return j.orderBy("word", "first_attested", "sense_id").select("word", F.col("first_attested").alias("year"), F.col("connotation_en").alias("connotation"), F.col("gloss_en").alias("gloss"))


def cq11(e: Entities, drift_type: str | None = "1-URGENT") -> DataFrame:
    """Words with events of one type; hypothesis, trigger, confidence and label together or not at all. For None every type, as a column `type`."""
    local = F.element_at(F.split("type_id", "[#/]"), -1)
    if drift_type is None:
        ev = e.event.join(e.event_type.select("event_id", local.alias("type")).distinct(), "event_id")
    else:
        ev = e.event.join(e.event_type.where(local == F.lit(drift_type)), "event_id", "left_semi")
    named = [] if drift_type is not None else ["type"]
    ev = ev.select(*named, "event_id", "word_id", F.col("drift_year").alias("year")).join(_written(e), "word_id")
    h = e.claim.where("confidence is not null").select("hyp_id", "event_id", "trigger_id", "confidence").join(e.trigger.where("label_en is not null").select("trigger_id", F.col("label_en").alias("triggerLabel")), "trigger_id")
    return ev.join(h, "event_id", "left").orderBy("year", "word", "event_id", "hyp_id").select("word", "year", "triggerLabel", "confidence", *named)


def cq12(e: Entities) -> DataFrame:
    """Distinct sources of each event and form, with their titles."""
    g = e.event_source.groupBy("event_id").agg(F.countDistinct("source_id").alias("nSources"), _joined("title", " | ").alias("sources"))
    j = g.join(e.event.select("event_id", "word_id"), "event_id").join(_written(e), "word_id")
    return j.orderBy(F.desc("nSources"), "word", "event_id").select("word", "nSources", "sources")


_RANK = "CASE evidence WHEN 'ScholarlyAttestation' THEN 5 WHEN 'LexicographicNote' THEN 4 WHEN 'ChangeSignalAlignment' THEN 3 WHEN 'FrequencyCorrelation' THEN 2 WHEN 'Speculative' THEN 1 ELSE 0 END"
_TYPED = "x AS (SELECT type, w.word_id, form, lang, drift_year AS year, event_id FROM event e JOIN word w USING (word_id))"

#: SQL twins, after the lens's common table expressions.
SQL = {
    "cq01": ", b AS (SELECT trigger_id, label, date, count(DISTINCT e.word_id) AS n, string_agg(DISTINCT form, ', ' ORDER BY form) AS words FROM hyp h JOIN event e USING (event_id) JOIN word w ON e.word_id = w.word_id JOIN trig t USING (trigger_id) GROUP BY trigger_id, label, date) SELECT label AS \"triggerLabel\", date AS \"eventYear\", n AS \"wordCount\", words FROM b ORDER BY n DESC, date, label, trigger_id LIMIT 10",
    "cq02": "SELECT form AS word, label AS trigger, evidence, confidence FROM hyp JOIN ev USING (event_id, trigger_id) JOIN event e USING (event_id) JOIN word w ON e.word_id = w.word_id JOIN trig USING (trigger_id) WHERE form = 'w7'",
    "cq03": "SELECT category, type AS \"driftType\", count(*) AS n FROM hyp JOIN trig USING (trigger_id) JOIN event USING (event_id) WHERE category IS NOT NULL GROUP BY ALL",
    "cq04": f", {_TYPED} SELECT a.type AS \"driftTypeLabel\", a.word_id, a.form AS word, a.lang, a.year, (SELECT count(*) FROM x b WHERE a.type = b.type AND a.lang <> b.lang) AS partners FROM x a",
    "cq04_word": f", {_TYPED} SELECT a.type AS \"driftTypeLabel\", a.form AS word1, a.lang AS lang1, a.year AS year1, b.form AS word2, b.lang AS lang2, b.year AS year2 FROM x a JOIN x b ON a.type = b.type AND a.lang <> b.lang AND CAST(a.word_id AS VARCHAR) < CAST(b.word_id AS VARCHAR) WHERE a.form = 'w7' OR b.form = 'w7'",
    "cq05": "SELECT form AS word, f.connotation AS \"fromConn\", t.connotation AS \"toConn\", drift_year AS year FROM es JOIN sense f ON f.sense_id = sense_from JOIN sense t ON t.sense_id = sense_to JOIN event e USING (event_id) JOIN word w ON e.word_id = w.word_id WHERE (f.connotation, t.connotation) IN (('positive', 'negative'), ('negative', 'positive'))",
    "cq06": "SELECT label AS \"triggerLabel\", date AS year, category, count(DISTINCT word_id) AS words FROM trig LEFT JOIN (hyp JOIN event USING (event_id)) USING (trigger_id) WHERE date BETWEEN 1900 AND 1999 GROUP BY trigger_id, label, date, category",
    "cq07": "SELECT h.event_id || '-' || h.trigger_id AS hypothesis, form AS word, confidence FROM hyp h JOIN event e ON e.event_id = h.event_id JOIN word w ON e.word_id = w.word_id WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.event_id = h.event_id AND ev.trigger_id = h.trigger_id AND evidence <> 'Speculative')",
    "cq08": f"SELECT form AS word, CAST(max({_RANK}) AS INT) AS \"strongestTier\" FROM ev JOIN event e USING (event_id) JOIN word w ON e.word_id = w.word_id GROUP BY form",
    "cq09": "SELECT form AS word, count(DISTINCT trigger_id) AS \"nTriggers\", min(confidence) AS \"minConf\", max(confidence) AS \"maxConf\" FROM hyp JOIN event e USING (event_id) JOIN word w ON e.word_id = w.word_id GROUP BY event_id, form HAVING count(DISTINCT trigger_id) > 1",
    "cq10": "SELECT form AS word, first_attested AS year, connotation, gloss FROM (SELECT DISTINCT word_id, unnest([sense_from, sense_to]) AS sense_id FROM es JOIN event USING (event_id)) JOIN word USING (word_id) JOIN sense USING (sense_id)",
    "cq11": "SELECT form AS word, drift_year AS year, label AS \"triggerLabel\", confidence FROM event e JOIN word w ON e.word_id = w.word_id LEFT JOIN (hyp JOIN trig USING (trigger_id)) h ON h.event_id = e.event_id WHERE type = '1-URGENT'",
    "cq12": "SELECT form AS word, count(DISTINCT year(l_shipdate)) AS \"nSources\", string_agg(DISTINCT 'S' || year(l_shipdate), ' | ' ORDER BY 'S' || year(l_shipdate)) AS sources FROM lineitem JOIN event e ON event_id = l_orderkey JOIN word w ON e.word_id = w.word_id GROUP BY event_id, form",
}
