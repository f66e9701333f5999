"""The entity tables as a lens over the star-schema Parquet tables, as DataFrames and as SQL.

word: customers; event: orders; trigger: suppliers; hypothesis: distinct (order, supplier) of line items, with their
flags as evidence; sense: parts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import quality_of

#: Name spaces of the lens's triples.
VOCAB, RESOURCE, XSD = "http://example.org/vocab#", "http://example.org/r/", "http://www.w3.org/2001/XMLSchema#"
TYPE, LANG = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
LABEL, PREF, CONCEPT = "http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/2004/02/skos/core#prefLabel", "http://www.w3.org/2004/02/skos/core#Concept"

#: Sources by market segment, evidence by line flags.
SEGMENTS = (("AUTOMOBILE", "GfdS"), ("BUILDING", "DWUG"), ("FURNITURE", "SemEval"), ("HOUSEHOLD", "Frequency"))
FLAGS = (("AF", "ScholarlyAttestation"), ("AO", "LexicographicNote"), ("RF", "ChangeSignalAlignment"), ("RO", "FrequencyCorrelation"), ("NO", "Speculative"))


def _mapped(c, pairs, other):
    return F.coalesce(*[F.when(c == a, F.lit(b)) for a, b in pairs], F.lit(other))


@dataclass(frozen=True)
class Entities:
    """What the analytics work on. Every table is lazy and reads only the columns it needs."""

    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def word(self) -> DataFrame:
        """word_id, written (the form as written, if any), form (written, else the id), lang, source, quality."""
        form = F.concat(F.lit("w"), (F.col("c_custkey") % 1000).cast("string"))
        form = F.when(F.col("c_custkey") % 3 == 0, F.upper(form)).otherwise(form)
        w = self.read("customer").select(
            F.col("c_custkey").alias("word_id"), form.alias("written"), form.alias("form"),
            F.when(F.col("c_nationkey") % 2 == 0, "en").otherwise("de").alias("lang"),
            _mapped(F.col("c_mktsegment"), SEGMENTS, "Curated").alias("source"),
        )
        return w.withColumn("quality", quality_of(F.col("source")))

    @property
    def word_node(self) -> DataFrame:
        """Every word, whether it has a form or a sense or not."""
        return self.read("customer").select(F.col("c_custkey").alias("word_id"))

    @cached_property
    def event(self) -> DataFrame:
        """event_id, word_id, drift_year (the event's own), year (or else its interval's first), year_end (the interval's last), confidence."""
        y = F.year("o_orderdate")
        return self.read("orders").select(
            F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("word_id"), y.alias("year"), F.when(F.col("o_orderstatus") == "P", y + 1).alias("year_end"),
            F.when(F.col("o_orderstatus") != "P", y).alias("drift_year"), F.lit(None).cast("double").alias("confidence"),
        )

    @cached_property
    def event_type(self) -> DataFrame:
        """event_id, type_id, type (label to show), type_en (English label, if any)."""
        t = F.col("o_orderpriority")
        return self.read("orders").select(F.col("o_orderkey").alias("event_id"), t.alias("type_id"), t.alias("type"), t.alias("type_en"))

    @cached_property
    def event_label(self) -> DataFrame:
        """event_id, type: the labels of all types of an event, joined in order of their ids."""
        return self.event_type.select("event_id", "type")

    @cached_property
    def trigger(self) -> DataFrame:
        """trigger_id, label, label_en, date, category, category_en, same_as, description."""
        nation = self.read("nation").select("n_nationkey", "n_regionkey")
        region = self.read("region").select("r_regionkey", "r_name")
        s = self.read("supplier").join(F.broadcast(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))), F.col("s_nationkey") == F.col("n_nationkey"))  # the nations of the world
        category = F.when(F.col("r_name") != "MIDDLE EAST", F.col("r_name"))
        return s.select(
            F.col("s_suppkey").alias("trigger_id"), F.col("s_name").alias("label"), F.col("s_name").alias("label_en"), (1900 + F.col("s_suppkey") % 120).cast("int").alias("date"),
            category.alias("category"), category.alias("category_en"), F.concat(F.lit("http://example.org/entity/Q"), F.col("s_suppkey").cast("string")).alias("same_as"), F.lit(None).cast("string").alias("description"),
        )

    @cached_property
    def claim(self) -> DataFrame:
        """hyp_id, event_id, trigger_id, confidence, evidence (sorted keys), evidence_en (their English labels): a hypothesis in one row.

        One aggregation of line items serves confidence and evidence alike.
        """
        keys = sorted([x for _, x in FLAGS] + ["Other"])
        flag = _mapped(F.concat("l_returnflag", "l_linestatus"), [(a, 1 << keys.index(x)) for a, x in FLAGS], 1 << keys.index("Other"))
        g = self.read("lineitem").groupBy(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("trigger_id"))
        # kinds of evidence are bits, so that the aggregation stays in generated code; names come last
        g = g.agg(F.round(F.max("l_discount") * 10, 6).alias("confidence"), F.bit_or(flag).alias("kinds"))
        evidence = F.array_compact(F.array(*[F.when(F.col("kinds").bitwiseAND(1 << i) != 0, F.lit(x)) for i, x in enumerate(keys)]))
        return g.select(F.concat_ws("-", "event_id", "trigger_id").alias("hyp_id"), "event_id", "trigger_id", "confidence", evidence.alias("evidence"), evidence.alias("evidence_en"))

    @cached_property
    def pair(self) -> DataFrame:
        """event_id, trigger_id of every claim, without what else it says."""
        return self.read("lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("trigger_id")).distinct()

    @property
    def hypothesis(self) -> DataFrame:
        """event_id, trigger_id, confidence, evidence: claims about one event and trigger in one row. On the lens they are claims."""
        return self.claim.select("event_id", "trigger_id", "confidence", F.col("evidence_en").alias("evidence"))

    @cached_property
    def event_sense(self) -> DataFrame:
        return self.read("lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.min("l_partkey").alias("sense_from"), F.max("l_partkey").alias("sense_to"))

    @cached_property
    def sense(self) -> DataFrame:
        """sense_id, connotation (label to show), connotation_id, connotation_en, gloss (to show), gloss_en, first_attested, att_begin, att_end."""
        c = F.when(F.col("p_size") % 3 == 0, "negative").when(F.col("p_size") % 3 == 1, "neutral").otherwise("positive")
        none = F.lit(None).cast("int")
        return self.read("part").select(
            F.col("p_partkey").alias("sense_id"), c.alias("connotation"), c.alias("connotation_id"), c.alias("connotation_en"), F.col("p_name").alias("gloss"), F.col("p_name").alias("gloss_en"),
            (1000 + F.col("p_size") * 10).cast("int").alias("first_attested"), none.alias("att_begin"), none.alias("att_end"),
        )

    @cached_property
    def xling(self) -> DataFrame:
        w = self.word.select("word_id", "lang")
        a = w.where("word_id % 10 = 0").select(F.col("word_id").alias("a"), F.col("lang").alias("la"))
        b = w.select(F.col("word_id").alias("b"), F.col("lang").alias("lb"))
        return a.join(b, F.col("b") == F.col("a") + 1).where("la <> lb").select("a", "b")

    @cached_property
    def word_sense(self) -> DataFrame:
        """word_id, sense_id of every sense that a word's events lead from or to."""
        s = self.event_sense.select("event_id", F.explode(F.array("sense_from", "sense_to")).alias("sense_id"))
        return s.join(self.event.select("event_id", "word_id"), "event_id").select("word_id", "sense_id").distinct()

    @cached_property
    def event_source(self) -> DataFrame:
        """A source is a ship year."""
        title = F.concat(F.lit("S"), F.year("l_shipdate").cast("string"))
        return self.read("lineitem").select(F.col("l_orderkey").alias("event_id"), title.alias("source_id"), title.alias("title")).distinct()

    @cached_property
    def claim_source(self) -> DataFrame:
        """hyp_id, title, url of the sources of a hypothesis."""
        hyp = F.concat_ws("-", "l_orderkey", "l_suppkey")
        return self.read("lineitem").select(hyp.alias("hyp_id"), F.concat(F.lit("S"), F.year("l_shipdate").cast("string")).alias("title"), F.lit(None).cast("string").alias("url")).distinct()

    @cached_property
    def frequency(self) -> DataFrame:
        """word_id, year, value: events of a user by day of the month count as its word's frequency in that year."""
        return self.read("events").groupBy(F.col("user_id").alias("word_id"), F.dayofmonth("ts").alias("year")).agg(F.count(F.lit(1)).cast("double").alias("value"))

    @cached_property
    def drift_type(self) -> DataFrame:
        """id, label, broaderId, broaderLabel of the drift types."""
        t = self.event_type.select("type_id").distinct()
        number = F.substring("type_id", 1, 1).cast("int")
        broader = F.when(number <= 2, "pressing").when(number <= 4, "usual")
        return t.select(F.col("type_id").alias("id"), F.col("type_id").alias("label"), broader.alias("broaderId"), broader.alias("broaderLabel"))

    @cached_property
    def evidence_type(self) -> DataFrame:
        """label of each evidence type of the scheme, used or not."""
        return self.spark.createDataFrame([(e,) for _, e in FLAGS], "label string")

    @cached_property
    def geo(self) -> DataFrame:
        lon = F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey") % 180)
        kind = F.when(F.col("s_suppkey") % 4 == 0, "P625").when(F.col("s_suppkey") % 4 == 1, "P19").when(F.col("s_suppkey") % 4 == 2, "P999")
        return self.read("supplier").select(F.col("s_suppkey").alias("trigger_id"), F.round(F.col("s_acctbal") % 90, 4).alias("lat"), lon.cast("double").alias("lon"), kind.alias("coordSource"))

    @cached_property
    def triples(self) -> DataFrame:
        """Words, events, triggers, hypotheses, their senses' ids aside, and their concepts as triples (s, p, o, kind, lang, datatype).

        A branch for each predicate, which stands there as a constant: a filter on predicates leaves only the branches that pass it.
        """
        text = lambda o, kind="string": (f"CAST({o} AS STRING)", "'literal'", "CAST(NULL AS STRING)", f"'{XSD}{kind}'")
        said = lambda o, lang: (o, "'literal'", lang, f"'{LANG}'")
        iri = lambda o: (o, "'iri'", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)")
        a = lambda kind: (TYPE, *iri(f"'{VOCAB}{kind}'"))
        r = lambda kind, c: f"concat('{RESOURCE}{kind}', {c})"
        slug = lambda c: f"regexp_replace({c}, '[^A-Za-z0-9]', '')"
        concept, event, trigger, hyp = (TYPE, *iri(f"'{CONCEPT}'")), r("event-", "event_id"), r("trigger-", "trigger_id"), r("hyp-", "hyp_id")
        parts = [
            ("word", r("word-", "word_id"), [a("Word"), ("writtenForm", *said("written", "lang")), ("language", *text("lang"))]),
            ("event", event, [a("DriftEvent"), ("affectsWord", *iri(r("word-", "word_id"))), ("driftYear", *text("drift_year", "gYear")), ("driftInterval", *iri(f"CASE WHEN drift_year IS NULL AND event_id % 2 = 0 THEN {r('interval-', 'event_id')} END"))]),
            ("event_type", event, [("driftType", *iri(r("type-", slug("type_id"))))]),
            ("trigger", trigger, [a("TriggerEvent"), (LABEL, *said("label_en", "'en'")), ("eventDate", *text("date", "gYear")), ("triggerCategory", *iri(r("category-", slug("category"))))]),
            ("claim", hyp, [a("CausalHypothesis"), ("aboutDrift", *iri(event)), ("proposedTrigger", *iri(trigger)), ("confidence", *text("confidence", "decimal"))]),
            ("(SELECT hyp_id, explode(evidence) AS x FROM {claim})", hyp, [("evidenceType", *iri(r("evidence/", "x")))]),
            ("drift_type", r("type-", slug("id")), [concept, (PREF, *said("label", "'en'"))]),
            ("(SELECT DISTINCT category FROM {trigger} WHERE category <> 'AFRICA')", r("category-", slug("category")), [concept, (PREF, *said("category", "'en'"))]),
            ("evidence_type", r("evidence/", "label"), [concept, (PREF, *said("label", "'en'"))]),
        ]
        branches = []
        for source, s, facts in parts:
            for p, o, kind, lang, datatype in facts:
                found = source if source.startswith("(") else f"{{{source}}}"
                name = p if ":" in p else VOCAB + p
                branches.append(f"SELECT {s} AS s, '{name}' AS p, {o} AS o, {kind} AS kind, {lang} AS lang, {datatype} AS datatype FROM {found} WHERE {o} IS NOT NULL")
        tables = {n: getattr(self, n) for n in ("word", "event", "event_type", "trigger", "claim", "drift_type", "evidence_type")}
        return self.spark.sql(" UNION ALL ".join(branches), **tables)


#: The same tables as common table expressions; a query's SQL follows.
SQL = """
WITH word AS (SELECT c_custkey AS word_id, CASE WHEN c_custkey % 3 = 0 THEN upper('w' || (c_custkey % 1000)) ELSE 'w' || (c_custkey % 1000) END AS form,
  CASE WHEN c_nationkey % 2 = 0 THEN 'en' ELSE 'de' END AS lang,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'GfdS' WHEN 'BUILDING' THEN 'DWUG' WHEN 'FURNITURE' THEN 'SemEval' WHEN 'HOUSEHOLD' THEN 'Frequency' ELSE 'Curated' END AS source,
  CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'benchmark' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'detected' ELSE 'high' END AS quality FROM customer),
freq AS (SELECT user_id AS word_id, CAST(day(ts) AS INT) AS year, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL),
canon AS (SELECT word_id, min(word_id) OVER (PARTITION BY lower(form), lang) AS canon FROM word),
merged AS (SELECT min(word_id) AS id, arg_min(form, word_id) AS form, lang, count(*) AS merged, string_agg(DISTINCT source, '; ' ORDER BY source) AS sources,
  arg_min(quality, (CASE quality WHEN 'high' THEN 0 WHEN 'benchmark' THEN 1 ELSE 2 END) * 1000000000 + word_id) AS quality, arg_min(source, (CASE quality WHEN 'high' THEN 0 WHEN 'benchmark' THEN 1 ELSE 2 END) * 1000000000 + word_id) AS source FROM word GROUP BY lower(form), lang),
event AS (SELECT o_orderkey AS event_id, o_custkey AS word_id, o_orderpriority AS type, CAST(year(o_orderdate) AS INT) AS year, CAST(CASE WHEN o_orderstatus = 'P' THEN year(o_orderdate) + 1 END AS INT) AS year_end,
  CAST(CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END AS INT) AS drift_year FROM orders),
trig AS (SELECT s_suppkey AS trigger_id, s_name AS label, CAST(1900 + s_suppkey % 120 AS INT) AS date, CASE WHEN r_name <> 'MIDDLE EAST' THEN r_name END AS category
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
hyp AS (SELECT l_orderkey AS event_id, l_suppkey AS trigger_id, round(max(l_discount) * 10, 6) AS confidence FROM lineitem GROUP BY ALL),
ev AS (SELECT DISTINCT l_orderkey AS event_id, l_suppkey AS trigger_id, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'ScholarlyAttestation' WHEN 'AO' THEN 'LexicographicNote'
  WHEN 'RF' THEN 'ChangeSignalAlignment' WHEN 'RO' THEN 'FrequencyCorrelation' WHEN 'NO' THEN 'Speculative' ELSE 'Other' END AS evidence FROM lineitem),
es AS (SELECT l_orderkey AS event_id, min(l_partkey) AS sense_from, max(l_partkey) AS sense_to FROM lineitem GROUP BY ALL),
sense AS (SELECT p_partkey AS sense_id, CASE p_size % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS connotation, p_name AS gloss, CAST(1000 + p_size * 10 AS INT) AS first_attested FROM part),
xling AS (SELECT x.word_id AS a, y.word_id AS b FROM word x JOIN word y ON y.word_id = x.word_id + 1 WHERE x.word_id % 10 = 0 AND x.lang <> y.lang)
"""
