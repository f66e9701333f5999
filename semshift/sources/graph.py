"""The entity tables read from triples, so that every analytic runs on a knowledge graph as it does on the lens.

Predicates and classes are known by their local names, in whatever name space. Keep big graphs as `write_graph` does:
Parquet by predicate, so that a table reads only its predicates' folders and columns; or as `save_graph` does, by predicate and
within each in buckets by subject, so that what is joined or grouped by subject (entity tables, stars of SPARQL patterns) stays where it is.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import local_name, parse_year, quality_of, source_of


def by_predicate(triples: DataFrame) -> DataFrame:
    return triples.withColumn("name", local_name(F.col("p")))


def write_graph(triples: DataFrame, path: str) -> None:
    by_predicate(triples).repartition("name", F.pmod(F.xxhash64("s"), F.lit(64))).write.partitionBy("name").parquet(path)


def save_graph(triples: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    """The triples as a catalog table at `path`, by predicate, each in buckets sorted by subject; an existing table of that name is an error.

    A bucket of a predicate is one file, written by one task: choose as many buckets as keep the largest predicate's files near
    a few hundred MB. A hot subject stands in one bucket.
    """
    t = by_predicate(triples).repartition(buckets, "s")  # as buckets are dealt, so that each task writes one file of a predicate
    t.write.partitionBy("name").bucketBy(buckets, "s").sortBy("s").format("parquet").option("path", path).saveAsTable(table)


def open_graph(spark: SparkSession, table: str, path: str, buckets: int = 64) -> DataFrame:
    """The triples that `save_graph` wrote, also in sessions whose catalog doesn't know the table yet; `buckets` as they were written."""
    if not spark.catalog.tableExists(table):
        fields = "s string, p string, o string, kind string, lang string, datatype string, name string"
        spark.sql(f"CREATE TABLE {table} ({fields}) USING parquet PARTITIONED BY (name) CLUSTERED BY (s) SORTED BY (s) INTO {buckets} BUCKETS LOCATION '{path}'")
        spark.sql(f"MSCK REPAIR TABLE {table}")
    return spark.table(table)


@dataclass(frozen=True)
class Graph:
    """Takes the place of lens.Entities. triples: s, p, o, kind, lang, datatype and name, p's local name.

    coords, if given, holds triggerId, lat, lon as `read_coords` returns them.
    """

    triples: DataFrame
    coords: DataFrame | None = None

    def all(self, name: str, out: str) -> DataFrame:
        return self.triples.where(F.col("name") == name).select("s", F.col("o").alias(out))

    def least(self, name: str, out: str) -> DataFrame:
        """The least value for each subject: a functional property needs a rule for subjects that break it."""
        return self.all(name, out).groupBy("s").agg(F.min(out).alias(out))

    def a(self, kind: str, out: str) -> DataFrame:
        return self.triples.where((F.col("name") == "type") & (local_name(F.col("o")) == kind)).select(F.col("s").alias(out)).distinct()

    def text(self, name: str, out: str) -> DataFrame:
        """s, out (English if there is one, else the least of any language), out_en (English or null)."""
        t = self.triples.where(F.col("name") == name).groupBy("s")
        en = F.min(F.when(F.col("lang") == "en", F.col("o")))
        return t.agg(F.coalesce(en, F.min("o")).alias(out), en.alias(f"{out}_en"))

    def concept(self, name: str, out: str) -> DataFrame:
        """s, out_id, out, out_en: each concept that a subject names by this predicate, its label, its English label; null where it has none."""
        label = self.text("prefLabel", out).withColumnRenamed("s", f"{out}_id")
        return self.all(name, f"{out}_id").distinct().join(label, f"{out}_id", "left").select("s", f"{out}_id", out, f"{out}_en")

    def first(self, df: DataFrame, *cols: str) -> DataFrame:
        """The row with the least first column for each subject: a functional property needs a rule for subjects that break it."""
        return df.groupBy("s").agg(F.min_by(F.struct(*cols), cols[0]).alias("__x")).select("s", "__x.*")

    @property
    def word_node(self) -> DataFrame:
        return self.a("Word", "word_id")

    @cached_property
    def word(self) -> DataFrame:
        """Words that have a written form or a sense."""
        w = self.a("Word", "s").join(self.least("writtenForm", "written"), "s", "left").join(self.least("language", "lang"), "s", "left")
        senses = self.all("sense", "x").select("s").distinct().withColumn("has", F.lit(True))
        w = w.join(senses, "s", "left").where("written is not null or has")
        w = w.select(F.col("s").alias("word_id"), "written", F.coalesce("written", local_name(F.col("s"))).alias("form"), "lang", source_of(F.col("s")).alias("source"))
        return w.withColumn("quality", quality_of(F.col("source")))

    @cached_property
    def event_type(self) -> DataFrame:
        """event_id, type_id, type, type_en: a row for each type of an event. A type without a label shows what follows its hash."""
        t = self.a("DriftEvent", "s").join(self.concept("driftType", "type"), "s")
        return t.select(F.col("s").alias("event_id"), "type_id", F.coalesce("type", F.substring_index("type_id", "#", -1)).alias("type"), "type_en").distinct()

    @cached_property
    def event_label(self) -> DataFrame:
        g = self.event_type.groupBy("event_id").agg(F.array_sort(F.collect_set(F.struct("type_id", "type"))).alias("t"))
        return g.select("event_id", F.array_join(F.col("t.type"), ", ").alias("type"))

    def _bound(self, of: str, which: str, out: str) -> DataFrame:
        inst = self.least(which, "i").join(self.least("inXSDgYear", "y").withColumnRenamed("s", "i"), "i").select(F.col("s").alias("v"), parse_year(F.col("y")).alias(out))
        return self.least(of, "v").join(inst, "v").select("s", out)

    @cached_property
    def event(self) -> DataFrame:
        """The interval's years stand in where an event has no year of its own."""
        e = self.a("DriftEvent", "s").join(self.least("affectsWord", "word_id"), "s").join(self.least("driftYear", "y"), "s", "left").join(self.least("confidence", "c"), "s", "left")
        e = e.join(self._bound("driftInterval", "hasBeginning", "b"), "s", "left").join(self._bound("driftInterval", "hasEnd", "n"), "s", "left").withColumn("y", parse_year(F.col("y")))
        return e.select(F.col("s").alias("event_id"), "word_id", F.coalesce("y", "b").alias("year"), F.when(F.col("y").isNull(), F.col("n")).alias("year_end"), F.col("y").alias("drift_year"), F.col("c").try_cast("double").alias("confidence"))

    @cached_property
    def trigger(self) -> DataFrame:
        category = self.first(self.concept("triggerCategory", "category"), "category", "category_en")
        t = self.a("TriggerEvent", "s").join(self.text("label", "label"), "s", "left").join(self.least("eventDate", "d"), "s", "left").join(category, "s", "left")
        t = t.join(self.least("sameAs", "same_as"), "s", "left").join(self.least("description", "description"), "s", "left")
        return t.select(F.col("s").alias("trigger_id"), F.coalesce("label", local_name(F.col("s"))).alias("label"), "label_en", parse_year(F.col("d")).alias("date"), "category", "category_en", "same_as", "description")

    @cached_property
    def claim(self) -> DataFrame:
        """hyp_id, event_id, trigger_id, confidence, evidence (local names), evidence_en (English labels, null where there is none): a row for each hypothesis."""
        h = self.a("CausalHypothesis", "s").join(self.least("aboutDrift", "event_id"), "s").join(self.least("proposedTrigger", "trigger_id"), "s").join(self.least("confidence", "c"), "s", "left")
        kinds = self.concept("evidenceType", "kind").withColumn("key", local_name(F.col("kind_id")))
        ev = kinds.groupBy("s").agg(F.array_sort(F.collect_set("key")).alias("evidence"), F.array_sort(F.collect_set("kind_en")).alias("evidence_en"), F.array_sort(F.collect_set(F.coalesce("kind_en", "kind_id"))).alias("shown"))
        none = F.array().cast("array<string>")
        h = h.join(ev, "s", "left").join(self.least("wasAttributedTo", "attributed_to"), "s", "left").join(self.least("date", "stated"), "s", "left")
        return h.select(F.col("s").alias("hyp_id"), "event_id", "trigger_id", F.col("c").try_cast("double").alias("confidence"), *[F.coalesce(c, none).alias(c) for c in ("evidence", "evidence_en", "shown")], "attributed_to", "stated")

    @cached_property
    def pair(self) -> DataFrame:
        """event_id, trigger_id of every claim and of every direct triggeredBy."""
        old = self.a("DriftEvent", "s").join(self.all("triggeredBy", "trigger_id"), "s").select(F.col("s").alias("event_id"), "trigger_id")
        return self.claim.select("event_id", "trigger_id").unionByName(old).distinct()

    @cached_property
    def hypothesis(self) -> DataFrame:
        """event_id, trigger_id, confidence, evidence: claims about one event and trigger in one row, with the first claim's confidence and the evidence of all."""
        g = self.claim.groupBy("event_id", "trigger_id").agg(F.min_by("confidence", "hyp_id").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("shown")))).alias("evidence"))
        return g

    @cached_property
    def event_sense(self) -> DataFrame:
        e = self.a("DriftEvent", "s").join(self.least("senseFrom", "sense_from"), "s", "left").join(self.least("senseTo", "sense_to"), "s", "left")
        return e.where("sense_from is not null or sense_to is not null").select(F.col("s").alias("event_id"), "sense_from", "sense_to")

    @cached_property
    def word_sense(self) -> DataFrame:
        return self.a("Word", "s").join(self.all("sense", "sense_id"), "s").select(F.col("s").alias("word_id"), "sense_id").distinct()

    @cached_property
    def sense(self) -> DataFrame:
        """Senses that words name, whatever class they are of."""
        ids = self.all("sense", "sense_id").select(F.col("sense_id").alias("s")).distinct()
        c = self.first(self.concept("connotation", "connotation"), "connotation_id", "connotation", "connotation_en")
        s = ids.join(c, "s", "left").join(self.text("gloss", "gloss"), "s", "left").join(self.least("firstAttested", "y"), "s", "left")
        s = s.join(self._bound("attestedDuring", "hasBeginning", "att_begin"), "s", "left").join(self._bound("attestedDuring", "hasEnd", "att_end"), "s", "left")
        shown = F.coalesce("connotation_en", F.substring_index("connotation_id", "#", -1))
        return s.select(F.col("s").alias("sense_id"), shown.alias("connotation"), "connotation_id", "connotation_en", "gloss", "gloss_en", parse_year(F.col("y")).alias("first_attested"), "att_begin", "att_end")

    @cached_property
    def xling(self) -> DataFrame:
        return self.all("crossLingualOf", "b").where("s <> b").select(F.col("s").alias("a"), "b").distinct()

    @cached_property
    def claim_source(self) -> DataFrame:
        """hyp_id, title, url of the sources of a hypothesis."""
        j = self.a("CausalHypothesis", "hyp_id").join(self.all("hasSource", "x").withColumnRenamed("s", "hyp_id"), "hyp_id")
        for name, out in (("title", "title"), ("sourceURL", "url")):
            j = j.join(self.least(name, out).withColumnRenamed("s", "x"), "x", "left")
        return j.select("hyp_id", "title", "url").distinct()

    @cached_property
    def frequency(self) -> DataFrame:
        """word_id, year, value of each observation that has a year and a value."""
        f = self.a("FrequencyObservation", "s").join(self.least("ofWord", "word_id"), "s").join(self.least("observedYear", "y"), "s").join(self.least("relativeFrequency", "v"), "s")
        return f.select("word_id", parse_year(F.col("y")).alias("year"), F.col("v").try_cast("double").alias("value")).where("year is not null and value is not null")

    @cached_property
    def event_source(self) -> DataFrame:
        """event_id, source_id, title of each source of an event; the title may be missing."""
        j = self.a("DriftEvent", "s").join(self.all("hasSource", "source_id"), "s").join(self.least("title", "title").withColumnRenamed("s", "source_id"), "source_id", "left")
        return j.select(F.col("s").alias("event_id"), "source_id", "title").distinct()

    @cached_property
    def drift_type(self) -> DataFrame:
        """id, label, broaderId, broaderLabel of the concepts in the scheme of drift types."""
        label = self.text("prefLabel", "label").drop("label_en")
        t = self.a("Concept", "s").join(self.all("inScheme", "x").where(local_name(F.col("x")) == "DriftTypeScheme").select("s").distinct(), "s", "left_semi")
        t = t.join(label, "s", "left").join(self.least("broader", "broaderId"), "s", "left")
        t = t.join(label.select(F.col("s").alias("broaderId"), F.col("label").alias("broaderLabel")), "broaderId", "left")
        return t.select(F.col("s").alias("id"), F.coalesce("label", F.substring_index("s", "#", -1)).alias("label"), "broaderId", "broaderLabel")

    @cached_property
    def evidence_type(self) -> DataFrame:
        """label of each evidence type of the scheme that has one."""
        t = self.a("Concept", "s").join(self.all("inScheme", "x").where(local_name(F.col("x")) == "EvidenceTypeScheme").select("s").distinct(), "s", "left_semi")
        return t.join(self.text("prefLabel", "label"), "s").select("label")

    @cached_property
    def geo(self) -> DataFrame:
        if self.coords is None:
            return self.trigger.select("trigger_id", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("string").alias("coordSource"))
        return self.coords.select(F.col("triggerId").alias("trigger_id"), "lat", "lon", "coordSource")


def read_coords(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON document, a bare array or an object that holds one as `triggers`."""
    row = "triggerId string, label string, qid string, lat double, lon double, eventDate string, category string, coordSource string"
    text = spark.read.text(path, wholetext=True)
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{row.replace(' ', ':').replace(',:', ',')}>>")).otherwise(F.from_json("value", f"triggers array<struct<{row.replace(' ', ':').replace(',:', ',')}>>")["triggers"])
    return text.select(F.explode(rows).alias("r")).select("r.*")
