"""What is drawn from the graph document: facet filter, search, trends, loss, pairs, networks, maps, dashboards, layouts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bucket, bucket_label, decade, evidence_rung, fuzzy_score, gyear, lang_label, percent, pretty_category, qid, read_year, rung_name, show_year, slug
from ..sources.lens import Entities
from .document import _FLAT, _IMPACT, _LIGHT, _XLING, _keyed, _types, canonical, causes, flat, impact, words_light, words_merged, xling_symmetric


def _any(test: Column) -> Column:
    return F.coalesce(F.bool_or(test), F.lit(False))


def facet_filter(
    e: Entities, search: str = "w1", langs: tuple = ("en",), sources: tuple = (), qualities: tuple = ("high", "benchmark"), types: tuple = (), connotations: tuple = (), evidences: tuple = (),
    year_from: int | None = None, year_to: int | None = None, has_trigger: bool = False, limit: int | None = None,
) -> DataFrame:
    """Merged words that pass every facet; several values within a facet are alternatives. By default detected words are left out.

    Types match by substring, connotations from either end of an event, evidence in any cause, all whatever their case. A word whose
    events have years needs one within the range; another one needs a span that overlaps it; undated words pass. `total` is
    the number of words that pass, of which the first `limit` are returned.
    """
    w = words_light(e)
    low = lambda values: [v.lower() for v in values]
    if search:
        w = w.where(F.lower("writtenForm").contains(search.lower()))
    if langs:
        w = w.where(F.coalesce("language", F.lit("?")).isin(*langs))
    if sources:
        w = w.where(F.arrays_overlap("sources", F.array(*map(F.lit, sources))))
    if qualities:
        w = w.where(F.col("quality").isin(*qualities))
    if types:
        w = w.where(F.exists("driftTypeLabels", lambda x: reduce(or_, [F.lower(x).contains(t) for t in low(types)])))
    if has_trigger:
        w = w.where("hasTrigger")
    tests = {}
    if connotations:
        tests["conn"] = _any(F.coalesce(F.lower("fromConn").isin(*low(connotations)), F.lit(False)) | F.coalesce(F.lower("toConn").isin(*low(connotations)), F.lit(False)))
    if evidences:
        tests["ev"] = _any(F.exists("causes", lambda c: F.exists(c["evidence"], lambda x: F.lower(x).isin(*low(evidences)))))
    ranged = year_from is not None or year_to is not None
    if ranged:
        lo, hi = (-(10**9) if year_from is None else year_from), (10**9 if year_to is None else year_to)
        tests["inside"], tests["dated"] = _any(F.col("year").between(lo, hi)), _any(F.col("year").isNotNull())
    if tests:
        ev = flat(e, with_causes=bool(evidences)).groupBy(F.col("canon").alias("id")).agg(*[t.alias(n) for n, t in tests.items()])
        w = w.join(ev, "id", "left")
        for n in ("conn", "ev"):
            if n in tests:
                w = w.where(n)
        if ranged:
            span = F.coalesce((F.coalesce("yearStart", "yearEnd") <= hi) & (F.coalesce("yearEnd", "yearStart") >= lo), F.lit(True))
            w = w.where(F.when(F.coalesce("dated", F.lit(False)), F.col("inside")).otherwise(span))
    w = w.select("id", "writtenForm", "language", "source", "quality")
    if limit is not None:
        n = w.agg(F.count(F.lit(1)).alias("total"))
        w = w.orderBy(F.coalesce(F.col("language") != "en", F.lit(True)), F.lower("writtenForm"), "id").limit(limit).join(F.broadcast(n))  # one row
    return w


def resolve_word(e: Entities, name: str = "W3", lang: str = "de") -> DataFrame:
    """The merged word that a link names: by form and language, by form, by form whatever its case, by id."""
    w = words_merged(e)
    exact = F.col("form") == F.lit(name)
    rank = F.when(exact & (F.lower("lang") == lang.lower()), 0).when(exact, 1).when(F.lower("form") == name.lower(), 2).when(F.col("id").cast("string") == name, 3)
    return w.withColumn("rank", rank).where("rank is not null").orderBy("rank", F.coalesce(F.col("lang") != "en", F.lit(True)), "id").limit(1).select("id", "form", "lang", "rank")


def resolve_trigger(e: Entities, name: str, namespace: str = "") -> DataFrame:
    """The trigger that a link names: by id, by id within the name space, by label whatever its case, by the id's last part."""
    i = F.col("trigger_id").cast("string")
    rank = F.when(i == name, 0).when(i == namespace + name, 1).when(F.lower("label") == name.lower(), 2).when(F.substring_index(i, "/", -1) == name, 3)
    return e.trigger.withColumn("rank", rank).where("rank is not null").orderBy("rank", "trigger_id").limit(1).select("trigger_id", "label", "rank")


def fuzzy_search(e: Entities, query: str = "w12", limit: int = 10) -> DataFrame:
    """The best labels for a query, among merged words and triggers."""
    q = query.strip()
    index = words_merged(e).select(F.lit("word").alias("kind"), F.col("form").alias("label"), F.col("id").cast("string").alias("id")).unionByName(e.trigger.select(F.lit("trigger").alias("kind"), "label", F.col("trigger_id").cast("string").alias("id")))
    s = index.withColumn("score", fuzzy_score(q, F.col("label"))).where("score > -1")
    return s.orderBy(F.desc("score"), "label", "kind", "id").limit(limit if q else 0)


def featured(e: Entities, forms: tuple = ("w1", "w2", "w5", "w7", "nothing"), least: int = 4) -> DataFrame:
    """The words of a fixed list, in its order, if at least so many exist."""
    place = F.array_position(F.array(*map(F.lit, forms)), F.col("form"))
    w = words_merged(e).where(F.col("form").isin(*forms)).groupBy("form").agg(F.min_by(F.struct("id", "lang"), F.struct(F.coalesce(F.col("lang") != "en", F.lit(True)), "id")).alias("x"))
    w = w.select(place.cast("int").alias("ord"), "form", "x.id", "x.lang")
    return w.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).where(F.col("n") >= least).drop("n").orderBy("ord")  # as many rows as the list


def random_word(e: Entities, seed: int = 0) -> DataFrame:
    """One merged word, drawn by a seeded hash of its id."""
    return words_merged(e).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1).select("id", "form", "lang")


def top_cause(e: Entities) -> DataFrame:
    """The trigger with the highest confidence for each merged word (none counts as 0); ties go to the earliest event, then to the lowest ids."""
    h = e.hypothesis.select("event_id", "trigger_id", "confidence").join(e.event.select("event_id", "word_id", "year"), "event_id").join(canonical(e), "word_id")
    first = F.struct(-F.coalesce("confidence", F.lit(0.0)), F.coalesce("year", F.lit(0)), "event_id", "trigger_id")
    g = h.groupBy("canon").agg(F.min_by(F.struct("trigger_id", "confidence"), first).alias("b"))
    return g.select(F.col("canon").alias("word_id"), F.col("b.trigger_id").alias("trigger_id"), F.col("b.confidence").alias("confidence"))


def last_cause(e: Entities) -> DataFrame:
    """canon, trigger_id, confidence, evidence: where several causes of a word name one trigger, the last one in order of its events."""
    f = flat(e).select("canon", "event_id", "year", F.posexplode("causes").alias("pos", "c"))
    last = F.struct(F.coalesce("year", F.lit(0)), "event_id", "pos")
    g = f.groupBy("canon", F.col("c.triggerLabel").alias("label")).agg(F.max_by("c", last).alias("c"))
    return g.select(F.col("canon").alias("word_id"), "label", "c.confidence", F.array_join("c.evidence", "; ").alias("evidence"))


def cause_rank(e: Entities) -> DataFrame:
    """Trigger labels by how many causes name them."""
    g = e.hypothesis.groupBy("trigger_id").agg(F.count(F.lit(1)).alias("n"))
    return g.join(e.trigger.select("trigger_id", "label"), "trigger_id").groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label")


def decade_stack(e: Entities) -> DataFrame:
    """Decade and type counts, with empty cells, and running totals over types."""
    d = flat(e, with_causes=False).where("year is not null").select(decade(F.col("year")).alias("decade"), F.explode(_types("type")).alias("type")).groupBy("decade", "type").agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy(F.lit(0))
    g = d.withColumn("types", F.collect_set("type").over(one)).groupBy("decade").agg(F.first("types").alias("types"), F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("m"))  # decades x types: a few hundred cells
    g = g.select("decade", F.explode(F.array_sort("types")).alias("type"), "m").select("decade", "type", F.coalesce(F.col("m")[F.col("type")], F.lit(0)).cast("long").alias("n"))
    return g.withColumn("top", F.sum("n").over(Window.partitionBy("decade").orderBy("type").rowsBetween(Window.unboundedPreceding, 0)))


def trend_buckets(e: Entities) -> DataFrame:
    """Events by bucket (century before 1800, else decade), joined type and resulting connotation (none counts as neutral)."""
    f = flat(e, with_causes=False).where("year is not null").select(bucket(F.col("year")).alias("bucket"), bucket_label(F.col("year")).alias("label"), "type", F.coalesce("toConn", F.lit("neutral")).alias("toConn"))
    return f.groupBy("bucket", "label", "type", "toConn").agg(F.count(F.lit(1)).alias("n"))


def trend_share(e: Entities) -> DataFrame:
    """Types of each bucket with their share of it."""
    g = trend_buckets(e).groupBy("bucket", "type").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("bucket"))
    return g.select("bucket", "type", "n", F.round(share, 6).alias("share"), percent(share).alias("pct"))


def _loss(e: Entities) -> DataFrame:
    """Events that turned negative (poisoned) or ceased to be (reclaimed); an unknown connotation isn't negative."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    f, t = low("fromConn"), low("toConn")
    kind = F.when((t == "negative") & (f != "negative"), "poisoned").when((f == "negative") & (t != "negative"), "reclaimed")
    other = F.when(t == "negative", f).otherwise(t)
    rank = F.when(other == "positive", 0).when(other == "neutral", 1).otherwise(2)
    return flat(e, with_causes=False).withColumns({"kind": kind, "rank": rank}).where("kind is not null")


def lexical_loss(e: Entities) -> DataFrame:
    """Poisoned and reclaimed events, the most striking first, then the latest."""
    return _loss(e).orderBy("kind", "rank", F.col("year").desc_nulls_last(), "event_id").select("kind", "event_id", "word", "lang", "year", "fromConn", "toConn", "rank")


def loss_stats(e: Entities) -> DataFrame:
    """How many words were poisoned and reclaimed, the difference, and their percentages."""
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    s = _loss(e).agg(n("poisoned").alias("poisoned"), n("reclaimed").alias("reclaimed"))
    all_ = F.greatest(F.col("poisoned") + F.col("reclaimed"), F.lit(1))
    return s.select("poisoned", "reclaimed", (F.col("poisoned") - F.col("reclaimed")).alias("net"), F.round(100 * F.col("poisoned") / all_, 6).alias("poisonedPct"), F.round(100 * F.col("reclaimed") / all_, 6).alias("reclaimedPct"))


def xling_pairs(e: Entities) -> DataFrame:
    """German and English partners, once each, with the least label of a trigger that both have (context only) and its year; those with one first, the latest first."""
    w = words_merged(e).select("id", "form", "lang")
    x = xling_symmetric(e).join(w.where("lang = 'de'").select(F.col("id").alias("word_id"), F.col("form").alias("de")), "word_id").join(w.where("lang = 'en'").select(F.col("id").alias("other_id"), F.col("form").alias("en")), "other_id")
    label = F.coalesce("label", F.substring_index(F.col("trigger_id").cast("string"), "/", -1))
    t = e.hypothesis.select("event_id", "trigger_id").join(e.trigger.select("trigger_id", "label"), "trigger_id", "left").select("event_id", label.alias("label"))
    t = t.join(e.event.select("event_id", "word_id"), "event_id").join(canonical(e), "word_id").select("canon", "label").distinct()
    both = x.select("word_id", "other_id").join(t.select(F.col("canon").alias("word_id"), "label"), "word_id").join(t.select(F.col("canon").alias("other_id"), "label"), ["other_id", "label"])
    common = both.groupBy("word_id", "other_id").agg(F.min("label").alias("shared"))
    years = e.trigger.groupBy(F.col("label").alias("shared")).agg(F.min_by("date", "trigger_id").alias("year"))
    j = x.join(common, ["word_id", "other_id"], "left").join(years, "shared", "left")
    return j.orderBy(F.col("shared").isNull(), F.col("year").desc_nulls_last(), F.lower("en"), "word_id", "other_id").select("de", "en", "shared", "year")


def _links(e: Entities) -> DataFrame:
    """trigger_id, label, word, lang, type, confidence, evidence: the first cause of each trigger label for each word and language."""
    f = flat(e).select("event_id", "canon", "word", "lang", "type", "year", F.posexplode("causes").alias("pos", "c"))
    first = F.struct(F.coalesce("year", F.lit(0)), "event_id", "pos")
    g = f.groupBy(F.col("c.triggerLabel").alias("label"), "word", "lang").agg(F.min_by(F.struct("type", "c"), first).alias("x"))
    return g.select("label", "word", "lang", "x.type", F.col("x.c.confidence").alias("confidence"), F.col("x.c.evidence").alias("evidence"))


def trigger_hypotheses(e: Entities, trigger: int | str = 3) -> DataFrame:
    """Words, types and confidences of one trigger, a row for each word and language, unknown confidence last."""
    t = e.trigger.where(F.col("trigger_id") == F.lit(trigger)).select("label")
    mine = e.pair.where(F.col("trigger_id") == F.lit(trigger)).select("event_id")
    # only events of the trigger's words can name it; those of the label's other triggers count as well
    words = mine.join(e.event.select("event_id", "word_id"), "event_id").join(canonical(e), "word_id").select("canon").distinct()
    f = flat(e).join(words, "canon", "left_semi").select("event_id", "word", "lang", "type", "year", F.posexplode("causes").alias("pos", "c")).join(F.broadcast(t), F.col("c.triggerLabel") == F.col("label"))  # one row
    g = f.groupBy("word", "lang").agg(F.min_by(F.struct("type", "c"), F.struct(F.coalesce("year", F.lit(0)), "word", "event_id", "pos")).alias("x"))
    out = g.select("word", "lang", F.col("x.type").alias("driftType"), F.col("x.c.confidence").alias("confidence"), F.array_join("x.c.evidence", "; ").alias("evidence"))
    return out.orderBy(F.coalesce("confidence", F.lit(-1.0)).desc(), "word", "lang")


def trigger_summary(e: Entities) -> DataFrame:
    """Mean, least and most confidence of each trigger over its words, and words by the best rung of their evidence."""
    r = _links(e).withColumn("rung", F.array_max(F.transform("evidence", evidence_rung)))
    by = lambda k: F.count(F.when(F.col("rung") == k, 1))
    return r.groupBy("label").agg(F.round(F.avg("confidence"), 6).alias("meanConf"), F.min("confidence").alias("minConf"), F.max("confidence").alias("maxConf"), *[by(k).alias(f"rung{k}") for k in range(5)])


def trigger_reach(e: Entities) -> DataFrame:
    """Words and languages that each trigger reaches: "N words across M languages"."""
    return _links(e).groupBy("label").agg(F.count(F.lit(1)).alias("words"), F.countDistinct("lang").alias("languages"), F.array_join(F.array_sort(F.collect_set(lang_label(F.col("lang")))), ", ").alias("languageNames"))


def _ranked(e: Entities, top: int) -> DataFrame:
    """The triggers with most words, each with its rank."""
    best = impact(e).drop("words").orderBy(F.desc("wordCount"), F.coalesce("year", F.lit(10**9)), "trigger").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("wordCount"), F.coalesce("year", F.lit(10**9)), "trigger")))  # `top` rows


def _category(c: str = "category") -> Column:
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t == "", "uncategorised").otherwise(t)


def trigger_cooccur(e: Entities, top: int = 40) -> DataFrame:
    """Pairs of the top triggers that share category and decade, the one of higher impact first. `top` bounds the pairs."""
    t = _ranked(e, top).select("rank", "trigger", _category().alias("category"), decade(F.col("year")).alias("decade")).where("category <> 'uncategorised' and decade is not null")
    a, b = t.select(F.col("rank").alias("ra"), F.col("trigger").alias("a"), "category", "decade"), t.select(F.col("rank").alias("rb"), F.col("trigger").alias("b"), "category", "decade")
    return a.join(b, ["category", "decade"]).where("ra < rb").select("a", "b", "category", "decade")


def bipartite_edges(e: Entities, top: int = 40) -> DataFrame:
    """Word-trigger links of the triggers with most words."""
    best = _ranked(e, top).where("wordCount > 0").select(F.col("trigger").alias("trigger_id"))
    j = e.pair.join(F.broadcast(best), "trigger_id", "left_semi").join(e.event.select("event_id", "word_id"), "event_id").join(_keyed(e).select("word_id", "form"), "word_id")  # `top` rows
    return j.select("trigger_id", "form").distinct()


def bipartite_degree(e: Entities) -> DataFrame:
    """node, degree, radius: links of triggers and of words, counted in one pass over the edges."""
    ends = F.explode(F.array(F.struct(F.lit("trigger").alias("kind"), F.col("trigger_id").cast("string").alias("node")), F.struct(F.lit("word").alias("kind"), F.col("form").alias("node"))))
    g = bipartite_edges(e).select(ends.alias("x")).groupBy("x.kind", "x.node").agg(F.count(F.lit(1)).alias("degree"))
    radius = F.when(F.col("kind") == "trigger", 7 + 6 * F.sqrt("degree")).otherwise(5 + 2.5 * (F.col("degree") - 1))
    return g.select("kind", "node", "degree", F.round(radius, 6).alias("radius"))


def category_freq(e: Entities) -> DataFrame:
    g = e.trigger.groupBy(_category().alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("category", pretty_category(F.col("category")).alias("shown"), "n")


def connotation_arc(e: Entities) -> DataFrame:
    """Connotations of the earliest and the latest sense of each merged word; a sense without a year is the latest."""
    s = e.word_sense.join(canonical(e), "word_id").select("canon", "sense_id").distinct().join(e.sense, "sense_id")
    k = F.struct(F.coalesce("first_attested", F.lit(2**31 - 1)), "sense_id")
    return s.groupBy(F.col("canon").alias("word_id")).agg(F.min_by("connotation", k).alias("earliest"), F.max_by("connotation", k).alias("latest"))


def geo_points(e: Entities) -> DataFrame:
    """Places with finite coordinates, and how exact they are."""
    g = e.geo.where("abs(lat) < double('infinity') and abs(lon) < double('infinity') and not isnan(lat) and not isnan(lon)")
    s = F.col("coordSource")
    note = F.when(s == "P625", "exact event location (P625)").when(s == "P19", "approx: birthplace of namesake (P19)").when(s == "P159", "approx: organisation headquarters (P159)").when(s == "P740", "approx: location of formation (P740)")
    return g.select("trigger_id", "lat", "lon", "coordSource", F.coalesce(note, F.concat(F.lit("approximate location ("), F.coalesce(s, F.lit("?")), F.lit(")"))).alias("note"), F.coalesce(s == "P625", F.lit(False)).alias("exact"))


def geo_breakdown(e: Entities) -> DataFrame:
    """Located triggers by the source of their coordinates, and how many of all triggers are located."""
    g = geo_points(e).groupBy(F.coalesce("coordSource", F.lit("?")).alias("coordSource")).agg(F.count(F.lit(1)).alias("n"))
    total = e.trigger.agg(F.count(F.lit(1)).alias("triggers"))
    return g.join(F.broadcast(total)).withColumn("located", F.sum("n").over(Window.partitionBy(F.lit(0))))  # a row for each source of coordinates


def geo_impact(e: Entities) -> DataFrame:
    return geo_points(e).select("trigger_id", "lat", "lon").join(impact(e).select(F.col("trigger").alias("trigger_id"), "wordCount", read_year(F.col("year").cast("string")).alias("shownYear")), "trigger_id")


def _scaled(column: str, width: float) -> Column:
    """A linear scale from the column's least to its greatest value onto 0 to width."""
    all_ = Window.partitionBy(F.lit(0))
    lo, hi = F.min(column).over(all_), F.max(column).over(all_)
    return F.when(hi > lo, (F.col(column) - lo) / (hi - lo) * width).otherwise(width / 2)


def trigger_scatter(e: Entities, width: float = 800.0) -> DataFrame:
    """Dated triggers along an axis: x, radius by the root of their words, and their place in the column they fall into."""
    t = impact(e).where("year is not null").select("trigger", "year", "wordCount")
    ends = t.agg(F.min("year").alias("lo"), F.max("year").alias("hi"), F.max("wordCount").alias("most"))
    t = t.join(F.broadcast(ends))  # one row
    x = F.when(F.col("hi") > F.col("lo"), (F.col("year") - F.col("lo")) / (F.col("hi") - F.col("lo")) * width).otherwise(F.lit(width / 2))
    t = t.withColumns({"x": x, "radius": 6 + 22 * F.sqrt(F.col("wordCount") / F.greatest("most", F.lit(1)))})
    t = t.withColumn("col", F.floor(F.col("x") / (F.col("radius") * 2.5 + 2) + 0.5))
    w = Window.partitionBy("col")
    return t.select("trigger", "year", "wordCount", F.round("x", 6).alias("x"), F.round("radius", 6).alias("radius"), F.col("col").cast("long").alias("col"), F.row_number().over(w.orderBy("year", "trigger")).alias("place"), F.count(F.lit(1)).over(w).alias("height"))


def beeswarm(e: Entities, width: float = 800.0, radius: float = 4.0) -> DataFrame:
    """Dated events along an axis, stacked within pixel columns.

    Places within a column come from a range-partitioned order, not from one task for each column, as a column of a crowded year
    may hold any share of the events.
    """
    f = e.event.where("year is not null").join(canonical(e), "word_id", "left_semi").select("event_id", "year")
    n = f.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    ends = n.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    x = F.when(F.col("hi") > F.col("lo"), (F.col("year") - F.col("lo")) / (F.col("hi") - F.col("lo")) * width).otherwise(F.lit(width / 2))
    cols = n.join(F.broadcast(ends)).select("year", "n", F.floor(x / (2 * radius) + 0.5).cast("long").alias("col"))  # one row; years
    before = Window.partitionBy("col").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    cols = cols.select("year", "col", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("col")).alias("height"))
    # a year's events are dealt into 64 lots in order of their ids' hash; each lot numbers its own
    lot = F.pmod(F.xxhash64("event_id"), F.lit(64))
    f = f.withColumn("lot", lot)
    lots = f.groupBy("year", "lot").agg(F.count(F.lit(1)).alias("m"))
    lots = lots.select("year", "lot", F.coalesce(F.sum("m").over(Window.partitionBy("year").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lot_before"))
    j = f.join(lots, ["year", "lot"]).join(cols, "year")
    place = F.col("before") + F.col("lot_before") + F.row_number().over(Window.partitionBy("year", "lot").orderBy("event_id"))
    return j.select("event_id", "year", "col", place.cast("long").alias("place"), "height", F.round((place - 1 - (F.col("height") - 1) / 2) * (2 * radius + 1), 6).alias("offset"))


def sense_graph_edges(e: Entities) -> DataFrame:
    """Edges of each word's graph: drift from sense to sense, and from an event's sense (the later, or else the earlier one) to its triggers."""
    ev = e.event.select("event_id", "word_id").join(canonical(e), "word_id").join(e.event_sense, "event_id").join(e.event_label, "event_id", "left")
    s = lambda c: F.col(c).cast("string")
    drift = ev.where("sense_from is not null and sense_to is not null").select("canon", "event_id", F.lit("drift").alias("kind"), s("sense_from").alias("source"), s("sense_to").alias("target"), F.coalesce("type", F.lit("")).alias("label"))
    trig = ev.join(e.pair, "event_id").select("canon", "event_id", F.lit("trigger").alias("kind"), F.coalesce(s("sense_to"), s("sense_from")).alias("source"), s("trigger_id").alias("target"), F.lit("").alias("label")).where("source is not null")
    return drift.unionByName(trig).withColumnRenamed("canon", "word_id")


def word_timeline(e: Entities) -> DataFrame:
    """The years that each word's timeline spans: 20 before the first and 30 after the last of its senses, events, triggers and frequencies; year 0 counts as unknown. Words without senses have none."""
    c = canonical(e)
    ev = e.event.select("event_id", "word_id", "year").join(c, "word_id")
    s = e.word_sense.join(c, "word_id").join(e.sense.select("sense_id", "first_attested"), "sense_id").select("canon", F.col("first_attested").alias("year"))
    t = ev.select("canon", "event_id").join(e.pair, "event_id").select("canon", "trigger_id").distinct().join(e.trigger.select("trigger_id", F.col("date").alias("year")), "trigger_id").select("canon", "year")
    f = e.frequency.join(c, "word_id").select("canon", "year")
    years = ev.select("canon", "year").unionByName(s).unionByName(t).unionByName(f).where("year <> 0").groupBy("canon").agg((F.min("year") - 20).alias("yearMin"), (F.max("year") + 30).alias("yearMax"))
    return years.join(s.select("canon").distinct(), "canon", "left_semi").withColumnRenamed("canon", "word_id")


def year_formats(e: Entities) -> DataFrame:
    y = e.trigger.select("trigger_id", (F.col("date") - 1950).alias("y"))
    return y.select("trigger_id", show_year(F.col("y")).alias("shown"), gyear(F.col("y")).alias("gyear"), slug(F.concat(F.lit("  Year of: "), F.col("y").cast("string"), F.lit("!"))).alias("slug"))


def evidence_rungs(e: Entities) -> DataFrame:
    """Evidence labels of hypotheses by rung, in several spellings."""
    t = e.claim.select(F.explode("evidence").alias("evidence")).groupBy("evidence").agg(F.count(F.lit(1)).alias("n"))
    raw = F.lower(F.regexp_replace("evidence", "([a-z])([A-Z])", "$1-$2"))
    return t.select("evidence", "n", evidence_rung(raw).alias("rung"), rung_name(evidence_rung(raw)).alias("name"))


def qids(e: Entities) -> DataFrame:
    return e.trigger.select("trigger_id", qid(F.col("same_as")).alias("qid"), qid(F.concat("same_as", F.lit(" (x)")), anchored=True).alias("none"))


_LINKS = "link AS (SELECT label, m.form AS word, m.lang, arg_min(type, o) AS type, arg_min(confidence, o) AS confidence, arg_min(event_id, o) AS event_id, arg_min(trigger_id, o) AS trigger_id FROM (SELECT h.*, t.label, e.type, e.word_id, e.year, row_number() OVER (ORDER BY e.year, h.event_id, h.confidence DESC, h.trigger_id) AS o FROM hyp h JOIN trig t USING (trigger_id) JOIN event e ON e.event_id = h.event_id) JOIN canon USING (word_id) JOIN merged m ON m.id = canon GROUP BY label, m.form, m.lang)"
_BEST = "best AS (SELECT *, row_number() OVER (ORDER BY n DESC, year, trigger) AS rank FROM impact ORDER BY n DESC, year, trigger LIMIT 40)"
_EDGES = f"{_IMPACT}, {_BEST}, edge AS (SELECT DISTINCT h.trigger_id, m.form FROM hyp h JOIN best ON best.trigger = h.trigger_id AND best.n > 0 JOIN event USING (event_id) JOIN canon USING (word_id) JOIN merged m ON m.id = canon)"
_LOST = f"{_FLAT}, lost AS (SELECT CASE WHEN tc = 'negative' THEN 'poisoned' ELSE 'reclaimed' END AS kind, event_id, word, lang, year, fc, tc, CASE WHEN tc = 'negative' THEN fc ELSE tc END AS o FROM flat WHERE (coalesce(tc, '') = 'negative') <> (coalesce(fc, '') = 'negative'))"
_RUNG = "CASE evidence WHEN 'ScholarlyAttestation' THEN 4 WHEN 'LexicographicNote' THEN 3 WHEN 'FrequencyCorrelation' THEN 1 WHEN 'Speculative' THEN 0 ELSE -1 END"

SQL = {
    "facet_filter": "SELECT id, form AS \"writtenForm\", lang AS language, source, quality FROM merged WHERE contains(lower(form), 'w1') AND lang = 'en' AND quality IN ('high', 'benchmark')",
    "facet_year_overlap": f", {_FLAT}, {_LIGHT} SELECT id, form AS \"writtenForm\", lang AS language, source, quality FROM light LEFT JOIN (SELECT canon AS id, bool_or(year BETWEEN 1996 AND 1997) AS hit FROM flat WHERE year IS NOT NULL GROUP BY canon) USING (id) WHERE coalesce(hit, (y0 <= 1997 AND y1 >= 1996), true)",
    "facet_all": f", {_FLAT} SELECT id, form AS \"writtenForm\", lang AS language, source, quality FROM merged m WHERE m.id IN (SELECT canon FROM flat WHERE contains(lower(type), 'urgent')) AND m.id IN (SELECT canon FROM flat WHERE fc = 'positive' OR tc = 'positive') AND m.id IN (SELECT canon FROM flat JOIN ev USING (event_id) WHERE evidence = 'Speculative') AND m.id IN (SELECT canon FROM flat WHERE has) AND EXISTS (SELECT 1 FROM word w JOIN canon c USING (word_id) WHERE c.canon = m.id AND w.source IN ('GfdS', 'DWUG'))",
    "resolve_word": ", r AS (SELECT id, form, lang, CASE WHEN form = 'W3' AND lang = 'de' THEN 0 WHEN form = 'W3' THEN 1 WHEN lower(form) = 'w3' THEN 2 WHEN CAST(id AS VARCHAR) = 'W3' THEN 3 END AS rank FROM merged) SELECT id, form, lang, CAST(rank AS INT) AS rank FROM r WHERE rank IS NOT NULL ORDER BY rank, lang <> 'en', id LIMIT 1",
    "fuzzy_search": ", i AS (SELECT 'word' AS kind, form AS label, CAST(id AS VARCHAR) AS id FROM merged UNION ALL SELECT 'trigger', label, CAST(trigger_id AS VARCHAR) FROM trig), s AS (SELECT kind, label, id, CASE WHEN lower(label) = 'w12' THEN 1000.0 ELSE 800.0 - length(label) END AS score FROM i WHERE starts_with(lower(label), 'w12')) SELECT kind, label, id, CAST(score AS DOUBLE) AS score FROM s ORDER BY score DESC, label, kind, id LIMIT 10",
    "featured": ", f AS (SELECT form, arg_min(id, CASE WHEN lang = 'en' THEN 0 ELSE 1000000000 END + id) AS id, arg_min(lang, CASE WHEN lang = 'en' THEN 0 ELSE 1000000000 END + id) AS lang FROM merged WHERE form IN ('w1', 'w2', 'w5', 'w7', 'nothing') GROUP BY form) SELECT CAST(list_position(['w1', 'w2', 'w5', 'w7', 'nothing'], form) AS INT) AS ord, form, id, lang FROM f WHERE (SELECT count(*) FROM f) >= 4",
    "top_cause": ", r AS (SELECT canon AS word_id, trigger_id, confidence, row_number() OVER (PARTITION BY canon ORDER BY confidence DESC, year, event_id, trigger_id) AS k FROM hyp JOIN event USING (event_id) JOIN canon USING (word_id)) SELECT word_id, trigger_id, confidence FROM r WHERE k = 1",
    "cause_rank": "SELECT label, count(*) AS n FROM hyp JOIN trig USING (trigger_id) GROUP BY label",
    "last_cause": ", c AS (SELECT canon, label, h.event_id, h.trigger_id, confidence, row_number() OVER (PARTITION BY canon, label ORDER BY year DESC, h.event_id DESC, confidence, h.trigger_id DESC) AS k FROM hyp h JOIN event e ON e.event_id = h.event_id JOIN canon USING (word_id) JOIN trig t ON t.trigger_id = h.trigger_id) SELECT canon AS word_id, label, confidence, (SELECT string_agg(evidence, '; ' ORDER BY evidence) FROM ev WHERE ev.event_id = c.event_id AND ev.trigger_id = c.trigger_id) AS evidence FROM c WHERE k = 1",
    "decade_stack": ", d AS (SELECT CAST(floor(year / 10.0) * 10 AS INT) AS decade, type, count(*) AS n FROM event GROUP BY ALL), g AS (SELECT a.decade, b.type, coalesce(d.n, 0) AS n FROM (SELECT DISTINCT decade FROM d) a CROSS JOIN (SELECT DISTINCT type FROM d) b LEFT JOIN d ON d.decade = a.decade AND d.type = b.type) SELECT decade, type, n, CAST(sum(n) OVER (PARTITION BY decade ORDER BY type ROWS UNBOUNDED PRECEDING) AS BIGINT) AS top FROM g",
    "trend_buckets": f", {_FLAT} SELECT CAST(floor(year / 10.0) * 10 AS INT) AS bucket, CAST(floor(year / 10.0) * 10 AS INT) || 's' AS label, type, coalesce(tc, 'neutral') AS \"toConn\", count(*) AS n FROM flat GROUP BY ALL",
    "trend_share": ", g AS (SELECT CAST(floor(year / 10.0) * 10 AS INT) AS bucket, type, count(*) AS n FROM event JOIN word USING (word_id) GROUP BY ALL) SELECT bucket, type, n, round(n / sum(n) OVER (PARTITION BY bucket), 6) AS share, CAST(round(100 * n / sum(n) OVER (PARTITION BY bucket)) AS INT) || '%' AS pct FROM g",
    "lexical_loss": f", {_LOST} SELECT kind, event_id, word, lang, year, fc AS \"fromConn\", tc AS \"toConn\", CAST(CASE o WHEN 'positive' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS INT) AS rank FROM lost",
    "loss_stats": f", {_LOST} SELECT count(*) FILTER (kind = 'poisoned') AS poisoned, count(*) FILTER (kind = 'reclaimed') AS reclaimed, count(*) FILTER (kind = 'poisoned') - count(*) FILTER (kind = 'reclaimed') AS net, round(100.0 * count(*) FILTER (kind = 'poisoned') / count(*), 6) AS \"poisonedPct\", round(100.0 * count(*) FILTER (kind = 'reclaimed') / count(*), 6) AS \"reclaimedPct\" FROM lost",
    "xling_pairs": f", {_XLING}, t AS (SELECT DISTINCT canon, trigger_id, label, date FROM hyp JOIN event USING (event_id) JOIN canon USING (word_id) JOIN trig USING (trigger_id)), c AS (SELECT s.word_id, s.other_id, min(p.label) AS shared FROM sym s JOIN t p ON p.canon = s.word_id JOIN t q ON q.canon = s.other_id AND q.label = p.label GROUP BY ALL) SELECT d.form AS de, n.form AS en, shared, (SELECT arg_min(date, trigger_id) FROM trig WHERE label = shared) AS year FROM sym s JOIN merged d ON d.id = s.word_id AND d.lang = 'de' JOIN merged n ON n.id = s.other_id AND n.lang = 'en' LEFT JOIN c ON c.word_id = s.word_id AND c.other_id = s.other_id",
    "trigger_hypotheses": f", {_LINKS} SELECT word, lang, type AS \"driftType\", confidence, (SELECT string_agg(evidence, '; ' ORDER BY evidence) FROM ev WHERE ev.event_id = link.event_id AND ev.trigger_id = link.trigger_id) AS evidence FROM link WHERE label = (SELECT label FROM trig WHERE trigger_id = 3)",
    "trigger_summary": f", {_LINKS}, r AS (SELECT label, word, lang, any_value(confidence) AS confidence, max({_RUNG}) AS rung FROM link JOIN ev ON ev.event_id = link.event_id AND ev.trigger_id = link.trigger_id GROUP BY label, word, lang) SELECT label, round(avg(confidence), 6) AS \"meanConf\", min(confidence) AS \"minConf\", max(confidence) AS \"maxConf\", count(*) FILTER (rung = 0) AS rung0, count(*) FILTER (rung = 1) AS rung1, count(*) FILTER (rung = 2) AS rung2, count(*) FILTER (rung = 3) AS rung3, count(*) FILTER (rung = 4) AS rung4 FROM r GROUP BY label",
    "trigger_reach": f", {_LINKS} SELECT label, count(*) AS words, count(DISTINCT lang) AS languages, string_agg(DISTINCT CASE lang WHEN 'en' THEN 'English' ELSE 'German' END, ', ' ORDER BY CASE lang WHEN 'en' THEN 'English' ELSE 'German' END) AS \"languageNames\" FROM link GROUP BY label",
    "trigger_cooccur": f", {_IMPACT}, {_BEST}, t AS (SELECT rank, trigger, lower(category) AS category, CAST(floor(year / 10.0) * 10 AS INT) AS decade FROM best WHERE category IS NOT NULL) SELECT x.trigger AS a, y.trigger AS b, category, decade FROM t x JOIN t y USING (category, decade) WHERE x.rank < y.rank",
    "bipartite_edges": f", {_EDGES} SELECT trigger_id, form FROM edge",
    "bipartite_degree": f", {_EDGES} SELECT 'trigger' AS kind, CAST(trigger_id AS VARCHAR) AS node, count(*) AS degree, round(7 + 6 * sqrt(count(*)), 6) AS radius FROM edge GROUP BY trigger_id UNION ALL SELECT 'word', form, count(*), round(5 + 2.5 * (count(*) - 1), 6) FROM edge GROUP BY form",
    "category_freq": "SELECT coalesce(lower(trim(category)), 'uncategorised') AS category, upper(coalesce(category, 'uncategorised'))[1] || lower(coalesce(category, 'uncategorised'))[2:] AS shown, count(*) AS n FROM trig GROUP BY ALL",
    "connotation_arc": ", s AS (SELECT DISTINCT canon AS word_id, sense_id FROM (SELECT word_id, unnest([sense_from, sense_to]) AS sense_id FROM es JOIN event USING (event_id)) JOIN canon USING (word_id)) SELECT word_id, arg_min(connotation, CAST(first_attested AS BIGINT) * 1000000000 + sense_id) AS earliest, arg_max(connotation, CAST(first_attested AS BIGINT) * 1000000000 + sense_id) AS latest FROM s JOIN sense USING (sense_id) GROUP BY word_id",
    "geo_points": "SELECT s_suppkey AS trigger_id, round(s_acctbal % 90, 4) AS lat, CAST(s_suppkey % 180 AS DOUBLE) AS lon, CASE s_suppkey % 4 WHEN 0 THEN 'P625' WHEN 1 THEN 'P19' WHEN 2 THEN 'P999' END AS \"coordSource\", CASE s_suppkey % 4 WHEN 0 THEN 'exact event location (P625)' WHEN 1 THEN 'approx: birthplace of namesake (P19)' WHEN 2 THEN 'approximate location (P999)' ELSE 'approximate location (?)' END AS note, s_suppkey % 4 = 0 AS exact FROM supplier WHERE s_suppkey % 7 <> 0 AND s_acctbal IS NOT NULL",
    "geo_breakdown": "SELECT CASE s_suppkey % 4 WHEN 0 THEN 'P625' WHEN 1 THEN 'P19' WHEN 2 THEN 'P999' ELSE '?' END AS \"coordSource\", count(*) AS n, (SELECT count(*) FROM supplier) AS triggers, CAST(sum(count(*)) OVER () AS BIGINT) AS located FROM supplier WHERE s_suppkey % 7 <> 0 AND s_acctbal IS NOT NULL GROUP BY 1",
    "geo_impact": f", {_IMPACT} SELECT trigger AS trigger_id, round(s_acctbal % 90, 4) AS lat, CAST(trigger % 180 AS DOUBLE) AS lon, n AS \"wordCount\", CAST(year AS VARCHAR) AS \"shownYear\" FROM impact JOIN supplier ON s_suppkey = trigger WHERE trigger % 7 <> 0",
    "trigger_scatter": f", {_IMPACT}, s AS (SELECT trigger, year, n, (year - min(year) OVER ()) / (max(year) OVER () - min(year) OVER ()) * 800.0 AS x, 6 + 22 * sqrt(n / greatest(max(n) OVER (), 1)) AS radius FROM impact), c AS (SELECT *, CAST(floor(x / (radius * 2.5 + 2) + 0.5) AS BIGINT) AS col FROM s) SELECT trigger, year, n AS \"wordCount\", round(x, 6) AS x, round(radius, 6) AS radius, col, CAST(row_number() OVER (PARTITION BY col ORDER BY year, trigger) AS INT) AS place, count(*) OVER (PARTITION BY col) AS height FROM c",
    "sense_graph_edges": "SELECT canon AS word_id, e.event_id, 'drift' AS kind, CAST(sense_from AS VARCHAR) AS source, CAST(sense_to AS VARCHAR) AS target, type AS label FROM event e JOIN canon USING (word_id) JOIN es ON es.event_id = e.event_id UNION ALL SELECT canon, e.event_id, 'trigger', CAST(sense_to AS VARCHAR), CAST(trigger_id AS VARCHAR), '' FROM event e JOIN canon USING (word_id) JOIN es ON es.event_id = e.event_id JOIN hyp ON hyp.event_id = e.event_id",
    "word_timeline": ", y AS (SELECT word_id, year FROM event UNION ALL SELECT word_id, year FROM freq UNION ALL SELECT word_id, first_attested FROM (SELECT word_id, unnest([sense_from, sense_to]) AS sense_id FROM es JOIN event USING (event_id)) JOIN sense USING (sense_id) UNION ALL SELECT word_id, date FROM event JOIN hyp USING (event_id) JOIN trig USING (trigger_id)) SELECT canon AS word_id, min(year) - 20 AS \"yearMin\", max(year) + 30 AS \"yearMax\" FROM y JOIN canon USING (word_id) WHERE year <> 0 AND canon IN (SELECT canon FROM event JOIN es USING (event_id) JOIN canon USING (word_id)) GROUP BY canon",
    "fmt_year": "SELECT trigger_id, CASE WHEN date < 1950 THEN (1950 - date) || ' BC' ELSE CAST(date - 1950 AS VARCHAR) END AS shown, CASE WHEN date < 1950 THEN '-' ELSE '' END || lpad(CAST(abs(date - 1950) AS VARCHAR), 4, '0') AS gyear, 'year-of-' || abs(date - 1950) AS slug FROM trig",
    "evidence_rung": f"SELECT evidence, count(*) AS n, CAST(CASE WHEN evidence = 'ChangeSignalAlignment' THEN 2 ELSE {_RUNG} END AS INT) AS rung, CASE WHEN evidence <> 'Other' THEN evidence END AS name FROM ev GROUP BY evidence",
    "qid_extract": "SELECT trigger_id, 'Q' || trigger_id AS qid, CAST(NULL AS VARCHAR) AS none FROM trig",
}
