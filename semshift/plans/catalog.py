"""Every registered query of the knowledge-graph engine with its SQL twin, and the capabilities that callers name."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from .. import sparql
from ..operators import document as d
from ..operators import questions as q
from ..operators import triples as t
from ..operators import views as v
from ..sources import exports, lens
from . import functions

#: Name of a query -> function of the entity tables.
ANALYTICS: dict[str, Callable[[lens.Entities], DataFrame]] = {
    **{f"cq{i:02d}": getattr(q, f"cq{i:02d}") for i in range(1, 13) if i != 4},
    "cq04": q.cq04_classes,
    "cq04_word": partial(q.cq04, word="w7"),
    **{n: getattr(d, n) for n in ("word_dedup", "words_order", "flat_events", "by_decade_type", "trigger_impact", "facets", "meta_counts", "freq_series", "word_span", "xling_symmetric", "drift_types")},
    **{
        n: getattr(v, n)
        for n in (
            "facet_filter", "resolve_word", "fuzzy_search", "featured", "top_cause", "last_cause", "cause_rank", "decade_stack", "trend_buckets", "trend_share", "lexical_loss", "loss_stats", "xling_pairs", "trigger_hypotheses", "trigger_summary", "trigger_reach", "trigger_cooccur", "bipartite_edges",
            "bipartite_degree", "category_freq", "connotation_arc", "geo_points", "geo_breakdown", "geo_impact", "trigger_scatter", "beeswarm", "sense_graph_edges", "word_timeline", "random_word",
        )
    },
    "facet_year_overlap": partial(v.facet_filter, search="", langs=(), qualities=(), year_from=1996, year_to=1997),
    "facet_all": partial(v.facet_filter, search="", langs=(), qualities=(), sources=("GfdS", "DWUG"), types=("urgent",), connotations=("Positive",), evidences=("speculative",), has_trigger=True),
    "fmt_year": v.year_formats,
    "evidence_rung": v.evidence_rungs,
    "qid_extract": v.qids,
    **{n: getattr(t, n) for n in ("distinct_words", "optional_left", "optional_filtered", "interval_chain", "sense_rows", "word_senses", "words_admissible", "hyp_evidence", "trigger_collapse", "derive_source")},
    "fn_triggers_in_range": lambda e: functions.called(e, "cq_triggers_in_range", "year_from => 1900, year_to => 1999"),
    "fn_hypotheses": lambda e: functions.called(e, "cq_hypotheses", "word => 'w7'"),
    "fn_cross_lingual": lambda e: functions.called(e, "cq_cross_lingual", "word => 'w7'"),
    "parse_year": t.parsed_years,
    "local_name": t.local_names,
    "fmt_gyear": t.gyears,
    "slugify": t.slugs,
    **{n: getattr(exports, n) for n in ("csv_words", "claims_ledger", "words_csv", "triggers_csv")},
    **{n: (lambda e, n=n: getattr(t, n)(e.triples)) for n in ("triple_count", "triples_distinct", "scan_class", "entity_counts", "lang_filter", "label_fallback", "shacl_report", "shacl_focus")},
    **{n: (lambda e, text=text: sparql.query(e.triples, text)) for n, text in t.SPARQL.items()},
}

#: Results for which no SQL on the tables says which rows come out: they are tested by their laws.
BY_LAW = ("beeswarm", "random_word")

SQL = {
    **q.SQL, **d.SQL, **v.SQL, **t.SQL, **exports.sql(d._FLAT, d._LIGHT),
    "fn_triggers_in_range": q.SQL["cq06"], "fn_hypotheses": q.SQL["cq02"], "fn_cross_lingual": q.SQL["cq04_word"],
    "drift_types": "SELECT DISTINCT type AS id, type AS label, CASE WHEN type[1] IN ('1', '2') THEN 'pressing' WHEN type[1] IN ('3', '4') THEN 'usual' END AS \"broaderId\", CASE WHEN type[1] IN ('1', '2') THEN 'pressing' WHEN type[1] IN ('3', '4') THEN 'usual' END AS \"broaderLabel\" FROM event",
}


def _on_lens(analytic: Callable[[lens.Entities], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: analytic(lens.Entities(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _on_lens(f) for name, f in ANALYTICS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: f"{lens.SQL.rstrip()}{'' if sql.startswith(',') else ' '}{sql}" for name, sql in SQL.items()}


#: What callers may name, on any entity tables: `capability("cq_hypotheses")(graph, word="lamp")`.
CAPABILITIES: dict[str, Callable] = {
    "graph_core": lambda e: d.single_document(e, "core"), "graph_detail": lambda e: d.single_document(e, "detail"), "graph_full": lambda e: d.single_document(e, "full"),
    "health": lambda e: t.triple_count(e.triples), "sparql_query": lambda e, query, **kw: sparql.query(e.triples, query, **kw),
    "cq_most_reframed": q.cq01, "cq_hypotheses": q.cq02, "cq_drift_by_trigger": q.cq03, "cq_cross_lingual": q.cq04, "cq_connotation_reversed": q.cq05, "cq_triggers_in_range": q.cq06, "cq_speculative_only": q.cq07,
    "cq_strongest_evidence": q.cq08, "cq_competing": q.cq09, "cq_sense_timeline": q.cq10, "cq_reappropriation": q.cq11, "cq_provenance": q.cq12,
}


def capability(name: str) -> Callable:
    if name not in CAPABILITIES:
        raise KeyError(f"no capability {name!r}; there are {', '.join(sorted(CAPABILITIES))}")
    return CAPABILITIES[name]
