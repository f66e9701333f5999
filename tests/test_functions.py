"""The capabilities as SQL table functions, against their DataFrame form."""

import pytest

from semshift.operators import questions as q
from semshift.plans import catalog, functions
from semshift.sources import graph, turtle
from test_graph import A, B


@pytest.fixture(scope="module")
def g(spark, tmp_path_factory):
    f = tmp_path_factory.mktemp("functions")
    (f / "a.ttl").write_text(A)
    (f / "b.ttl").write_text(B)
    graph.write_graph(turtle.distinct_triples(turtle.read_turtle(spark, str(f))), str(f / "stored"))
    found = graph.Graph(spark.read.parquet(str(f / "stored")))
    functions.register(spark, found, "t_")
    return found


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


#: A call in SQL, and the same capability as DataFrames.
CALLS = {
    "t_cq_most_reframed()": q.cq01,
    "t_cq_hypotheses('cloud')": lambda g: q.cq02(g, "cloud"),
    "t_cq_hypotheses(word => 'Wolke')": lambda g: q.cq02(g, "Wolke"),
    "t_cq_cross_lingual('Wolke')": lambda g: q.cq04(g, "Wolke"),
    "t_cq_cross_lingual(word => 'cloud')": lambda g: q.cq04(g, "cloud"),
    "t_cq_triggers_in_range()": q.cq06,
    "t_cq_triggers_in_range(2000, 2010)": lambda g: q.cq06(g, 2000, 2010),
    "t_cq_triggers_in_range(year_to => 1930)": lambda g: q.cq06(g, year_to=1930),
    "t_cq_reappropriation()": lambda g: q.cq11(g, "Reappropriation"),
    "t_cq_reappropriation(drift_type => 'Metaphor')": lambda g: q.cq11(g, "Metaphor"),
    "t_cq_sense_timeline()": q.cq10,
    "t_health()": catalog.capability("health"),
}


@pytest.mark.parametrize("call", CALLS)
def test_function_gives_what_its_capability_gives(spark, g, call):
    got, want = spark.sql(f"SELECT * FROM {call}"), CALLS[call](g)
    assert got.columns == want.columns and rows(got) == rows(want) and rows(got)


def test_functions_are_the_capabilities():
    assert set(functions.FUNCTIONS) == set(catalog.CAPABILITIES) - {"graph_core", "graph_detail", "graph_full", "sparql_query"}


def test_null_argument_gives_no_rows_and_functions_join(spark, g):
    assert rows(spark.sql("SELECT * FROM t_cq_hypotheses(NULL)")) == []
    both = spark.sql("SELECT r.triggerLabel, h.word FROM t_cq_triggers_in_range(year_from => 2000, year_to => 2010) r JOIN t_cq_hypotheses('cloud') h ON h.trigger = r.triggerLabel")
    assert set(rows(both)) == {("Launch", "cloud")}


def test_argument_reaches_the_form_before_the_join(spark, g):
    """One side of the pairs is filtered by its form, so that the join makes that form's pairs only."""
    plan = spark.sql("SELECT * FROM t_cq_cross_lingual('Wolke')")._jdf.queryExecution().optimizedPlan().toString()
    joins = [i for i, line in enumerate(plan.splitlines()) if "Join" in line]
    filters = [i for i, line in enumerate(plan.splitlines()) if "Filter" in line and "= Wolke" in line]
    assert filters and max(filters) > joins[0]
