"""Every query of the catalog against its SQL twin on the smallest tables."""

import duckdb
import pytest

from semshift.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, sql, name):
    df = catalog.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = sql.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
    assert found == want


def test_every_query_has_a_twin_or_laws():
    assert set(catalog.queries()) == set(catalog.oracle_sql()) | set(catalog.BY_LAW)


def test_beeswarm_laws(spark):
    """Each column's events stand at places 1 to its height, around its middle; earlier years lower."""
    rows = catalog.queries()["beeswarm"](spark, FOLDER).collect()
    cols = {}
    for r in rows:
        cols.setdefault(r.col, []).append(r)
    assert len(rows) == len({r.event_id for r in rows}) > 0
    for rs in cols.values():
        rs.sort(key=lambda r: r.place)
        assert [r.place for r in rs] == list(range(1, len(rs) + 1)) and {r.height for r in rs} == {len(rs)}
        assert [r.year for r in rs] == sorted(r.year for r in rs)
        assert abs(sum(r.offset for r in rs)) < 1e-3


def test_random_word_is_seeded(spark):
    from semshift.operators.views import random_word
    from semshift.sources.lens import Entities

    e = Entities(spark, FOLDER)
    found = [random_word(e, seed).collect() for seed in (1, 1, 2, 3)]
    assert found[0] == found[1] and len({r[0].id for r in found}) > 1
