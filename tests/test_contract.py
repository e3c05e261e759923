"""The registered queries against their SQL on the smallest tables, and the driver's entry point."""

import duckdb
import pytest

import __spark_entry__ as entry
from pitpanel.plans import registry

SF = "/root/testdata/sf0.001"
#: Queries outside the training-data part whose SQL gives rows on the smallest tables.
COMPARED = sorted(registry.ORACLES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = lambda x: round(float(x), 6) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else None if x is None or x != x else str(x)[:10] if hasattr(x, "isoformat") else x
    return sorted(([flat(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", COMPARED)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_no_query_keeps_a_table_cached(spark):
    for name in ("k10_areas", "k12_calibration", "k22_conformal", "k24_scales", "k28_promotion"):
        entry.queries()[name](spark, SF).collect()
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
