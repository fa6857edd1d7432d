"""Every registered query with SQL against DuckDB, on the small tables of the test data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, rows
from gapweave.plans import registry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, D).toArrow()
    sql = registry.oracle_sql().get(name)
    if sql is not None:
        want = con.sql(sql).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_known_counts(spark):
    """Counts that independent implementations found on these tables."""
    q = registry.queries()
    assert q["hash_windows"](spark, D).select("item").distinct().count() == 152
    assert q["knn_radius"](spark, D).count() == 158
    assert q["duplicate_pairs"](spark, D).count() == 2
    assert q["group_sizes"](spark, D).count() == 2


def test_projections_miss_few_pairs(spark):
    q = registry.queries()
    exact = {(r.q, r.item) for r in q["knn_embeddings"](spark, D).collect()}
    found = {(r.q, r.item) for r in q["knn_lsh"](spark, D).select("q", "item").collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact) > 0
