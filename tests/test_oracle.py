"""Every query of the model against the SQL that gives the same rows."""

import os

import duckdb
import pytest

from voltgrain.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        at = f"{sf_dir}/{name}"
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{at + '/*.parquet' if os.path.isdir(at) else at}')")
    return con


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sf_dir, duck, name):
    found, want = QUERIES[name](spark, sf_dir), duck.sql(SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert sorted_rows(found.select(*want.columns).collect()) == sorted_rows(want.fetchall())


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_file(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["municipio", "distribuidora", "score_risco"]
    assert entry.entry(spark).count() == 5
