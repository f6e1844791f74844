import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__ as entry
from haplolake.plans.views import TABLES
from tools.compare import rows

FOLDER = "/root/testdata/sf0.001"


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@pytest.fixture(scope="module")
def results(spark):
    """Columns and rows of every query with SQL, several running at a time."""
    queries = entry.queries()

    def run(name):
        df = queries[name](spark, FOLDER)
        return df.columns, df.collect()

    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(run, name) for name in entry.oracle_sql()}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_sql(results, name):
    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    columns, got = results[name].result()
    cur = base.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(columns)
    assert rows(columns, got) == rows(names, cur.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
