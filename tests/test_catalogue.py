"""Every archive query against its SQL in DuckDB, over the same tables."""

import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pandas as pd
import pytest

from palimpsest.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def found(spark):
    """{query: (Spark's rows, DuckDB's rows) or the error}; a few queries at a time, as each is small."""
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")

    def both(name):
        try:
            return catalogue.QUERIES[name](spark, DATA).toPandas(), con.cursor().sql(catalogue.SQL[name]).df()
        except Exception as e:  # told by the test of that query
            return e

    names = sorted(catalogue.SQL)
    with ThreadPoolExecutor(4) as pool:
        return dict(zip(names, pool.map(both, names)))


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if pd.isna(v):
            return ""
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(found, name):
    if isinstance(found[name], Exception):
        raise found[name]
    got, want = found[name]
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


@pytest.mark.parametrize("name", ["authority_replay", "ledger_conservation", "reachability_faults", "attachment_partition_check", "stale_certificates", "import_slots"])
def test_faults_are_planted(found, name):
    """Queries that look for faults look at tables with faults in them: none is empty by construction."""
    assert len(found[name][0])
