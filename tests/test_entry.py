"""Every core query runs, and agrees with its SQL where there is one, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from paraleaf import queries_corpus, queries_evaluate, queries_nested, queries_pages, queries_sources, queries_suite, queries_text

CORE = {k: f for m in (queries_nested, queries_text, queries_pages, queries_evaluate, queries_corpus, queries_sources, queries_suite) for k, f in m.QUERIES.items()}


def rows(df):
    df = df[sorted(df.columns)]
    import pandas as pd

    def show(v):
        gone = v is None or (pd.api.types.is_scalar(v) and pd.isna(v))
        return "NULL" if gone else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(show(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, sf, con, name):
    got = CORE[name](spark, sf).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
