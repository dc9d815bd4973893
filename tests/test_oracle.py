"""Every registered query against its DuckDB form on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = "part documents".split()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(set(E.oracle_sql()) - set(E.LLM_SQL)))
def test_query_matches_oracle(spark, con, key):
    sdf = E.queries()[key](spark, SF_SMALL).toPandas()
    ddf = con.sql(E.oracle_sql()[key]).df()
    assert sorted(sdf.columns) == sorted(ddf.columns)
    cols = sorted(sdf.columns)
    s = sorted(tuple(_norm(r[c]) for c in cols) for r in sdf.to_dict("records"))
    d = sorted(tuple(_norm(r[c]) for c in cols) for r in ddf.to_dict("records"))
    assert s == d


def test_every_query_has_oracle():
    assert set(E.QUERIES) == set(E.oracle_sql()) - set(E.LLM_SQL)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["pair_id", "nl_sentence", "fol_expression"]
    assert df.count() == 1800
