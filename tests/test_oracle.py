"""Every registered query with SQL against DuckDB on the smallest tables, and the others for their rows."""

import datetime
import decimal

import duckdb
import pytest

from sparkloom.plans.catalog import ORACLES, QUERIES
from sparkloom.plans.context import TABLES

#: Queries whose result may be empty on the smallest tables.
MAY_BE_EMPTY = {"scenario_boundary", "followup_gate", "performance_gate", "ingestion_gate", "evaluation_gate", "source_boundary", "detect_communities", "faq_document_conflicts", "query_document_match"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def order(row):
    return tuple((x is None, "n" if isinstance(x, (int, float)) else str(type(x)), 0 if x is None else x) for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    assert got or name in MAY_BE_EMPTY
    if name in ORACLES:
        cur = con.execute(ORACLES[name])
        cols = [x[0] for x in cur.description]
        names = sorted(cols)
        assert names == sorted(df.columns)
        want = sorted((tuple(plain(r[cols.index(c)]) for c in names) for r in cur.fetchall()), key=order)
        assert sorted((tuple(plain(r[c]) for c in names) for r in got), key=order) == want


def test_entry(spark):
    import __spark_entry__

    row = __spark_entry__.entry(spark).collect()[0]
    assert row.cases > 0 and row.annotated > 0 and row.recall_at_5 == 1.0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
