"""Derived tables that a query uses several times are joined once."""

from sparkloom.plans.context import FIXTURES, Tables


def test_edges_are_joined_once(spark, sf):
    tables = Tables(spark, sf)
    plan = tables.kg_edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and tables.kg_edges is tables.kg_edges
    want = Tables(spark, sf).sql(FIXTURES["kg_edges"])
    assert sorted(map(tuple, tables.kg_edges.collect())) == sorted(map(tuple, want.collect()))
