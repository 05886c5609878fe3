"""BM25 over shards of documents and slices of queries against one shard and one slice."""

import os
import random

from sparkloom.operators import lexical_store as L


def test_shards_and_slices(spark, monkeypatch, tmp_path):
    r = random.Random(3)
    said = lambda n: " ".join(r.choices([f"t{i}" for i in range(60)], [1 / (i + 1) for i in range(60)], k=n))
    docs = [(i, said(r.choice([1, 5, 30]))) for i in range(300)] + [(300 + i, "t1 t2") for i in range(40)]
    path = str(tmp_path / "store")
    L.write_bm25_store(spark.createDataFrame(docs, "key long, text string"), path)
    assert not os.path.exists(f"{path}/blocks")  # no postings are dealt out by term
    store = L.open_bm25_store(spark, path)
    queries = spark.createDataFrame([(i, said(4)) for i in range(30)] + [(30, "t1 t2")], "query_id long, text string")
    rows = lambda: sorted(tuple(x) for x in L.search_bm25_store(queries, store, 6).collect())
    one = rows()
    monkeypatch.setattr(L, "SHARD", 25)
    monkeypatch.setattr(L, "SLICE", 7)
    assert rows() == one == sorted(tuple(x) for x in L.search_counted(queries, store, 6)[0].collect())
    plan = L.search_bm25_store(queries, store, 6)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan


def test_cells_meet_packed_pieces(spark, tmp_path):
    """What is dealt to the cells of a search is a value for many documents or weights, not a row for each."""
    docs = spark.createDataFrame([(i, f"t{i % 7} t{i % 5} common") for i in range(1500)], "key long, text string").repartition(2)
    path = str(tmp_path / "store")
    L.write_bm25_store(docs, path)
    store = L.open_bm25_store(spark, path)
    pieces = L._packed_docs(store.docs, 3)
    assert pieces.count() <= 1500 // L.PIECE + 8 and {x.shard for x in pieces.collect()} <= {0, 1, 2}
    held = [r for x in pieces.collect() for r in L.pa.ipc.open_stream(x.rows).read_all().column("key").to_pylist()]
    assert sorted(held) == list(range(1500))
    queries = spark.createDataFrame([(i, f"t{i % 7} common") for i in range(400)], "query_id long, text string")
    packed = L._packed_queries(L._weights(queries, store).selectExpr("int(query_id % 2) AS slice", "query_id", "term", "idf"))
    assert packed.count() < 100
    assert len(L.search_bm25_store(queries, store, 3).collect()) == 1200
