"""The stored block-max index against plain BM25 over all pairs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import lexical_store as L


def _corpus():
    r = random.Random(8)
    kinds = [[f"{k}{i}" for i in range(80)] for k in "abc"]
    weights = [1 / (i + 1) for i in range(80)]
    docs = [(i, " ".join(r.choices(kinds[i % 3], weights, k=r.choice([3, 12, 12, 40, 200])))) for i in range(400)]
    docs += [(400, None), (401, ""), (402, "--"), (403, "A0, a0; B1!"), (404, docs[0][1]), (405, docs[0][1])]
    asked = [(i, " ".join(r.choices(kinds[i % 3], k=r.choice([1, 4, 15])))) for i in range(30)] + [(30, "none of these"), (31, None), (32, docs[0][1]), (33, "a0 b0 c0")]
    return docs, asked


def _plain(docs, asked, k):
    words = lambda t: __import__("re").findall(r"[^\W_]+", (t or "").lower())
    held = {i: Counter(w) for i, t in docs if (w := words(t))}
    n, avgdl = len(held), sum(sum(c.values()) for c in held.values()) / len(held)
    df = Counter(t for c in held.values() for t in c)
    out = []
    for q, text in asked:
        scored = []
        for i, c in held.items():
            terms = [t for t in dict.fromkeys(words(text)) if c[t]]
            if terms:
                dl = sum(c.values())
                s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * dl / avgdl)) for t in terms)
                scored.append((-round(s, 6), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("salted,buckets", [(8192, 32), (3, 4)])
def test_search(spark, monkeypatch, tmp_path, salted, buckets):
    monkeypatch.setattr(L, "SALTED", salted)
    monkeypatch.setattr(L, "BUCKETS", buckets)
    docs, asked = _corpus()
    path = str(tmp_path / "store")
    L.write_bm25_store(spark.createDataFrame(docs, "key long, text string").repartition(3), path)
    store = L.open_bm25_store(spark, path)
    assert (store.salts > 1) == (salted == 3)
    queries = spark.createDataFrame(asked, "query_id long, text string")
    got = sorted((r.query_id, r.key, r.score, r["rank"]) for r in L.search_bm25_store(queries, store, 5).collect())
    want = _plain(docs, asked, 5)
    assert [(q, k, r) for q, k, _, r in got] == [(q, k, r) for q, k, _, r in want]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))
    # a bound is one: no document scores above it
    tops = store.blocks.select(F.posexplode("tops").alias("part", "top"), "places", "tfs", "dls")
    each = tops.select("part", "top", F.inline(F.arrays_zip("places", "tfs", "dls"))).where(f"places div {L.PART} = part")
    assert each.where(L.gain(F.col("tfs"), F.col("dls"), F.lit(store.avgdl)) > F.col("top")).count() == 0


def test_parts_below_the_bar_are_not_scored(spark):
    docs, _ = _corpus()
    r = random.Random(1)
    docs = [(i, t) for i, t in docs if i < 400] + [(1000 + i, " ".join(f"z{r.randrange(200)}" for _ in range(8))) for i in range(1600)]
    store = L.bm25_store(spark.createDataFrame(docs, "key long, text string"))
    queries = spark.createDataFrame([(0, "z1 z2 z3 a1 a2 b3"), (1, "c1 c7 c9 z5")], "query_id long, text string")
    rows, read = L.search_counted(queries, store, 3)
    assert rows.count() == 6
    assert read.agg(F.sum(F.bit_count("mask"))).first()[0] * L.PART < 0.25 * 2 * len(docs)


def test_empty_store_and_empty_questions(spark):
    none = spark.createDataFrame([], "key long, text string")
    one = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    assert L.search_bm25_store(one, L.bm25_store(none), 3).collect() == []
    store = L.bm25_store(spark.createDataFrame([("x", "a"), ("y", None)], "key string, text string"))
    assert [(r.key, r["rank"]) for r in L.search_bm25_store(one, store, 3).collect()] == [("x", 1)]
    assert L.search_bm25_store(one.limit(0), store, 3).collect() == []


def test_passages(spark):
    docs = ["the quick brown fox jumps", "one two three", "", None, "a  b\tc", "漢字仮名", "xone twoy", "ΑΣ ΒΣ ΓΣ ΔΣ"]
    asked = ["he quick brown fo", "one two", "quick", "uick b", "a  b", " ", "", "no such thing at", "the quick brown fox jumps", None, "ΑΣ ΒΣ ΓΣ Δ"]
    d = spark.createDataFrame(list(enumerate(docs)), "key long, text string")
    got = {(x.text, x.key) for x in L.passages_in_store(spark.createDataFrame([(a,) for a in asked], "text string"), L.bm25_store(d), d).collect()}
    assert got == {(a, k) for a in asked if a is not None for k, t in enumerate(docs) if t is not None and a in t}
