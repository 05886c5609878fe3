"""Operators on skewed tables against plain versions: intervals, rarest grams, repeated descriptions, sides too large."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import aggregates as A
from sparkloom.operators import classify as C
from sparkloom.operators import filters as P
from sparkloom.operators import graph as G
from sparkloom.operators.stored import only_few
from sparkloom.streaming import jobs


def test_version_windows(spark):
    r = random.Random(4)
    rows = [(i, r.randrange(0, 300), r.choice([0, 0, r.randrange(1, 320)])) for i in range(400)] + [(1000, None, 0), (1001, 5, None), (1002, 7, 7), (1003, 9, 2)]
    asked = sorted({r.randrange(0, 300) for _ in range(60)} | {0, 1})
    d = spark.createDataFrame(rows, "id long, valid_from_seq long, valid_to_seq long")
    v = spark.createDataFrame([(x,) for x in asked] + [(None,)], "seq long")
    got = [(x.seq, x.id) for x in P.version_window_join(d, v).collect()]
    want = {(x, i) for x in asked for i, a, b in rows if None not in (a, b) and a <= x and (b == 0 or b > x)}
    assert len(got) == len(set(got)) and set(got) == want
    assert P.version_window_join(d, v.limit(0)).count() == 0
    many = spark.range(100_000).select(F.col("id").alias("seq"))
    plan = P.version_window_join(d, many)
    assert plan.where("id = 1002 OR seq < 0").count() == 0 and "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def test_rarest_grams(spark):
    r = random.Random(6)
    names = [f"Customer#{i:06}" for i in range(300)] + ["ab", "Cus", "quartz", "xquartzy"]
    tokens = [(i, r.choice(names)[r.randrange(0, 6) :]) for i in range(40)] + [(50, "Customer"), (51, "zzzz"), (52, "ab"), (53, "quartz"), (54, "Customer#zz"), (55, "")]
    t = spark.createDataFrame(tokens, "query_id long, token string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    got = {}
    for x in P.like_match(t, n, 500).collect():
        got.setdefault(x.query_id, set()).add(x.name)
    want = {q: {x for x in names if (k in x if len(k) >= 3 else k == x)} for q, k in tokens}
    assert got == {q: x for q, x in want.items() if x}
    found = {(x.query_id, x.name) for x in G.match_entities(t, n, 1000).collect()}
    assert found == {(q, x) for q, k in tokens if len(k) >= 2 for x in names if k in x}


def test_repeated_descriptions(spark):
    r = random.Random(2)
    rows = [(r.choice("AbBc"), f"t{r.randrange(3)}", r.choice(["red", "red car", "car", "blue"]), i) for i in r.sample(range(1000), 80)]
    want = {}
    for name, kind, text, _ in sorted(rows, key=lambda x: x[3]):
        have = want.setdefault(name.upper(), [kind, ""])
        if text not in have[1]:
            have[1] = f"{have[1]}；{text}" if have[1] else text
    got = {x.name: [x.type, x.description] for x in A.merge_entities(spark.createDataFrame(rows, "name string, type string, description string, pos long")).collect()}
    assert got == want
    edges = [(r.choice("xy"), r.choice("xyz"), r.choice("pqr"), float(r.randrange(9)), i) for i in r.sample(range(1000), 90)]
    keep = {}
    for a, b, text, s, _ in sorted(edges, key=lambda x: x[4]):
        e = keep.setdefault((min(a, b), max(a, b)), [[], 0.0])
        e[0] += [text] * (text not in e[0])
        e[1] = max(e[1], s)
    got = {(x.a, x.b): ["；".join(keep[x.a, x.b][0]) == x.description, x.strength] for x in A.merge_edges(spark.createDataFrame(edges, "source string, target string, description string, strength double, pos long")).collect()}
    assert got == {k: [True, v[1]] for k, v in keep.items()}


def test_large_sides_are_refused(spark):
    with pytest.raises(ValueError, match="more than 10"):
        only_few(spark.range(11), 10)
    assert only_few(spark.range(10), 10).count() == 10
    faq = spark.createDataFrame([(1, "s", "q")], "faq_id long, subject string, question string")
    rules = spark.range(10_001).select(F.lit("x").alias("pattern"), F.lit("a").alias("source"), F.col("id").alias("source_order"))
    with pytest.raises(ValueError):
        C.faq_source_normalize(faq, rules)


def test_session_counts_hold_no_state(spark, tmp_path):
    """Batches add up, a batch that runs again counts once, and no query of the stream has a state operator."""
    given = tmp_path / "in"
    for n in range(3):
        spark.createDataFrame([(i % 2,) for i in range(11)], "session_id long").coalesce(1).write.mode("append").parquet(str(given))
    stream = lambda: spark.readStream.schema("session_id long").option("maxFilesPerTrigger", 1).parquet(str(given))
    log = str(tmp_path / "log")
    jobs.session_counts(stream(), log, str(tmp_path / "one"))
    first = {x.session_id: x.due for x in jobs.summary_due(spark.read.parquet(log), 14, 8).collect()}
    jobs.session_counts(stream(), log, str(tmp_path / "two"))  # all batches once more
    again = {x.session_id: x.due for x in jobs.summary_due(spark.read.parquet(log), 14, 8).collect()}
    assert first == again == {0: 18 - 8, 1: 15 - 8}
    assert not (tmp_path / "one" / "state").exists()
