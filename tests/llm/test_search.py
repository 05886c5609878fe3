"""Hard-negative mining and ranked lexical search against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import lexical, negatives

VECTORS = "vec_id long, embedding array<float>, label int, id string, row string, score int"


def _mined(rows, anchor, positives=5, negatives_=3, low=50, high=95):
    """rows (id, vector, label) with distinct ids → the operator's rows, by sorting all pairs."""
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if None not in (i, v, y) and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, q, y in good:
        if not anchor(a):
            continue
        scored = sorted((-sum(s * t for s, t in zip(q, p, strict=False)), i, z == y) for i, p, z in good if i != a)
        for s, i, _ in [x for x in scored if x[2]][:positives]:
            window = [x for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s][:negatives_]
            out += [(a, i, k + 1, x[1], -s, -x[0]) for k, x in enumerate(window)]
    return sorted(out)


def _vectors():
    r = random.Random(4)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(3)]
    rows = [(i, [c + r.gauss(0, 0.4) for c in centres[i % 3]], r.randint(0, 3)) for i in range(120)]
    rows += [(200 + i, list(centres[0]), i % 2) for i in range(30)]  # one frequent vector
    rows += [(300 + i, [0.0] * 8, i % 2) for i in range(6)]  # scores of zero on both sides
    rows += [(400, None, 1), (401, [1.0] * 8, None), (402, [1.0, None] * 4, 1), (403, [float("nan")] * 8, 1), (404, [float("inf")] * 8, 0), (405, [], 1), (None, [1.0] * 8, 1)]
    rows += [(410, [0.5, 0.5, 0.1], 0), (411, [-1.0] * 8, 7), (420, [0.5] * 12, 1)]
    return rows


@pytest.mark.parametrize("slice_bytes", [negatives.SLICE_BYTES, 1500])
def test_hard_negatives(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(negatives, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(negatives, "BLOCK", 7)
    rows = _vectors()
    df = spark.createDataFrame([(i, v, y, "x", "y", 1) for i, v, y in rows], VECTORS).repartition(5)
    got = negatives.hard_negatives(negatives.quantised(df, "vec_id", "embedding", F.col("label")), F.col("id") % 5 == 0)
    want = _mined(rows, lambda i: i % 5 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    assert any(s == 0 for *_, s, _ in want)  # a window of zero takes rows of zero, smaller ids too


def test_hard_negatives_repeated_and_empty(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (0, [0.0, 1.0], 2), (1, [1.0, 0.5], 1), (2, [0.8, 0.5], 2), (2, [0.8, 0.5], 2)]
    df = lambda rows: spark.createDataFrame([(i, v, y, "x", "y", 1) for i, v, y in rows], VECTORS)
    mined = lambda d, a: sorted(map(tuple, negatives.hard_negatives(negatives.quantised(d, "vec_id", "embedding", F.col("label")), a).collect()))
    first, second = mined(df(rows), F.col("id") == 0), mined(df(rows[1:5] + rows[:1]), F.col("id") == 0)
    assert first == second  # equal rows count once
    # the anchor (0, label 1) has the positive 1, and 2 as its negative; that of label 2 has a positive and no negative
    assert first == [(0, 1, 1, 2, 256 * 256, 256 * 204)]
    assert mined(df([]), F.lit(True)) == [] and mined(df(rows), F.col("id") == 77) == []
    assert mined(df([(i, [1.0], 3) for i in range(4)]), F.lit(True)) == []  # one label: no negatives


def test_scores_stay_exact():
    r = np.random.default_rng(0)
    a, b = r.integers(-(2**20), 2**20, (5, 64)), r.integers(-(2**30), 2**30, (7, 64))
    assert (negatives._scores(a, b) == np.array([[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a])).all()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _ranked(docs, items, k=10):
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := _plain_terms(text))]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        asked = Counter(_plain_terms(text))
        scored = []
        for i, c, length in held:
            m = 25 + (75 * length * n) // total
            s = sum(times * weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in asked.items() if c[t])
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def _corpus():
    r = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    text = lambda n: " ".join(r.choices(words, weights, k=n))
    docs = [(i, text(r.choice([3, 10, 40, 300]))) for i in range(300)]
    docs += [(300 + i, docs[5][1]) for i in range(30)]  # ties
    docs += [(400, None), (401, ""), (402, "-- ??"), (403, "Été İstanbul é ÉTÉ x_y a1-b2"), (None, text(20)), (5, text(10)), (404, text(20_000)), (405, "\ud800 w1".encode("utf-8", "replace").decode())]
    items = [(i, text(r.choice([1, 5, 30]))) for i in range(25)] + [(30, None), (31, "?!"), (32, "été é X B2"), (33, "absent"), (34, docs[5][1]), (35, "w0 w0 w0")]
    return docs, items


@pytest.mark.parametrize("postings,first,terms", [(1 << 20, 256, 100_000), (600, 1, 100_000), (3000, 2, 20)])
def test_ranked_search(spark, monkeypatch, postings, first, terms):
    """Small blocks, short reads and slices of few terms give the same rows."""
    for name, value in (("BLOCK_POSTINGS", postings), ("FIRST_READ", first), ("SLICE_TERMS", terms)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = _corpus()
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, term string, n int, tf int").repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, lexical.ranked_search(df, asked).collect())) == _ranked(docs, items)


def test_nra_reads_less_than_all():
    """Blocks that cannot reach the ten best are left after few reads."""
    r = np.random.default_rng(3)
    ids = np.arange(20_000)
    ts = [np.unique(r.integers(1, 40, 12)) for _ in ids]
    tfs = [r.integers(1, 3, len(t)) for t in ts]
    block = lexical.Block(ids, np.array([x.sum() for x in tfs], np.int64) + 20, ts, tfs, len(ids), 700_000)
    item = {t: 1000 + t for t in range(1, 30)}
    best = lexical.nra(block, item, 10, [], first_read=64)
    score = np.zeros(len(ids), np.int64)
    for t, w in item.items():
        a, b = block.lists[t]
        score[block.doc[a:b]] += w * block.impact[a:b]
    order = np.lexsort((ids, -score))[:10]
    assert best == [(-int(score[i]), int(ids[i])) for i in order]
    out = sorted((-int(score.max()) * 3 - i, 10**6 + i) for i in range(10))
    assert lexical.nra(block, item, 10, out) == out  # nothing here can enter


def test_ranked_search_on_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.ranked_search(none, items).collect() == []
    assert lexical.ranked_search(spark.createDataFrame([(1, "w1")], "doc_id long, text string"), items.limit(0)).collect() == []
    assert lexical.ranked_search(spark.createDataFrame([(1, None)], "doc_id long, text string"), items).collect() == []
