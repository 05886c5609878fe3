"""Packing in one global order against the serial fold, on any split."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.operators import sequence_packing as P


def serial(tokens, limit):
    """The fold as one reads it: a list of batches."""
    batches, out = [], []
    for t in tokens:
        if batches and sum(batches[-1]) + t <= limit:
            batches[-1].append(t)
        else:
            batches.append([t])
        out.append(len(batches) - 1)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=400), st.integers(1, 30), st.lists(st.integers(0, 400), max_size=6))
def test_functions_compose_to_the_fold(tokens, limit, cuts):
    at, before, got = limit + 1, 0, []
    edges = [0, *sorted(min(c, len(tokens)) for c in cuts), len(tokens)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = np.array(tokens[a:b], np.int64)
        got += P.fold(part, limit, at, before).tolist()
        fill, opened = P.transfer(part, limit)
        at, before = int(fill[at]), before + int(opened[at])
    assert got == serial(tokens, limit)


@pytest.mark.parametrize(("stretch", "fan"), [(1000, 64), (40, 64), (9, 3)])
def test_any_split_gives_the_serial_batches(spark, monkeypatch, stretch, fan):
    """One stretch, several, and several levels of them; one document holds a third of all parents."""
    monkeypatch.setattr(P, "FAN", fan)
    rng = np.random.default_rng(5)
    rows = sorted({(None if d == 3 else 0 if d % 3 == 0 else d, int(p)) for d, p in zip(rng.integers(0, 40, 400), rng.permutation(400), strict=True)}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    tokens = [int(t) for t in rng.choice([0, 3, 17, 60, 99, 100, 101, 500], len(rows))]
    want = dict(zip(rows, serial(tokens, 100), strict=True))
    data = [(d, p, t) for (d, p), t in zip(rows, tokens, strict=True)]
    rng.shuffle(data)
    df = spark.createDataFrame([(None if d is None else int(d), int(p), int(t)) for d, p, t in data], "doc_id long, pos int, tokens int").repartition(7)
    got = {(r.doc_id, r.pos): r.batch_no for r in P.pack_in_order(df, ["doc_id", "pos"], 100, stretch).collect()}
    assert got == want


def test_nulls_empty_tables_and_wrong_sizes(spark):
    kind = "doc_id long, pos int, chunk_id string, parent_id string, tokens int"
    assert P.pack_parents_in_order(spark.createDataFrame([], kind)).collect() == []
    rows = [(1, 0, "a", None, None), (1, 1, "b", "p", 5), (1, 1, "b", "p", 5), (None, 0, "c", "p", 9), (2, 0, None, "q", 6)]
    got = sorted(map(tuple, P.pack_parents_in_order(spark.createDataFrame(rows, kind), 10).collect()))
    assert got == [(0, 2, 1, 1, "a,c", 9), (1, 1, 1, 1, "b,b", 5), (2, 1, 2, 2, "", 6)]
    with pytest.raises(ValueError, match="negative"):
        P.pack_parents_in_order(spark.createDataFrame([(1, 0, "a", "p", -1)], kind))
    with pytest.raises(ValueError, match="1 or more"):
        P.pack_parents_in_order(spark.createDataFrame([], kind), 0)
