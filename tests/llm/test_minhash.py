"""Near-duplicates by fast similarity sketches, and the links of crowded groups, against all pairs compared in full."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import minhash, simhash
from sparkloom.llm.crowds import group_links

SCHEMA = "doc_id long, text string, n int, id string, bands string, key string, s string"


def _sets(texts, shingle):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        runs = list(zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else [tuple(w)]
        out.append(set(runs) if w else set())
    return out


def _roots(sets, threshold):
    """The group of each set by all pairs, through a matrix of sets by shingles."""
    place = {}
    for s in sets:
        for x in s:
            place.setdefault(x, len(place))
    m = np.zeros((len(sets), max(1, len(place))), np.float32)
    for i, s in enumerate(sets):
        m[i, [place[x] for x in s]] = 1
    size, both = m.sum(axis=1), m @ m.T
    like = (both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6) & (size[:, None] > 0)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = list(zip(*np.nonzero(np.triu(like, 1)), strict=True))
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))], len(links)


def _family(n, edits, words=300, seed=3):
    r = random.Random(seed)
    base, out = [f"t{i}" for i in range(words)], []
    for _ in range(n):
        w = list(base)
        for p in r.sample(range(words), edits):
            w[p] = f"e{r.randrange(5000)}"
        out.append(" ".join(w))
    return out


def _hold(spark, rows, **more):
    """The operator's rows against all pairs, for rows (doc_id, text)."""
    df = spark.createDataFrame([(i, t, 1, "x", "b", "k", "s") for i, t in rows], SCHEMA).repartition(5)
    got = minhash.near_groups(df, shingle=2, **more).collect()
    sets = _sets([t for _, t in rows], 2)
    roots, links = _roots(sets, 0.8)
    order = lambda i: (i is None, i or 0)
    least = {}
    for (i, _), root in zip(rows, roots, strict=True):
        least[root] = min(least.get(root, i), i, key=order)
    want = [(i, len(s), least[root], i == least[root]) for (i, _), s, root in zip(rows, sets, roots, strict=True)]
    by = lambda x: (order(x[0]), x[1], order(x[2]))
    assert sorted(map(tuple, got), key=by) == sorted(want, key=by)
    return links


def test_rows_of_all_kinds(spark):
    r = random.Random(7)
    text = lambda n: " ".join(r.choice(["Alpha", "beta", "été", "漢字", "x1", *(f"w{i}" for i in range(50))]) for _ in range(n))
    base, long = text(60), text(20_000)
    texts = [base, base, base.upper(), base + " tail", None, "", " \n\t", "one", "ONE", "one two", "one\ttwo", "two one", long, long + " end", "a a a a", "a " * 3000]
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(100 + i, " ".join(x if r.random() > 0.03 else "new" for x in base.split())) for i in range(20)]
    rows += [(0, text(40)), (6, None), (9, base), (None, text(30)), (None, base), (None, None)]
    assert _hold(spark, rows) > 10


def test_empty_table(spark):
    assert minhash.near_groups(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("edits", [9, 11])
def test_crowded_bands_lose_no_link(spark, edits):
    """All texts of a family share bands, and few pairs of them are alike."""
    links = _hold(spark, list(enumerate(_family(300, edits))), hot=8)
    assert 0 < links < 0.5 * 300 * 299 / 2


def test_groups_by_differences_alone(spark):
    """One crowded group of sets given as they are: many are alike to the centre, some only to each other."""
    r = random.Random(5)
    sets = []
    for _ in range(150):
        s = set(range(100))
        edits = r.choice([2, 9, 14, 14, 18])
        s -= set(r.sample(range(100), edits))
        s |= {r.randrange(1000, 1040) for _ in range(r.choice([0, edits]))}
        sets.append(s)
    rows = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in enumerate(sets)], "id long, s array<long>")
    members = rows.select(F.lit(1).cast("long").alias("at"), "id", F.size("s").alias("n"))
    want, _ = _roots(sets, 0.8)
    for hot in (4, 16, 1000):
        got = {frozenset((x.a, x.b)) for x in group_links(members, lambda ids: rows.join(ids, "id"), 0.8, hot=hot).collect()}
        for pair in got:
            a, b = (sets[i] for i in pair)
            assert len(a & b) >= 0.8 * len(a | b) - 1e-9
        root = list(range(len(sets)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in map(sorted, got):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        assert [find(i) for i in range(len(sets))] == want


def test_pipeline_stage_in_crowded_bands(spark):
    """The pipeline's near-dedup on a family of texts that share bands: as many rows stay as there are groups."""
    texts = _family(300, 5, seed=9)
    roots, links = _roots(_sets(texts, 5), 0.8)
    assert 10 < links < 2000
    given = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = simhash.keep_one_alike(given, hot=8)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(roots))
    assert corpus_pipeline.STAGES[1][1] is corpus_pipeline.simhash_near_dedup


def test_sketches():
    """Every coordinate is filled, depends on the set alone, and agrees as often as the sets do."""
    r = np.random.default_rng(1)
    for size in (1, 2, 3, 50, 199, 5000):
        s = r.integers(0, 2**63, size, np.uint64)
        k = minhash.sketch_of(s)
        assert len(k) == minhash.T and (k != 2**64 - 1).all()
        assert (minhash.sketch_of(s[::-1].copy()) == k).all()
    for size in (30, 400):
        agree = []
        for _ in range(60):
            x = r.integers(0, 2**63, size, np.uint64)
            y = np.concatenate([x[: size * 3 // 4], r.integers(0, 2**63, size // 4, np.uint64)])
            agree.append((minhash.sketch_of(x) == minhash.sketch_of(y)).mean())
        union = size * 3 // 4 + size - size * 3 // 4 + size // 4
        assert abs(np.mean(agree) - (size * 3 // 4) / union) < 0.02


def _one_round_at_a_time(s, t):
    out = [None] * t
    for i in range(2 * t):
        z = minhash._mixed(s + np.uint64(i + 1) * minhash._STEP)
        for x in z.tolist():
            at = ((x & 0xFFFF) * t) >> 16 if i < t else i - t
            value = (i, x >> 16)
            if out[at] is None or value < out[at]:
                out[at] = value
        if all(x is not None for x in out):
            break
    return [(i << 48) | v for i, v in out]


def test_sketch_rounds_match_plain_ones():
    r = np.random.default_rng(2)
    for size in (1, 2, 5, 40, 300):
        s = r.integers(0, 2**63, size, np.uint64)
        assert minhash.sketch_of(s, 16).tolist() == _one_round_at_a_time(s, 16)


def test_elements_of_a_crowd_are_counted_in_arrays(spark, monkeypatch):
    """Counting the elements of a crowded group makes a row for a member and a part, not one for each element."""
    from collections import Counter

    from sparkloom.llm import crowds

    r = random.Random(4)
    sets = {i: sorted({*r.sample(range(-60, 60), 30), *range(1000, 1020), 5000 + i}) for i in range(90)}
    rows = spark.createDataFrame([(7, i, s, 90, 90 * 51) for i, s in sets.items()], "at long, id long, d array<long>, size long, total long")
    df = Counter(e for s in sets.values() for e in s)
    for cell in (1 << 16, 2000):
        monkeypatch.setattr(crowds, "CELL", cell)
        got = crowds._counted(rows).collect()
        parts = -(-90 * 51 // cell)
        assert len(got) <= (90 + 1) * parts
        for i, s in sets.items():
            assert sorted(p for x in got if x.id == i for p in zip(x.es, x.dfs)) == sorted((e, df[e]) for e in s if df[e] > 1)
        assert sorted(p for x in got if x.id is None for p in zip(x.es, x.dfs)) == sorted((e, n) for e, n in df.items() if 2 * n > 90)


def test_pairs_of_a_crowd_are_bounded_from_both_ends(spark, monkeypatch):
    """Sets that lack some elements of a crowd share what they lack with many others; those that cannot be alike by the
    places of such an element in both orders are not compared."""
    from sparkloom.llm import crowds

    alike, checked = crowds._alike, []

    def counted(pairs, rows, g):
        checked.append(pairs.distinct().count())
        return alike(pairs, rows, g)

    monkeypatch.setattr(crowds, "_alike", counted)
    r, size, sets = random.Random(6), 300, []
    for i in range(size):
        n = r.choice([2, 4, 8, 22])
        sets.append(set(range(147)) - set(r.sample(range(147), n)) | {1000 * (i + 1) + x for x in range(n)})
    sets[20] = set(range(147)) - set(range(22)) | {1000 * 21 + x for x in range(22)}
    sets[21] = sets[20] - {50, 51} | {1, 2}  # alike to no set but the one before
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, s array<long>")
    members = rows.select(F.lit(1).cast("long").alias("at"), "id", F.size("s").alias("n"))
    root = list(range(size))
    for a, b in [(x.a, x.b) for x in group_links(members, lambda ids: rows.join(ids, "id"), 0.8).collect()]:
        root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    want = _roots(sets, 0.8)[0]
    assert root == want and want[21] == 20
    assert checked[0] <= size, checked
