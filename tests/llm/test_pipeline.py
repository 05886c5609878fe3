"""Each stage of the pipeline against a plain version of it, over rows with nulls, repeats, ties and clashing columns."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import pii, simhash, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lines string, key string, kept_text string, __key string, part string"
WORDS = [f"w{i}" for i in range(400)]


def _rows():
    r = random.Random(12)
    text = lambda n: "".join(r.choice(WORDS) + r.choice([" ", " ", " ", "\n", "  "]) for _ in range(n))
    line = "This line of the site stands on every page of it"
    shared = " ".join(r.choice(WORDS) for _ in range(60))
    texts = [(i, line + "\n" + text(r.choice([4, 30, 60])), "a" if i % 10 else None) for i in range(80)]
    texts += [(100 + i, text(50) + shared[r.randint(0, 40) :] + "\n\n" + text(20), "b") for i in range(12)]
    texts += [(200, None, "b"), (201, "", "b"), (202, "short", "b"), (203, "spam eggs ham jam tea " * 30, "b"), (204, text(3000), None)]
    texts += [(210, "mail me.x@host.example.com or call +1 (663) 555-6869 " + text(30), "c"), (None, text(40), "c"), (None, None, "c")]
    texts += [(100, text(40), "b"), (7, text(40), "a"), texts[85], texts[85]]
    base = text(200)
    texts += [(300 + i, base + f"tail{i}", "d") for i in range(4)]
    return [(i, t, "en", s, None if t is None else len(t), "l", "k", "t", "m", "p") for i, t, s in texts]


@pytest.fixture(scope="module")
def given(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(6)


def _key(row):
    return (row[0] is None, row[0] or 0, row[1] or "", str(row[2:]))


def _out(df):
    return sorted((tuple(r) for r in df.collect()), key=_key)


def _with(row, text):
    return (row[0], text, *row[2:4], None if text is None else len(text), *row[5:])


def _quality(rows):
    words = lambda t: (t or "").encode().split()
    norm = lambda x: re.sub(r"[\x20\x09-\x0d]+", " ", x).strip(" ").lower()
    worded = lambda t: [x for x in (t or "").split("\n") if x.encode().split()]

    def failed(t):
        w, seen = words(t), defaultdict(list)
        for k in range(len(w) - 4):
            seen[tuple(w[k : k + 5])].append(k)
        return len(w) < 10 or 100 * len({k + j for ks in seen.values() if len(ks) > 1 for k in ks for j in range(5)}) > 20 * len(w)

    holders, passing = defaultdict(set), defaultdict(set)
    for r in rows:
        for x in worded(r[1]):
            holders[r[3] or "", norm(x)].add(r[0])
    for at in list(holders):
        for i in holders[at]:
            mine = [r for r in rows if r[0] == i and (r[3] or "") == at[0] and at[1] in map(norm, worded(r[1]))]
            if i is not None and not all(failed(r[1]) for r in mine):
                passing[at].add(i)
    out = []
    for r in rows:
        host = r[3] or ""
        often = {x for x in map(norm, worded(r[1])) if len(holders[host, x]) > 50}
        stays = {x for x in often if passing[host, x] and min(passing[host, x]) == r[0]}
        gone = [x for x in worded(r[1]) if norm(x) in often - stays]
        lost, n = sum(len(words(x)) for x in gone), len(words(r[1]))
        if not failed(r[1]) and (stays or n - lost >= 0.3 * n):
            out.append(_with(r, "\n".join(x for x in r[1].split("\n") if x not in gone)))
    return out


def test_quality_stage(spark, given):
    rows = _rows()
    want = _quality(rows)
    assert len(want) < len(rows) and any(a[1] != b[1] for a in rows for b in want if a[0] == b[0])
    assert _out(corpus_pipeline.quality_rules(spark, given, "")) == sorted(want, key=_key)


def _one_of_each(rows):
    sets = [frozenset(simhash.shingles_of(r[1], 5).tolist()) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(rows)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                root[find(b)] = find(a)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i])
    return groups.values()


def test_near_dedup_stage(spark, given):
    got = _out(corpus_pipeline.simhash_near_dedup(spark, given, ""))
    groups = _one_of_each(_rows())
    assert len(got) == len(groups) < len(_rows())
    for g in groups:
        (one,) = [x for x in got if x in g]
        assert (one[0] is None, one[0] or 0) == min((r[0] is None, r[0] or 0) for r in g)
    assert got == _out(corpus_pipeline.simhash_near_dedup(spark, given.repartition(2), ""))


def _without_repeats(rows):
    first = {}
    for r in rows:
        w = (r[1] or "").split()
        for k in range(len(w) - 12):
            if r[0] is not None:
                at = tuple(w[k : k + 13])
                first[at] = min(first.get(at, r[0]), r[0])
    out = []
    for r in rows:
        spans = [m.span() for m in re.finditer(r"\S+", r[1] or "")]
        w = [r[1][a:b] for a, b in spans]
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if r[0] is not None and first[tuple(w[k : k + 13])] < r[0]:
                gone[k : k + 13] = [True] * 13
        if w and all(gone):
            continue
        cut = [not any(gone[j] and (a <= i < b or (j and gone[j - 1] and spans[j - 1][1] <= i < b)) for j, (a, b) in enumerate(spans)) for i in range(len(r[1]))] if any(gone) else None
        out.append(_with(r, r[1] if cut is None else "".join(c for c, keep in zip(r[1], cut, strict=True) if keep)))
    return out


@pytest.mark.parametrize("limit", [substring.FREQUENT_BYTES, 1])
def test_substring_stage(spark, given, monkeypatch, limit):
    monkeypatch.setattr(substring, "FREQUENT_BYTES", limit)
    want = _without_repeats(_rows())
    assert any(a[1] != b[1] and "\n\n" in b[1] for a in _rows() for b in want if a[0] == b[0] and a[1])
    n = lambda rows: [x[:4] + x[5:] + (len(x[1] or ""),) for x in rows]
    assert n(_out(corpus_pipeline.substring_dedup(spark, given, ""))) == n(sorted(want, key=_key))


def test_pii_stage(spark, given):
    field, want = pii.train(given), []
    for r in _rows():
        text = r[1]
        for _, a, b in sorted(pii.all_spans(text or "", field)[1], key=lambda x: -x[1]):
            text = text[:a] + "[" + next(k for k, x, y in pii.all_spans(r[1], field)[1] if (x, y) == (a, b)).upper() + "]" + text[b:]
        want.append((r[0], text))
    got = _out(corpus_pipeline.pii_redaction(spark, given, ""))
    assert [x[:2] for x in got] == sorted(want, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    assert any("[EMAIL]" in (x[1] or "") and "[PHONE]" in x[1] for x in got)
    assert all(x[4] == len(x[1] or "") for x in got)


def test_packing_stage_and_whole_run(spark, given, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    given.write.parquet(str(tmp_path / "documents.parquet"))
    docs = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == given.columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    want = sorted([*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect())
    for made in (corpus_pipeline.STAGES[-1][1](spark, docs, ""), corpus_pipeline.run(spark, str(tmp_path))):
        rows = made.collect()
        whole = defaultdict(list)
        for r in rows:
            whole[r.sequence_id].append((r.offset, r.length))
        for pieces in whole.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= 2048
        assert sorted(r.doc_tokens for r in rows if r.start == 0) == sorted(map(len, want))
        short = [x for x in want if len(x) <= 2048]
        assert sorted(list(r.ids) for r in rows if r.doc_tokens <= 2048) == short and sum(r.length for r in rows) == sum(map(len, want))


def test_stages_take_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    none.write.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
