"""Postings are counted within rows; rows that repeat a key add up."""

from collections import Counter

from sparkloom.operators import retrieval as S


def test_postings(spark):
    docs = [(1, "a b a", "x"), (2, "b", "x"), (3, None, "x"), (4, "", "y"), (5, "C c d", "y")]
    rows = lambda d: spark.createDataFrame(d, "key long, text string, source string")

    def want(d):
        found = Counter()
        for k, t, s in d:
            w = (t or "").lower().split()
            for x in w:
                found[x, k, len(w), s] += 1
        return sorted((*x, n) for x, n in found.items())

    got = lambda df: sorted((r.term, r.key or 0, r.dl, r.source, r.tf) for r in df.collect())
    plain = S.build_bm25_index(rows(docs))
    assert got(plain) == want(docs)
    assert "Exchange hash" not in plain._jdf.queryExecution().executedPlan().toString()
    again = [*docs, (1, "a e f", "x"), (1, "a", "x"), (1, "b a a", "z")]
    assert got(S.build_bm25_index(rows(again))) == want(again)
    none = [(None, "a b", "x"), (None, "b c", "x")]
    assert got(S.build_bm25_index(rows(none))) == want([(0, t, s) for _, t, s in none])
