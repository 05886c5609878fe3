"""Alias pairs against all pairs of names, clusters without chains, and a graph with planted variants of names."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import build as B
from sparkloom.operators import graph as G


def _names():
    r = random.Random(3)
    of = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    names = [of("甲乙丙丁戊己庚辛", r.choice([1, 2, 3, 3, 4, 5])) for _ in range(90)] + [of("abcde", r.choice([1, 2, 3, 4, 6, 9])) for _ in range(90)]
    for _ in range(50):
        n = r.choice(names)
        names.append(r.choice([n + "x", n[::-1], "q" + n, "ab " + n, n[:-1], n + "公司", n.upper(), n[1:]]))
    names += ["stem" + of("xyz", 2) for _ in range(40)]  # a frequent stem
    return [n for n in dict.fromkeys(names) if n]


@pytest.mark.parametrize("spelled", [False, True])
def test_pairs_are_all_pairs(spark, spelled):
    names = _names()
    rows = [(n, "t") for n in names] + [(None, "t"), ("", "t"), ("x", None), (names[0], "other"), (names[1], "other")]
    found = G.alias_candidate_pairs(spark.createDataFrame(rows, "name string, type string"), spelled=spelled, suffixes=("公司",))
    got = {(x.a, x.b, x.similarity) for x in found.collect()}
    d = spark.createDataFrame([(n,) for n in names], "name string")
    every = d.toDF("a").crossJoin(d.toDF("b")).where("a < b")
    like = G.alias_similarity(F.col("a"), F.col("b"), spelled=spelled, suffixes=("公司",))
    assert got == {(x.a, x.b, x.similarity) for x in every.withColumn("similarity", like).where("similarity >= 0.65").collect()} and len(got) > 100


def test_spelled_names_by_hand(spark):
    like = lambda a, b: spark.range(1).select(G.alias_similarity(F.lit(a), F.lit(b), spelled=True)).first()[0]
    assert like("BLETH", "THANBLE") == 0.0  # the same letters in another order
    assert like("mobile phone works", "mobile phones works") == 0.7
    assert like("ring", "small ring") == 0.85 and like("ing", "small ring") == 0.0
    assert like("甲公司", "丙丁甲公司") == 0.85


def test_clusters_do_not_chain(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(30)]
    r = random.Random(1)
    noise = [(f"x{r.randrange(60)}", f"x{r.randrange(60)}") for _ in range(150)]
    pairs = {tuple(sorted(p)) for p in chain + noise if p[0] != p[1]}
    got = {x.name: x.component for x in G.alias_clusters(spark.createDataFrame(sorted(pairs), "a string, b string")).collect()}
    assert set(got) == {x for p in pairs for x in p}
    for name, pivot in got.items():
        assert name == pivot or tuple(sorted((name, pivot))) in pairs
        assert got[pivot] == pivot
    assert len({got[f"n{i:02}"] for i in range(31)}) >= 11  # three names of a chain at most
    # no pivots are alike: a pivot takes all of its open neighbours
    pivots = set(got.values())
    taken = [p for p in pairs if p[0] in pivots and p[1] in pivots]
    assert not taken
    assert G.alias_clusters(spark.createDataFrame([], "a string, b string")).collect() == []


def test_graph_keeps_planted_entities(spark):
    """Variants of a name merge, different names stay, edges follow, and no node takes the others."""
    base = ["Marlow Foundry", "Tressel Bakery", "Quint Harbour", "Voss Chemicals", "Odell Timber", "Pryce Optics"]
    typo = {x: x[:3] + x[4:] for x in base}
    chunks = [(i, 0, f"c{i}", f"p{i}", f"{a}|{b}" if i % 2 else f"{typo[a]}|{b}", 10) for i, (a, b) in enumerate(zip(base * 2, base[1:] + base + base[:1], strict=True))]

    def extract(texts):
        out = []
        for t in texts:
            a, b = t.split("|")
            out.append(f'("entity"<|>{a}<|>org<|>about {a})##("entity"<|>{b}<|>org<|>about {b})##("relationship"<|>{a}<|>{b}<|>trades<|>{a} trades with {b}<|>3)')
        return out

    given = spark.createDataFrame(chunks, "doc_id long, pos int, chunk_id string, parent_id string, parent_content string, tokens int")
    entities, edges, communities = B.build_knowledge_graph(given, extract, ["org"])
    names = {x.name for x in entities.collect()}
    assert names == {x.upper() for x in base}
    got = {frozenset((x.source, x.target)) for x in edges.collect()}
    assert all(len(e) == 2 and e <= names for e in got) and len(got) >= len(base)
    assert {x.name for x in communities.collect()} == names


def test_keys_of_names_that_share_a_stem(spark):
    """Numbered names: all pairs are found, and what they all have in common is hardly ever a key."""
    names = [f"Supplier#{i:09}" for i in range(0, 60000, 241)]
    grams = {x: {x[i : i + 2] for i in range(len(x) - 1)} for x in names}
    rows = spark.createDataFrame([("t", x, sorted(g)) for x, g in grams.items()], "group string, id string, els array<string>")
    got = {(x.a, x.b) for x in G.overlap_pairs(rows, 0.6).collect()}
    alike = {(a, b) for a in names for b in names if a < b and len(grams[a] & grams[b]) >= 0.6 * len(grams[a] | grams[b])}
    assert alike <= got and len(got) < 0.5 * len(names) * (len(names) - 1) / 2


def test_only_alike_pairs_leave_the_join(spark):
    """What meets and is not alike, or meets again, is gone before any row is shuffled; a set may have many elements."""
    r = random.Random(5)
    base = [r.sample(range(40), r.choice([1, 2, 3, 5, 8, 11, 14, 20])) for _ in range(120)]
    sets = {f"s{i:03}": {*b} for i, b in enumerate(base)} | {f"t{i:03}": {*b[1:], r.randrange(40)} for i, b in enumerate(base)}
    rows = spark.createDataFrame([("g", k, sorted(v)) for k, v in sets.items()], "group string, id string, els array<int>")
    got = [(x.a, x.b) for x in G.overlap_pairs(rows, 0.6).collect()]
    alike = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    assert sorted(got) == sorted(alike) and len(got) > 50


def test_pairs_of_several_types_are_one_row(spark):
    rows = [(n, t) for n in ("mobile phone works", "mobile phones works", "small ring", "ring") for t in ("a", "b")] + [("mobil phones works", "b")]
    got = sorted((x.a, x.b) for x in G.alias_candidate_pairs(spark.createDataFrame(rows, "name string, type string"), spelled=True).collect())
    assert got == [("mobil phones works", "mobile phone works"), ("mobil phones works", "mobile phones works"), ("mobile phone works", "mobile phones works"), ("ring", "small ring")]


def test_stored_tables_leave_no_shuffle(spark):
    from sparkloom.operators.stored import saved

    before = _shuffled(spark)
    rows = saved(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert _shuffled(spark) <= before
    assert rows.count() == 7


def _shuffled(spark):
    """Names of the shuffle files on disk."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    names = set()
    while found.hasNext():
        names.add(found.next().getName())
    return {x for x in names if x.startswith("shuffle_") and x.endswith(".data")}


def test_keys_are_not_broadcast(spark):
    """The file of the keys is small where names are alike; in memory they are many times as large."""
    rows = spark.range(400).select(F.lit("t").alias("type"), F.concat(F.lit("Supplier#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("name"))
    pairs = G.alias_candidate_pairs(rows, spelled=True)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "Exchange" in plan and "HashAggregate" not in plan
