"""Queries of the knowledge-graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from .context import query

_TYPES = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]


@query("""SELECT n_nationkey AS batch_id, upper(n_name) AS source, upper(r_name) AS target, 'in' AS label, 'belongs to' AS description, least(n_nationkey % 12, 10)::DOUBLE AS strength FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT n_nationkey, upper(r_name), upper(n_name), '主管', '他是公司的主管', CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 2 END FROM nation JOIN region ON n_regionkey = r_regionkey""")
def parse_extraction_records(s):
    return G.parse_extraction_records(s.kg_records, _TYPES)[1].drop("pos")


@query("SELECT n_nationkey AS batch_id, upper(n_name) AS name, upper(r_name) AS type, concat('nation ', n_name) AS description FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')")
def parse_entities(s):
    return G.parse_extraction_records(s.kg_records, _TYPES)[0].drop("pos")


@query("SELECT n_nationkey AS batch_id, CASE WHEN n_nationkey % 2 = 0 THEN 'a##b<|COMPLETE|>' ELSE 'a##b##c' END AS response FROM nation")
def merge_gleanings(s):
    rounds = s.nation.crossJoin(s.spark.range(3).toDF("round"))  # three rounds a batch
    i, r = F.col("n_nationkey"), F.col("round")
    text = F.when(r == 0, "a").when(r == 1, F.when(i % 2 == 0, "b<|COMPLETE|>").otherwise("b")).otherwise("c")
    return G.merge_gleanings(rounds.select(i.alias("batch_id"), "round", text.alias("response")))


_REL = "SELECT concat('s', CAST(l_suppkey % 40 AS VARCHAR(9))) AS source, concat('s', CAST(l_partkey % 40 AS VARCHAR(9))) AS target, '' AS label, l_returnflag AS description, CAST(l_quantity AS DOUBLE) AS strength, l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 AS pos FROM lineitem"


@query(f"WITH r AS ({_REL}) SELECT least(source, target) AS a, greatest(source, target) AS b, min(pos) AS pos FROM r GROUP BY 1, 2")
def dedup_relations(s):
    return G.dedup_relations(s.sql(_REL)).select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "pos")


_NAMES = "SELECT DISTINCT p_name AS name, p_brand AS type FROM part UNION SELECT s_name AS name, concat('n', CAST(s_nationkey AS VARCHAR(9))) AS type FROM supplier"


def _similar(a: str, b: str, spelled: bool = False) -> str:
    """DuckDB SQL of the likeness of two names, rule by rule; ``spelled``: of names with letters."""
    grams = "list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))"
    x, y = (grams.format(c) if spelled else f"string_split({c}, '')" for c in (a, b))
    common, every = f"len(list_intersect({x}, {y}))", f"len(list_distinct(list_concat({x}, {y})))"
    n, m = f"length({a})", f"length({b})"
    short, long = f"CASE WHEN {n} <= {m} THEN {a} ELSE {b} END", f"CASE WHEN {n} <= {m} THEN {b} ELSE {a} END"
    three = f"{n} = 3 AND {m} = 3 AND {a}[1] = {b}[1]"
    chars = "" if spelled else f"""WHEN {three} AND {a}[2] = {b}[2] AND {a}[3] <> {b}[3] THEN 0.0 WHEN {three} AND {a}[2] <> {b}[2] AND {a}[3] = {b}[3] THEN 0.7
 WHEN {n} = {m} AND {n} >= 4 AND {a}[3:] = {b}[3:] AND {a}[1] <> {b}[1] THEN 0.0"""
    border = f" AND regexp_matches(substr({long}, abs({n} - {m}), 1), '[^\\p{{L}}\\p{{N}}]')" if spelled else ""
    return f"""CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN list_sort({x}) = list_sort({y}) THEN 0.85 {chars}
 WHEN {n} = {m} AND {common} >= {n} - {2 if spelled else 1} AND 2 * {common} >= {every} THEN 0.7 WHEN {n} = {m} AND 4 * {common} >= 3 * {every} THEN 0.7
 WHEN {n} <> {m} AND least({n}, {m}) >= 2 AND ends_with({long}, {short}){border} THEN 0.85
 WHEN 5 * {common} >= 3 * {every} AND {common} >= 2 AND NOT ({n} <> {m} AND starts_with({long}, {short})) THEN 0.7 ELSE 0.0 END::DOUBLE"""


@query(f"WITH e AS ({_NAMES}), p AS (SELECT DISTINCT a.name AS a, b.name AS b FROM e a JOIN e b ON a.type = b.type AND a.name < b.name), s AS (SELECT a, b, {_similar('a', 'b', True)} AS similarity FROM p) SELECT * FROM s WHERE similarity >= 0.65")
def alias_candidate_pairs(s):
    """Whole names of parts and suppliers."""
    return G.alias_candidate_pairs(s.sql(_NAMES), spelled=True)


_VARIANTS = """SELECT c_custkey, substr(c_name, length(c_name) - 3) AS a, CASE c_custkey % 13 WHEN 0 THEN substr(c_name, length(c_name) - 3) WHEN 1 THEN reverse(substr(c_name, length(c_name) - 3)) WHEN 2 THEN substr(c_name, length(c_name) - 2) WHEN 3 THEN substr(c_name, length(c_name) - 3, 3)
 WHEN 4 THEN concat('x', substr(c_name, length(c_name) - 2)) WHEN 5 THEN concat(substr(c_name, length(c_name) - 3), 'z') WHEN 6 THEN concat('qr', substr(c_name, length(c_name) - 3)) WHEN 7 THEN concat(substr(c_name, length(c_name) - 3, 3), 'y') WHEN 8 THEN concat('x', substr(c_name, length(c_name) - 2, 1), 'w', substr(c_name, length(c_name)))
 WHEN 9 THEN '' WHEN 10 THEN concat(substr(c_name, length(c_name) - 1), substr(c_name, length(c_name) - 3, 3)) WHEN 11 THEN phone_part ELSE concat(substr(c_name, length(c_name)), phone_part) END AS b FROM (SELECT c_custkey, c_name, CAST(c_custkey * 37 % 1000 AS VARCHAR(9)) AS phone_part FROM customer) t"""
_THREE = f"SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN a ELSE substr(a, 2) END AS a, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 13 IN (3, 11) THEN b ELSE concat(substr(a, 2, 1), substr(b, length(b) - 1)) END AS b FROM ({_VARIANTS}) v"


@query(f"SELECT c_custkey, a, b, {_similar('a', 'b')} AS similarity FROM ({_THREE})")
def alias_similarity(s):
    """Names against variants of themselves, by which every rule without a word list is met."""
    return s.sql(_THREE).select("c_custkey", "a", "b", G.alias_similarity(F.col("a"), F.col("b")).alias("similarity"))


_PAIRS = "SELECT DISTINCT source AS a, target AS b FROM kg_edges"


@query(f"""WITH RECURSIVE p AS ({_PAIRS}), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), c AS (SELECT a AS name, a AS m FROM e UNION SELECT c.name, e.b FROM c JOIN e ON e.a = c.m) SELECT name, min(m) AS component FROM c GROUP BY name""")
def alias_components(s):
    return G.alias_components(s.sql(_PAIRS))


@query(f"""WITH RECURSIVE p AS ({_PAIRS}), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), c AS (SELECT a AS name, a AS m FROM e UNION SELECT c.name, e.b FROM c JOIN e ON e.a = c.m), d AS (SELECT name, min(m) AS component FROM c GROUP BY name),
b AS (SELECT component, name AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY starts_with(name, 'Supplier') DESC, length(name) DESC, name DESC) AS k FROM d) WHERE k = 1) SELECT name, canonical FROM d JOIN b USING (component)""")
def canonical_names(s):
    return G.canonical_names(G.alias_components(s.sql(_PAIRS)), "Supplier")


_CANON = "SELECT concat('s', CAST(id AS VARCHAR(9))) AS name, concat('s', CAST(id - id % 4 AS VARCHAR(9))) AS canonical FROM (SELECT DISTINCT l_partkey % 40 AS id FROM lineitem) t"


@query(f"""WITH r AS ({_REL}), c AS ({_CANON}), n AS (SELECT a.canonical AS source, b.canonical AS target, pos FROM r JOIN c a ON a.name = source JOIN c b ON b.name = target WHERE a.canonical <> b.canonical) SELECT least(source, target) AS a, greatest(source, target) AS b, min(pos) AS pos FROM n GROUP BY 1, 2""")
def rewrite_graph_aliases(s):
    entities = s.sql(_CANON).select("name", F.lit("t").alias("type"), F.col("name").alias("description"), F.col("name").alias("pos"))
    relations = G.rewrite_aliases(entities, s.sql(_REL), s.sql(_CANON))[1]
    return relations.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "pos")


@query(f"""WITH r AS ({_REL}), n AS (SELECT concat('s', i) AS name FROM range(0, 30) t(i)), k AS (SELECT source, target, max(pos) AS pos FROM r WHERE source IN (SELECT name FROM n) AND target IN (SELECT name FROM n) GROUP BY 1, 2) SELECT source, target, pos, '关联' AS label FROM k""")
def build_graph(s):
    entities = s.sql(_REL).select(F.col("source").alias("name"), "pos").unionByName(s.sql(_REL).select(F.col("target").alias("name"), "pos")).where("CAST(substr(name, 2) AS INT) < 30")
    return G.build_graph(entities, s.sql(_REL))[1].select("source", "target", "pos", "label")


@query()
def detect_communities(s):
    return G.detect_communities(s.kg_edges)


_COMM = "SELECT name, concat('g', CAST(length(name) * 7 % 3 AS VARCHAR(9)), substr(name, length(name), 1)) AS community FROM (SELECT source AS name FROM kg_edges UNION SELECT target FROM kg_edges) n"


@query(f"""WITH c AS ({_COMM}), v AS (SELECT source AS a, target AS b, strength FROM kg_edges UNION ALL SELECT target, source, strength FROM kg_edges), p AS (SELECT ca.community, sum(strength) AS d, sum(CASE WHEN ca.community = cb.community THEN strength ELSE 0 END) AS i FROM v JOIN c ca ON ca.name = a JOIN c cb ON cb.name = b GROUP BY 1)
SELECT round(sum(i::DOUBLE / m - (d::DOUBLE / m) ^ 2), 6) AS modularity FROM p, (SELECT sum(d) AS m FROM p)""")
def modularity(s):
    return G.modularity(s.kg_edges, s.sql(_COMM))


@query(f"WITH c AS ({_COMM}) SELECT community, count(*) AS size, 0 AS page, concat('[\"', string_agg(name, '\",\"' ORDER BY name), '\"]') AS members FROM c GROUP BY community")
def community_members(s):
    return G.community_members(s.sql(_COMM))


_CTX = f"""c AS ({_COMM}), l AS (SELECT community AS g, 0 AS kind, name AS pos, name AS line FROM c UNION ALL SELECT a.community, 1, concat(source, chr(31), target), concat(source, ' -> ', target) FROM kg_edges JOIN c a ON a.name = source JOIN c b ON b.name = target WHERE a.community = b.community),
k AS (SELECT *, row_number() OVER (PARTITION BY g, kind ORDER BY pos) AS n FROM l), u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY g ORDER BY kind, pos) AS upto FROM k WHERE n <= CASE kind WHEN 0 THEN 10 ELSE 20 END)"""


@query(f"WITH {_CTX} SELECT g AS community, string_agg(line, chr(10) ORDER BY kind, pos) AS context FROM u WHERE upto <= 600 GROUP BY g")
def community_context(s):
    return G.community_context(s.sql(_COMM), s.kg_edges, 600, 10, 20)


@query()
def summarize_communities(s):
    return G.summarize_communities(G.community_context(s.sql(_COMM), s.kg_edges, 600, 10, 20))


def _summaries(s):
    names = F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Z][a-z]+"), F.lit(0)), " ")
    return s.documents.select(F.col("doc_id").alias("community"), F.col("text").alias("summary"), names.alias("entities"))


_TERMS = r"list_distinct(list_transform(regexp_extract_all({t}, '[A-Za-z0-9_]+'), lambda x: lower(x)))"
_SCORE = f"""q AS (SELECT item_id AS query_id, unnest({_TERMS.format(t='text')}) AS term FROM benchmark), d AS (SELECT doc_id AS community, unnest({_TERMS.format(t='text')}) AS term, 2.0::DOUBLE AS w FROM documents UNION ALL SELECT doc_id, unnest({_TERMS.format(t="array_to_string(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+'), ' ')")}), 0.5 FROM documents),
s AS (SELECT query_id, community, sum(w) AS score FROM q JOIN d USING (term) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community) AS rank FROM s)"""


@query(f"WITH {_SCORE} SELECT query_id, community, score, rank FROM r WHERE rank <= 5")
def score_communities(s):
    return G.score_communities(s.benchmark.select(F.col("item_id").alias("query_id"), "text"), _summaries(s))


@query(f"WITH {_SCORE} SELECT query_id, string_agg(concat('[', rank, '] ', text), chr(10) ORDER BY rank) AS text FROM r JOIN documents ON doc_id = community WHERE rank <= 5 GROUP BY query_id")
def global_search(s):
    return G.global_search(s.benchmark.select(F.col("item_id").alias("query_id"), "text"), _summaries(s))


_TOK = "SELECT DISTINCT s_suppkey % 30 AS query_id, substr(s_name, length(s_name) - 2) AS token FROM supplier"
_MATCH = f"""t AS ({_TOK}), n AS (SELECT source AS name FROM kg_edges UNION SELECT target FROM kg_edges), m AS (SELECT query_id, name, max(length(token)) AS n FROM t JOIN n ON contains(name, token) GROUP BY 1, 2), me AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, name) AS rank FROM m)"""


@query(f"WITH {_MATCH} SELECT query_id, name, rank FROM me WHERE rank <= 15")
def match_entities(s):
    from ..operators.joins import undirected

    return G.match_entities(s.sql(_TOK), undirected(s.kg_edges).select("name").distinct())


_LOCAL = f"""{_MATCH}, sd AS (SELECT query_id, name FROM me WHERE rank <= 15), bo AS (SELECT source AS name, target AS other, strength FROM kg_edges UNION ALL SELECT target, source, strength FROM kg_edges), nr AS (SELECT name, other FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY strength DESC, other) AS r FROM bo) WHERE r <= 30),
h1 AS (SELECT DISTINCT query_id, other AS name FROM sd JOIN nr USING (name) EXCEPT SELECT * FROM sd), h2 AS (SELECT DISTINCT query_id, other AS name FROM h1 JOIN nr USING (name) EXCEPT (SELECT * FROM sd UNION SELECT * FROM h1)),
rc AS (SELECT query_id, count(*) AS reached FROM (SELECT * FROM sd UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1),
ra AS (SELECT query_id, source, target, strength FROM kg_edges JOIN sd ON name = source UNION ALL SELECT query_id, source, target, strength FROM kg_edges JOIN sd ON name = target), rb AS (SELECT query_id, source, target, max(strength) * CASE WHEN count(*) = 2 THEN 3 ELSE 1 END AS sc FROM ra GROUP BY 1, 2, 3),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, source, target) AS k FROM rb), lt AS (SELECT query_id, string_agg(concat(source, ' -> ', target), chr(10) ORDER BY k) AS text FROM rr WHERE k <= 30 GROUP BY 1)"""


@query(f"WITH {_LOCAL} SELECT query_id, reached, text FROM rc LEFT JOIN lt USING (query_id)")
def local_search(s):
    return G.local_search(s.sql(_TOK), s.kg_edges)


@query(f"WITH {_LOCAL}, {_SCORE}, g AS (SELECT query_id, string_agg(concat('[', rank, '] ', text), chr(10) ORDER BY rank) AS text FROM r JOIN documents ON doc_id = community WHERE rank <= 5 GROUP BY query_id) SELECT item_id AS query_id, coalesce(lt.text, g.text) AS text, CASE WHEN lt.text IS NOT NULL THEN 'local' WHEN g.text IS NOT NULL THEN 'global' ELSE 'none' END AS kind FROM benchmark LEFT JOIN lt ON lt.query_id = item_id LEFT JOIN g ON g.query_id = item_id")
def graph_context_fallback(s):
    asked = s.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return G.graph_context(local_search(s), G.global_search(asked, _summaries(s)), asked)


_SEED = "SELECT s_suppkey % 10 AS query_id, s_name AS name FROM supplier WHERE s_suppkey % 5 = 0"


@query(f"""WITH sd AS (SELECT DISTINCT * FROM ({_SEED})), bo AS (SELECT source AS name, target AS other, strength FROM kg_edges UNION ALL SELECT target, source, strength FROM kg_edges),
o AS (SELECT query_id, least(name, other) AS a, greatest(name, other) AS b, max(strength) AS strength FROM sd JOIN bo USING (name) GROUP BY 1, 2, 3), o1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, a, b) AS k FROM o) WHERE k <= 80), kn AS (SELECT query_id, a AS name FROM o1 UNION SELECT query_id, b FROM o1),
t AS (SELECT query_id, least(name, other) AS a, greatest(name, other) AS b, max(strength) AS strength FROM kn JOIN bo USING (name) GROUP BY 1, 2, 3), t1 AS (SELECT t.* FROM t ANTI JOIN o1 USING (query_id, a, b)), t2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, a, b) AS k FROM t1) WHERE k <= 40)
SELECT query_id, a, b, strength, 1 AS hop FROM o1 UNION ALL SELECT query_id, a, b, strength, 2 FROM t2""")
def ego_graph(s):
    return G.ego_graph(s.kg_edges, s.sql(_SEED))


@query(f"""WITH sd AS (SELECT DISTINCT name FROM ({_SEED})), bo AS (SELECT source AS name, target AS other, strength FROM kg_edges UNION ALL SELECT target, source, strength FROM kg_edges), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY strength DESC, other) AS k FROM bo WHERE name IN (SELECT name FROM sd))
SELECT name, (SELECT count(DISTINCT other) FROM bo WHERE bo.name = r.name) AS degree, string_agg(other, ',' ORDER BY k) AS neighbours FROM r WHERE k <= 10 GROUP BY name""")
def entity_detail(s):
    return G.entity_detail(s.kg_edges, s.sql(_SEED))


