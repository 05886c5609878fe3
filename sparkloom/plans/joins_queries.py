"""Queries of the joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import NUMERIC_FACT, VERSION_NUMBER
from ..operators import joins as J
from ..operators import sets as U
from .context import query

_TARGET = "SELECT * FROM new_manifest WHERE doc_id % 3 = 0"


@query("""SELECT n.path, n.source, n.fingerprint, n.schema_version, n.doc_id,
CASE WHEN t.path IS NOT NULL THEN 'unchanged' WHEN b.fingerprint = n.fingerprint AND b.schema_version = n.schema_version THEN 'reusable' WHEN b.path IS NOT NULL THEN 'changed' ELSE 'new' END AS status
FROM new_manifest n LEFT JOIN (SELECT * FROM new_manifest WHERE doc_id % 3 = 0) t ON t.path = n.path LEFT JOIN base_manifest b ON b.path = n.path""")
def manifest_diff(s):
    return J.manifest_diff(s.new_manifest, s.new_manifest.where("doc_id % 3 = 0"), s.base_manifest)


@query("SELECT path, doc_id FROM base_manifest WHERE path NOT IN (SELECT path FROM new_manifest)")
def expire_missing(s):
    return J.expire_missing(s.base_manifest, s.new_manifest).select("path", "doc_id")


@query("""SELECT source, count(*) FILTER (h) AS existing, count(*) FILTER (NOT h) AS missing, coalesce(sum(1 + doc_id % 3) FILTER (NOT h), 0)::BIGINT AS affected_chunks
FROM (SELECT *, path IN (SELECT path FROM new_manifest) AS h FROM base_manifest) GROUP BY source""")
def missing_document_cleanup(s):
    records = s.base_manifest.withColumn("chunk_ids", F.sequence(F.lit(1), (1 + F.col("doc_id") % 3).cast("int")))
    return J.missing_cleanup(records, s.new_manifest)


_FAQ = "SELECT CAST(pos AS BIGINT) AS faq_id, CASE WHEN pos % 5 = 0 THEN '' ELSE source END AS source, question, answer FROM faq"
_TOK = r"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}]+')"
_KW = f"list_filter({_TOK.format(t='''concat(question, ' ', answer)''')}, lambda x: length(x) >= 2)"
_REL = f"""f AS ({_FAQ}), k AS (SELECT faq_id, source, unnest((list_filter(l, lambda x, i: list_position(l, x) = i))[1:12]) AS token, least(12, len(list_distinct(l))) AS n FROM (SELECT *, {_KW} AS l FROM f)),
c AS (SELECT doc_id, source AS cs, doc_id % 4 = 0 AS tab, unnest(list_distinct({_TOK.format(t='text')})) AS token FROM documents),
p AS (SELECT faq_id, doc_id, count(*) AS shared, max(length(token)) AS longest, any_value(n) AS n, any_value(tab) AS tab FROM k JOIN c USING (token) WHERE source = '' OR source = cs GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY faq_id ORDER BY shared DESC, doc_id) AS rank FROM p WHERE shared >= CASE WHEN n >= 6 THEN 3 WHEN n >= 3 THEN 2 ELSE 1 END AND (NOT tab OR shared >= 2 OR longest >= 3))"""


def _faq(s):
    return s.sql(_FAQ), s.documents.select(F.col("doc_id").alias("chunk_id"), "source", "text", (F.col("doc_id") % 4 == 0).alias("is_table"))


@query(f"WITH {_REL} SELECT faq_id, doc_id AS chunk_id, shared, rank FROM r WHERE rank <= 5")
def faq_document_relate(s):
    return J.faq_document_relate(*_faq(s))


_NUM = f"list_distinct(list_transform(regexp_extract_all(regexp_replace(coalesce({{t}}, ''), '{VERSION_NUMBER}', '', 'g'), '{NUMERIC_FACT}'), lambda x: replace(x, ' ', '')))".replace("{4}", "{{4}}").replace("{2}", "{{2}}").replace("{1,2}", "{{1,2}}")


@query(f"""WITH {_REL}, x AS (SELECT faq_id, doc_id, answer, text FROM r JOIN f USING (faq_id) JOIN documents USING (doc_id) WHERE rank <= 5)
SELECT faq_id, doc_id AS chunk_id, 'polarity_mismatch' AS kind FROM x WHERE (contains(answer, ' the ') AND NOT contains(answer, ' of ') AND contains(text, ' of ') AND NOT contains(text, ' the ')) OR (contains(answer, ' of ') AND NOT contains(answer, ' the ') AND contains(text, ' the ') AND NOT contains(text, ' of '))
UNION ALL SELECT faq_id, doc_id, 'numeric_mismatch' FROM (SELECT faq_id, doc_id, {_NUM.format(t='answer')} AS na, {_NUM.format(t='text')} AS nt FROM x) WHERE len(na) > 0 AND len(nt) > 0 AND len(list_intersect(na, nt)) = 0
UNION ALL SELECT faq_id, NULL, 'no_related_document' FROM f WHERE faq_id NOT IN (SELECT faq_id FROM r WHERE rank <= 5)""")
def faq_document_conflicts(s):
    return J.faq_document_conflicts(*_faq(s), polarity=lambda c: T.polarity(c, " the ", " of "))


_ENT = "SELECT s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0 UNION SELECT c_name FROM customer WHERE c_custkey % 4 <> 0"


@query(f"WITH e AS ({_ENT}) SELECT source, target, strength FROM kg_edges WHERE source IN (SELECT name FROM e) AND target IN (SELECT name FROM e)")
def dangling_edge_filter(s):
    return J.dangling_edge_filter(s.kg_edges, s.sql(_ENT)).select("source", "target", "strength")


_BOTH = "b AS (SELECT source AS name, target AS other, strength FROM kg_edges UNION ALL SELECT target, source, strength FROM kg_edges)"


@query(f"WITH {_BOTH}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY strength DESC, other) AS rank FROM b JOIN (SELECT s_name FROM supplier WHERE s_suppkey % 2 = 0) ON name = s_name) SELECT name, other, strength, rank FROM r WHERE rank <= 20")
def neighbor_lookup(s):
    return J.neighbor_lookup(s.kg_edges, s.supplier.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("name")), 20)


_SEEDS = "SELECT s_suppkey % 10 AS query_id, s_name AS name FROM supplier WHERE s_suppkey % 5 = 0"


@query(f"""WITH {_BOTH}, n AS (SELECT name, other FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY strength DESC, other) AS r FROM b) WHERE r <= 30),
h0 AS (SELECT DISTINCT query_id, name FROM ({_SEEDS})), h1 AS (SELECT DISTINCT query_id, other AS name FROM h0 JOIN n USING (name) EXCEPT SELECT * FROM h0),
h2 AS (SELECT DISTINCT query_id, other AS name FROM h1 JOIN n USING (name) EXCEPT (SELECT * FROM h0 UNION SELECT * FROM h1))
SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2""")
def khop_traverse(s):
    return J.khop_traverse(s.kg_edges, s.sql(_SEEDS))


@query(f"""WITH {_BOTH}, x AS (SELECT name FROM ({_SEEDS}) UNION SELECT other FROM b WHERE name IN (SELECT name FROM ({_SEEDS}))) SELECT source, target, strength FROM kg_edges WHERE source IN (SELECT name FROM x) AND target IN (SELECT name FROM x)""")
def induced_subgraph(s):
    return J.induced_subgraph(s.kg_edges, s.sql(_SEEDS)).select("source", "target", "strength")


_CASES = "SELECT DISTINCT query_id AS case_id, prefer_table, concat('SRC ', CAST(query_id % 5 AS VARCHAR(9))) AS e FROM hits"
_CHITS = "SELECT query_id AS case_id, variant_no AS rank, source AS source_text, source_type <> 'faq' AS is_doc FROM hits"


@query(f"""WITH c AS ({_CASES}), h AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN prefer_table AND NOT is_doc THEN 1 ELSE 0 END, rank) AS pos FROM c JOIN ({_CHITS}) USING (case_id))
SELECT case_id, min(pos) FILTER (contains(source_text, lower(replace(e, ' ', '')))) AS source_rank FROM h GROUP BY case_id""")
def expected_source_match(s):
    return J.expected_source_rank(s.sql(_CASES).withColumn("expected", F.array("e")), s.sql(_CHITS))


_OLD = "SELECT query_id AS case_id, variant_no AS rank, source AS key FROM hits WHERE variant_no % 2 = 1"
_NEW = "SELECT query_id AS case_id, variant_no AS rank, source AS key FROM hits WHERE variant_no % 3 <> 0"
_EXP = "SELECT DISTINCT query_id AS case_id, concat('src', CAST(query_id % 5 AS VARCHAR(9))) AS key FROM hits"
_COMPARE = f"""o AS ({_OLD}), n AS ({_NEW}), e AS ({_EXP}), ot AS (SELECT case_id, arg_min(key, rank) AS t FROM o GROUP BY 1), nt AS (SELECT case_id, arg_min(key, rank) AS t FROM n GROUP BY 1),
orr AS (SELECT case_id, min(rank) AS r FROM o JOIN e USING (case_id, key) GROUP BY 1), nr AS (SELECT case_id, min(rank) AS r FROM n JOIN e USING (case_id, key) GROUP BY 1),
cmp AS (SELECT e.case_id, ot.t IS DISTINCT FROM nt.t AS top_changed, orr.r IS NOT NULL AS old_recall, nr.r IS NOT NULL AS new_recall, coalesce(1.0::DOUBLE / nr.r, 0) - coalesce(1.0::DOUBLE / orr.r, 0) AS mrr_delta
FROM e LEFT JOIN ot USING (case_id) LEFT JOIN nt USING (case_id) LEFT JOIN orr USING (case_id) LEFT JOIN nr USING (case_id))"""


@query(f"WITH {_COMPARE} SELECT case_id, top_changed, old_recall, new_recall, round(mrr_delta, 6) AS mrr_delta FROM cmp")
def version_compare_join(s):
    return J.version_compare(s.sql(_OLD), s.sql(_NEW), s.sql(_EXP)).withColumn("mrr_delta", F.round("mrr_delta", 6))


@query("SELECT r.case_id, coalesce(r.scenario_id, 'x') AS scenario_id, coalesce(CASE WHEN r.case_id % 2 = 0 THEN 'rag' END, r.hit_type) AS hit_type, r.elapsed_ms FROM eval_rows r")
def restore_original_fields(s):
    cases = s.eval_rows.select("case_id", F.lit("x").alias("scenario_id"), F.when(F.col("case_id") % 2 == 0, "rag").alias("hit_type"))
    return J.restore_fields(s.eval_rows.select("case_id", "scenario_id", "hit_type", "elapsed_ms"), cases, ["scenario_id"], ["hit_type"])


@query("SELECT q.query_id, f.pos AS faq_id FROM (SELECT conv_id * 1000 + turn AS query_id, trim(text) AS q FROM conversations WHERE role = 'user') q JOIN faq f ON trim(f.question) = q WHERE q <> ''")
def query_document_match(s):
    queries = s.conversations.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))
    return J.query_document_match(queries, s.faq.select(F.col("pos").alias("faq_id"), "question")).select("query_id", "faq_id")


@query("""WITH q AS (SELECT query_id, selected_source FROM questions), h AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents)
SELECT query_id, sha256(selected_source) AS cache_key, doc_id, rank FROM q JOIN h ON source = selected_source WHERE rank <= 3""")
def cache_reuse_join(s):
    from ..operators.ranking import topk_per_group

    def search(q):
        top = topk_per_group(s.documents.select("source", "doc_id"), ["source"], [F.col("doc_id")], 3)
        return q.join(top, q["selected_source"] == top["source"]).select("query_id", "doc_id", "rank")

    return J.cache_reuse(s.questions.select("query_id", "selected_source"), F.sha2("selected_source", 256), search).select("query_id", "cache_key", "doc_id", "rank")


@query("""WITH r AS (SELECT *, 0 AS p FROM faq WHERE pos % 2 = 0 UNION ALL SELECT *, 1 FROM faq WHERE pos % 3 = 0), n AS (SELECT *, CASE WHEN trim(question) = '' THEN 1 ELSE row_number() OVER (PARTITION BY trim(question) ORDER BY p, pos) END AS n FROM r)
SELECT pos, question, n = 1 AS kept FROM n""")
def union_keep_first(s):
    kept, dropped = U.union_keep_first(s.faq.where("pos % 2 = 0"), s.faq.where("pos % 3 = 0"))
    return kept.select("pos", "question", F.lit(True).alias("kept")).unionByName(dropped.select("pos", "question", F.lit(False).alias("kept")))


@query("""SELECT case_id, CASE WHEN case_id % 3 = 0 THEN elapsed_ms + 1 ELSE elapsed_ms END AS elapsed_ms, CASE WHEN case_id % 2 <> 0 THEN 'inserted' WHEN case_id % 3 <> 0 THEN 'kept' ELSE 'replaced' END AS action FROM eval_rows WHERE case_id % 2 = 0 OR case_id % 3 = 0""")
def merge_cases(s):
    rows = s.eval_rows.select("case_id", "elapsed_ms")
    return U.merge_cases(rows.where("case_id % 2 = 0"), rows.where("case_id % 3 = 0").withColumn("elapsed_ms", F.col("elapsed_ms") + 1))


@query("SELECT DISTINCT text FROM benchmark WHERE text NOT IN (SELECT b.text FROM benchmark b JOIN documents d ON contains(d.text, b.text))")
def coverage_gap(s):
    docs = s.documents.select(F.col("doc_id").alias("key"), "text")
    return U.coverage_gap(s.benchmark.select("text"), U.passages_in(s.benchmark, docs).select("text"))


@query("""SELECT avg(CASE WHEN scenario_id = a THEN 1.0 ELSE 0.0 END)::DOUBLE AS turn_share, (SELECT count(*) FROM (SELECT scenario_id FROM eval_rows INTERSECT SELECT concat('scn', case_id % 3) FROM eval_rows))::DOUBLE / (SELECT count(DISTINCT scenario_id) FROM eval_rows) AS scenario_share
FROM (SELECT scenario_id, concat('scn', case_id % 3) AS a FROM eval_rows)""")
def scenario_isolation(s):
    return U.scenario_isolation(s.eval_rows.select(F.col("scenario_id").alias("expected"), F.concat(F.lit("scn"), (F.col("case_id") % 3).cast("string")).alias("actual")))


@query("SELECT coalesce(o.path, b.path) AS path, coalesce(o.fingerprint, b.fingerprint) AS content, o.path IS NOT NULL AND b.path IS NOT NULL AS overwritten FROM base_manifest b FULL JOIN new_manifest o ON o.path = b.path")
def overlay_files(s):
    c = lambda d: d.select("path", F.col("fingerprint").alias("content"))
    return U.overlay_files(c(s.base_manifest), c(s.new_manifest))
