"""Queries of search, fusion, plans and confidence; the flagship evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as S
from ..operators.lexical_store import passages_in_store
from ..operators.stored import few, saved
from ..operators.vector_codes import coded
from .context import query


def _docs(s):
    return s.documents.select(F.col("doc_id").alias("key"), "text")


def _bm25(s, k):
    return S.bm25_search(_asked(s), s.bm25_store, k)


def _asked(s):
    return s.benchmark.select(F.col("item_id").alias("query_id"), "text")


_T = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


def _bm25_sql(docs: str = "documents", k: int = 5) -> str:
    return f"""tl AS MATERIALIZED (SELECT doc_id AS key, {_T} AS l FROM {docs}), dt AS MATERIALIZED (SELECT key, unnest(l) AS term, len(l) AS dl FROM tl), p AS MATERIALIZED (SELECT term, key, dl, count(*) AS tf FROM dt GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT key, dl FROM p)), dfq AS (SELECT term, count(*) AS df FROM p GROUP BY term),
qt AS (SELECT item_id AS query_id, unnest(list_distinct({_T})) AS term FROM benchmark),
bs AS (SELECT query_id, key, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM qt JOIN dfq USING (term) JOIN p USING (term), st GROUP BY 1, 2),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM bs), b AS (SELECT * FROM br WHERE rank <= {k})"""


@query(f"""WITH {_bm25_sql()}, x AS (SELECT item_id, b.text, min(d.doc_id) AS doc FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1, 2),
h AS (SELECT item_id, doc, (SELECT min(rank) FROM b JOIN documents dd ON dd.doc_id = b.key WHERE query_id = item_id AND contains(dd.text, x.text)) AS r FROM x)
SELECT count(*) AS cases, count(doc) AS annotated, round(avg(CASE WHEN doc IS NOT NULL THEN (r IS NOT NULL)::INT END), 6) AS recall_at_5, round(avg(CASE WHEN doc IS NOT NULL THEN coalesce(1.0::DOUBLE / r, 0) END), 6) AS mrr FROM h""")
def eval_summary(s):
    """Benchmark passages as queries over all documents by BM25; a hit is a document that holds the passage."""
    top = few(saved(_bm25(s, 5), "eval-top"), 100_000)
    good = F.contains("text", F.col("passage"))
    passages = s.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    ranks = _docs(s).join(top, "key").join(passages, "query_id").where(good).groupBy("query_id").agg(F.min("rank").alias("r"))
    covered = passages_in_store(passages.select(F.col("passage").alias("text")), s.bm25_store, _docs(s)).select(F.col("text").alias("passage")).distinct()
    covered = passages.join(covered, "passage").select("query_id").withColumn("there", F.lit(True))
    rows = passages.select("query_id").join(covered, "query_id", "left").join(ranks, "query_id", "left")
    return rows.agg(F.count("*").alias("cases"), F.count("there").alias("annotated"), F.round(F.avg(F.when(F.col("there"), F.col("r").isNotNull().cast("double"))), 6).alias("recall_at_5"), F.round(F.avg(F.when(F.col("there"), F.coalesce(1 / F.col("r"), F.lit(0.0)))), 6).alias("mrr"))


@query(f"WITH {_bm25_sql()} SELECT term, key, dl, tf FROM p")
def build_bm25_index(s):
    return S.build_bm25_index(_docs(s))


@query(f"WITH {_bm25_sql(k=10)} SELECT query_id, key, score, rank FROM b")
def bm25_search(s):
    return _bm25(s, 10)


def _vectors(s):
    return s.embeddings.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"), "label")


def _vq(s):
    return _vectors(s).where("key % 20 = 0").select(F.col("key").alias("query_id"), "vec", "label")


def _dense_sql(v: str = "embedding::DOUBLE[]", where: str = "", k: int = 10, q: str = "vec_id % 20 = 0") -> str:
    return f"""n AS (SELECT vec_id AS key, label, {v} AS v FROM embeddings), u AS (SELECT key, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM n),
dd AS (SELECT a.key AS query_id, b.key, round(list_inner_product(a.v, b.v), 6) AS score FROM u a JOIN u b ON true WHERE a.key IN (SELECT vec_id FROM embeddings WHERE {q}) {where}),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM dd), d AS (SELECT * FROM dr WHERE rank <= {k})"""


@query(f"WITH {_dense_sql()} SELECT query_id, key, score, rank FROM d")
def dense_search(s):
    return S.dense_search(_vq(s), _vectors(s), 10)


@query()
def dense_search_ann(s):
    return S.dense_search_ann(_vq(s), _vectors(s), 10)


@query("SELECT count(*) AS queries, true AS recall_reached, (SELECT count(*) FROM embeddings) AS vectors, greatest(50, least(300, (SELECT count(*) FROM embeddings) // 20)) AS read_a_query FROM embeddings WHERE vec_id % 20 = 0")
def ann_recall(s):
    """Recall@10 of the coded search against the exact one over all queries, and the full vectors it reads for each."""
    store = coded(_vectors(s).select("key", "vec"))
    read = max(50, min(300, store.n // 20))
    got = S.recall_of(S.dense_search_ann(_vq(s), store, 10, read), S.dense_search(_vq(s), _vectors(s), 10))
    return got.select("queries", (F.col("recall") >= 0.9).alias("recall_reached"), F.lit(store.n).cast("long").alias("vectors"), F.lit(read).cast("long").alias("read_a_query"))


@query(f"WITH {_dense_sql(k=50)}, a AS (SELECT query_id, key, 0.55::DOUBLE * (1 + score) / 2 AS score FROM d WHERE rank <= 10 UNION ALL SELECT query_id, key, 0.45::DOUBLE * score FROM d WHERE rank > 5) SELECT query_id, key, round(sum(score), 9) AS score FROM a GROUP BY 1, 2")
def weighted_fusion(s):
    top = S.dense_search(_vq(s), _vectors(s), 50)
    return S.weighted_fusion([(S.cosine_unit(top.where("rank <= 10")), 0.55), (top.where("rank > 5"), 0.45)])


@query(f"""WITH {_bm25_sql(k=50)}, n AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 40), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM n),
w AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.v, b.v), 6) AS score FROM u a, u b), dd AS (SELECT item_id AS query_id, doc_id AS key, score FROM benchmark JOIN w ON a = item_id % 40 JOIN documents ON b = doc_id % 40 WHERE documents.text IS NOT NULL),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM dd) WHERE rank <= 50),
f AS (SELECT query_id, key, round(sum(score), 9) AS score FROM (SELECT query_id, key, (1 + score) / 2 * 0.55::DOUBLE AS score FROM d UNION ALL SELECT query_id, key, score / (1 + score) * 0.45::DOUBLE FROM b) GROUP BY 1, 2)
SELECT query_id, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM f) WHERE rank <= 5""")
def hybrid_search(s):
    """Texts by BM25 and given vectors, one of forty for each row, by cosine."""
    vectors = s.embeddings.where("vec_id < 40").select(F.col("vec_id").alias("v"), F.col("embedding").alias("vec"))
    with_vec = lambda d, i: d.join(F.broadcast(vectors), F.col(i) % 40 == F.col("v")).drop("v")  # noqa: E731  forty rows
    return S.hybrid_search(with_vec(_asked(s), "query_id"), with_vec(_docs(s).where("text IS NOT NULL"), "key"), 5, store=s.bm25_store)


def _half(name: str, a: int, b: int) -> str:
    return _dense_sql(f"(embedding::DOUBLE[])[{a}:{b}]", k=100).replace("n AS", f"n{name} AS").replace("FROM n)", f"FROM n{name})").replace("u AS", f"u{name} AS").replace("FROM u a JOIN u b", f"FROM u{name} a JOIN u{name} b").replace("dd AS", f"dd{name} AS").replace("FROM dd)", f"FROM dd{name})").replace("dr AS", f"dr{name} AS").replace(" d AS (SELECT * FROM dr ", f" d{name} AS (SELECT * FROM dr{name} ")


@query(f"""WITH {_half('1', 1, 32)}, {_half('2', 33, 64)}, a AS (SELECT query_id, key, 0.35::DOUBLE * (1 + score) / 2 AS score FROM d1 UNION ALL SELECT query_id, key, 0.65::DOUBLE * (1 + score) / 2 FROM d2), f AS (SELECT query_id, key, round(sum(score), 9) AS score FROM a GROUP BY 1, 2)
SELECT query_id, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM f) WHERE rank <= 5""")
def multi_vector_search(s):
    halves = lambda d, k: d.select(k, F.slice("vec", 1, 32).alias("title"), F.slice("vec", 33, 32).alias("content"))
    return S.multi_vector_search(halves(_vq(s), "query_id"), halves(_vectors(s), "key"), {"title": 0.35, "content": 0.65}, 5)


@query(f"WITH {_dense_sql(where='AND b.label = 3', k=5)} SELECT query_id, key, score, rank FROM d")
def batch_partition_search(s):
    return S.dense_search(_vq(s), _vectors(s).where("label = 3"), 5)


@query("""WITH b AS (SELECT query_id, chunk_id AS key, score, variant_no, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, variant_no) AS n FROM hits), r AS (SELECT query_id, key, score, variant_no, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM b WHERE n = 1)
SELECT query_id, key, score, variant_no, rank FROM r JOIN (SELECT query_id, 2 * count(DISTINCT variant_no) AS cap FROM hits GROUP BY 1) USING (query_id) WHERE rank <= cap AND rank <= 5""")
def search_many(s):
    hits = s.hits.select("query_id", F.col("chunk_id").alias("key"), "score", "variant_no")
    return S.search_many(hits, s.hits.select("query_id", "variant_no").distinct(), 5, per_variant=2)


_SPLIT = r"list_distinct(list_filter(regexp_split_to_array(lower({t}), '\s+'), lambda x: x <> ''))"


@query(f"""WITH {_bm25_sql(k=20)}, o AS (SELECT query_id, key, {_SPLIT.format(t='q.text')} AS a, {_SPLIT.format(t='d.text')} AS t FROM b JOIN benchmark q ON item_id = query_id JOIN documents d ON doc_id = key),
v AS (SELECT query_id, key, round(len(list_intersect(a, t)) / greatest(1, len(a))::DOUBLE, 6) AS score FROM o), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM v) SELECT query_id, key, score, rank FROM w WHERE rank <= 5""")
def rerank(s):
    top = few(saved(_bm25(s, 20), "rerank-top"), 100_000)
    return S.rerank(_docs(s).join(top, "key").join(_asked(s).withColumnRenamed("text", "query"), "query_id"))


def _variants_sql() -> str:
    made = []
    for any_of, all_of, fold, pairs in S.R.VARIANT_RULES:
        q = "lower(question)" if fold else "question"
        when = " AND ".join([*([f"regexp_matches({q}, '{'|'.join(any_of)}')"] if any_of else []), *[f"contains({q}, '{x}')" for x in all_of]])
        for old, new in pairs:
            made.append(f"CASE WHEN {when} THEN trim(regexp_replace(question, '{'(?i)' if fold else ''}{old}', '{new}', 'g')) END")
    return f"list_filter([question, {', '.join(made)}], lambda x: x IS NOT NULL AND x <> '')"


@query(f"""WITH a AS (SELECT query_id, question, {_variants_sql()} AS l, length(question) <= 24 AND regexp_matches(question, '{'|'.join(S.R.SHORT_STRUCTURED)}') AS short FROM questions),
b AS (SELECT query_id, CASE WHEN short THEN [question] ELSE (list_filter(l, lambda x, i: list_position(l, x) = i))[1:3] END AS v FROM a) SELECT query_id, unnest(range(0, len(v))) AS variant_no, unnest(v) AS variant FROM b""")
def query_variants(s):
    return s.questions.select("query_id", F.posexplode(S.query_variants(F.col("question"))).alias("variant_no", "variant"))


@query("SELECT query_id, substr(sha256(concat(scenario_id, '||', selected_source, '||', 'v', turn, '||', 'hr,public', '||', question)), 1, 24) AS k FROM questions")
def retrieval_key(s):
    rows = s.questions.select("query_id", "scenario_id", "selected_source", F.concat(F.lit("v"), F.col("turn").cast("string")).alias("version"), F.array(F.lit("public"), F.lit("hr")).alias("roles"), F.array("question").alias("variants"))
    return rows.select("query_id", S.retrieval_key(["scenario_id", "version", "selected_source"], "roles", "variants").alias("k"))


@query("SELECT pos, CASE WHEN pos % 3 = 0 OR (pos % 4 <> 0 AND (pos % 100) / 100.0 >= 0.72) THEN nullif(trim(answer), '') END AS answer FROM faq")
def faq_direct_answer(s):
    asked = F.when(F.col("pos") % 3 == 0, F.concat(F.lit(" "), "question")).otherwise(F.lit("\u0001"))
    return s.faq.select("pos", S.faq_direct_answer(asked, F.col("question"), F.col("answer"), (F.col("pos") % 100) / 100.0, F.lit(0.72), F.col("pos") % 4 == 0).alias("answer"))


_HINTS = "|".join(S.R.FAQ_FAST_HINTS)


@query(f"SELECT query_id, trim(question) <> '' AND length(trim(question)) <= 48 AND NOT contains(trim(question), chr(10)) AND (regexp_matches(question, '{_HINTS}') OR conv_id % 2 = 0) AS fast FROM questions")
def faq_fast_path_gate(s):
    return s.questions.select("query_id", S.faq_fast_path(F.col("question"), F.col("conv_id") % 2 == 0).alias("fast"))


_PLANNED = "SELECT query_id, question AS query, CASE query_id % 4 WHEN 0 THEN 'FAQ_QUERY' WHEN 1 THEN 'KNOWLEDGE_QUERY' WHEN 2 THEN 'FOLLOW_UP' ELSE 'GREETING' END AS intent, 0.60 + (query_id * 7 % 5) * 0.07 AS decision_score, CASE query_id * 3 % 5 WHEN 0 THEN 'pricing' WHEN 1 THEN 'compliance' WHEN 2 THEN 'troubleshooting' WHEN 3 THEN 'summary' ELSE 'default' END AS category, query_id % 7 = 0 AS table_query FROM questions"


@query(f"""WITH a AS (SELECT *, length(trim(query)) <= 20 AS short FROM ({_PLANNED})),
b AS (SELECT *, CASE WHEN intent = 'FOLLOW_UP' THEN 24 WHEN short THEN 30 ELSE 20 END AS f1, CASE intent WHEN 'FAQ_QUERY' THEN 10 WHEN 'GREETING' THEN 20 ELSE 24 END AS d1, CASE WHEN intent IN ('KNOWLEDGE_QUERY', 'FOLLOW_UP') THEN 5 ELSE 4 END AS c1,
 CASE intent WHEN 'FAQ_QUERY' THEN 0.64 WHEN 'FOLLOW_UP' THEN 0.82 ELSE 0.72 END AS t1, CASE intent WHEN 'FAQ_QUERY' THEN 'faq_first' WHEN 'KNOWLEDGE_QUERY' THEN 'knowledge_doc_enriched' WHEN 'FOLLOW_UP' THEN 'history_aware_follow_up' ELSE 'balanced_retrieval' END AS r1 FROM a),
c AS (SELECT *, short AND intent <> 'FOLLOW_UP' AS g, decision_score::DOUBLE < 0.70 AS low, decision_score::DOUBLE >= 0.70 AND decision_score::DOUBLE < 0.82 AS mid FROM b),
d AS (SELECT *, CASE WHEN g THEN least(d1, 12) ELSE d1 END AS d2, CASE WHEN g THEN greatest(t1, 0.78) ELSE t1 END AS t2, r1 || CASE WHEN g THEN '_short_query_guard' ELSE '' END AS r2 FROM c),
e AS (SELECT *, CASE WHEN low THEN greatest(d2, 24) WHEN mid THEN greatest(d2, 20) ELSE d2 END AS d3, CASE WHEN low THEN greatest(c1, 6) ELSE c1 END AS c3, CASE WHEN low THEN greatest(t2, 0.86) WHEN mid THEN greatest(t2, 0.82) ELSE t2 END AS t3, r2 || CASE WHEN low THEN '_low_rule_score_guard' WHEN mid THEN '_rule_score_guard' ELSE '' END AS r3 FROM d),
h AS (SELECT *, category <> 'default' AS k FROM e)
SELECT query_id, CASE WHEN category = 'pricing' THEN greatest(f1, 20) ELSE f1 END AS faq_top_k, CASE WHEN k OR table_query THEN greatest(d3, 24) ELSE d3 END AS doc_top_k, CASE WHEN table_query THEN 7 WHEN k THEN greatest(c3, 6) ELSE c3 END AS context_top_n,
CAST(CASE category WHEN 'pricing' THEN greatest(t3, 0.84) WHEN 'compliance' THEN greatest(t3, 0.86) ELSE t3 END AS DOUBLE) AS direct_threshold, low OR table_query AS exact_only,
r3 || CASE category WHEN 'pricing' THEN '_pricing_guard' WHEN 'compliance' THEN '_compliance_guard' WHEN 'troubleshooting' THEN '_troubleshooting_expanded' WHEN 'summary' THEN '_summary_expanded' ELSE '' END || CASE WHEN table_query THEN '_table_row_preferred' ELSE '' END AS reason FROM h""")
def retrieval_plan(s):
    rows = s.sql(_PLANNED).withColumn("decision_score", F.col("decision_score").cast("double"))
    return S.retrieval_plan(rows).select("query_id", "faq_top_k", "doc_top_k", "context_top_n", F.col("direct_threshold").cast("double").alias("direct_threshold"), "exact_only", "reason")


_CONF = "SELECT trace_id, CASE trace_id % 4 WHEN 0 THEN 'rag' WHEN 1 THEN 'faq_direct' WHEN 2 THEN 'insufficient_context' ELSE 'graph_context' END AS hit_type, CAST(total_ms AS DOUBLE) / 20 AS top_score, trace_id % 6 AS context_count, trace_id % 5 AS source_count, (trace_id % 10) / 10.0 AS decision_score, trace_id % 11 = 0 AS deterministic, trace_id % 3 = 0 AS faq_exact, trace_id % 7 = 0 AS rewritten FROM traces"


@query(f"""WITH a AS (SELECT *, decision_score::DOUBLE AS d, CASE WHEN top_score <= 0 THEN 0 WHEN top_score <= 1 THEN top_score ELSE 1 - 1 / (1 + top_score) END AS u FROM ({_CONF})),
b AS (SELECT *, CASE WHEN deterministic THEN 0.78::DOUBLE + 0.18::DOUBLE * d WHEN hit_type = 'faq_direct' AND faq_exact THEN 0.95::DOUBLE WHEN hit_type = 'faq_direct' THEN 0.55::DOUBLE + 0.35::DOUBLE * u + 0.08::DOUBLE * d WHEN hit_type = 'insufficient_context' THEN 0.12::DOUBLE + 0.15::DOUBLE * u
 ELSE 0.20::DOUBLE + 0.45::DOUBLE * u + least(context_count, 4) * 0.06::DOUBLE + least(source_count, 3) * 0.04::DOUBLE + 0.12::DOUBLE * d END - CASE WHEN rewritten THEN CASE WHEN context_count >= 2 THEN 0.05::DOUBLE ELSE 0.08::DOUBLE END ELSE 0 END - CASE WHEN d < 0.70 AND NOT deterministic THEN 0.04::DOUBLE ELSE 0 END AS s FROM a),
c AS (SELECT trace_id, round(round(greatest(least(CASE WHEN hit_type = 'rag' AND context_count = 0 THEN least(s, 0.35::DOUBLE) ELSE s END, 1), 0), 9), 2) AS confidence FROM b)
SELECT trace_id, confidence, CASE WHEN confidence >= 0.82 THEN 'high' WHEN confidence >= 0.55 THEN 'medium' ELSE 'low' END AS level FROM c""")
def answer_confidence(s):
    return S.answer_confidence(s.sql(_CONF).withColumn("decision_score", F.col("decision_score").cast("double"))).select("trace_id", "confidence", "level")


@query("""SELECT trace_id, CASE WHEN trace_id % 13 = 0 THEN 'direct' WHEN trace_id % 11 = 0 THEN 'boundary' WHEN trace_id % 7 = 0 THEN 'faq_direct' WHEN trace_id % 5 > 0 THEN 'rag' WHEN trace_id % 2 = 0 THEN 'graph_context' ELSE 'insufficient_context' END AS route FROM traces""")
def route_query(s):
    i = F.col("trace_id")
    return s.traces.select("trace_id", S.route_query(F.when(i % 13 == 0, "x"), i % 11 == 0, i % 7 == 0, i % 5, i % 2 == 0).alias("route"))


@query()
def answer_chain(s):
    """All steps of a question over its own hits; tests hold it against the steps taken one by one."""
    from ..operators.answer import answer_chain as chain

    questions = s.questions.select("query_id", "question", "has_history", F.when(F.col("conv_id") % 3 == 0, F.col("selected_source")).otherwise("").alias("source"))
    faq = s.faq.select(F.col("pos").alias("faq_id"), "question")
    return chain(questions, faq, s.documents.select(F.col("doc_id").alias("key"), "text", "source"), store=s.bm25_store)


@query("SELECT doc_id AS id, length(coalesce(text, ''))::DOUBLE AS chars, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')))::DOUBLE AS spaces FROM documents")
def dedup_embedding_inputs(s):
    def embed(texts):
        return [[float(len(t or "")), float((t or "").count(" "))] for t in texts]

    return S.dedup_embedding_inputs(s.documents.select(F.col("doc_id").alias("id"), "text"), embed, "m1").select("id", F.get("vec", 0).alias("chars"), F.get("vec", 1).alias("spaces"))


@query("SELECT doc_id, CASE WHEN text = '' OR text IS NULL THEN 0 ELSE 1 END AS norm FROM documents")
def text_hash_vectors(s):
    v = S.text_hash_vectors(F.col("text"))
    return s.documents.select("doc_id", F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), 6).cast("int").alias("norm"))


