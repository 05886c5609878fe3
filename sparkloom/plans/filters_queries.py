"""Queries of the filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import filters as P
from .context import query

_CALLERS = "SELECT DISTINCT lang AS caller, 'default' AS tenant_id, 'default' AS dataset_id, CASE lang WHEN 'en' THEN 'internal' WHEN 'fr' THEN 'private' ELSE 'guest' END AS visibility, CASE lang WHEN 'de' THEN 'hr' ELSE 'public' END AS role FROM documents"


@query(f"""WITH c AS ({_CALLERS}) SELECT caller, doc_id FROM kb_docs k JOIN c USING (tenant_id, dataset_id)
WHERE (k.visibility = 'public' OR (k.visibility = c.visibility AND c.visibility IN ('internal', 'private'))) AND list_contains(string_split(allowed_roles_csv, ','), role)""")
def scope_filter(s):
    callers = s.sql(_CALLERS).withColumn("roles", F.array("role"))
    return P.scope_filter(s.kb_docs.withColumn("allowed_roles", F.split("allowed_roles_csv", ",")), callers).select("caller", "doc_id")


@query("""SELECT v AS seq, doc_id, source, row_number() OVER (PARTITION BY v ORDER BY source, doc_id) AS pos FROM kb_docs, range(1, 6) t(v)
WHERE valid_from_seq <= v AND (valid_to_seq = 0 OR valid_to_seq > v)""")
def version_window_filter(s):
    from pyspark.sql import Window

    versions = s.kb_docs.select(F.col("valid_from_seq").alias("seq")).distinct().unionByName(s.spark.range(5, 6).toDF("seq")).distinct()
    rows = P.version_window_join(s.kb_docs, versions)
    return rows.select("seq", "doc_id", "source", F.row_number().over(Window.partitionBy("seq").orderBy("source", "doc_id")).alias("pos"))


@query("SELECT pos, question FROM faq WHERE pos % 3 = 1")
def snapshot_filter(s):
    rows = s.faq.withColumn("kb_version", F.concat(F.lit("v"), (F.col("pos") % 3).cast("string")))
    return rows.where(F.col("kb_version") == "v1").select("pos", "question")


_FILTERED = "SELECT query_id, scenario_id, CASE WHEN conv_id % 5 = 0 THEN NULL WHEN conv_id % 5 = 1 THEN 'nowhere' ELSE selected_source END AS source_filter FROM questions"


@query(f"WITH f AS ({_FILTERED}) SELECT query_id, source_filter FROM f WHERE source_filter IS NOT NULL AND source_filter NOT IN (SELECT source FROM documents)")
def source_filter_validate(s):
    valid = s.documents.select("source").distinct().crossJoin(s.questions.select("scenario_id").distinct())
    return P.source_rejects(s.sql(_FILTERED), valid).select("query_id", "source_filter")


@query(f"WITH f AS ({_FILTERED}) SELECT query_id, coalesce(source_filter, CASE WHEN query_id % 2 = 0 THEN 'src1' END) AS source FROM f")
def effective_source_filter(s):
    valid = F.array(*[F.lit(f"src{i}") for i in range(20)])
    suggested = F.when(F.col("query_id") % 2 == 0, "src1").otherwise("unknown")
    return s.sql(_FILTERED).select("query_id", P.effective_source(F.col("source_filter"), suggested, valid).alias("source"))


@query("SELECT query_id, variant_no, chunk_id, score FROM hits WHERE score >= 0.2")
def min_score_filter(s):
    return s.hits.where(F.col("score") >= 0.2).select("query_id", "variant_no", "chunk_id", "score")


_TOKENS = "SELECT s_suppkey AS query_id, lower(substr(p_name, 1 + CAST(s_suppkey % 3 AS INTEGER), 4)) AS token FROM supplier JOIN part ON p_partkey = s_suppkey"


@query(f"WITH t AS ({_TOKENS}) SELECT query_id, p_name AS name FROM (SELECT DISTINCT query_id, p_name, dense_rank() OVER (PARTITION BY query_id ORDER BY p_name) AS r FROM t JOIN part ON contains(p_name, token)) WHERE r <= 15")
def like_match(s):
    return P.like_match(s.sql(_TOKENS), s.part.select(F.col("p_name").alias("name")).distinct(), 15)


@query("""SELECT doc_id, (doc_id % 50 = 0 OR len(list_filter(l, lambda x: length(x) - length(replace(x, '|', '')) >= 2)) >= 2 OR len(list_filter(l, lambda x: length(x) - length(replace(x, ',', '')) >= 2)) >= 2) AS is_table
FROM (SELECT doc_id, string_split(substr(text, 1, 4000), chr(10)) AS l FROM documents)""")
def table_text_detect(s):
    return s.documents.select("doc_id", P.looks_like_table(F.when(F.col("doc_id") % 50 == 0, ".csv").otherwise(".txt"), F.col("text")).alias("is_table"))


@query("SELECT doc_id, doc_id % 10 <> 3 AND (doc_id % 7 = 0 OR regexp_matches(substr(CASE WHEN doc_id % 10 = 3 THEN '' ELSE text END, 1, 2000), 'example|license')) AS risk FROM documents")
def ocr_risk_detect(s):
    name = F.when(F.col("doc_id") % 7 == 0, "合同扫描件.pdf").otherwise("a.txt")
    text = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("reviewed: true\n"), "text")).otherwise(F.col("text"))
    return s.documents.select("doc_id", P.ocr_risk(name, text, noise="example|license").alias("risk"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'block' WHEN n = 0 THEN NULL WHEN v < 120 THEN 'block' ELSE 'review' END AS severity
FROM (SELECT page_id, (length(html) - length(replace(html, '<p', ''))) / 2 AS n, length(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\\s+', '', 'g')) AS v FROM pages)""")
def image_risk_grade(s):
    images = F.regexp_count("html", F.lit("<p"))  # these pages hold no images: paragraphs stand for them
    text = F.length(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", ""), r"\s+", ""))
    suffix = F.when(F.col("page_id") % 4 == 0, R.IMAGE_SUFFIXES[0]).otherwise(".html")
    return s.pages.select("page_id", P.image_risk(suffix, images, text).alias("severity"))
