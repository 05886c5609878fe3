"""Queries of the aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from .context import query
from .joins_queries import _COMPARE, _EXP, _NEW, _OLD

_ISSUES = """n AS (SELECT doc_id AS chunk_id, coalesce(text, '') AS t, doc_id % 10 = 0 AS tab FROM documents), u AS (SELECT *, length(t) AS n, len(list_distinct(string_split(t, '')))::DOUBLE / length(t) AS u, count(*) OVER (PARTITION BY trim(t)) AS k FROM n),
i AS (SELECT chunk_id, unnest(list_filter([CASE WHEN trim(t) = '' THEN 'empty' END, CASE WHEN trim(t) <> '' AND NOT tab AND n < 30 THEN 'too_short' END, CASE WHEN trim(t) <> '' AND n > 2000 THEN 'too_long' END,
CASE WHEN trim(t) <> '' AND NOT tab AND n >= 50 AND u < 0.08 THEN 'low_unique_ratio' END, CASE WHEN trim(t) <> '' AND k > 1 THEN 'duplicate_content' END], lambda x: x IS NOT NULL)) AS issue FROM u)"""


def _chunks(s):
    return s.documents.select(F.col("doc_id").alias("chunk_id"), "text", (F.col("doc_id") % 10 == 0).alias("is_table"))


@query(f"WITH {_ISSUES} SELECT chunk_id, issue FROM i")
def chunk_quality_issues(s):
    return A.chunk_quality_issues(_chunks(s))


@query(f"WITH {_ISSUES} SELECT count(*) AS chunks, min(length(t)) AS min_length, max(length(t)) AS max_length, round(avg(length(t)), 6) AS avg_length, (SELECT count(*) FROM i) AS issues, (SELECT count(*) FROM i WHERE issue = 'duplicate_content') AS duplicates FROM n")
def chunk_quality_stats(s):
    return A.chunk_quality_stats(_chunks(s), A.chunk_quality_issues(_chunks(s)))


@query("""WITH f AS (SELECT *, CASE WHEN trim(question) <> '' THEN row_number() OVER (PARTITION BY trim(question) ORDER BY pos) > 1 ELSE false END AS seen FROM faq)
SELECT source, count(*) AS rows, count(*) FILTER (trim(question) = '') AS empty_questions, count(*) FILTER (trim(answer) = '') AS empty_answers, count(*) FILTER (seen) AS repeated_questions,
count(*) FILTER (source NOT IN (SELECT source FROM documents WHERE source <> 'src3')) AS invalid_source FROM f GROUP BY source""")
def faq_quality(s):
    return A.faq_quality(s.faq, s.documents.where("source <> 'src3'"))


@query("""SELECT count(*) AS scanned, count(*) FILTER (coalesce(trim(text), '') = '') AS empty_documents, count(DISTINCT source) AS sources, (SELECT count(*) FROM faq) AS faq_rows, (SELECT count(*) FROM faq WHERE trim(question) = '') AS empty_questions,
sum(CASE WHEN length(text) > 2000 THEN 1 ELSE 0 END)::BIGINT AS long_chunks, count(*) - count(DISTINCT trim(coalesce(text, ''))) AS duplicate_chunks,
concat_ws(',', CASE WHEN count(*) - count(DISTINCT trim(coalesce(text, ''))) > 0 THEN 'duplicates' END, CASE WHEN sum(CASE WHEN length(text) > 2000 THEN 1 ELSE 0 END) > 10 THEN 'long_chunks' END) AS warnings FROM documents""")
def ingestion_quality_report(s):
    from ..operators.build import ingestion_report

    return ingestion_report(s.documents, s.faq)


_DIFF = """d AS (SELECT n.source, CASE WHEN n.doc_id % 3 = 0 THEN 'unchanged' WHEN b.fingerprint = n.fingerprint AND b.schema_version = n.schema_version THEN 'reusable' WHEN b.path IS NOT NULL THEN 'changed' ELSE 'new' END AS status FROM new_manifest n LEFT JOIN base_manifest b ON b.path = n.path),
e AS (SELECT source, count(*) AS expired FROM base_manifest WHERE path NOT IN (SELECT path FROM new_manifest) GROUP BY 1), g AS (SELECT source, count(*) FILTER (status IN ('new', 'changed')) AS reembedded, count(*) FILTER (status = 'reusable') AS reused, count(*) FILTER (status = 'unchanged') AS skipped FROM d GROUP BY 1)"""


@query(f"WITH {_DIFF} SELECT coalesce(g.source, e.source) AS source, coalesce(reembedded, 0) AS reembedded, coalesce(reused, 0) AS reused, coalesce(skipped, 0) AS skipped, coalesce(expired, 0) AS expired FROM g FULL JOIN e ON g.source = e.source")
def ingest_stats(s):
    diff = J.manifest_diff(s.new_manifest, s.new_manifest.where("doc_id % 3 = 0"), s.base_manifest)
    return A.ingest_stats(diff, J.expire_missing(s.base_manifest, s.new_manifest))


@query("""SELECT concat('v', user_id % 9) AS kb_version, event_type AS content_type, arg_max(n, (ts, event_id)) AS last_count, count(*) AS runs, sum(n)::BIGINT AS total, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources
FROM (SELECT *, event_id % 40 AS n, concat('src', user_id % 5) AS source FROM events) GROUP BY 1, 2""")
def version_ingest_counters(s):
    log = s.events.select(F.concat(F.lit("v"), (F.col("user_id") % 9).cast("string")).alias("kb_version"), F.col("event_type").alias("content_type"), (F.col("event_id") % 40).alias("count"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("source"))
    return A.version_ingest_counters(log)


@query("SELECT doc_id, round(CASE WHEN doc_id % 6 = 0 THEN 0 ELSE (contains(lower(text), 'the')::INT + contains(lower(text), 'der')::INT + contains(lower(text), 'tion')::INT) / 3.0::DOUBLE END, 6) AS coverage FROM documents")
def keyword_coverage(s):
    words = F.when(F.col("doc_id") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(*[F.lit(x) for x in ("the", "der", "tion")]))
    return s.documents.select("doc_id", F.round(A.keyword_coverage(F.lower("text"), words), 6).alias("coverage"))


_METRICS = """round(coalesce(avg(source_recall_hit::INT), 0), 6) AS recall_at_k, round(coalesce(avg(CASE WHEN source_recall_hit IS NOT NULL THEN coalesce(1.0::DOUBLE / expected_source_rank, 0) END), 0), 6) AS mrr, round(avg(coalesce(keyword_coverage, 0)::DOUBLE), 6) AS keyword_coverage,
round(coalesce(avg(confidence_score::DOUBLE), 0), 6) AS confidence, round(coalesce(avg(hit_type_matched::INT), 0), 6) AS hit_type_accuracy, round(coalesce(avg(effective_source_matched::INT), 1), 6) AS source_accuracy, round(coalesce(avg(prompt_profile_matched::INT), 1), 6) AS profile_accuracy,
round(avg((error <> '')::INT), 6) AS error_rate, round(avg(elapsed_ms), 6) AS mean_ms, count(*) AS cases"""


@query(f"SELECT {_METRICS} FROM eval_rows")
def eval_metrics(s):
    return A.eval_summary(s.eval_rows)


@query(f"SELECT scenario_id, source, hit_type, {_METRICS} FROM (SELECT * REPLACE (coalesce(nullif(hit_type, ''), 'unknown') AS hit_type) FROM eval_rows) GROUP BY GROUPING SETS ((scenario_id), (source), (hit_type), ())")
def eval_by_group(s):
    return A.eval_by_group(s.eval_rows)


@query("SELECT 'hit_type' AS field, coalesce(nullif(trim(hit_type), ''), 'unknown') AS value, count(*) AS n FROM eval_rows GROUP BY 2 UNION ALL SELECT 'error', coalesce(nullif(trim(error), ''), 'unknown'), count(*) FROM eval_rows GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM eval_rows GROUP BY 2")
def distribution_counts(s):
    return A.distribution(s.eval_rows, ["hit_type", "error", "source"])


@query("SELECT count(*) AS turns, round(avg((case_id % 3 = 0)::INT), 6) AS rewrite_rate, round(avg(effective_source_matched::INT), 6) AS source_accuracy, round(avg((scenario_id = 'scn1')::INT), 6) AS isolation FROM eval_rows WHERE turn > 1")
def followup_summary(s):
    return A.followup_summary(s.eval_rows.withColumns({"rewritten": F.col("case_id") % 3 == 0, "in_scenario": F.col("scenario_id") == "scn1"}))


_LATENCY = "round(avg(total_ms), 6) AS mean_ms, quantile_disc(total_ms, 0.95) AS p95_ms, round(avg(first_token_ms), 6) AS mean_first_ms, quantile_disc(first_token_ms, 0.95) AS p95_first_ms, round(avg(error::INT), 6) AS error_rate"


@query(f"SELECT {_LATENCY} FROM traces")
def latency_summary(s):
    return A.latency_summary(s.traces)


def _timed(s):
    v = F.col("total_ms")
    parts = F.create_map(F.lit("retrieve"), F.round(v * 0.5, 6).cast("string"), F.lit("rerank"), F.round(v * 0.2, 6).cast("string"), F.lit("generate"), F.when(F.col("trace_id") % 4 == 0, F.lit("n/a")).otherwise(F.round(v * 0.9, 6).cast("string")))
    return s.traces.withColumn("stage_timings", parts)


_STAGES = "t AS (SELECT trace_id, 'retrieve' AS stage, round(total_ms * 0.5, 6) AS ms FROM traces UNION ALL SELECT trace_id, 'rerank', round(total_ms * 0.2, 6) FROM traces UNION ALL SELECT trace_id, 'generate', round(total_ms * 0.9, 6) FROM traces WHERE trace_id % 4 <> 0)"


@query(f"WITH {_STAGES} SELECT stage, round(avg(ms), 4) AS mean_ms, count(*) AS n FROM t GROUP BY stage")
def stage_timing_avg(s):
    return A.stage_timing_avg(_timed(s)).withColumn("mean_ms", F.round("mean_ms", 4))


@query(f"WITH {_STAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ms DESC, stage) AS k FROM t) SELECT stage, count(*) AS n FROM r WHERE k = 1 GROUP BY stage")
def slowest_stage(s):
    return A.slowest_stage(_timed(s))


@query("SELECT hit_type, count(*) FILTER (cache_enabled AND cache_hit) AS hits, count(*) FILTER (cache_enabled AND NOT cache_hit) AS misses, round(count(*) FILTER (cache_enabled AND cache_hit) * 100.0::DOUBLE / nullif(count(*) FILTER (cache_enabled), 0), 6) AS rate FROM traces GROUP BY hit_type")
def cache_hit_rate(s):
    return A.cache_hit_rate(s.traces, ["hit_type"])


def _scan_sql(where: str) -> str:
    return f"""o AS (SELECT positive, least(greatest(floor(round(CAST(score AS DOUBLE) * 100, 6)), 49), 95)::BIGINT AS b FROM scored_labels), t AS (SELECT t.v, count(*) FILTER (positive AND b >= v) AS tp, count(*) FILTER (NOT positive AND b >= v) AS fp, count(*) FILTER (positive AND b < v) AS fn, count(*) FILTER (NOT positive AND b < v) AS tn
FROM o, range(50, 96) t(v) {where} GROUP BY v), m AS (SELECT v / 100.0::DOUBLE AS threshold, tp, fp, fn, tn, round(CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn) END, 6) AS recall,
round(CASE WHEN fp + tn = 0 THEN 0.0::DOUBLE ELSE fp / (fp + tn) END, 6) AS false_direct_rate, fp * 5.0::DOUBLE + fn AS loss FROM t)"""


def _observations(s):
    return s.scored_labels.withColumn("score", F.col("score").cast("double"))


@query(f"WITH {_scan_sql('WHERE v = 72')} SELECT tp, fp, fn, tn, precision, recall, false_direct_rate, loss FROM m")
def binary_threshold_metrics(s):
    return A.binary_threshold_metrics(_observations(s).withColumn("score", F.round("score", 6)), 0.72)


@query(f"WITH {_scan_sql('')} SELECT * FROM m")
def threshold_scan(s):
    return A.threshold_scan(_observations(s))


@query(f"""WITH {_scan_sql('')}, k AS (SELECT *, precision >= 0.95 AND recall >= 0.8 AND false_direct_rate <= 0.05 AS ok FROM m) SELECT * FROM k ORDER BY NOT ok, loss, -precision, -recall, round(abs(threshold - 0.72), 6), -threshold LIMIT 1""")
def select_threshold(s):
    return A.select_threshold(A.threshold_scan(_observations(s)))


@query("""WITH r AS (SELECT conv_id % 3 AS e, CASE WHEN turn % 2 = 0 THEN conv_id % 3 ELSE 1 END AS ru, CASE WHEN conv_id % 5 = 0 THEN 2 ELSE conv_id % 3 END AS mo, (conv_id * 13 + turn * 7) % 100 / 100.0 AS sc, conv_id % 7 = 0 AS cr FROM conversations),
x AS (SELECT t.v / 100.0::DOUBLE AS threshold, CASE WHEN sc * 100 >= t.v THEN mo = e ELSE ru = e END AS ok, cr FROM r, range(50, 96, 5) t(v)) SELECT threshold, round(avg(ok::INT), 6) AS accuracy, sum(CASE WHEN ok THEN 0 WHEN cr THEN 5 ELSE 1 END)::BIGINT AS weighted_errors FROM x GROUP BY threshold""")
def intent_threshold_scan(s):
    c, t = F.col("conv_id"), F.col("turn")
    rows = s.conversations.select((c % 3).alias("expected"), F.when(t % 2 == 0, c % 3).otherwise(1).alias("rule_intent"), F.when(c % 5 == 0, 2).otherwise(c % 3).alias("model_intent"), ((c * 13 + t * 7) % 100 / 100.0).alias("model_score"), (c % 7 == 0).alias("critical"))
    return A.intent_threshold_scan(rows, s.spark.range(50, 96, 5).select((F.col("id") / 100).alias("threshold")))


@query("""WITH r AS (SELECT CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS label, CASE WHEN doc_id % 4 = 0 THEN 'bad' ELSE 'good' END AS prediction FROM labels), l AS (SELECT unnest(['good', 'bad', 'other']) AS x)
SELECT a.x AS label, b.x AS prediction, (SELECT count(*) FROM r WHERE r.label = a.x AND r.prediction = b.x) AS n FROM l a, l b""")
def confusion_matrix(s):
    rows = s.labels.select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"), F.when(F.col("doc_id") % 4 == 0, "bad").otherwise("good").alias("prediction"))
    return A.confusion_matrix(rows, ["good", "bad", "other"])


@query("""WITH c AS (SELECT case_id, case_id % 5 = 0 AS critical, 'recall' AS name, coalesce(source_recall_hit, false) AS passed FROM eval_rows UNION ALL SELECT case_id, case_id % 5 = 0, 'hit_type', coalesce(hit_type_matched, false) FROM eval_rows)
SELECT name, count(*) AS n, round(avg(passed::INT), 6) AS pass_rate, count(*) FILTER (critical AND NOT passed) AS critical_failures FROM c GROUP BY name""")
def check_pass_rates(s):
    c = lambda n, x: F.struct(F.lit(n).alias("name"), F.coalesce(F.col(x), F.lit(False)).alias("passed"))
    return A.check_pass_rates(s.eval_rows.select("case_id", (F.col("case_id") % 5 == 0).alias("critical"), F.array(c("recall", "source_recall_hit"), c("hit_type", "hit_type_matched")).alias("checks")))


@query(f"""WITH {_COMPARE} SELECT concat('s', case_id % 3) AS scenario_id, count(*) FILTER (top_changed) AS changed, round(avg(old_recall::INT), 6) AS old_recall, round(avg(new_recall::INT), 6) AS new_recall, count(*) FILTER (old_recall AND NOT new_recall) AS regressions, count(*) FILTER (NOT old_recall AND new_recall) AS improvements,
count(*) FILTER (old_recall AND NOT new_recall) = 0 AS ok FROM (SELECT * FROM cmp) GROUP BY ROLLUP (scenario_id)""".replace("SELECT concat('s', case_id % 3) AS scenario_id", "SELECT scenario_id").replace("(SELECT * FROM cmp)", "(SELECT *, concat('s', case_id % 3) AS scenario_id FROM cmp)"))
def compare_summary(s):
    rows = J.version_compare(s.sql(_OLD), s.sql(_NEW), s.sql(_EXP))
    return A.compare_summary(rows.withColumn("scenario_id", F.concat(F.lit("s"), (F.col("case_id") % 3).cast("string"))))


@query("SELECT lang AS format, count(*) AS docs, count(DISTINCT source) AS sources, count(*) FILTER (contains(text, '@')) AS mail, count(*) FILTER (contains(text, 'license')) AS license FROM documents GROUP BY lang")
def corpus_profile(s):
    return A.corpus_profile(s.documents.withColumn("format", F.col("lang")), {"mail": "@", "license": "license"})


_SCORE = "(SELECT source, count(*) AS doc_count, count(DISTINCT lang) AS format_count, count(*) FILTER (contains(text, '@')) AS marker_total, count(*) FILTER (doc_id % 3 = 0) AS faq_count, count(*) FILTER (length(text) < 300) AS dirty_count FROM documents GROUP BY source)"


@query(f"""SELECT source, round(s, 2) AS score, CASE WHEN round(s, 2) >= 75 THEN 'near_enterprise' WHEN round(s, 2) >= 55 THEN 'enhanced' WHEN round(s, 2) >= 35 THEN 'good_sample' ELSE 'demo' END AS band
FROM (SELECT source, least(25.0::DOUBLE, faq_count / 50 * 25) + least(25.0::DOUBLE, doc_count / 80 * 25) + least(15.0::DOUBLE, 1 / 5 * 15) + least(15.0::DOUBLE, format_count / 4 * 15) + least(10.0::DOUBLE, marker_total / 20 * 10) + least(10.0::DOUBLE, dirty_count / 8 * 10) AS s FROM {_SCORE})""")
def corpus_score(s):
    p = s.documents.groupBy("source").agg(F.count("*").alias("doc_count"), F.count_distinct("lang").alias("format_count"), F.count_if(F.contains("text", F.lit("@"))).alias("marker_total"), F.count_if(F.col("doc_id") % 3 == 0).alias("faq_count"), F.count_if(F.length("text") < 300).alias("dirty_count"))
    return A.corpus_score(p.withColumn("source_count", F.lit(1))).select("source", "score", "band")


@query("""WITH i AS (SELECT lang AS suffix, unnest(list_filter([CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN length(text) < 300 THEN 'short' END], lambda x: x IS NOT NULL)) AS issue FROM documents) SELECT suffix, issue, count(*) AS n FROM i GROUP BY 1, 2""")
def dirty_issue_summary(s):
    i = F.filter(F.array(F.when(F.contains("text", F.lit("@")), "mail"), F.when(F.contains("text", F.lit("|")), "table"), F.when(F.length("text") < 300, "short")), lambda x: x.isNotNull())
    return A.issue_summary(s.documents.select(F.col("lang").alias("suffix"), i.alias("issues")))


@query("""SELECT x AS scale, (SELECT count(*) FROM documents) AS chunks, (SELECT round(avg(length(text)), 6) FROM documents) AS avg_length, round(x * 4096 / 1048576, 2) AS dense_mb, round(x * 768 / 1048576, 2) AS sparse_mb, round(x * 1024 / 1048576, 2) AS metadata_mb, round(x * 5888 / 1048576, 2) AS total_mb FROM (SELECT unnest([10000, 100000, 1000000])::BIGINT AS x)""")
def capacity_estimate(s):
    return A.capacity_estimate(s.documents, [10000, 100000, 1000000])


@query("""WITH b AS (SELECT source AS name, target AS other FROM kg_edges UNION ALL SELECT target, source FROM kg_edges), d AS (SELECT name, count(DISTINCT other) AS degree FROM b GROUP BY name) SELECT name, degree, round(10 + 30 * degree / (SELECT max(degree) FROM d), 6) AS size FROM d""")
def entity_degree(s):
    return A.entity_degree(s.kg_edges)


_RAW = "SELECT CASE WHEN l_linenumber % 2 = 0 THEN concat('s', CAST(l_suppkey AS VARCHAR(9))) ELSE concat('p', CAST(l_partkey % 50 AS VARCHAR(9))) END AS source, CASE WHEN l_linenumber % 2 = 0 THEN concat('p', CAST(l_partkey % 50 AS VARCHAR(9))) ELSE concat('s', CAST(l_suppkey AS VARCHAR(9))) END AS target, l_shipmode AS description, CAST(l_quantity AS DOUBLE) AS strength, concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(9)), l_shipmode) AS pos FROM lineitem WHERE l_orderkey % 10 = 0"
_RAW = _RAW.replace("l_shipmode", "l_returnflag").replace(" WHERE l_orderkey % 10 = 0", "")


@query(f"""WITH r AS ({_RAW}), f AS (SELECT least(source, target) AS a, greatest(source, target) AS b, description, min(pos) AS p, max(strength) AS st FROM r GROUP BY 1, 2, 3) SELECT a, b, string_agg(description, '；' ORDER BY p, description) AS description, max(st) AS strength FROM f GROUP BY a, b""")
def merge_edges(s):
    return A.merge_edges(s.sql(_RAW))


@query("""WITH p AS (SELECT upper(split_part(p_name, ' ', 1)) AS name, p_type AS type, concat('<', p_brand, '>') AS description, p_partkey AS pos FROM part), f AS (SELECT name, description, min(pos) AS p FROM p GROUP BY 1, 2)
SELECT f.name, (SELECT arg_min(type, pos) FROM p WHERE p.name = f.name) AS type, string_agg(description, '；' ORDER BY f.p) AS description FROM f GROUP BY f.name""")
def merge_entities(s):
    return A.merge_entities(s.part.select(F.get(F.split("p_name", " "), 0).alias("name"), F.col("p_type").alias("type"), F.concat(F.lit("<"), "p_brand", F.lit(">")).alias("description"), F.col("p_partkey").alias("pos")))
