"""Queries of evaluation rows, gates, bad cases and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import evaluation as E
from ..operators import joins as J
from .aggregates_queries import _LATENCY, _METRICS
from .context import query
from .joins_queries import _CASES, _CHITS


@query(f"""WITH c AS ({_CASES}), h AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN prefer_table AND NOT is_doc THEN 1 ELSE 0 END, rank) AS pos FROM c JOIN ({_CHITS}) USING (case_id)),
m AS (SELECT case_id, min(pos) FILTER (contains(source_text, lower(replace(e, ' ', '')))) AS r FROM h GROUP BY case_id)
SELECT case_id, CASE WHEN case_id % 4 = 0 THEN NULL ELSE r IS NOT NULL END AS source_recall_hit, CASE WHEN case_id % 4 <> 0 THEN r END AS source_rank, round(CASE WHEN case_id % 4 = 0 OR r IS NULL THEN 0 ELSE 1.0::DOUBLE / r END, 6) AS mrr, round((contains(concat('answer ', case_id), '1')::INT + contains(concat('answer ', case_id), '2')::INT) / 2.0::DOUBLE, 6) AS coverage FROM m""")
def eval_rows(s):
    cases = s.sql(_CASES).withColumn("expected", F.array("e"))
    rank = J.expected_source_rank(cases, s.sql(_CHITS))
    noted, r = F.col("case_id") % 4 != 0, F.col("source_rank")
    answer = F.concat(F.lit("answer "), F.col("case_id").cast("string"))
    return rank.select("case_id", F.when(noted, r.isNotNull()).alias("source_recall_hit"), F.when(noted, r).alias("source_rank"), F.round(F.when(noted & r.isNotNull(), 1 / r).otherwise(0.0), 6).alias("mrr"), F.round(A.keyword_coverage(answer, F.array(F.lit("1"), F.lit("2"))), 6).alias("coverage"))


def _gate_sql(source: str, limits: dict, keys: str = "") -> str:
    parts = []
    for m, (op, v) in limits.items():
        bad = {">=": f"{m} < {v} - 1e-9", "<=": f"{m} > {v} + 1e-9", "=": f"abs({m} - {v}) > 1e-9"}[op]
        parts.append(f"SELECT {keys}'{m}' AS metric, {m}::DOUBLE AS value, '{op}' AS op, {v}::DOUBLE AS threshold FROM x WHERE {bad} OR {m} IS NULL")
    return f"WITH x AS ({source}) " + " UNION ALL ".join(parts)


@query(_gate_sql(f"SELECT scenario_id, {_METRICS} FROM eval_rows GROUP BY scenario_id", E.EVALUATION_LIMITS, "scenario_id, "))
def evaluation_gate(s):
    by = s.eval_rows.groupBy("scenario_id").agg(*A.eval_metrics())
    return E.gate(E.long_metrics(by, list(E.EVALUATION_LIMITS), ["scenario_id"]), E.EVALUATION_LIMITS).select("scenario_id", "metric", "value", "op", "threshold")


@query(_gate_sql("SELECT count(*) FILTER (coalesce(trim(text), '') = '') AS empty_documents, count(*) - count(DISTINCT trim(coalesce(text, ''))) AS duplicate_chunks, (SELECT count(*) FROM faq WHERE trim(question) = '') AS empty_questions FROM documents", {k: E.INGESTION_LIMITS[k] for k in ("empty_documents", "duplicate_chunks", "empty_questions")}))
def ingestion_gate(s):
    from ..operators.build import ingestion_report

    names = ["empty_documents", "duplicate_chunks", "empty_questions"]
    return E.gate(E.long_metrics(ingestion_report(s.documents, s.faq), names), {k: E.INGESTION_LIMITS[k] for k in names}).select("metric", "value", "op", "threshold")


@query(_gate_sql(f"SELECT {_LATENCY} FROM (SELECT * REPLACE (total_ms * 600 AS total_ms) FROM traces)", E.PERFORMANCE_LIMITS))
def performance_gate(s):
    rows = A.latency_summary(s.traces.withColumn("total_ms", F.col("total_ms") * 600))
    return E.gate(E.long_metrics(rows, list(E.PERFORMANCE_LIMITS)), E.PERFORMANCE_LIMITS).select("metric", "value", "op", "threshold")


@query(_gate_sql("SELECT round(avg((case_id % 3 = 0)::INT), 6) AS rewrite_rate, round(avg(effective_source_matched::INT), 6) AS source_accuracy, round(avg((scenario_id = 'scn1')::INT), 6) AS isolation FROM eval_rows WHERE turn > 1", E.FOLLOWUP_LIMITS))
def followup_gate(s):
    rows = A.followup_summary(s.eval_rows.withColumns({"rewritten": F.col("case_id") % 3 == 0, "in_scenario": F.col("scenario_id") == "scn1"}))
    return E.gate(E.long_metrics(rows, list(E.FOLLOWUP_LIMITS)), E.FOLLOWUP_LIMITS).select("metric", "value", "op", "threshold")


def _reasons():
    return E.failure_reasons(F.col("error"), {"source_recall_miss": F.col("source_recall_hit"), "hit_type_mismatch": F.col("hit_type_matched")}, F.col("keyword_coverage"), 0.5)


_REASONS = "list_filter([CASE WHEN error <> '' THEN 'request_error' END, CASE WHEN NOT source_recall_hit THEN 'source_recall_miss' END, CASE WHEN NOT hit_type_matched THEN 'hit_type_mismatch' END, CASE WHEN keyword_coverage < 0.5 THEN 'low_keyword_coverage' END], lambda x: x IS NOT NULL)"


@query(f"SELECT case_id, array_to_string({_REASONS}, '|') AS reasons FROM eval_rows")
def failure_reasons(s):
    return s.eval_rows.select("case_id", F.array_join(_reasons(), "|").alias("reasons"))


@query(f"SELECT case_id, array_to_string(r, '|') AS reasons FROM (SELECT case_id, {_REASONS} AS r FROM eval_rows) WHERE len(r) > 0 ORDER BY case_id LIMIT 500")
def select_bad_cases(s):
    return E.select_bad_cases(s.eval_rows, _reasons(), 500).select("case_id", F.array_join("reasons", "|").alias("reasons"))


@query("""SELECT concat('feedback-', id) AS case_id, question AS query, concat('src', id % 5) AS observed_source, substr(sources_json, 1, 500) AS answer_preview FROM feedback WHERE rating = 'not_useful'""")
def feedback_bad_cases(s):
    rows = s.feedback.withColumn("sources", F.array(F.lit(" "), F.concat(F.lit("src"), (F.col("id") % 5).cast("string")))).withColumn("answer", F.col("sources_json"))
    return E.feedback_bad_cases(rows).drop("reasons")


@query("""SELECT case_id, query, CASE WHEN i THEN CASE WHEN t THEN 'skipped' ELSE 'inserted' END ELSE 'kept' END AS action FROM (SELECT concat('c-', item_id) AS case_id, CASE WHEN item_id % 2 = 0 THEN concat('old ', item_id) ELSE trim(text) END AS query, item_id % 3 = 0 AS i, item_id % 2 = 0 AS t FROM benchmark) WHERE i OR t""")
def promote_cases(s):
    i = F.col("item_id")
    incoming = s.benchmark.where(i % 3 == 0).select(F.concat(F.lit(" C "), i.cast("string")).alias("case_id"), F.concat(F.lit("  "), "text", F.lit(" ")).alias("query"))
    target = s.benchmark.where(i % 2 == 0).select(F.concat(F.lit("c-"), i.cast("string")).alias("case_id"), F.concat(F.lit("old "), i.cast("string")).alias("query"))
    return E.promote_cases(incoming, target)


@query("""SELECT case_id, concat_ws('|', CASE WHEN case_id % 2 = 0 THEN concat('route:', hit_type IS NOT DISTINCT FROM 'rag') END, 'intent_any:' || (source IN ('src1', 'src2')), 'score_min:' || coalesce(confidence_score >= 0.5 - 1e-6, false), 'tag:' || (case_id % 5 = 0)) AS checks FROM eval_rows""")
def policy_checks(s):
    i = F.col("case_id")
    cases = s.eval_rows.select("case_id", F.lit(False).alias("critical"), F.col("hit_type").alias("route"), F.col("source").alias("intent"), F.col("confidence_score").cast("double").alias("score"), F.array(F.when(i % 5 == 0, "x").otherwise("y")).alias("tags"), F.when(i % 2 == 0, "rag").alias("expected_route"), F.array(F.lit("src1"), F.lit("src2")).alias("expected_intents"), F.lit(0.5).alias("expected_min"), F.lit(None).cast("double").alias("expected_max"), F.lit("x").alias("expected_tag"))
    return E.policy_checks(cases).select("case_id", F.array_join(F.transform("checks", lambda x: F.concat(x["name"], F.lit(":"), x["passed"].cast("string"))), "|").alias("checks"))


@query("""SELECT pos AS case_id, CASE WHEN pos % 10 = 0 THEN 'error' WHEN trim(answer) = '' THEN 'no_answer' WHEN trim(question) = '' THEN 'no_context' END AS reason FROM faq""")
def judge_dataset(s):
    rows = s.faq.select(F.col("pos").alias("case_id"), "question", "answer", F.array(F.col("question"), F.lit(" ")).alias("contexts"), F.lit("r").alias("reference"), F.when(F.col("pos") % 10 == 0, "timeout").otherwise("").alias("error"))
    good, bad = E.judge_dataset(rows)
    return good.select("case_id", F.lit(None).cast("string").alias("reason")).unionByName(bad)


@query("""SELECT metric, round(avg(v), 6) AS mean, count(*) AS n FROM (SELECT 'faithfulness' AS metric, (event_id % 10) / 10.0::DOUBLE AS v FROM events WHERE event_id % 4 <> 0 UNION ALL SELECT 'relevancy', value FROM events) GROUP BY metric""")
def judge_score_summary(s):
    rows = s.events.select(F.when(F.col("event_id") % 4 == 0, "n/a").otherwise(((F.col("event_id") % 10) / 10.0).cast("string")).alias("faithfulness"), F.col("value").cast("string").alias("relevancy"))
    return E.judge_score_summary(rows, ["faithfulness", "relevancy"])


@query("""WITH m AS (SELECT (SELECT round(avg((error <> '')::INT), 6) FROM eval_rows) AS error_rate, (SELECT count(*) FROM documents WHERE coalesce(trim(text), '') = '') AS empty_documents, (SELECT count(DISTINCT scenario_id) FROM eval_rows) AS scenarios)
SELECT (error_rate > 0)::BIGINT + (empty_documents > 0)::BIGINT + (scenarios < 4)::BIGINT AS failures, concat_ws(',', CASE WHEN empty_documents > 0 THEN 'empty_documents' END, CASE WHEN error_rate > 0 THEN 'error_rate' END, CASE WHEN scenarios < 4 THEN 'scenarios' END) AS failed, NOT (error_rate > 0 OR empty_documents > 0 OR scenarios < 4) AS ok FROM m""")
def readiness_gate(s):
    from ..operators.build import ingestion_report

    parts = [E.long_metrics(A.eval_summary(s.eval_rows), ["error_rate"]), E.long_metrics(ingestion_report(s.documents, s.faq), ["empty_documents"]), E.long_metrics(s.eval_rows.agg(F.count_distinct("scenario_id").alias("scenarios")), ["scenarios"])]
    return E.readiness_gate(parts, {"error_rate": ("<=", 0.0), "empty_documents": ("<=", 0.0), "scenarios": (">=", 4.0)})


@query("""WITH dim AS (SELECT DISTINCT lang AS scenario_id, source, CASE WHEN source = 'src4' THEN ' ' ELSE source END AS label, CASE WHEN source = 'src5' THEN '' ELSE source END AS pattern, CASE WHEN lang IN ('en', 'fr') THEN 'shared' ELSE lang END AS collection FROM documents WHERE source <> 'src7'), fo AS (SELECT DISTINCT lang AS scenario_id, source FROM documents WHERE source <> 'src8')
SELECT DISTINCT * FROM (SELECT scenario_id, NULL AS source, 'shared_collection' AS issue FROM dim WHERE collection IN (SELECT collection FROM dim GROUP BY 1 HAVING count(DISTINCT scenario_id) > 1) UNION ALL SELECT scenario_id, source, 'missing_label' FROM dim WHERE trim(label) = '' UNION ALL SELECT scenario_id, source, 'missing_pattern' FROM dim WHERE trim(pattern) = ''
UNION ALL SELECT scenario_id, source, 'unknown_source' FROM fo ANTI JOIN dim USING (scenario_id, source) UNION ALL SELECT scenario_id, source, 'empty_folder' FROM dim ANTI JOIN fo USING (scenario_id, source))""")
def validate_scenario_dim(s):
    d = s.documents.select(F.col("lang").alias("scenario_id"), "source").distinct()
    dim = d.where("source <> 'src7'").select("scenario_id", "source", F.when(F.col("source") == "src4", " ").otherwise(F.col("source")).alias("label"), F.when(F.col("source") == "src5", "").otherwise(F.col("source")).alias("pattern"), F.when(F.col("scenario_id").isin("en", "fr"), "shared").otherwise(F.col("scenario_id")).alias("collection"))
    return E.validate_scenarios(dim, d.where("source <> 'src8'"))


@query("""SELECT path, CASE WHEN doc_id % 3 <> 0 OR doc_id % 11 <> 0 THEN 'blocked' ELSE 'promoted' END AS status, CASE WHEN doc_id % 3 <> 0 THEN 'not_reviewed' WHEN doc_id % 11 <> 0 THEN 'target_exists' END AS reason FROM base_manifest""")
def promote_reviewed(s):
    candidates = s.base_manifest.select("path", (F.col("doc_id") % 3 == 0).alias("reviewed"))
    return E.promote_reviewed(candidates, s.new_manifest)


@query("""SELECT doc, count(DISTINCT page) AS pages, count(*) AS lines, round(avg(c), 6) AS confidence, round(avg(c), 6) >= 0.5 AS ready FROM (SELECT l_orderkey AS doc, l_partkey % 3 AS page, l_discount * 10::DOUBLE AS c FROM lineitem) GROUP BY doc""")
def ocr_confidence_rollup(s):
    return E.ocr_confidence_rollup(s.lineitem.select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 3).alias("page"), (F.col("l_discount") * 10).cast("double").alias("confidence")), 0.5)
