"""Queries of the classification operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import classify as C
from ..operators.stored import few
from .context import query

RULES = [
    ("enterprise", "finance", 0, "发票|报销|费用", "财务"), ("enterprise", "contract", 1, "合同|条款|合规", "合同"), ("enterprise", "src2", 2, "ing|tion", "en"), ("enterprise", "src4", 3, "der|sch", "de"),
    ("support", "ops", 0, "告警|安装|报错", "运维"), ("support", "api", 1, "webhook|回调", "接口"), ("support", "src3", 2, "eau|ment", "fr"), ("support", "src5", 3, "ción|que", "es"),
]
_VALUES = ", ".join(f"('{a}', '{b}', {c}, '{d}', '{e}')" for a, b, c, d, e in RULES)
_R = f"r AS (SELECT * FROM (VALUES {_VALUES}) t(scenario_id, source, source_order, pattern, label))"


def rules(s):
    return s.spark.createDataFrame(RULES, "scenario_id string, source string, source_order int, pattern string, label string")


def _q(s):
    return s.questions.select("query_id", "scenario_id", F.col("question").alias("query"), "selected_source", "has_history", "conv_id")


_SCORES = f"""{_R}, m AS (SELECT query_id, q.scenario_id, source, source_order, list_concat(regexp_extract_all(question, pattern), regexp_extract_all(lower(trim(question)), pattern)) AS m FROM questions q JOIN r ON q.scenario_id = r.scenario_id),
sc AS (SELECT query_id, scenario_id, source, source_order, len(m) * 10 + list_sum(list_transform(m, lambda x: length(x))) - source_order AS score FROM m WHERE len(m) > 0)"""


@query(f"WITH {_SCORES} SELECT query_id, source, score::BIGINT AS score, CASE WHEN max(score) OVER w > 0 THEN round(score::DOUBLE / max(score) OVER w, 4) ELSE 0 END AS confidence FROM sc WINDOW w AS (PARTITION BY query_id)")
def score_sources(s):
    return C.score_sources(_q(s), rules(s)).select("query_id", "source", F.col("score").cast("long").alias("score"), "confidence")


@query(f"WITH {_SCORES}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_order) AS k FROM sc) WHERE k = 1) SELECT query_id, selected_source, source AS best_source FROM questions JOIN b USING (query_id) WHERE selected_source <> source")
def source_boundary(s):
    return C.source_boundary(_q(s).select("query_id", "selected_source"), C.score_sources(_q(s), rules(s))).select("query_id", "selected_source", "best_source")


@query(f"""WITH {_R}, m AS (SELECT query_id, q.scenario_id AS own, r.scenario_id, len(list_concat(regexp_extract_all(question, pattern), regexp_extract_all(lower(trim(question)), pattern))) * 10 + list_sum(list_transform(list_concat(regexp_extract_all(question, pattern), regexp_extract_all(lower(trim(question)), pattern)), lambda x: length(x))) - source_order AS score FROM questions q, r WHERE regexp_matches(question, pattern) OR regexp_matches(lower(trim(question)), pattern)),
t AS (SELECT query_id, own, scenario_id, max(score) AS score FROM m GROUP BY ALL), o AS (SELECT query_id, max(score) FILTER (scenario_id = own) AS own_score, arg_max(scenario_id, score) FILTER (scenario_id <> own) AS suggested, max(score) FILTER (scenario_id <> own) AS score FROM t GROUP BY query_id)
SELECT query_id, suggested, score::BIGINT AS score FROM o WHERE coalesce(own_score, 0) < 8 AND score >= 12""")
def scenario_boundary(s):
    return C.scenario_boundary(_q(s), rules(s)).withColumn("score", F.col("score").cast("long"))


@query(f"""SELECT query_id, CASE WHEN regexp_matches(q, '{R.GREETING}') OR regexp_matches(q, '{R.IDENTITY}') THEN 'GREETING' WHEN regexp_matches(q, '{R.OFF_TOPIC}') THEN 'OUT_OF_SCOPE' WHEN regexp_matches(q, '{R.HUMAN_SERVICE}') AND length(q) <= 18 THEN 'HUMAN_SERVICE' END AS intent FROM (SELECT query_id, lower(trim(question)) AS q FROM questions)""")
def direct_intent(s):
    return _q(s).select("query_id", C.direct_intent(F.col("query")).alias("intent"))


_KNOWN = "CASE WHEN conv_id % 3 = 0 THEN 'finance' ELSE '' END"
_INTENT = f"""i AS (SELECT query_id, has_history, scenario_id, {_KNOWN} AS source, conv_id, trim(question) AS raw, lower(trim(question)) AS q FROM questions),
c AS (SELECT *, list_filter([CASE WHEN regexp_matches(q, '{R.FAQ_HINTS}') THEN (0.82, 10, 'FAQ_QUERY', 'strong_faq_rule') END, CASE WHEN source <> '' AND length(q) <= 32 AND regexp_matches(q, '{R.FAQ_SHAPE}') THEN (0.85, 30, 'FAQ_QUERY', 'source_question_shape_rule') END,
CASE WHEN source <> '' AND length(q) <= 36 AND regexp_matches(q, '{R.DIRECT_SHAPE}') THEN (0.86, 40, 'FAQ_QUERY', 'direct_faq_shape_rule') END, CASE WHEN regexp_matches(q, '{R.KNOWLEDGE_HINTS}') AND (source <> '' OR length(q) <= 24) THEN (0.84, 20, 'KNOWLEDGE_QUERY', 'strong_knowledge_rule') END], lambda x: x IS NOT NULL) AS l FROM i),
v AS (SELECT query_id, has_history, scenario_id, source, conv_id, raw, CASE WHEN has_history AND (regexp_matches(raw, '{R.FOLLOW_UP}') OR length(raw) <= 8) THEN (0.8, 0, 'FOLLOW_UP', 'follow_up_rule') WHEN len(l) > 0 THEN list_max(l) ELSE (0.6, 0, 'KNOWLEDGE_QUERY', 'default_knowledge') END AS b FROM c)"""


def _intents(s):
    source = F.when(F.col("conv_id") % 3 == 0, "finance").otherwise("")
    return _q(s).withColumn("source", source).withColumn("b", C.rule_intent(F.col("query"), F.col("has_history"), F.col("source")))


@query(f"WITH {_INTENT} SELECT query_id, b[1]::DOUBLE AS score, b[3] AS intent, b[4] AS reason FROM v")
def rule_intent(s):
    return _intents(s).select("query_id", F.col("b.score").alias("score"), F.col("b.intent").alias("intent"), F.col("b.reason").alias("reason"))


_MODEL = "CASE query_id % 3 WHEN 0 THEN 'FAQ_QUERY' WHEN 1 THEN 'KNOWLEDGE_QUERY' ELSE 'FOLLOW_UP' END AS model, (40 + query_id * 7 % 60) / 100.0::DOUBLE AS ms"


@query(f"""WITH {_INTENT}, f AS (SELECT query_id, b[1]::DOUBLE AS rs, b[3] AS rule, b[4] AS reason, has_history, {_MODEL} FROM v)
SELECT query_id, CASE WHEN model = 'FOLLOW_UP' AND NOT has_history OR ms < 0.55 OR model = rule THEN rule WHEN reason = 'default_knowledge' THEN model ELSE rule END AS intent,
round(CASE WHEN model = 'FOLLOW_UP' AND NOT has_history OR ms < 0.55 THEN rs WHEN model = rule THEN least(1.0, greatest(rs, ms) + 0.03) WHEN reason = 'default_knowledge' THEN ms ELSE least(rs, 0.68) END, 6) AS score,
CASE WHEN model = 'FOLLOW_UP' AND NOT has_history THEN 'model_follow_up_without_history_guarded' WHEN ms < 0.55 THEN 'model_low_confidence_rule_kept' WHEN model = rule THEN 'rule_model_agreed' WHEN reason = 'default_knowledge' THEN 'model_assisted_default' ELSE 'rule_model_conflict_guarded' END AS policy FROM f""")
def fuse_intent(s):
    i = F.col("query_id")
    model = F.when(i % 3 == 0, "FAQ_QUERY").when(i % 3 == 1, "KNOWLEDGE_QUERY").otherwise("FOLLOW_UP")
    return _intents(s).select("query_id", C.fuse_intent(F.col("b.intent"), F.col("b.score"), F.col("b.reason"), model, (40 + i * 7 % 60) / 100.0, F.col("has_history")).alias("f")).select("query_id", "f.*")


_CAT = f"CASE WHEN regexp_matches(q, '{R.PRICING}') THEN 'pricing' WHEN regexp_matches(q, '{R.COMPLIANCE}') THEN 'compliance' WHEN regexp_matches(q, '{R.TROUBLESHOOTING}') THEN 'troubleshooting' WHEN regexp_matches(q, '{R.SUMMARY}') THEN 'summary' ELSE 'default' END"


@query(f"""WITH {_INTENT}, t AS (SELECT query_id, scenario_id, source, b, {_CAT.replace('(q,', '(lower(raw),')} AS cat FROM v)
SELECT query_id, concat_ws('|', 'domain:' || scenario_id, CASE WHEN source <> '' THEN 'source:' || source END, CASE WHEN cat <> 'default' THEN 'risk:' || cat END, CASE WHEN b[3] = 'FOLLOW_UP' THEN 'context:history_required' END, CASE WHEN b[1] < 0.7 THEN 'confidence:low_rule_score' END) AS tags FROM t""")
def risk_tags(s):
    rows = _intents(s)
    return rows.select("query_id", F.array_join(C.risk_tags(F.col("scenario_id"), F.col("source"), C.question_category(F.col("query")), F.col("b.intent"), F.col("b.score")), "|").alias("tags"))


@query(f"SELECT query_id, {_CAT} AS category FROM (SELECT query_id, lower(trim(question)) AS q FROM questions)")
def question_category(s):
    return _q(s).select("query_id", C.question_category(F.col("query")).alias("category"))


@query(f"SELECT query_id, regexp_matches(lower(trim(question)), '{R.TABLE_QUERY}') AS is_table FROM questions")
def table_query_flag(s):
    return _q(s).select("query_id", C.table_query_flag(F.col("query")).alias("is_table"))


@query(f"WITH {_INTENT}, t AS (SELECT query_id, b[3] AS intent, {_CAT.replace('(q,', '(lower(raw),')} AS cat FROM v) SELECT query_id, CASE cat WHEN 'pricing' THEN 'strict' WHEN 'compliance' THEN 'legal' ELSE CASE intent WHEN 'FAQ_QUERY' THEN 'short' ELSE 'default' END END AS profile FROM t")
def prompt_profile(s):
    rows = _intents(s).select("query_id", F.col("b.intent").alias("intent"), C.question_category(F.col("query")).alias("category"))
    dim = lambda d, c: s.spark.createDataFrame(d, f"{c} string, profile string")
    return C.prompt_profile(rows, dim([("pricing", "strict"), ("compliance", "legal")], "category"), dim([("FAQ_QUERY", "short")], "intent")).select("query_id", "profile")


@query(f"""WITH {_R}, f AS (SELECT pos AS faq_id, CASE WHEN pos % 3 = 0 THEN concat(' ', upper(source)) ELSE 'other' END AS subject, question FROM faq),
m AS (SELECT faq_id, arg_min(source, source_order) AS first FROM f, r WHERE regexp_matches(subject, pattern) OR regexp_matches(question, pattern) GROUP BY 1)
SELECT faq_id, coalesce((SELECT any_value(source) FROM r WHERE source = lower(trim(subject))), first) AS source FROM f LEFT JOIN m USING (faq_id)""")
def faq_source_normalize(s):
    faq = s.faq.select(F.col("pos").alias("faq_id"), F.when(F.col("pos") % 3 == 0, F.concat(F.lit(" "), F.upper("source"))).otherwise("other").alias("subject"), "question")
    # orders repeat between scenarios here, so they are made one sequence
    one = rules(s).withColumn("source_order", F.col("source_order") * 2 + (F.col("scenario_id") == "support").cast("int"))
    good, bad = C.faq_source_normalize(faq, one)
    return good.select("faq_id", "source").unionByName(bad.select("faq_id", F.lit(None).cast("string").alias("source")))


@query("""WITH d AS (SELECT doc_id, doc_id % 20 = 0 AS csv, text FROM documents) SELECT doc_id, array_to_string(CASE WHEN len(l) = 0 THEN ['manual_review'] ELSE l END, '|') AS issues FROM (SELECT doc_id, list_filter([CASE WHEN contains(text, 'license') THEN 'expired_policy' END, CASE WHEN contains(text, 'license') THEN 'active_ingestion_blocked' END, CASE WHEN contains(text, '@') THEN 'policy_conflict' END, CASE WHEN contains(text, 'token') THEN 'ocr_review_required' END, CASE WHEN csv OR contains(text, '|') THEN 'table_split_required' END], lambda x: x IS NOT NULL) AS l FROM d)""")
def dirty_sample_classify(s):
    patterns = {"expired_policy": "license", "policy_conflict": "@", "ocr_review_required": "token", "table_split_required": r"\|"}
    return s.documents.select("doc_id", F.array_join(C.dirty_sample_classify(F.lit("f.txt"), F.when(F.col("doc_id") % 20 == 0, ".csv").otherwise(".txt"), F.col("text"), patterns), "|").alias("issues"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'account' WHEN 1 THEN 'timeout' WHEN 2 THEN 'connection' WHEN 3 THEN 'account' ELSE 'generic' END AS class FROM events")
def classify_errors(s):
    i = F.col("event_id")
    text = F.when(i % 5 == 0, "HTTP 401 Unauthorized").when(i % 5 == 1, "request Timed out").when(i % 5 == 2, "Connection refused").when(i % 5 == 3, "Invalid API key").otherwise(F.col("event_type"))
    return s.events.select("event_id", C.classify_errors(F.regexp_replace(text, "error", "e")).alias("class"))


@query()
def train_text_classifier(s):
    rows = s.documents.join(s.labels, "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("label"))
    model = C.train_text_classifier(rows.where("doc_id % 3 <> 0"))
    return C.score_text_classifier(model, rows.where("doc_id % 3 = 0")).select("doc_id", "label", "prediction", "probability")


@query()
def score_text_classifier(s):
    rows = s.documents.join(s.labels, "doc_id").select("text", F.col("quality").cast("double").alias("label"))
    model = C.train_text_classifier(rows)
    return C.score_text_classifier(model, s.documents.select("doc_id", "text")).select("doc_id", "prediction", "probability", F.get("scores", 1).alias("score"))


@query(f"WITH {_R} SELECT query_id, source, len(regexp_extract_all(question, pattern)) AS matches FROM questions q JOIN r ON q.scenario_id = r.scenario_id WHERE regexp_matches(question, pattern)")
def rule_join(s):
    rows = _q(s).join(few(rules(s)), "scenario_id")
    return rows.select("query_id", "source", F.expr("regexp_count(query, pattern)").alias("matches")).where("matches > 0")
