"""Queries of the scalar text and identity operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import identity as I
from .context import query


def q(pattern: str) -> str:
    return pattern.replace("'", "''")


_KB = "SELECT k.*, concat('kb/', source, '_data/f', doc_id, CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.csv' ELSE '.PDF' END) AS path FROM kb_docs k"


def _paths(s):
    suffix = F.expr("CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.csv' ELSE '.PDF' END")
    return s.kb_docs.withColumn("path", F.concat(F.lit("kb/"), "source", F.lit("_data/f"), F.col("doc_id").cast("string"), suffix))


@query(f"""WITH p AS ({_KB}) SELECT doc_id, path, source, 'default' AS dataset_id, tenant_id, visibility,
  array_to_string(list_filter(string_split(allowed_roles_csv, ','), lambda x: x <> ''), '|') AS roles, 'v7' AS kb_version, 7::BIGINT AS valid_from_seq, 0::BIGINT AS valid_to_seq,
  string_split(path, '/')[3] AS file_name, lower(regexp_extract(path, '\\.([^.]+)$', 1)) AS file_type FROM p""")
def stamp_metadata(s):
    docs = _paths(s).drop("valid_from_seq", "valid_to_seq")
    out = I.stamp_metadata(docs, "v7", 7, tenant=F.col("tenant_id"), visibility=F.col("visibility"), roles=F.split("allowed_roles_csv", ","))
    return out.select("doc_id", "path", "source", "dataset_id", "tenant_id", "visibility", F.array_join("allowed_roles", "|").alias("roles"), "kb_version", "valid_from_seq", "valid_to_seq", "file_name", "file_type")


@query(f"WITH p AS ({_KB}) SELECT doc_id, source AS found FROM p")
def source_from_path(s):
    return _paths(s).select("doc_id", T.source_from_path("path").alias("found"))


@query("SELECT doc_id, sha256(concat(coalesce(source, ''), '||', coalesce(nullif(lang, 'en'), ''), '||', coalesce(text, ''))) AS h FROM documents")
def stable_hash(s):
    return s.documents.select("doc_id", T.stable_hash("source", F.nullif("lang", F.lit("en")), "text").alias("h"))


@query("""WITH c AS (SELECT *, concat(scenario_id, '||', tenant_id, '||', dataset_id, '||', source, '||m1||v1||', doc_id) AS scope, doc_id % 6 = 0 AS t FROM kb_docs),
p AS (SELECT *, CASE WHEN t THEN sha256(concat(scope, '||t', doc_id % 50, '||s1||', doc_id)) ELSE sha256(concat(scope, '||', coalesce(text, ''))) END AS parent_id FROM c)
SELECT doc_id, parent_id, CASE WHEN t THEN sha256(concat('row||', parent_id)) ELSE sha256(concat(parent_id, '||', coalesce(text, ''))) END AS chunk_id FROM p""")
def chunk_identity(s):
    t = F.col("doc_id") % 6 == 0
    chunks = s.kb_docs.withColumn("parent_content", F.col("text")).withColumns({"content_type": F.when(t, "table_row").otherwise("text"), "table_id": F.concat(F.lit("t"), (F.col("doc_id") % 50).cast("string")), "sheet_name": F.lit("s1"), "row_number": F.col("doc_id"), "embedding_model_version": F.lit("m1"), "chunk_schema_version": F.lit("v1")})
    return I.chunk_identity(chunks).select("doc_id", "parent_id", "chunk_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN concat(l, ' / OCR 已复核', CASE WHEN doc_id % 2 = 0 THEN concat(' / 置信度：', doc_id % 100) ELSE '' END)
  WHEN doc_id % 4 = 2 THEN concat(l, ' / 工作表：sheet', doc_id % 3, ' / 第 ', doc_id, ' 行') ELSE l END AS label
FROM (SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 7 = 0 THEN concat('h3-', doc_id) ELSE '' END, ''), nullif(CASE WHEN doc_id % 5 = 0 THEN 'h1' ELSE '' END, ''), nullif(CASE WHEN doc_id % 3 = 0 THEN concat('f', doc_id, '.md') ELSE '' END, ''), source) AS l FROM documents)""")
def source_label(s):
    i = F.col("doc_id")
    pick = lambda c, v: F.when(c, v).otherwise("")
    label = T.source_label(pick(i % 7 == 0, F.concat(F.lit("h3-"), i.cast("string"))), F.lit(""), pick(i % 5 == 0, F.lit("h1")), pick(i % 3 == 0, F.concat(F.lit("f"), i.cast("string"), F.lit(".md"))), F.lit(""), "source", i % 9 == 0, F.when(i % 2 == 0, i % 100), i % 4 == 2, F.concat(F.lit("sheet"), (i % 3).cast("string")), i)
    return s.documents.select("doc_id", label.alias("label"))


@query("""SELECT k.doc_id, v.kb_version, v.seq AS valid_from_seq, 0::BIGINT AS valid_to_seq FROM kb_docs k
JOIN (SELECT scenario_id, max(valid_from_seq) AS seq, concat(scenario_id, '-v', max(valid_from_seq)) AS kb_version FROM kb_docs GROUP BY scenario_id) v USING (scenario_id)""")
def version_metadata(s):
    versions = s.kb_docs.groupBy("scenario_id").agg(F.max("valid_from_seq").alias("seq")).withColumn("kb_version", F.concat("scenario_id", F.lit("-v"), F.col("seq").cast("string")))
    return s.kb_docs.join(versions, "scenario_id").select("doc_id", "kb_version", F.col("seq").alias("valid_from_seq"), F.lit(0).cast("long").alias("valid_to_seq"))


@query(r"SELECT doc_id, lower(regexp_replace(text, '[\s\pP]+', '', 'g')) AS n FROM documents")
def normalize_text(s):
    return s.documents.select("doc_id", T.normalize_text("text").alias("n"))


def _normal_sql(col: str) -> str:
    raw = f"regexp_replace(coalesce({col}, ''), '^\\s+|\\s+$', '', 'g')"
    now = f"regexp_replace({raw}, '\\s+', ' ', 'g')"
    for _ in range(4):
        now = f"trim(regexp_replace(regexp_replace(regexp_replace({now}, '{q(R.GREETING_PREFIX)}', ''), '{q(R.POLITE_PREFIX)}', ''), '{R.LEADING}', ''))"
    return f"coalesce(nullif({now}, ''), {raw})"


@query(f"SELECT query_id, {_normal_sql('question')} AS n FROM questions")
def normalize_query(s):
    return s.questions.select("query_id", T.normalize_query("question").alias("n"))


@query(r"SELECT p_partkey, regexp_replace(trim(concat(' ', CAST(p_size AS VARCHAR), CASE WHEN p_partkey % 2 = 0 THEN '.0 ' ELSE '.50' END)), '^(\d+)\.0$', '\1') AS c FROM part")
def cell_text(s):
    return s.part.select("p_partkey", T.cell_text(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".0 ").otherwise(".50"))).alias("c"))


@query("SELECT n_nationkey, 'name' AS key, n_name AS value FROM nation UNION ALL SELECT n_nationkey, '区域', CAST(n_regionkey AS VARCHAR) FROM nation")
def extract_table_cells(s):
    text = F.concat(F.lit("表格行\n- name： "), "n_name", F.lit("\n - 区域: "), F.col("n_regionkey").cast("string"), F.lit("\n- 空：\nno cell: x"))
    return s.nation.select("n_nationkey", F.inline(T.table_cells(text)))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ocr_reviewed_text' END AS content_type, CASE WHEN doc_id % 3 = 0 THEN 'reviewed' END AS review_status,
 CASE WHEN doc_id % 3 = 0 THEN (doc_id % 100) / 100.0::DOUBLE END AS confidence, CASE WHEN doc_id % 3 = 0 THEN concat('scan/', source, '.png') END AS original FROM documents""")
def parse_ocr_review(s):
    head = F.concat(F.when(F.col("doc_id") % 3 == 0, "复核状态：已复核\n").otherwise("草稿\n"), F.lit("OCR 平均置信度："), ((F.col("doc_id") % 100) / 100.0).cast("decimal(4,2)").cast("string"), F.lit("\n原始文件： scan/"), "source", F.lit(".png \n"), F.substring("text", 1, 200))
    yes = F.col("reviewed")
    rows = s.documents.select("doc_id", head.alias("t")).withColumn("reviewed", T.ocr_reviewed("t"))
    return rows.select("doc_id", F.when(yes, "ocr_reviewed_text").alias("content_type"), F.when(yes, "reviewed").alias("review_status"), F.when(yes, F.regexp_extract("t", R.OCR_CONFIDENCE, 1).try_cast("double")).alias("confidence"), F.when(yes, F.trim(F.regexp_extract("t", R.OCR_SOURCE, 1))).alias("original"))


_FACTS = f"list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '{R.VERSION_NUMBER}', '', 'g'), '{R.NUMERIC_FACT}'), lambda x: replace(x, ' ', ''))"


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(f, lambda x: regexp_replace(x, '\\s+', '', 'g')))), '|') AS facts FROM (SELECT doc_id, {_FACTS} AS f FROM documents)")
def numeric_facts(s):
    return s.documents.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform(T.numeric_facts("text"), lambda x: F.regexp_replace(x, r"\s+", "")))), "|").alias("facts"))


@query("SELECT doc_id, substr(text, 1, len(list_filter(range(1, 102), lambda n: n <= length(text) AND strlen(substr(text, 1, n)) <= 101))) AS cut FROM documents")
def truncate_utf8(s):
    return s.documents.select("doc_id", T.truncate_utf8("text", 101).alias("cut"))


@query("SELECT doc_id, CASE WHEN n AND NOT p THEN 'negative' WHEN p AND NOT n THEN 'positive' ELSE 'mixed_or_unknown' END AS polarity FROM (SELECT doc_id, regexp_matches(text, ' (nicht|pas|no|not) ') AS n, regexp_matches(text, ' (the|der|les|que) ') AS p FROM documents)")
def polarity(s):
    return s.documents.select("doc_id", T.polarity("text", " (nicht|pas|no|not) ", " (the|der|les|que) ").alias("polarity"))


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\x{4e00}-\x{9fff}]+|[\p{L}\p{N}]+')"
_FIRST = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"
KEYWORDS_SQL = f"list_filter({_WORDS}, lambda x: length(x) >= 2)"


@query(f"SELECT doc_id, array_to_string((list_filter(l, lambda x, i: list_position(l, x) = i))[1:12], '|') AS k FROM (SELECT doc_id, {KEYWORDS_SQL} AS l FROM documents)")
def keyword_tokens(s):
    return s.documents.select("doc_id", F.array_join(T.keyword_tokens("text"), "|").alias("k"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[\\x{4e00}-\\x{9fff}A-Za-z0-9_]+'), lambda x: lower(x)))), '|') AS t FROM documents")
def ngram_terms(s):
    return s.documents.select("doc_id", F.array_join(F.array_sort(T.ngram_terms("text")), "|").alias("t"))


_RUNS = r"regexp_extract_all(coalesce(question, ''), '[\x{4e00}-\x{9fff}]+')"
_SYN = ", ".join(f"('{k}', '{v}')" for k, vs in R.SYNONYMS.items() for v in vs)


@query(f"""WITH r AS (SELECT query_id, unnest({_RUNS}) AS w FROM questions), g AS (SELECT DISTINCT query_id, substr(w, i, n) AS g FROM r, range(1, 60) a(i), range(2, 7) b(n) WHERE i + n - 1 <= length(w)),
s AS (SELECT * FROM (VALUES {_SYN}) t(k, v)), e AS (SELECT query_id, g FROM g UNION SELECT query_id, v FROM g JOIN s ON g = k)
SELECT query_id, string_agg(g, '|' ORDER BY length(g) DESC, g) AS tokens FROM e GROUP BY query_id""")
def expand_query_tokens(s):
    return s.questions.select("query_id", T.expand_query_tokens("question").alias("t")).where(F.size("t") > 0).select("query_id", F.array_join("t", "|").alias("tokens"))


_FOUND = f"list_filter([{', '.join(repr(m) for m in R.SEARCH_MARKERS)}], lambda m: contains(c, m))[1]"


@query(f"""WITH c AS (SELECT query_id, regexp_replace(coalesce(question, ''), '[\\s\\x{{3000}}，。？！、；：,.!?;:]+', '', 'g') AS c FROM questions), m AS (SELECT query_id, c, {_FOUND} AS m FROM c),
p AS (SELECT query_id, c, CASE WHEN m IS NOT NULL THEN CASE WHEN strpos(c, m) > 2 THEN substr(c, 1, strpos(c, m) - 1) ELSE substr(c, strpos(c, m) + length(m)) END END AS k FROM m)
SELECT query_id, CASE WHEN c = '' THEN '' WHEN k IS NULL OR length(k) < 2 OR k = c THEN c ELSE concat(c, '|', k) END AS keys FROM p""")
def graph_search_keys(s):
    return s.questions.select("query_id", F.array_join(T.graph_search_keys("question"), "|").alias("keys"))


_DESC = "CASE doc_id % 8 WHEN 0 THEN concat('张三是', source, '的父亲。') WHEN 1 THEN '两家公司存在竞争' WHEN 2 THEN '他参加了拍卖大会' WHEN 3 THEN '购买设备' WHEN 4 THEN '' WHEN 5 THEN concat(source, '是学生的老师') WHEN 6 THEN '负责项目' ELSE lang END"


@query(f"SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '父亲' WHEN 1 THEN '敌对' WHEN 2 THEN '拍卖大会' WHEN 3 THEN '交易' WHEN 5 THEN '老师' WHEN 6 THEN '领导' ELSE '关联' END AS label FROM (SELECT doc_id, {_DESC} AS d FROM documents)")
def relation_label_from_text(s):
    return s.documents.select("doc_id", T.relation_label(F.expr(_DESC)).alias("label"))


@query("""SELECT query_id, rank, substr(text, 1, 500) AS preview, concat(source, '#', rank) AS citation, CASE WHEN doc_id % 4 = 0 THEN doc_id END AS row_number
FROM (SELECT *, label AS query_id, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS rank FROM (SELECT d.*, doc_id % 25 AS label FROM documents d)) WHERE rank <= 5""")
def source_payload(s):
    from pyspark.sql import Window

    rows = s.documents.withColumn("query_id", F.col("doc_id") % 25)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")).cast("long"))
    hits = rows.select("query_id", "rank", "text", F.concat("source", F.lit("#"), F.col("rank").cast("string")).alias("citation"), (F.col("doc_id") % 4 == 0).alias("is_table"), F.lit("t").alias("table_id"), F.lit("s").alias("sheet_name"), F.col("doc_id").alias("row_number"))
    return I.source_payload(hits).select("query_id", "rank", "preview", "citation", F.col("locator.row_number").alias("row_number"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('c', doc_id) WHEN doc_id % 3 = 1 THEN concat('f', doc_id) ELSE substr(text, 1, 120) END AS k FROM documents")
def document_key(s):
    i = F.col("doc_id")
    return s.documents.select("doc_id", I.document_key(F.when(i % 3 == 0, F.concat(F.lit("c"), i.cast("string"))).otherwise(""), F.when(i % 3 == 1, F.concat(F.lit("f"), i.cast("string"))), F.col("text")).alias("k"))


@query("SELECT doc_id, substr(CASE WHEN doc_id % 2 = 0 THEN source ELSE text END, 1, 160) AS k FROM documents")
def source_signature(s):
    return s.documents.select("doc_id", I.source_signature(F.lit(""), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.lit(None).cast("string"), F.col("text")).alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1 END::BIGINT AS n, CASE WHEN event_id % 10 <> 0 THEN json_extract_string(props, '$.k') END AS k FROM events")
def json_column_decode(s):
    text = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.col("props"))
    m = T.json_or_empty(text, "map<string,string>")
    return s.events.select("event_id", F.size(m).cast("long").alias("n"), F.element_at(m, "k").alias("k"))


@query("""SELECT doc_id, array_to_string(CASE WHEN len(l) = 0 THEN ['public'] ELSE list_filter(l, lambda x, i: list_position(l, x) = i) END, '|') AS roles
FROM (SELECT doc_id, list_filter(list_transform(string_split(concat(CASE WHEN doc_id % 9 = 0 THEN ' ,' ELSE allowed_roles_csv END, ', ', CASE WHEN doc_id % 2 = 0 THEN ' hr ' ELSE '' END), ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM kb_docs)""")
def clean_roles(s):
    roles = F.split(F.when(F.col("doc_id") % 9 == 0, " ,").otherwise(F.col("allowed_roles_csv")), ",")
    return s.kb_docs.select("doc_id", F.array_join(T.clean_roles(roles, F.when(F.col("doc_id") % 2 == 0, " hr ").otherwise("")), "|").alias("roles"))


@query("SELECT event_id, round(CASE WHEN v <= 0 THEN 0 WHEN v <= 1 THEN v ELSE 1 - 1 / (1 + v) END, 6) AS s FROM (SELECT event_id, value / 10 - 0.5 AS v FROM events)")
def normalize_score(s):
    return s.events.select("event_id", F.round(T.normalize_score(F.col("value") / 10 - 0.5), 6).alias("s"))


@query("""SELECT conv_id, string_agg(concat(CASE role WHEN 'user' THEN '用户：' ELSE '助手：' END, text), chr(10) ORDER BY turn) AS history
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant')) WHERE n <= 8 GROUP BY conv_id""")
def format_history(s):
    rows = s.conversations.where("role IN ('user', 'assistant')").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    last = F.slice("m", F.greatest(F.size("m") - 7, F.lit(1)), 8)
    return rows.select("conv_id", F.array_join(F.transform(last, lambda x: F.concat(F.when(x["role"] == "user", "用户：").otherwise("助手："), x["text"])), "\n").alias("history"))


@query("""SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS column_3 FROM nation""")
def normalize_table_headers(s):
    raw = s.nation.select(F.col("n_nationkey").cast("string"), "n_name", F.lit(None).cast("string").alias("empty"), F.col("n_regionkey").cast("string").alias("Unnamed: 3"))
    return I.normalize_table_headers(raw.unionByName(raw.limit(1).select(*[F.lit(None).cast("string").alias(c) for c in raw.columns])))


@query("""WITH a AS (SELECT *, sha256(concat('faq||v1||', source, '||', question)) AS f, row_number() OVER (PARTITION BY source, question ORDER BY pos) AS n FROM faq),
b AS (SELECT *, CASE WHEN n = 1 THEN f ELSE sha256(concat('faq||v1||', source, '||', question, '||', answer)) END AS faq_id FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY faq_id ORDER BY pos) AS k FROM b)
SELECT faq_id, pos, source, question, answer, 'v1' AS kb_version FROM c WHERE k = 1""")
def faq_snapshot(s):
    return I.faq_snapshot(s.faq, "v1")


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN concat(answer, chr(10), chr(10), '表格行要点：状态：open-', turn, '；来源：', conv_id, ' [1]') WHEN conv_id % 3 = 1 THEN concat(answer, ' [2]')
ELSE concat(answer, chr(10), chr(10), '来源：', chr(10), '[1] doc', conv_id) END AS cited FROM faq_pairs""")
def citation_footer(s):
    cells = F.array(F.struct(F.lit("状态").alias("key"), F.concat(F.lit("open-"), F.col("turn").cast("string")).alias("value")), F.struct(F.lit("来源").alias("key"), F.col("conv_id").cast("string").alias("value")))
    docs = F.array(F.struct(F.concat(F.lit("doc"), F.col("conv_id").cast("string")).alias("label"), (F.col("conv_id") % 3 == 0).alias("is_table"), cells.alias("cells")))
    rows = s.faq_pairs.select("conv_id", "turn", F.when(F.col("conv_id") % 3 == 1, F.concat("answer", F.lit(" [2]"))).otherwise(F.col("answer")).alias("answer"), docs.alias("docs"))
    return I.citation_footer(rows).select("conv_id", "turn", "cited")
