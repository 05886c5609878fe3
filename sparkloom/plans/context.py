"""Tables, derived tables and the registry of queries.

Derived tables are SQL that Spark and DuckDB both run, so a query and its check start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.lexical_store import open_bm25_store, write_bm25_store
from ..operators.stored import saved, scratch  # queries that write files take scratch from here

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FIXTURES: dict[str, str] = {
    "kb_docs": """
SELECT doc_id, text, source, lang AS scenario_id,
  CASE WHEN doc_id % 10 = 0 THEN 'tenant_b' ELSE 'default' END AS tenant_id, 'default' AS dataset_id,
  CASE doc_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'private' END AS visibility,
  CASE doc_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'public,hr' WHEN 2 THEN 'hr' ELSE 'finance,it' END AS allowed_roles_csv,
  1 + doc_id % 4 AS valid_from_seq, CASE WHEN doc_id % 5 = 0 THEN 3 + doc_id % 4 ELSE 0 END AS valid_to_seq
FROM documents""",
    "faq_pairs": """
SELECT conv_id, turn, question, answer FROM (
  SELECT conv_id, turn, role, text AS answer,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role,
    lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question
  FROM conversations WHERE role IN ('user','assistant')) t
WHERE role = 'assistant' AND prev_role = 'user'""",
    "faq": """
SELECT conv_id * 1000 + turn AS pos, concat('src', CAST(conv_id % 20 AS VARCHAR(9))) AS source,
  CASE WHEN conv_id % 9 = 0 THEN '' ELSE question END AS question, CASE WHEN conv_id % 11 = 0 THEN ' ' ELSE answer END AS answer
FROM faq_pairs""",
    "traces": """
SELECT event_id AS trace_id, user_id AS client, ts, event_type AS hit_type,
  value AS total_ms, value * 0.4 AS first_token_ms, event_type = 'error' AS error,
  event_id % 3 = 0 AS cache_enabled, event_id % 6 = 0 AS cache_hit
FROM events""",
    "feedback": """
SELECT event_id AS id, user_id AS session_id, ts AS created_at,
  CASE WHEN event_type = 'error' THEN 'not_useful' ELSE 'useful' END AS rating,
  event_type AS question, props AS sources_json
FROM events""",
    "scored_labels": """
SELECT doc_id, quality = 1 AS positive, (doc_id * 37 % 100) / 100.0 * 0.7 + 0.3 * quality AS score FROM labels""",
    "kg_edges": """
SELECT s_name AS source, c_name AS target, count(*) AS strength
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
GROUP BY s_name, c_name""",
    "kg_records": """
SELECT n_nationkey AS batch_id,
  concat('("entity"<|>', n_name, '<|>', r_name, '<|>nation ', n_name, ')##("relationship"<|>', n_name, '<|>', r_name, '<|>in<|>belongs to<|>', CAST(n_nationkey % 12 AS VARCHAR(9)), ')##("relationship"<|>', r_name, '<|>', n_name, '<|>', '他是公司的主管', '<|>', CASE WHEN n_nationkey % 3 = 0 THEN 'high' ELSE '2' END, ')##<|COMPLETE|>') AS response
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "activation_log": """
SELECT o_custkey % 8 AS scenario_id, o_orderkey % 6 + 1 AS version_seq, o_orderdate AS activated_at, o_orderkey AS log_id FROM orders""",
    "change_log": """
SELECT o_custkey AS path, o_orderkey AS chunk_id,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq
FROM orders""",
    "base_manifest": """
SELECT concat('kb/', source, '/', CAST(doc_id AS VARCHAR(20)), '.txt') AS path, source, sha2hex AS fingerprint, 'v1' AS schema_version, doc_id
FROM (SELECT doc_id, source, {sha} AS sha2hex FROM documents) d WHERE doc_id % 7 <> 0""",
    "new_manifest": """
SELECT concat('kb/', source, '/', CAST(doc_id AS VARCHAR(20)), '.txt') AS path, source,
  CASE WHEN doc_id % 5 = 0 THEN concat(sha2hex, 'x') ELSE sha2hex END AS fingerprint, CASE WHEN doc_id % 13 = 0 THEN 'v2' ELSE 'v1' END AS schema_version, doc_id
FROM (SELECT doc_id, source, {sha} AS sha2hex FROM documents) d WHERE doc_id % 11 <> 0""",
    "questions": """
SELECT conv_id * 1000 + turn AS query_id, conv_id, turn, concat('src', CAST(conv_id % 20 AS VARCHAR(9))) AS selected_source,
  CASE WHEN conv_id % 2 = 0 THEN 'enterprise' ELSE 'support' END AS scenario_id, turn > 0 AS has_history,
  concat(CASE (conv_id + turn) % 20 WHEN 0 THEN '你好，请问报销流程有哪些' WHEN 1 THEN '发票怎么开' WHEN 2 THEN '那费用呢'
    WHEN 3 THEN '系统安装失败报错怎么处理' WHEN 4 THEN '麻烦你帮我看下合同条款' WHEN 5 THEN '转人工' WHEN 6 THEN '你好！'
    WHEN 7 THEN '验收项清单有哪些字段' WHEN 8 THEN '知识库文档手册' WHEN 9 THEN 'WEBHOOK 回调流程怎么走' WHEN 10 THEN '糖尿病怎么办'
    WHEN 11 THEN '这个告警如何排查' WHEN 12 THEN '个人信息合规要求是什么' WHEN 13 THEN '总结主要内容' WHEN 14 THEN '怎么治疗感冒头疼' ELSE '' END,
    CASE WHEN (conv_id + turn) % 20 > 14 OR conv_id % 3 = 0 THEN concat(' ', text) ELSE '' END) AS question
FROM conversations WHERE role = 'user'""",
    "hits": """
SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS variant_no, concat('c', CAST(l_partkey % 40 AS VARCHAR(9))) AS chunk_id, concat('p', CAST(l_partkey % 13 AS VARCHAR(9))) AS parent_id,
  CASE WHEN l_partkey % 4 = 0 THEN 'faq' WHEN l_partkey % 7 = 0 THEN 'table_row' ELSE 'doc' END AS source_type,
  concat('src', CAST(l_suppkey % 5 AS VARCHAR(9))) AS source, CAST(l_quantity AS DOUBLE) / 50 AS score, CAST(l_partkey % 9 * 400 + 100 AS BIGINT) AS n_chars, l_orderkey % 3 = 0 AS prefer_table
FROM lineitem""",
    "eval_rows": """
SELECT event_id AS case_id, concat('scn', CAST(user_id % 4 AS VARCHAR(9))) AS scenario_id, concat('src', CAST(user_id % 7 AS VARCHAR(9))) AS source,
  CASE event_id % 4 WHEN 0 THEN 'rag' WHEN 1 THEN 'faq_direct' WHEN 2 THEN 'insufficient_context' ELSE NULL END AS hit_type,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 3 <> 0 END AS hit_type_matched,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 4 <> 1 END AS source_recall_hit,
  CASE WHEN event_id % 6 = 0 OR event_id % 4 = 1 THEN NULL ELSE 1 + event_id % 5 END AS expected_source_rank,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 8 <> 0 END AS effective_source_matched,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 10 <> 0 END AS prompt_profile_matched,
  (event_id % 11) / 10.0 AS keyword_coverage, CASE WHEN event_id % 12 = 0 THEN NULL ELSE (event_id % 100) / 100.0 END AS confidence_score,
  value AS elapsed_ms, CASE WHEN event_type = 'error' THEN 'timeout' ELSE '' END AS error, user_id, event_id % 17 + 1 AS turn
FROM events""",
}
#: Derived tables that are far smaller than the joins behind them and are used several times by a query: joined once.
STORED = {"kg_edges"}
_SHA = {"spark": "sha2(coalesce(text, ''), 256)", "duckdb": "sha256(coalesce(text, ''))"}


def _named(sql: str) -> set[str]:
    return set(re.findall(r"\b[a-z_]+\b", sql))


def spread(rows: DataFrame) -> DataFrame:
    """Deals rows out where a table has fewer splits than there are cores, as one small file of long texts has."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: The standing BM25 indexes of this session, by application and the files that they were built from.
_STORES: dict[tuple, str] = {}


def _files(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table, as Spark's file system lists them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return tuple(sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in found))


class Tables:
    """The given tables and the derived ones of a folder, as DataFrames by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._known = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        known = self.__dict__["_known"]
        if name not in known:
            if name in TABLES:
                rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                known[name] = spread(rows) if name == "documents" else rows
            elif name in FIXTURES:
                rows = self.sql(FIXTURES[name])
                known[name] = saved(rows, name) if name in STORED else rows
            else:
                raise AttributeError(name)
        return known[name]

    @property
    def bm25_store(self):
        """The standing index of documents: written by the first query of a session that needs it, opened by the others.
        Other files, or files written anew, get an index of their own."""
        at = (self.spark.sparkContext.applicationId, _files(self.spark, f"{self.sf_dir}/documents.parquet"))
        if at not in _STORES:
            path = scratch(self.spark, "bm25")
            write_bm25_store(self.documents.selectExpr("doc_id AS key", "text"), path)
            _STORES[at] = path
        return open_bm25_store(self.spark, _STORES[at])

    def sql(self, sql: str) -> DataFrame:
        sql = sql.replace("{sha}", _SHA["spark"]).replace("VARCHAR(9)", "STRING").replace("VARCHAR(20)", "STRING")
        for name in sorted((_named(sql) & ({*TABLES} | {*FIXTURES}))):
            if re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", sql):
                getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(sql)


def with_fixtures(sql: str) -> str:
    """The SQL with the derived tables it names put in front."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in FIXTURES:
            if name in _named(text) and name not in need and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                add(FIXTURES[name])
                if name not in need:
                    need.append(name)

    add(sql)
    if not need:
        return sql
    head = ", ".join(f"{n} AS ({FIXTURES[n].replace('{sha}', _SHA['duckdb'])})" for n in need)
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {head}, {body[14:]}"
    return f"WITH {head}, {body[4:]}" if body[:4].upper() == "WITH" else f"WITH {head} {body}"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with the DuckDB SQL of its rows."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = with_fixtures(sql)
        return f

    return register
