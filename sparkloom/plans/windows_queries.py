"""Queries of top-k, ordering, context selection and version timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as K
from .context import query


@query("SELECT l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def topk_per_group(s):
    return K.topk_per_group(s.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")], 3).drop("l_extendedprice")


@query("SELECT sha256(coalesce(text, '')) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def keep_first_distinct(s):
    return K.keep_first(s.documents.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), "doc_id"), ["h"], [F.col("doc_id")])


@query("""SELECT query_id, chunk_id, score, variant_no FROM (SELECT query_id, chunk_id, score, variant_no, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, variant_no) AS n FROM hits) WHERE n = 1""")
def keep_best_hit(s):
    return K.keep_best_hit(s.hits.select("query_id", "chunk_id", "score", "variant_no"), ["query_id", "chunk_id"])


_RANKED = "SELECT query_id, chunk_id, source_type, prefer_table, score, parent_id, n_chars, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id, source, parent_id, source_type, n_chars) AS rank FROM (SELECT query_id, chunk_id, source_type, prefer_table, parent_id, n_chars, source, max(score) AS score FROM hits GROUP BY query_id, chunk_id, source_type, prefer_table, parent_id, n_chars, source) h"


@query(f"""WITH r AS ({_RANKED}), f AS (SELECT *, min(CASE WHEN source_type = 'faq' THEN rank END) OVER (PARTITION BY query_id) AS f FROM r)
SELECT query_id, chunk_id, source, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank = f THEN 0 ELSE 1 END, rank) AS new_rank FROM f""")
def promote_exact_match(s):
    return K.promote_exact(s.sql(_RANKED), F.col("source_type") == "faq").select("query_id", "chunk_id", "source", "new_rank")


@query(f"WITH r AS ({_RANKED}) SELECT query_id, chunk_id, source, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN prefer_table AND source_type = 'table_row' THEN 0 ELSE 1 END, score DESC, chunk_id, source) AS rank FROM r")
def table_first_order(s):
    rows = s.sql(_RANKED).drop("rank").withColumn("key", F.struct("chunk_id", "source"))
    return K.table_first_order(rows).select("query_id", "chunk_id", "source", "rank")


_FITS = "len(s.keys) < 4 AND NOT list_contains(s.parents, i.p) AND s.used + i.c <= 3000"


@query(f"""WITH RECURSIVE r AS ({_RANKED}), q AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_type = 'faq' ORDER BY rank) AS f FROM r),
i AS (SELECT query_id, chunk_id AS key, coalesce(parent_id, chunk_id) AS p, least(n_chars, 1600)::BIGINT AS c, row_number() OVER (PARTITION BY query_id ORDER BY source_type <> 'faq', rank) AS n FROM q WHERE source_type <> 'faq' OR f <= 2),
s AS (SELECT query_id, n, [p] AS parents, [key] AS keys, c AS used FROM i WHERE n = 1
 UNION ALL SELECT i.query_id, i.n, CASE WHEN {_FITS} THEN list_append(s.parents, i.p) ELSE s.parents END, CASE WHEN {_FITS} THEN list_append(s.keys, i.key) ELSE s.keys END, CASE WHEN {_FITS} THEN s.used + i.c ELSE s.used END FROM s JOIN i ON i.query_id = s.query_id AND i.n = s.n + 1),
e AS (SELECT query_id, arg_max(keys, n) AS keys, max(used) AS used FROM s GROUP BY query_id)
SELECT query_id, unnest(range(0, len(keys))) AS pos, unnest(keys) AS key, used FROM e""")
def select_context(s):
    rows = s.sql(_RANKED).select("query_id", "rank", F.col("chunk_id").alias("key"), "parent_id", (F.col("source_type") == "faq").alias("is_faq"), "n_chars")
    return K.select_context(rows, budget=3000)


@query(f"""WITH r AS ({_RANKED}), c AS (SELECT query_id, chunk_id, parent_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) AS k FROM r WHERE source_type <> 'faq') WHERE k = 1)
SELECT query_id, pos, chunk_id AS key FROM c WHERE pos <= 4""")
def select_context_unbounded(s):
    rows = s.sql(_RANKED).where("source_type <> 'faq'").select("query_id", "rank", F.col("chunk_id").alias("key"), "parent_id", F.lit(False).alias("is_faq"), "n_chars")
    return K.select_context(rows, budget=10**9).select("query_id", (F.col("pos") + 1).alias("pos"), "key")


@query(f"""WITH r AS ({_RANKED}), f AS (SELECT query_id, source, min(rank) AS pos FROM r WHERE rank <= 5 GROUP BY query_id, source), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM f),
l AS (SELECT n.query_id, n, chunk_id, n.source FROM n JOIN r ON r.query_id = n.query_id AND r.rank = n.pos)
SELECT query_id, string_agg(concat('[', n, '] ', chunk_id, chr(10), source), chr(10) || chr(10) ORDER BY n) AS context FROM l GROUP BY query_id""")
def build_context_text(s):
    return K.build_context_text(s.sql(_RANKED).where("rank <= 5").select("query_id", F.col("rank").alias("pos"), F.col("chunk_id").alias("label"), F.col("source").alias("text")))


@query("""SELECT conv_id AS session_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3""")
def last_n_messages(s):
    return K.last_n_messages(s.conversations.select(F.col("conv_id").alias("session_id"), "turn", "text"), 3)


@query("""WITH m AS (SELECT *, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM conversations WHERE role IN ('user', 'assistant')),
u AS (SELECT conv_id, i, max(turn) AS ut FROM m WHERE role = 'user' GROUP BY conv_id, i)
SELECT m.conv_id AS session_id, m.turn, q.text AS question, m.text AS answer FROM m JOIN u USING (conv_id, i) JOIN conversations q ON q.conv_id = m.conv_id AND q.turn = u.ut WHERE m.role = 'assistant'""")
def pair_turns(s):
    return K.pair_turns(s.conversations.select(F.col("conv_id").alias("session_id"), "turn", "role", "text"))


_CHANGES = "SELECT *, lag(version_seq) OVER (PARTITION BY scenario_id ORDER BY activated_at, log_id) AS from_seq FROM activation_log"


@query(f"""WITH c AS ({_CHANGES}), d AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY activated_at DESC, log_id DESC) AS rank FROM c WHERE from_seq IS NULL OR from_seq <> version_seq)
SELECT scenario_id, log_id, from_seq, version_seq, CASE WHEN version_seq < from_seq THEN 'rollback' ELSE 'activate' END AS action, rank FROM d WHERE rank <= 50""")
def activation_history(s):
    return K.activation_history(s.activation_log, 50).select("scenario_id", "log_id", "from_seq", "version_seq", "action", "rank")


@query(f"""WITH c AS ({_CHANGES}), d AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY activated_at DESC, log_id DESC) AS r FROM c WHERE from_seq IS NULL OR from_seq <> version_seq),
n AS (SELECT scenario_id, version_seq AS active, from_seq AS previous FROM d WHERE r = 1)
SELECT DISTINCT scenario_id, version_seq, active, previous, CASE WHEN version_seq = active THEN 'ACTIVE' WHEN (scenario_id + version_seq) % 3 = 0 THEN 'ARCHIVED' ELSE 'STAGED' END AS status FROM activation_log JOIN n USING (scenario_id)""")
def version_status(s):
    archived = s.activation_log.where("(scenario_id + version_seq) % 3 = 0").select("scenario_id", "version_seq").distinct()
    return K.version_status(s.activation_log, archived)


@query("SELECT scenario_id, log_id, 100 * scenario_id + row_number() OVER (PARTITION BY scenario_id ORDER BY activated_at, log_id) AS new_seq FROM activation_log")
def next_version_seq(s):
    log = s.activation_log.withColumnRenamed("activated_at", "created_at")
    base = log.select("scenario_id").distinct().withColumn("base_seq", 100 * F.col("scenario_id"))
    return K.next_version_seq(log, base).select("scenario_id", "log_id", "new_seq")


@query("SELECT path, chunk_id, seq AS valid_from_seq, lead(seq, 1, 0) OVER (PARTITION BY path ORDER BY seq, chunk_id) AS valid_to_seq FROM change_log")
def validity_windows(s):
    return K.validity_windows(s.change_log).select("path", "chunk_id", "valid_from_seq", F.col("valid_to_seq").cast("long").alias("valid_to_seq"))


@query("SELECT id, rating FROM feedback WHERE rating = 'not_useful' ORDER BY created_at DESC, id DESC LIMIT 1000")
def newest_first_listing(s):
    return K.newest_first(s.feedback.where("rating = 'not_useful'"), [F.desc("created_at"), F.desc("id")], 5000, 1000).select("id", "rating")


_SEEDS = "SELECT s_suppkey % 20 AS query_id, s_name AS name FROM supplier UNION SELECT c_custkey % 20, c_name FROM customer WHERE c_custkey % 7 = 0"


@query(f"""WITH s AS ({_SEEDS}), a AS (SELECT query_id, source, target, strength FROM kg_edges JOIN s ON name = source UNION ALL SELECT query_id, source, target, strength FROM kg_edges JOIN s ON name = target),
b AS (SELECT query_id, source, target, max(strength) AS strength, count(*) AS ends FROM a GROUP BY 1, 2, 3), c AS (SELECT *, CASE WHEN ends = 2 THEN 3.0 ELSE 1.0 END * strength AS score FROM b)
SELECT query_id, source, target, CAST(score AS DOUBLE) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, target) AS rank FROM c) WHERE rank <= 30""")
def rank_relations(s):
    return K.rank_relations(s.kg_edges, s.sql(_SEEDS)).select("query_id", "source", "target", F.col("score").cast("double").alias("score"), "rank")


_LINES = "SELECT source AS group_id, 0 AS kind, target AS pos, target AS line FROM kg_edges UNION ALL SELECT source, 1, target, concat(source, ' -> ', target) FROM kg_edges"


@query(f"""WITH l AS ({_LINES}), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, kind ORDER BY pos) AS n FROM l) WHERE n <= CASE kind WHEN 0 THEN 6 ELSE 12 END),
s AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY group_id ORDER BY kind, pos ROWS UNBOUNDED PRECEDING) AS upto FROM c) SELECT group_id, kind, pos, upto::BIGINT AS upto FROM s WHERE upto <= 400""")
def budgeted_lines(s):
    return K.budgeted_lines(s.sql(_LINES), 400, most={0: 6, 1: 12}).select("group_id", "kind", "pos", "upto")


@query("SELECT query_id, count(*) AS context_count, sum(n_chars)::BIGINT AS context_chars, count(DISTINCT source) AS source_count, max(score) AS top_score FROM hits GROUP BY query_id")
def context_stats(s):
    return K.context_stats(s.hits)


@query(f"""WITH r AS ({_RANKED}), x AS (SELECT query_id, chunk_id, source, row_number() OVER (PARTITION BY query_id, source_type = 'faq' ORDER BY rank) AS rank, source_type = 'faq' AS f FROM r),
y AS (SELECT * FROM x WHERE (f AND rank <= 2) OR (NOT f AND rank <= 5))
SELECT query_id, chunk_id, source, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN f = (query_id % 3 <> 0) THEN 0 ELSE 1 END, rank) AS pos FROM y""")
def union_sources(s):
    from pyspark.sql import Window

    rows = s.sql(_RANKED).withColumn("f", F.col("source_type") == "faq").withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "f").orderBy("rank")))
    plans = s.hits.select("query_id", "prefer_table").distinct()
    pick = rows.select("query_id", "chunk_id", "source", "rank", "f")
    return K.union_sources(pick.where("f").drop("f"), pick.where("NOT f").drop("f"), plans).select("query_id", "chunk_id", "source", "pos")
