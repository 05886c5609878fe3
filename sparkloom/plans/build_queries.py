"""Queries of sources, sinks, chunking and builds. Files are written from the given tables into a shared folder first."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import build as B
from ..operators import chunking as C
from ..operators import joins as J
from ..operators.sequence_packing import pack_parents_in_order as packed_in_order
from ..sources import files as S
from .context import query, scratch


@query("SELECT doc_id, sha256(rtrim(text, chr(10))) AS h, false AS reviewed FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def read_text_corpus(s):
    path = scratch(s.spark, "corpus")
    _files_of_rows(s.documents.select("doc_id", "text"), path)
    rows = S.read_text_corpus(s.spark, path)
    return rows.select(F.regexp_extract("path", r"doc_id=([0-9]+)[^/]*$", 1).cast("long").alias("doc_id"), F.sha2(F.regexp_replace("text", r"\n+$", ""), 256).alias("h"), "reviewed")


#: Files of one folder, so that executors list a large corpus folder by folder.
FOLDER = 1000


def _files_of_rows(rows: DataFrame, path: str) -> None:
    """rows(doc_id, text) → a .txt file for each row, doc_id in its name, below a shared path.

    Spark's writer by partitions takes a folder, a checksum and two processes for permissions a file; tasks write their files
    themselves where the path is a mounted folder. A task's files lie in a hidden folder until all are there, so a task
    that runs again leaves nothing twice."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("maxRecordsPerFile", 1).partitionBy("doc_id").text(path)
        return
    root = at.toUri().getPath()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n = TaskContext.get(), 0
        own = f"{root}/_{task.taskAttemptId()}"
        os.makedirs(own)
        for pdf in batches:
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if n % FOLDER == 0:
                    os.mkdir(f"{own}/{n // FOLDER}")
                with open(f"{own}/{n // FOLDER}/{n}.doc_id={i}.txt", "wb") as f:
                    f.write((text or "").encode() + b"\n")
                n += 1
        try:
            os.rename(own, f"{root}/{task.partitionId()}")
        except OSError:  # another attempt was first
            if not os.path.isdir(f"{root}/{task.partitionId()}"):
                raise
        yield pd.DataFrame({"n": [n]})

    rows.mapInPandas(run, "n long").agg(F.sum("n")).collect()  # one row


@query("""SELECT row_number() OVER (ORDER BY p_partkey) AS row_number, concat('- p_partkey：', p_partkey, chr(10), '- p_name：', p_name, chr(10), '- p_size：', p_size, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(chr(10), '- p_brand：', p_brand) END) AS text FROM part""")
def read_table_rows(s):
    path = scratch(s.spark, "table")
    rows = s.part.select("p_partkey", "p_name", F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("p_size"), F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_brand")).alias("p_brand"))
    rows.orderBy("p_partkey").coalesce(1).write.csv(path, header=True)  # one file, as tables arrive
    return S.read_table_rows(s.spark, path, "part").select("row_number", "text")


_FAQ = r"SELECT source, regexp_replace(question, '^\s+|\s+$', '', 'g') AS question, regexp_replace(answer, '^\s+|\s+$', '', 'g') AS answer FROM faq"


@query(_FAQ)
def read_faq(s):
    path = scratch(s.spark, "faq")
    s.faq.select(F.col("source").alias("分类"), F.col("question").alias("问题"), F.col("answer").alias("答案")).write.csv(path, header=True, quoteAll=True, escape='"')
    return S.read_faq(s.spark, path)


@query(_FAQ)
def write_faq_csv(s):
    path = scratch(s.spark, "faq-out")
    S.write_faq_csv(s.faq, path)
    return S.read_faq(s.spark, path)


@query("SELECT concat('case-', item_id) AS case_id, text AS query, 'default' AS tenant_id, CASE WHEN item_id % 2 = 0 THEN 'internal' ELSE 'public' END AS visibility FROM benchmark")
def read_eval_cases(s):
    path = scratch(s.spark, "cases")
    i = F.col("item_id")
    row = F.to_json(F.struct(F.concat(F.lit("case-"), i.cast("string")).alias("case_id"), F.col("text").alias("question"), F.when(i % 2 == 0, "internal").alias("visibility")))
    s.benchmark.select(row.alias("value")).unionByName(s.spark.range(1).select(F.lit("# a comment").alias("value"))).write.text(path)
    return S.read_eval_cases(s.spark, path, lines=True).select("case_id", "query", "tenant_id", "visibility")


@query("""SELECT lang AS scenario_id, source, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS source_order, concat(source, '|', lang) AS pattern, upper(source) AS label FROM (SELECT DISTINCT lang, source FROM documents)""")
def read_scenario_dim(s):
    path = scratch(s.spark, "scenarios")
    d = s.documents.select("lang", "source").distinct().groupBy("lang").agg(F.array_sort(F.collect_list("source")).alias("valid_sources"))
    d = d.select(F.col("lang").alias("k"), F.col("lang").alias("scenario_id"), "valid_sources", F.map_from_arrays("valid_sources", F.transform("valid_sources", lambda x: F.upper(x))).alias("source_labels"), F.map_from_arrays("valid_sources", F.transform("valid_sources", lambda x: F.concat(x, F.lit("|"), "lang"))).alias("source_patterns"))
    d.write.partitionBy("k").json(path)
    return S.read_scenario_dim(s.spark, path).select("scenario_id", "source", "source_order", "pattern", "label")


@query("SELECT DISTINCT '.txt' AS suffix, concat('source=', source) AS source, true AS supported FROM documents")
def file_inventory(s):
    path = scratch(s.spark, "files")
    s.documents.select("source", "text").write.partitionBy("source").text(path)
    return S.file_inventory(s.spark, path).select("suffix", "source", "supported").distinct()


@query()
def read_html_pages(s):
    return S.read_html_pages(s.pages).select("page_id", "title", F.length("text").alias("chars"), F.size("links").alias("links"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 200000")
def read_control_table(s):
    return S.read_control_table(s.spark, f"{s.sf_dir}/orders.parquet", "o_totalprice > 200000").select("o_orderkey", "o_orderstatus")


@query("SELECT doc_id AS key, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS payload FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 2 <> 0")
def write_chunks_upsert(s):
    path = scratch(s.spark, "changes")
    d = s.documents.select(F.col("doc_id").alias("key"), "source")
    S.append_changes(d.select("key", F.lit(1).alias("batch_id"), F.lit("upsert").alias("op"), F.col("source").alias("payload")), path)
    second = d.where("key % 2 = 0").select("key", F.lit(2).alias("batch_id"), F.when(F.col("key") % 5 == 0, "delete").otherwise("upsert").alias("op"), F.upper("source").alias("payload"))
    S.append_changes(second, path)
    S.append_changes(second, path)  # a replayed batch
    return S.current_view(s.spark.read.parquet(path))


@query("SELECT source, target, count(*) AS n FROM kg_edges GROUP BY 1, 2")
def write_graph(s):
    path = scratch(s.spark, "graph")
    entities = s.kg_edges.select(F.col("source").alias("name"), F.lit("t").alias("description")).distinct()
    relations = s.kg_edges.withColumn("label", F.lit("supplies"))
    members = entities.select(F.substring("name", -1, 1).alias("community"), "name")
    for _ in range(2):  # a rebuild writes the same
        S.write_graph(entities, relations, members, path, "v1")
    return s.spark.read.parquet(f"{path}/relations").where("kb_version = 'v1'").groupBy("source", "target").agg(F.count_distinct("id").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def write_report(s):
    path = scratch(s.spark, "report")
    S.write_report(s.events.groupBy("event_type").agg(F.count("*").alias("n")), path, "events")
    return s.spark.read.schema("event_type string, n long, report_type string").json(path).where("report_type = 'events'").select("event_type", "n")


_MARK = "CASE WHEN l = {k} THEN name WHEN l > 0 AND l < {k} THEN '' END"
_HEAD = "nullif(last_value(" + _MARK + " IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING), '') AS h{k}"


@query(rf"""WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), y AS (SELECT doc_id, unnest(range(0, len(lines))) AS n, unnest(lines) AS line FROM x),
z AS (SELECT *, length(regexp_extract(line, '^(#{{1,3}}) +\S', 1)) AS l, trim(regexp_replace(line, '^#{{1,3}} +', '')) AS name FROM y),
w AS (SELECT *, sum(CASE WHEN l > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)::BIGINT AS section, {_HEAD.format(k=1)}, {_HEAD.format(k=2)}, {_HEAD.format(k=3)} FROM z)
SELECT doc_id, section, h1, h2, h3, trim(string_agg(line, chr(10) ORDER BY n)) AS text FROM w WHERE l = 0 GROUP BY ALL HAVING trim(string_agg(line, chr(10) ORDER BY n)) <> ''""")
def split_markdown_sections(s):
    return C.split_markdown_sections(s.documents.select("doc_id", "text"))


@query()
def recursive_split(s):
    return C.recursive_split(s.documents.select("doc_id", "text"), 350, 50)


@query("SELECT doc_id, piece_no, 1 + piece_no * 450 AS start, substr(text, CAST(1 + piece_no * 450 AS BIGINT), 500) AS piece FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(greatest(length(text) - 50, 1) / 450.0) AS BIGINT))) AS piece_no FROM documents WHERE length(text) > 0)")
def fixed_window_split(s):
    return C.fixed_window_split(s.documents.select("doc_id", "text"), 500, 50)


@query()
def parent_child_chunks(s):
    return C.parent_child_chunks(s.documents.withColumn("content_type", F.lit("text")).select("doc_id", "text", "content_type"))


@query("SELECT n_nationkey AS doc_id, concat('- name：', n_name) AS text FROM nation")
def atomic_chunks(s):
    rows = s.nation.select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("- name："), "n_name").alias("text"), F.lit("table_row").alias("content_type"))
    return C.parent_child_chunks(rows).select("doc_id", "text")


def _windows_of_documents(s):
    """Windows of all texts as chunks, three of which have one parent."""
    pieces = C.fixed_window_split(s.documents.select("doc_id", "text"), 350, 50)
    return pieces.select("doc_id", F.col("piece_no").alias("pos"), F.concat_ws("-", F.col("doc_id").cast("string"), F.col("piece_no").cast("string")).alias("chunk_id"), F.concat_ws("-", F.col("doc_id").cast("string"), F.floor(F.col("piece_no") / 3).cast("string")).alias("parent_id"), (F.length("piece") / 2).cast("int").alias("tokens"))


@query("""WITH RECURSIVE x AS (SELECT doc_id, text, unnest(range(0, CAST(ceil(greatest(length(text) - 50, 1) / 300.0) AS BIGINT))) AS pos FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, pos, concat(doc_id, '-', pos) AS chunk_id, pos // 3 AS parent, length(substr(text, CAST(1 + pos * 300 AS BIGINT), 350)) // 2 AS tokens FROM x),
p AS (SELECT doc_id, parent, arg_min(tokens, pos) AS tokens, list(chunk_id) AS ids, row_number() OVER (PARTITION BY doc_id ORDER BY parent) AS n FROM c GROUP BY doc_id, parent),
f AS (SELECT doc_id, n, 0 AS batch_no, tokens AS used FROM p WHERE n = 1
 UNION ALL SELECT p.doc_id, p.n, CASE WHEN f.used + p.tokens > 600 THEN f.batch_no + 1 ELSE f.batch_no END, CASE WHEN f.used + p.tokens > 600 THEN p.tokens ELSE f.used + p.tokens END FROM f JOIN p ON p.doc_id = f.doc_id AND p.n = f.n + 1)
SELECT doc_id, batch_no, count(*) AS parents, array_to_string(list_sort(flatten(list(ids))), ',') AS chunk_ids, sum(tokens)::BIGINT AS tokens FROM f JOIN p USING (doc_id, n) GROUP BY doc_id, batch_no""")
def pack_parents_by_tokens(s):
    return C.pack_parents(_windows_of_documents(s), 600)


@query("""WITH RECURSIVE x AS (SELECT doc_id, text, unnest(range(0, CAST(ceil(greatest(length(text) - 50, 1) / 300.0) AS BIGINT))) AS pos FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, pos, concat(doc_id, '-', pos) AS chunk_id, pos // 3 AS parent, length(substr(text, CAST(1 + pos * 300 AS BIGINT), 350)) // 2 AS tokens FROM x),
g AS (SELECT doc_id, parent, arg_min(tokens, pos) AS tokens, list(chunk_id) AS ids FROM c GROUP BY doc_id, parent),
p AS (SELECT *, row_number() OVER o AS rn, sum(tokens) OVER (o ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM g WINDOW o AS (ORDER BY doc_id, parent)),
hop AS (SELECT rn, CASE WHEN tokens > 4096 THEN rn + 1 ELSE 1 + count(*) OVER (ORDER BY upto RANGE BETWEEN UNBOUNDED PRECEDING AND greatest(4096 - tokens, 0) FOLLOWING) END AS nxt FROM p),
b AS (SELECT min(rn) AS head FROM p HAVING count(*) > 0 UNION ALL SELECT hop.nxt FROM b JOIN hop ON hop.rn = b.head),
s AS (SELECT head, row_number() OVER (ORDER BY head) - 1 AS batch_no, lead(head) OVER (ORDER BY head) AS stop FROM b)
SELECT batch_no, count(*) AS parents, min(doc_id) AS first_doc, max(doc_id) AS last_doc, array_to_string(list_sort(flatten(list(ids))), ',') AS chunk_ids, sum(tokens)::BIGINT AS tokens
FROM s JOIN p ON p.rn >= s.head AND (s.stop IS NULL OR p.rn < s.stop) GROUP BY batch_no""")
def pack_parents_in_order(s):
    return packed_in_order(_windows_of_documents(s))


@query("""WITH d AS (SELECT n.path, CASE WHEN n.doc_id % 3 = 0 THEN 'unchanged' WHEN b.fingerprint = n.fingerprint AND b.schema_version = n.schema_version THEN 'reusable' WHEN b.path IS NOT NULL THEN 'changed' ELSE 'new' END AS status FROM new_manifest n LEFT JOIN base_manifest b ON b.path = n.path)
SELECT b.path, concat('b', doc_id) AS chunk_id, 1::BIGINT AS valid_from_seq, CASE WHEN d.status IN ('unchanged', 'reusable') THEN 0 ELSE 2 END::BIGINT AS valid_to_seq FROM base_manifest b LEFT JOIN d ON d.path = b.path
UNION ALL SELECT n.path, concat('n', n.doc_id), 2, 0 FROM new_manifest n JOIN d ON d.path = n.path WHERE d.status IN ('new', 'changed')""")
def incremental_build(s):
    diff = J.manifest_diff(s.new_manifest, s.new_manifest.where("doc_id % 3 = 0"), s.base_manifest)
    name = lambda p: F.concat(F.lit(p), F.col("doc_id").cast("string")).alias("chunk_id")
    base = s.base_manifest.select("path", name("b"), F.lit(1).cast("long").alias("valid_from_seq"), F.lit(0).cast("long").alias("valid_to_seq"))
    return B.incremental_build(diff, base, s.new_manifest.select("path", name("n")), 2)


@query("SELECT 'v2' AS kb_version, 2::BIGINT AS version_seq, 'activate' AS action FROM (SELECT count(*) FILTER (coalesce(trim(text), '') = '') AS e FROM documents) WHERE e <= 5")
def rebuild_version(s):
    return B.rebuild_version(B.ingestion_report(s.documents, s.faq), {"empty_documents": ("<=", 5.0)}, "v2", 2)


def capitalised(texts):
    """Records of all capitalised words of each text and of each pair of neighbours among them, once a text."""
    out = []
    for t in texts:
        w = [x for x in (t or "").split() if x[:1].isupper() and x.isalpha()]
        out.append("##".join([f'("entity"<|>{x}<|>word<|>{x}' + ")" for x in dict.fromkeys(w)] + [f'("relationship"<|>{a}<|>{b}<|>next<|>{a} then {b}<|>1)' for a, b in dict.fromkeys(zip(w, w[1:], strict=False))]))
    return out


@query()
def build_knowledge_graph(s):
    chunks = s.documents.select("doc_id", F.lit(0).alias("pos"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("parent_id"), F.col("text").alias("parent_content"), (F.length("text") / 4).cast("int").alias("tokens"))
    return B.build_knowledge_graph(chunks, capitalised, ["word"])[2]


@query()
def file_fingerprint(s):
    path = scratch(s.spark, "prints")
    s.documents.select("lang", "text").write.partitionBy("lang").text(path)
    return S.file_inventory(s.spark, path).select("path", "fingerprint")
