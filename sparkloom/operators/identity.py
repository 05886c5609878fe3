"""Identity, metadata and projection operators over chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def stamp_metadata(docs: DataFrame, kb_version: str, version_seq: int, tenant: Column | None = None, dataset: Column | None = None, visibility: Column | None = None, roles: Column | None = None, schema_version: str = "v1", model_version: str = "m1") -> DataFrame:
    """Adds scope, version window and file columns to loaded documents with (path, source, scenario_id, text)."""
    name = F.element_at(F.split("path", "/"), -1)
    return docs.withColumns({
        "tenant_id": tenant if tenant is not None else F.lit("default"), "dataset_id": dataset if dataset is not None else F.lit("default"), "visibility": visibility if visibility is not None else F.lit("public"),
        "allowed_roles": T.clean_roles(roles if roles is not None else F.array().cast("array<string>")), "kb_version": F.lit(kb_version), "valid_from_seq": F.lit(version_seq).cast("long"), "valid_to_seq": F.lit(0).cast("long"),
        "embedding_model_version": F.lit(model_version), "chunk_schema_version": F.lit(schema_version), "file_name": name,
        "file_type": F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)), "source": F.coalesce(F.nullif(F.col("source"), F.lit("")), T.source_from_path("path")),
    })


def chunk_identity(chunks: DataFrame) -> DataFrame:
    """Adds parent_id and chunk_id: hashes of scope, versions, document and text; table rows use table, sheet and row."""
    scope = ["scenario_id", "tenant_id", "dataset_id", "source", "embedding_model_version", "chunk_schema_version", "doc_id"]
    table = F.col("content_type") == "table_row"
    parent = F.when(table, T.stable_hash(*scope, "table_id", "sheet_name", "row_number")).otherwise(T.stable_hash(*scope, "parent_content"))
    return chunks.withColumn("parent_id", parent).withColumn("chunk_id", F.when(table, T.stable_hash(F.lit("row"), "parent_id")).otherwise(T.stable_hash("parent_id", "text")))


def document_key(chunk_id: Column, faq_id: Column, text: Column) -> Column:
    return F.coalesce(T.first_filled(chunk_id, faq_id), F.substring(text, 1, 120))


def source_signature(*fields: Column) -> Column:
    return F.substring(F.coalesce(T.first_filled(*fields), F.lit("")), 1, 160)


def source_payload(hits: DataFrame, limit: int = 5) -> DataFrame:
    """hits(query_id, rank, text, citation, is_table, table_id, sheet_name, row_number, ...) → the first ``limit`` as payloads."""
    place = F.when(F.col("is_table"), F.struct("table_id", "sheet_name", "row_number"))
    return hits.where(F.col("rank") <= limit).select("query_id", "rank", F.substring("text", 1, 500).alias("preview"), "citation", place.alias("locator"))


def faq_snapshot(faq: DataFrame, kb_version: str, scenario_id: str = "faq") -> DataFrame:
    """faq(pos, source, question, answer) → snapshot records. An id that an earlier row has takes the answer in as well;
    a second clash is dropped."""
    first = T.stable_hash(F.lit(scenario_id), F.lit(kb_version), "source", "question")
    rows = faq.withColumn("first_id", first).withColumn("n", F.row_number().over(Window.partitionBy("first_id").orderBy("pos")))
    rows = rows.withColumn("faq_id", F.when(F.col("n") == 1, F.col("first_id")).otherwise(T.stable_hash(F.lit(scenario_id), F.lit(kb_version), "source", "question", "answer")))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("faq_id").orderBy("pos"))).where("k = 1")
    return rows.select("faq_id", "pos", "source", "question", "answer", F.lit(kb_version).alias("kb_version"))


def normalize_table_headers(raw: DataFrame) -> DataFrame:
    """Drops rows and columns without a value, makes nulls empty, and names blank or "unnamed" headers by place."""
    filled = raw.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(raw.columns)]).first()
    kept = [(i, c) for i, c in enumerate(raw.columns) if filled[i]]
    named = [F.col(f"`{c}`").cast("string").alias(f"column_{k}" if not c.strip() or c.lower().startswith(("unnamed", "_c")) else c.strip()) for k, (i, c) in enumerate(kept, 1)]
    return raw.na.drop("all").select(*named).na.fill("")


def citation_footer(answers: DataFrame) -> DataFrame:
    """answers(answer, docs array<struct<label, is_table, cells array<struct<key,value>>>>) → with ``cited``: cells that
    the answer lacks, of the first such table row, and a list of sources where no [n] stands in the answer."""
    lacking = F.filter(F.transform("docs", lambda d, i: F.struct(d["is_table"].alias("t"), d["cells"].alias("cells"), (i + 1).alias("n"))), lambda d: d["t"] & F.exists(d["cells"], lambda c: ~F.contains(F.col("answer"), c["value"])))
    detail = F.when(F.size(lacking) > 0, T.let(F.get(lacking, 0), lambda d: F.concat(F.lit("\n\n表格行要点："), F.array_join(F.transform(F.slice(d["cells"], 1, 6), lambda c: F.concat(c["key"], F.lit("："), c["value"])), "；"), F.lit(" ["), d["n"].cast("string"), F.lit("]"))))
    body = F.concat("answer", F.coalesce(detail, F.lit("")))
    footer = F.array_join(F.transform("docs", lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), d["label"])), "\n")
    return answers.withColumn("__body", body).withColumn("cited", F.when(F.col("__body").rlike(r"\[[0-9]+\]") | (F.size("docs") == 0), F.col("__body")).otherwise(F.concat("__body", F.lit("\n\n来源：\n"), footer))).drop("__body")
