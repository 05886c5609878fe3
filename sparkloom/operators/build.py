"""Versioned builds over manifests, chunks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import saved


def ingestion_report(docs: DataFrame, faq: DataFrame) -> DataFrame:
    """One row that rolls up documents and FAQ, with warnings."""
    bare = F.coalesce(F.trim("text"), F.lit(""))
    d = docs.agg(F.count("*").alias("scanned"), F.count_if(bare == "").alias("empty_documents"), F.count_distinct("source").alias("sources"), F.count_if(F.length("text") > 2000).alias("long_chunks"), (F.count("*") - F.count_distinct(F.sha2(bare, 256))).alias("duplicate_chunks"))
    f = faq.agg(F.count("*").alias("faq_rows"), F.count_if(F.trim("question") == "").alias("empty_questions"))
    warnings = F.concat_ws(",", F.when(F.col("duplicate_chunks") > 0, "duplicates"), F.when(F.col("long_chunks") > 10, "long_chunks"))
    return d.crossJoin(f).withColumn("warnings", warnings)  # one row each


def incremental_build(diff: DataFrame, base_chunks: DataFrame, new_chunks: DataFrame, seq: int) -> DataFrame:
    """diff(path, status), base_chunks(path, chunk_id, valid_from_seq, valid_to_seq), new_chunks(path, chunk_id) of changed
    and new files → the chunk table after version ``seq``: reused windows stay open, those of changed and vanished files
    close, new ones open."""
    keep = diff.where("status IN ('unchanged', 'reusable')").select("path").withColumn("keep", F.lit(True))
    old = base_chunks.join(keep, "path", "left")
    closed = F.when(F.col("keep") | (F.col("valid_to_seq") != 0), F.col("valid_to_seq")).otherwise(F.lit(seq).cast("long"))
    old = old.select("path", "chunk_id", "valid_from_seq", closed.alias("valid_to_seq"))
    fresh = new_chunks.join(diff.where("status IN ('new', 'changed')").select("path"), "path", "left_semi")
    return old.unionByName(fresh.select("path", "chunk_id", F.lit(seq).cast("long").alias("valid_from_seq"), F.lit(0).cast("long").alias("valid_to_seq")))


def rebuild_version(report: DataFrame, limits: dict, version: str, seq: int) -> DataFrame:
    """The activation row of a version whose quality report passes its limits; no row if it fails."""
    from .evaluation import gate, long_metrics

    bad = gate(long_metrics(report, list(limits)), limits).agg(F.count("*").alias("failures"))
    return bad.where("failures = 0").select(F.lit(version).alias("kb_version"), F.lit(seq).cast("long").alias("version_seq"), F.lit("activate").alias("action"))


def build_knowledge_graph(chunks: DataFrame, extract, types: list[str], pack_limit: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chunks(doc_id, pos, chunk_id, parent_id, parent_content, tokens) → entities, relations, communities.

    Parents are packed into batches, ``extract`` (a batch function from texts to responses) runs on each batch's text,
    records are parsed, aliases merged, and communities found. Names are aliases where all are alike to one of them
    (``alias_clusters``); chains of likeness do not merge.
    """
    import pandas as pd

    from . import graph as G

    parents = chunks.groupBy("doc_id", "parent_id").agg(F.min("pos").alias("pos"), F.first("parent_content").alias("text"), F.first("tokens").alias("tokens"))
    from .chunking import pack_parents

    batches = pack_parents(parents.withColumn("chunk_id", F.col("parent_id")), pack_limit).select("doc_id", "batch_no", F.explode(F.split("chunk_ids", ",")).alias("parent_id"))
    texts = batches.join(parents, ["doc_id", "parent_id"]).groupBy("doc_id", "batch_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    texts = texts.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("batch_no").cast("string")).alias("batch_id"), "text")

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"batch_id": pdf["batch_id"], "response": list(extract(pdf["text"].tolist()))})

    responses = saved(texts.mapInPandas(run, "batch_id string, response string"), "responses")
    entities, relations = G.parse_extraction_records(responses, types)
    pairs, numbers = G.numbered_pairs(entities, spelled=True)
    canonical = saved(G.canonical_names(G.clusters_by_number(pairs, numbers)), "canonical")
    at = lambda d: d.withColumn("pos", F.concat_ws("#", "batch_id", F.lpad(F.col("pos").cast("string"), 6, "0")))
    merged = G.rewrite_aliases(at(entities), at(relations), canonical)[0]
    names = saved(numbers.join(canonical, "name", "left").select("name", F.coalesce("canonical", "name").alias("canonical")), "merged-names")
    edges = G.redirect_relations(at(relations), names)  # not stored: communities need but three of its columns
    return merged, edges, G.detect_communities(edges)
