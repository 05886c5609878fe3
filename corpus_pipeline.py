"""From raw documents to packed token sequences, in five stages over operators of sparkloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next one's
documents. All but the last keep the columns of documents; n_chars follows the text. Other columns pass through,
whatever their names.

Stages tell rows apart by id and text. Null and empty texts fail the base rules of the first stage; the later stages,
given such a row, keep it (one of a group in near-dedup) and pack it as its end token alone. Rows with null ids are
judged like others, are the last choice of a near-duplicate group, and neither lose nor claim passages. Rows that repeat
an id are rows of their own; equal rows are copies, of which near-dedup keeps one. Very long texts are whole in every
stage. An empty table passes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import packing, pii, quality, simhash, substring
from sparkloom.llm.common import table, unused, written

TOKENIZER = "byte_bpe_50k.json"


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are left with little when boilerplate lines go, are dropped; the lines go
    from the others. The first document of a host that passes the base rules keeps each line (keep_first), so that a
    group of copies does not vanish whole."""
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of near-duplicates, that with the least id: five-word shingles at a Jaccard of
    0.8 or more."""
    return simhash.keep_one_alike(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has too are cut out; what lies around them, line breaks too, stays as
    it is. A document of which nothing is left goes; texts without a word stay."""
    n, gone, left = names = tuple(unused(docs, x) for x in ("n_words", "n_removed", "kept_text"))
    cut = substring.dedup_substrings(docs, layout=True, names=names).where((F.col(gone) < F.col(n)) | (F.col(n) == 0))
    return _sized(cut.withColumn("text", F.col(left)).select(docs.columns))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return _sized(pii.redacted(docs, pii.train(docs)).select(docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids, laid out in sequences of 2048."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("pii_redaction", pii_redaction),
    ("best_fit_packing", best_fit_packing),
]

#: Hashes, a trained field and a tokenizer are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
