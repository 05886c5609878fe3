"""A corpus of files: a file for each row, read by a bounded number of tasks."""

from pyspark.sql import functions as F

from sparkloom.plans.catalog import QUERIES
from sparkloom.sources import files as S


def test_every_row_is_a_file(spark, tmp_path):
    """Rows that share an id are files of their own; they were lines of one file, and one row."""
    rows = [(1, "one\n"), (1, "two"), (2, "  \n "), (3, None), (4, "three\r\nlines\n\nhere\n"), (5, "é 中")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.h) for r in QUERIES["read_text_corpus"](spark, str(tmp_path)).collect())
    want = spark.createDataFrame([(i, t.rstrip("\n")) for i, t in rows if t and t.strip()], "doc_id long, text string")
    assert got == sorted((r.doc_id, r.h) for r in want.select("doc_id", F.sha2("text", 256).alias("h")).collect())


def test_small_files_share_tasks(spark, tmp_path):
    most = S.READERS * spark.sparkContext.defaultParallelism
    for i in range(most + 40):
        (tmp_path / f"{i}.txt").write_text(f"text {i}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # what Spark reckons for opening one
    try:
        rows = S.read_text_corpus(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() <= most and rows.count() == most + 40
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
