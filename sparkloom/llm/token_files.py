"""Operator 3: token ids in ORC files, written in ascending document order and read back.

Texts, not ids, are shuffled: a range partitioning on id and a hash of the text deals them out, each task sorts its range, encodes it and
streams it into ORC stripes. ORC stores the id lists with its integer run-length encoding; a row index holds the least
and largest document id of every ``row_index_stride`` rows, and Bloom filters on the document id let a lookup skip
stripes. Readers take one stripe or more each. Where a document's ids start in the whole sequence follows from sums
over files and running sums within a file.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_tokens import ByteTokens
from .common import bounded, scratch, table, written

#: Bytes of text meant for one file, and the ORC layout.
FILE_BYTES = 64 << 20
ORC = {"orc.stripe.size": str(16 << 20), "orc.row.index.stride": "2000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs → (doc_id, ids array<int>): the ids of the whole text and ``end_id``. A null text is an empty one."""

    def run(batches):
        tokens = ByteTokens.load(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                ids, starts = tokens.encode(texts[at : at + 500], end_id)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.view(np.int32)))], names=["doc_id", "ids"])

    bounded(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes (doc_id, ids, place) as ORC in ascending doc_id order: by file name, and by place within a file.

    Rows of equal ids follow each other by a hash of their text and the text itself, so the order is that of the data,
    however the table is split; where they are many they go over several files. Null ids come first; a null or empty text is
    ``end_id`` alone; a text of any length is one row, so a very long one makes its stripe larger; an empty table gives
    files without rows. Other columns are not read, whatever their names.
    """
    if files is None:
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        files = int(max(12, -(-size // FILE_BYTES)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    dealt = rows.repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    # a task writes one file, so a row's number in its task is its place there
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    encode_documents(dealt, tokenizer, end_id).withColumn("place", place).write.options(**ORC).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a token store; filters on doc_id reach stripes through row indexes and Bloom filters."""
    return bounded(spark).read.schema("doc_id long, ids array<int>, place long").orc(path)


def file_number(name: Column) -> Column:
    """The number in a file's name, part-00007-… or part-100000-…."""
    return F.regexp_extract(name, r"^part-(\d+)", 1).cast("long")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a token store, from its files alone.

    start counts the ids of all documents before it: sums of the files before, of which there are few rows, and a
    running sum over the narrow rows of its own file. Files are in the order of the numbers in their names, however
    many digits these have, and documents in that of their places, so ``start`` cuts the ids of a document out of all ids.
    """

    def run(batches):
        for batch in batches:
            ids, stops = batch.column(1), batch.column(1).offsets.to_numpy()
            data = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.diff(stops).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "file", "place", "n_tokens", "ids_crc32"])

    rows = read_token_files(spark, path).select("doc_id", "ids", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "place")
    rows = rows.mapInArrow(run, "doc_id long, file string, place long, n_tokens long, ids_crc32 long")
    rows = written(rows.withColumn("file", file_number(F.col("file"))), "token-digests")  # read once, used twice
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("part", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(base, "file")
        .select("doc_id", (F.col("base") + F.col("part")).alias("start"), "n_tokens", "ids_crc32")
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digests(spark, path)
