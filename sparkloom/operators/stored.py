"""Intermediate tables in the folder that executors share: they cut lineage and outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a session on one machine gets a temporary folder;
    a cluster gets an error, for its executors could not read each other's."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows and bytes of an Arrow batch, so that a Python worker holds a bounded piece of its partition.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


def batches_bounded(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches that Python workers get (whole rows: a longer text is a batch of its own)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """The table marked for broadcast if it has at most ``most`` rows; a larger one as it is, for an ordinary join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def only_few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """As ``few``, for a side of a join without an equality: more rows are an error, for no ordinary join takes them."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} rows on the small side of a join without an equality")
    return F.broadcast(df)


#: Spark's setting to remove an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The table written as Parquet and read again. What the write shuffled is removed at its end: nothing reads it again,
    and rounds of such tables would otherwise keep the shuffles of all rounds on disk until the driver collects garbage."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
