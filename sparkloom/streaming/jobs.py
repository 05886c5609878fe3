"""Structured Streaming jobs: arriving documents, request metrics, rate limits, sessions, deduplication, feedback."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.stored import few
from ..sources.files import append_changes


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream with the schema of what is there; timestamps without a zone
    are cast."""
    there = spark.read.parquet(path)
    schema, (folder, name) = there.schema, path.rstrip("/").rsplit("/", 1)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if any(f.endswith(f"/{name}") for f in there.inputFiles()):  # one file: its folder, filtered by its name
        reader, path = reader.option("pathGlobFilter", name), folder
    rows = reader.parquet(path)
    return rows.select([F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema])


def run_available(writer, checkpoint: str) -> None:
    """Starts the query over all that is there and waits for its end."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_files(docs: DataFrame, log: str, checkpoint: str) -> None:
    """docs(doc_id, text, ...) as a stream → a change log keyed by document. A replayed batch has the same batch id and
    leaves the current view as it is."""

    def land(batch: DataFrame, batch_id: int) -> None:
        append_changes(batch.select(F.col("doc_id").alias("key"), F.lit(batch_id).alias("batch_id"), F.lit("upsert").alias("op"), T.stable_hash("source", "text").alias("payload")), log)

    run_available(docs.writeStream.foreachBatch(land), checkpoint)


def request_metrics(traces: DataFrame, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """traces(ts, event_type, value) → count, errors and mean per closed window and kind."""
    rows = traces.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "mean")


def rate_limit(requests: DataFrame, limit: int, seconds: int = 60, late: str = "1 day") -> DataFrame:
    """requests(client, at long microseconds, id) → (client, id, accepted): at most ``limit`` accepted within the span
    before a request; refused ones do not count. A client's state is the times of its accepted requests in the span; it
    goes when the watermark, ``late`` behind the latest request, has passed the span after the last of them."""
    span = seconds * 1_000_000

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "id"], kind="stable")
        verdict = []
        for at in rows["at"].tolist():
            kept = [t for t in kept if t > at - span]
            yes = len(kept) < limit
            if yes:
                kept.append(at)
            verdict.append(yes)
        state.update((kept,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, ((kept[-1] if kept else 0) + span) // 1000 + 1))
        yield pd.DataFrame({"client": rows["client"], "id": rows["id"], "accepted": verdict})

    timed = requests.withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", late)
    return timed.groupBy("client").applyInPandasWithState(run, "client long, id long, accepted boolean", "kept array<long>", "append", "EventTimeTimeout")


def session_counts(messages: DataFrame, log: str, checkpoint: str) -> None:
    """messages(session_id) as a stream → a log of how many messages each batch brought a session. Nothing is kept as
    state, so a session that is idle for ever costs nothing; a batch that is run again writes over its own rows."""

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("session_id").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")

    run_available(messages.select("session_id").writeStream.foreachBatch(land), checkpoint)


def summary_due(log: DataFrame, after: int = 14, recent: int = 8) -> DataFrame:
    """Sessions past ``after`` messages, and how many of them, all but the ``recent`` last, are due for a summary. The
    log's rows of a session add up."""
    now = log.groupBy("session_id").agg(F.sum("n").alias("n"))
    return now.where(F.col("n") > after).select("session_id", (F.col("n") - recent).alias("due"))


def ttl_dedup(events: DataFrame, keys: list[str], ttl: str = "10 minutes") -> DataFrame:
    """The first event of each key within the span of the watermark; keys hold the epoch, so a new one starts anew."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def feedback_cases(feedback: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Feedback that is not useful, joined with the scenario dimension as it streams."""
    bad = feedback.where("event_type = 'error'")
    return bad.join(few(scenarios), "user_group").select(F.concat(F.lit("feedback-"), F.col("event_id").cast("string")).alias("case_id"), "scenario", "props")


def active_intervals(log: DataFrame) -> DataFrame:
    """activations(scenario_id, version_seq, activated_at, log_id) → [start, stop) of each, an open stop is null."""
    w = Window.partitionBy("scenario_id").orderBy("activated_at", "log_id")
    return log.select("scenario_id", "version_seq", F.col("activated_at").alias("start"), F.lead("activated_at").over(w).alias("stop"))


def active_version_join(requests: DataFrame, intervals: DataFrame, bucket: int = 86_400) -> DataFrame:
    """requests(id, scenario_id, ts), a stream or a table → the version that was active then.

    Closed intervals are listed under every ``bucket`` of seconds that they touch, and a request meets those of its own
    bucket; the open one, a row for each scenario, takes what came after the last change."""
    at = lambda t: F.floor(F.unix_seconds(t) / bucket)
    closed = intervals.where("stop IS NOT NULL AND start < stop")
    closed = closed.select(F.col("scenario_id").alias("__s"), F.explode(F.sequence(at(F.col("start")), at(F.col("stop")))).alias("__b"), "start", "stop", F.col("version_seq").alias("__v"))
    last = intervals.where("stop IS NULL").select(F.col("scenario_id").alias("__o"), F.col("start").alias("__from"), F.col("version_seq").alias("__w"))
    on = (F.col("scenario_id") == F.col("__s")) & (at(F.col("ts")) == F.col("__b")) & (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("stop"))
    rows = requests.join(closed, on, "left").join(last, (F.col("scenario_id") == F.col("__o")) & (F.col("ts") >= F.col("__from")), "left")
    return rows.select("id", "scenario_id", F.coalesce("__v", "__w").alias("version_seq")).where("version_seq IS NOT NULL")
