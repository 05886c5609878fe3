"""Queries of the streaming jobs: each reads a given table as a stream to its end and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.files import current_view
from ..streaming import jobs as J
from .context import query, scratch


def _stream(s, name: str):
    return J.read_stream(s.spark, f"{s.sf_dir}/{name}.parquet")


def _sunk(s, rows, mode: str = "append"):
    out, schema = scratch(s.spark, "sink"), rows.schema
    J.run_available(rows.writeStream.format("parquet").outputMode(mode).option("path", out), scratch(s.spark, "state"))
    return s.spark.read.schema(schema).parquet(out)


@query("SELECT doc_id AS key, sha256(concat(source, '||', coalesce(text, ''))) AS payload FROM documents")
def stream_ingest_files(s):
    log = scratch(s.spark, "log")
    J.ingest_files(_stream(s, "documents"), log, scratch(s.spark, "state"))
    return current_view(s.spark.read.parquet(log))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2)
SELECT start::TIMESTAMP AS start, (start + INTERVAL 10 MINUTE)::TIMESTAMP AS "end", event_type, n, mean FROM w WHERE start + INTERVAL 10 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_request_metrics(s):
    out = _sunk(s, J.request_metrics(_stream(s, "events").select("ts", "event_type", "value")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", "mean")


_KEPT = "list_filter(f.kept, lambda x: x > e.t - 3600000000)"


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS client, event_id AS id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events),
f AS (SELECT client, id, n, true AS accepted, [t] AS kept FROM e WHERE n = 1
 UNION ALL SELECT e.client, e.id, e.n, len({_KEPT}) < 3, CASE WHEN len({_KEPT}) < 3 THEN list_append({_KEPT}, e.t) ELSE {_KEPT} END FROM f JOIN e ON e.client = f.client AND e.n = f.n + 1)
SELECT client, id, accepted FROM f""")
def stream_rate_limit(s):
    rows = _stream(s, "events").select(F.col("user_id").alias("client"), F.unix_micros("ts").alias("at"), F.col("event_id").alias("id"))
    return _sunk(s, J.rate_limit(rows, 3, 3600))


@query("SELECT user_id AS session_id, count(*) - 8 AS due FROM events GROUP BY 1 HAVING count(*) > 14")
def stream_session_summary_due(s):
    log = scratch(s.spark, "sessions")
    J.session_counts(_stream(s, "events").select(F.col("user_id").alias("session_id")), log, scratch(s.spark, "state"))
    return J.summary_due(s.spark.read.parquet(log))


@query()
def stream_ttl_dedup(s):
    rows = _stream(s, "events").select("event_id", "ts", "user_id", "event_type", (F.col("event_id") % 3).alias("epoch"))
    return _sunk(s, J.ttl_dedup(rows, ["user_id", "event_type", "epoch"], "6 hours"))


@query("SELECT concat('feedback-', event_id) AS case_id, concat('scn', user_id % 5) AS scenario, props FROM events WHERE event_type = 'error'")
def stream_feedback_bad_cases(s):
    dim = s.events.select((F.col("user_id") % 5).alias("user_group")).distinct().select("user_group", F.concat(F.lit("scn"), F.col("user_group").cast("string")).alias("scenario"))
    rows = _stream(s, "events").withColumn("user_group", F.col("user_id") % 5)
    return _sunk(s, J.feedback_cases(rows, dim))


_LOG = "SELECT event_id AS log_id, user_id % 8 AS scenario_id, event_id % 6 + 1 AS version_seq, ts AS activated_at FROM events WHERE event_type = 'error'"


@query(f"""WITH l AS ({_LOG}), i AS (SELECT scenario_id, version_seq, activated_at AS start, lead(activated_at) OVER (PARTITION BY scenario_id ORDER BY activated_at, log_id) AS stop FROM l)
SELECT event_id AS id, e.scenario_id, version_seq FROM (SELECT event_id, user_id % 8 AS scenario_id, ts FROM events) e JOIN i ON e.scenario_id = i.scenario_id AND ts >= start AND (stop IS NULL OR ts < stop)""")
def stream_active_version_join(s):
    log = s.events.where("event_type = 'error'").select(F.col("event_id").alias("log_id"), (F.col("user_id") % 8).alias("scenario_id"), (F.col("event_id") % 6 + 1).alias("version_seq"), F.col("ts").cast("timestamp").alias("activated_at"))
    rows = _stream(s, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 8).alias("scenario_id"), "ts")
    return _sunk(s, J.active_version_join(rows, J.active_intervals(log)))
