"""Evaluation rows, gates, bad cases and reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_metrics(wide: DataFrame, metrics: list[str], keys: list[str] = ()) -> DataFrame:
    """Metric columns as rows (keys, metric, value)."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return wide.select(*keys, F.inline(each))


def gate(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """Metric rows that are missing or break a limit (operator, value). The limits are a handful of rows and broadcast."""
    spark = metrics.sparkSession
    dim = spark.createDataFrame([(m, op, float(v)) for m, (op, v) in limits.items()], "metric string, op string, threshold double")
    rows = metrics.join(F.broadcast(dim), "metric")
    good = F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold") - 1e-9).when(F.col("op") == "<=", F.col("value") <= F.col("threshold") + 1e-9).otherwise(F.abs(F.col("value") - F.col("threshold")) <= 1e-9)
    return rows.where(~F.coalesce(good, F.lit(False)))


#: Default limits.
EVALUATION_LIMITS = {"recall_at_k": (">=", 0.8), "mrr": (">=", 0.6), "keyword_coverage": (">=", 0.7), "error_rate": ("<=", 0.0), "mean_ms": ("<=", 60000.0)}
PERFORMANCE_LIMITS = {"mean_ms": ("<=", 15000.0), "p95_ms": ("<=", 30000.0), "mean_first_ms": ("<=", 8000.0), "p95_first_ms": ("<=", 15000.0), "error_rate": ("<=", 0.0)}
FOLLOWUP_LIMITS = {"rewrite_rate": (">=", 0.5), "source_accuracy": (">=", 0.8), "isolation": ("=", 1.0)}
INGESTION_LIMITS = {"empty_documents": ("<=", 0.0), "duplicate_chunks": ("<=", 5.0), "short_chunks": ("<=", 10.0), "empty_questions": ("<=", 0.0), "repeated_questions": ("<=", 0.0), "table_like": ("<=", 20.0), "ocr_risk": ("<=", 0.0)}


def failure_reasons(row_error: Column, flags: dict[str, Column], coverage: Column, least: float) -> Column:
    """Reasons of a row in order: an error, each flag that is false (null is no failure), coverage below the limit."""
    parts = [F.when(F.coalesce(row_error, F.lit("")) != "", "request_error"), *[F.when(c == False, name) for name, c in flags.items()], F.when(coverage < least, "low_keyword_coverage")]  # noqa: E712
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def select_bad_cases(rows: DataFrame, reasons: Column, limit: int) -> DataFrame:
    return rows.withColumn("reasons", reasons).where(F.size("reasons") > 0).orderBy("case_id").limit(limit)


def feedback_bad_cases(feedback: DataFrame) -> DataFrame:
    """feedback(id, rating, question, sources array<string>, answer) that is not useful → cases."""
    first = F.get(F.filter(F.transform("sources", lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), 0)
    return feedback.where("rating = 'not_useful'").select(F.concat(F.lit("feedback-"), F.col("id").cast("string")).alias("case_id"), F.col("question").alias("query"), first.alias("observed_source"), F.substring("answer", 1, 500).alias("answer_preview"), F.array(F.lit("negative_feedback")).alias("reasons"))


def promote_cases(cases: DataFrame, target: DataFrame, conflict: str = "skip") -> DataFrame:
    """Reviewed cases with ids and queries trimmed, without blank ones, merged into the target."""
    from .sets import merge_cases

    rows = cases.withColumn("case_id", F.lower(F.regexp_replace(F.trim("case_id"), r"[^A-Za-z0-9_-]+", "-"))).withColumn("query", F.trim("query")).where("case_id <> '' AND query <> ''")
    return merge_cases(target, rows.dropDuplicates(["case_id"]), conflict)


def policy_checks(cases: DataFrame) -> DataFrame:
    """cases(case_id, critical, route, intent, score, tags, expected_*) → checks as an array of (name, passed)."""
    c = lambda name, expected, ok: F.when(F.col(expected).isNotNull(), F.struct(F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("passed")))
    checks = F.array(
        c("route", "expected_route", F.col("route") == F.col("expected_route")), c("intent_any", "expected_intents", F.array_contains("expected_intents", F.col("intent"))),
        c("score_min", "expected_min", F.col("score") >= F.col("expected_min") - 1e-6), c("score_max", "expected_max", F.col("score") <= F.col("expected_max") + 1e-6), c("tag", "expected_tag", F.array_contains("tags", F.col("expected_tag"))),
    )
    return cases.select("case_id", "critical", F.filter(checks, lambda x: x.isNotNull()).alias("checks"))


def judge_dataset(rows: DataFrame, max_contexts: int = 3) -> tuple[DataFrame, DataFrame]:
    """rows(case_id, question, answer, contexts, reference, error) → (rows to judge, rows left out with a reason)."""
    contexts = F.slice(F.filter(F.transform("contexts", lambda x: F.trim(x)), lambda x: x != ""), 1, max_contexts)
    rows = rows.withColumn("contexts", contexts)
    why = F.when(F.coalesce("error", F.lit("")) != "", "error").when(F.trim("answer") == "", "no_answer").when(F.size("contexts") == 0, "no_context")
    rows = rows.withColumn("reason", why)
    return rows.where("reason IS NULL").select("case_id", "question", "answer", "contexts", "reference"), rows.where("reason IS NOT NULL").select("case_id", "reason")


def judge_score_summary(scores: DataFrame, metrics: list[str]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).try_cast("double").alias("v")) for m in metrics])
    rows = scores.select(F.inline(each)).where("v IS NOT NULL AND NOT isnan(v)")
    return rows.groupBy("metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.count("*").alias("n"))


def readiness_gate(parts: list[DataFrame], limits: dict[str, tuple[str, float]]) -> DataFrame:
    """Several metric tables in one verdict: ok, and what failed."""
    every = reduce(DataFrame.unionByName, parts)
    bad = gate(every, limits)
    return bad.agg(F.count("*").alias("failures"), F.array_join(F.array_sort(F.collect_list("metric")), ",").alias("failed")).withColumn("ok", F.col("failures") == 0)


def validate_scenarios(dim: DataFrame, folders: DataFrame) -> DataFrame:
    """dim(scenario_id, source, label, pattern, collection) and folders(scenario_id, source) → issue rows."""
    repeated = dim.groupBy("scenario_id", "source").agg(F.count("*").alias("n")).where("n > 1").select("scenario_id", "source", F.lit("repeated_source").alias("issue"))
    shared = dim.groupBy("collection").agg(F.count_distinct("scenario_id").alias("n")).where("n > 1").select("collection")
    clash = dim.join(shared, "collection").select("scenario_id", F.lit(None).cast("string").alias("source"), F.lit("shared_collection").alias("issue")).distinct()
    blank = dim.where("label IS NULL OR trim(label) = ''").select("scenario_id", "source", F.lit("missing_label").alias("issue"))
    bare = dim.where("pattern IS NULL OR trim(pattern) = ''").select("scenario_id", "source", F.lit("missing_pattern").alias("issue"))
    unknown = folders.join(dim, ["scenario_id", "source"], "left_anti").select("scenario_id", "source", F.lit("unknown_source").alias("issue"))
    empty = dim.join(folders, ["scenario_id", "source"], "left_anti").select("scenario_id", "source", F.lit("empty_folder").alias("issue"))
    return reduce(DataFrame.unionByName, [repeated, clash, blank, bare, unknown, empty]).distinct()


def promote_reviewed(candidates: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """candidates(path, reviewed, confidence) against existing(path) → promoted or blocked, with a reason."""
    rows = candidates.join(existing.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    reason = F.when(~F.col("reviewed"), "not_reviewed").when(F.col("there") & F.lit(not force), "target_exists")
    return rows.select("path", F.when(reason.isNull(), "promoted").otherwise("blocked").alias("status"), reason.alias("reason"))


def ocr_confidence_rollup(lines: DataFrame, least: float = 0.85) -> DataFrame:
    """lines(doc, page, confidence) → documents: mean of page means, weighted by lines; ready if it reaches the limit."""
    pages = lines.groupBy("doc", "page").agg(F.avg("confidence").alias("m"), F.count("*").alias("n"))
    rows = pages.groupBy("doc").agg(F.count("*").alias("pages"), F.sum("n").alias("lines"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("c"))
    return rows.select("doc", "pages", "lines", F.round("c", 6).alias("confidence"), (F.round("c", 6) >= least).alias("ready"))
