"""Quality, evaluation, latency and threshold aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_quality_issues(chunks: DataFrame, parent_size: int = 1000) -> DataFrame:
    """chunks(chunk_id, text, is_table) → (chunk_id, issue). Empty stops further checks; tables are not short or poor."""
    t = F.coalesce("text", F.lit(""))
    n = F.length(t)
    unique = F.size(F.array_distinct(F.split(t, ""))) / n
    keyed = chunks.withColumn("__h", F.sha2(F.trim(t), 256))
    twice = keyed.groupBy("__h").agg(F.count("*").alias("__n")).where("__n > 1")  # combines before the shuffle, however large a group
    rows = keyed.join(twice, "__h", "left")
    empty = F.trim(t) == ""
    free = ~empty & ~F.col("is_table")
    issues = F.array(
        F.when(empty, "empty"), F.when(free & (n < 30), "too_short"), F.when(~empty & (n > max(2 * parent_size, 2000)), "too_long"),
        F.when(free & (n >= 50) & (unique < 0.08), "low_unique_ratio"), F.when(~empty & F.col("__n").isNotNull(), "duplicate_content"),
    )
    return rows.select("chunk_id", F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("issue"))


def chunk_quality_stats(chunks: DataFrame, issues: DataFrame) -> DataFrame:
    n = F.length(F.coalesce("text", F.lit("")))
    one = chunks.agg(F.count("*").alias("chunks"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.round(F.avg(n), 6).alias("avg_length"))
    two = issues.agg(F.count("*").alias("issues"), F.count_if(F.col("issue") == "duplicate_content").alias("duplicates"))
    return one.crossJoin(two)  # one row each


def faq_quality(faq: DataFrame, valid: DataFrame) -> DataFrame:
    """Per source: rows, empty questions and answers, questions seen before in the whole table, unknown sources."""
    q, a = F.trim(F.coalesce("question", F.lit(""))), F.trim(F.coalesce("answer", F.lit("")))
    # all rows of a question but the first repeat it; its first row is a minimum, which combines before the shuffle
    first = faq.where(q != "").groupBy(q.alias("q")).agg(F.min(F.struct("pos", "source")).alias("f")).groupBy(F.col("f.source").alias("source")).agg(F.count("*").alias("firsts"))
    per = faq.groupBy("source").agg(F.count("*").alias("rows"), F.count_if(q == "").alias("empty_questions"), F.count_if(a == "").alias("empty_answers"))
    known = valid.select("source").distinct().withColumn("ok", F.lit(True))
    per = per.join(first, "source", "left").join(known, "source", "left").withColumn("firsts", F.coalesce("firsts", F.lit(0)))
    invalid = F.when(F.col("ok").isNull(), F.col("rows")).otherwise(0).alias("invalid_source")
    return per.select("source", "rows", "empty_questions", "empty_answers", (F.col("rows") - F.col("empty_questions") - F.col("firsts")).alias("repeated_questions"), invalid)


def ingest_stats(diff: DataFrame, expired: DataFrame) -> DataFrame:
    by = diff.groupBy("source").agg(F.count_if(F.col("status").isin("new", "changed")).alias("reembedded"), F.count_if(F.col("status") == "reusable").alias("reused"), F.count_if(F.col("status") == "unchanged").alias("skipped"))
    return by.join(expired.groupBy("source").agg(F.count("*").alias("expired")), "source", "full").na.fill(0)


def version_ingest_counters(log: DataFrame) -> DataFrame:
    """log(kb_version, content_type, source, count, at, id) → last count, runs, total and sources of each."""
    return log.groupBy("kb_version", "content_type").agg(F.max_by("count", F.struct("at", "id")).alias("last_count"), F.count("*").alias("runs"), F.sum("count").alias("total"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def keyword_coverage(answer: Column, keywords: Column) -> Column:
    """The share of keywords in the answer, 0 if none is expected."""
    hit = F.size(F.filter(keywords, lambda k: F.contains(answer, k)))
    return F.when(F.size(keywords) == 0, 0.0).otherwise(hit / F.size(keywords))


#: Means of evaluation flags: over annotated rows; coverage over all rows.
def eval_metrics() -> list[Column]:
    share = lambda c: F.avg(F.col(c).cast("double"))
    mrr = F.avg(F.when(F.col("source_recall_hit").isNotNull(), F.coalesce(1 / F.col("expected_source_rank"), F.lit(0.0))))
    z = F.lit(0.0)
    return [F.round(x, 6).alias(n) for n, x in (
        ("recall_at_k", F.coalesce(share("source_recall_hit"), z)), ("mrr", F.coalesce(mrr, z)), ("keyword_coverage", F.avg(F.coalesce("keyword_coverage", z))),
        ("confidence", F.coalesce(F.avg("confidence_score"), z)), ("hit_type_accuracy", F.coalesce(share("hit_type_matched"), z)), ("source_accuracy", F.coalesce(share("effective_source_matched"), F.lit(1.0))),
        ("profile_accuracy", F.coalesce(share("prompt_profile_matched"), F.lit(1.0))), ("error_rate", F.avg((F.coalesce("error", F.lit("")) != "").cast("double"))), ("mean_ms", F.avg("elapsed_ms")),
    )] + [F.count("*").alias("cases")]


def eval_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(*eval_metrics())


def eval_by_group(rows: DataFrame) -> DataFrame:
    """The same per scenario, source, hit type and in all, in one pass over grouping sets."""
    names = ["scenario_id", "source", "hit_type"]
    rows = rows.withColumn("hit_type", F.coalesce(F.nullif("hit_type", F.lit("")), F.lit("unknown")))
    c = [F.col(n) for n in names]
    return rows.groupingSets([[c[0]], [c[1]], [c[2]], []], *c).agg(*eval_metrics())


def distribution(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) of several columns in one pass; null and blank count as unknown."""
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("unknown")).alias("value")) for c in columns])
    return rows.select(F.inline(each)).groupBy("field", "value").agg(F.count("*").alias("n"))


def followup_summary(turns: DataFrame) -> DataFrame:
    late = turns.where("turn > 1")
    return late.agg(F.count("*").alias("turns"), F.round(F.avg(F.col("rewritten").cast("double")), 6).alias("rewrite_rate"), F.round(F.avg(F.col("effective_source_matched").cast("double")), 6).alias("source_accuracy"), F.round(F.avg(F.col("in_scenario").cast("double")), 6).alias("isolation"))


def latency_summary(traces: DataFrame) -> DataFrame:
    p95 = lambda c: F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {c})")
    return traces.agg(F.round(F.avg("total_ms"), 6).alias("mean_ms"), p95("total_ms").alias("p95_ms"), F.round(F.avg("first_token_ms"), 6).alias("mean_first_ms"), p95("first_token_ms").alias("p95_first_ms"), F.round(F.avg(F.col("error").cast("double")), 6).alias("error_rate"))


def stage_timing_avg(traces: DataFrame) -> DataFrame:
    """Mean of each stage over the traces that have it as a number; stage_timings is a map of text."""
    rows = traces.select(F.explode("stage_timings").alias("stage", "v")).withColumn("ms", F.col("v").try_cast("double")).where("ms IS NOT NULL")
    return rows.groupBy("stage").agg(F.round(F.avg("ms"), 6).alias("mean_ms"), F.count("*").alias("n"))


def slowest_stage(traces: DataFrame) -> DataFrame:
    rows = traces.select("trace_id", F.explode("stage_timings").alias("stage", "v")).withColumn("ms", F.col("v").try_cast("double")).where("ms IS NOT NULL")
    worst = rows.groupBy("trace_id").agg(F.min_by("stage", F.struct(-F.col("ms"), F.col("stage"))).alias("stage"))
    return worst.groupBy("stage").agg(F.count("*").alias("n"))


def cache_hit_rate(traces: DataFrame, keys: list[str]) -> DataFrame:
    on = F.col("cache_enabled")
    hits, misses = F.count_if(on & F.col("cache_hit")), F.count_if(on & ~F.col("cache_hit"))
    return traces.groupBy(*keys).agg(hits.alias("hits"), misses.alias("misses"), F.round(F.try_divide(hits * 100.0, hits + misses), 6).alias("rate"))


def _threshold_metrics(rows: DataFrame) -> DataFrame:
    """Adds precision, recall, false-direct rate and loss to rows of tp, fp, fn, tn."""
    d = lambda a, b, empty: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(empty)), 6)
    return rows.withColumns({"precision": d("tp", F.col("tp") + F.col("fp"), 1.0), "recall": d("tp", F.col("tp") + F.col("fn"), 0.0), "false_direct_rate": d("fp", F.col("fp") + F.col("tn"), 0.0), "loss": F.col("fp") * F.col("fp_cost") + F.col("fn") * F.col("fn_cost")})


def binary_threshold_metrics(obs: DataFrame, threshold: float, fp_cost: float = 5.0, fn_cost: float = 1.0) -> DataFrame:
    yes, hit = F.col("positive"), F.col("score") >= threshold
    rows = obs.agg(F.count_if(yes & hit).alias("tp"), F.count_if(~yes & hit).alias("fp"), F.count_if(yes & ~hit).alias("fn"), F.count_if(~yes & ~hit).alias("tn"))
    return _threshold_metrics(rows.withColumn("fp_cost", F.lit(fp_cost)).withColumn("fn_cost", F.lit(fn_cost))).drop("fp_cost", "fn_cost")


def threshold_scan(obs: DataFrame, low: int = 50, high: int = 95, fp_cost: float = 5.0, fn_cost: float = 1.0) -> DataFrame:
    """Metrics at every hundredth from low to high. Scores fall into hundredths first, so a table of any size becomes
    at most a hundred rows, and sums from above give every threshold at once."""
    bucket = F.least(F.greatest(F.floor(F.round(F.col("score") * 100, 6)), F.lit(low - 1)), F.lit(high))
    per = obs.groupBy(bucket.cast("long").alias("b")).agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    every = obs.sparkSession.range(low - 1, high + 1).toDF("b").join(per, "b", "left").na.fill(0)
    up, all_ = Window.orderBy(F.desc("b")), Window.partitionBy()
    rows = every.select("b", F.sum("p").over(up).alias("tp"), F.sum("n").over(up).alias("fp"), F.sum("p").over(all_).alias("P"), F.sum("n").over(all_).alias("N")).where(F.col("b") >= low)
    rows = rows.select((F.col("b") / 100).alias("threshold"), "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn"))
    return _threshold_metrics(rows.withColumn("fp_cost", F.lit(fp_cost)).withColumn("fn_cost", F.lit(fn_cost))).drop("fp_cost", "fn_cost")


def select_threshold(scan: DataFrame, current: float = 0.72, precision: float = 0.95, recall: float = 0.8, false_direct: float = 0.05) -> DataFrame:
    """The best feasible row, or the best of all if none is feasible, flagged by ``ok``."""
    ok = (F.col("precision") >= precision) & (F.col("recall") >= recall) & (F.col("false_direct_rate") <= false_direct)
    rows = scan.withColumn("ok", ok)
    order = F.struct((~F.col("ok")).alias("a"), "loss", (-F.col("precision")).alias("b"), (-F.col("recall")).alias("c"), F.round(F.abs(F.col("threshold") - current), 6).alias("d"), (-F.col("threshold")).alias("e"))
    return rows.agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def intent_threshold_scan(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """rows(expected, rule_intent, model_intent, model_score, critical) → accuracy and weighted errors per threshold:
    the model's intent counts from the threshold on. ``thresholds`` is a short list, so it is broadcast."""
    bucket = rows.groupBy(F.floor(F.round(F.col("model_score") * 100, 6)).alias("b"), "critical").agg(F.count("*").alias("n"), F.count_if(F.col("model_intent") == F.col("expected")).alias("model_ok"), F.count_if(F.col("rule_intent") == F.col("expected")).alias("rule_ok"))
    each = bucket.crossJoin(F.broadcast(thresholds))  # hundredths by thresholds: at most some thousand rows
    right = F.when(F.col("b") >= F.round(F.col("threshold") * 100, 6), F.col("model_ok")).otherwise(F.col("rule_ok"))
    wrong = (F.col("n") - right) * F.when(F.col("critical"), 5).otherwise(1)
    return each.groupBy("threshold").agg(F.round(F.sum(right) / F.sum("n"), 6).alias("accuracy"), F.sum(wrong).alias("weighted_errors"))


def confusion_matrix(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Counts of all pairs of labels, zeros too."""
    spark = rows.sparkSession
    one = spark.createDataFrame([(x,) for x in labels], "label string")
    cells = one.crossJoin(one.withColumnRenamed("label", "prediction"))
    found = rows.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    return cells.join(found, ["label", "prediction"], "left").na.fill(0)


def check_pass_rates(rows: DataFrame) -> DataFrame:
    """rows(case_id, critical, checks array<struct<name, passed>>) → per check."""
    each = rows.select("case_id", "critical", F.inline("checks"))
    return each.groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"), F.count_if(F.col("critical") & ~F.col("passed")).alias("critical_failures"))


def compare_summary(cmp: DataFrame) -> DataFrame:
    """compare rows with scenario_id → per scenario and in all; ok without regressions."""
    lost = F.col("old_recall") & ~F.col("new_recall")
    out = cmp.rollup("scenario_id").agg(F.count_if("top_changed").alias("changed"), F.round(F.avg(F.col("old_recall").cast("double")), 6).alias("old_recall"), F.round(F.avg(F.col("new_recall").cast("double")), 6).alias("new_recall"), F.count_if(lost).alias("regressions"), F.count_if(~F.col("old_recall") & F.col("new_recall")).alias("improvements"))
    return out.withColumn("ok", F.col("regressions") == 0)


def corpus_profile(docs: DataFrame, markers: dict[str, str]) -> DataFrame:
    """Per format: documents, sources, and documents that hold each marker."""
    return docs.groupBy("format").agg(F.count("*").alias("docs"), F.count_distinct("source").alias("sources"), *[F.count_if(F.contains("text", F.lit(v))).alias(k) for k, v in markers.items()])


def corpus_score(profile: DataFrame) -> DataFrame:
    """profile(faq_count, doc_count, source_count, format_count, marker_total, dirty_count) → score of 100 and band."""
    part = lambda c, most, full: F.least(F.lit(float(most)), F.col(c) / full * most)
    total = part("faq_count", 25, 50) + part("doc_count", 25, 80) + part("source_count", 15, 5) + part("format_count", 15, 4) + part("marker_total", 10, 20) + part("dirty_count", 10, 8)
    band = F.when(F.col("score") >= 75, "near_enterprise").when(F.col("score") >= 55, "enhanced").when(F.col("score") >= 35, "good_sample").otherwise("demo")
    return profile.withColumn("score", F.round(total, 2)).withColumn("band", band)


def issue_summary(rows: DataFrame) -> DataFrame:
    """rows(suffix, issues array) → histogram of issues by suffix."""
    return rows.select("suffix", F.explode("issues").alias("issue")).groupBy("suffix", "issue").agg(F.count("*").alias("n"))


def capacity_estimate(chunks: DataFrame, scales: list[int]) -> DataFrame:
    """MB of vectors, postings and metadata for several numbers of chunks, and the mean length found."""
    spark = chunks.sparkSession
    stats = chunks.agg(F.count("*").alias("chunks"), F.round(F.avg(F.length("text")), 6).alias("avg_length"))
    mb = lambda b: F.round(F.col("scale") * b / 1048576, 2)
    every = spark.createDataFrame([(x,) for x in scales], "scale long").crossJoin(stats)  # one row of statistics
    return every.select("scale", "chunks", "avg_length", mb(4096).alias("dense_mb"), mb(768).alias("sparse_mb"), mb(1024).alias("metadata_mb"), mb(5888).alias("total_mb"))


def entity_degree(edges: DataFrame) -> DataFrame:
    from .joins import undirected

    rows = undirected(edges).groupBy("name").agg(F.count_distinct("other").alias("degree"))
    top = rows.agg(F.max("degree").alias("__m"))
    return rows.crossJoin(F.broadcast(top)).select("name", "degree", F.round(10 + 30 * F.col("degree") / F.col("__m"), 6).alias("size"))  # one row of a maximum


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each unordered pair: distinct descriptions in order, the largest strength."""
    a, b = F.least("source", "target"), F.greatest("source", "target")
    # a description counts once, at its first place, before an edge's are gathered
    rows = edges.select(a.alias("a"), b.alias("b"), "description", "strength", "pos").groupBy("a", "b", "description").agg(F.min("pos").alias("pos"), F.max("strength").alias("strength"))
    texts = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "description"))), lambda x: x["description"]))
    return rows.groupBy("a", "b").agg(F.array_join(texts, "；").alias("description"), F.max("strength").alias("strength"))


def merge_entities(entities: DataFrame) -> DataFrame:
    """One entity for each upper-case name: a description is appended unless what stands there holds it."""
    # what stands there holds a description from its first place on, so only that one is gathered
    first = entities.groupBy(F.upper("name").alias("name"), "description").agg(F.min(F.struct("pos", "type")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("x.pos", "x.type", "description")))
    one = first.groupBy("name").agg(ordered.alias("e"))
    fold = F.aggregate("e", F.lit(""), lambda a, x: F.when(F.contains(a, x["description"]), a).when(a == "", x["description"]).otherwise(F.concat(a, F.lit("；"), x["description"])))
    return one.select("name", F.get("e", 0)["type"].alias("type"), fold.alias("description"))
