"""Rule and model classification of queries and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from .stored import few, only_few


def score_sources(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """queries(query_id, scenario_id, query) × rules(scenario_id, source, source_order, pattern) → scores per source.

    A match in the raw and in the lower-cased text counts each: ten for a match, its characters, less the source's
    place. Rules are configuration, a few rows a scenario, and are broadcast if they are.
    """
    rows = queries.join(few(rules), "scenario_id")
    found = F.concat(F.expr("regexp_extract_all(query, pattern, 0)"), F.expr("regexp_extract_all(lower(trim(query)), pattern, 0)"))
    rows = rows.withColumn("m", found).where(F.size("m") > 0)
    score = F.size("m") * 10 + F.aggregate("m", F.lit(0), lambda a, x: a + F.length(x)) - F.col("source_order")
    rows = rows.select("query_id", "scenario_id", "source", "source_order", score.alias("score"))
    best = F.max("score").over(Window.partitionBy("query_id", "scenario_id"))
    return rows.withColumn("confidence", F.when(best > 0, F.round(F.col("score") / best, 4)).otherwise(0.0))


def source_boundary(queries: DataFrame, scores: DataFrame) -> DataFrame:
    """queries(query_id, selected_source) whose best source is another one."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "source_order")
    best = scores.withColumn("r", F.row_number().over(w)).where("r = 1").select("query_id", F.col("source").alias("best_source"), "score")
    return queries.join(best, "query_id").where((F.col("selected_source") != "") & (F.col("selected_source") != F.col("best_source")))


def scenario_boundary(queries: DataFrame, rules: DataFrame, own_least: int = 8, other_least: int = 12) -> DataFrame:
    """Queries whose own scenario scores under ``own_least`` while another one reaches ``other_least``."""
    every = queries.select("query_id", F.col("scenario_id").alias("own"), "query")
    scenarios = rules.select("scenario_id").distinct()
    scored = score_sources(every.crossJoin(only_few(scenarios)), rules)  # scenarios: configuration
    top = scored.groupBy("query_id", "scenario_id").agg(F.max("score").alias("score")).join(every.select("query_id", "own"), "query_id")
    own = top.where("scenario_id = own").select("query_id", F.col("score").alias("own_score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "scenario_id")
    other = top.where("scenario_id <> own").withColumn("r", F.row_number().over(w)).where("r = 1").select("query_id", F.col("scenario_id").alias("suggested"), "score")
    return other.join(own, "query_id", "left").where((F.coalesce("own_score", F.lit(0)) < own_least) & (F.col("score") >= other_least)).select("query_id", "suggested", "score")


def direct_intent(query: Column) -> Column:
    """GREETING, OUT_OF_SCOPE or HUMAN_SERVICE in this order, else null."""
    q = F.lower(F.trim(query))
    return F.when(q.rlike(R.GREETING) | q.rlike(R.IDENTITY), "GREETING").when(q.rlike(R.OFF_TOPIC), "OUT_OF_SCOPE").when(q.rlike(R.HUMAN_SERVICE) & (F.length(q) <= 18), "HUMAN_SERVICE")


def rule_intent(query: Column, has_history: Column, source: Column) -> Column:
    """A struct (score, priority, intent, reason): follow-up first, else the best of four rules, else the default."""
    raw, q = F.trim(query), F.lower(F.trim(query))
    known, s = F.coalesce(source, F.lit("")) != "", R.INTENT_SCORES
    # ``of`` makes an alternative, null where its rule does not hold
    of = lambda when, score, priority, intent, reason: F.when(when, F.struct(F.lit(score).alias("score"), F.lit(priority).alias("priority"), F.lit(intent).alias("intent"), F.lit(reason).alias("reason")))
    best = F.greatest(
        of(q.rlike(R.FAQ_HINTS), s["strong_faq"], 10, "FAQ_QUERY", "strong_faq_rule"),
        of(known & (F.length(q) <= 32) & q.rlike(R.FAQ_SHAPE), s["source_question_shape"], 30, "FAQ_QUERY", "source_question_shape_rule"),
        of(known & (F.length(q) <= 36) & q.rlike(R.DIRECT_SHAPE), s["direct_faq_shape"], 40, "FAQ_QUERY", "direct_faq_shape_rule"),
        of(q.rlike(R.KNOWLEDGE_HINTS) & (known | (F.length(q) <= 24)), s["knowledge"], 20, "KNOWLEDGE_QUERY", "strong_knowledge_rule"),
    )
    follow = of(has_history & (raw.rlike(R.FOLLOW_UP) | (F.length(raw) <= 8)), 0.8, 0, "FOLLOW_UP", "follow_up_rule")
    return F.coalesce(follow, best, of(F.lit(True), 0.6, 0, "KNOWLEDGE_QUERY", "default_knowledge"))


def fuse_intent(rule: Column, rule_score: Column, reason: Column, model: Column, model_score: Column, has_history: Column) -> Column:
    """A struct (intent, score, policy) from the rule's and the model's verdicts."""
    of = lambda i, s, p: F.struct(i.alias("intent"), F.round(s, 6).alias("score"), F.lit(p).alias("policy"))
    return (
        F.when((model == "FOLLOW_UP") & ~has_history, of(rule, rule_score, "model_follow_up_without_history_guarded"))
        .when(model_score < 0.55, of(rule, rule_score, "model_low_confidence_rule_kept"))
        .when(model == rule, of(rule, F.least(F.lit(1.0), F.greatest(rule_score, model_score) + 0.03), "rule_model_agreed"))
        .when(reason == "default_knowledge", of(model, model_score, "model_assisted_default"))
        .otherwise(of(rule, F.least(rule_score, F.lit(0.68)), "rule_model_conflict_guarded"))
    )


def question_category(query: Column) -> Column:
    q = F.lower(F.trim(query))
    return F.when(q.rlike(R.PRICING), "pricing").when(q.rlike(R.COMPLIANCE), "compliance").when(q.rlike(R.TROUBLESHOOTING), "troubleshooting").when(q.rlike(R.SUMMARY), "summary").otherwise("default")


def table_query_flag(query: Column) -> Column:
    return F.lower(F.trim(query)).rlike(R.TABLE_QUERY)


def risk_tags(scenario: Column, source: Column, category: Column, intent: Column, rule_score: Column) -> Column:
    return F.filter(F.array(
        F.concat(F.lit("domain:"), scenario), F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit("source:"), source)), F.when(category != "default", F.concat(F.lit("risk:"), category)),
        F.when(intent == "FOLLOW_UP", "context:history_required"), F.when(rule_score < 0.70, "confidence:low_rule_score"),
    ), lambda x: x.isNotNull())


def prompt_profile(queries: DataFrame, by_category: DataFrame, by_intent: DataFrame, default: str = "default") -> DataFrame:
    """The profile of the category, else of the intent, else the default, from two small dimensions."""
    c = by_category.select("category", F.col("profile").alias("__c"))
    i = by_intent.select("intent", F.col("profile").alias("__i"))
    return queries.join(few(c), "category", "left").join(few(i), "intent", "left").withColumn("profile", F.coalesce("__c", "__i", F.lit(default))).drop("__c", "__i")


def faq_source_normalize(faq: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """faq(faq_id, subject, question) → (with a valid source, rejected): the subject itself, else the first pattern that
    the subject or the question matches."""
    s = F.lower(F.trim("subject"))
    exact = rules.select(F.col("source").alias("__s")).distinct().withColumn("__exact", F.col("__s"))
    rows = faq.withColumn("__k", s).join(few(exact), F.col("__k") == F.col("__s"), "left")
    met = faq.crossJoin(only_few(rules)).where(F.expr("subject rlike pattern OR question rlike pattern"))  # rules: a few rows of configuration
    first = met.groupBy("faq_id").agg(F.min_by("source", "source_order").alias("__first"))
    rows = rows.join(first, "faq_id", "left").withColumn("source", F.coalesce("__exact", "__first")).drop("__k", "__s", "__exact", "__first")
    return rows.where("source IS NOT NULL"), rows.where("source IS NULL").drop("source")


def dirty_sample_classify(name: Column, suffix: Column, text: Column, patterns: dict[str, str] = R.DIRTY) -> Column:
    """Issues of a sample, by patterns over its name and text; one of no issue needs a manual review."""
    content = F.concat(name, F.lit("\n"), text)
    hit = {k: content.rlike(v) for k, v in patterns.items()}
    parts = [F.when(hit["expired_policy"], "expired_policy"), F.when(hit["expired_policy"], "active_ingestion_blocked"), F.when(hit["policy_conflict"], "policy_conflict"), F.when(hit["ocr_review_required"], "ocr_review_required"), F.when((suffix == ".csv") | hit["table_split_required"], "table_split_required")]
    found = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit("manual_review"))).otherwise(found)


def classify_errors(error: Column) -> Column:
    e = F.lower(error)
    out = None
    for name, pattern in R.ERRORS:
        out = F.when(e.rlike(pattern), name) if out is None else out.when(e.rlike(pattern), name)
    return out.otherwise("generic")


def train_text_classifier(rows: DataFrame, features: int = 4096):
    """rows(text, label double) → a pipeline of words, hashed counts, IDF and logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    steps = [RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}!#$%&|*]+"), HashingTF(inputCol="words", outputCol="counts", numFeatures=features), IDF(inputCol="counts", outputCol="features"), LogisticRegression(maxIter=20, regParam=0.01)]
    return Pipeline(stages=steps).fit(rows)


def score_text_classifier(model, rows: DataFrame) -> DataFrame:
    """Adds prediction, probability and the scores of all classes."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows)
    p = vector_to_array("probability")
    return out.withColumn("scores", p).withColumn("probability", F.array_max(p)).drop("words", "counts", "features", "rawPrediction")


