"""Top-k, keep-first, ordering and windowed operators. Every order carries its tiebreaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def topk_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank; the window limit runs before the shuffle as well."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return topk_per_group(rows, keys, order, 1).drop("rank")


def keep_best_hit(hits: DataFrame, keys: list[str], score: str = "score", variant: str = "variant_no") -> DataFrame:
    """The highest score of each key, of equal ones the earlier variant: an aggregate, so it combines before the shuffle."""
    rest = [c for c in hits.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(variant))).alias("b")
    return hits.groupBy(*keys).agg(best).select(*keys, "b.*")


def promote_exact(hits: DataFrame, exact: Column) -> DataFrame:
    """The best exact match of a query becomes first; the others keep their order."""
    w = Window.partitionBy("query_id")
    first = F.min(F.when(exact, F.col("rank"))).over(w)
    moved = hits.withColumn("__first", first)
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("rank") == F.col("__first"), 0).otherwise(1), "rank")
    return moved.withColumn("new_rank", F.row_number().over(order)).drop("__first")


def table_first_order(hits: DataFrame) -> DataFrame:
    """Rank by score, table rows first where the query's plan prefers them."""
    lift = F.when(F.col("prefer_table") & (F.col("source_type") == "table_row"), 0).otherwise(1)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(lift, F.desc("score"), "key")))


def select_context(candidates: DataFrame, budget: int = 6000, per_doc: int = 1600, top_n: int = 4, faq_limit: int = 2) -> DataFrame:
    """candidates(query_id, rank, key, parent_id, is_faq, n_chars) → the chosen ones with their position.

    FAQ hits come first, at most ``faq_limit``; a document counts its parent once. A document over what is left of the
    budget is skipped, not the end; the first always enters. Candidates of a query are bounded by the search before.
    """
    rows = candidates.withColumn("__f", F.when(F.col("is_faq"), F.row_number().over(Window.partitionBy("query_id", "is_faq").orderBy("rank")))).where(F.col("__f").isNull() | (F.col("__f") <= faq_limit))
    item = F.struct((~F.col("is_faq")).alias("o"), "rank", "key", F.coalesce("parent_id", "key").alias("p"), F.least(F.col("n_chars"), F.lit(per_doc)).cast("long").alias("n"))
    one = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("parents"), F.array().cast("array<string>").alias("keys"))

    def step(a: Column, x: Column) -> Column:
        fits = (F.size(a["keys"]) < top_n) & ~F.array_contains(a["parents"], x["p"]) & ((F.size(a["keys"]) == 0) | (a["used"] + x["n"] <= budget))
        return F.when(fits, F.struct((a["used"] + x["n"]).alias("used"), F.concat(a["parents"], F.array(x["p"])).alias("parents"), F.concat(a["keys"], F.array(x["key"])).alias("keys"))).otherwise(a)

    chosen = one.select("query_id", F.aggregate("items", start, step).alias("c"))
    return chosen.select("query_id", F.posexplode("c.keys").alias("pos", "key"), F.col("c.used").alias("used"))


def build_context_text(rows: DataFrame) -> DataFrame:
    """rows(query_id, pos, label, text) → one numbered text a query, repeated texts once."""
    first = keep_first(rows, ["query_id", "text"], [F.col("pos")])
    numbered = first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))
    block = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "label", F.lit("\n"), "text")
    return numbered.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


def last_n_messages(messages: DataFrame, n: int) -> DataFrame:
    rows = topk_per_group(messages, ["session_id"], [F.desc("turn")], n).drop("rank")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy("turn")))


def pair_turns(messages: DataFrame) -> DataFrame:
    """Each assistant message with the latest user message not yet answered."""
    w = Window.partitionBy("session_id").orderBy("turn")
    island = F.coalesce(F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = messages.where("role IN ('user', 'assistant')").withColumn("__i", island)
    last = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(Window.partitionBy("session_id", "__i").orderBy("turn"))
    return rows.withColumn("question", last).where((F.col("role") == "assistant") & F.col("question").isNotNull()).select("session_id", "turn", "question", F.col("text").alias("answer"))


def activation_history(log: DataFrame, limit: int = 200) -> DataFrame:
    """Changes of the active version, newest first, at most ``limit`` (1 to 200) a scenario."""
    w = Window.partitionBy("scenario_id").orderBy("activated_at", "log_id")
    rows = log.withColumn("from_seq", F.lag("version_seq").over(w)).where(F.col("from_seq").isNull() | (F.col("from_seq") != F.col("version_seq")))
    rows = rows.withColumn("action", F.when(F.col("version_seq") < F.col("from_seq"), "rollback").otherwise("activate"))
    return topk_per_group(rows, ["scenario_id"], [F.desc("activated_at"), F.desc("log_id")], max(1, min(limit, 200)))


def version_status(log: DataFrame, archived: DataFrame) -> DataFrame:
    """ACTIVE, ARCHIVED or STAGED of each version in the log, with the active and the one before it."""
    order = F.struct("activated_at", "log_id")
    w = Window.partitionBy("scenario_id").orderBy("activated_at", "log_id")
    changes = log.withColumn("prev", F.lag("version_seq").over(w)).where("prev IS NULL OR prev <> version_seq")
    now = changes.groupBy("scenario_id").agg(F.max_by("version_seq", order).alias("active"), F.max_by("prev", order).alias("previous"))
    rows = log.select("scenario_id", "version_seq").distinct().join(now, "scenario_id").join(archived.withColumn("gone", F.lit(True)), ["scenario_id", "version_seq"], "left")
    return rows.withColumn("status", F.when(F.col("version_seq") == F.col("active"), "ACTIVE").when(F.col("gone"), "ARCHIVED").otherwise("STAGED")).drop("gone")


def next_version_seq(created: DataFrame, base: DataFrame) -> DataFrame:
    """Dense numbers per scenario in order of creation, after the scenario's largest so far."""
    n = F.row_number().over(Window.partitionBy("scenario_id").orderBy("created_at", "log_id"))
    return created.withColumn("n", n).join(base, "scenario_id", "left").withColumn("new_seq", F.col("n") + F.coalesce("base_seq", F.lit(0))).drop("n", "base_seq")


def validity_windows(changes: DataFrame) -> DataFrame:
    """Each change of a path opens a window that the next one closes; the last stays open, which is 0."""
    until = F.lead("seq", 1, 0).over(Window.partitionBy("path").orderBy("seq", "chunk_id"))
    return changes.withColumn("valid_from_seq", F.col("seq")).withColumn("valid_to_seq", until)


def newest_first(rows: DataFrame, order: list[Column], limit: int, most: int) -> DataFrame:
    return rows.orderBy(*order).limit(max(1, min(limit, most)))


def rank_relations(relations: DataFrame, seeds: DataFrame, k: int = 30) -> DataFrame:
    """relations(source, target, strength) weighted 3, 1 or 0.5 by how many ends are seeds of a query; top k a query.

    Only relations that touch a seed are compared, through equi-joins on either end."""
    s = seeds.select("query_id", "name").distinct()
    a = relations.join(s, relations["source"] == s["name"]).select("query_id", "source", "target", "strength", F.lit(1).alias("n"))
    b = relations.join(s, relations["target"] == s["name"]).select("query_id", "source", "target", "strength", F.lit(1).alias("n"))
    both = a.unionByName(b).groupBy("query_id", "source", "target").agg(F.max("strength").alias("strength"), F.sum("n").alias("ends"))
    scored = both.withColumn("score", F.when(F.col("ends") == 2, 3.0).otherwise(1.0) * F.col("strength"))
    return topk_per_group(scored, ["query_id"], [F.desc("score"), F.col("source"), F.col("target")], k)


def budgeted_lines(lines: DataFrame, budget: int = 12000, keys: tuple[str, ...] = ("group_id",), most: dict[str, int] | None = None) -> DataFrame:
    """lines(group, kind, pos, line): lines in order while their lengths and feeds fit, stopping at the first that does not."""
    w = Window.partitionBy(*keys).orderBy("kind", "pos")
    rows = lines
    if most:
        n = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("pos"))
        cap = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in most.items()])
        rows = rows.withColumn("__n", n).where(F.col("__n") <= cap).drop("__n")
    return rows.withColumn("upto", F.sum(F.length("line") + 1).over(w)).where(F.col("upto") <= budget)


def context_stats(context: DataFrame) -> DataFrame:
    return context.groupBy("query_id").agg(F.count("*").alias("context_count"), F.sum("n_chars").alias("context_chars"), F.count_distinct("source").alias("source_count"), F.max("score").alias("top_score"))


def union_sources(faq: DataFrame, docs: DataFrame, plans: DataFrame) -> DataFrame:
    """FAQ hits (two) and document hits (five) of each query in one order; table plans put documents first."""
    two = faq.where("rank <= 2").withColumn("block", F.lit(0))
    five = docs.where("rank <= 5").withColumn("block", F.lit(1))
    rows = two.unionByName(five).join(plans, "query_id")
    block = F.when(F.col("prefer_table"), 1 - F.col("block")).otherwise(F.col("block"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(block, "rank"))).drop("block", "prefer_table")


