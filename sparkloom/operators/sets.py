"""Set operators over slices of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import saved


def union_keep_first(base: DataFrame, overlay: DataFrame, key: str = "question", order: str = "pos") -> tuple[DataFrame, DataFrame]:
    """Base rows, then overlay rows; a repeated key is dropped. Returns (kept, dropped); blank keys are all kept."""
    rows = base.withColumn("__p", F.lit(0)).unionByName(overlay.withColumn("__p", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(F.trim(key)).orderBy("__p", order))
    rows = rows.withColumn("__n", F.when(F.trim(key) == "", 1).otherwise(n))
    return rows.where("__n = 1").drop("__p", "__n"), rows.where("__n > 1").drop("__p", "__n")


def merge_cases(target: DataFrame, incoming: DataFrame, conflict: str = "replace") -> DataFrame:
    """Full outer join on case_id: replace takes the incoming row, skip the target's; ``error`` raises if both have an id."""
    if conflict == "error" and not target.join(incoming, "case_id", "left_semi").isEmpty():
        raise ValueError("cases are in both tables")
    cols = [c for c in target.columns if c != "case_id"]
    t = target.select("case_id", F.struct(*cols).alias("t"))
    i = incoming.select("case_id", F.struct(*cols).alias("i"))
    rows = t.join(i, "case_id", "full")
    pick = F.coalesce("i", "t") if conflict == "replace" else F.coalesce("t", "i")
    action = F.when(F.col("t").isNull(), "inserted").when(F.col("i").isNull(), "kept").otherwise("replaced" if conflict == "replace" else "skipped")
    return rows.select("case_id", pick.alias("x"), action.alias("action")).select("case_id", "x.*", "action")


def coverage_gap(required: DataFrame, covered: DataFrame) -> DataFrame:
    """Required rows that are not covered."""
    return required.subtract(covered)


def passages_in(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """passages(text) and docs(key, text) → pairs (text, key) of a passage and a document that contains it, character by
    character, in the middle of words too.

    A word of the passage with white space on both sides is a whole word of every such document, so documents are looked
    up by the one that the fewest of them have. A passage without such a word has one or two pieces of words: the longer
    one lies in a word of the corpus, which grams of its beginning find among the distinct words. ``contains`` decides on
    what a lookup returns. Passages of white space alone are compared with every document, as all of them may have it."""
    passages = passages.select("text").where("text IS NOT NULL").distinct()
    passages = passages.withColumn("w", F.split("text", r"\s+"))
    inner = passages.select("text", F.explode(F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0)))).alias("word")).distinct()
    words = docs.where("text IS NOT NULL").select("key", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    held = saved(words.join(inner.select("word").distinct(), "word", "left_semi"), "passage-words")
    count = inner.join(held.groupBy("word").agg(F.count("*").alias("df")), "word", "left")
    rarest = count.groupBy("text").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), F.col("word"))).alias("word"))
    met = rarest.join(held, "word").select("text", "key")

    pieces = passages.where((F.size("w") <= 2) & (F.trim(F.array_join("w", "")) != ""))
    pieces = pieces.select("text", F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("p"))))["p"].alias("piece"))
    if not pieces.isEmpty():
        gram = lambda x, i: F.substring(x, i, F.lit(3))
        grams = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: gram(F.col("word"), i))
        every = F.concat(grams, F.transform(grams, lambda g: F.substring(g, 1, 2)), F.transform(grams, lambda g: F.substring(g, 1, 1)))
        index = words.select("word").distinct().where("word <> ''").select("word", F.explode(F.array_distinct(every)).alias("gram"))
        hosts = pieces.withColumn("gram", F.substring("piece", 1, 3)).join(index, "gram").where(F.contains("word", F.col("piece"))).select("text", "word")
        met = met.unionByName(hosts.join(words, "word").select("text", "key"))
    found = met.distinct().join(docs.select("key", F.col("text").alias("__t")), "key").where(F.contains("__t", F.col("text"))).select("text", "key")
    blank = passages.where(F.trim(F.array_join("w", "")) == "").select("text")
    if not blank.isEmpty():
        found = found.unionByName(docs.select("key", F.col("text").alias("__t")).join(blank, F.contains("__t", F.col("text"))).select("text", "key"))
    return found


def scenario_isolation(rows: DataFrame) -> DataFrame:
    """rows(expected, actual): share of expected scenarios that came back, and of rows in the right one."""
    e, a = rows.select(F.col("expected").alias("s")).distinct(), rows.select(F.col("actual").alias("s")).distinct()
    shares = e.agg(F.count("*").alias("n")).crossJoin(e.intersect(a).agg(F.count("*").alias("m")))  # one row each
    return rows.agg(F.avg((F.col("expected") == F.col("actual")).cast("double")).alias("turn_share")).crossJoin(shares).select("turn_share", (F.col("m") / F.col("n")).alias("scenario_share"))


def overlay_files(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Files by relative path, the overlay's where both have one."""
    b, o = base.select("path", F.col("content").alias("b")), overlay.select("path", F.col("content").alias("o"))
    rows = b.join(o, "path", "full")
    return rows.select("path", F.coalesce("o", "b").alias("content"), (F.col("b").isNotNull() & F.col("o").isNotNull()).alias("overwritten"))
