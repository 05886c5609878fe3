"""Scope, version and risk filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def visible_levels(own: Column) -> Column:
    """Public, and the caller's own level where that is internal or private."""
    return F.when(own.isin("internal", "private"), F.array(F.lit("public"), own)).otherwise(F.array(F.lit("public")))


def scope_filter(chunks: DataFrame, callers: DataFrame) -> DataFrame:
    """chunks visible to each caller(caller, tenant_id, dataset_id, visibility, roles): tenant, dataset, level, any role."""
    c = callers.select("caller", F.col("tenant_id"), F.col("dataset_id"), visible_levels(F.col("visibility")).alias("__levels"), F.col("roles").alias("__roles"))
    rows = chunks.join(c, ["tenant_id", "dataset_id"])
    return rows.where(F.array_contains("__levels", F.col("visibility")) & F.arrays_overlap("__roles", "allowed_roles")).drop("__levels", "__roles")


def visible_at(seq: Column | int, start: str = "valid_from_seq", stop: str = "valid_to_seq") -> Column:
    """The validity window holds the sequence; an open end is 0."""
    v = F.lit(seq) if isinstance(seq, int) else seq
    return (F.col(start) <= v) & ((F.col(stop) == 0) | (F.col(stop) > v))


def _blocks(start: Column, stop: Column, levels: int) -> Column:
    """The numbers [start, stop) as dyadic blocks (l, i) of 2 ** l numbers each, two of a size at most."""
    def at(k: int) -> Column:
        low, high = F.ceil(start / 2**k).cast("long"), F.floor(stop / 2**k).cast("long")
        block = lambda i: F.struct(F.lit(k).alias("l"), i.alias("i"))
        return F.filter(F.array(F.when((low < high) & (low % 2 == 1), block(low)), F.when((low < high) & (high % 2 == 1), block(high - 1))), lambda x: x.isNotNull())

    return F.concat(*[at(k) for k in range(levels)])


def version_window_join(rows: DataFrame, versions: DataFrame, start: str = "valid_from_seq", stop: str = "valid_to_seq") -> DataFrame:
    """versions(seq) and rows → the rows visible at each version, for any number of versions.

    A validity window is cut into dyadic blocks, at most two for each power of two, and a version lies in one block of
    each size, so the two meet by equality; every pair meets once. Sequences are 0 or more, an open end is 0; rows with
    a null start or end and null versions meet nothing."""
    top = versions.agg(F.max("seq")).first()[0]
    levels = max(1, int(top or 0).bit_length() + 1)
    upto = F.when(F.col(stop) == 0, F.lit(int(top or 0) + 1)).otherwise(F.least(F.col(stop), F.lit(int(top or 0) + 1)))
    cut = rows.where(F.col(start).isNotNull() & F.col(stop).isNotNull()).select("*", F.inline(_blocks(F.greatest(F.col(start), F.lit(0)), upto, levels)).alias("__l", "__i"))
    every = F.array(*[F.struct(F.lit(k).alias("__l"), F.floor(F.col("seq") / 2**k).cast("long").alias("__i")) for k in range(levels)])
    asked = versions.where("seq >= 0").select("seq", F.inline(every))
    return cut.join(asked, ["__l", "__i"]).drop("__l", "__i")


def rarest_gram(tokens: DataFrame, index: DataFrame, size: int) -> DataFrame:
    """tokens(query_id, token) and an index (gram, name) → the tokens with the gram of theirs that the fewest names have; a
    token with a gram that no name has is left out, for no name holds it."""
    each = tokens.select("token").distinct().where(F.length("token") >= size)
    each = each.select("token", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("token") - (size - 1)), lambda i: F.substring(F.col("token"), i, F.lit(size))))).alias("gram"))
    often = index.groupBy("gram").agg(F.count("*").alias("df"))
    known = each.join(often, "gram", "left").groupBy("token").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("g")).where("g.df > 0")
    return tokens.join(known.select("token", "g.gram"), "token")


def source_rejects(queries: DataFrame, valid: DataFrame) -> DataFrame:
    """Queries whose source filter is not among the scenario's sources; null is allowed."""
    return queries.where(F.col("source_filter").isNotNull()).join(valid.select("scenario_id", F.col("source").alias("source_filter")), ["scenario_id", "source_filter"], "left_anti")


def effective_source(explicit: Column, suggested: Column, valid: Column) -> Column:
    return F.coalesce(F.nullif(explicit, F.lit("")), F.when(F.array_contains(valid, suggested), suggested))


def name_index(names: DataFrame, column: str, low: int = 3, high: int = 3) -> DataFrame:
    """(gram, name): the distinct 3-grams of each name, for lookups without a scan of all names per query."""
    grams = F.transform(F.sequence(F.lit(1), F.length(column) - (low - 1)), lambda i: F.substring(F.col(column), i, F.lit(low)))
    return names.where(F.length(column) >= low).select(F.explode(F.array_distinct(grams)).alias("gram"), F.col(column)).withColumnRenamed(column, "name")


def like_match(tokens: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """tokens(query_id, token) → names that hold the token, at most ``limit`` a query, by name. The token's rarest
    gram is looked up in the index, and ``contains`` decides on what it returns. Shorter tokens match whole names."""
    from .ranking import topk_per_group

    index = name_index(names, "name")
    found = rarest_gram(tokens, index, 3).join(index, "gram").where(F.contains(F.col("name"), F.col("token")))
    exact = tokens.where(F.length("token") < 3).join(names.select("name"), F.col("token") == F.col("name"))
    rows = found.select("query_id", "name").unionByName(exact.select("query_id", "name")).distinct()
    return topk_per_group(rows, ["query_id"], [F.col("name")], limit).drop("rank")


def looks_like_table(suffix: Column, text: Column) -> Column:
    lines = F.split(F.substring(text, 1, 4000), "\n")
    many = lambda mark: F.size(F.filter(lines, lambda x: F.regexp_count(x, F.lit(mark)) >= 2)) >= 2
    return suffix.isin(*R.TABLE_SUFFIXES) | many(r"\|") | many(",")


def ocr_risk(name: Column, text: Column, carrier: str = R.OCR_CARRIER, noise: str = R.OCR_NOISE) -> Column:
    return ~T.ocr_reviewed(text) & (name.rlike(carrier) | F.substring(text, 1, 2000).rlike(noise))


def image_risk(suffix: Column, images: Column, visible_chars: Column, least: int = 120) -> Column:
    """block, review or null: an image blocks; a container with images blocks while it has little text."""
    held = suffix.isin(*R.CONTAINER_SUFFIXES) & (images > 0)
    return F.when(suffix.isin(*R.IMAGE_SUFFIXES), "block").when(held & (visible_chars < least), "block").when(held, "review")
