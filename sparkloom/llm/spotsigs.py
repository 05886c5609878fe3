"""Operator 9: SpotSigs document fingerprints, in DataFrame functions alone.

A signature is a common word (an anchor) with the next two content words after it. The first two and the last two words
of a text are signatures as well, and so is each word that a hash chooses, one in EVERY, with the two words after it. The
choice depends on the word alone, so texts of other languages, tables and word lists have signatures all over too, and an
edit changes the signatures around it and no others. The set of a text's signatures, hashed to 32 bits each, is its fingerprint; likeness is the Jaccard measure of
two sets. Content words are an array of their own: the j-th common word, at place i, is followed by the content words
from i - j on, so all chains of a text come from one pass.

``near_pairs`` is the self-join: sets are partitioned by their size, since a Jaccard of t bounds the ratio of sizes by
t; within a partition and the next one, only the rarest signatures of a set, as many as t demands, are joined on; what
passes the bound by sizes and places is compared in full. Equal sets are one node throughout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table, text_key, written
from .components import connected_components

#: Common words of four languages.
ANCHORS = (
    "the a an of and to in is was that for on with as be by it at this are from or "
    "le la les de des du un une et en est que qui dans pour par sur au avec "
    "der die das und den dem von zu mit ist ein eine im auf sich nicht für "
    "el los las del una con se su es lo al por para y como"
).split()
CHAIN = 2
#: One in so many words begins a signature by its hash.
EVERY = 6
NOT_WORD = r"[^\p{L}\p{N}]+"


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The distinct signatures of a text as a sorted array of ints. None for an empty text; a text without a word has
    its whole as one signature."""
    w = F.filter(F.split(F.lower(text), NOT_WORD), lambda x: x != "")
    # (word, whether it is common) so that each is looked up once
    tagged = F.transform(w, lambda x: F.struct(x.alias("w"), x.isin(*sorted(set(ANCHORS))).alias("c")))

    def chains(t: Column) -> Column:
        content = F.transform(F.filter(t, lambda x: ~x["c"]), lambda x: x["w"])
        anchors = F.filter(F.transform(t, lambda x, i: F.struct(x["w"].alias("w"), x["c"].alias("c"), i.alias("i"))), lambda x: x["c"])
        word = lambda i: F.coalesce(F.get(t, i)["w"], F.lit(""))
        chosen = F.filter(F.transform(t, lambda x, i: F.struct(x["w"].alias("w"), i.alias("i"))), lambda x: (F.pmod(F.hash(F.lit("#"), x["w"]), F.lit(EVERY)) == 0) & (x["i"] + chain < F.size(t)))
        return let(content, lambda c: F.concat(
            F.array(F.hash(F.lit("^"), *[word(F.lit(k)) for k in range(chain)]), F.hash(F.lit("$"), *[word(F.size(t) - k) for k in range(chain, 0, -1)])),
            F.transform(chosen, lambda x: F.hash(F.lit("+"), *[word(x["i"] + k) for k in range(chain + 1)])),
            F.transform(
                F.filter(F.transform(anchors, lambda x, j: F.struct(x["w"].alias("w"), (x["i"] - j).alias("at"))), lambda x: x["at"] + chain <= F.size(c)),
                lambda x: F.hash(x["w"], *[F.get(c, x["at"] + k) for k in range(chain)]),
            ),
        ))

    found = let(tagged, lambda t: F.when(F.size(t) == 0, F.array(F.hash(F.lit("?"), text))).otherwise(chains(t)))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<int>")).otherwise(F.sort_array(F.array_distinct(found)))


def fingerprint(sigs: Column) -> Column:
    """A set as text: eight hex digits for each signature, in order."""
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard measure of two sets of signatures; 1 for equal sets, empty ones too."""
    both = F.size(F.array_intersect(a, b))
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def next_ids(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs → (doc_id, next_id): the id that follows in descending order, and the largest after the least.

    Ids are dealt out by quantiles, as many as the session has shuffle partitions, and follow each other within a
    range; the last of a range is followed by the first of the next one, of which there is one row a range."""
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    n = max(2, min(2000, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    at = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    rows = ids.withColumn("r", at)
    heads = rows.groupBy("r").agg(F.max("doc_id").alias("head"))
    lower = Window.orderBy(F.desc("r"))
    heads = heads.select("r", F.coalesce(F.lead("head").over(lower), F.first("head").over(lower.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = rows.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("r").orderBy(F.desc("doc_id"))))
    return inside.join(F.broadcast(heads), "r").select("doc_id", F.coalesce("next_id", "after").alias("next_id"))  # heads: a row a range


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs → the contract's columns: each text against its edited text and against the next document.

    One row per input row with an id. A null text is empty; rows that repeat an id are each edited by their own length
    and have the same next document, that of the next id, of which the text with the least hash counts; a text of any
    length is whole; rows with a null id are left out, for they have no next document; an empty table gives an empty
    result; other columns are not read, whatever their names. Signatures of a text are computed once, where it is read.
    The number of partitions follows the text, for adaptive execution would merge them by their bytes, which say little
    of the work.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    own = own.withColumn("key", text_key(F.col("text")))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(2 * spark.sparkContext.defaultParallelism, size >> 23))
    lengths = own.select("doc_id", "key", F.length("text").alias("n")).distinct()
    least = lengths.groupBy("doc_id").agg(F.min("key").alias("next_key")).withColumnRenamed("doc_id", "next_id")
    # for each row: whom it gives its beginning to, and how much of it
    gives = lengths.join(next_ids(own), "doc_id").join(least, "next_id")
    gives = gives.select(F.col("next_id").alias("doc_id"), F.col("next_key").alias("key"), F.struct("doc_id", "key").alias("to"), F.floor(F.col("n") / 3).cast("int").alias("take"))
    text = own.withColumn("a", signatures(F.col("text"))).repartition(parts, "doc_id", "key")
    given = text.dropDuplicates(["doc_id", "key"]).join(gives, ["doc_id", "key"])
    given = given.select("to.doc_id", "to.key", F.substring("text", F.lit(1), F.col("take")).alias("part"), F.col("a").alias("next_sigs")).repartition(parts, "doc_id", "key")
    rows = text.join(given, ["doc_id", "key"]).withColumn("n_chars", F.length("text"))
    cut = F.col("n_chars") - F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), cut), F.col("part")))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", signatures(F.col("edited")).alias("b"), "next_sigs")
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"), fingerprint(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).cast("double").alias("near_edited"), likeness(F.col("a"), F.col("next_sigs")).cast("double").alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs → (a, b, likeness): representatives (least ids) of distinct, non-empty signature sets at ``threshold`` or more.

    Size partitions grow by 1/threshold, so a set is compared within its own and the next; the prefix of a set is its
    rarest signatures, size - ceil(threshold * size) + 1 of them, and two sets at the threshold share one. Signatures
    are ordered by document frequency, so very frequent ones are joined on in sets that have little else.
    """
    one = docs.select(F.col(id_col).cast("long").alias("id"), signatures(F.col(text_col)).alias("s")).where(F.size("s") > 0)
    sets = written(one.groupBy("s").agg(F.min("id").alias("id")), "spotsigs")
    each = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("x"))
    often = each.groupBy("x").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "x"))
    step = math.log(1 / threshold)
    rare = each.join(often, "x").select("id", "n", "x", place.alias("k")).where(F.col("k") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1)
    rare = rare.withColumn("bin", F.floor(F.log(F.col("n").cast("double")) / step + 1e-9))
    ask = rare.select("id", "n", "x", "k", F.explode(F.array("bin", F.col("bin") + 1)).alias("bin"))
    met = rare.alias("p").join(ask.alias("q"), ["x", "bin"]).where("q.id <> p.id AND (q.n < p.n OR (q.n = p.n AND q.id < p.id))")
    shared = F.least(F.col("p.n") - F.col("p.k"), F.col("q.n") - F.col("q.k")) + F.least("p.k", "q.k")
    bound = (F.col("q.n") >= threshold * F.col("p.n") - 1e-9) & (shared >= threshold / (1 + threshold) * (F.col("p.n") + F.col("q.n")) - 1e-9)
    pairs = met.where(bound).select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return full.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold)


def near_groups(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs → (doc_id, group_id): the least id among texts chained by likeness at ``threshold`` or more."""
    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(fingerprint(signatures(F.col(text_col))), 256).alias("h"), (F.coalesce(F.col(text_col), F.lit("")) == "").alias("bare"))
    least = one.where("NOT bare").groupBy("h").agg(F.min("doc_id").alias("rep"))
    found = connected_components(near_pairs(docs, threshold, id_col, text_col).select("a", "b"))
    rows = one.join(least, "h", "left").withColumn("rep", F.when(F.col("bare"), F.col("doc_id")).otherwise(F.col("rep")))
    return rows.join(found, rows["rep"] == found["node"], "left").select("doc_id", F.coalesce("component", "rep").alias("group_id"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
