"""Operator 2: quality rules with cross-document line frequency, in DataFrame functions alone.

Base rules look at one text. The method looks across documents: lines are normalised (lower case, single spaces) and
hashed, the distinct documents that hold a line are counted for each host, and a line that more than ``max_docs``
documents of a host hold is boilerplate there. It is removed from every document of that host, and a document left with
less than ``min_left`` of its words is rejected. With ``keep_first`` the first document of the host that passes the base
rules keeps the line and is not rejected for what it loses, so that one copy of every line stays in the corpus.

Texts are read once: measures and hashed lines are written as a narrow table, which the counts and verdicts read. Texts
are never shuffled. Documents that hold a line are counted in two steps, by (host, line, document) and by (host, line),
which combine before they shuffle, so a hot host or line sends one row a task; the join that brings removals back is
on (host, line) and can be split where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, table, text_key, unused, words, written

MAX_DOCS, MIN_LEFT, MIN_WORDS, MAX_REPEAT_PERCENT = 50, 0.3, 10, 20
#: Words in a repeated window.
REPEAT = 5
SYMBOLS = r"[#*$%&|<>]"


def _lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, SPACE, " "))))


def repeated_words(w: Column) -> Column:
    """Words of an array that lie in windows of five words found twice or more in it.

    Windows are hashed to 64 bits. Where all differ, which one hash set tells, the answer is 0. Elsewhere (hash,
    place) pairs are sorted, those equal to a neighbour are repeats, and in order of place each covers five words or
    as many as lie before the next."""
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - REPEAT), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(REPEAT)])))

    def places(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])), lambda x: x["i"])))

    def cover(p: Column) -> Column:
        spans = F.transform(p, lambda x, k: F.least(F.lit(REPEAT), F.coalesce(F.get(p, k + 1) - x, F.lit(REPEAT))))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)

    zero = F.lit(0).cast("long")
    count = let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), zero).otherwise(let(places(g), cover)))
    return F.when(F.size(w) < REPEAT + 1, zero).otherwise(count)


def _measures(text: Column, w: Column) -> dict[str, Column]:
    long = lambda c: c.cast("long")
    return {
        "n_words": long(F.size(w)),
        "word_chars": long(F.length(F.array_join(w, ""))),
        "n_symbols": long(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS))),
        "n_dup_lines": long(let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))),
        "n_repeat_words": repeated_words(w),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs → a written table (doc_id, host, key, base measures, base_failed, lines): one row per input row.

    ``key`` is a hash of the text, which tells rows of one id apart; ``lines`` are (hash, words) of the lines that have
    a word, in order. Null texts have no words; null hosts are one host, the empty one."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    rows = rows.withColumn("w", words(F.col("text")))
    lines = F.transform(_lines(F.col("text")), lambda x: F.struct(line_hash(x).alias("line"), F.size(words(x)).alias("n")))
    made = rows.select("doc_id", "host", text_key(F.col("text")).alias("key"), *[c.alias(n) for n, c in _measures(F.col("text"), F.col("w")).items()], lines.alias("lines"))
    return written(made.withColumn("base_failed", base_failed()), "quality")


def frequent_lines(rows: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Measured rows → (host, line, first_id, n_docs) of lines that more than max_docs distinct documents of a host
    hold; first_id is the least document of them that passes the base rules. Rows that repeat an id are one document,
    and rows with null ids are one as well."""
    each = rows.select("host", "doc_id", "base_failed", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    docs = each.groupBy("host", "line", "doc_id").agg(F.bool_and("base_failed").alias("failed"))
    counted = docs.groupBy("host", "line").agg(F.min(F.when(~F.col("failed"), F.col("doc_id"))).alias("first_id"), F.count("*").alias("n_docs"))
    return counted.where(F.col("n_docs") > max_docs)


def removed_lines(rows: DataFrame, max_docs: int = MAX_DOCS, keep_first: bool = False) -> DataFrame:
    """Measured rows → (doc_id, host, key, n_lines_removed, n_words_removed, lines, holds): of every row with frequent
    lines how many go and their hashes, and whether it keeps one as its host's first document. Equal rows are one."""
    each = rows.select("doc_id", "host", "key", F.posexplode("lines").alias("at", "x")).select("doc_id", "host", "key", "at", "x.line", "x.n")
    met = each.join(frequent_lines(rows, max_docs), ["host", "line"])
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & F.col("doc_id").isNotNull() if keep_first else F.lit(False)
    met = met.withColumn("stays", stays)
    gone = F.collect_set(F.when(~F.col("stays"), F.struct("at", "n", "line")))
    one = met.groupBy("doc_id", "host", "key").agg(gone.alias("x"), F.bool_or("stays").alias("holds"))
    return one.select(
        "doc_id", "host", "key", F.size("x").cast("long").alias("n_lines_removed"),
        F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_words_removed"), F.array_distinct(F.transform("x", lambda x: x["line"])).alias("lines"), "holds",
    )


def _with_verdicts(rows: DataFrame, max_docs: int, min_left: float, keep_first: bool) -> DataFrame:
    gone = removed_lines(rows, max_docs, keep_first).select(F.col("doc_id").alias("__d"), F.col("host").alias("__h"), F.col("key").alias("__k"), "n_lines_removed", "n_words_removed", F.col("lines").alias("gone"), "holds")
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("host") == F.col("__h")) & (F.col("key") == F.col("__k"))
    out = rows.drop("lines").join(gone, same, "left").drop("__d", "__h", "__k").fillna(0, ["n_lines_removed", "n_words_removed"]).fillna(False, ["holds"])
    left = (F.col("n_words") - F.col("n_words_removed") >= min_left * F.col("n_words")) | F.col("holds")
    return out.withColumn("kept", ~F.col("base_failed") & left)


def quality_rules(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs → base measures, n_lines_removed, n_words_removed and kept: one row per input row.

    Null and empty texts have no words and fail the base rules; null hosts are one host; rows with null ids count as
    one document, and lines go from them too; rows that repeat an id count as one document, and each is judged by its
    own text; a very long text is one row of the written table; an empty table gives an empty result; other columns are
    not read, whatever their names.
    """
    rows = measured(docs, id_col, text_col, host_col)
    return _with_verdicts(rows, max_docs, min_left, keep_first).drop("host", "key", "gone", "holds")


def keep_good(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, keep_first: bool = True) -> DataFrame:
    """documents → those kept, without their boilerplate lines, with all columns; n_chars follows the text.

    Rows are judged as by ``quality_rules``, each by its own id, host and text, and all rows that are kept stay, those
    that repeat an id or have none too."""
    verdicts = _with_verdicts(measured(docs), max_docs, min_left, keep_first).where("kept").groupBy("doc_id", "host", "key").agg(F.first("gone").alias("gone"))
    names = {n: unused(docs, f"__{n}") for n in ("id", "host", "key", "gone")}
    verdicts = verdicts.select(*[F.col(c).alias(names[n]) for c, n in (("doc_id", "id"), ("host", "host"), ("key", "key"), ("gone", "gone"))])
    same = docs["doc_id"].eqNullSafe(F.col(names["id"])) & (F.coalesce(docs["source"].cast("string"), F.lit("")) == F.col(names["host"])) & (text_key(docs["text"]) == F.col(names["key"]))
    gone = F.col(names["gone"])
    text = F.when(F.coalesce(F.size(gone), F.lit(0)) <= 0, F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(gone, line_hash(x))), "\n"))
    out = docs.join(verdicts, same).withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out.select(docs.columns)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS raw FROM d),
n AS (SELECT doc_id, host, raw, lower(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line,
  len(list_filter(regexp_split_to_array(raw, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
  FROM l WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM n GROUP BY doc_id),
f AS (SELECT host, line FROM n GROUP BY host, line HAVING count(DISTINCT doc_id) > {MAX_DOCS}),
gone AS (SELECT doc_id, count(*) AS n_lines_removed, sum(words) AS n_words_removed
  FROM n JOIN f USING (host, line) GROUP BY doc_id),
g AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(5, coalesce(j - i, 5))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed, coalesce(n_words_removed, 0)::BIGINT AS n_words_removed
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words - n_words_removed >= {MIN_LEFT} * n_words AS kept FROM b
"""
