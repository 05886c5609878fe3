"""Operator 13: ranked lexical search by NRA, on document-partitioned impact-sorted postings.

Texts are read once into a stored table of the asked terms of each document; documents, lengths and document frequencies
come from it as aggregates. Then every task takes its documents in blocks, orders a block's postings by term and
descending impact, and answers each item by NRA: all lists of the item are read from their high ends, some further
with each round; a document's lower bound is the sum of what has been read of it, its upper bound adds what the unread
rest of each other list can still give. A document whose upper bound loses against the ten best of the task so far,
ties by id included, is out. Reading goes on until no unread document can enter, the members are settled and their
bounds meet, so the scores are final. A task hands on ten documents of an item, and a window picks the ten of all.

Blocks are bounded by postings, items by slices of as many terms; a frequent term's list is spread over all blocks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, table, written

#: Letters and digits of ASCII and all other characters make terms; only A-Z are lower-cased.
_TERM = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Postings of a block, first reads of a list, and distinct terms of a slice of items.
BLOCK_POSTINGS, FIRST_READ, SLICE_TERMS = 1 << 20, 256, 100_000


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, repeats too, in UTF-8; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM).split()


def slices_of(items: list[tuple[int, str | None]], most: int = SLICE_TERMS) -> Iterator[tuple[list[tuple[int, Counter]], dict[bytes, int]]]:
    """Items in slices of about ``most`` distinct terms: (item's id, its terms with counts), and the number of each term."""
    part, known = [], {}
    for item, text in items:
        found = Counter(terms_of(text))
        if part and len(known.keys() | found.keys()) > most:
            yield part, known
            part, known = [], {}
        for t in found:
            known.setdefault(t, len(known))
        part.append((item, Counter({known[t]: n for t, n in found.items()})))
    if part:
        yield part, known


def asked_postings(docs: DataFrame, known, id_col: str, text_col: str) -> DataFrame:
    """docs and a broadcast dict of terms → (doc_id, n, t array<int>, tf array<int>): the length of each document with a
    term, and the asked terms that it holds."""

    def run(batches):
        number = known.value
        for pdf in batches:
            lengths, ts, tfs = [], [], []
            for text in pdf.pop("text"):
                found = terms_of(text)
                held = Counter(number[w] for w in found if w in number)
                lengths.append(len(found))
                ts.append(np.fromiter(held.keys(), np.int32, len(held)))
                tfs.append(np.fromiter(held.values(), np.int32, len(held)))
            out = pdf.assign(n=lengths, t=ts, tf=tfs)
            yield out[out["n"] > 0]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n long, t array<int>, tf array<int>")


def document_frequencies(postings: DataFrame, count: int) -> np.ndarray:
    """The number of documents of each asked term, summed by task and then over tasks."""

    def run(batches):
        total = np.zeros(count, np.int64)
        for pdf in batches:
            for t in pdf["t"]:
                total[t] += 1  # a document has a term once
        (held,) = np.nonzero(total)
        yield pd.DataFrame({"term": held.astype(np.int32), "df": total[held]})

    out = np.zeros(count, np.int64)
    for r in postings.select("t").mapInPandas(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


class Block:
    """Postings of some documents: for each term its documents by descending impact."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, ts: list, tfs: list, n: int, total: int):
        self.ids = ids
        counts = np.array([len(t) for t in ts])
        term, tf = (np.concatenate([np.asarray(x, np.int64) for x in xs]) if len(xs) else np.zeros(0, np.int64) for xs in (ts, tfs))
        doc = np.repeat(np.arange(len(ids)), counts)
        m = 25 + (75 * lengths * n) // total
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.lexsort((-impact, term))
        self.doc, self.impact, term = doc[order], impact[order], term[order]
        held, begin = np.unique(term, return_index=True)
        stops = np.append(begin[1:], len(term))
        self.lists = {t: (a, b) for t, a, b in zip(held.tolist(), begin.tolist(), stops.tolist(), strict=True)}


def nra(block: Block, item: dict[int, int], k: int, best: list[tuple[int, int]], first_read: int = FIRST_READ) -> list[tuple[int, int]]:
    """The k best (-score, doc_id) of a block's documents and of ``best``, in order; scores are final, and above 0.

    item: term → weight. Lists are read in rounds, each twice as far as all before."""
    lists = [(w, *block.lists[t]) for t, w in item.items() if w > 0 and t in block.lists]
    if not lists:
        return best
    docs, width = len(block.ids), len(lists)
    low, seen = np.zeros(docs, np.int64), np.zeros((width, docs), bool)
    at = [a for _, a, _ in lists]
    live = np.ones(docs, bool)
    step = first_read
    while True:
        for j, (w, _, stop) in enumerate(lists):
            upto = min(at[j] + step, stop)
            if upto > at[j]:
                got = block.doc[at[j] : upto]
                low[got] += w * block.impact[at[j] : upto]
                seen[j, got] = True
                at[j] = upto
        step *= 2
        # the most that the unread rest of each list can give
        rest = np.array([w * int(block.impact[i]) if i < stop else 0 for i, (w, _, stop) in zip(at, lists, strict=True)], np.int64)
        high = low + rest.sum()
        for j in np.flatnonzero(rest):
            high -= rest[j] * seen[j]
        bar, bar_id = _bar(block, low, live, k, best)
        live &= (high > bar) | ((high == bar) & (block.ids <= bar_id))
        live &= high > 0
        if (low[live] == high[live]).all():
            break
        if not live.any():
            break
    (left,) = np.nonzero(live & (low > 0))
    return sorted([*best, *((-int(low[i]), int(block.ids[i])) for i in left)])[:k]


def _bar(block: Block, low: np.ndarray, live: np.ndarray, k: int, best: list[tuple[int, int]]) -> tuple[int, int]:
    """The lower bound and id of the k-th document so far, of the block's and of ``best``; (0, none) if there are fewer."""
    (held,) = np.nonzero(live & (low > 0))
    score = np.concatenate([low[held], np.array([-s for s, _ in best], np.int64)])
    if len(score) < k:
        return 0, np.iinfo(np.int64).min
    ids = np.concatenate([block.ids[held], np.array([i for _, i in best], np.int64)])
    if len(score) > 4 * k:  # only those at the k-th score or above can be the k-th
        keep = score >= np.partition(score, -k)[-k]
        score, ids = score[keep], ids[keep]
    last = np.lexsort((ids, -score))[k - 1]
    return int(score[last]), int(ids[last])


def _ranked(postings: DataFrame, held, k: int, n: int, total: int) -> DataFrame:
    """postings and broadcast items → (item_id, doc_id, score): the k best documents of each task."""

    def blocks(batches):
        ids, lengths, ts, tfs, size = [], [], [], [], 0
        for pdf in batches:
            for row in zip(pdf["doc_id"], pdf["n"], pdf["t"], pdf["tf"], strict=True):
                if not len(row[2]):
                    continue  # scores nothing
                for into, x in zip((ids, lengths, ts, tfs), row, strict=True):
                    into.append(x)
                size += len(row[2]) + 16
                if size >= BLOCK_POSTINGS:
                    yield Block(np.array(ids, np.int64), np.array(lengths, np.int64), ts, tfs, n, total)
                    ids, lengths, ts, tfs, size = [], [], [], [], 0
        if ids:
            yield Block(np.array(ids, np.int64), np.array(lengths, np.int64), ts, tfs, n, total)

    def run(batches):
        items = held.value
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        for block in blocks(batches):
            for i, (_, terms) in enumerate(items):
                best[i] = nra(block, terms, k, best[i])
        yield pd.DataFrame([(item, doc, -score) for (item, _), found in zip(items, best, strict=True) for score, doc in found], columns=["item_id", "doc_id", "score"]).astype(np.int64)

    return postings.mapInPandas(run, "item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs and items(item_id, text) → (item_id, rank, doc_id, score): the k best documents of each item, by descending
    score and ascending doc_id, of those with a score above 0.

    A term's weight is floor(1000 ln((2N+2)/(2df+1))); a document's score sums weight * ((10**9 tf) div (1000 tf + 8 m))
    over the item's terms, repeats included, with m = 25 + (75 n N) div L. Null, empty and term-less texts of documents
    count nowhere, such items have no rows. Rows with a null doc_id count in N, L and df and are never listed; rows that
    repeat a doc_id are documents of their own and may be listed one by one; equal scores go by doc_id, and rows of one
    id and score each have a rank. Items that repeat an id are ranked each by itself, in order of their texts; items
    with a null id are left out. A text of any length is whole. Items are a stated query set: they come to the driver in
    slices of at most SLICE_TERMS terms, and each slice is one pass over the documents. Empty tables give an empty result.
    """
    spark = bounded(docs.sparkSession)
    schema, out = "item_id long, rank int, doc_id long, score long", None
    given = items.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).where("i IS NOT NULL").orderBy("i", "t")
    for number, (part, known) in enumerate(slices_of((r.i, r.t) for r in given.toLocalIterator())):
        sc = spark.sparkContext
        postings = written(asked_postings(docs, sc.broadcast(known), id_col, text_col), "lexical-postings")
        n, total = postings.agg(F.count("*"), F.sum("n")).first()
        df = document_frequencies(postings, len(known))
        weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()]
        # each item has a number of its own, so that repeated ids stay apart
        held = sc.broadcast([(i, {t: count * weight[t] for t, count in terms.items() if df[t]}) for i, (_, terms) in enumerate(part)])
        found = written(_ranked(postings.where("doc_id IS NOT NULL"), held, k, n, total or 1), "lexical-found")
        best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(part)], "at int, item long")
        rows = found.join(ids, F.col("item_id") == F.col("at")).select(F.col("item").alias("item_id"), "rank", "doc_id", "score")
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], schema) if out is None else out


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return ranked_search(table(spark, sf_dir, "documents"), items)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
held AS (SELECT doc_id, len(t) AS n, t FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS cn, CAST(sum(n) AS BIGINT) AS cl FROM held),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM held) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * cn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
r AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * cn) // cl))))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""
