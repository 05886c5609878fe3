"""Operator 12: hard negatives by a secondary-sort shuffle.

Pairs of an anchor and a row are packed into keys (anchor, descending score, positives first, id) and go through
repartitionAndSortWithinPartitions: an anchor's pairs reach one task in order of their scores. A streaming iterator
opens a window at each positive and hands every negative to the windows that are open to it; it holds the few windows
of one anchor, never an anchor's rows. A window ends below the score of its positive, so a positive always comes first.

All scores of an anchor would be as many as there are rows, so each task combines before the shuffle, as an aggregate
does: the first scan keeps an anchor's first positives among the task's rows, the second one, which knows the windows,
the first negatives of each window. Whatever is first among all rows is first among those of its task. Anchors are
dealt into slices of bounded bytes; a slice is broadcast and meets all rows in one pass, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.rdd import portable_hash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, table, written

#: Bytes of a slice of anchors (eight a component), and anchors that are scored at once against a batch of rows.
SLICE_BYTES, BLOCK = 16 << 20, 512
_NONE = np.iinfo(np.int64).min


def quantised(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = 256) -> DataFrame:
    """rows → (id, row, label, q array<long>): the rows that take part, with floor(scale * x) of each component.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; nor do vectors without a
    component. ``row`` tells rows of one id apart by label and vector; rows equal in all three count once."""
    x = F.col(vector_col)
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    given = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(x, lambda v: v.cast("double")).alias("x"))
    kept = given.where("id IS NOT NULL AND label IS NOT NULL AND size(x) > 0").where(~F.exists("x", odd))
    q = kept.select("id", "label", F.transform("x", lambda v: F.floor(scale * v)).alias("q"))
    return q.select("id", F.xxhash64("label", "q").alias("row"), "label", "q").dropDuplicates(["id", "row"])


def _matrix(vectors, width: int) -> np.ndarray:
    """Vectors as rows of one matrix; a missing component is 0."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v[:width]
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exactly: in doubles where no sum can leave their whole numbers, else in 64-bit integers."""
    top = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if top < 2**53 else a @ b.T


class _First:
    """The first k of each slot, by descending score, then id, then row."""

    def __init__(self, slots: int, k: int):
        self.k, self.score = k, np.full((slots, k), _NONE)
        self.id, self.row = np.zeros((slots, k), np.int64), np.zeros((slots, k), np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        if not len(slot):
            return
        hit = np.unique(slot)
        s = np.concatenate([np.repeat(hit, self.k), slot])
        v, i, r = (np.concatenate([old[hit].ravel(), new]) for old, new in ((self.score, score), (self.id, id_), (self.row, row)))
        order = np.lexsort((r, i, ~v, s))  # ~v: descending, and defined for the least number too
        s, v, i, r = s[order], v[order], i[order], r[order]
        begin = np.searchsorted(s, hit)
        at = begin[:, None] + np.arange(self.k)  # every slot has k entries at least
        self.score[hit], self.id[hit], self.row[hit] = v[at], i[at], r[at]


def _scan(rows: DataFrame, held, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """rows and a broadcast slice of anchors → (anchor, mark, score, id, row): of each task's rows the first positives of
    every anchor, or, where the slice has its positives' scores, the first negatives of every window."""

    def run(batches: Iterator[pd.DataFrame]):
        a_id, a_row, a_label, a_q, tops = held.value
        count, width = a_q.shape
        best = _First(count, positives) if tops is None else _First(count * positives, negatives)
        for pdf in batches:
            ids, marks, labels = (pdf[c].to_numpy(np.int64) for c in ("id", "row", "label"))
            longest = max(map(len, pdf["q"]), default=0)
            b = _matrix(pdf["q"].tolist(), max(width, longest))
            for at in range(0, count, BLOCK):
                part = slice(at, min(at + BLOCK, count))
                q = a_q[part]
                q = np.pad(q, ((0, 0), (0, b.shape[1] - width))) if b.shape[1] > width else q
                score = _scores(q, b)
                same = a_label[part, None] == labels[None, :]
                if tops is None:
                    own = (a_id[part, None] == ids[None, :]) & (a_row[part, None] == marks[None, :])
                    x, y = np.nonzero(same & ~own & (score >= best.score[part, -1:]))
                    best.add(x + at, score[x, y], ids[y], marks[y])
                else:
                    for p in range(positives):
                        top = tops[part, p : p + 1]
                        worst = best.score[at * positives + p : part.stop * positives : positives, -1:]
                        x, y = np.nonzero(~same & (top != _NONE) & (low * top <= 100 * score) & (100 * score <= high * top) & (score >= worst))
                        best.add((x + at) * positives + p, score[x, y], ids[y], marks[y])
        slot, k = np.nonzero(best.score != _NONE)
        out = slot if tops is None else slot // positives
        yield pd.DataFrame({"anchor": a_id[out], "mark": a_row[out], "score": best.score[slot, k], "id": best.id[slot, k], "row": best.row[slot, k]})

    return rows.mapInPandas(run, "anchor long, mark long, score long, id long, row long")


def _slices(anchors: DataFrame) -> list[DataFrame]:
    """Anchors in slices of at most about SLICE_BYTES."""
    size = anchors.agg(F.sum(8 * F.size("q") + 64)).first()[0] or 0
    n = -(-size // SLICE_BYTES)
    return [anchors.where(F.pmod(F.xxhash64("id", "row", F.lit(7)), F.lit(n)) == i) for i in range(n)]


def _held(part: DataFrame, positives: int | None):
    """A slice as arrays, broadcast: its size is bounded by _slices."""
    got = part.collect()
    if not got:
        return None
    tops = None
    if positives is not None:
        tops = np.full((len(got), positives), _NONE)
        for i, r in enumerate(got):
            tops[i, : len(r.tops)] = r.tops
    longs = [np.array([r[c] for r in got], np.int64) for c in ("id", "row", "label")]
    return part.sparkSession.sparkContext.broadcast((*longs, _matrix([r.q for r in got], max(len(r.q) for r in got)), tops))


def windows(pairs: Iterator, negatives: int, low: int, high: int):
    """Sorted ((anchor, mark, -score, kind, id, row), None), kind 0 for positives → (anchor, positive, rank, negative,
    positive's score, negative's score). Windows of one anchor are all that is held."""
    now, opened = None, []
    for (anchor, mark, minus, kind, id_, _), _ in pairs:
        if (anchor, mark) != now:
            now, opened = (anchor, mark), []
        if kind == 0:
            opened.append([id_, -minus, 0])
            continue
        for w in opened:
            if w[2] < negatives and low * w[1] <= -100 * minus <= high * w[1]:
                w[2] += 1
                yield anchor, w[0], w[2], id_, w[1], -minus


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """rows of ``quantised`` → (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` says which rows are anchors. An anchor's positives are its first other rows of its label, its negatives
    for a positive the first rows of other labels with low * positive_score <= 100 * negative_score <= high *
    positive_score; first means by descending score, then id. A positive of a negative score has none.

    Vectors of different lengths are compared as if the shorter one ended in zeros. Scores are 64-bit integers. Rows
    that share an id and differ otherwise are rows of their own, as anchors and as partners, and an anchor's id then
    stands for all of them. Fewer positives or negatives than asked for are all that there are; an empty table, or one
    without anchors, gives an empty result.
    """
    spark = bounded(rows.sparkSession)
    rows = written(rows, "negatives-rows")
    chosen = rows.where(anchors)

    def scanned(slices: list[DataFrame], known: int | None) -> DataFrame | None:
        out = None
        for part in slices:
            held = _held(part, known)
            if held is not None:
                found = written(_scan(rows, held, positives, negatives, low, high), "negatives-found")
                held.destroy()
                out = found if out is None else out.unionByName(found)
        return out

    first = scanned(_slices(chosen), None)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if first is None:
        return spark.createDataFrame([], schema)
    order = Window.partitionBy("anchor", "mark").orderBy(F.desc("score"), "id", "row")
    first = written(first.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives).drop("k"), "negatives-positives")
    tops = first.groupBy(F.col("anchor").alias("id"), F.col("mark").alias("row")).agg(F.collect_list("score").alias("tops"))  # a few each
    rest = scanned(_slices(chosen.join(tops, ["id", "row"])), positives)
    if rest is None:
        return spark.createDataFrame([], schema)
    both = first.withColumn("kind", F.lit(0)).unionByName(rest.distinct().withColumn("kind", F.lit(1)))
    keyed = both.rdd.map(lambda r: ((r.anchor, r.mark, -r.score, r.kind, r.id, r.row), None))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionAndSortWithinPartitions(parts, lambda k: portable_hash((k[0], k[1])))
    return spark.createDataFrame(dealt.mapPartitions(lambda pairs: windows(pairs, negatives, low, high)), schema, verifySchema=False)


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(quantised(rows, "vec_id", "embedding", label), F.col("id") % 50 == 0)


ORACLE = """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
pos AS (
  SELECT anchor_id, id AS positive_id, score AS ps FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
neg AS (
  SELECT pos.anchor_id, positive_id, p.id AS negative_id, ps, p.score AS ns FROM pos JOIN p ON p.anchor_id = pos.anchor_id AND NOT p.same
  WHERE 50 * ps <= 100 * p.score AND 100 * p.score <= 95 * ps)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY ns DESC, negative_id) AS INTEGER) AS rank, negative_id, ps AS positive_score, ns AS negative_score
FROM neg QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY ns DESC, negative_id) <= 3"""
