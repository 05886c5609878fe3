"""Operator 6: a quality classifier of histogram gradient-boosted trees over document statistics.

Statistics are taken from whole texts in Arrow batches. Trees grow on a bounded sample of labelled rows: statistics are
cut into at most 64 bins by their quantiles, and gradients and Hessians of the logistic loss are summed per bin, so a
level of a tree costs one pass of bincount. The model is a handful of arrays (feature, threshold, children, value) that
travel with the task; scoring walks all trees of a batch by array indexing, one step for each level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table

#: The most labelled rows to learn from; of more, those with the least hash of their id are taken.
SAMPLE = 20_000
STATISTICS = (
    "chars", "words", "lines", "word_length", "upper", "digit", "punctuation", "symbol", "bar", "bang", "space", "wide", "distinct", "top_word",
    "long_word", "capital_words", "bare_words", "symbol_words", "line_words", "repeated_lines", "sentence_end", "hash_like", "short_line", "word_spread",
)
_KIND = np.zeros((256, 9), np.float64)
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()?-", b"#*$%&<>=_{}[]\\/@^~`+", b"|", b"!", b" \t\n\r\x0b\x0c", bytes(range(128, 256)), b"\n")):
    _KIND[list(_set), _i] = 1


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text; all zero for null, empty and word-less ones, but for characters."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    upper, digit, punct, symbol, bar, bang, space, wide, feeds = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _KIND) / n
    w = data.split()
    if not w:
        return [float(np.log1p(len(data))), *[0.0] * (len(STATISTICS) - 1)]
    size = np.fromiter(map(len, w), np.int64, len(w))
    count: dict[bytes, int] = {}
    for x in w:
        count[x] = count.get(x, 0) + 1
    kinds = list(count)
    times = np.fromiter(count.values(), np.float64, len(kinds))
    marks = np.array([(x.isupper(), not any(c > 127 or 65 <= c <= 90 or 97 <= c <= 122 for c in x), x[-1] in b"#*$%&|<>", len(x) > 24, len(x) >= 16 and x.strip(b'"').isalnum() and any(48 <= c <= 57 for c in x), x[-1] in b".?!") for x in kinds], np.float64)
    capital, bare, marked, long, hashed, ends = times @ marks / len(w)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        float(np.log1p(len(data))), float(np.log1p(len(w))), float(np.log1p(len(lines))), float(size.mean()), upper, digit, punct, symbol, bar, bang, space, wide,
        len(kinds) / len(w) ** 0.8, float(times.max()) / len(w), long, capital, bare, marked, len(w) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), ends, hashed,
        sum(len(x) < 30 for x in lines) / max(1, len(lines)), float(size.std()),
    ]


@dataclass
class Trees:
    """Flattened trees: row t of each array is a complete binary tree, children of node i at 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.1, bins: int = 64, least: float = 3.0, ridge: float = 1.0) -> Trees:
    """Boosts ``trees`` trees on rows x with 0/1 targets y. Without rows, or with one class, a constant results."""
    n, m = x.shape if len(x) else (0, len(STATISTICS))
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base, depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-9)
            for j in range(m):
                key = at * bins + binned[:, j]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least / 4) | (ht - hs < least / 4)] = 0
                gain = gain[:, : len(edges[j])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = j
                threshold[first : first + width][better] = edges[j][k[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base, depth)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Learns from at most ``sample`` labelled documents; rows with a null label or id are left out; of an id that is
    labelled twice the larger label counts. The statistics of the sample, some hundred bytes a row, are all that
    reaches the driver; where documents repeat an id, ``sample`` bounds their rows as well. Without a row, or with one
    class, the model is a constant."""
    rows = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("double").alias("y"))
    rows = rows.where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = texts.join(F.broadcast(rows), "doc_id")  # at most ``sample`` rows of two numbers

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": [statistics(t) for t in pdf["text"]]})

    known = known.select("doc_id", "y", "text").mapInPandas(run, "doc_id long, y double, x array<double>")
    got = known.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("x")).limit(sample).toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(STATISTICS))
    return grow(x, got["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs → (doc_id, score): the probability of label 1 of every row.

    Null and empty texts are scored as texts without words; null ids stay null; rows that repeat an id are rows of their
    own, and equal texts have equal scores; very long texts are read whole; an empty table gives an empty result; other
    columns are not read, whatever their names."""

    def run(batches):
        for pdf in batches:
            x = np.array([statistics(t) for t in pdf["text"]], np.float64).reshape(len(pdf), len(STATISTICS))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": model.score(x)})

    bounded(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, score double")


def op6_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = train(docs, labels.where(fold != 1))
    return score(docs, model).select("doc_id", (fold == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
