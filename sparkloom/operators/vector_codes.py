"""A stored index of product-quantised vectors: codes are scanned, a few full vectors are read.

Unit vectors are cut into pieces of PIECE components; each piece is replaced by the number of its nearest centre among
256, fitted for that piece on a bounded sample. A vector is then a code of one byte a piece, stored beside its key. A
query has a table of inner products of its pieces with all centres, and the score of a code is the sum of one entry for
each byte. A task keeps the ``rerank`` best codes of a query; the best of all tasks are scored exactly on their full
vectors, which are the only ones read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import topk_per_group
from .stored import batches_bounded, scratch

#: Components of a piece, centres of a piece, sampled vectors, and queries whose tables a task holds at once.
PIECE, CENTRES, SAMPLE, ASKED = 4, 256, 8192, 512


class Codes(NamedTuple):
    codes: DataFrame  # key, code
    vectors: DataFrame  # key, vec
    centres: np.ndarray  # pieces, centres, components of a piece
    n: int


def unit(vectors, width: int | None = None) -> np.ndarray:
    """Vectors as rows of length one; shorter ones end in zeros."""
    rows = list(vectors)
    width = width or max(map(len, rows), default=1)
    v = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        v[i, : min(len(x), width)] = x[:width]
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _pieces(v: np.ndarray) -> np.ndarray:
    v = np.pad(v, ((0, 0), (0, -v.shape[1] % PIECE)))
    return v.reshape(len(v), v.shape[1] // PIECE, PIECE)


def _nearest(p: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * p @ centres.T).argmin(axis=1)


def fit_centres(v: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Sampled unit vectors → the centres of each piece by k-means."""
    p = _pieces(v)
    out = np.zeros((p.shape[1], CENTRES, PIECE))
    for i in range(p.shape[1]):
        x = p[:, i]
        c = x[np.linspace(0, len(x) - 1, CENTRES).astype(int)].copy() if len(x) else out[i]
        for _ in range(rounds if len(x) else 0):
            at = _nearest(x, c)
            count = np.bincount(at, minlength=CENTRES)
            total = np.stack([np.bincount(at, x[:, j], CENTRES) for j in range(PIECE)], axis=1)
            c[count > 0] = total[count > 0] / count[count > 0, None]
        out[i] = c
    return out


def code_of(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    p = _pieces(v)
    return np.stack([_nearest(p[:, i], centres[i]) for i in range(p.shape[1])], axis=1).astype(np.uint8)


def write_codes(vectors: DataFrame, path: str, sample: int = SAMPLE) -> None:
    """vectors(key, vec) → codes, vectors and centres below ``path``. Every vector has a code; centres alone come from the
    ``sample`` vectors of the least hashes. Rows without a vector take no part; keys are unique."""
    spark = batches_bounded(vectors.sparkSession)
    rows = vectors.where("vec IS NOT NULL AND size(vec) > 0").select("key", "vec")
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 1
    centres = fit_centres(unit([r.vec for r in rows.orderBy(F.xxhash64("key"), "key").limit(sample).select("vec").collect()], width))

    def run(batches):
        for pdf in batches:
            code = code_of(unit(pdf["vec"], width), centres)
            yield pd.DataFrame({"key": pdf["key"], "code": [c.tobytes() for c in code]})

    key = vectors.schema["key"].dataType.simpleString()
    rows.write.parquet(f"{path}/vectors")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/vectors")
    stored.mapInPandas(run, f"key {key}, code binary").write.parquet(f"{path}/codes")
    flat = [(i, c.ravel().tolist()) for i, c in enumerate(centres)]
    spark.createDataFrame(flat, "piece int, centres array<double>").coalesce(1).write.parquet(f"{path}/centres")


def open_codes(spark: SparkSession, path: str) -> Codes:
    parts = spark.read.parquet(f"{path}/centres").orderBy("piece").collect()
    vectors, codes = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/codes")
    return Codes(codes, vectors, np.array([r.centres for r in parts]).reshape(len(parts), CENTRES, PIECE), codes.count())


def coded(vectors: DataFrame) -> Codes:
    path = scratch(vectors.sparkSession, "codes")
    write_codes(vectors, path)
    return open_codes(vectors.sparkSession, path)


def _best_codes(store: Codes, ids: np.ndarray, q: np.ndarray, rerank: int) -> DataFrame:
    """A slice of queries, ids and unit vectors → (query_id, key, score): each task's best codes."""
    spark, width = store.codes.sparkSession, store.centres.shape[0] * PIECE
    tables = np.einsum("qpc,pkc->pqk", _pieces(np.pad(q, ((0, 0), (0, width - q.shape[1])))), store.centres).astype(np.float32)
    held = spark.sparkContext.broadcast((ids, tables))  # ASKED queries of a kilobyte a piece
    key = store.codes.schema["key"].dataType.simpleString()

    def run(batches):
        asked, table = held.value
        keys, scores = np.zeros((len(asked), 0), object), np.zeros((len(asked), 0), np.float32)
        for pdf in batches:
            code = np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), table.shape[0])
            s = sum(table[p][:, code[:, p]] for p in range(code.shape[1]))
            scores = np.concatenate([scores, s], axis=1)
            keys = np.concatenate([keys, np.broadcast_to(pdf["key"].to_numpy(object), s.shape)], axis=1)
            if scores.shape[1] > rerank:
                at = np.argpartition(-scores, rerank - 1, axis=1)[:, :rerank]
                scores, keys = np.take_along_axis(scores, at, 1), np.take_along_axis(keys, at, 1)
        yield pd.DataFrame({"query_id": np.repeat(asked, scores.shape[1]), "key": keys.ravel(), "score": scores.ravel()})

    return store.codes.mapInPandas(run, f"query_id long, key {key}, score float")


def search_codes(queries: DataFrame, store: Codes, k: int, rerank: int | None = None, digits: int = 6) -> DataFrame:
    """queries(query_id, vec) → (query_id, key, score, rank): about the k nearest by cosine, with exact scores.

    ``rerank`` codes of a query are scored on full vectors, by default a twentieth of the vectors, 5 k at least and 300 at
    most unless k asks for more. Queries are a stated set: they come to the driver ASKED at a time, and each slice is one
    scan of the codes. Queries without a vector have no rows."""
    spark = batches_bounded(queries.sparkSession)
    rerank = rerank or max(5 * k, min(300, store.n // 20))
    width, out = store.centres.shape[0] * PIECE, None
    rows = queries.where("vec IS NOT NULL AND size(vec) > 0").select(F.col("query_id").cast("long").alias("query_id"), "vec")
    part: list = []

    def found(part: list) -> DataFrame:
        return _best_codes(store, np.array([r.query_id for r in part], np.int64), unit([r.vec for r in part], width), rerank)

    for r in rows.toLocalIterator():
        part.append(r)
        if len(part) == ASKED:
            out, part = found(part) if out is None else out.unionByName(found(part)), []
    if part:
        out = found(part) if out is None else out.unionByName(found(part))
    key = store.codes.schema["key"].dataType.simpleString()
    if out is None:
        return spark.createDataFrame([], f"query_id long, key {key}, score double, rank int")
    best = topk_per_group(out, ["query_id"], [F.desc("score"), F.col("key")], rerank).select("query_id", "key")
    full = best.join(store.vectors, "key").join(rows.withColumnRenamed("vec", "q"), "query_id").select("query_id", "key", "q", "vec")

    def exact(batches):
        for pdf in batches:
            s = np.round((unit(pdf["q"], width) * unit(pdf["vec"], width)).sum(axis=1), digits)
            yield pd.DataFrame({"query_id": pdf["query_id"], "key": pdf["key"], "score": s})

    scored = full.mapInPandas(exact, f"query_id long, key {key}, score double")
    return topk_per_group(scored, ["query_id"], [F.desc("score"), F.col("key")], k)
