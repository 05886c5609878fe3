"""Operator 11: near-duplicates by MinHash, with fast similarity sketches.

A sketch has T coordinates. Round i throws every shingle into a hashed bin with a hashed value and a coordinate keeps
the least (round, value) that reached its bin; from round T on, round i throws all shingles into bin i - T, so every
coordinate is filled after at most 2 T rounds, and in fact after about T ln T throws. Two sketches agree in a
coordinate with a chance of the Jaccard measure, concentrated as for independent coordinates, while a long text needs
one round instead of T hashes a shingle.

BANDS bands of ROWS coordinates give candidates: two sets at 0.8 share none of them with a chance of
(1 - 0.8 ** 5) ** 40, one in eight million. Candidates are confirmed on full sets; bands that many sets share are
settled without listing their pairs (``crowds``). Equal sets are one node throughout.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table, text_key, written
from .components import connected_components
from .crowds import HOT, group_links
from .simhash import shingles_of

BANDS, ROWS = 40, 5
T = BANDS * ROWS
_STEP, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bits of a value; those above hold the round.
_VALUE = 48
_EMPTY = np.uint64(2**64 - 1)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _A
    z = (z ^ (z >> np.uint64(27))) * _B
    return z ^ (z >> np.uint64(31))


def sketch_of(s: np.ndarray, t: int = T) -> np.ndarray:
    """Distinct hashes of a set → its t coordinates, (round, value) in one number each. A set has one element at least."""
    out = np.full(t, _EMPTY, np.uint64)
    # rounds are taken several at once where the set is small; a later round never replaces an earlier one
    at, step = 0, max(1, int(1.2 * t * np.log(max(t, 2)) / len(s)))
    while at < 2 * t:
        stop = min(at + step, t if at < t else 2 * t)
        rounds = np.arange(at, stop, dtype=np.uint64)[:, None]
        z = _mixed(s[None, :] + (rounds + np.uint64(1)) * _STEP)
        value = (rounds << np.uint64(_VALUE)) | (z >> np.uint64(64 - _VALUE))
        if at < t:
            bins = ((z & np.uint64(0xFFFF)) * np.uint64(t)) >> np.uint64(16)
            np.minimum.at(out, bins.ravel().astype(np.intp), value.ravel())
        else:
            own = slice(at - t, stop - t)
            out[own] = np.minimum(out[own], value.min(axis=1))
        if (out != _EMPTY).all():
            break
        at = stop
    return out


def bands_of(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A sketch → one key for each band; the band's number is part of the key."""
    rows = sketch.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _STEP
    for column in rows.T:
        key = _mixed(key ^ column) + _STEP
    return _mixed(key).view(np.int64)


def _set_id(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes(), 42)


def sketches(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """docs → (doc_id, key, id, n, bands): the hash that tells rows of an id apart, the set's hash and size, its bands.
    A set without shingles has no bands."""

    def run(batches):
        for pdf in batches:
            ids, sizes, bands = [], [], []
            for t in pdf.pop("text"):
                s = np.unique(shingles_of(t, shingle))
                ids.append(_set_id(s))
                sizes.append(len(s))
                bands.append(bands_of(sketch_of(s)) if len(s) else np.zeros(0, np.int64))
            yield pdf.assign(id=np.array(ids, np.uint64).view(np.int64), n=sizes, bands=bands)

    bounded(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, key long, id long, n int, bands array<long>")


def sets_of_texts(texts: DataFrame, shingle: int) -> DataFrame:
    """texts(text) → (id, s): the distinct shingle hashes of each."""

    def run(batches):
        for pdf in batches:
            sets = [np.unique(shingles_of(t, shingle)) for t in pdf["text"]]
            yield pd.DataFrame({"id": np.array([_set_id(s) for s in sets], np.uint64).view(np.int64), "s": [s.view(np.int64) for s in sets]})

    bounded(texts.sparkSession)
    return texts.mapInPandas(run, "id long, s array<long>")


def near_groups(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """docs → (doc_id, n_shingles, component_id, kept): one row per input row.

    component_id is the least doc_id that links at a Jaccard of ``threshold`` or more reach, the row itself included;
    kept tells whether it is the row's own.

    A null, empty or word-less text has an empty set, is linked with nothing and is its own component. A row with a
    null id takes part with its text; its kept is true where its whole component has no id. Rows that repeat an id are
    rows of their own, each with its own text. Equal sets are copies of one node, however many. A very long text is
    one row. An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    rows = written(sketches(docs, shingle, id_col, text_col), "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    worded = rows.where("n > 0")
    # of each set one row, whose text is read again where the set has a candidate
    nodes = written(worded.groupBy("id").agg(F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.min(F.struct("doc_id", "key")).alias("row")), "minhash-nodes")
    members = nodes.select(F.explode("bands").alias("at"), "id", "n")

    def sets_of(ids: DataFrame) -> DataFrame:
        asked = nodes.join(ids, "id", "left_semi").select(F.coalesce("row.doc_id", F.lit(0)).alias("o"), F.col("row.doc_id").isNull().alias("none"), F.col("row.key").alias("key"))
        keyed = texts.select(F.coalesce("doc_id", F.lit(0)).alias("o"), F.col("doc_id").isNull().alias("none"), text_key(F.col("text")).alias("key"), "text")
        found = keyed.join(asked, ["o", "none", "key"], "left_semi")
        return sets_of_texts(found.select("text"), shingle).dropDuplicates(["id"])

    links = group_links(members, sets_of, threshold, hot=hot)
    found = connected_components(links).withColumnRenamed("node", "id")
    placed = nodes.select("id", "least_id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = placed.join(least, "component").select("id", "component_id")
    out = rows.select("doc_id", "n", "id").join(known, "id", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), shingle=2)
