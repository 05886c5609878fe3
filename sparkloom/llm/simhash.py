"""Operator 1: SimHash near-duplicates through multi-index hashing.

Pairs at two or fewer differing bits are found by two 32-bit segments. Two bits spread over two segments leave the
left one with at most one, or the right one with none; so a fingerprint probes the Hamming ball of radius 1 around
its left segment and of radius 0 around its right segment, and full distances are verified on what the table returns.
A single differing left bit is 0 on one side, so flipping zero bits alone meets every such pair once.

Segment values that more than ``hot`` distinct fingerprints share would give pairs by the square of the group. They are
indexed again in the same way: the bits outside the value are cut into two segments, with balls of radius 1 and 0, and
a probe holds the crowded value and one of them. That happens twice at most, for then 56 bits of a key are fixed and no
more than 256 distinct fingerprints can share it. All pairs within two bits are found, whatever ``hot`` is.

Equal fingerprints are one node throughout; copies are never expanded into pairs. Rows are told apart by their id and a
hash of their text, so a repeated id neither merges texts nor loses one.

``alike_links`` is for stages that ask for a Jaccard of shingle sets. Texts at 0.8 differ in about ten of 64 bits, which
no ball reaches, so links within two bits are joined by those of min-hash bands, and every link is verified in full.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, table, unused, written
from .components import connected_components
from .crowds import group_links

SEED = 42
#: Min-hash bands: two sets at a Jaccard of 0.8 share none of them with a chance of 0.68 ** 20, one in 2800.
BANDS, ROWS = 20, 5
#: Sets of a band that are compared pair by pair; more are settled by their differences.
HOT = 64


def shingles_of(text: str | None, shingle: int = 3) -> np.ndarray:
    """XXH64 of the word shingles of one text in order, repeats too; none if it has no words."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() and split() know ASCII alone
    if not w:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in runs), np.uint64, max(1, len(w) - shingle + 1))


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text as an unsigned number; zero if it has no words."""
    return _voted(shingles_of(text, shingle))


def _voted(h: np.ndarray) -> int:
    total, counts = len(h), np.zeros(64, np.int64)
    for at in range(0, total, 1 << 15):
        bits = np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """docs → (doc_id, fp long): a 64-bit SimHash of the XXH64 of all word shingles, lower-cased A-Z.

    Null and word-less texts get 0; a text of fewer words than a shingle is one shingle; repeated shingles count.
    """

    def run(batches):
        for pdf in batches:
            fp = np.array([fingerprint_of(t, shingle) for t in pdf["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp.view(np.int64)})

    bounded(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bits(mask: int) -> list[int]:
    return [1 << i for i in range(64) if mask >> i & 1]


def _halves(mask: int) -> tuple[int, int]:
    """The bits outside a mask as two masks of equal size, the upper ones first."""
    rest = _bits(~mask & (1 << 64) - 1)
    return sum(rest[len(rest) // 2 :]), sum(rest[: len(rest) // 2])


def _lit(mask: int) -> Column:
    return F.lit(_signed(mask)).cast("long")


def near_links(fps: DataFrame, hot: int = 64) -> DataFrame:
    """Distinct fingerprints (fp) → all links (a, b), a < b, of two or fewer differing bits, each once.

    A fingerprint has at most 2080 neighbours within two bits, so links grow in line with fingerprints. Rows of the
    table and of the probes carry the fixed bits of a key (mask, value); values shared by more than ``hot``
    fingerprints are keyed again by a segment more."""
    fp = F.col("fp")
    far = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= 2

    def keyed(rows: DataFrame, mask: int, part: int, flips: Column | None) -> DataFrame:
        """Rows (fp, val) of values on ``mask`` → rows on mask and part, with the values that ``flips`` lists too."""
        own = F.col("val").bitwiseOR(fp.bitwiseAND(_lit(part)))
        values = F.array(own) if flips is None else F.concat(F.array(own), F.transform(flips, own.bitwiseXOR))
        return rows.select("fp", F.explode(values).alias("val"), _lit(mask | part).alias("mask"))

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    start = fps.select("fp", F.lit(0).cast("long").alias("val"))
    upper, lower = _halves(0)
    zeros = F.filter(F.array(*[_lit(b) for b in _bits(upper)]), lambda b: fp.bitwiseAND(b) == 0)
    table = union([keyed(start, 0, m, None) for m in (upper, lower)])
    probes = union([keyed(start, 0, upper, zeros), keyed(start, 0, lower, None)])
    masks, found = [upper, lower], []
    for level in range(3):
        if level < 2:
            crowded = table.groupBy("mask", "val").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("mask", "val")
            crowded = written(crowded, "simhash-crowded")
            light, more = table.join(crowded, ["mask", "val"], "left_anti"), table.join(crowded, ["mask", "val"], "left_semi")
            asked = probes.join(crowded, ["mask", "val"], "left_semi")
        else:
            light, more = table, None
        met = probes.alias("p").join(light.alias("t"), ["mask", "val"]).where((F.col("p.fp") != F.col("t.fp")) & far(F.col("p.fp"), F.col("t.fp")))
        found.append(met.select(F.least("p.fp", "t.fp").alias("a"), F.greatest("p.fp", "t.fp").alias("b")))
        if more is None or crowded.isEmpty():
            break
        halves = {m: _halves(m) for m in masks}
        on = lambda rows, m: rows.where(F.col("mask") == _lit(m)).select("fp", "val")
        table = written(union([keyed(on(more, m), m, part, None) for m, both in halves.items() for part in both]), "simhash-table")
        probes = written(union([keyed(on(asked, m), m, a, F.array(*[_lit(x) for x in _bits(a)])) for m, (a, _) in halves.items()] + [keyed(on(asked, m), m, b, None) for m, (_, b) in halves.items()]), "simhash-probes")
        masks = [m | part for m, both in halves.items() for part in both]
    return union(found).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, hot: int = 64) -> DataFrame:
    """docs → (doc_id, fingerprint, component_id, n_links): one row per input row.

    component_id is the least doc_id that links of two or fewer differing bits reach, the row itself included, and
    n_links the number of other fingerprints within two bits of the row's. An empty table gives an empty result; a row
    with a null id keeps its null id and takes part with its text, and a group of such rows alone has a null
    component_id; rows that repeat an id are rows of their own, each with its own text; a very long text is one row;
    other columns are not read, whatever their names.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    links = written(near_links(nodes.select("fp"), hot), "simhash-links")
    found = connected_components(links).withColumnRenamed("node", "fp")
    placed = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    known = placed.join(least, "component").join(degree, "fp", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return fps.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


def _row_key(id_: Column, text: Column) -> tuple[Column, Column]:
    """Two columns that tell rows apart by id and text and are never null, so that joins and groups share a shuffle."""
    id_ = id_.cast("long")
    return F.coalesce(id_, F.lit(0).cast("long")), F.xxhash64(F.coalesce(text, F.lit("")), id_.isNull())


def _one_of_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """documents and row keys (own, key) → the rows with these keys; of rows with one key that with the least other
    columns."""
    own, mark, at = unused(docs, "__own"), unused(docs, "__key"), unused(docs, "__at")
    o, k = _row_key(F.col("doc_id"), F.col("text"))
    keyed = docs.withColumn(own, o).withColumn(mark, k)
    rows = keyed.join(kept.select(F.col("own").alias(own), F.col("key").alias(mark)), [own, mark], "left_semi")
    order = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]), {"ignoreNullFields": "false"})
    rows = rows.withColumn(at, F.row_number().over(Window.partitionBy(own, mark).orderBy(order)))
    return rows.where(F.col(at) == 1).select(docs.columns)


def _least(name: str) -> Column:
    """The least row of a group: by id, null ids last, then by its key."""
    return F.min(F.struct("none", "own", "key")).alias(name)


def _bands_of(s: np.ndarray, mix: np.ndarray) -> list[int]:
    """A set of shingle hashes → one key for each band; the band is part of the key."""
    import xxhash

    least = np.full(len(mix), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1 << 12):
        least = np.minimum(least, (mix[:, None] * s[None, at : at + (1 << 12)]).min(axis=1))
    return [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, ROWS))]


def sketches(docs: DataFrame, shingle: int, banded: bool = True) -> DataFrame:
    """documents → (none, own, key, fp, same, n, bands): whether the id is null and the row's key, its SimHash, a hash of
    the whole shingle set, its size and its band keys, null if not ``banded``."""

    def run(batches):
        mix = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
        for pdf in batches:
            fp, same, sizes, bands = [], [], [], []
            for t in pdf.pop("text"):
                h = shingles_of(t, shingle)
                fp.append(_voted(h))
                if banded:
                    s = np.unique(h)
                    same.append(_set_hash(s))
                    sizes.append(len(s))
                    bands.append(np.array(_bands_of(s, mix), np.uint64).view(np.int64))
            long = lambda x: np.array(x, np.uint64).view(np.int64)
            yield pdf.assign(fp=long(fp), same=long(same) if banded else 0, n=sizes if banded else 0, bands=bands if banded else None)

    bounded(docs.sparkSession)
    own, key = _row_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(F.col("doc_id").isNull().alias("none"), own.alias("own"), key.alias("key"), "text")
    return rows.mapInPandas(run, "none boolean, own long, key long, fp long, same long, n int, bands array<long>")


def _set_hash(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.tobytes(), SEED)


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """documents → (same, s): the distinct shingle hashes of each text, and the hash of their set."""

    def run(batches):
        for pdf in batches:
            sets = [np.unique(shingles_of(t, shingle)) for t in pdf["text"]]
            yield pd.DataFrame({"same": np.array([_set_hash(s) for s in sets], np.uint64).view(np.int64), "s": [s.view(np.int64) for s in sets]})

    bounded(docs.sparkSession)
    return docs.select("text").mapInPandas(run, "same long, s array<long>")


def alike_links(docs: DataFrame, nodes: DataFrame, shingle: int, threshold: float, hot: int = HOT) -> DataFrame:
    """documents and nodes (same, least, fp, n, bands) of distinct sets → links (a, b) of sets at a Jaccard of
    ``threshold`` or more.

    Sets that share a band, or a fingerprint, are a group; no alike pair of a group is left apart, however many share it
    (``crowds``). Links of fingerprints come on top."""
    members = nodes.select(F.explode(F.concat("bands", F.array(F.xxhash64("fp")))).alias("at"), F.col("same").alias("id"), "n")
    fps = nodes.groupBy("fp").agg(F.min("same").alias("a"))
    end = lambda c: fps.select(F.col("fp").alias(c), F.col("a").alias(f"{c}_id"))
    near = near_links(fps.select("fp")).join(end("a"), "a").join(end("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))

    def sets_of(ids: DataFrame) -> DataFrame:
        asked = nodes.join(ids.withColumnRenamed("id", "same"), "same", "left_semi").select("least.own", "least.key")
        return shingle_sets(_one_of_each(docs.select("doc_id", "text"), asked), shingle).toDF("id", "s")

    return group_links(members, sets_of, threshold, more=near, hot=hot)


def _kept(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """documents and rows (none, own, key, group) → the least row of every group."""
    return _one_of_each(docs, groups.groupBy("group").agg(_least("least")).select("least.*"))


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """documents → one document of every group chained by two or fewer differing bits, with all its columns: that with
    the least doc_id, of one id that with the least hash of its text, of equal rows that with the least other columns.

    Rows with null ids come last: one stays only where its group has no row with an id. Null and empty texts are one
    group. An empty table gives an empty result."""
    rows = written(sketches(docs, shingle, banded=False).select("none", "own", "key", "fp"), "keep-one")
    links = written(near_links(rows.select("fp").distinct()), "keep-one-links")
    found = connected_components(links)
    groups = rows.join(found, rows["fp"] == found["node"], "left").select("none", "own", "key", F.coalesce("component", "fp").alias("group"))
    return _kept(docs, groups)


def keep_one_alike(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, hot: int = HOT) -> DataFrame:
    """documents → one document of every group chained by a Jaccard of word shingles at ``threshold`` or more, with all
    its columns; which of them stays is as in ``keep_one``."""
    rows = sketches(docs, shingle)
    nodes = rows.groupBy("same").agg(_least("least"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = written(nodes, "alike")  # equal sets have equal fingerprints up to repeats, and equal bands
    found = connected_components(written(alike_links(docs, nodes, shingle, threshold, hot), "alike-links"))
    groups = nodes.join(found, nodes["same"] == found["node"], "left").select("least.*", F.coalesce("component", "same").alias("group"))
    return _kept(docs, groups)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).drop("n_links")
