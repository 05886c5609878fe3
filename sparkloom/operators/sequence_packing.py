"""Parents packed into token batches in one global order, over any number of tasks.

Packing in order is a serial fold: a parent opens a batch where it no longer fits into the last one. What a stretch of
parents does to that fold depends on one number alone, the fill of the batch that is open before it. So a stretch is
a function from the fill at entry to the fill at exit and the number of batches opened, and functions of neighbouring
stretches compose. Each stretch makes its function in its own task, FAN neighbours at a time are composed, level by
level, until one group is left, and the fills at entry come back down the same levels. Then each stretch folds once
more, from the fill that it is really entered with.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import saved

#: Parents of a stretch, and functions that are composed at once.
STRETCH, FAN = 50_000, 64
#: Parents after which fills that have met are followed as one.
_MEET = 128


def transfer(tokens: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The fill at exit and the batches opened for every fill at entry: 0 to limit, and limit + 1 for a batch that takes
    nothing more (an overlong parent's, or none at all)."""
    of = np.arange(limit + 2)  # the class of each fill at entry; fills of a class are one from here on
    opened, fill, new = np.zeros(limit + 2, np.int64), np.arange(limit + 2, dtype=np.int64), np.zeros(limit + 2, np.int64)
    for at in range(0, len(tokens), _MEET):
        for t in tokens[at : at + _MEET].tolist():
            full = fill + t > limit
            fill = np.minimum(np.where(full, t, fill + t), limit + 1)
            new += full
        opened += new[of]
        fill, place = np.unique(fill, return_inverse=True)
        of, new = place[of], np.zeros(len(fill), np.int64)
    return fill[of], opened


def fold(tokens: np.ndarray, limit: int, fill: int, opened: int) -> np.ndarray:
    """The batch of each parent, entered with a fill and with so many batches opened before."""
    out = np.empty(len(tokens), np.int64)
    for i, t in enumerate(tokens.tolist()):
        if fill + t > limit:
            fill, opened = t, opened + 1
        else:
            fill += t
        out[i] = opened - 1
    return out


def _ups(limit: int):
    """Functions of one group of neighbours → the function of all of them, in their order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fill, opened = np.arange(limit + 2), np.zeros(limit + 2, np.int64)
        for out, new in zip(*[pdf.sort_values("part")[c] for c in ("fill", "opened")], strict=True):
            fill, opened = np.asarray(out)[fill], opened + np.asarray(new)[fill]
        return pd.DataFrame({"part": [pdf["part"].iloc[0] // FAN], "fill": [fill], "opened": [opened]})

    return run


def _downs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Functions of one group and how the group is entered (at, before) → how each of them is entered."""
    pdf = pdf.sort_values("part")
    at, before, rows = int(pdf["at"].iloc[0]), int(pdf["before"].iloc[0]), []
    for part, out, new in zip(pdf["part"], pdf["fill"], pdf["opened"], strict=True):
        rows.append((part, at, before))
        at, before = int(out[at]), before + int(new[at])
    return pd.DataFrame(rows, columns=["part", "at", "before"])


def _entries(stretches: DataFrame, limit: int, parts: int) -> DataFrame:
    """Functions (part, fill, opened) of stretches 0 to parts - 1 → (part, at, before), the fill that each is entered
    with and the batches opened before it."""
    levels = [stretches]
    while parts > FAN:
        parts = -(-parts // FAN)
        up = levels[-1].groupBy(F.floor(F.col("part") / FAN)).applyInPandas(_ups(limit), "part long, fill array<int>, opened array<long>")
        levels.append(saved(up, "packing-level"))
    top = levels[-1].select(F.lit(0).cast("long").alias("group")).distinct()
    entry = top.select("group", F.lit(limit + 1).cast("long").alias("at"), F.lit(0).cast("long").alias("before"))
    for level in reversed(levels):
        met = level.withColumn("group", F.floor(F.col("part") / FAN)).join(entry, "group")
        found = saved(met.groupBy("group").applyInPandas(_downs, "part long, at long, before long"), "packing-entry")
        entry = found.withColumnRenamed("part", "group")
    return found


def pack_in_order(items: DataFrame, order: list[str], limit: int, stretch: int = STRETCH) -> DataFrame:
    """items(tokens, ...) → the same rows with batch_no: in ascending ``order``, nulls first, a batch takes rows until
    the next one would bring it over ``limit`` tokens; a row over the limit is a batch of its own.

    Rows of equal order columns may come in either order, so these should tell rows apart. Null tokens count as none, and
    negative ones are an error. The result does not depend on how the table is split. An empty table gives an empty
    result. Columns may have any names but __part, __k and batch_no.
    """
    if limit < 1 or stretch < 1:
        raise ValueError("limit and stretch are 1 or more")
    items = saved(items, "packing-items")
    n, least = items.agg(F.count("*"), F.min("tokens")).first()
    if (least or 0) < 0:
        raise ValueError("tokens are not negative")
    parts = max(1, -(-n // stretch))
    dealt = (items.repartitionByRange(parts, *order) if parts > 1 else items.coalesce(1)).withColumn("__part", F.spark_partition_id().cast("long"))
    dealt = saved(dealt, "packing-dealt").withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    dealt = saved(dealt, "packing-order")
    sizes = dealt.select(F.col("__part").alias("part"), F.col("__k").alias("k"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))

    def function(pdf: pd.DataFrame) -> pd.DataFrame:
        fill, opened = transfer(pdf.sort_values("k")["tokens"].to_numpy(), limit)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "fill": [fill], "opened": [opened]})

    def placed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        batch = fold(pdf["tokens"].to_numpy(), limit, int(pdf["at"].iloc[0]), int(pdf["before"].iloc[0]))
        return pd.DataFrame({"__part": pdf["part"], "__k": pdf["k"], "batch_no": batch})

    made = saved(sizes.groupBy("part").applyInPandas(function, "part long, fill array<int>, opened array<long>"), "packing-functions")
    batches = sizes.join(_entries(made, limit, parts), "part").groupBy("part").applyInPandas(placed, "__part long, __k int, batch_no long")
    return dealt.join(batches, ["__part", "__k"]).drop("__part", "__k")


def pack_parents_in_order(chunks: DataFrame, limit: int = 4096, stretch: int = STRETCH) -> DataFrame:
    """chunks(doc_id, pos, chunk_id, parent_id, tokens) → (batch_no, parents, first_doc, last_doc, chunk_ids, tokens):
    the distinct parents of all documents in the order of (doc_id, pos) in batches up to ``limit`` tokens, which may span
    documents. A parent's tokens are those of its first chunk; of chunks at one place the least id's count."""
    first = F.struct("pos", "chunk_id")
    one = chunks.groupBy("doc_id", "parent_id").agg(F.min("pos").alias("pos"), F.min_by("tokens", first).alias("tokens"), F.collect_list("chunk_id").alias("ids"))
    rows = pack_in_order(one, ["doc_id", "pos", "parent_id"], limit, stretch)
    return rows.groupBy("batch_no").agg(
        F.count("*").alias("parents"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
        F.array_join(F.array_sort(F.flatten(F.collect_list("ids"))), ",").alias("chunk_ids"), F.sum("tokens").cast("long").alias("tokens"),
    )
