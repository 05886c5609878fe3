"""Links of sets at a Jaccard threshold among the members of groups, crowded ones included, without listing all pairs.

A group, a min-hash band say, holds sets that may be alike. Groups of up to ``hot`` members give all their pairs. In a
larger group every member is compared with one of them, the pivot, and the group is settled where one component holds
all members. Where it does not, members are described by what differs between them and a centre, the elements that
more than half of the group has. With differences Dx and Dy, |x Δ y| = |Dx| + |Dy| - 2 |Dx ∩ Dy|, and x and y are alike
where that is g (|x| + |y|) at most, g = (1 - t) / (1 + t). With a = |D| - g |x| this reads 2 |Dx ∩ Dy| >= ax + ay:

* ax + ay <= 0: alike without a common difference. Then both are alike to the member p of least a, for ap + ax <= ay +
  ax; so comparing p with all chains all such pairs.
* ax + ay > 0: they share a difference. Links that are still to be found have an end y outside the component of p. It
  shares (ay + ap) / 2 differences with any other, and ay - g |y| / t, since it cannot share more than |Dx|. So it
  shares one of its rarest |Dy| - that + 1. Where y is far from all others these are in no other difference at all.

A y is compared with those that share such a difference, where what follows in the order of either can hold as many
common ones as the two need; the first one that they share is among the rarest of both. Members far from the centre
share it with many y, but late in their orders. What all have in common is in no difference, and no pair is lost: the
bounds are exact.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

#: Members of a group that is compared pair by pair.
HOT = 64
#: Elements of a group that are counted together.
CELL = 1 << 16
_EPS = 1e-9


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """pairs(a, b) and sets(id, s) of distinct elements → the pairs at a Jaccard of ``threshold`` or more, exactly."""
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    full = pairs.join(right, "b").join(left, "a")
    return full.where(both >= threshold * (F.size("sa") + F.size("sb") - both) - _EPS).select("a", "b")


def _open(members: DataFrame, name: str) -> DataFrame:
    """members(at, id, n, comp, ...) → those of groups that two components share, with the group's size."""
    groups = members.groupBy("at").agg(F.count("*").alias("size"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2")
    return written(members.join(groups.select("at", "size"), "at"), name)


def _between(x: str | Column, y: str | Column) -> Column:
    """The number of elements that one of two sets has and the other has not."""
    return F.size(x) + F.size(y) - 2 * F.size(F.array_intersect(x, y))


def _without(rows: DataFrame) -> DataFrame:
    """rows(d, c, ...) → what differs between d and c as d."""
    return rows.withColumn("d", F.concat(F.array_except("d", "c"), F.array_except("c", "d"))).drop("c")


def _alike(pairs: DataFrame, rows: DataFrame, g: float) -> DataFrame:
    """pairs(at, a, b) of members of groups and their rows(at, id, n, d) → those that are alike."""
    pairs = pairs.select("at", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    end = lambda c: rows.select("at", F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("d").alias(f"d{c}"))
    full = pairs.join(end("a"), ["at", "a"]).join(end("b"), ["at", "b"])
    return full.where(_between("da", "db") <= g * (F.col("na") + F.col("nb")) + _EPS).select("a", "b")


def _met(y: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """y and members(at, e, k, id, n, comp, a, m), e the k-th of a member's m differences → (at, a, b) of one difference
    and two components, where what follows in the order of either can still hold enough common ones."""
    other = members.select("at", "e", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("a").alias("ab"), F.col("m").alias("mb"), F.col("k").alias("kb"))
    fits = (F.col("comp") != F.col("cb")) & (F.least("n", "nb") >= threshold * F.greatest("n", "nb") - _EPS)
    share = (F.col("a") + F.col("ab")) / 2 - _EPS
    enough = share <= F.least(F.col("m") - F.col("k"), F.col("mb") - F.col("kb")) + 1
    return y.join(other, ["at", "e"]).where(fits & enough).select("at", F.col("id").alias("a"), "b")


def _shared(cell: pa.Table) -> pa.Table:
    """Members (at, id, d, size) of a group with the same part of their elements → (at, id, es, dfs), the elements that
    another member has too and in how many they are, and a row without an id of those that more than half have."""
    lists = cell.column("d").combine_chunks()
    _, of, df = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    row, every = np.repeat(np.arange(len(cell)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    use = df[of] > 1
    common = np.unique(of[df[of] * 2 > cell.column("size")[0].as_py()], return_index=True)[0]
    first = np.zeros(len(df), np.int64)
    first[of] = np.arange(len(of))
    es = np.append(every[use], every[first[common]])
    dfs = np.append(df[of[use]], df[common])
    ends = np.append(np.searchsorted(row[use], np.arange(len(cell) + 1)), len(es)).astype(np.int32)
    at = pa.array([cell.column("at")[0].as_py()] * (len(cell) + 1), pa.int64())
    each = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x, pa.int64()))
    return pa.table([at, pa.array([*cell.column("id").to_pylist(), None], pa.int64()), each(es), each(dfs)], names=["at", "id", "es", "dfs"])


def _counted(rows: DataFrame) -> DataFrame:
    """rows(at, id, d, size, total) → (at, id, es, dfs) as in ``_shared``. A group's elements are dealt to parts of
    about CELL, and are counted there in arrays; no row is made for an element."""
    parts = F.ceil(F.col("total") / CELL).cast("int")
    cells = rows.select("at", "id", "size", "d", parts.alias("parts"), F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)).alias("part"))
    own = F.when(F.col("parts") > 1, F.filter("d", lambda e: F.pmod(e, F.col("parts")) == F.col("part"))).otherwise(F.col("d"))
    return cells.select("at", "id", "size", "part", own.alias("d")).where(F.size("d") > 0).groupBy("at", "part").applyInArrow(_shared, "at long, id long, es array<long>, dfs array<long>")


def _rare(counted: DataFrame, rows: DataFrame, centre: DataFrame, size: DataFrame) -> DataFrame:
    """→ (at, id, els), els the (df, e) of a member's differences from the centre that another member has too, from the
    rarest. An element of the centre is a difference of those that do not have it."""
    none = F.array().cast("array<struct<df:bigint,e:bigint>>")
    own = counted.where("id IS NOT NULL").groupBy("at", "id").agg(F.flatten(F.collect_list(F.arrays_zip(F.col("dfs").alias("df"), F.col("es").alias("e")))).alias("own"))
    centre = centre.select("at", "c", F.map_from_arrays("c", "cdfs").alias("cdf"))
    all_ = rows.select("at", "id", "d").join(size.select("at", "size"), "at").join(centre, "at", "left").join(own, ["at", "id"], "left")
    apart = F.filter("own", lambda x: x["df"] * 2 <= F.col("size"))
    lacks = F.transform(F.array_except("c", "d"), lambda e: F.struct((F.col("size") - F.element_at("cdf", e)).alias("df"), e.alias("e")))
    return all_.select("at", "id", F.array_sort(F.filter(F.concat(F.coalesce(apart, none), F.coalesce(lacks, none)), lambda x: x["df"] > 1)).alias("els"))


def _close(rows: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """rows(at, id, n, comp, d) of crowded groups, d a member's set, and the links so far → all links."""
    g, far = (1 - threshold) / (1 + threshold), (1 - threshold) / (1 + threshold) / threshold
    # differences from one member are few beside the sets, and stand for them just as well
    rows = written(rows, "crowd-sets")
    one = rows.groupBy("at").agg(F.min_by("d", "id").alias("c"))
    rows = written(_without(rows.join(one, "at")), "crowd-rows")
    size = rows.groupBy("at").agg(F.count("*").alias("size"), F.sum(F.size("d")).alias("total"))
    counted = written(_counted(rows.join(size, "at")), "crowd-elements")
    centre = counted.where("id IS NULL").groupBy("at").agg(F.flatten(F.collect_list("es")).alias("c"), F.flatten(F.collect_list("dfs")).alias("cdfs"))  # twice the mean size at most
    moved = rows.join(centre.select("at", "c"), "at", "left").withColumn("c", F.coalesce("c", F.array().cast("array<long>")))
    moved = written(_without(moved).withColumn("m", F.size("d")).withColumn("a", F.col("m") - g * F.col("n")), "crowd-moved")
    first = moved.groupBy("at").agg(F.min_by(F.struct("id", "n", "comp", "a", "d"), F.struct("a", "id")).alias("p"))
    like = _between("d", F.col("p.d")) <= g * (F.col("n") + F.col("p.n")) + _EPS
    stars = written(moved.join(first, "at").where((F.col("comp") != F.col("p.comp")) & like).select("at", F.col("p.id").alias("a"), F.col("id").alias("b"), "comp"), "crowd-stars")
    links = links.unionByName(_ordered(stars.select("a", "b")))

    # y: not in the component of p, which the components of its new neighbours are in now
    joined = stars.select("at", "comp").distinct().withColumn("joined", F.lit(True))
    left = moved.join(joined, ["at", "comp"], "left").join(first.select("at", F.col("p.comp").alias("main"), F.col("p.a").alias("least")), "at")
    left = left.withColumn("comp", F.when(F.col("joined"), F.col("main")).otherwise(F.col("comp"))).withColumn("y", F.col("comp") != F.col("main")).drop("joined", "main")
    left = written(left.join(left.where("y").select("at").distinct(), "at", "left_semi"), "crowd-left")
    # a y shares this many at least with any other, and a member this many with any y
    share = F.greatest(F.lit(1), F.ceil((F.col("a") + F.col("least")) / 2 - _EPS), F.ceil(F.col("a") - far * F.col("n") - _EPS))
    # the differences that another member has too, from the rarest; all that come before them are a member's own
    more = _rare(counted, rows, centre, size)
    held = left.drop("d").join(more, ["at", "id"]).withColumn("alone", F.col("m") - F.size("els")).withColumn("share", share)
    apart = left.where("y").groupBy("at").agg(F.min("a").alias("least"))
    other = held.where("NOT y").drop("least").join(apart, "at").withColumn("share", share)

    def rarest(held: DataFrame) -> DataFrame:
        first_of = F.slice("els", 1, F.greatest(F.lit(0), F.least(F.size("els").cast("long"), F.col("m") - F.col("share") + 1 - F.col("alone"))).cast("int"))
        each = held.select("at", "id", "n", "comp", "a", "m", "alone", F.posexplode(first_of).alias("pos", "x"))
        return each.select("at", F.col("x.e").alias("e"), "id", "n", "comp", "a", "m", (F.col("alone") + F.col("pos") + 1).alias("k"))

    asked = written(rarest(held.where("y")), "crowd-asked")
    keys = asked.select("at", "e").distinct()
    members = written(asked.unionByName(rarest(other).join(keys, ["at", "e"], "left_semi")), "crowd-members")

    found = _alike(_met(asked, members, threshold), left, g)
    return written(links.unionByName(_ordered(found)), "crowd-links")


def group_links(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float, more: DataFrame | None = None, hot: int = HOT) -> DataFrame:
    """members(at long, id, n) of groups, each once, n the size of the set → links (a, b), a < b, all of them verified.

    Any two members of a group at a Jaccard of ``threshold`` or more are linked or chained by links: no such pair is
    left apart. ``sets_of`` takes (id) and returns (id, s), the sets of these ids, distinct elements; ``more`` holds
    further pairs (a, b) to verify. Members whose group is theirs alone ask for nothing; empty tables give no links.
    """
    count = members.groupBy("at").agg(F.count("*").alias("size"), F.min("id").alias("pivot")).where("size > 1")
    held = written(members.join(count, "at"), "crowd-members")
    few = held.where(F.col("size") <= hot).select("at", "id", "n")
    other = few.select("at", F.col("id").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("id") < F.col("b")) & (F.least("n", "nb") >= threshold * F.greatest("n", "nb") - _EPS)
    pairs = few.join(other, "at").where(fits).select(F.col("id").alias("a"), "b")
    pairs = pairs.unionByName(held.where(F.col("size") > hot).select(F.col("pivot").alias("a"), F.col("id").alias("b")))
    ask = written(_ordered(pairs if more is None else pairs.unionByName(more)), "crowd-pairs")
    sets = written(sets_of(ask.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "crowd-sets")
    links = written(verified(ask, sets, threshold), "crowd-links")

    crowd = held.where(F.col("size") > hot)
    if crowd.isEmpty():
        return links
    # groups whose pivots are in one component are one, and a member's difference is taken once for all of them
    comps = written(connected_components(links), "crowd-components")
    crowd = crowd.select("pivot", "id", "n").distinct().join(comps.toDF("id", "comp"), "id", "left").join(comps.toDF("pivot", "at"), "pivot", "left")
    crowd = crowd.groupBy(F.coalesce("at", "pivot").alias("at"), "id").agg(F.first("n").alias("n"), F.first(F.coalesce("comp", "id")).alias("comp"))
    rows = _open(crowd, "crowd-open")
    if rows.isEmpty():
        return links
    return _close(rows.drop("size").join(sets.withColumnRenamed("s", "d"), "id"), links, threshold)
