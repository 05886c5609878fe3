"""Operator 8: exact substring deduplication over prefix-partitioned suffix trees.

Words are cut out of every text as they are. A suffix enters the trees only where its first ``prefix`` words have the
least hash among the prefixes of some window of ``window`` words (a local minimum): equal windows choose an equal
prefix at an equal place, so nothing that repeats is missed, and a stretch of windows that chose one prefix travels
once, as a segment of about ``window + window / 3`` words, in place of one copy of the text for every window.

1. Over a batch of documents numpy hashes words and prefixes and cuts the segments. Copies of a segment within the
   batch are settled there: only the least document sends it on, the others know of a smaller one. A group of copies
   thus sends one segment for each batch, not one for each document.
2. A first pass adds up the bytes that each bucket of prefix hashes would get. Prefixes in buckets over the limit are
   frequent and are made longer, up to the whole window: see 4. The others keep ``prefix`` words.
3. Segments of the other prefixes are dealt out by ranges of the prefix hash. The number of ranges follows the total
   text, and a range has BUCKETS buckets none of which is over the limit, so it fits in memory at any size and for any
   text. Within a range, segments are split by their whole prefix and, where a prefix has many leaves, by longer
   prefixes, until a group is small; each group's suffixes are sorted, which lists the leaves of its suffix tree from
   left to right, and the inner nodes at depth ``window`` or below are the runs of leaves that agree in as many words.
   The least document below such a node owns the windows; they are repeats in the others.
4. A suffix of a frequent prefix has the whole window as its prefix, at which depth a tree has no branches left to
   find: its node is the group of equal windows. The least document of each is a grouped minimum that combines before
   it shuffles, and a join on the window brings it back, so neither a prefix of a million continuations nor a window
   in a third of all rows meets in one task.
5. The repeated windows return to their documents, and the covered words are removed.

Comparisons from step 1 on are of the words themselves; hashes only choose places, ranges and buckets.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, bounded, table, text_key, unused, written

WINDOW, PREFIX = 13, 3
#: Bytes of segments that one range of prefixes is meant to hold, and leaves of one subtree.
RANGE_BYTES, LEAVES = 14 << 20, 4096
#: Buckets of a range, the bytes from which on a bucket's prefixes are frequent, and the most buckets that can be so:
#: the limit follows the total where that many would not be enough, so their list is bounded.
BUCKETS, FREQUENT_BYTES, MOST_FREQUENT = 8, 7 << 20, 1 << 22
#: Bytes of text that are cut at once, and rows from which words are removed at once.
PIECE, SLICE = 4 << 20, 256
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _segments(texts: list[bytes], window: int, prefix: int):
    """Single-spaced bytes of all texts; of the segments in them the text, first word, number of windows, byte range,
    byte range and hash of the prefix; the first word of each text."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACES[raw]
    keep = ~space
    keep[1:] |= ~space[:-1]
    ends = np.cumsum([len(t) + 1 for t in texts])  # a text ends at its line feed
    kept = np.cumsum(keep, dtype=np.int32)  # a batch is some PIECE bytes
    clean = np.where(space, np.uint8(32), raw)[keep]
    gap = clean == 32
    stop = np.flatnonzero(gap)
    start = np.concatenate([[0], stop[:-1] + 1])[: len(stop)]
    n = len(start)
    first = np.searchsorted(start, np.concatenate([[0], kept[ends - 1]]))  # first word of each text, and the end
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    none = clean, (np.zeros(0, np.int64),) * 8, first
    if n < window:
        return none
    # a word's hash: a polynomial over its bytes, from differences of running sums
    with np.errstate(over="ignore"):
        length = stop - start
        h = np.zeros(n, np.uint64)
        power = np.uint64(1)
        todo = np.arange(n)
        at = 0
        while len(todo):
            h[todo] = h[todo] * np.uint64(0x100000001B3) + clean[start[todo] + at].astype(np.uint64) + np.uint64(1)
            at += 1
            todo = todo[length[todo] > at] if at < 64 else todo[:0]
        long = np.flatnonzero(length > 64)
        for i in long:
            piece = clean[start[i] : stop[i]].astype(np.uint64) + np.uint64(1)
            h[i] = (piece * _powers(len(piece), 0x100000001B3)).sum(dtype=np.uint64)
        h = _mix(h + length.astype(np.uint64))
        m = n - prefix + 1
        p = np.zeros(m, np.uint64)
        for j in range(prefix):
            p = _mix(p * np.uint64(_BASE & 0xFFFFFFFFFFFFFFFF) + h[j : j + m])
    wide = window - prefix + 1
    best = np.arange(n - window + 1)
    least = p[: n - window + 1].copy()
    for j in range(1, wide):  # the leftmost least prefix of every window
        other = p[j : j + n - window + 1]
        less = other < least
        np.copyto(least, other, where=less)
        best[less] = np.flatnonzero(less) + j
    inside = owner[: n - window + 1] == owner[window - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return none
    head = np.flatnonzero(np.concatenate([[True], (best[at][1:] != best[at][:-1]) | (at[1:] != at[:-1] + 1)]))
    begin, last = at[head], at[np.concatenate([head[1:], [len(at)]]) - 1]
    mark = best[begin]
    return clean, (owner[begin], begin, last - begin + 1, start[begin], stop[last + window - 1], start[mark], stop[mark + prefix - 1], p[mark]), first


def _pack(columns: dict) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(pickle.dumps(columns, protocol=5))


def _unpack(data: bytes) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _pieces(batches, window: int):
    """Lists of (id, key, first word, text) of some PIECE bytes; a longer text is several pieces that overlap by a
    window less one word, so that each window lies in one of them."""
    held, size = [], 0
    for pdf in batches:
        for d, key, text in zip(pdf["doc_id"].tolist(), pdf["key"].tolist(), pdf["text"].tolist(), strict=True):
            if d is None or d != d or not text:
                continue
            data = text.encode("utf-8", "surrogatepass")
            if len(data) > PIECE:
                w = data.split()
                step = max(window, len(w) * (PIECE // 2) // len(data))
                parts = [(int(d), key, at, b" ".join(w[at : at + step + window - 1])) for at in range(0, max(1, len(w) - window + 1), step)]
            else:
                parts = [(int(d), key, 0, data)]
            for part in parts:
                held.append(part)
                size += len(part[3])
                if size >= PIECE:
                    yield held
                    held, size = [], 0
    if held:
        yield held


@dataclass
class _Cut:
    """The segments of one batch: document, text key, first word, windows, prefix (begin, end) and its hash, text; and
    which of them the batch has not settled."""

    doc: np.ndarray
    key: np.ndarray
    at: np.ndarray
    n: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: list[bytes]
    send: np.ndarray

    def bucket(self, buckets: int) -> np.ndarray:
        return (self.hash % np.uint64(buckets)).astype(np.int64)


def _cuts(batches, window: int, prefix: int):
    for held in _pieces(batches, window):
        held.sort(key=lambda x: x[:3])
        ids, keys, base = (np.array([x[i] for x in held], np.int64) for i in range(3))
        clean, (owner, begin, n, b0, b1, p0, p1, h), first = _segments([x[3] for x in held], window, prefix)
        if not len(owner):
            continue
        data, doc = clean.tobytes(), ids[owner]
        text = [data[a:b] for a, b in zip(b0.tolist(), b1.tolist(), strict=True)]
        known: dict[bytes, int] = {}  # the first that has a segment is its least document
        send = np.fromiter((known.setdefault(t, d) == d for t, d in zip(text, doc.tolist(), strict=True)), bool, len(text))
        yield _Cut(doc, keys[owner], begin - first[owner] + base[owner], n, p0 - b0, p1 - b0, h, text, send)


def _weigher(buckets: int, window: int, prefix: int):
    """Step 2 as a function for mapInPandas: rows (bucket, bytes)."""

    def run(batches):
        for cut in _cuts(batches, window, prefix):
            size = np.fromiter(map(len, cut.text), np.int64, len(cut.text))
            bucket, at = np.unique(cut.bucket(buckets)[cut.send], return_inverse=True)
            yield pd.DataFrame({"bucket": bucket, "bytes": np.bincount(at, size[cut.send], len(bucket)).astype(np.int64)})

    return run


def _runs(*columns: np.ndarray) -> list[slice]:
    """Stretches of rows that agree in all columns."""
    n = len(columns[0])
    edge = np.zeros(max(0, n - 1), bool)
    for c in columns:
        edge |= np.diff(c) != 0
    stops = [0, *(np.flatnonzero(edge) + 1).tolist(), n]
    return [slice(a, b) for a, b in zip(stops[:-1], stops[1:], strict=True)]


def _cutter(ranges: int, buckets: int, frequent: np.ndarray, window: int, prefix: int):
    """Step 1 as a function for mapInPandas: rows (range, payload) of segments, and of what is settled already."""

    def run(batches):
        for cut in _cuts(batches, window, prefix):
            rows, order = [], (cut.hash % np.uint64(ranges)).astype(np.int64)
            chosen = np.flatnonzero(cut.send & ~np.isin(cut.bucket(buckets), frequent))
            chosen = chosen[np.argsort(order[chosen], kind="stable")]
            for run_ in _runs(order[chosen]) if len(chosen) else ():
                part = chosen[run_]
                rows.append((int(order[part[0]]), _pack({"doc": cut.doc[part], "key": cut.key[part], "at": _narrow(cut.at[part]), "n": _narrow(cut.n[part]), "p": _narrow(cut.begin[part]), "q": _narrow(cut.end[part]), "text": b"\n".join([cut.text[i] for i in part.tolist()])})))
            done = np.flatnonzero(~cut.send)
            if len(done):
                pairs = np.stack([cut.at[done], cut.n[done]], axis=1).astype(np.int32)
                own = _runs(cut.doc[done], cut.key[done])
                settled = [(int(cut.doc[done[x.start]]), int(cut.key[done[x.start]])) for x in own]
                rows.append((int(cut.doc[0] % ranges), _pack({"settled": settled, "hits": [pairs[x].tobytes() for x in own]})))  # any range will do
            yield pd.DataFrame(rows, columns=["range", "payload"])

    return run


def _window_cutter(buckets: int, frequent: np.ndarray, window: int, prefix: int):
    """Step 4 as a function for mapInPandas: rows (win, doc_id, key, at) of the windows of frequent prefixes; win is
    null where a smaller document of the batch has the window too."""

    def run(batches):
        for cut in _cuts(batches, window, prefix):
            known: dict[bytes, int] = {}
            rows = []
            for i in np.flatnonzero(cut.send & np.isin(cut.bucket(buckets), frequent)).tolist():
                w, doc, key, at = cut.text[i].split(b" "), int(cut.doc[i]), int(cut.key[i]), int(cut.at[i])
                for k in range(int(cut.n[i])):
                    win = b" ".join(w[k : k + window])
                    rows.append((win if known.setdefault(win, doc) == doc else None, doc, key, at + k))
            yield pd.DataFrame(rows, columns=["win", "doc_id", "key", "at"])

    return run


def _split(group: list, depth: int, window: int):
    """Groups of suffixes of at most LEAVES, by ever longer prefixes; what agrees in a whole window stays together."""
    if len(group) <= LEAVES or depth >= window:
        yield group
        return
    parts = defaultdict(list)
    for leaf in group:
        parts[leaf[0].split(b" ", depth + 1)[depth]].append(leaf)
    for part in parts.values():
        if len(part) > 1:
            yield from _split(part, depth + 1, window)


def _tree(leaves: list, window: int):
    """Leaves (suffix, document, ...) in tree order → for every inner node at least a window deep, its leaves."""
    leaves.sort(key=lambda leaf: leaf[0])
    node, edge = [], b"\n"
    for leaf in leaves:
        if leaf[0].startswith(edge):
            node.append(leaf)
        else:
            if len(node) > 1:
                yield node
            node, edge = [leaf], b" ".join(leaf[0].split(b" ", window)[:window]) + b" "
    if len(node) > 1:
        yield node


def _grower(window: int):
    """Step 3: the payloads of one range → repeated windows of documents."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: dict[tuple, list] = defaultdict(list)  # (document, key) → first window, windows, first window, ...
        segments: dict[bytes, list] = {}  # text → its least document, its windows, and where that document holds it
        groups: dict[bytes, list] = defaultdict(list)
        done: list[tuple[int, int, np.ndarray]] = []
        for payload in pdf["payload"]:
            x = _unpack(payload)
            if "settled" in x:
                done += [(d, key, np.frombuffer(hits, np.int32)) for (d, key), hits in zip(x["settled"], x["hits"], strict=True)]
                continue
            for t, d, key, at, n, p, q in zip(x["text"].split(b"\n"), *[x[c].tolist() for c in ("doc", "key", "at", "n", "p", "q")], strict=True):
                one = segments.get(t)
                if one is None:
                    segments[t] = [d, n, [(key, at)]]
                    groups[t[p:q]].append(t)
                elif d == one[0]:
                    one[2].append((key, at))
                elif d > one[0]:  # equal segments: all windows are the least document's
                    found[d, key] += (at, n)
                else:
                    for was, where in one[2]:
                        found[one[0], was] += (where, n)
                    one[0], one[2] = d, [(key, at)]
        for members in groups.values():
            if len(members) < 2:
                continue
            leaves = []
            for t in members:
                rest = t + b" "
                for i in range(segments[t][1]):
                    leaves.append((rest, segments[t], i))
                    rest = rest[rest.index(b" ") + 1 :]
            for group in _split(leaves, 0, window):
                for node in _tree(group, window):
                    owner = min(leaf[1][0] for leaf in node)
                    for _, (d, _, places), i in node:
                        if d > owner:
                            for key, at in places:
                                found[d, key] += (at + i, 1)
        done += [(d, key, np.array(v, np.int32)) for (d, key), v in found.items()]
        return pd.DataFrame(done, columns=["doc_id", "key", "hits"])

    return run


def row_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[int, Column | None]:
    """Bytes of text, and what tells rows of one id apart: a hash of their text, or nothing where no id has two texts,
    for a hash at every segment is a tenth of what is shuffled."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.octet_length(text_col).alias("n"))
    one = rows.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.sum("n").alias("n"))
    size, several = one.agg(F.sum("n"), F.bool_or((F.col("a") != F.col("b")) & F.col("doc_id").isNotNull())).first()
    return size or 0, text_key(F.col(text_col)) if several else None


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, Column | None]:
    """docs → (doc_id, key, hits): for each row with repeats, pairs (first window, windows) in word positions, one after
    the other, of windows whose words also start in a document with a smaller id; and the key's column of docs,
    None where ids tell rows apart."""
    bounded(docs.sparkSession)
    size, key = row_key(docs, id_col, text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.lit(0).cast("long") if key is None else key).alias("key"), F.col(text_col).alias("text"))
    ranges, prefix = int(max(24, -(-size * 4 // RANGE_BYTES))), min(PREFIX, window)
    buckets, limit = ranges * BUCKETS, max(FREQUENT_BYTES, size * 4 // MOST_FREQUENT)
    loads = own.mapInPandas(_weigher(buckets, window, prefix), "bucket long, bytes long").groupBy("bucket").agg(F.sum("bytes").alias("bytes"))
    frequent = np.array(sorted(r.bucket for r in loads.where(F.col("bytes") > limit).select("bucket").collect()), np.int64)  # MOST_FREQUENT at most
    cut = own.mapInPandas(_cutter(ranges, buckets, frequent, window, prefix), "range int, payload binary")
    hits = cut.repartition(ranges, "range").groupBy("range").applyInPandas(_grower(window), "doc_id long, key long, hits array<int>")
    if len(frequent):
        wins = written(own.mapInPandas(_window_cutter(buckets, frequent, window, prefix), "win binary, doc_id long, key long, at int"), "substring-windows")
        open_ = wins.where("win IS NOT NULL")
        least = open_.groupBy("win").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("win", "least")
        more = open_.join(least, "win").where("doc_id > least").select("doc_id", "key", "at").unionByName(wins.where("win IS NULL").select("doc_id", "key", "at"))
        hits = hits.unionByName(more.select("doc_id", "key", F.array("at", F.lit(1)).alias("hits")))
    return hits, key


def covered(n_words: int, hits: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words the repeated windows cover."""
    edge, pair = np.zeros(n_words + 1, np.int64), np.asarray(hits, np.int64).reshape(-1, 2)
    np.add.at(edge, np.minimum(pair[:, 0], n_words), 1)
    np.add.at(edge, np.minimum(pair[:, 0] + pair[:, 1] + window - 1, n_words), -1)
    return np.cumsum(edge)[:-1] > 0


_WORDS = re.compile(WORD)


def without_words(text: str, gone: np.ndarray) -> str:
    """The text without the marked words: each stretch of them goes from its first character to its last, and all that
    lies around, line breaks and spaces too, stays."""
    spans = [m.span() for m in _WORDS.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    out, at = [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return "".join([*out, text[at:]])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, layout: bool = False, names: tuple[str, str, str] = ("n_words", "n_removed", "kept_text")) -> DataFrame:
    """docs → all columns, with n_words, n_removed and kept_text added: one row per input row.

    Every word that lies in a window of ``window`` words that also starts in a document with a smaller id is removed;
    windows are judged on the input. kept_text joins the other words by one space or, with ``layout``, is the text with
    the removed stretches cut out and all white space around them as it was. Null texts are empty, and null with
    ``layout``; a row with a null id is kept whole and takes no part; rows that repeat an id are documents of that id
    each, judged by their own text, and do not repeat each other; a text over PIECE bytes is cut in overlapping pieces;
    an empty table gives an empty result. ``names`` are those of the added columns; columns of the input with these
    names are replaced.
    """
    bounded(docs.sparkSession)
    docs = docs.drop(*names)
    own, key, mark = unused(docs, "__id"), unused(docs, "__key"), unused(docs, "__hits")
    hits, row = repeated_windows(docs, id_col, text_col, window)
    hits = hits.groupBy(F.col("doc_id").alias(own), F.col("key").alias(key)).agg(F.flatten(F.collect_list("hits")).alias(mark))
    same = F.col(id_col).cast("long") == F.col(own)
    rows = docs.join(hits, same if row is None else same & (row == F.col(key)), "left").drop(own, key)
    schema = docs.select("*", *[F.lit(None).cast(t).alias(n) for n, t in zip(names, ("long", "long", "string"), strict=True)]).schema

    def one(text: str | None, hits) -> tuple:
        w = (text or "").encode("utf-8", "surrogatepass").split()
        if hits.is_valid:
            gone = covered(len(w), hits.values.to_numpy(), window)
            left = without_words(text, gone).encode("utf-8", "surrogatepass") if layout else b" ".join([x for x, g in zip(w, gone.tolist(), strict=True) if not g])
            return len(w), int(gone.sum()), left
        return len(w), 0, (None if text is None else text.encode("utf-8", "surrogatepass")) if layout else b" ".join(w)

    def run(batches):
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, max(1, b.num_rows), SLICE)):
            columns = list(zip(*map(one, batch.column(text_col).to_pylist(), batch.column(mark)), strict=True)) or [(), (), ()]
            rest = [n for n in batch.schema.names if n != mark]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in rest] + [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()).cast(pa.string())],
                names=[*rest, *names],
            )

    return rows.mapInArrow(run, schema)


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
