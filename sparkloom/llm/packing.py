"""Operator 10: packing documents into fixed windows by best-fit decreasing.

Each task encodes its documents in blocks, cuts documents of over a window into full windows and places the rests of a
block, longest first, into the open window with the least room that still holds them. A segment tree over remaining
room, one leaf for each amount, finds that window in log2(window) steps. Windows that a block leaves open stay in the
tree for the next one, so a rest meets all room that its task has; a full window is written at once, and what is open at
the end of the task is written as it is, to be padded. Tasks pack alone, so nothing is shuffled. Memory is bounded by a
block and by OPEN windows: where more are open, the fullest ones are written, which hardly any rest would fit.

Which documents share a window follows from how the table is split into tasks, which differs between clusters; pieces of
a document and their contents do not.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_tokens import ByteTokens
from .common import bounded, table

WINDOW, BLOCK, BLOCK_BYTES = 2048, 8192, 48 << 20
#: Windows that a task holds open.
OPEN = 8192


class RoomTree:
    """A segment tree over the amounts of room 0..capacity: how many open windows have that much left."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (room, window) with the least room of at least ``need``; None if there is none."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up, until something to the right has a window
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, self.open[room].pop()


    def fullest(self) -> int | None:
        """Removes and returns the open window with the least room."""
        got = self.take(1)
        return None if got is None else got[1]


class Packer:
    """Best fit over blocks of pieces: windows by number, their fill, and the tree of those with room."""

    def __init__(self, capacity: int):
        self.capacity, self.tree, self.fill = capacity, RoomTree(capacity), {}
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """Window and offset of a piece of length 1..capacity."""
        got = self.tree.take(length)
        if got is None:
            got = self.capacity, self.made
            self.made += 1
            self.fill[got[1]] = 0
        room, window = got
        offset = self.fill[window]
        self.fill[window] += length
        if room > length:
            self.tree.put(room - length, window)
        return window, offset

    def block(self, lengths: list[int]) -> list[tuple[int, int]]:
        """Window and offset of each piece, placed longest first."""
        out: list = [None] * len(lengths)
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            out[i] = self.place(lengths[i])
        return out

    def closed(self, most: int = 0) -> list[int]:
        """Forgets and returns the windows that are full, then the fullest until ``most`` are open."""
        out = [w for w, f in self.fill.items() if f == self.capacity]
        for _ in range(len(self.fill) - len(out) - most):
            out.append(self.tree.fullest())
        for w in out:
            del self.fill[w]
        return out


def _blocks(batches, tokens: ByteTokens, end_id: int, block: int):
    held: list = []
    size = 0
    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at in range(0, len(texts), 500):
            ids, starts = tokens.encode(texts[at : at + 500], end_id)
            data = ids.astype("<u4").tobytes()
            held += zip(docs[at : at + 500], [data[4 * a : 4 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], strict=True)
            size += len(data)
            if len(held) >= block or size > BLOCK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, block: int = BLOCK, most_open: int = OPEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs → pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. Pieces of a document begin at
    ``start`` of its ids; pieces of a sequence lie end to end from offset 0. A sequence is padded to ``window`` when
    tensors are made, unless its length is a power of two. Every row is packed, rows with repeated and null ids too,
    each with its own text; of equal lengths the earlier row is placed first; a very long text is full windows and a
    rest; an empty table gives no piece; other columns are not read.
    """

    def run(batches):
        tokens, packer = ByteTokens.load(tokenizer), Packer(window)
        base = TaskContext.get().partitionId() << 33
        used = 0  # sequences written so far
        held: dict[int, list] = {}  # open window → its pieces: document, start, ids, ids of the document, offset

        def rows(placed):
            for low in range(0, len(placed), 4096):
                part = placed[low : low + 4096]
                size = [len(p[2]) // 4 for p in part]
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size]).astype(np.int32)), pa.array(np.frombuffer(b"".join(p[2] for p in part), "<i4"), pa.int32()))
                column = lambda k: pa.array([p[k] for p in part], pa.int64())
                yield pa.RecordBatch.from_arrays([column(0), column(1), pa.array(size, pa.int64()), ids, column(3), column(5), column(4)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def written(windows):
            nonlocal used
            out = []
            for w in windows:
                out += [(*p, base + used) for p in held.pop(w)]
                used += 1
            return out

        for docs_ in _blocks(batches, tokens, end_id, block):
            placed, rests = [], []
            for doc, data in docs_:
                total = len(data) // 4
                whole = total // window * window
                for start in range(0, whole, window):
                    placed.append((doc, start, data[4 * start : 4 * (start + window)], total, 0, base + used))
                    used += 1
                if whole < total:
                    rests.append((doc, whole, data[4 * whole :], total))
            for rest, (w, offset) in zip(rests, packer.block([len(r[2]) // 4 for r in rests]), strict=True):
                held.setdefault(w, []).append((*rest, offset))
            yield from rows(placed + written(packer.closed(most_open)))
        yield from rows(written(packer.closed()))

    bounded(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with their ids' checksum in place of the ids."""

    def run(batches):
        for batch in batches:
            stops = batch.column(1).offsets.to_numpy()
            data = memoryview(batch.column(1).values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64()), *batch.columns[2:]], names=["doc_id", "ids_crc32", *batch.schema.names[2:]])

    return pieces.select("doc_id", "ids", "start", "length", "doc_tokens", "sequence_id", "offset").mapInArrow(run, "doc_id long, ids_crc32 long, start long, length long, doc_tokens long, sequence_id long, offset long").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
