"""Byte-level BPE ids by the tokenizers library, each distinct chunk of text encoded once in a worker.

The vocabulary's pre-tokenizer never lets a piece run from a non-space into a space, so a text may be cut before a
space that no other white space follows, and the chunks encode alone as they do in place. Chunks repeat far more than
texts do, so a worker numbers them, keeps their ids in one array, and puts a batch together by one gather. New chunks
are encoded as one text and its ids cut where chunks end. Texts with other runs of white space go to the library whole.
"""

from __future__ import annotations

from itertools import chain

import numpy as np

#: Chunks, and ids of chunks, that a worker keeps before it starts anew.
KEPT, KEPT_IDS = 900_000, 8_000_000
#: Marks the first chunk of a text, which no space precedes, among the numbered ones; texts that hold it are not cut.
HEAD = "\ue000"
_loaded: dict = {}


class _Numbers(dict):
    """Numbers for chunks; a chunk that has none gets the next and is listed as new. One that is empty or begins with
    white space belongs to a text with a run of it, which must not be cut: it gets no number and sets ``run``."""

    def __init__(self):
        self.next, self.new, self.run = 0, [], False

    def __missing__(self, chunk: str) -> int:
        if not chunk or chunk[0].isspace():
            self.run = True
            return -1
        got = self[chunk] = self.next
        self.next += 1
        self.new.append(chunk)
        return got


def _fitted(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])


class ByteTokens:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        table = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(table.values()) + 1, np.int64)  # a token has one character for each of its bytes
        for token, i in table.items():
            self.width[i] = len(token)
        self._clear()

    @classmethod
    def load(cls, path: str) -> ByteTokens:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _clear(self) -> None:
        self.known, self.used = _Numbers(), 0
        self.flat, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _keep(self, numbers: np.ndarray, ids: np.ndarray, stops: np.ndarray) -> None:
        low = np.concatenate([[0], stops[:-1]])
        self.flat = _fitted(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start, self.size = _fitted(self.start, self.known.next), _fitted(self.size, self.known.next)
        self.start[numbers], self.size[numbers] = self.used + low, stops - low
        self.used += len(ids)

    def _learn(self, chunks: list[str], numbers: list[int]) -> None:
        """Encodes new chunks that follow a space."""
        for at in range(0, len(chunks), 2000):
            part = [" " + c for c in chunks[at : at + 2000]]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.int64)
            stops = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(c.encode()) for c in part])) + 1
            self._keep(np.array(numbers[at : at + 2000]), ids, stops)

    def _learn_whole(self, texts: list[str], numbers: list[int]) -> None:
        for at in range(0, len(texts), 500):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + 500], add_special_tokens=False)]
            self._keep(np.array(numbers[at : at + 500]), np.array(list(chain.from_iterable(ids)), np.int64), np.cumsum([len(x) for x in ids]))

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, ``end_id`` after each, and where each text's ids begin, with the end of the last."""
        if len(self.known) > KEPT or self.used > KEPT_IDS:
            self._clear()
        known = self.known
        number, rows, odd, odd_numbers = known.__getitem__, [], [], []
        end = known.next
        known.next += 1
        for text in texts:
            if not text:
                row = []
            else:
                head, *rest = text.split(" ")
                known.run = HEAD in text or ("<" in text and any(s in text for s in self.special))
                row = [] if known.run else [*map(number, rest)]
                if known.run:
                    known.run, row = False, [known.next]
                    known.next += 1
                    odd.append(text)
                    odd_numbers += row
                else:
                    row.insert(0, number(HEAD + head))
            row.append(end)
            rows.append(row)
        self._keep(np.array([end]), np.array([end_id]), np.array([1]))
        heads = [c for c in known.new if c[0] == HEAD]
        self._learn_whole([c[1:] for c in heads] + odd, [known[c] for c in heads] + odd_numbers)
        rest = [c for c in known.new if c[0] != HEAD]
        self._learn(rest, [known[c] for c in rest])
        known.new = []
        count = np.fromiter(map(len, rows), np.int64, len(rows))
        at = np.fromiter(chain.from_iterable(rows), np.int64, int(count.sum()))
        size = self.size[at]
        stop = np.cumsum(size)
        ids = self.flat[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(self.start[at] - stop + size, size)]
        ends = np.cumsum(count)
        return ids, np.concatenate([[0], stop[ends - 1]]) if len(rows) else np.zeros(1, np.int64)
