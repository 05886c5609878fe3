"""Operator 7: BPE encoding and decoding by a depth-first walk of a word trie.

The vocabulary lower-cases, drops white space and ends words with ``</w>``. A greedy-merge encoding has the property
that a sequence of tokens is the encoding of its text if and only if each two neighbours are the encoding of theirs.
So the encoding of a prefix is that of a shorter prefix plus one last token, and the last token is all that needs to be
kept for each prefix. Distinct new words are inserted into a trie in sorted order, which is its depth-first order; each
new node gets its last token from its ancestors', and words that share a prefix share that work, also with words of
earlier batches, for the worker keeps the trie. The verdicts on neighbours are kept as well. Very long words, such as a
text without spaces, are walked alone and not kept.

Text is cut at white space into chunks, and a worker keeps what each distinct chunk gave, so the trie sees new chunks
alone. All stores are bounded by their bytes or nodes and are emptied when they reach the bound.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, sha, table

#: Bytes of chunks, their ids and decoded texts, nodes of the trie and neighbour verdicts that a worker keeps. A chunk
#: counts CHUNK_BYTES beside its texts. Longer chunks and words than these many characters are not kept.
KEPT_BYTES, KEPT_NODES, KEPT_PAIRS = 400 << 20, 1_000_000, 1_500_000
CHUNK_BYTES, LONG_CHUNK, LONG_WORD = 330, 2048, 64
#: Fixed value: the pattern of words in the vocabulary's file.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"


@lru_cache(1)
def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return [out[b] for b in range(256)]


class TrieBPE:
    """Encodes and decodes as the tokenizers library does with the same file and add_special_tokens=False."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.longest = max(len(t.removesuffix(END)) for t in self.ids)
        self.pieces = regex.compile(PIECES).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self._empty_trie()
        self._empty_chunks()

    def _empty_chunks(self) -> None:
        self.chunks: dict[str, tuple[int, str, str]] = {}
        self.kept_bytes = 0
        for name, i in self.special.items():
            self.chunks[name] = 1, str(i), name

    def _empty_trie(self) -> None:
        """Node 0 is the root; ``child`` leads from (node, character), as one number, to a node; ``last`` and ``size``
        are each node's last token and its length."""
        self.child: dict[int, int] = {}
        self.node_last, self.node_size = [0], [0]

    def symbols(self, token: int) -> list[str]:
        text = self.tokens[token]
        body = text.removesuffix(END)
        return [*body[:-1], body[-1] + END] if body != text else [*text]

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain greedy merging, for the short texts of two tokens."""
        rank = self.rank
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: rank.get((symbols[i], symbols[i + 1]), 1 << 30))
            pair = symbols[best], symbols[best + 1]
            if pair not in rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def stands(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their text."""
        got = self.pairs.get((left, right))
        if got is None:
            got = self.merged(self.symbols(left) + self.symbols(right)) == [self.tokens[left], self.tokens[right]]
            self.pairs[left, right] = got
        return got

    def whole(self, token: int) -> bool:
        got = self.alone.get(token)
        if got is None:
            got = self.alone[token] = self.merged(self.symbols(token)) == [self.tokens[token]]
        return got

    def last_token(self, text: str, depth: int, end: str, last: list[int], size: list[int]) -> tuple[int, int]:
        """The last token, and its length, of the encoding of text[:depth] + end, from those of shorter prefixes."""
        ids = self.ids
        for n in range(min(depth, self.longest), 0, -1):
            token = ids.get(text[depth - n : depth] + end)
            if token is not None and (self.whole(token) if n == depth else self.stands(last[depth - n], token)):
                return token, n
        raise ValueError(f"no encoding of {text[:depth]!r}")

    def _insert(self, word: str, path: list[int], last: list[int], size: list[int]) -> None:
        """Walks a word down the trie from the node that ends ``path``, making nodes that are not there; ``last`` and
        ``size`` are the states along the path."""
        child, keep = self.child, len(word) <= LONG_WORD
        for depth in range(len(path), len(word)):  # inner nodes: prefixes without the word's end
            key = path[-1] << 21 | ord(word[depth - 1])
            node = child.get(key) if keep else None
            if node is None:
                token, n = self.last_token(word, depth, "", last, size)
                node = len(self.node_last)
                if keep:
                    child[key] = node
                    self.node_last.append(token)
                    self.node_size.append(n)
            else:
                token, n = self.node_last[node], self.node_size[node]
            path.append(node)
            last.append(token)
            size.append(n)

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Encodes distinct words, in stand-in characters. Sorted, they are leaves in the trie's depth-first order, so
        the path to one is cut back to what the next one shares with it."""
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        if len(self.node_last) > KEPT_NODES:
            self._empty_trie()
        out: dict[str, list[int]] = {}
        path, last, size, before = [0], [0], [0], ""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word), len(path) - 1)
            if len(word) <= LONG_WORD:
                while shared < most and before[shared] == word[shared]:
                    shared += 1
            del path[shared + 1 :], last[shared + 1 :], size[shared + 1 :]
            self._insert(word, path, last, size)
            token, at = self.last_token(word, len(word), END, last, size)
            ids, at = [token], len(word) - at
            while at:
                ids.append(last[at])
                at -= size[at]
            out[word] = ids[::-1]
            before = word if len(word) <= LONG_WORD else ""
        return out

    def _learn(self, chunks: list[str]) -> dict[str, tuple[int, str, str]]:
        """What new chunks give; those that are not long are kept."""
        chars = _byte_chars()
        parts, new = {}, set()
        for chunk in chunks:
            text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
            parts[chunk] = words = [w if w.isascii() and w.isprintable() else "".join([chars[b] for b in w.encode()]) for w in self.pieces(text.lower())]
            new.update(words)
        known, out = self.encode_words(list(new)), {}
        for chunk, words in parts.items():
            ids = [i for w in words for i in known[w]]
            out[chunk] = got = len(ids), " ".join(map(str, ids)), self.decode(ids)
            if len(chunk) <= LONG_CHUNK:
                self.chunks[chunk] = got
                self.kept_bytes += CHUNK_BYTES + 4 * len(chunk) + len(got[1]) + 4 * len(got[2]) if not chunk.isascii() else CHUNK_BYTES + len(chunk) + len(got[1]) + len(got[2])
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, as this vocabulary without a decoder is decoded."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])

    def _chunks(self, text: str) -> list[str]:
        """What lies between white space; control characters that Python alone takes for white space are kept."""
        return [c for c in re.split(r"[^\S\x1c-\x1f]+", text) if c] if re.search("[\x1c-\x1f]", text) else text.split()

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: how many ids, the ids joined by spaces, and the decoded text."""
        parts: list[list[str]] = []
        for text in texts:
            if self.special and "<|" in text:
                one: list[str] = []
                for i, x in enumerate(self.cut.split(text)):
                    one += [x] if i % 2 else self._chunks(x)  # a special string becomes a chunk of its own
                parts.append(one)
            else:
                parts.append(self._chunks(text))
        if self.kept_bytes > KEPT_BYTES:
            self._empty_chunks()
        kept = self.chunks
        new = {c for one in parts for c in one if c not in kept}
        made = self._learn(list(new)) if new else {}
        out = []
        for one in parts:
            got = [kept[c] if c in kept else made[c] for c in one]
            out.append((sum([g[0] for g in got]), " ".join([g[1] for g in got]), " ".join([g[2] for g in got])))
        return out


@lru_cache(2)
def load(path: str) -> TrieBPE:
    return TrieBPE(path)


#: Characters and texts that are encoded at once.
ASKED_CHARS, ASKED_TEXTS = 4 << 20, 500


def _asked(texts: list[str | None]):
    """Stretches of texts, of bounded length in all; a longer text is a stretch of its own."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= ASKED_CHARS or len(held) == ASKED_TEXTS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs → (doc_id, n_tokens, ids array<int>, decoded): one row per input row.

    A null text is an empty one and has no ids; null ids stay null; rows that repeat an id or a text are rows of their
    own, equal texts with equal results; texts of any length and without spaces are encoded whole; an empty table gives
    an empty result; other columns are not read, whatever their names."""

    def run(batches):
        bpe = load(tokenizer)
        for batch in batches:
            at = 0
            for texts in _asked(batch.column(1).to_pylist()):
                got = bpe.encode(texts)
                ids = pa.array([[int(x) for x in g[1].split()] for g in got], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(got)), pa.array([g[0] for g in got], pa.int64()), ids, pa.array([g[2] for g in got], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])
                at += len(got)

    bounded(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def token_text_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs → (doc_id, n_tokens, ids_sha256, decoded_sha256) without sending ids or texts out of Python; rows as in
    ``encode_texts``."""

    def run(batches):
        bpe = load(tokenizer)
        for pdf in batches:
            rows = []
            for texts in _asked(pdf["text"].tolist()):
                rows += [(n, sha(ids), sha(text)) for n, ids, text in bpe.encode(texts)]
            n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": list(n), "ids_sha256": list(ids), "decoded_sha256": list(text)})

    bounded(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_text_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
