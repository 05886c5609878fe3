"""Operator 4: personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans of four kinds, which always stay. The field looks at the regions around digits and @
signs and adds spans that the patterns miss, such as telephone numbers without a plus sign or addresses that spell out
"at". It scores whole candidate spans, not tokens: digits, groups, separators, check digits, the word before and what
touches the span's ends are features of a span and a kind. A segmentation of a region is a sequence of spans of up to
SPAN tokens and single tokens outside; a weight between the kinds of each span and of the one before it makes kinds
depend on each other. Dynamic programming over span ends and the last kind finds the best segmentation, boundaries and
kinds together, in time linear in the region. Weights maximise the likelihood of segmentations of composed examples and
of regions from a bounded sample of the corpus, labelled by the patterns; gradients come from the forward-backward sums
over all segmentations. Regions in which a first fit to the composed examples sees more than the patterns do are left
out of the sample, for the patterns do not say what that is.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_FIND = {k: re.compile(v) for k, v in PATTERNS.items()}
#: Tokens of a candidate span; characters that a region takes in on either side; the most sampled texts, and pieces of
#: their regions, of at most LONGEST characters each, to learn from; rounds of training, and of the second fit.
SPAN, AROUND, SAMPLE, LONGEST, ROUNDS, MORE_ROUNDS = 17, 28, 300, 400, 60, 30
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
_TRIGGER = re.compile(r"[0-9]+|@|[\[(] ?(?:at|AT) ?[\])]| at (?=[\w-]+ dot )")
_CUES = {
    "email": {"mail", "email", "contact", "courriel", "write"}, "ip": {"ip", "host", "server", "address", "node"},
    "card": {"card", "visa", "credit", "mastercard", "karte", "carte"}, "phone": {"phone", "tel", "call", "fax", "mobile", "telefon", "telephone", "cell"},
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def _holds(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in s.split(".")))
    if kind == "card":
        d = _digits(s)
        return 16 <= len(d) <= 19 and luhn(d)
    return kind != "phone" or 8 <= len(_digits(s)) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns by kind as listed, then start; failing matches are dropped, not retried."""
    out = []
    for kind, need in (("email", "@"), ("ip", "."), ("card", ""), ("phone", "+")):
        if need in text:
            out += [(kind, m.start(), m.end()) for m in _FIND[kind].finditer(text) if _holds(kind, m[0])]
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around digits, @ and spelled "at"; triggers whose surroundings meet share one."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _shape(s: str) -> tuple[str, ...]:
    """Names of a span's own features, the same for all kinds."""
    d = _digits(s)
    groups = re.findall("[0-9]+", s)
    letters = sum(c.isalpha() for c in s)
    out = [f"digits{min(len(d), 20)}", f"groups{min(len(groups), 6)}", f"longest{min(max(map(len, groups), default=0), 8)}", f"first:{s[0] if not s[0].isalnum() else 'a' if s[0].isalpha() else '0'}"]
    if "@" in s:
        out.append("@")
        if re.fullmatch(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+", s):
            out.append("mail")
    if re.fullmatch(r"[\w.%+-]+\s?[\[(]?\s?at\s?[\])]?\s?[\w-]+(\s?[\[(]?\s?(\.|dot)\s?[\])]?\s?[a-z]{2,12})+", s, re.I) and ("(" in s or "[" in s or " dot " in s):
        out.append("spelled")
    if len(groups) == 4 and s.count(".") == 3 and not letters:
        out.append("quad" if all(len(g) < 4 and int(g) < 256 for g in groups) and len(s) == len(d) + 3 else "badquad")
    if len(d) >= 13 and not letters:
        out.append("luhn" if luhn(d) else "noluhn")
    if not letters and re.fullmatch(r"(\([0-9]{3}\)[ -]?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}", s):
        out.append("national")
    if not letters and re.fullmatch(r"(19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}", s):
        out.append("date")
    for name, yes in (("letters", letters), ("space", " " in s), ("line", "\n" in s), ("dash", "-" in s), ("dot", "." in s), ("bracket", "(" in s), ("other", any(c in ",;:/=\"'<>#*$%&|_" for c in s)), ("end", not s[-1].isalnum())):
        if yes:
            out.append(name)
    return tuple(out)


class Field:
    """Weights of features for each kind, weights between a kind and the kind before it (row 0: none before), and the
    dynamic programmes over a region."""

    def __init__(self, index: dict[str, int] | None = None, weights: np.ndarray | None = None, steps: np.ndarray | None = None):
        self.index = index or {}
        self.weights = weights if weights is not None else np.zeros((0, len(KINDS)))
        self.steps = steps if steps is not None else np.zeros((len(KINDS) + 1, len(KINDS)))

    @staticmethod
    def spans(text: str, a: int, b: int, taken: list[tuple[int, int]] = ()) -> tuple[list[int], list[tuple[int, int, tuple[str, ...]]]]:
        """Token borders of a region, and candidate spans (first, last border, features) that no taken span meets."""
        cuts = [a, *[a + m.end() for m in _TOKEN.finditer(text[a:b])]]
        out = []
        for i in range(len(cuts) - 1):
            s0 = text[cuts[i]]
            if not (s0.isalnum() or s0 in "+("):
                continue
            before = "cut" if cuts[i] and text[cuts[i] - 1].isalnum() or cuts[i] and text[cuts[i] - 1] in "+@.-_" else "free"
            cue = re.findall(r"[^\W\d_]+", text[max(0, cuts[i] - 24) : cuts[i]].lower())[-2:]
            for j in range(i + 1, min(len(cuts), i + SPAN + 1)):
                s = text[cuts[i] : cuts[j]]
                if "\n" in s:
                    break
                if not s[-1].isalnum() or ("@" not in s and not any("0" <= c <= "9" for c in s) and " at" not in s and "(at" not in s and "[at" not in s):
                    continue
                if any(x < cuts[j] and cuts[i] < y for x, y in taken):
                    break
                after = "cut" if cuts[j] < len(text) and (text[cuts[j]].isalnum() or text[cuts[j]] in "@_" or text[cuts[j]] in ".-" and text[cuts[j] + 1 : cuts[j] + 2].isalnum()) else "free"
                cues = tuple(f"cue:{k}" for k, w in _CUES.items() if any(c in w for c in cue))
                out.append((i, j, ("span", f"before:{before}", f"after:{after}", *cues, *_shape(s))))
        return cuts, out

    def scores(self, spans) -> np.ndarray:
        if not self.index or not spans:
            return np.zeros((len(spans), len(KINDS)))
        get, flat, stops = self.index.get, [], []
        for x in spans:  # every span has a known feature, "span"
            stops.append(len(flat))
            flat += [i for i in map(get, x[2]) if i is not None]
        return np.add.reduceat(self.weights[flat], stops, axis=0)

    def best(self, cuts: list[int], spans) -> list[tuple[str, int, int]]:
        """Viterbi: the best segmentation's spans, as (kind, start, end)."""
        if not spans:
            return []
        score, steps = self.scores(spans), self.steps
        # the most that a span of a kind can add: its score, the step to it, and what it changes for the next step
        most = score + steps.max(axis=0) + np.maximum(0, (steps[1:] - steps.min(axis=0)).max(axis=1))
        ends: dict[int, list[tuple[int, int]]] = {}
        for x, k in np.argwhere(most > 0).tolist():
            ends.setdefault(spans[x][1], []).append((x, k))
        if not ends:
            return []
        step, value, states = steps.tolist(), score.tolist(), range(len(KINDS) + 1)
        total: list[list[float]] = [[0.0, *[-np.inf] * len(KINDS)]]
        came: list[list | None] = [None]
        for j in range(1, len(cuts)):
            now, by = total[j - 1], None
            for x, k in ends.get(j, ()):
                before = total[spans[x][0]]
                got, s = max((before[s] + step[s][k], -s) for s in states)
                if got + value[x][k] > now[k + 1]:
                    if by is None:
                        now, by = now.copy(), [None] * len(states)
                    now[k + 1], by[k + 1] = got + value[x][k], (x, -s)
            total.append(now)
            came.append(by)
        out, j = [], len(cuts) - 1
        state = max(states, key=lambda s: (total[j][s], -s))
        while j > 0:
            got = came[j][state] if came[j] else None
            if got is None:
                j -= 1
            else:
                i = spans[got[0]][0]
                out.append((KINDS[state - 1], cuts[i], cuts[j]))
                j, state = i, got[1]
        return out[::-1]


class _Lattice:
    """All candidate spans of many regions, by region, and the sums over all segmentations of each, for all regions at
    once. Sums are of exponentials: a region is short, and scores are held within ±CLIP while learning."""

    CLIP = 25.0

    def __init__(self, made: list[tuple[int, list, np.ndarray]], index: dict[str, int]):
        """made: (borders, spans, kind of each span or -1) of every region; new features enter the index."""
        tuples: dict[tuple, int] = {}
        rows = [(j, r, i, tuples.setdefault(f, len(tuples)), k) for r, (_, spans, kind) in enumerate(made) for (i, j, f), k in zip(spans, kind.tolist(), strict=True)]
        rows.sort(key=lambda x: x[:3])
        self.end, self.region, self.start, self.shape, self.kind = np.array(rows, np.int64).reshape(-1, 5).T
        flat = [[index.setdefault(f, len(index)) for f in t] for t in tuples]
        self.stops = np.cumsum([0, *map(len, flat)])[:-1]
        self.flat = np.array([i for t in flat for i in t], np.int64)
        self.owner = np.repeat(np.arange(len(flat)), [len(t) for t in flat])
        self.borders = np.array([n for n, _, _ in made], np.int64)
        self.by_end = [(int(self.end[x.start]), x) for x in _stretches(self.end)]
        order = np.argsort(self.start, kind="stable")
        self.by_start = [(int(self.start[order[x.start]]), order[x]) for x in _stretches(self.start[order])]
        # the labelled steps: of each labelled span the kind of the one before it in its region, or none
        labelled = np.flatnonzero(self.kind >= 0)
        labelled = labelled[np.lexsort((self.start[labelled], self.region[labelled]))]
        first = np.ones(len(labelled), bool)
        first[1:] = np.diff(self.region[labelled]) != 0
        before = np.concatenate([[0], self.kind[labelled][:-1] + 1]).astype(np.int64)[: len(labelled)]
        self.want_steps = np.zeros((len(KINDS) + 1, len(KINDS)))
        np.add.at(self.want_steps, (np.where(first, 0, before), self.kind[labelled]), 1)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.flat], self.stops, axis=0)[self.shape].clip(-self.CLIP, self.CLIP)

    def expected(self, score: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of each (span, kind), expected steps over all regions, and the sum of each region."""
        n, regions = int(self.borders.max()), len(self.borders)
        gain, step = np.exp(score), np.exp(steps)
        forth, back = np.zeros((n, regions, len(KINDS) + 1)), np.ones((n, regions, len(KINDS) + 1))
        forth[:, :, 0] = 1
        at = 1
        for j, x in self.by_end:
            forth[at : j + 1, :, 1:] = forth[at - 1, :, 1:]
            np.add.at(forth[j, :, 1:], self.region[x], (forth[self.start[x], self.region[x]] @ step) * gain[x])
            at = j + 1
        forth[at:, :, 1:] = forth[at - 1, :, 1:]
        at = n - 2
        for i, x in self.by_start[::-1]:
            back[i : at + 1] = back[at + 1]
            after = gain[x] * back[self.end[x], self.region[x], 1:]
            np.add.at(back[i], self.region[x], after @ step.T)
            at = i - 1
        whole = forth[-1].sum(axis=1)
        after = gain * back[self.end, self.region, 1:] / whole[self.region][:, None]
        before = forth[self.start, self.region]
        return after * (before @ step), (before.T @ after) * step, whole

    def gradient(self, weights: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chance, taken, _ = self.expected(self.scores(weights), steps)
        miss = -chance
        has = self.kind >= 0
        miss[np.flatnonzero(has), self.kind[has]] += 1
        by_shape = np.stack([np.bincount(self.shape, miss[:, k], len(self.stops)) for k in range(len(KINDS))], axis=1)
        out = np.stack([np.bincount(self.flat, by_shape[self.owner, k], len(weights)) for k in range(len(KINDS))], axis=1)
        return out, self.want_steps - taken


def _stretches(x: np.ndarray) -> list[slice]:
    stops = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)]
    return [slice(a, b) for a, b in zip(stops[:-1], stops[1:], strict=True) if b > a]


def composed(seed: int = 7, count: int = 360) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Example texts with spans: the four kinds in several forms among other numbers."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvy") for _ in range(r.randint(2, 9)))

    def card() -> str:
        d = r.choice("3456") + digits(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice(["", " ", "-"]).join([d[i : i + 4] for i in range(0, 16, 4)])

    forms = {
        "email": lambda: r.choice([f"{word()}.{word()}@{word()}.{word()}", f"{word()}{digits(2)}@{word()}.com", f"{word()} (at) {word()} (dot) com", f"{word()}[at]{word()}.org", f"{word()} at {word()} dot net"]),
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice([f"+{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(11)}", f"{digits(3)}.{digits(3)}.{digits(4)}"]),
    }
    other = [
        lambda: digits(r.randint(1, 7)), lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"${digits(3)}.{digits(2)}", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: f"{digits(2)}:{digits(2)}",
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([16, 32, 40]))), lambda: digits(r.randint(12, 24)), lambda: f"{digits(2)}%", lambda: f"@{word()}", lambda: f"{word()} at {word()}", lambda: f"{r.randint(256, 999)}.{digits(3)}.{digits(3)}.{digits(3)}", lambda: f"{digits(3)}-{digits(4)}-{word()}",
        lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: f"{digits(3)} {digits(3)} {digits(4)} {digits(2)}",
    ]
    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(1, 4))) + r.choice([" ", ": ", " ", ". "])
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                if r.random() < 0.3:
                    text += r.choice(sorted(_CUES[kind])) + r.choice([" ", ": "])
                s = forms[kind]()
                spans.append((kind, len(text), len(text) + len(s)))
                text += s
            else:
                text += r.choice(other)()
            text += r.choice([" ", ". ", ", "])
        out.append((text + word(), spans))
    return out


def learn(examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = ROUNDS, start: Field | None = None) -> Field:
    """Weights by adaptive steps on the log-likelihood of all regions, with a small quadratic penalty, from zero or from
    those of ``start``. No example gives a field that finds nothing."""
    made = []
    for text, gold in examples:
        want = {(s, e): KINDS.index(k) for k, s, e in gold}
        for a, b in regions(text):
            cuts, spans = Field.spans(text, a, b)
            if spans:
                made.append((len(cuts), spans, np.array([want.get((cuts[i], cuts[j]), -1) for i, j, _ in spans])))
    if not made:
        return start or Field()
    index = dict(start.index) if start else {}
    lattice = _Lattice(made, index)
    weights, steps = np.zeros((len(index), len(KINDS))), np.zeros((len(KINDS) + 1, len(KINDS)))
    if start:
        weights[: len(start.weights)], steps = start.weights, start.steps.copy()
    moved = [[np.zeros_like(v), np.zeros_like(v)] for v in (weights, steps)]
    for t in range(1, rounds + 1):
        for v, g, m in zip((weights, steps), lattice.gradient(weights, steps), moved, strict=True):
            g = g - 0.05 * v
            m[0] = 0.8 * m[0] + 0.2 * g
            m[1] = 0.95 * m[1] + 0.05 * g * g
            v += 0.25 * (m[0] / (1 - 0.8**t)) / (np.sqrt(m[1] / (1 - 0.95**t)) + 1e-3)
    return Field(index, weights, steps)


@lru_cache(1)
def _composed_field() -> Field:
    return learn(composed())


def sampled_pieces(docs: DataFrame, sample: int = SAMPLE, longest: int = LONGEST, text_col: str = "text") -> list[str]:
    """At most ``sample`` pieces of regions, of at most ``longest`` characters: all regions of the ``sample`` texts with
    the least hashes are cut into pieces, and of these the ones with the least hashes are taken. Equal texts and equal
    pieces count once."""
    text = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    least = [r.h for r in text.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(sample).collect()]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"piece": [t[x : min(b, x + longest)] for t in pdf["text"] for a, b in regions(t) for x in range(a, b, longest)]})

    bounded(docs.sparkSession)
    pieces = text.where(F.xxhash64("text").isin(least)).mapInPandas(run, "piece string").distinct()
    return [r.piece for r in pieces.orderBy(F.xxhash64("piece"), "piece").limit(sample).collect()]


def train(docs: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> Field:
    """Learns from composed examples, and then from these and the pieces that ``sampled_pieces`` takes, labelled by the
    patterns. An empty table leaves the composed examples alone."""
    first = _composed_field()
    known = [(t, base_spans(t)) for t in sampled_pieces(docs, sample, text_col=text_col)]
    known = [(t, base) for t, base in known if len(all_spans(t, first)[1]) == len(base)]
    return learn([*composed(), *known], MORE_ROUNDS, first)


def all_spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: by kind as listed, then start."""
    base = base_spans(text)
    taken = [(a, b) for _, a, b in base]
    more = []
    for a, b in regions(text):
        near = [x for x in taken if x[0] < b and a < x[1]]
        more += field.best(*Field.spans(text, a, b, near))
    return base, sorted({*base, *more}, key=lambda x: (KINDS.index(x[0]), *x[1:])) if more else base


def find_spans(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs → (doc_id, base, spans) of every row: arrays of (kind, start, end) in code points, end exclusive.

    Null and empty texts have none; null ids stay null; rows that repeat an id are rows of their own; equal texts have
    equal spans; a span starts and ends once for each kind, and of segmentations with equal scores the one with fewer
    spans is taken; very long texts are searched whole, region by region; other columns are not read, whatever their
    names; an empty table gives an empty result.
    """
    kind = "array<struct<kind:string,start:long,end:long>>"

    def run(batches):
        for batch in batches:
            found = [all_spans(t or "", field) for t in batch.column(1).to_pylist()]
            rows = [[[{"kind": k, "start": a, "end": b} for k, a, b in part] for part in both] for both in found]
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], kinds), pa.array([r[1] for r in rows], kinds)], names=["doc_id", "base", "spans"])

    bounded(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def redacted(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """docs → docs with every span of their texts replaced by its kind in brackets; spans that meet become one. Null
    texts stay null, and all other columns as they are."""

    def clean(text: str | None) -> str | None:
        if not text or not (spans := all_spans(text, field)[1]):
            return text
        out, at = [], 0
        for kind, a, b in sorted(spans, key=lambda x: x[1:]):
            if a >= at:
                out += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            yield batch.set_column(i, batch.schema.field(i), pa.array([clean(t) for t in batch.column(i).to_pylist()], batch.schema.field(i).type))

    bounded(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_spans(docs, train(docs))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
