"""Scalar text operators as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_null(x: C) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.regexp_replace(_c(x), r"^\s+|\s+$", ""), F.lit(""))


def first_filled(*xs: C) -> Column:
    return F.coalesce(*[F.nullif(_c(x), F.lit("")) for x in xs])


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def stable_hash(*parts: C) -> Column:
    """SHA-256 of the parts joined by two bars, null as empty."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts]), "||"), 256)


def source_from_path(path: C) -> Column:
    """The folder of a path without the ending ``_data``; ``default`` if that leaves nothing."""
    folder = F.coalesce(F.get(F.reverse(F.split(_c(path), "/")), 1), F.lit(""))
    return F.coalesce(F.nullif(F.regexp_replace(folder, "_data$", ""), F.lit("")), F.lit("default"))


def normalize_text(text: C) -> Column:
    return F.lower(F.regexp_replace(_c(text), r"(?U)[\s\p{P}]+", ""))


def normalize_query(text: C) -> Column:
    """Without greetings and polite openings, up to four rounds; the trimmed text if nothing else is left."""
    raw = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"(?U)^\s+|\s+$", "")
    now = F.regexp_replace(raw, r"(?U)\s+", " ")
    for _ in range(4):
        now = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(now, R.GREETING_PREFIX, ""), R.POLITE_PREFIX, ""), R.LEADING, ""))
    return F.coalesce(F.nullif(now, F.lit("")), raw)


def cell_text(text: C) -> Column:
    return F.regexp_replace(F.trim(_c(text)), r"^(\d+)\.0$", "$1")


def table_cells(text: C) -> Column:
    """Lines ``- key: value`` with keys of 1 to 40 characters, as structs."""
    rows = F.filter(F.split(_c(text), "\n"), lambda x: F.trim(x).rlike(r"^-\s*[^：:\n]{1,40}[：:]\s*\S"))
    return F.transform(rows, lambda x: F.struct(
        F.trim(F.regexp_extract(F.trim(x), r"^-\s*([^：:]{1,40})[：:]\s*(.+)$", 1)).alias("key"), F.trim(F.regexp_extract(F.trim(x), r"^-\s*([^：:]{1,40})[：:]\s*(.+)$", 2)).alias("value")))


def ocr_reviewed(text: C) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(_c(text), F.lit(m)) for m in R.OCR_MARKERS])


def numeric_facts(text: C) -> Column:
    """Distinct numbers with their units, after versions such as v2024.01 are taken out."""
    clean = F.regexp_replace(F.coalesce(_c(text), F.lit("")), R.VERSION_NUMBER, "")
    return F.array_distinct(F.transform(F.regexp_extract_all(clean, F.lit(R.NUMERIC_FACT), F.lit(0)), lambda x: F.regexp_replace(x, " ", "")))


def truncate_utf8(text: C, limit: int) -> Column:
    """The longest prefix of whole characters within so many bytes: a cut inside a character goes back to its start."""
    data = F.encode(_c(text), "utf-8")
    kept = F.substring(data, 1, limit)
    # of the last four bytes, how many belong to a character that is not whole
    code = lambda k: F.conv(F.hex(F.substring(kept, -k, 1)), 16, 10).cast("int")
    drop = F.when(code(1) < 128, 0)
    for k, least in ((1, 192), (2, 224), (3, 240)):
        drop = drop.when(code(k) >= least, k)
        if k < 3:
            continue
    whole = F.when(F.octet_length(data) <= limit, data).otherwise(F.expr("null").cast("binary"))
    return F.decode(F.coalesce(whole, F.substring(kept, F.lit(1), F.octet_length(kept) - F.coalesce(drop, F.lit(0)))), "utf-8")


def polarity(text: C, negative: str = R.NEGATIVE, positive: str = R.POSITIVE) -> Column:
    no, yes = F.coalesce(_c(text), F.lit("")).rlike(negative), F.coalesce(_c(text), F.lit("")).rlike(positive)
    return F.when(no & ~yes, "negative").when(yes & ~no, "positive").otherwise("mixed_or_unknown")


def keyword_tokens(text: C, stop: tuple[str, ...] = R.STOP_WORDS, limit: int = 12) -> Column:
    """The first distinct words of two or more characters; runs of Chinese characters give their bigrams."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(r"[\x{4e00}-\x{9fff}]+|[\p{L}\p{N}]+"), F.lit(0))
    cut = F.flatten(F.transform(runs, lambda w: F.when(w.rlike(r"^[\x{4e00}-\x{9fff}]{3,}$"), F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array(w))))
    return F.slice(F.array_distinct(F.filter(cut, lambda w: (F.length(w) >= 2) & ~w.isin(*stop))), 1, limit)


def _grams(run: Column, low: int, high: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(run) - (low - 1))
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length(run) - i + 1)), lambda n: F.substring(run, i, n))))


def ngram_terms(text: C, low: int = 2, high: int = 6) -> Column:
    """Chinese runs as all their 2- to 6-grams, other words lower-cased; distinct."""
    runs = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"[\x{4e00}-\x{9fff}A-Za-z0-9_]+"), F.lit(0))
    none = F.array().cast("array<string>")
    made = F.transform(runs, lambda w: F.when(w.rlike(r"^[\x{4e00}-\x{9fff}]+$"), F.when(F.length(w) >= low, _grams(w, low, high)).otherwise(none)).otherwise(F.array(F.lower(w))))
    return F.array_distinct(F.flatten(made))


def expand_query_tokens(text: C, low: int = 2, high: int = 6, synonyms: dict = R.SYNONYMS) -> Column:
    """2- to 6-grams of Chinese runs and their synonyms, longest first, then by text."""
    runs = F.filter(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"[\x{4e00}-\x{9fff}]+"), F.lit(0)), lambda w: F.length(w) >= low)
    grams = F.flatten(F.transform(runs, lambda w: _grams(w, low, high)))
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    more = F.flatten(F.filter(F.transform(grams, lambda g: F.element_at(table, g)), lambda x: x.isNotNull()))
    ordered = F.sort_array(F.transform(F.array_distinct(F.concat(grams, more)), lambda g: F.struct((-F.length(g)).alias("n"), g.alias("g"))))
    return F.transform(ordered, lambda x: x["g"])


def graph_search_keys(text: C) -> Column:
    """The cleaned question, and what stands before the first marker in list order, or after it if that is short."""
    clean = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[\s\x{3000}，。？！、；：,.!?;:]+", "")
    markers = F.array(*[F.lit(m) for m in R.SEARCH_MARKERS])

    def keys(q: Column) -> Column:
        def part(m: Column) -> Column:
            at = F.instr(q, m)
            before, after = F.substring(q, F.lit(1), at - 1), F.substring(q, at + F.length(m), F.length(q))
            return F.when(F.length(before) >= 2, before).otherwise(after)

        found = F.get(F.filter(markers, lambda m: F.contains(q, m)), 0)
        extra = F.when(found.isNotNull(), part(found))
        return F.when(q == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(F.array(q, extra), lambda k: F.length(k) >= F.when(k == q, 1).otherwise(2))))

    return let(clean, keys)


def relation_label(text: C) -> Column:
    """A short label from a relation's description: "is ... of", then word classes, then events, else the default."""
    d = F.trim(F.coalesce(_c(text), F.lit("")))
    clean = lambda x: F.regexp_replace(x, r"[，。！？、；：“”‘’（）【】《》\s]", "")
    fits = lambda x, low=2: F.when((F.length(x) >= low) & (F.length(x) <= 6), x)
    first = clean(F.regexp_extract(d, r"是.+的(.{2,6})(?:[，。！？、；：]|$)", 1))
    first = fits(F.when(~first.isin(*R.RELATION_IGNORED), first))
    head = F.substring(d, 1, 30)
    second = F.lit(None).cast("string")
    for label, words in R.RELATION_WORDS.items():
        second = F.coalesce(second, F.when(head.rlike("|".join(words)), F.lit(label)))
    third = fits(clean(F.regexp_extract(d, r"(?:参加|举行|举办|召开|测试出)(?:了)?(.{2,6})(?:[，。！？]|$)", 1)))
    return F.coalesce(first, second, third, F.lit("关联"))


def normalize_score(score: C) -> Column:
    s = _c(score)
    return F.when(s <= 0, 0.0).when(s <= 1, s).otherwise(1 - 1 / (1 + s))


def json_or_empty(text: C, schema: str) -> Column:
    """JSON text as an array or map; malformed text or another kind gives an empty one."""
    empty = F.array().cast(schema) if schema.startswith("array") else F.create_map().cast(schema)
    return F.coalesce(F.from_json(_c(text), schema), empty)


def clean_roles(roles: Column, extra: Column | None = None, default: str = "public") -> Column:
    """Trimmed, without blanks, first of equals kept, one more appended, never empty."""
    every = F.concat(roles, F.array(extra)) if extra is not None else roles
    kept = F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(kept) == 0, F.array(F.lit(default))).otherwise(kept)


def source_label(h3: C, h2: C, h1: C, file_name: C, question: C, source: C, reviewed: Column, confidence: Column, is_table: Column, sheet: Column, row_number: Column) -> Column:
    """Citation label: deepest heading, file, question or source; reviewed scans add a note, table rows sheet and row."""
    label = F.coalesce(first_filled(h3, h2, h1), first_filled(file_name, question, source), F.lit("unknown"))
    note = F.concat(label, F.lit(" / OCR 已复核"), F.coalesce(F.concat(F.lit(" / 置信度："), confidence.cast("string")), F.lit("")))
    place = F.concat_ws(" / ", label, F.concat(F.lit("工作表："), F.nullif(F.trim(sheet), F.lit(""))), F.concat(F.lit("第 "), row_number.cast("string"), F.lit(" 行")))
    return F.when(reviewed, note).when(is_table, place).otherwise(label)
