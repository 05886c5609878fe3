"""Splitting documents: sections, recursive splits, windows, parents and children, token batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Separators from coarse to fine; the last is a cut between characters.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "，", ". ", " ", "")


def split_markdown_sections(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) → (doc_id, section, h1, h2, h3, text): cut at #, ## and ###, headings carried down.

    A heading clears the deeper ones. Text before the first heading is section 0; sections without text are left out.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    level = F.length(F.regexp_extract("line", r"^(#{1,3}) +\S", 1))
    name = F.trim(F.regexp_replace("line", r"^#{1,3} +", ""))
    w = Window.partitionBy("doc_id").orderBy("n")
    rows = lines.withColumn("l", level).withColumn("section", F.sum(F.when(F.col("l") > 0, 1).otherwise(0)).over(w))
    for k in (1, 2, 3):
        # a heading of level k sets h<k>, one of a higher level clears it
        mark = F.when(F.col("l") == k, name).when((F.col("l") > 0) & (F.col("l") < k), "")
        rows = rows.withColumn(f"h{k}", F.nullif(F.last(mark, ignorenulls=True).over(w), F.lit("")))
    body = rows.where("l = 0").groupBy("doc_id", "section", "h1", "h2", "h3").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("x"))
    text = F.trim(F.array_join(F.transform("x", lambda x: x["line"]), "\n"))
    return body.select("doc_id", "section", "h1", "h2", "h3", text.alias("text")).where("text <> ''")


def recursive_pieces(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, in order, that cover the text; neighbours share up to ``overlap`` characters.

    The text is cut at the coarsest separator that it has, separators stay with what is before them; parts over the
    size are cut again at finer ones. Parts are then joined while they fit, and a piece begins with the last whole parts
    of the one before, as many as the overlap takes.
    """
    if len(text) <= size:
        return [text] if text else []

    def parts(t: str, seps: tuple[str, ...]) -> list[str]:
        if len(t) <= size:
            return [t]
        sep = seps[0]
        if sep == "":
            step = max(1, size - overlap)
            return [t[i : i + step] for i in range(0, len(t), step)]
        if sep not in t:
            return parts(t, seps[1:])
        cut = t.split(sep)
        cut = [c + sep for c in cut[:-1]] + ([cut[-1]] if cut[-1] else [])
        return [p for c in cut for p in parts(c, seps[1:])]

    out, now, length = [], [], 0
    for p in parts(text, separators):
        if now and length + len(p) > size:
            out.append("".join(now))
            while now and (length > overlap or length + len(p) > size):
                length -= len(now.pop(0))
        now.append(p)
        length += len(p)
    if now:
        out.append("".join(now))
    return out


def recursive_split(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text", name: str = "piece") -> DataFrame:
    """docs → (id, piece_no, piece): recursive_pieces in Arrow batches, and all other columns by a join are the caller's."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, p) for i, t in zip(pdf[id_col], pdf[text_col], strict=True) for n, p in enumerate(recursive_pieces(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=[id_col, f"{name}_no", name])

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, {name}_no int, {name} string")


def fixed_window_split(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Plain windows of characters: the last level of the recursive split, in SQL alone."""
    n = F.length(F.coalesce("text", F.lit("")))
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - overlap, F.lit(1)), F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    rows = docs.select("doc_id", "text", F.posexplode(starts).alias("piece_no", "start"))
    return rows.select("doc_id", "piece_no", "start", F.substring("text", F.col("start"), F.lit(size)).alias("piece"))


def parent_child_chunks(docs: DataFrame, parent: tuple[int, int] = (1000, 100), child: tuple[int, int] = (350, 50)) -> DataFrame:
    """Sections → parents → children that keep their parent's text; table rows and reviewed scans stay whole.

    docs(doc_id, text, content_type) → (doc_id, h1, h2, h3, section, parent_no, parent_content, child_no, text).
    """
    whole = F.coalesce("content_type", F.lit("")).isin("table_row", "ocr_reviewed_text")
    none = F.lit(None).cast("string")
    atomic = docs.where(whole & (F.trim("text") != "")).select("doc_id", none.alias("h1"), none.alias("h2"), none.alias("h3"), F.lit(0).cast("long").alias("section"), F.lit(0).alias("parent_no"), F.col("text").alias("parent_content"), F.lit(0).alias("child_no"), "text")
    sections = split_markdown_sections(docs.where(~whole)).select("doc_id", "h1", "h2", "h3", F.col("section").cast("long").alias("section"), "text")
    names = ["doc_id", "h1", "h2", "h3", "section", "parent_no", "parent_content", "child_no", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                rows = [(*x[:5], n, p, m, c) for x in pdf.iloc[at : at + 500].itertuples(index=False) for n, p in enumerate(recursive_pieces(x[5], *parent)) for m, c in enumerate(recursive_pieces(p, *child))]
                yield pd.DataFrame(rows, columns=names)

    kind = dict(docs.dtypes)["doc_id"]
    made = sections.mapInPandas(run, f"doc_id {kind}, h1 string, h2 string, h3 string, section long, parent_no int, parent_content string, child_no int, text string")
    return made.unionByName(atomic)


def pack_parents(chunks: DataFrame, limit: int = 4096) -> DataFrame:
    """chunks(doc_id, pos, chunk_id, parent_id, tokens) → (doc_id, batch_no, parents, chunk_ids, tokens): distinct parents
    of a document in order, in batches up to ``limit`` tokens, as a fold over a document's parents."""
    one = chunks.groupBy("doc_id", "parent_id").agg(F.min("pos").alias("pos"), F.min_by("tokens", "pos").alias("tokens"), F.array_sort(F.collect_list("chunk_id")).alias("ids"))
    items = one.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "parent_id", F.col("tokens").cast("long").alias("tokens"), "ids"))).alias("x"))
    start = F.struct(F.lit(-1).alias("b"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("bs"))

    def step(a, x):
        new = (a["b"] < 0) | (a["used"] + x["tokens"] > limit)
        b = F.when(new, a["b"] + 1).otherwise(a["b"])
        return F.struct(b.alias("b"), F.when(new, x["tokens"]).otherwise(a["used"] + x["tokens"]).alias("used"), F.concat(a["bs"], F.array(b)).alias("bs"))

    rows = items.withColumn("bs", F.aggregate("x", start, step)["bs"])
    rows = rows.select("doc_id", F.inline(F.transform("x", lambda x, i: F.struct(F.get("bs", i).alias("batch_no"), x["pos"].alias("pos"), x["tokens"].alias("tokens"), x["ids"].alias("ids")))))
    return rows.groupBy("doc_id", "batch_no").agg(F.count("*").alias("parents"), F.array_join(F.array_sort(F.flatten(F.collect_list("ids"))), ",").alias("chunk_ids"), F.sum("tokens").alias("tokens"))
