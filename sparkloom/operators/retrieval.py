"""Lexical, dense and hybrid search over whole query tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from .lexical_store import Store, bm25_store, counted_terms, search_bm25_store, terms
from .ranking import keep_best_hit, topk_per_group
from .stored import few, saved
from .vector_codes import Codes, coded, search_codes

#: Vectors of a block in exact search.
BLOCK = 2048


def build_bm25_index(docs: DataFrame) -> DataFrame:
    """docs(key, text, ...) → postings (term, key, tf, dl) with the other columns of docs."""
    rest = [c for c in docs.columns if c not in ("key", "text")]
    rows = docs.select(F.struct("key", *rest).alias("key"), "text")

    def postings(rows: DataFrame) -> DataFrame:
        counted = counted_terms(rows).select("key.*", "dl", F.explode(F.arrays_zip("u", "tfs")).alias("x"))
        return counted.select(F.col("x.u").alias("term"), "key", "dl", *rest, F.col("x.tfs").cast("long").alias("tf"))

    # a document's terms are counted within its row; rows of one key add up where they are of one length
    again = saved(docs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("__k")), "keys-again")
    if again.isEmpty():
        return postings(rows)
    again, met = few(again), F.col("key.key").eqNullSafe(F.col("__k"))
    added = postings(rows.join(again, met, "left_semi")).groupBy("term", "key", "dl", *rest).agg(F.sum("tf").alias("tf"))
    return postings(rows.join(again, met, "left_anti")).unionByName(added)


def bm25_search(queries: DataFrame, docs: DataFrame | Store, k: int, digits: int = 6) -> DataFrame:
    """queries(query_id, text) → (query_id, key, score, rank): the k best documents of each query, exactly, over a stored
    index (``lexical_store``), or over docs(key, text), for which one is built."""
    store = docs if isinstance(docs, Store) else bm25_store(docs)
    return search_bm25_store(queries, store, k, digits)


def _unit(vectors: pd.Series) -> np.ndarray:
    v = np.array(vectors.tolist(), np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows(id, vec) → (ids, width, data): unit vectors of up to ``size`` rows of a partition as one value."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size]
                v = _unit(part["vec"])
                yield pd.DataFrame({"ids": [part["id"].to_numpy(np.int64).tobytes()], "width": [v.shape[1]], "data": [v.tobytes()]})

    return rows.where("vec IS NOT NULL").mapInPandas(run, "ids binary, width int, data binary")


def dense_search(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """queries(query_id, vec) × vectors(key, vec) → exact top k by cosine for a stated set of queries.

    Both sides become blocks of BLOCK vectors, one value each, on the executors; a task multiplies a block of queries with
    a block of vectors and keeps k candidates for each query of it. Nothing passes through the driver. Rows without a
    vector take no part."""
    q = _blocks(queries.select(F.col("query_id").alias("id"), "vec"), BLOCK).select(F.col("ids").alias("qids"), F.col("data").alias("qdata"))
    v = _blocks(vectors.select(F.col("key").alias("id"), "vec"), BLOCK)

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                ids, keys = np.frombuffer(r.qids, np.int64), np.frombuffer(r.ids, np.int64)
                s = np.round(np.frombuffer(r.qdata).reshape(len(ids), -1) @ np.frombuffer(r.data).reshape(len(keys), -1).T, digits)
                order = np.lexsort((np.broadcast_to(keys, s.shape), -s), axis=1)[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "key": keys[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

    met = v.crossJoin(q).mapInPandas(run, "query_id long, key long, score double")  # block by block
    return topk_per_group(met, ["query_id"], [F.desc("score"), F.col("key")], k)


def _nearest(v: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    d = (centers**2).sum(1)[None, :] - 2 * v @ centers.T
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def fit_cells(sample: pd.Series, cells: int, rounds: int = 12) -> np.ndarray:
    """k-means centres of sampled vectors."""
    if not len(sample):
        return np.zeros((1, 1))
    v = _unit(sample)
    centers = v[np.linspace(0, len(v) - 1, min(cells, len(v))).astype(int)].copy()
    for _ in range(rounds):
        at = _nearest(v, centers, 1)[:, 0]
        for c in range(len(centers)):
            if (at == c).any():
                centers[c] = v[at == c].mean(axis=0)
    return centers


def _probes(sample: np.ndarray, centers: np.ndarray, k: int, recall: float, asked: int = 200) -> int:
    """The least number of cells in which sampled vectors find ``recall`` of their k nearest in the sample. Neighbours
    are farther apart in a sample than among all vectors, so this is on the safe side."""
    q = sample[:asked]
    best = np.argsort(-(q @ sample.T), axis=1, kind="stable")[:, : k + 1]
    cell = _nearest(sample, centers, 1)[:, 0]
    order = _nearest(q, centers, len(centers)).argsort(axis=1)  # a cell's place among those that a query asks
    place = np.take_along_axis(order, cell[best], axis=1)
    for n in range(1, len(centers) + 1):
        if (place < n).mean() >= recall:
            return n
    return len(centers)


def cell_search(queries: DataFrame, vectors: DataFrame, k: int, cells: int | None = None, probe: int | None = None, recall: float = 0.95, sample: int = 5000) -> DataFrame:
    """Approximate top k: every vector lies in its nearest cell, a query asks its ``probe`` nearest, and what they hold
    is scored exactly. There are about as many cells as the square root of the vectors; ``probe`` is fitted so that
    vectors of a bounded sample reach ``recall`` among each other: few cells where vectors have clusters, most of them
    where they have none. All vectors are indexed; only centres and ``probe`` come from the sample.

    A task gathers the vectors of a batch by cell and sends one block for each, and queries do the same, so blocks of a
    frequent cell are rows that a skewed join can split, and never one group."""
    rows = vectors.where("vec IS NOT NULL").orderBy(F.xxhash64("key"), "key").limit(sample).select("vec").toPandas()
    if cells is None:
        cells = max(1, round(vectors.count() ** 0.5))
    centers = fit_cells(rows["vec"], min(cells, 4096))
    probe = probe or (_probes(_unit(rows["vec"]), centers, k, recall) if len(rows) else 1)

    def blocks(n):
        def run(batches):
            for pdf in batches:
                v = _unit(pdf["vec"])
                near, ids = _nearest(v, centers, n), pdf["id"].to_numpy(np.int64)
                for c in np.unique(near):
                    at = np.flatnonzero((near == c).any(axis=1))
                    yield pd.DataFrame({"cell": [int(c)], "ids": [ids[at].tobytes()], "data": [v[at].tobytes()]})

        return run

    def score(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                ids, keys = np.frombuffer(r.qids, np.int64), np.frombuffer(r.ids, np.int64)
                s = np.round(np.frombuffer(r.qdata).reshape(len(ids), -1) @ np.frombuffer(r.data).reshape(len(keys), -1).T, 6)
                order = np.lexsort((np.broadcast_to(keys, s.shape), -s), axis=1)[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "key": keys[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

    schema = "cell long, ids binary, data binary"
    held = vectors.where("vec IS NOT NULL").select(F.col("key").alias("id"), "vec").mapInPandas(blocks(1), schema)
    asked = queries.where("vec IS NOT NULL").select(F.col("query_id").alias("id"), "vec").mapInPandas(blocks(probe), schema).select("cell", F.col("ids").alias("qids"), F.col("data").alias("qdata"))
    met = held.join(asked, "cell").mapInPandas(score, "query_id long, key long, score double")
    return topk_per_group(met, ["query_id"], [F.desc("score"), F.col("key")], k)


def dense_search_ann(queries: DataFrame, vectors: DataFrame | Codes, k: int, rerank: int | None = None) -> DataFrame:
    """Approximate top k over stored codes (``vector_codes``), or over vectors(key, vec), which are coded first. Where
    vectors have clusters ``cell_search`` reads a few of them."""
    return search_codes(queries, vectors if isinstance(vectors, Codes) else coded(vectors), k, rerank)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """found and exact(query_id, key) → one row (queries, recall): the share of the exact hits that were found."""
    rows = exact.select("query_id", "key").join(found.select("query_id", "key", F.lit(1).alias("hit")), ["query_id", "key"], "left")
    return rows.agg(F.count_distinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def weighted_fusion(channels: list[tuple[DataFrame, float]], digits: int = 9) -> DataFrame:
    """(query_id, key, score) of several channels → the weighted sum; a channel without the key adds nothing. Scores of
    six places under weights of two have at most nine, so rounding to nine hides the order of summing and meets no tie."""
    rows = None
    for hits, weight in channels:
        part = hits.select("query_id", "key", (F.col("score") * weight).alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("query_id", "key").agg(F.round(F.sum("score"), digits).alias("score"))


def lexical_unit(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.col("score") / (1 + F.col("score")))


def cosine_unit(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", (1 + F.col("score")) / 2)


def hybrid_search(queries: DataFrame, docs: DataFrame, k: int, dense_weight: float = 0.55, depth: int = 50, store: Store | None = None) -> DataFrame:
    """queries(query_id, text, vec) over docs(key, text, vec) that scope filters have passed → fused top k. ``store`` is
    the documents' standing index; without one it is built."""
    lexical = lexical_unit(bm25_search(queries, store or docs.select("key", "text"), depth))
    dense = cosine_unit(dense_search(queries, docs, depth))
    fused = weighted_fusion([(dense, dense_weight), (lexical, 1 - dense_weight)])
    return topk_per_group(fused, ["query_id"], [F.desc("score"), F.col("key")], k)


def multi_vector_search(queries: DataFrame, vectors: DataFrame, fields: dict[str, float], k: int, depth: int = 100) -> DataFrame:
    """One search for each vector field, fused by weight."""
    parts = [(cosine_unit(dense_search(queries.select("query_id", F.col(f).alias("vec")), vectors.select("key", F.col(f).alias("vec")), depth)), w) for f, w in fields.items()]
    return topk_per_group(weighted_fusion(parts), ["query_id"], [F.desc("score"), F.col("key")], k)


def search_many(hits: DataFrame, variants: DataFrame, k: int, per_variant: int = 5) -> DataFrame:
    """Hits of all variants(query_id, variant_no) → best per document, at most ``per_variant`` times the variants as
    candidates, then k."""
    best = keep_best_hit(hits, ["query_id", "key"])
    cap = variants.groupBy("query_id").agg((F.count("*") * per_variant).alias("cap"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return best.withColumn("rank", rank).join(cap, "query_id").where((F.col("rank") <= F.col("cap")) & (F.col("rank") <= k)).drop("cap")


def rerank(hits: DataFrame, scorer=None, top_n: int = 5) -> DataFrame:
    """hits(query_id, key, query, text) → scores of a batch function in place of the old ones; by default the share of
    the query's words that the text has. The function gets a pandas frame and returns one score for each row."""

    def overlap(pdf: pd.DataFrame) -> list[float]:
        out = []
        for q, t in zip(pdf["query"], pdf["text"], strict=True):
            w = set((q or "").lower().split())
            out.append(len(w & set((t or "").lower().split())) / max(1, len(w)))
        return out

    score = scorer or overlap

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"query_id": pdf["query_id"], "key": pdf["key"], "score": [round(float(x), 6) for x in score(pdf)]})

    rows = hits.select("query_id", "key", "query", "text").mapInPandas(run, "query_id long, key long, score double")
    return topk_per_group(rows, ["query_id"], [F.desc("score"), F.col("key")], top_n)


def query_variants(query: Column, extra: int = 2, rules=R.VARIANT_RULES) -> Column:
    """The query and up to ``extra`` rewordings by ordered rules; short structured questions stay alone."""
    made = []
    for any_of, all_of, fold, pairs in rules:
        q = F.lower(query) if fold else query
        when = F.lit(True)
        if any_of:
            when = when & q.rlike("|".join(any_of))
        for x in all_of:
            when = when & F.contains(q, F.lit(x))
        for old, new in pairs:
            made.append(F.when(when, F.trim(F.regexp_replace(query, ("(?i)" if fold else "") + old, new))))
    all_ = F.array_distinct(F.filter(F.array(query, *made), lambda x: x.isNotNull() & (x != "")))
    short = (F.length(query) <= 24) & query.rlike("|".join(R.SHORT_STRUCTURED))
    return F.when(short, F.array(query)).otherwise(F.slice(all_, 1, extra + 1))


def retrieval_key(fields: list[str], roles: str, variants: str) -> Column:
    """24 digits of the hash over all that a result depends on: roles sorted, variants in order."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in sorted(fields)]
    return F.substring(T.stable_hash(*parts, F.array_join(F.array_sort(roles), ","), F.array_join(variants, "\x1f")), 1, 24)


def faq_direct_answer(question: Column, standard: Column, answer: Column, score: Column, threshold: Column, exact_only: Column) -> Column:
    said = F.nullif(F.trim(answer), F.lit(""))
    return F.when(F.trim(question) == F.trim(standard), said).when(~exact_only & (score >= threshold), said)


def faq_fast_path(query: Column, known_source: Column, most: int = 48) -> Column:
    q = F.trim(query)
    return (q != "") & (F.length(q) <= most) & ~F.contains(q, F.lit("\n")) & (q.rlike("|".join(R.FAQ_FAST_HINTS)) | known_source)


#: Search widths and thresholds that plans start from.
PLAN = {"faq_top_k": 20, "faq_short_top_k": 30, "doc_top_k": 20, "doc_complex_top_k": 24, "context_top_n": 4, "direct": 0.72, "short_chars": 20}


def retrieval_plan(q: DataFrame) -> DataFrame:
    """queries(query, intent, decision_score, category, table_query) → search parameters, by layers in a fixed order:
    intent, short question, decision score, category, table. Each sets, floors or caps a parameter and names itself."""
    c, p = F.col, PLAN
    short = F.length(F.trim("query")) <= p["short_chars"]
    q = q.withColumns({"faq_top_k": F.when(short, p["faq_short_top_k"]).otherwise(p["faq_top_k"]), "doc_top_k": F.lit(p["doc_top_k"]), "context_top_n": F.lit(p["context_top_n"]), "direct_threshold": F.lit(p["direct"]), "exact_only": F.lit(False), "reason": F.lit("balanced_retrieval")})

    def layer(q: DataFrame, cases: list[tuple[Column, dict[str, Column], str, bool]]) -> DataFrame:
        made = {name: c(name) for name in ("faq_top_k", "doc_top_k", "context_top_n", "direct_threshold", "exact_only", "reason")}
        for name in made:
            e = None
            for when, change, reason, replace in cases:
                value = F.lit(reason) if replace and name == "reason" else F.concat_ws("_", "reason", F.lit(reason)) if name == "reason" else change.get(name, c(name))
                e = F.when(when, value) if e is None else e.when(when, value)
            made[name] = e.otherwise(c(name))
        return q.withColumns(made)

    at_least = lambda name, v: F.greatest(c(name), F.lit(v))
    wide = p["doc_complex_top_k"]
    intent = c("intent")
    q = layer(q, [
        (intent == "FAQ_QUERY", {"doc_top_k": F.lit(10), "direct_threshold": F.lit(0.64)}, "faq_first", True),
        (intent == "KNOWLEDGE_QUERY", {"doc_top_k": at_least("doc_top_k", wide), "context_top_n": at_least("context_top_n", 5)}, "knowledge_doc_enriched", True),
        (intent == "FOLLOW_UP", {"faq_top_k": F.lit(24), "doc_top_k": at_least("doc_top_k", wide), "context_top_n": at_least("context_top_n", 5), "direct_threshold": at_least("direct_threshold", 0.82)}, "history_aware_follow_up", True),
    ])
    q = layer(q, [(short & (intent != "FOLLOW_UP"), {"doc_top_k": F.least("doc_top_k", F.lit(12)), "direct_threshold": at_least("direct_threshold", 0.78)}, "short_query_guard", False)])
    q = layer(q, [
        (c("decision_score") < 0.70, {"doc_top_k": at_least("doc_top_k", wide), "context_top_n": at_least("context_top_n", 6), "direct_threshold": at_least("direct_threshold", 0.86), "exact_only": F.lit(True)}, "low_rule_score_guard", False),
        (c("decision_score") < 0.82, {"doc_top_k": at_least("doc_top_k", p["doc_top_k"]), "direct_threshold": at_least("direct_threshold", 0.82)}, "rule_score_guard", False),
    ])
    guard = {"doc_top_k": at_least("doc_top_k", wide), "context_top_n": at_least("context_top_n", 6)}
    q = layer(q, [
        (c("category") == "pricing", guard | {"faq_top_k": at_least("faq_top_k", p["faq_top_k"]), "direct_threshold": at_least("direct_threshold", 0.84)}, "pricing_guard", False),
        (c("category") == "compliance", guard | {"direct_threshold": at_least("direct_threshold", 0.86)}, "compliance_guard", False),
        (c("category") == "troubleshooting", guard, "troubleshooting_expanded", False), (c("category") == "summary", guard, "summary_expanded", False),
    ])
    return layer(q, [(c("table_query"), {"doc_top_k": at_least("doc_top_k", wide), "context_top_n": at_least("context_top_n", 7), "exact_only": F.lit(True)}, "table_row_preferred", False)])


def answer_confidence(rows: DataFrame) -> DataFrame:
    """rows(hit_type, top_score, context_count, source_count, decision_score, deterministic, faq_exact, rewritten) →
    score of two decimals, level and reasons."""
    c = F.col
    unit, d = T.normalize_score("top_score"), F.greatest(F.least("decision_score", F.lit(1.0)), F.lit(0.0))
    base = F.when(c("deterministic"), 0.78 + 0.18 * d).when((c("hit_type") == "faq_direct") & c("faq_exact"), 0.95).when(c("hit_type") == "faq_direct", 0.55 + 0.35 * unit + 0.08 * d)
    base = base.when(c("hit_type") == "insufficient_context", 0.12 + 0.15 * unit).otherwise(0.20 + 0.45 * unit + F.least("context_count", F.lit(4)) * 0.06 + F.least("source_count", F.lit(3)) * 0.04 + 0.12 * d)
    base = base - F.when(c("rewritten"), F.when(c("context_count") >= 2, 0.05).otherwise(0.08)).otherwise(0.0) - F.when((d < 0.70) & ~c("deterministic"), 0.04).otherwise(0.0)
    bare = (c("hit_type") == "rag") & (c("context_count") == 0)
    score = F.round(F.round(F.greatest(F.least(F.when(bare, F.least(base, F.lit(0.35))).otherwise(base), F.lit(1.0)), F.lit(0.0)), 9), 2)
    kind = F.when(c("deterministic"), "deterministic_route").when((c("hit_type") == "faq_direct") & c("faq_exact"), "faq_exact_match").when(c("hit_type") == "faq_direct", "faq_score_direct").when(c("hit_type") == "insufficient_context", "insufficient_context").when(c("context_count") > 0, "rag_with_context").otherwise("rag_without_context")
    reasons = F.filter(F.array(kind, F.when(c("rewritten"), "history_rewrite_used"), F.when((d < 0.70) & ~c("deterministic"), "low_intent_decision_score"), F.when(bare, "no_selected_context")), lambda x: x.isNotNull())
    return rows.withColumn("confidence", score).withColumn("level", F.when(c("confidence") >= 0.82, "high").when(c("confidence") >= 0.55, "medium").otherwise("low")).withColumn("reasons", reasons)


def route_query(direct: Column, boundary: Column, exact_faq: Column, context_count: Column, graph: Column) -> Column:
    """The first stage with an answer decides; else retrieval, named by what it found."""
    return F.when(direct.isNotNull(), "direct").when(boundary, "boundary").when(exact_faq, "faq_direct").when(context_count > 0, "rag").when(graph, "graph_context").otherwise("insufficient_context")


def dedup_embedding_inputs(rows: DataFrame, embed, version: str, vector: str = "array<double>") -> DataFrame:
    """rows(id, text) → (id, vec): each distinct text goes through the batch function once, and its vector is joined back."""
    keyed = rows.select("id", "text", T.stable_hash("text", F.lit(version)).alias("k"))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "vec": list(embed(pdf["text"].tolist()))})

    made = keyed.select("k", "text").dropDuplicates(["k"]).mapInPandas(run, f"k string, vec {vector}")
    return keyed.select("id", "k").join(made, "k").select("id", "vec")


def text_hash_vectors(text: Column, size: int = 64) -> Column:
    """A unit vector of hashed term counts; a neural embedder is a batch function of the user's."""
    at = F.transform(terms(text), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    counts = F.aggregate(at, F.array_repeat(F.lit(0.0), size), lambda a, i: F.transform(a, lambda x, j: F.when(j == i, x + 1).otherwise(x)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return T.let(counts, lambda v: T.let(norm(v), lambda n: F.transform(v, lambda x: F.when(n == 0, 0.0).otherwise(x / n))))
