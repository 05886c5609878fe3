"""Readers and writers of corpora, tables, pages, evaluation cases and reports."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


#: Tasks for each core that read the files of a corpus, at most.
READERS = 16


def read_text_corpus(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """.txt and .md files as one row each (path, text, modified, and what review marks say); blank files are dropped.

    Spark reckons 4 MB for opening a file, so small files would make a task of a few; tasks read many of them in turn. The
    reader of whole texts copies Hadoop's settings for each file, the one of binary files does not."""
    rows = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.{txt,md}").load(paths)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("content").cast("string").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))
    rows = rows.coalesce(READERS * spark.sparkContext.defaultParallelism)
    return rows.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").withColumn("reviewed", T.ocr_reviewed("text"))


def read_table_rows(spark: SparkSession, path: str, table_id: str) -> DataFrame:
    """A CSV with a header → a row for each line with a value: number, filled cells as a map, and text ``- name: value``.

    Lines without any value are gone before numbering; lines that are blank after trimming keep their number and go.
    Order follows the file, so one file is read; a table of many files has numbers of its own for each.
    """
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True)
    names = [c for c in raw.columns]
    rows = raw.na.drop("all").withColumn("__at", F.monotonically_increasing_id())
    from pyspark.sql import Window

    rows = rows.withColumn("__file", F.input_file_name()).withColumn("row_number", F.row_number().over(Window.partitionBy("__file").orderBy("__at")))
    cells = F.map_filter(F.create_map(*[x for c in names for x in (F.lit(c.lstrip("﻿")), F.coalesce(T.cell_text(F.col(f"`{c}`").cast("string")), F.lit("")))]), lambda k, v: v != "")
    rows = rows.withColumn("cells", cells).where(F.size("cells") > 0)
    lines = F.array_join(F.transform(F.map_entries("cells"), lambda e: F.concat(F.lit("- "), e["key"], F.lit("："), e["value"])), "\n")
    return rows.select(F.lit(table_id).alias("table_id"), "row_number", "cells", lines.alias("text"), F.lit("table_row").alias("content_type"))


#: Headers that a FAQ table may use.
QUESTION, ANSWER, SOURCE = ("question", "问题"), ("answer", "答案"), ("source", "source_filter", "subject_name", "业务分类", "分类")


def read_faq(spark: SparkSession, path: str) -> DataFrame:
    """A FAQ table under any of its headers → (source, question, answer), trimmed."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])

    def first(names: tuple[str, ...]) -> Column:
        there = [T.blank_null(F.col(f"`{c}`")) for c in names if c in raw.columns]
        return F.coalesce(*there, F.lit(""))

    return raw.select(first(SOURCE).alias("source"), first(QUESTION).alias("question"), first(ANSWER).alias("answer"))


CASE_SCHEMA = "case_id string, scenario_id string, source_filter string, tenant_id string, dataset_id string, visibility string, user_role string, query string, question string, expected_hit_type string, expected_effective_source string, expected_prompt_profile string, expected_keywords array<string>, expected_source_contains array<string>"


def read_eval_cases(spark: SparkSession, path: str, lines: bool, limit: int | None = None) -> DataFrame:
    """Evaluation cases from a JSON list or JSON lines, with defaults for their scope; comments and blank lines are skipped."""
    if lines:
        text = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(ltrim(value), '#')")
        rows = text.select(F.from_json("value", CASE_SCHEMA).alias("c")).select("c.*")
    else:
        rows = spark.read.schema(CASE_SCHEMA).json(path, multiLine=True)
    rows = rows.withColumns({"query": F.coalesce("query", "question"), "tenant_id": F.coalesce("tenant_id", F.lit("default")), "dataset_id": F.coalesce("dataset_id", F.lit("default")), "visibility": F.coalesce("visibility", F.lit("public")), "user_role": F.coalesce("user_role", F.lit("public"))}).drop("question")
    return rows.limit(limit) if limit else rows


SCENARIO_SCHEMA = "scenario_id string, display_name string, valid_sources array<string>, source_labels map<string,string>, source_patterns map<string,string>"


def read_scenario_dim(spark: SparkSession, path: str, toml: bool = False) -> DataFrame:
    """Scenario files of JSON, or of TOML, below a path → one row a source (scenario_id, display_name, source,
    source_order, pattern, label); files without the required fields, or that cannot be parsed, are left out."""
    if toml:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.toml").load(path)
        rows = files.select("content").mapInPandas(_toml_as_json, "value string").select(F.from_json("value", SCENARIO_SCHEMA).alias("s")).select("s.*")
    else:
        rows = spark.read.schema(SCENARIO_SCHEMA).json(path, multiLine=True)
    rows = rows.where("scenario_id IS NOT NULL AND size(valid_sources) > 0")
    rows = rows.select("scenario_id", "display_name", "source_labels", "source_patterns", F.posexplode("valid_sources").alias("source_order", "source"))
    return rows.select("scenario_id", "display_name", "source", "source_order", F.element_at("source_patterns", F.col("source")).alias("pattern"), F.element_at("source_labels", F.col("source")).alias("label"))


def _toml_as_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for content in pdf["content"]:
            try:
                out.append(json.dumps(tomllib.loads(content.decode("utf-8")), default=str))
            except (UnicodeDecodeError, tomllib.TOMLDecodeError):
                out.append(None)
        yield pd.DataFrame({"value": out})


def file_inventory(spark: SparkSession, path: str, supported: tuple[str, ...] = (".txt", ".md", ".csv", ".html")) -> DataFrame:
    """All files below a path: suffix, source by folder, size, time and whether a reader exists. Contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return rows.select("path", suffix.alias("suffix"), T.source_from_path("path").alias("source"), "length", "modificationTime", suffix.isin(*supported).alias("supported"), T.stable_hash("path", "modificationTime", "length").alias("fingerprint"))


class _Page(HTMLParser):
    DROP = {"script", "style", "nav", "footer", "header", "noscript", "aside"}
    BREAK = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "tr", "section", "article", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.text, self.links, self.inside, self.in_title = "", [], [], 0, False

    def handle_starttag(self, tag, attrs):
        if tag in self.DROP:
            self.inside += 1
        if tag == "title":
            self.in_title = True
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)
        if tag in self.BREAK:
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in self.DROP:
            self.inside = max(0, self.inside - 1)
        if tag == "title":
            self.in_title = False
        if tag in self.BREAK:
            self.text.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.inside:
            self.text.append(data)


def read_html_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) → title, body text without boilerplate tags, and links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, html in zip(pdf["page_id"], pdf["html"], strict=True):
                p = _Page()
                p.feed(html or "")
                lines = [" ".join(x.split()) for x in "".join(p.text).split("\n")]
                out.append((i, p.title.strip(), "\n".join(x for x in lines if x), p.links))
            yield pd.DataFrame(out, columns=["page_id", "title", "text", "links"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, text string, links array<string>")


def read_control_table(spark: SparkSession, path: str, where: str | None = None, jdbc: dict | None = None, table: str | None = None) -> DataFrame:
    """A control table from Parquet, or by JDBC where options are given; the filter is pushed down."""
    rows = spark.read.format("jdbc").options(**jdbc, dbtable=table).load() if jdbc else spark.read.parquet(path)
    return rows.where(where) if where else rows


def append_changes(changes: DataFrame, path: str) -> None:
    """Appends (key, batch_id, op, payload) to a change log; nothing that is there is rewritten."""
    changes.select("key", "batch_id", "op", "payload").write.mode("append").parquet(path)


def current_view(log: DataFrame) -> DataFrame:
    """The latest payload of each key, without keys whose last change deletes. Replayed batches change nothing."""
    last = log.groupBy("key").agg(F.max_by(F.struct("op", "payload"), F.struct("batch_id", F.col("op"), F.coalesce("payload", F.lit("")))).alias("c"))
    return last.where("c.op <> 'delete'").select("key", "c.payload")


def write_graph(entities: DataFrame, relations: DataFrame, communities: DataFrame, path: str, kb_version: str) -> None:
    """Three tables partitioned by version; ids are hashes of the content, so a rebuild writes the same rows."""
    e = entities.withColumn("id", T.stable_hash(F.lit(kb_version), "name")).withColumn("description", T.truncate_utf8("description", 4096))
    r = relations.withColumn("id", T.stable_hash(F.lit(kb_version), "source", "target")).withColumn("label", F.when(F.length("label") > 32, "关联").otherwise(F.col("label")))
    c = communities.withColumn("id", T.stable_hash(F.lit(kb_version), "community"))
    for name, rows in (("entities", e), ("relations", r), ("communities", c)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}/kb_version={kb_version}")


def write_report(rows: DataFrame, path: str, kind: str) -> None:
    """Report rows as JSON, partitioned by kind and date."""
    rows.withColumn("report_type", F.lit(kind)).withColumn("report_date", F.current_date()).write.mode("append").partitionBy("report_type", "report_date").json(path)


def write_faq_csv(faq: DataFrame, path: str) -> None:
    faq.select("source", "question", "answer").write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')
