"""Operator 5: chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the turns before it are context, and its text alone is trainable.
Turns after the last assistant turn make one more example without a trainable span, so the output holds the whole
conversation. The template marks a turn as ``<|role|>\\n text <|end|>\\n``. Inside roles and texts a backslash is
doubled and ``<|`` becomes ``<\\|``, so no text can hold a mark, and reading takes one backslash away again.

Turns of a conversation are gathered once, sorted by turn; an example is built from a slice of them. As every target
takes all turns before it along, the output grows with the square of a conversation's turns; that is the method, and
each example is a row of its own. Rows without a conversation id are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _lone() -> Column:
    """A number of its own for each row without a conversation, so that no group gathers them; null for the others."""
    return F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant") -> DataFrame:
    """Rows by turn → (conv_id, example, formatted, loss_start, loss_end, lone), spans in code points, end exclusive.

    ``example`` is the place of the example's last turn; loss_start = loss_end marks an example without a trainable
    span. Null and empty texts and roles are empty; turns that repeat a number follow each other by role and text, and
    equal rows are turns each; null turns come first; a row with a null conversation id is a conversation of its own,
    for nothing says which belong together, and such rows may be many; texts of any length are whole; other columns
    are not read, whatever their names; an empty table gives no example. ``lone`` tells rows without a conversation
    apart and is null for the others.
    """
    turns = rows.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    one = turns.withColumn("lone", _lone()).groupBy("conv_id", "lone").agg(F.sort_array(F.collect_list("t")).alias("t"))
    head = lambda x: F.concat(F.lit("<|"), escaped(x["role"]), F.lit("|>\n"))
    one = one.select("conv_id", "lone", F.transform("t", lambda x: F.struct((x["role"] == target).alias("trained"), head(x).alias("head"), escaped(x["text"]).alias("text"))).alias("t"))
    # a target's place, or the last place where turns follow the last target
    places = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.get("t", i)["trained"] | (i == F.size("t") - 1))
    made = one.select("conv_id", "lone", "t", F.explode(places).alias("example"))
    context = F.array_join(F.transform(F.slice("t", 1, F.col("example")), lambda x: F.concat(x["head"], x["text"], F.lit("<|end|>\n"))), "")
    last = F.get("t", F.col("example"))
    made = made.select("conv_id", "lone", F.col("example").cast("long").alias("example"), F.concat(context, last["head"]).alias("before"), last.alias("last"))
    start = F.length("before").cast("long")
    return made.select(
        "conv_id", "example", F.concat("before", "last.text", F.lit("<|end|>\n")).alias("formatted"), start.alias("loss_start"),
        F.when(F.col("last.trained"), start + F.length("last.text")).otherwise(start).alias("loss_end"), "lone",
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted example, unescaped."""
    parts = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(
        unescaped(F.regexp_extract(x, r"(?s)^<\|(.*?)\|>\n", 1)).alias("role"), unescaped(F.regexp_replace(x, r"(?s)^<\|.*?\|>\n", "")).alias("text")))


def chat_digests(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples say, read back from them: turns from the longest, texts under the masks. An
    example without a conversation id is one of its own."""
    loss = unescaped(F.substring("formatted", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    rows = examples.select("conv_id", "lone", "example", F.struct("example", "formatted").alias("whole"), F.struct("example", loss.alias("loss")).alias("loss"), F.length("formatted").cast("long").alias("n"))
    one = rows.groupBy("conv_id", "lone").agg(F.max("whole")["formatted"].alias("formatted"), F.sort_array(F.collect_list("loss")).alias("loss"), F.sum("n").alias("formatted_chars"))
    text = F.array_join(F.transform("loss", lambda x: x["loss"]), "")
    said = let(read_turns(F.col("formatted")), lambda t: F.struct(F.size(t).cast("long").alias("n"), F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("s")))
    return one.select("conv_id", said.alias("said"), text.alias("text"), "formatted_chars").select(
        "conv_id", F.col("said.n").alias("n_turns"), F.sha2("said.s", 256).alias("turns_sha256"),
        F.length("text").cast("long").alias("loss_chars"), F.sha2("text", 256).alias("loss_sha256"), "formatted_chars",
    )


#: The conversation that the contract adds: its texts hold a control string of another template and a backslash.
EXTRA = r"\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"))
    return chat_digests(format_chats(rows.unionByName(extra)))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(role, '\', '\\'), '<|', '<\|') AS r, replace(replace(text, '\', '\\'), '<|', '<\|') AS t FROM c),
s AS (SELECT *, sum(length(r) + length(t) + 13) OVER w AS upto, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS m
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR n = m)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
