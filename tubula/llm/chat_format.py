r"""Prefix-target expansion of conversations, in DataFrame and SQL functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its own text is trainable.
A turn is written as `### <role>: <text> </turn>` and a line feed. Inside roles and texts a backslash becomes `\b`, `###`
becomes `\h`, `</turn>` becomes `\t` and, in roles, a colon becomes `\c`; as no other backslash is left, replacing the
codes, the backslash last, restores the text. Turns after the last assistant turn come as one more example without a
target, so that the examples hold the whole conversation.

Defined results: null texts and roles count as empty; turns go by (turn, role, text), nulls first, so that ties and repeated
rows have an order; a conversation without assistant turns has one example without a target; rows without a
conv_id are one conversation, as grouping has them; empty input gives no rows. Other columns, whatever their names, are not read.
A conversation's turns come together in one row, as each of its examples does; its output grows with the square of its replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CODES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_CODES = (*CODES, (":", "\\c"))
START, MID, END = "### ", ": ", " </turn>\n"
TARGET = "assistant"


def escaped(text: Column, codes=CODES) -> Column:
    for raw, code in codes:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column, codes=CODES) -> Column:
    for raw, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def examples(conversations: DataFrame, target: str = TARGET) -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start and loss_length in code points (0 and 0: no target)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def written(t: Column) -> Column:
        body = escaped(t["text"])
        head = F.concat(F.lit(START), escaped(t["role"], ROLE_CODES), F.lit(MID))
        return F.struct(F.concat(head, body, F.lit(END)).alias("s"), F.char_length(head).alias("head"), F.char_length(body).alias("body"), (t["role"] == target).alias("on"))

    turns = turns.select("conv_id", F.transform("ts", written).alias("ts"))
    ends = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: (i == F.size("ts")) | F.element_at("ts", i)["on"])
    each = turns.select("conv_id", "ts", F.posexplode(ends).alias("example", "n"))
    prefix = F.concat_ws("", F.transform(F.slice("ts", 1, F.col("n") - 1), lambda t: t["s"]))
    last = F.element_at("ts", F.col("n"))
    each = each.select("conv_id", "example", prefix.alias("prefix"), last.alias("last"))
    start = F.when(F.col("last.on"), F.char_length("prefix") + F.col("last.head")).otherwise(0)
    return each.select("conv_id", "example", F.concat("prefix", "last.s").alias("formatted"), start.alias("loss_start"), F.when(F.col("last.on"), F.col("last.body")).otherwise(0).alias("loss_length"))


def turns_of(formatted: Column) -> Column:
    """The array of struct(role, text) that a formatted example holds."""
    parts = F.filter(F.split(formatted, END), lambda p: p != "")

    def read(part: Column) -> Column:
        at = F.locate(MID, part)
        return F.struct(unescaped(part.substr(F.lit(len(START) + 1), at - len(START) - 1), ROLE_CODES).alias("role"), unescaped(part.substr(at + len(MID), F.char_length(part))).alias("text"))

    return F.transform(parts, read)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TARGET).alias("role"), F.lit(said).alias("text"))
    out = examples(rows.unionByName(extra))
    reply = unescaped(F.col("formatted").substr(F.col("loss_start") + 1, F.col("loss_length")))
    out = out.select("conv_id", "example", "formatted", reply.alias("reply"), F.char_length("formatted").cast("long").alias("chars"))
    # The longest example holds every turn; the others only add their replies.
    out = out.groupBy("conv_id").agg(F.max_by("formatted", "example").alias("whole"), F.sort_array(F.collect_list(F.struct("example", "reply"))).alias("replies"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_examples"))
    turns = turns_of(F.col("whole"))
    out = out.select("conv_id", turns.alias("turns"), F.concat_ws("", F.transform("replies", lambda r: r["reply"])).alias("loss"), "formatted_chars", "n_examples")
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
w AS (
  SELECT *, role = 'assistant' AS aimed, row_number() OVER o AS n, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    sum(14 + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c'))
           + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) + 1) OVER o AS upto
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (aimed), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (aimed), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (aimed OR n = n_turns) AS BIGINT) AS formatted_chars,
  count(*) FILTER (aimed OR n = n_turns) AS n_examples
FROM w GROUP BY conv_id
"""
QUERIES, ORACLES = {"op3_chat_format": op3_chat_format}, {"op3_chat_format": SQL}
