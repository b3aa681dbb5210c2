"""Chat formatting: every participant's view of a multi-party dialogue. DataFrame functions only.

For each speaker of a conversation the whole dialogue is rendered with that speaker as the assistant and the others as
named users; the mask holds the spans of the assistant's turns, end mark included, which a trainer learns from. System
turns are rendered as such in every view and give no view of their own.

Turns stand in the order of their number (null first), then speaker, then text. A conversation is rendered in blocks of
``block_turns`` turns in that order, a row for each view and block, so that one conversation of very many turns is not
gathered in one place; short conversations have one block. Turns are numbered by running counts over blocks of the whole
table's order, so turns that repeat a number, or have none, fill blocks like any others. A view is its blocks' texts one
after the other; spans count characters of their own block.

Cases: a null role is the speaker ``unknown``; a null text is empty. Rows with null conv_id are one conversation. Repeated
rows are repeated turns. A conversation with system turns only has no participant and gives no row. Other columns are not
read, so their names can't clash. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wingspan.operators.windows import running_sums

END = "<|end|>\n"
ASSISTANT = "<|assistant|>\n"
SYSTEM = "<|system|>\n"


def views(turns: DataFrame, block_turns: int = 512, system_role: str = "system") -> DataFrame:
    """(conv_id, perspective, block, n_turns, text, mask) from rows (conv_id, turn, role, text).

    block counts from 0 in each conversation. mask: array of (start, end).
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = running_sums(rows, ["conv_id", "turn", "role", "text"], {"place": F.lit(1).cast("long")})
    first = rows.groupBy(F.col("conv_id").alias("of_conv")).agg(F.min("place").alias("first"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("of_conv")))
    rows = rows.withColumn("block", F.floor((F.col("place") - F.col("first")) / block_turns).cast("long")).drop("of_conv", "place", "first")
    user = lambda role: F.concat(F.lit("<|user name="), role, F.lit("|>\n"))
    others = F.when(F.col("role") == system_role, F.lit(SYSTEM)).otherwise(user(F.col("role")))
    size = (F.length(others) + F.length("text") + len(END)).cast("long")
    # where a turn begins if no turn is the assistant's, and how many turns of its speaker stand before it in the block
    before = lambda *keys: Window.partitionBy("conv_id", "block", *keys).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(size).over(before()), F.lit(0))).withColumn("nth", F.count("*").over(before("role")))
    blocks = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "start", "nth"))).alias("turns"))
    speakers = turns.select("conv_id", F.coalesce("role", F.lit("unknown")).alias("role")).filter(F.col("role") != system_role).groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("speakers"))
    speakers = speakers.withColumnRenamed("conv_id", "of_conv")
    seen = blocks.join(speakers, F.col("conv_id").eqNullSafe(F.col("of_conv"))).select(
        "conv_id", "block", "turns", F.explode("speakers").alias("perspective")
    )
    own = lambda t: t["role"] == F.col("perspective")
    head = lambda t: (
        F.when(own(t), F.lit(ASSISTANT)).when(t["role"] == system_role, F.lit(SYSTEM)).otherwise(user(t["role"]))
    )
    longer = F.lit(len(ASSISTANT)) - F.length(user(F.col("perspective")))  # by so much is each of the assistant's own turns
    begin = lambda t: t["start"] + t["nth"] * longer + len(ASSISTANT)
    mask = F.transform(
        F.filter("turns", own),
        lambda t: F.struct(begin(t).alias("start"), (begin(t) + F.length(t["text"]) + len(END) - 1).alias("end")),
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(END))), "")
    return seen.select("conv_id", "perspective", "block", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), mask.alias("mask"))


def spans_as_text(column: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")


# Rows of op3_chat_perspectives.
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1) // 512 AS BIGINT) AS block
  FROM conversations
), p AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'
), r AS (
  SELECT t.*, p.perspective, t.role = p.perspective AS own,
    CASE WHEN t.role = p.perspective THEN '<|assistant|>' || chr(10) WHEN t.role = 'system' THEN '<|system|>' || chr(10)
      ELSE '<|user name=' || t.role || '|>' || chr(10) END AS head,
    t.text || '<|end|>' || chr(10) AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), s AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, block
    ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS stop
  FROM r
)
SELECT conv_id, perspective, block, count(*) AS n_turns,
  string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text) AS text,
  coalesce(string_agg(CAST(stop - length(body) AS BIGINT) || '-' || CAST(stop - 1 AS BIGINT), ',' ORDER BY stop) FILTER (own), '') AS mask
FROM s GROUP BY conv_id, perspective, block
"""
