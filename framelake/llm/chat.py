"""Multi-party perspective rotation of conversations, with DataFrame functions only.

Every participant of a conversation gets the dialogue with themselves as the assistant, the others as named users,
and a loss mask that is 1 on the assistant's turns alone.  Speakers in ``context_roles`` (system prompts) are context
in every perspective and never take one.  The result has one row per perspective and turn, so that a conversation of
any length is spread over tasks: joining a turn with the conversation's distinct participants is the only step, the
participants are pre-aggregated before the shuffle, and adaptive skew handling may split the turns of a hot
conversation.  Concatenating ``segment`` in the order of ``turn`` gives the rendered dialogue.  A ``<|`` within a text or a
name is rendered as ``< |``, so that no turn can forge a mark.

Nulls and edge cases: a null text is an empty turn; a null or empty role is the speaker ``unknown``; a null
conversation id is a conversation of its own (all such rows together); a null turn sorts first.  Repeated rows are
repeated turns.  A conversation of context roles alone has no perspective and no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORACLE = """
WITH t AS (SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT t.conv_id, p.perspective, t.turn, t.speaker, t.text,
  CASE WHEN t.speaker = 'system' THEN 'system' WHEN t.speaker = p.perspective THEN 'assistant' ELSE 'user' END AS chat_role
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, CASE WHEN chat_role = 'user' THEN '<|user name=' || replace(speaker, '<|', '< |') || '|>' ELSE '<|' || chat_role || '|>' END AS head FROM r)
SELECT conv_id, perspective, turn, speaker, chat_role, head || chr(10) || text || '<|end|>' || chr(10) AS segment,
  CAST(CASE WHEN chat_role = 'assistant' THEN 1 ELSE 0 END AS INTEGER) AS loss_mask,
  CAST(length(head) + 1 AS BIGINT) AS mask_start,
  CAST(CASE WHEN chat_role = 'assistant' THEN length(text) + 7 ELSE 0 END AS BIGINT) AS mask_length
FROM h
"""


def unforged(text: Column) -> Column:
    """The text without anything that starts a mark."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate_perspectives(turns: DataFrame, context_roles: Sequence[str] = ("system",)) -> DataFrame:
    """Rows (``conv_id``, ``perspective``, ``turn``, ``speaker``, ``chat_role``, ``segment``, ``loss_mask``, ``mask_start``,
    ``mask_length``): the mask covers that many code points of ``segment`` from ``mask_start``, the text and its end mark."""
    speaker = F.when(F.coalesce(F.col("role"), F.lit("")) == "", F.lit("unknown")).otherwise(F.col("role"))
    said = turns.select("conv_id", "turn", speaker.alias("speaker"), unforged(F.coalesce("text", F.lit(""))).alias("text"))
    own = said.select(F.col("conv_id").alias("__conv"), F.col("speaker").alias("perspective"))
    own = own.where(~F.col("perspective").isin(list(context_roles))).distinct()
    joined = said.join(own, F.col("conv_id").eqNullSafe(F.col("__conv")))
    role = F.when(F.col("speaker").isin(list(context_roles)), "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    head = F.when(F.col("chat_role") == "user", F.concat(F.lit("<|user name="), unforged(F.col("speaker")), F.lit("|>"))).otherwise(F.concat(F.lit("<|"), "chat_role", F.lit("|>")))
    mine = F.col("chat_role") == "assistant"
    return joined.withColumn("chat_role", role).withColumn("head", head).select(
        "conv_id", "perspective", "turn", "speaker", "chat_role",
        F.concat("head", F.lit("\n"), "text", F.lit("<|end|>\n")).alias("segment"),
        mine.cast("int").alias("loss_mask"),
        (F.length("head") + 1).cast("long").alias("mask_start"),
        F.when(mine, F.length("text") + 7).otherwise(0).cast("long").alias("mask_length"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 3 over the whole table of conversations."""
    return rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
