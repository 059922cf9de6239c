"""Chat formatting: every dialogue seen by each of its participants in turn.

For each participant the dialogue is rendered once more: that speaker becomes
the assistant, whose words are learnt; all others are users with their names,
whose words are masked. System turns stay system turns in every view.

A view is kept as one row per turn, in order, with the turn's rendered text and
the part of it that is learnt. So a dialogue of any length is never gathered in
one task; ``start_char`` says where a turn stands in its view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn",
           speaker: str = "role", text: str = "text") -> DataFrame:
    """One row per dialogue, view and turn.

    Columns: ``conv_id``, ``perspective`` (the participant who is the
    assistant), ``turn``, ``role``, ``name`` (of other speakers, else null),
    ``rendered``, ``mask_start`` and ``mask_length`` in characters of
    ``rendered``: the learnt part, length 0 in masked turns.

    Null speakers take part as ``unknown``; a null text is empty. Turns of a
    null dialogue are rendered within that dialogue of their own. Repeated rows
    are repeated in every view. A dialogue of system turns alone has no view.
    Other columns of the input are left out.
    """
    said = turns.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    people = said.filter(F.col("speaker") != SYSTEM).select(
        F.col("conv_id").alias("view_conv"), F.col("speaker").alias("perspective")
    ).distinct()
    views = said.join(people, said["conv_id"].eqNullSafe(people["view_conv"]))
    learnt = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(learnt, "assistant").otherwise("user")
    views = views.withColumns(
        {"role": role, "name": F.when(role == "user", F.col("speaker"))}
    )
    head = F.concat(
        F.lit(OPEN), F.col("role"), F.when(F.col("name").isNull(), "").otherwise(F.concat(F.lit(" name="), "name")), F.lit("\n")
    )
    # What is learnt is the text and its end mark, not the head.
    return views.withColumn("head", head).select(
        "conv_id",
        "perspective",
        "turn",
        "role",
        "name",
        F.concat("head", "text", F.lit(CLOSE)).alias("rendered"),
        F.length("head").cast("long").alias("mask_start"),
        F.when(learnt, F.length("text") + len(CLOSE)).otherwise(0).cast("long").alias("mask_length"),
    )


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP8_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
views AS (
  SELECT s.*, p.perspective,
    CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
),
heads AS (
  SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
    '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head
  FROM views
)
SELECT conv_id, perspective, turn, role, name, head || text || '<|im_end|>' || chr(10) AS rendered,
  length(head)::BIGINT AS mask_start,
  (CASE WHEN speaker = perspective THEN length(text) + 11 ELSE 0 END)::BIGINT AS mask_length
FROM heads
"""
