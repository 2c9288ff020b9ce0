"""Chat formatting: one rendering of a dialogue for each of its participants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finweave.llm.shared import materialise, prefix_sum, spread_join

SYSTEM, NOBODY, END = "system", "unknown", "<|end|>\n"
#: Signs of a name that could end or open a marker, and how a header writes them.
NAME_SIGNS = (("%", "%25"), ("|", "%7C"), ("<", "%3C"), (">", "%3E"), ("\n", "%0A"), ("\r", "%0D"))


def header_name(speaker: Column) -> Column:
    """A speaker as a header shows it: no two speakers alike, no marker within."""
    return reduce(lambda c, sign: F.replace(c, F.lit(sign[0]), F.lit(sign[1])), NAME_SIGNS, speaker)


def rotations(turns: DataFrame) -> DataFrame:
    """Every turn as each participant of its conversation sees it.

    ``turns``: conv_id, turn, role, text. Participants are the distinct roles
    of a conversation but ``system``; a null role is the speaker ``unknown``.
    For each perspective its speaker is the assistant and learned from
    (mask 1), the system stays the system, all others are users by name (mask
    0). Returns conv_id, perspective, turn, as_role (assistant, system or user),
    speaker, rendered, mask, start and stop: ``rendered`` in order of start is
    the whole dialogue, [start, stop) its code points there; the first
    head_chars of it are the header, which is never learned from.

    Order is by turn (nulls first), then a hash of the text, speaker and text,
    so ties and repeated rows have a fixed order. Offsets are sums over blocks
    of turns, so a conversation with a third of all rows is no single task.
    Null texts are empty. ``<|`` in a text becomes ``< |``: no text can play a
    marker. Conversations of the system alone, null conv_ids with nobody in
    them and empty tables give no rows.

    Names are data as well: a header writes the signs of a speaker's name that
    could end or open a marker as ``%`` and two digits; the column ``speaker``
    has the name itself. A conversation with many of all turns meets its
    participants in as many tasks as its size asks for.
    """
    said = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(NOBODY)).alias("speaker"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    people = said.filter(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    seen = spread_join(materialise(said, "said"), people, ["conv_id"])
    mine = F.col("speaker") == F.col("perspective")
    as_role = F.when(mine, "assistant").when(F.col("speaker") == SYSTEM, "system").otherwise("user")
    head = F.when(as_role == "user", F.concat(F.lit("<|user name="), header_name(F.col("speaker")), F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), as_role, F.lit("|>\n")))
    seen = seen.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        as_role.alias("as_role"),
        F.concat(head, "text", F.lit(END)).alias("rendered"),
        F.length(head).cast("long").alias("head_chars"),
        mine.cast("int").alias("mask"),
    )
    seen = materialise(seen, "turns").withColumns({"chars": F.length("rendered").cast("long"), "block": F.floor(F.col("turn") / 256), "tie": F.substring(F.md5("rendered"), 1, 2)})
    placed = prefix_sum(seen, ["conv_id", "perspective"], ["block", "turn", "tie"], [F.col("speaker"), F.col("rendered")], "chars", "start")
    return placed.select("conv_id", "perspective", "turn", "as_role", "speaker", "rendered", "head_chars", "mask", "start", (F.col("start") + F.col("chars")).alias("stop"))


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'
), seen AS (
  SELECT s.conv_id, perspective, turn, speaker, text,
         CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS as_role
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), headed AS (
  SELECT *, CASE WHEN as_role = 'user' THEN '<|user name=' || replace(replace(replace(replace(replace(replace(speaker, '%', '%25'), '|', '%7C'), '<', '%3C'), '>', '%3E'), chr(10), '%0A'), chr(13), '%0D') || '|>' ELSE '<|' || as_role || '|>' END || chr(10) AS head FROM seen
), whole AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM headed
), placed AS (
  SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective
      ORDER BY turn NULLS FIRST, substr(md5(rendered), 1, 2), speaker, rendered ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM whole
)
SELECT conv_id, perspective, turn, as_role, speaker, rendered, CAST(length(head) AS BIGINT) AS head_chars,
       CAST(CASE WHEN as_role = 'assistant' THEN 1 ELSE 0 END AS INTEGER) AS mask,
       CAST(start AS BIGINT) AS start, CAST(start + length(rendered) AS BIGINT) AS stop
FROM placed
"""
