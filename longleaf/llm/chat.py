"""Chat formatting: every dialogue once from the perspective of each of its participants.

In a rendering the chosen speaker is the assistant, all others are users with their names, and
system turns stay system turns.  The mask lists the spans of the assistant's words, in characters
from 0, end exclusive.  Only DataFrame functions are used.

A dialogue is rendered in parts of ``part_turns`` turn numbers, and a part in pieces of ``piece_turns``
turns (one, unless turn numbers repeat), so no cell holds an endless dialogue; texts of its parts and
pieces, in order, joined, are the dialogue, and spans count from the piece's start.

Cases: turns are ordered by turn number (null first), speaker and text, so ties and repeated rows
have a defined order and all are rendered; a null text is empty and gets an empty span; a null
speaker is ``unknown``; a row without a conversation id is a dialogue of its own; a dialogue
without participants (system turns only) gives no rows; very long texts are rendered whole; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The markers of the rendered format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _head(speaker: Column, chosen: Column) -> Column:
    role = F.when(speaker == "system", F.lit("system")).when(speaker == chosen, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), speaker))
    return F.concat(F.lit(OPEN), role, F.lit("\n"))


def perspectives(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", part_turns: int = 256, piece_turns: int = 1024) -> DataFrame:
    """conv_id, part, piece, perspective, n_turns, rendered, mask (array of start and stop)."""
    speaker = F.coalesce(F.col(speaker_col), F.lit("unknown"))
    turns = df.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id()).alias("lone"),
        F.coalesce(F.floor(F.col(turn_col).cast("long") / part_turns), F.lit(0)).cast("long").alias("part"),
        F.struct(F.col(turn_col).cast("long").alias("turn"), speaker.alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("said"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id", "lone", "part").orderBy("said"))
    turns = turns.withColumn("piece", F.floor((place - 1) / piece_turns).cast("long"))
    dialogues = turns.groupBy("conv_id", "lone", "part", "piece").agg(F.sort_array(F.collect_list("said")).alias("said"), F.array_sort(F.collect_set("said.speaker")).alias("speakers"))
    named = dialogues.select("conv_id", "lone", F.explode("speakers").alias("perspective")).where("perspective <> 'system'").distinct()
    each = dialogues.alias("d").join(named.alias("n"), F.col("d.conv_id").eqNullSafe(F.col("n.conv_id")) & F.col("d.lone").eqNullSafe(F.col("n.lone"))).select("d.conv_id", "d.part", "d.piece", "n.perspective", "d.said")
    chosen = F.col("perspective")
    pieces = F.transform("said", lambda s: F.struct(_head(s["speaker"], chosen).alias("head"), s["text"].alias("text"), ((s["speaker"] == chosen) & (s["speaker"] != "system")).alias("own")))
    each = each.select("conv_id", "part", "piece", "perspective", F.size("said").alias("n_turns"), pieces.alias("pieces"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["head"])
        stop = start + F.length(p["text"])
        span = F.struct(start.alias("start"), stop.alias("stop"))
        return F.struct((stop + len(CLOSE)).alias("at"), F.when(p["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    rendered = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], F.lit(CLOSE))), "")
    return each.select("conv_id", "part", "piece", "perspective", "n_turns", rendered.alias("rendered"), F.aggregate("pieces", zero, step, lambda s: s["spans"]).alias("mask"))


#: The same in DuckDB, with the mask as text.
ORACLE = f"""
WITH r AS (
  SELECT conv_id, coalesce(floor(turn / 256), 0)::BIGINT AS part, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, speaker, text) AS k FROM r
), who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
p AS (
  SELECT t.conv_id, t.part, (t.k - 1) // 1024 AS piece, w.perspective, t.k, t.text, t.speaker = w.perspective AS own,
         '{OPEN}' || CASE WHEN t.speaker = 'system' THEN 'system' WHEN t.speaker = w.perspective THEN 'assistant' ELSE 'user name=' || t.speaker END || chr(10) AS head
  FROM t JOIN who w USING (conv_id)
), q AS (
  SELECT *, sum(length(head) + length(text) + {len(CLOSE)}) OVER (PARTITION BY conv_id, perspective, part, piece ORDER BY k) - length(text) - {len(CLOSE)} AS start FROM p
)
SELECT conv_id, part, piece, perspective, count(*)::INT AS n_turns,
       string_agg(head || text || '{CLOSE[:-1]}' || chr(10), '' ORDER BY k) AS rendered,
       coalesce(string_agg(start::BIGINT || '-' || (start + length(text))::BIGINT, ',' ORDER BY k) FILTER (WHERE own), '') AS mask
FROM q GROUP BY conv_id, part, piece, perspective
"""
