"""Perspective rotation of dialogues with several parties; DataFrame functions only.

For every participant of a conversation, the dialogue is rendered with that speaker as the assistant and everyone
else as a named user; system turns stay system turns.  A loss mask marks what the assistant says, with its end
mark.  Turns are gathered in parts of `PART` turn numbers, so that a very long conversation is many rows; the parts of a
perspective, in order, are the whole dialogue.  A part is bounded where turn numbers are: rows that share one number,
or have none, stay in one part.

Defined results: a null role is the speaker "unknown"; null text is empty; a null turn comes first, in part 0; rows
that repeat exactly are one turn; ties of a turn are ordered by role, then text; a null conversation id is one
conversation; a conversation of system turns alone has no perspective; other columns aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 128
END = "<|end|>"


def _head(role: Column, perspective: Column) -> Column:
    named = F.concat(F.lit("<|user name="), role, F.lit("|>\n"))
    return F.when(role == "system", F.lit("<|system|>\n")).when(role == perspective, F.lit("<|assistant|>\n")).otherwise(named)


def rotated(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, part, n_turns, n_target_turns, text, masks.

    masks lists the spans of text to be learned as start:length, in characters from 0 on.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    speakers = turns.filter("role <> 'system'").select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct()
    part = F.coalesce(F.floor(F.col("turn") / PART), F.lit(0)).cast("long")
    gathered = turns.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # few rows a conversation; AQE splits the parts of a very long one
    both = gathered.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    segments = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(_head(t["role"], F.col("perspective")), t["text"], F.lit(END + "\n")).alias("segment"),
            F.char_length(_head(t["role"], F.col("perspective"))).alias("head"),
            (F.char_length(t["text"]) + len(END)).alias("said"),
            (t["role"] == F.col("perspective")).alias("target"),
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        span = F.concat_ws(":", (acc["at"] + s["head"]).cast("string"), s["said"].cast("string"))
        return F.struct((acc["at"] + F.char_length(s["segment"])).alias("at"), F.when(s["target"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    shown = both.withColumn("segments", segments)
    return shown.select(
        "conv_id",
        "perspective",
        "part",
        F.size("segments").cast("long").alias("n_turns"),
        F.size(F.filter("segments", lambda s: s["target"])).cast("long").alias("n_target_turns"),
        F.array_join(F.col("segments.segment"), "").alias("text"),
        F.array_join(F.aggregate("segments", start, step)["spans"], ",").alias("masks"),
    )


SQL = f"""
WITH m AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS said FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM m WHERE role <> 'system'),
h AS (
    SELECT m.conv_id, perspective, coalesce(CAST(floor(turn / {PART}.0) AS BIGINT), 0) AS part, turn, role, said, role = perspective AS target,
        CASE WHEN role = 'system' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>' ELSE '<|user name=' || role || '|>' END || chr(10) AS head
    FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, head || said || '{END}' || chr(10) AS segment FROM h),
a AS (
    SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
    FROM s)
SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (WHERE target) AS n_target_turns,
    string_agg(segment, '' ORDER BY turn NULLS FIRST, role, said) AS text,
    coalesce(string_agg(CAST(pos + length(head) AS VARCHAR) || ':' || CAST(length(said) + {len(END)} AS VARCHAR), ',' ORDER BY turn NULLS FIRST, role, said) FILTER (WHERE target), '') AS masks
FROM a GROUP BY conv_id, perspective, part"""
