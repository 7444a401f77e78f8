"""Multi-party dialogues rendered from the side of every participant.

For each speaker of a dialogue the whole dialogue is written once with that speaker
as the assistant and everybody else as a named user; ``mask`` holds the character
spans ``start:end`` that a model should learn, which are the speaker's own turns.
System turns stay system turns and are never learnt.

A dialogue longer than ``chunk_turns`` is cut into consecutive chunks of that many
turns, so no row grows with the longest dialogue; every chunk is rendered for every
speaker of the whole dialogue, with an empty mask where the speaker is silent. Turn ranks come from counts per block of turn
numbers, so a dialogue that holds a third of all rows is not handed to one task.

Defined results: turns go by turn number (null first), then role and text; a null
text is an empty turn, a null role is ``unknown``, rows with a null conversation
form one dialogue; repeated rows are repeated turns; control marks inside a text are
defused by a backslash; in roles a space is written ``\\s``, a line break ``\\n`` and a
backslash twice, so that no two speakers become one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CHUNK_TURNS = 64
_BLOCK = 4096


def ranked_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, role, text, rank``: ranks from 0 inside each dialogue."""
    rows = turns.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / _BLOCK), F.lit(-(1 << 62))).cast("long").alias("block"))
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block")
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("block").alias("b"),
                         (F.sum("n").over(before) - F.col("n")).alias("offset"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    return rows.join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select(
        "conv_id", "role", "text", (F.col("offset") + F.row_number().over(inside) - 1).alias("rank"))


def _name(role: Column) -> Column:
    """A role as one word; different roles stay different."""
    for raw, mark in (("\\", "\\\\"), ("<|im_", "<\\|im_"), (" ", "\\s"), ("\n", "\\n")):
        role = F.replace(role, F.lit(raw), F.lit(mark))
    return role


def _header(role: Column, speaker: Column) -> Column:
    return F.when(role == "system", F.lit("system")).when(role == speaker, F.lit("assistant")).otherwise(
        F.concat(F.lit("user name="), role))


def perspectives(turns: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """One row per dialogue chunk and speaker: ``conv_id, chunk, speaker, n_turns, text, mask``."""
    safe = lambda c: F.replace(F.replace(c, F.lit("<|im_"), F.lit("<\\|im_")), F.lit("\r\n"), F.lit("\n"))
    rows = ranked_turns(turns).withColumns({
        "chunk": F.floor(F.col("rank") / chunk_turns).cast("long"),
        "text": safe(F.col("text")),
        "role": _name(F.col("role"))})
    chunks = rows.groupBy("conv_id", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("rank", "role", "text"))).alias("turns"))
    # Speakers of the whole dialogue: few rows leave the partial aggregate.
    speakers = turns.select(
        F.col("conv_id").alias("c"),
        _name(F.coalesce(F.col("role").cast("string"), F.lit("unknown"))).alias("speaker"),
    ).filter("speaker <> 'system'").distinct()
    each = chunks.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", "chunk", "turns", "speaker")
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(OPEN), _header(t["role"], F.col("speaker")), F.lit("\n")).alias("head"),
        t["text"].alias("text"), (t["role"] == F.col("speaker")).alias("learn")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, part: Column) -> Column:
        first = state["at"] + F.length(part["head"])
        last = first + F.length(part["text"])
        return F.struct(
            (last + len(CLOSE)).alias("at"),
            F.when(part["learn"], F.concat(state["spans"], F.array(F.concat_ws(":", first, last))))
            .otherwise(state["spans"]).alias("spans"))

    return each.select("conv_id", "chunk", "speaker", "turns", parts.alias("parts")).select(
        "conv_id", "chunk", "speaker", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(CLOSE))), "").alias("text"),
        F.array_join(F.aggregate("parts", start, step, lambda s: s["spans"]), ",").alias("mask"))
