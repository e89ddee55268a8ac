"""Chat formatting by multi-party perspective rotation.

Every participant of a dialogue gets a rendering of their own: there that speaker is the
assistant, the others are users who are named, and only the speaker's words carry a loss (the
mask). Speakers of the system kind set the scene in every rendering and take no part themselves.

A rendering is cut into rows of at most ``turns_per_row`` turns, so a conversation with a third of
all turns is many rows, never one group. Turns get their place by a range order over the whole
table (sequence.ordered), the first place of a conversation is one aggregate, and rows are then
groups of bounded size. Rows of one rendering, joined by ``part``, are the whole dialogue.

NULL conversation: one conversation of its own. NULL speaker: the name "unknown". NULL or empty
text: an empty message. Equal turns are ordered by speaker, then text; repeated rows stay, each a
message. A dialogue with system messages only has no rendering. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitloom.operators.sequence import SEQ, ordered

UNKNOWN = "unknown"
END = "<|end|>\n"


def _head(message: Column, speaker: Column) -> Column:
    who = message["who"]
    return (
        F.when(message["scene"], F.lit("<|system|>"))
        .when(who == speaker, F.lit("<|assistant|>"))
        .otherwise(F.concat(F.lit("<|user|>"), who, F.lit(": ")))
    )


def rotated(
    turns: DataFrame,
    *,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    system: tuple[str, ...] = ("system",),
    turns_per_row: int = 64,
) -> DataFrame:
    """(conversation, speaker, part, n_turns, text, spans): the spans are (start, length) in characters.

    A span covers a message of the assistant with its end mark: what the model has to write.
    """
    told = turns.select(
        F.col(f"`{conversation}`").alias("conv"),
        F.col(f"`{turn}`").alias("at"),
        F.coalesce(F.col(f"`{speaker}`"), F.lit(UNKNOWN)).alias("who"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("said"),
    ).withColumn("scene", F.col("who").isin(*system))
    # Rows equal in all four may stand in any order.
    placed = ordered(told, ["conv", "at", "who", "said"]).frame
    first = placed.groupBy("conv").agg(F.min(SEQ).alias("first")).withColumnRenamed("conv", "c")
    parts = placed.join(first, F.col("conv").eqNullSafe(F.col("c"))).withColumn(
        "part", F.floor((F.col(SEQ) - F.col("first")) / turns_per_row)
    )
    rows = parts.groupBy("conv", "part").agg(
        F.sort_array(F.collect_list(F.struct(SEQ, "who", "said", "scene"))).alias("messages")
    )
    speakers = (
        told.filter(~F.col("scene"))
        .select(F.col("conv").alias("c"), F.col("who").alias("speaker"))
        .distinct()
    )
    seen = rows.join(speakers, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    heads = F.transform("messages", lambda m: _head(m, F.col("speaker")))
    bodies = F.transform("messages", lambda m: F.concat(m["said"], F.lit(END)))
    mine = F.transform("messages", lambda m: ~m["scene"] & (m["who"] == F.col("speaker")))
    built = seen.select("conv", "speaker", "part", heads.alias("h"), bodies.alias("b"), mine.alias("m"))
    steps = F.arrays_zip("h", "b", "m")
    spans = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["h"]) + F.length(x["b"])).alias("at"),
            F.when(
                x["m"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct((acc["at"] + F.length(x["h"])).alias("start"), F.length(x["b"]).alias("length"))
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return built.select(
        F.col("conv").alias(conversation),
        "speaker",
        F.col("part").cast("long").alias("part"),
        F.size("h").cast("long").alias("n_turns"),
        F.array_join(F.transform(steps, lambda x: F.concat(x["h"], x["b"])), "").alias("text"),
        spans.alias("spans"),
    )
