"""Multi-party chat formatting: every dialogue from each speaker's side.

For every participant (a role other than system) a conversation is rendered
with that speaker as assistant and the others as named users; system turns stay
system turns.  A rendering is kept as segments, one per turn, with the place of
each segment and of its trained part (the text of an assistant turn and its end
mark) in the rendered dialogue, so that no conversation has to fit in a row.
``dialogues`` joins the segments of conversations into one text.

Turns are ordered by turn number, then role and text (nulls first); a null text
is an empty turn, a null role is the participant ``unknown``; a null
conversation id is a conversation of its own.  Repeated rows are turns of their
own.  A conversation of system turns only has no participant and no rendering.

Places are running sums inside blocks of turns and over the blocks' totals, so
a conversation that holds a large share of all rows is many small windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
SYSTEM = "system"
END = "<|end|>\n"


def _heads(role: Column, side: Column) -> Column:
    return (
        F.when(role == SYSTEM, F.lit("<|system|>\n"))
        .when(role == side, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user|>"), role, F.lit("\n")))
    )


def segments(turns: DataFrame) -> DataFrame:
    """``conv_id, perspective, turn, segment, start, end, mask_start, mask_end,
    trained``; an untrained segment has an empty mask at its end."""
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    sides = rows.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    seen = rows.join(sides, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    head = _heads(F.col("role"), F.col("perspective"))
    seen = seen.select(
        "conv_id", "perspective", "turn", "role", "text", "copy",
        F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK).alias("block"),
        F.concat(head, F.col("text"), F.lit(END)).alias("segment"),
        F.length(head).cast("bigint").alias("n_head"),
        (F.col("role") == F.col("perspective")).alias("trained"),
    )
    size = F.length("segment").cast("bigint")
    totals = seen.groupBy("conv_id", "perspective", "block").agg(F.sum(size).alias("size"))
    ahead = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"),
        F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("before"),
    )
    order = (
        Window.partitionBy("conv_id", "perspective", "block")
        .orderBy("turn", "role", "text", "copy")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = seen.withColumn("inner", F.coalesce(F.sum(size).over(order), F.lit(0))).join(
        offsets,
        F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")),
    )
    start = F.col("before") + F.col("inner")
    end = start + size
    mask = F.when(F.col("trained"), start + F.col("n_head")).otherwise(end)
    return placed.select(
        "conv_id", "perspective", "turn", "segment", start.alias("start"), end.alias("end"),
        mask.alias("mask_start"), end.alias("mask_end"), "trained",
    )


def dialogues(segment_table: DataFrame) -> DataFrame:
    """Segments joined into one text per conversation and perspective, with the
    trained spans.  For conversations that fit in a row."""
    piece = F.struct("start", "segment", "mask_start", "mask_end", "trained")
    return (
        segment_table.groupBy("conv_id", "perspective")
        .agg(F.sort_array(F.collect_list(piece)).alias("s"))
        .select(
            "conv_id",
            "perspective",
            F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("text"),
            F.transform(
                F.filter("s", lambda x: x["trained"]),
                lambda x: F.struct(x["mask_start"].alias("start"), x["mask_end"].alias("end")),
            ).alias("masks"),
        )
    )
