"""Chat formatting by multi-party perspective rotation (dealt operator 9); DataFrame functions only.

A conversation is rendered once for every participant (every speaker but ``system``): that speaker is
the assistant, all others are users with their names, system turns stay system turns.  The result has
a row per perspective and turn: the rendered piece, its place [start_char, end_char) in the rendered
dialogue, and the place of what is trained on, [mask_start, mask_end), null for turns of others.
Pieces in the order of ``start_char`` are the dialogue, so no conversation is collected.  The places
are sums over earlier turns, taken in two levels (stretches of ``STRETCH`` turn numbers, then
stretches of a conversation), so that a conversation with a third of all turns is split as well.

Defined cases: a null or empty speaker is called ``unknown`` and is no participant; a null text is
empty; a conversation of only system or unknown turns has no rows; a null conversation id is one
conversation; a null turn comes first; equal turn numbers are ordered by speaker, then text, and
repeated rows are all kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm import blocks as B

SYSTEM, UNKNOWN = "system", "unknown"
STRETCH = 256
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
COLUMNS = ["conv_id", "perspective", "turn", "speaker", "role", "rendered", "start_char", "end_char", "mask_start", "mask_end"]


def _header(role: Column, speaker: Column) -> Column:
    named = F.when(role == "user", F.concat(F.lit(" name="), speaker)).otherwise(F.lit(""))
    return F.concat(F.lit(BEGIN), role, named, F.lit("\n"))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", stretch: int = STRETCH) -> DataFrame:
    said = B.chosen(turns, conv, turn, role, text).select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.when(F.col(f"`{role}`") != "", F.col(f"`{role}`")).otherwise(F.lit(UNKNOWN)).alias("speaker"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    people = said.where(~F.col("speaker").isin(SYSTEM, UNKNOWN)).select(F.col("conv_id").alias("__conv"), F.col("speaker").alias("perspective")).distinct()
    views = said.join(people, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    own = F.col("speaker") == F.col("perspective")
    views = views.withColumn("role", F.when(own, F.lit("assistant")).when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).otherwise(F.lit("user")))
    views = views.withColumn("__header", F.length(_header(F.col("role"), F.col("speaker"))))
    views = views.withColumn("rendered", F.concat(_header(F.col("role"), F.col("speaker")), "text", F.lit(END)))
    views = views.withColumn("__stretch", F.floor(F.col("turn") / stretch)).withColumn("__size", F.length("rendered").cast("long"))

    keys = ["conv_id", "perspective", "__stretch"]
    sums = views.groupBy(keys).agg(F.sum("__size").alias("__sum"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(keys).orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    views = views.withColumn("__local", F.coalesce(F.sum("__size").over(within), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = views.join(sums, same[0] & same[1] & same[2])
    out = out.withColumn("start_char", F.col("__base") + F.col("__local"))
    out = out.withColumn("end_char", F.col("start_char") + F.col("__size"))
    trained = F.col("role") == "assistant"
    out = out.withColumn("mask_start", F.when(trained, F.col("start_char") + F.col("__header")))
    out = out.withColumn("mask_end", F.when(trained, F.col("end_char") - 1))  # the end mark is trained on, its line feed is not
    return out.select(COLUMNS)


def dialogues(rotated: DataFrame) -> DataFrame:
    """Whole dialogues (conv_id, perspective, text, masks), for conversations that fit a row."""
    piece = F.struct("start_char", "rendered", "mask_start", "mask_end")
    rows = rotated.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    masks = F.transform(F.filter("p", lambda x: x["mask_start"].isNotNull()), lambda x: F.struct(x["mask_start"], x["mask_end"]))
    return rows.select("conv_id", "perspective", F.array_join(F.transform("p", lambda x: x["rendered"]), "").alias("text"), masks.alias("masks"))
