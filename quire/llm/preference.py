"""Preference formatting: the common turns of two conversations once as prompt, and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the chat format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) from rows of (conv_id, turn, role, text): an array of (role, text) in turn order.

    A null role is user, a null text empty; turns of equal number follow by role
    and text, null numbers come first; rows of a null conv_id are one conversation. A
    conversation is one training example and becomes one row.
    """
    rows = conversations.select("conv_id", F.struct(
        "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).alias("row"))
    ordered = F.sort_array(F.collect_list("row"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))


def with_rejected(conversations: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): the rejected one has, as its last reply, the reply before that one again (an empty one if there is none)."""
    replies = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == TRAINED_ROLE)
    rows = conversations.where(F.size("turns") > 0).withColumn("replies", replies)
    last = F.when(F.size("replies") > 0, F.element_at("replies", -1))
    earlier = F.when(F.size("replies") > 1, F.element_at("turns", F.element_at("replies", -2))["text"])
    worse = F.transform("turns", lambda t, i: F.struct(
        t["role"].alias("role"), F.when(i + 1 == F.col("last"), F.col("earlier")).otherwise(t["text"]).alias("text")
    ))
    rows = rows.select("conv_id", "turns", last.alias("last"), F.coalesce(earlier, F.lit("")).alias("earlier"))
    return rows.select("conv_id", F.col("turns").alias("chosen"), worse.alias("rejected"))


def _segments(part: Column) -> Column:
    """Rendered pieces of some turns, each with whether it is trained on: replies and their end are, headers and other turns are not."""
    text = F.transform(part, lambda t: F.array(
        F.struct(F.concat(F.lit(OPEN), F.replace(t["role"], F.lit("<|"), F.lit("< |")), F.lit("\n")).alias("text"), F.lit(False).alias("trained")),
        F.struct(F.concat(F.replace(t["text"], F.lit("<|"), F.lit("< |")), F.lit(CLOSE)).alias("text"), (t["role"] == TRAINED_ROLE).alias("trained")),
    ))
    return F.flatten(text)


def joined(segments: Column, trained_only: bool = False) -> Column:
    """The text of segments, or of the trained ones."""
    if trained_only:
        segments = F.filter(segments, lambda s: s["trained"])
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """All columns but chosen and rejected (arrays of (role, text)), n_prompt_turns, prompt, and chosen and rejected as segments.

    The prompt is the longest common prefix of turns (equal role and text),
    rendered once; a completion is the rest of its side as segments (text,
    trained). Null sides count as empty; equal sides give two empty completions. Format
    marks inside texts are broken up ("<|" becomes "< |"), so texts cannot open turns. Columns
    named like the results are replaced.
    """
    kept = [c for c in pairs.columns if c not in ("chosen", "rejected", "n_prompt_turns", "prompt")]
    none = F.array().cast("array<struct<role:string,text:string>>")
    rows = pairs.select(*kept, F.coalesce("chosen", none).alias("_c"), F.coalesce("rejected", none).alias("_r"))
    shorter = F.least(F.size("_c"), F.size("_r"))
    places = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda i: ~F.element_at("_c", i).eqNullSafe(F.element_at("_r", i)))
    common = F.when(F.size(differ) > 0, F.element_at(differ, 1) - 1).otherwise(shorter)
    rows = rows.withColumn("_n", common)
    rest = lambda side: _segments(F.slice(side, F.col("_n") + 1, F.size(side)))
    return rows.select(
        *kept, F.col("_n").alias("n_prompt_turns"), joined(_segments(F.slice("_c", F.lit(1), F.col("_n")))).alias("prompt"),
        rest("_c").alias("chosen"), rest("_r").alias("rejected"),
    )


def preference_examples(conversations: DataFrame) -> DataFrame:
    """Preference examples of every conversation of the table."""
    return format_preferences(with_rejected(turns(conversations)))
