"""Dialogues rendered from the perspective of every participant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.shards import numbered
from tidecast.sources.tables import staged

PART_TURNS = 256
OVERLAP = 16
SYSTEM_ROLE = "system"
UNNAMED = "unknown"


def header(kind: Column | str) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.lit(kind) if isinstance(kind, str) else kind, F.lit("\n"))


def placed(messages: DataFrame, split_size: int) -> DataFrame:
    """Messages with `split`, their place in their part by `split_size`, and `last`, the part's highest split.

    Only parts of more than `split_size` messages are ordered: all of them together by ranges, so that a
    part of any size spreads over tasks.
    """
    sizes = messages.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > split_size)
    sizes = staged(sizes, "crowded")
    order = ["conv", "part", "turn", "role", "text"]
    ordered = messages.join(sizes.select("conv", "part"), ["conv", "part"], "left_semi").select(*order)
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = numbered(staged(ordered.withColumn("place", F.monotonically_increasing_id()), "ordered"), "number")
    starts = ranked.groupBy("conv", "part").agg(F.min("number").alias("start"))
    ranked = ranked.join(starts, ["conv", "part"]).join(sizes, ["conv", "part"]).select(
        *order,
        F.floor((F.col("number") - F.col("start")) / split_size).alias("split"),
        F.floor((F.col("n") - 1) / split_size).alias("last"),
    )
    none = F.lit(0).cast("long")
    small = messages.join(sizes.select("conv", "part"), ["conv", "part"], "left_anti")
    return small.select(*order, none.alias("split"), none.alias("last")).union(ranked)


def chat_perspectives(
    conversations: DataFrame, part_turns: int = PART_TURNS, overlap: int = OVERLAP, system_role: str = SYSTEM_ROLE
) -> DataFrame:
    """One row per participant and part of a conversation: conv_id, part, split, speaker, n_messages, text, masks.

    In a row's text the speaker is the assistant, all others are users named by their role, and system
    messages stay system messages. `masks` has the [start, end) code points to learn from: the speaker's
    own messages with their end marks. A part has `part_turns` turns by turn number, so a long dialogue is
    bounded samples instead of one huge row; a part of more than twice as many messages (many share a
    turn) is cut in order into rows of as many, numbered in `split`. Every participant of the conversation
    has a row for each, with empty masks where they are silent. A row after the first begins with the system
    messages of the first and the last `overlap` other messages of the row before it, if the part before has
    messages; these are not learned from again. Rows are as many as participants times parts.

    Messages are ordered by turn, then role, then text. A row that repeats another in these and conv_id
    is the same message. A null turn comes first, in part 0; a null or empty role is "unknown"; a null
    text is empty; null conv_ids form one conversation. Texts of any length are rendered whole. "<|" inside
    texts and names becomes "< |", so texts cannot imitate marks. A conversation with system messages only,
    and an empty table, give no rows. Other columns are ignored.
    """

    def clean(c: Column) -> Column:
        return F.replace(c, F.lit("<|"), F.lit("< |"))

    role = F.coalesce(F.nullif(F.col("role").cast("string"), F.lit("")), F.lit(UNNAMED))
    messages = conversations.select(
        F.struct("conv_id").alias("conv"),  # equal to its like with a null in it
        F.col("turn").cast("long").alias("turn"),
        clean(role).alias("role"),
        clean(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    ).distinct()
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(0)).cast("long")
    rows = placed(messages.withColumn("part", part), 2 * part_turns).groupBy("conv", "part", "split").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"), F.max("last").alias("last")
    )
    rows = staged(rows, "dialogue-parts")

    speakers = rows.select("conv", F.explode(F.array_distinct("messages.role")).alias("speaker"))
    speakers = speakers.filter(F.col("speaker") != system_role).distinct()
    systems = F.filter("messages", lambda m: m["role"] == system_role)
    others = F.filter("messages", lambda m: m["role"] != system_role)
    heads = rows.groupBy("conv").agg(F.min(F.struct("part", "split", systems.alias("systems"))).alias("head"))
    goes_on = F.col("split") < F.col("last")
    tails = rows.select(
        "conv",
        F.when(goes_on, F.col("part")).otherwise(F.col("part") + 1).alias("part"),
        F.when(goes_on, F.col("split") + 1).otherwise(0).alias("split"),
        F.slice(others, F.greatest(F.size(others) - overlap + 1, F.lit(1)), overlap).alias("tail"),
    )
    none = F.slice("messages", 1, 0)
    first = (F.col("part") == F.col("head.part")) & (F.col("split") == F.col("head.split"))
    carried = F.concat(F.when(first, none).otherwise(F.col("head.systems")), F.coalesce("tail", none))
    views = rows.join(tails, ["conv", "part", "split"], "left").join(heads, "conv").withColumn("carried", carried)
    views = views.select("conv", "part", "split", "carried", "messages").join(speakers, "conv")

    def rendered(m: Column, new: bool) -> Column:
        kind = (
            F.when(m["role"] == F.col("speaker"), F.lit("assistant"))
            .when(m["role"] == system_role, F.lit("system"))
            .otherwise(F.concat(F.lit("user name="), m["role"]))
        )
        return F.struct(
            (F.lit(new) & (m["role"] == F.col("speaker"))).alias("own"),
            F.concat(header(kind), m["text"], F.lit("<|im_end|>\n")).alias("text"),
        )

    segments = F.concat(
        F.transform("carried", lambda m: rendered(m, False)), F.transform("messages", lambda m: rendered(m, True))
    )
    views = views.select("conv.conv_id", "part", "split", "speaker", segments.alias("segments"))
    head = F.length(header("assistant"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, s: Column) -> Column:
        at = state["at"] + F.length(s["text"])
        span = F.struct((state["at"] + head).alias("start"), (at - 1).alias("end"))
        spans = F.when(s["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(at.alias("at"), spans.alias("spans"))

    return views.select(
        "conv_id",
        "part",
        "split",
        "speaker",
        F.size("segments").cast("long").alias("n_messages"),
        F.array_join("segments.text", "").alias("text"),
        F.aggregate("segments", start, add, lambda s: s["spans"]).alias("masks"),
    )
