"""From nested live-chat exports to a flat, deduplicated, numbered comment lake."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from murmullo.functions import chat
from murmullo.functions.text import clean_lake_text, text_or_empty
from murmullo.session import materialize

# Renderer of each message type, in order of precedence, and the dedup key.
RENDERERS = {
    "text": "liveChatTextMessageRenderer",
    "superchat": "liveChatPaidMessageRenderer",
    "supersticker": "liveChatPaidStickerRenderer",
    "membership": "liveChatMembershipItemRenderer",
}
PAID_TYPES = ("superchat", "supersticker")
DEDUP_KEYS = ("video_id", "timestamp_usec", "author_channel_id", "message", "message_type", "purchase_text")


def explode_actions(lines: DataFrame) -> DataFrame:
    """One row per chat action of each export line; position kept for ordering."""
    kept = [c for c in lines.columns if c != "replayChatItemAction"]
    return (
        lines.select(
            *kept,
            F.col("replayChatItemAction.videoOffsetTimeMsec").alias("video_offset_msec"),
            F.posexplode("replayChatItemAction.actions").alias("action_order", "_action"),
        )
        .withColumn("item", F.col("_action.addChatItemAction.item"))
        .drop("_action")
    )


def _message(kind: str, renderer: Column) -> Column:
    body = chat.runs_to_text(renderer["message"]["runs"])
    if kind == "supersticker":
        return clean_lake_text(renderer["sticker"]["accessibility"]["accessibilityData"]["label"])
    if kind == "membership":
        header = chat.runs_to_text(renderer["headerSubtext"]["runs"])
        return clean_lake_text(F.concat_ws(" ", F.coalesce(header, F.lit("")), F.coalesce(body, F.lit(""))))
    return F.coalesce(body, F.lit(""))


def _row(kind: str, renderer: Column) -> Column:
    paid = renderer["purchaseAmountText"]["simpleText"] if kind in PAID_TYPES else F.lit("")
    return F.struct(
        F.lit(kind).alias("message_type"),
        text_or_empty(renderer["timestampText"]["simpleText"]).alias("timestamp_text"),
        text_or_empty(renderer["timestampUsec"]).alias("timestamp_usec"),
        text_or_empty(renderer["authorName"]["simpleText"]).alias("author"),
        text_or_empty(renderer["authorExternalChannelId"]).alias("author_channel_id"),
        chat.badges(renderer["authorBadges"]).alias("badges"),
        text_or_empty(paid).alias("purchase_text"),
        _message(kind, renderer).alias("message"),
    )


def normalize_renderer(actions: DataFrame) -> DataFrame:
    """The four known renderers as one row shape; other items are dropped."""
    rows = [F.when(F.col("item")[name].isNotNull(), _row(kind, F.col("item")[name])) for kind, name in RENDERERS.items()]
    shaped = actions.withColumn("_row", F.coalesce(*rows)).where(F.col("_row").isNotNull())
    return shaped.select(
        *[c for c in actions.columns if c not in ("item", "video_offset_msec")],
        text_or_empty(F.col("video_offset_msec")).alias("video_offset_msec"),
        "_row.*",
    ).withColumn("message_length", F.length("message"))


def keep_messages(comments: DataFrame) -> DataFrame:
    """Short text messages go unless listed; paid and membership messages always stay."""
    return comments.where((F.col("message_type") != "text") | chat.is_worth_keeping(F.col("message")))


def dedup_comments(comments: DataFrame, order: Sequence[str], keys: Sequence[str] = DEDUP_KEYS) -> DataFrame:
    """First row of every key in the given order.

    ``row_number() = 1`` lets Spark drop all but one row per key in each task before the shuffle
    (WindowGroupLimit), so a key with very many copies does not overload one task.
    """
    ranked = comments.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def flatten_live_chat(lines: DataFrame) -> DataFrame:
    """Export lines to the comment lake: explode, shape, name the video, filter, deduplicate."""
    rows = keep_messages(normalize_renderer(explode_actions(lines)))
    rows = rows.withColumn("video_id", chat.video_id_from_file(F.col("source_file")))
    rows = dedup_comments(rows, order=("source_file", "line_order", "action_order"))
    return rows.select(
        "source_file", "video_id", "message_type", "timestamp_text", "timestamp_usec", "video_offset_msec",
        "author", "author_channel_id", "badges", "purchase_text", "message", "message_length",
        "line_order", "action_order",
    )


def flatten_text_messages(lines: DataFrame) -> DataFrame:
    """The earlier text-only flattening: no emoji, no cleaning, no filter, no dedup."""
    item = F.col(f"item.{RENDERERS['text']}")
    return explode_actions(lines).where(item.isNotNull()).select(
        chat.video_id_from_file(F.col("source_file")).alias("video_id"),
        text_or_empty(item["timestampText"]["simpleText"]).alias("timestamp_text"),
        text_or_empty(item["timestampUsec"]).alias("timestamp_usec"),
        text_or_empty(item["authorName"]["simpleText"]).alias("author"),
        text_or_empty(item["authorExternalChannelId"]).alias("author_channel_id"),
        chat.runs_to_plain_text(item["message"]["runs"]).alias("message"),
    )


def number_rows(df: DataFrame, order: Sequence[str], within: Sequence[str] = (), name: str = "row_number") -> DataFrame:
    """1-based row numbers in an order, over the table or within groups, without a hot task.

    Rows are range-partitioned by group and order, so a group of any size spreads over many
    tasks; each task numbers its own range, and the ranges' sizes give every range its start. The
    ranges are written to a stage table first: the start of a range must not change when a lost
    task is run again.
    """
    order, within = list(order), list(within)
    ranged = df.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order)
    position = F.monotonically_increasing_id()
    ranged = ranged.withColumns(
        {"_range": F.shiftrightunsigned(position, 33).cast("int"), "_index": position.bitwiseAND(F.lit((1 << 33) - 1))}
    )
    ranged = materialize(ranged, "ranges")
    sizes = ranged.groupBy("_range", *within).agg(F.count(F.lit(1)).alias("_rows"), F.min("_index").alias("_first"))
    # one row per range and group: small beside the data, and the join carries both keys
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_range", *within, (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1).alias("_start")
    )
    if not within:
        starts = F.broadcast(starts)  # one row per range, so at most one per shuffle partition
    joined = ranged.alias("r").join(
        starts.alias("s"),
        [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("_range", *within)],
    )
    return joined.select(*[F.col(f"r.{c}") for c in df.columns if c != name], (F.col("r._index") + F.col("s._start")).alias(name))


def row_range(df: DataFrame, low: int = 0, high: int = 0, column: str = "row_number") -> DataFrame:
    """Rows with a number in an inclusive range; 0 leaves that end open."""
    number = F.col(column).try_cast("long")
    if low > 0:
        df = df.where(number >= low)
    if high > 0:
        df = df.where(number <= high)
    return df


def limit_rows(df: DataFrame, n: int, order: Sequence[str] = ()) -> DataFrame:
    """First n rows in an order; 0 means all."""
    if n <= 0:
        return df
    return (df.orderBy(*order) if order else df).limit(n)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n pseudo-random rows, the same for the same seed whatever the partitioning."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def union_all(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second)
