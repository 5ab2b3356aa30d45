"""Read-side rows: display text and tags, categorised events, search, and one common feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from murmullo.functions.text import first_text, non_empty
from murmullo.operators.batches import GROUP, batch_group

# Display text candidates in order of preference.
TEXT_CANDIDATES = (
    "payload.stream_text", "payload.message_text", "payload.message_clean", "payload.message_raw",
    "message_clean", "message_raw", "raw.message_clean", "raw.message_raw",
    "payload.hybrid_risk_reason", "payload.reason", "event_type",
)
MAX_TAGS = 4


def event_text() -> Column:
    """First non-empty display text of an event with ``payload`` and ``raw`` structures."""
    return first_text(*[F.col(c) for c in TEXT_CANDIDATES])


def event_tags() -> Column:
    """Up to four tags: type, rule tags, risk level, actor, alert type, raw marker."""
    rule_tags = F.split(F.coalesce("payload.local_rule_tags", F.lit("")), r"\|")
    level = F.concat(F.lit("risk:"), non_empty(F.col("payload.hybrid_risk_level")))
    tail = F.array(
        level, F.col("payload.actor"), F.col("payload.alert_type"),
        F.when(F.col("source") == "raw", F.lit("raw_youtube_chat")),
    )
    every = F.concat(F.array(F.col("event_type")), rule_tags, tail)
    return F.slice(F.filter(every, lambda tag: F.length(tag) > 0), 1, MAX_TAGS)


def is_categorised() -> Column:
    """Event with any text and any category field."""
    text = first_text(
        F.col("payload.stream_text"), F.col("payload.message_text"), F.col("payload.message_clean"),
        F.col("payload.message_raw"), F.col("message_clean"), F.col("message_raw"),
    )
    category = first_text(F.col("payload.local_rule_tags"), F.col("payload.actor"), F.col("payload.alert_type"))
    scored = F.coalesce(F.col("payload.local_risk_score_stream"), F.lit(0)) != 0
    return (text != "") & ((category != "") | scored)


def matches_query(query: str, columns: Sequence[str | Column]) -> Column:
    """Case-insensitive substring over the blank-joined columns; an empty query matches all."""
    needle = query.strip().lower()
    if not needle:
        return F.lit(True)
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns])
    return F.contains(F.lower(joined), F.lit(needle))


def search(df: DataFrame, query: str, columns: Sequence[str | Column]) -> DataFrame:
    return df.where(matches_query(query, columns))


# Source names and event types of the feed's three kinds of rows.
STREAM_ROW = ("stream", "political_signals")
ALERT_ROW = ("alert", "risk_alert")
BATCH_ROW = ("spark", "spark_batch_output")


def signal_feed(signals: DataFrame, is_alert: Column) -> DataFrame:
    """Feed rows of signals, each comment once and once more if it is an alert: one pass over the rules."""
    rows = F.array_compact(F.array(
        F.struct(F.lit(STREAM_ROW[0]).alias("source"), F.lit(STREAM_ROW[1]).alias("event_type")),
        F.when(is_alert, F.struct(F.lit(ALERT_ROW[0]).alias("source"), F.lit(ALERT_ROW[1]).alias("event_type")))))
    return signals.select(
        F.inline(rows), F.col("message_text").alias("text"), "event_id",
        F.col("kafka_partition").alias("source_partition"), F.col("kafka_offset").cast("long").alias("source_offset"))


def unified_feed(events: DataFrame, ledger: DataFrame, output_root: str | None = None, size: int = 1000) -> DataFrame:
    """Events and batch status in one frame; columns a side lacks are null.

    A batch row carries the end of its range as offset, partition 0 and, with ``output_root``, the folder of its rows.
    """
    folder = F.lit(None).cast("string") if output_root is None else F.concat(F.lit(f"{output_root}/{GROUP}="), batch_group(F.col("batch_id"), size).cast("string"))
    status = ledger.select(
        F.lit(BATCH_ROW[0]).alias("source"), F.lit(BATCH_ROW[1]).alias("event_type"), F.col("batch_id").alias("job_name"),
        F.concat_ws(" ", F.concat("status", F.lit(":")), F.col("rows").cast("string"), F.lit("filas escritas")).alias("text"),
        F.lit(0).alias("source_partition"), F.col("range_end").cast("long").alias("source_offset"), folder.alias("output_path"))
    return events.unionByName(status, allowMissingColumns=True)
