"""Test adapters: conversations and labelled documents in the shapes the engine works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from murmullo.functions.chat import event_id
from murmullo.functions.scalars import BINARY_LABELS, MULTICLASS_LABELS, label_name
from murmullo.operators.ingest import number_rows
from murmullo.session import materialize
from murmullo.sources.topics import RAW_TOPIC

SOURCE_PATH = "lake/chat.csv"
PARTITIONS = 3
START_USEC = 1704067200000000  # 2024-01-01 00:00:00 UTC
STEP_USEC = 700000
TURN_MSEC = 20000

_LANDED: dict[tuple[str, str], DataFrame] = {}


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The given test tables are one file with one row group, which can't be split: they are dealt out once.

    Tables in a lake have many splits and are not read this way; the package itself never repartitions its input.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def comments_from_conversations(conversations: DataFrame) -> DataFrame:
    """Conversations as a topic snapshot: one comment per turn, numbered by (conv_id, turn)."""
    numbered = number_rows(
        conversations.withColumn("kafka_partition", (F.col("conv_id") % PARTITIONS).cast("int")), ["conv_id", "turn"]
    )
    numbered = number_rows(numbered, ["row_number"], within=["kafka_partition"], name="_rank")
    n, conv, turn = F.col("row_number"), F.col("conv_id"), F.col("turn")
    usec = F.lit(START_USEC) + n * STEP_USEC
    padded = F.lpad(conv.cast("string"), 8, "0")
    seconds = turn * (TURN_MSEC // 1000)
    system = F.col("role") == "system"
    shaped = numbered.select(
        n.cast("string").alias("row_number"),
        F.lit(SOURCE_PATH).alias("source_s3_path"),
        F.lit(RAW_TOPIC).alias("kafka_topic"),
        "kafka_partition",
        (F.col("_rank") - 1).alias("kafka_offset"),
        F.timestamp_micros(usec).alias("kafka_timestamp"),
        F.concat(F.lit("chat [vid"), padded, F.lit("].live_chat.json")).alias("source_file"),
        F.concat(F.lit("vid"), padded).alias("video_id"),
        F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0")).alias("timestamp_text"),
        usec.cast("string").alias("timestamp_usec"),
        F.when(system, F.lit("n/a")).otherwise((turn * TURN_MSEC).cast("string")).alias("video_offset_msec"),
        F.when(~system, F.concat_ws("_", "role", (conv % 17).cast("string"))).alias("author"),
        F.concat(F.lit("ch"), (conv % 41).cast("string")).alias("author_channel_id"),
        F.col("text").alias("message_raw"),
        F.col("text").alias("message_clean"),
    )
    identity = [F.col(c) for c in ("source_s3_path", "video_id", "timestamp_usec", "author_channel_id", "author", "row_number")]
    return shaped.withColumn("event_id", event_id(*identity))


def comments(spark: SparkSession, directory: str) -> DataFrame:
    """The comment table of a data folder, landed once per application as a stage table."""
    key = (spark.sparkContext.applicationId, directory)
    if key not in _LANDED:
        _LANDED[key] = materialize(comments_from_conversations(read(spark, directory, "conversations")), "comments")
    return _LANDED[key]


def corpus(spark: SparkSession, directory: str) -> DataFrame:
    """Documents with labels as a labelled corpus; ``split`` by the last digit of the id."""
    joined = spread(read(spark, directory, "documents")).join(read(spark, directory, "labels"), "doc_id")
    label = (1 - F.col("toxic")) * 2 + (1 - F.col("quality"))
    digit = F.col("doc_id") % 10
    return joined.select(
        F.col("doc_id").cast("string").alias("comment_id"),
        F.col("text").alias("comment"),
        F.col("source").alias("influencer"),
        F.lit(None).cast("string").alias("influencer_gender"),
        F.col("lang").alias("media"),
        label.cast("bigint").alias("label"),
        F.when(digit < 8, "train").when(digit == 8, "validation").otherwise("test").alias("split"),
    )


def splits(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    every = corpus(spark, directory)
    return {s: every.where(F.col("split") == s).drop("split") for s in ("train", "validation", "test")}


def pseudo_predictions(comments: DataFrame) -> DataFrame:
    """Deterministic predictions by arithmetic on the row number, some of them missing."""
    n = F.col("row_number").cast("long")
    h = (n * 7919) % 1000
    missing = h % 50 == 0
    predicted = comments.withColumns(
        {
            "pred_binary_sparkml": F.when(~missing, (h % 2).cast("int")),
            "confidence_binary_sparkml": F.when(~missing, 0.5 + h / 2000.0),
            "pred_multiclass_sparkml": ((n * 31) % 5).cast("int"),
            "confidence_multiclass_sparkml": (h % 100) / 100.0,
        }
    )
    return predicted.withColumns(
        {
            "pred_binary_sparkml_label": label_name(F.col("pred_binary_sparkml"), BINARY_LABELS),
            "pred_multiclass_sparkml_label": label_name(F.col("pred_multiclass_sparkml"), MULTICLASS_LABELS),
        }
    )
