"""Topic access: snapshot and continuous reads, event building, event sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from murmullo.functions.chat import event_id, event_key
from murmullo.functions.text import first_text, non_empty

# Topic names and the fields of an event.
RAW_TOPIC = "raw_youtube_chat"
RESULTS_TOPIC = "nlp_stream_results"
ALERTS_TOPIC = "alerts_polarization"
EVENT_FIELDS = (
    "event_id", "ingestion_ts", "source_s3_path", "row_number", "source_file", "video_id", "timestamp_text",
    "timestamp_usec", "video_offset_msec", "author", "author_channel_id", "message_raw", "message_clean",
)
EVENT_SCHEMA = T.StructType(
    [T.StructField(f, T.StringType()) for f in EVENT_FIELDS]
    + [T.StructField("raw", T.MapType(T.StringType(), T.StringType()))]
)
BOM = "\ufeff"


def read_topic_snapshot(spark: SparkSession, servers: str, topic: str = RAW_TOPIC, start="earliest", end="latest") -> DataFrame:
    """Everything a topic holds between two offsets. Needs the Kafka connector on the class path."""
    return (
        spark.read.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", start)
        .option("endingOffsets", end)
        .load()
    )


def stream_topic(spark: SparkSession, servers: str, topic: str = RAW_TOPIC, max_per_trigger: int | None = None) -> DataFrame:
    """Continuous read of a topic; progress lives in the checkpoint of the query that consumes it."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load()


def stream_table(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """A landed topic (parquet files of topic rows) as a stream, for runs without a broker."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def parse_events(topic_rows: DataFrame) -> DataFrame:
    """Topic rows (key, value, topic, partition, offset, timestamp) as flat events.

    The body has no source file of its own; it comes from the original row, where a byte-order
    mark may stick to the column name. Works on static and streaming frames.
    """
    event = F.from_json(F.col("value").cast("string"), EVENT_SCHEMA)
    flat = topic_rows.select(
        event.alias("e"),
        F.col("topic").alias("kafka_topic"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.col("timestamp").alias("kafka_timestamp"),
        F.col("key").cast("string").alias("kafka_key"),
        F.col("value").cast("string").alias("json_value"),
    )
    source_file = F.coalesce("e.source_file", F.col("e.raw")["source_file"], F.col("e.raw")[BOM + "source_file"])
    fields = [source_file.alias(f) if f == "source_file" else F.col(f"e.{f}").alias(f) for f in EVENT_FIELDS]
    return flat.select(
        *fields, "kafka_topic", "kafka_partition", "kafka_offset", "kafka_timestamp", "kafka_key", "json_value",
        F.col("e.raw").alias("raw"),
    )


def clean_header(df: DataFrame) -> DataFrame:
    """Column names without byte-order mark and outer blanks."""
    return df.toDF(*[name.lstrip(BOM).strip() for name in df.columns])


def build_events(numbered: DataFrame, source_path: str, start_row: int = 1, limit: int = 0, ingestion_ts=None) -> DataFrame:
    """Lake rows with a ``row_number`` as keyed JSON events (key, value), from a start row on.

    A row count needs no sort: with contiguous row numbers the limit is a range filter.
    """
    if start_row < 1:
        raise ValueError("start_row must be at least 1")
    df = clean_header(numbered)
    number = F.col("row_number").cast("long")
    df = df.where(number >= start_row)
    if limit > 0:
        df = df.where(number < start_row + limit)

    def column(name: str):
        return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")

    raw_text = first_text(column("message_raw"), column("message"))
    original = [c for c in df.columns if c not in ("row_number", "key", "value")]
    raw = F.map_from_arrays(F.array(*[F.lit(c) for c in original]), F.array(*[F.col(c).cast("string") for c in original]))
    identity = (column("video_id"), column("timestamp_usec"), column("author_channel_id"), column("author"))
    body = F.struct(
        event_id(F.lit(source_path), *identity, number).alias("event_id"),
        (F.lit(ingestion_ts) if ingestion_ts else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).alias("ingestion_ts"),
        F.lit(source_path).alias("source_s3_path"),
        number.alias("row_number"),
        *[column(c).alias(c) for c in ("video_id", "timestamp_text", "timestamp_usec", "video_offset_msec", "author", "author_channel_id")],
        raw_text.alias("message_raw"),
        F.coalesce(non_empty(column("message_clean")), raw_text).alias("message_clean"),
        raw.alias("raw"),
    )
    return df.select(
        event_key(*identity).cast("binary").alias("key"),
        F.to_json(body, {"ignoreNullFields": "false"}).cast("binary").alias("value"),
    )


def write_topic(events: DataFrame, servers: str, topic: str = RAW_TOPIC) -> None:
    """Batch write of (key, value) rows to a topic."""
    events.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.acks", "1").save()


def write_topic_stream(envelopes: DataFrame, servers: str, topic: str, checkpoint: str):
    """Streaming write of JSON envelopes (column ``value``) to a topic."""
    return (
        envelopes.select(F.col("value").cast("string"))
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("kafka.acks", "1")
        .option("checkpointLocation", checkpoint)
    )
