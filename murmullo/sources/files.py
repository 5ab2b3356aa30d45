"""File sources and sinks: comment lake, labelled corpus, stage tables, live-chat exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

# Columns of the comment lake.
LAKE_COLUMNS = (
    "source_file", "video_id", "message_type", "timestamp_text", "timestamp_usec", "video_offset_msec",
    "author", "author_channel_id", "badges", "purchase_text", "message", "message_length",
)


def string_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


LAKE_SCHEMA = string_schema(LAKE_COLUMNS)
CORPUS_SCHEMA = (
    "comment_id string, comment string, influencer string, influencer_gender string, media string, label bigint"
)

_RUNS = (
    "array<struct<text: string, emoji: struct<shortcuts: array<string>, "
    "image: struct<accessibility: struct<accessibilityData: struct<label: string>>>>>>"
)
_COMMON = (
    f"message: struct<runs: {_RUNS}>, authorName: struct<simpleText: string>, authorExternalChannelId: string, "
    "timestampText: struct<simpleText: string>, timestampUsec: string, "
    "authorBadges: array<struct<liveChatAuthorBadgeRenderer: struct<tooltip: string>>>"
)
_PAID = f"{_COMMON}, purchaseAmountText: struct<simpleText: string>"
LIVE_CHAT_SCHEMA = (
    "replayChatItemAction struct<videoOffsetTimeMsec: string, actions: array<struct<addChatItemAction: struct<item: struct<"
    f"liveChatTextMessageRenderer: struct<{_COMMON}>, "
    f"liveChatPaidMessageRenderer: struct<{_PAID}>, "
    f"liveChatPaidStickerRenderer: struct<{_PAID}, sticker: struct<accessibility: struct<accessibilityData: struct<label: string>>>>, "
    f"liveChatMembershipItemRenderer: struct<{_COMMON}, headerSubtext: struct<runs: {_RUNS}>>"
    ">>>>>"
)


def read_comments_csv(
    spark: SparkSession, path: str, schema: T.StructType = LAKE_SCHEMA, escape: str = '"', multi_line: bool = True
) -> DataFrame:
    """Comment lake CSV: header, quoted fields over several lines, every column a string.

    ``escape`` is '"' for files written by CSV libraries and '\\' for files written by Spark.
    A multi-line file is one task however large it is: ``read_split_csv`` splits it. Lakes without line
    breaks in fields (``multi_line=False``) split freely.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", escape)
        .csv(path)
    )


def csv_records(spark: SparkSession, path: str, escape: str = '"') -> DataFrame:
    """Records of CSV files whose quoted fields may hold line breaks, from any number of tasks a file: column ``record``, no headers.

    A line starts a record if the quotes before it in its file are even. Lines are read in splits; each split counts
    its quotes, the parity at its start is a prefix sum over the few splits of a file, and the parity of a line one over the lines
    of its split. Records inside a split are put together there; only the lines of records that cross a split's border move on.
    """
    value = F.col("value") if escape == '"' else F.regexp_replace("value", r"\\.", "")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), (F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))).alias("quotes"))
    lines = lines.withColumn("at", F.monotonically_increasing_id())  # the order of lines within a split
    splits = lines.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("odd_before", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    order = Window.partitionBy("file", "block").orderBy("at")
    placed = lines.join(splits, ["file", "block"]).withColumn(
        "starts", ((F.col("odd_before") + F.coalesce(F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) % 2 == 0))
    placed = placed.withColumn("place", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("crosses", (F.col("place") == 0) | (((F.col("odd_before") + F.col("odd")) % 2 == 1) & (F.col("place") == F.max("place").over(Window.partitionBy("file", "block")))))
    is_first = (F.col("block") == 0) & (F.col("place") == 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "\n").alias("record")
    inside = placed.where("not crosses").groupBy("file", "block", "place").agg(text, F.bool_or(is_first).alias("header"))
    over = Window.partitionBy("file").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, 0)
    border = placed.where("crosses").withColumn("number", F.sum(F.col("starts").cast("int")).over(over))
    border = border.groupBy("file", "number").agg(text, F.bool_or(is_first).alias("header"))
    every = inside.select("record", "header").union(border.select("record", "header"))
    return every.where("not header").select(F.rtrim("record", F.lit("\r")).alias("record")).where("record <> ''")


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType = LAKE_SCHEMA, escape: str = '"') -> DataFrame:
    """As ``read_comments_csv`` of multi-line files, with large files split among tasks. Parsing is left to ``from_csv``."""
    options = {"quote": '"', "escape": escape, "multiLine": "true"}
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return csv_records(spark, path, escape).select(F.from_csv("record", kinds, options).alias("r")).select("r.*")


def read_stage(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_corpus(spark: SparkSession, directory: str, splits=("train", "validation", "test")) -> dict[str, DataFrame]:
    return {s: spark.read.schema(CORPUS_SCHEMA).parquet(f"{directory}/{s}.parquet") for s in splits}


def read_live_chat(spark: SparkSession, path: str) -> DataFrame:
    """Live-chat export lines with their file name and position; unparsable lines are skipped.

    ``line_order`` orders the lines of a file as they stand in it, whatever the split.
    """
    lines = spark.read.schema(LIVE_CHAT_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return lines.select(
        "replayChatItemAction",
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("_encoded_name"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("line_order"),
    ).withColumn("source_file", F.url_decode(F.replace("_encoded_name", F.lit("+"), F.lit("%2B")))).drop("_encoded_name")


def _fewer_files(df: DataFrame, files: int) -> DataFrame:
    """``files`` > 0 asks for that many output files; otherwise the partitioning is kept."""
    return df.repartition(files) if files > 0 else df


def write_csv(df: DataFrame, path: str, files: int = 0, escape: str = "\\") -> None:
    (
        _fewer_files(df, files).write.mode("errorifexists")
        .option("header", True)
        .option("escape", escape)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_stage(df: DataFrame, path: str, files: int = 0, partition_by=()) -> None:
    """Overwrite a stage table; the work before the write keeps its own parallelism."""
    _fewer_files(df, files).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_enriched(df: DataFrame, path: str) -> None:
    """A labelled split as parquet and as CSV side by side."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}.csv")


def head_json(df: DataFrame, path: str, order, n: int = 200) -> DataFrame:
    """First n rows in key order as JSON, the label-audit sample."""
    sample = df.orderBy(*order).limit(n)
    sample.write.mode("overwrite").json(path)
    return sample
