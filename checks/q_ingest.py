"""Ingest (families A, B, G06, I01): live-chat exports, lake files and topic events made from conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from checks import sql as S
from checks.data import comments, predicted, read, rules
from checks.registry import query
from murmullo.functions import chat
from murmullo.functions.text import first_text
from murmullo.operators import ingest as I
from murmullo.operators import offsets as O
from murmullo.operators.aggregates import count_by_type
from murmullo.operators.corpus import drop_empty, enrich_labels
from murmullo.operators.rules import add_rules
from murmullo.plans import batch
from murmullo.session import materialize, scratch_path
from checks import tables
from murmullo.sources import files, topics

# --- live-chat export lines --------------------------------------------------------------------------
# Row n becomes an export line whose renderer, runs and badges depend on n; every third line has a
# second action, every fifth line stands in the export twice.



def _short():
    return F.when(F.col("n") % 11 == 0, "ok").when(F.col("n") % 13 == 0, "JP").when(F.col("n") % 17 == 0, " \t ")


_BODY_SQL = "CASE WHEN n % 11 = 0 THEN 'ok' WHEN n % 13 = 0 THEN 'JP' WHEN n % 17 = 0 THEN chr(32) || chr(9) || chr(32) ELSE message_raw END"


def _emoji():
    label = F.struct(F.struct(F.struct(F.lit("heart").alias("label")).alias("accessibilityData")).alias("accessibility")).alias("image")
    shortcuts = F.when(F.col("n") % 2 == 0, F.array(F.lit(":smile:"), F.lit(":s:"))).alias("shortcuts")
    return F.when(F.col("n") % 4 < 2, F.struct(F.struct(shortcuts, label).alias("emoji")))


def _runs():
    body = F.coalesce(_short(), F.col("message_raw"))
    text = [F.struct(F.substring(body, 1, 40).alias("text"), F.lit(None).cast("string").alias("x")),
            F.struct(F.substring(body, 41, 1 << 30).alias("text"), F.lit(None).cast("string").alias("x"))]
    emoji = F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("x"), _emoji()["emoji"].alias("emoji"))
    plain = [F.struct(t["text"].alias("text"), t["x"].alias("x"), F.lit(None).cast(
        "struct<shortcuts: array<string>, image: struct<accessibility: struct<accessibilityData: struct<label: string>>>>").alias("emoji")) for t in text]
    return F.when(_short().isNotNull(), F.array(*plain)).otherwise(F.array(plain[0], emoji, plain[1]))


def _renderer():
    badge = F.array(
        F.struct(F.struct(F.lit("Moderador").alias("tooltip")).alias("liveChatAuthorBadgeRenderer")),
        F.struct(F.struct(F.lit("").alias("tooltip")).alias("liveChatAuthorBadgeRenderer")),
        F.struct(F.struct(F.concat(F.lit("Miembro "), F.col("kafka_partition").cast("string")).alias("tooltip")).alias("liveChatAuthorBadgeRenderer")),
    )
    header = F.array(F.struct(F.lit("Bienvenido").alias("text")), F.struct(F.lit(" a").alias("text")))
    return F.struct(
        F.when(F.col("n") % 19 != 0, F.struct(_runs().alias("runs"))).alias("message"),
        F.struct(F.col("author").alias("simpleText")).alias("authorName"),
        F.col("author_channel_id").alias("authorExternalChannelId"),
        F.struct(F.col("timestamp_text").alias("simpleText")).alias("timestampText"),
        F.col("timestamp_usec").alias("timestampUsec"),
        F.when(F.col("n") % 3 == 0, badge).alias("authorBadges"),
        F.struct(F.concat(F.lit("S/"), (F.col("n") % 100).cast("string")).alias("simpleText")).alias("purchaseAmountText"),
        F.struct(F.struct(F.struct(F.lit("Sticker ​ gato").alias("label")).alias("accessibilityData")).alias("accessibility")).alias("sticker"),
        F.struct(header.alias("runs")).alias("headerSubtext"),
    )


def _lines(spark, sf):
    """(source_file, line_order, value): export lines as JSON text."""
    df = comments(spark, sf).withColumn("n", F.col("row_number").cast("long"))
    r = F.col("_r")
    names = {0: "liveChatPaidMessageRenderer", 1: "liveChatPaidStickerRenderer", 2: "liveChatMembershipItemRenderer", 3: "liveChatPlaceholderItemRenderer"}
    item = F.struct(
        *[F.when(F.col("n") % 7 == k, r).alias(name) for k, name in names.items()],
        F.when(F.col("n") % 7 > 3, r).alias("liveChatTextMessageRenderer"),
    )
    second = F.struct(F.struct(F.struct(F.struct(
        F.struct(F.array(F.struct(F.concat(F.lit("eco "), F.col("row_number")).alias("text"))).alias("runs")).alias("message"),
        F.col("timestamp_usec").alias("timestampUsec")).alias("liveChatTextMessageRenderer")).alias("item")).alias("addChatItemAction"))
    built = df.withColumn("_r", _renderer()).withColumn("item", F.to_json(item)).withColumn("second", F.to_json(second))
    text = F.concat(
        F.lit('{"replayChatItemAction": {"videoOffsetTimeMsec": "'), F.col("video_offset_msec"),
        F.lit('", "actions": [{"addChatItemAction": {"item": '), F.col("item"), F.lit("}}"),
        F.when(F.col("n") % 3 == 0, F.concat(F.lit(", "), F.col("second"))).otherwise(F.lit("")), F.lit("]}}"),
    )
    copies = F.explode(F.when(F.col("n") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return built.select("source_file", "n", copies.alias("copy"), text.alias("value")).select(
        "source_file", F.struct("n", "copy").alias("line_order"), "value")


def _parsed(spark, sf):
    schema = files.LIVE_CHAT_SCHEMA
    parsed = _lines(spark, sf).withColumn("j", F.from_json("value", schema))
    return parsed.select("source_file", "line_order", "j.replayChatItemAction")


def _clean(x):
    return f"trim(regexp_replace(translate({x}, '​﻿', '  '), '\\s+', ' ', 'g'))"


_EMOJI_SQL = "CASE WHEN n % 4 >= 2 THEN '' WHEN n % 2 = 0 THEN ':smile:' ELSE 'heart' END"
_EXPORT = f"""
body AS (SELECT *, CASE WHEN n % 19 = 0 THEN '' WHEN n % 11 = 0 OR n % 13 = 0 OR n % 17 = 0 THEN {_BODY_SQL}
    ELSE substr(message_raw, 1, 40) || {_EMOJI_SQL} || substr(message_raw, 41) END AS b FROM comments),
shaped AS (
  SELECT source_file, video_id, n, 0 AS action_order, video_offset_msec, timestamp_text, timestamp_usec, coalesce(author, '') AS author, author_channel_id,
    CASE WHEN n % 3 = 0 THEN 'Moderador|Miembro ' || kafka_partition ELSE '' END AS badges,
    CASE n % 7 WHEN 0 THEN 'superchat' WHEN 1 THEN 'supersticker' WHEN 2 THEN 'membership' ELSE 'text' END AS message_type,
    CASE WHEN n % 7 IN (0, 1) THEN 'S/' || (n % 100) ELSE '' END AS purchase_text,
    CASE n % 7 WHEN 1 THEN 'Sticker gato' WHEN 2 THEN {_clean("'Bienvenido a ' || b")} ELSE {_clean('b')} END AS message
  FROM body WHERE n % 7 <> 3
  UNION ALL
  SELECT source_file, video_id, n, 1, video_offset_msec, '', timestamp_usec, '', '', '', 'text', '', 'eco ' || row_number FROM comments WHERE n % 3 = 0),
kept AS (SELECT *, length(message) AS message_length FROM shaped WHERE message_type <> 'text'
  OR (lower(replace(message, ' ', '')) IN ('jp', 'fp', 'jne', 'onpe', 'no', 'si', 'sí') OR length(replace(message, ' ', '')) >= 3))"""
_COPIES = "copies AS (SELECT *, UNNEST(CASE WHEN n % 5 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM {})"


@query("b01_explode_actions", S.chain(S.COMMENTS, final="""
SELECT source_file, sum(CASE WHEN n % 5 = 0 THEN 2 ELSE 1 END * CASE WHEN n % 3 = 0 THEN 2 ELSE 1 END)::BIGINT AS actions FROM comments GROUP BY 1"""))
def b01(spark, sf):
    return I.explode_actions(_parsed(spark, sf)).groupBy("source_file").agg(F.count(F.lit(1)).alias("actions"))


_LAKE = "message_type, timestamp_text, timestamp_usec, video_offset_msec, author, author_channel_id, badges, purchase_text, message"


@query("b02_normalize_renderer", S.chain(S.COMMENTS, _EXPORT, _COPIES.format("shaped"), final=f"""
SELECT source_file, n, copy, action_order, {_LAKE}, CAST(length(message) AS INTEGER) AS message_length FROM copies"""))
def b02(spark, sf):
    rows = I.normalize_renderer(I.explode_actions(_parsed(spark, sf)))
    return rows.withColumns({"n": F.col("line_order.n"), "copy": F.col("line_order.copy")}).drop("line_order")


@query("b03_runs_to_text", S.chain(S.COMMENTS, _EXPORT, _COPIES.format("shaped"), final="SELECT n, copy, action_order, message AS text FROM copies WHERE message_type = 'text'"))
def b03(spark, sf):
    items = I.explode_actions(_parsed(spark, sf)).where("item.liveChatTextMessageRenderer IS NOT NULL")
    runs = F.col("item.liveChatTextMessageRenderer.message.runs")
    return items.select(F.col("line_order.n").alias("n"), F.col("line_order.copy").alias("copy"), "action_order", F.coalesce(chat.runs_to_text(runs), F.lit("")).alias("text"))


@query("b04_membership_message", S.chain(S.COMMENTS, _EXPORT, _COPIES.format("shaped"), final="SELECT n, copy, message FROM copies WHERE message_type = 'membership'"))
def b04(spark, sf):
    rows = I.normalize_renderer(I.explode_actions(_parsed(spark, sf))).where("message_type = 'membership'")
    return rows.select(F.col("line_order.n").alias("n"), F.col("line_order.copy").alias("copy"), "message")


@query("b05_badges", S.chain(S.COMMENTS, _EXPORT, _COPIES.format("shaped"), final="SELECT badges, count(*) AS messages FROM copies GROUP BY badges"))
def b05(spark, sf):
    rows = I.normalize_renderer(I.explode_actions(_parsed(spark, sf)))
    return rows.groupBy("badges").agg(F.count(F.lit(1)).alias("messages"))


@query("b06_video_id", S.chain(S.COMMENTS, final="SELECT event_id, video_id, '' AS none FROM comments"))
def b06(spark, sf):
    name = F.col("source_file")
    return comments(spark, sf).select(
        "event_id", chat.video_id_from_file(name).alias("video_id"), chat.video_id_from_file(F.concat(name, F.lit("x"))).alias("none"))


@query("b07_keep_messages", S.chain(S.COMMENTS, _EXPORT, _COPIES.format("kept"), final="SELECT n, copy, action_order, message_type, message FROM copies"))
def b07(spark, sf):
    rows = I.keep_messages(I.normalize_renderer(I.explode_actions(_parsed(spark, sf))))
    return rows.select(F.col("line_order.n").alias("n"), F.col("line_order.copy").alias("copy"), "action_order", "message_type", "message")


_KEYS = "video_id, timestamp_usec, author_channel_id, message, message_type, purchase_text"


@query("b08_dedup_comments", S.chain(S.COMMENTS, _EXPORT, _COPIES.format("kept"), f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY source_file, n, copy, action_order) AS r FROM copies)""", final=f"""
SELECT source_file, video_id, {_LAKE}, CAST(message_length AS INTEGER) AS message_length, n, copy, action_order FROM ranked WHERE r = 1"""))
def b08(spark, sf):
    lake = I.flatten_live_chat(_parsed(spark, sf))
    return lake.withColumns({"n": F.col("line_order.n"), "copy": F.col("line_order.copy")}).drop("line_order")


@query("b08_dedup_copies", """
SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY lang, source""")
def b08_copies(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "lang", "source")
    return I.dedup_comments(docs, order=["doc_id"], keys=["lang", "source"])


@query("b08_text_messages", S.chain(S.COMMENTS, _EXPORT, _COPIES.format("comments"), final="""
SELECT count(*) AS messages, count(DISTINCT video_id) AS videos FROM (
  SELECT video_id FROM copies WHERE n % 7 > 3 UNION ALL SELECT video_id FROM copies WHERE n % 3 = 0)"""))
def b08_text(spark, sf):
    return I.flatten_text_messages(_parsed(spark, sf)).agg(
        F.count(F.lit(1)).alias("messages"), F.count_distinct("video_id").alias("videos"))


@query("f25_count_by_type", S.chain(S.COMMENTS, _EXPORT, final="SELECT message_type, count(*) AS count FROM kept GROUP BY message_type"))
def f25(spark, sf):
    return count_by_type(I.flatten_live_chat(_parsed(spark, sf)))


@query("a07_read_live_chat", S.chain(S.COMMENTS, final="""
SELECT count(*) AS lines, sum(CASE WHEN n % 3 = 0 THEN 2 ELSE 1 END)::BIGINT AS actions, count(DISTINCT n) AS distinct_lines FROM (
  SELECT n, UNNEST(CASE WHEN n % 5 = 0 THEN [0, 1] ELSE [0] END) FROM comments)"""))
def a07(spark, sf):
    path = scratch_path(spark, "live_chat")
    lines = _lines(spark, sf).select("value")
    broken = lines.select(F.concat(F.lit('{"broken": '), F.substring("value", 1, 20)).alias("value"))
    lines.union(broken).write.text(path)
    rows = files.read_live_chat(spark, path)
    known = rows.select(F.size("replayChatItemAction.actions").alias("a")).agg(F.count(F.lit(1)).alias("lines"), F.sum("a").alias("actions"))
    # lines whose renderer is unknown look alike once parsed: lines of the file are told apart by their text
    whole = spark.read.text(path).where(F.get_json_object("value", "$.replayChatItemAction").isNotNull())
    return known.select("lines", "actions", whole.agg(F.count_distinct("value").alias("distinct_lines")).scalar().alias("distinct_lines"))


# --- lake files --------------------------------------------------------------------------------------

_CSV_COLUMNS = ("row_number", "source_file", "video_id", "timestamp_usec", "video_offset_msec", "author", "message_raw")
_CSV_SQL = S.chain(S.COMMENTS, final=f"SELECT {', '.join(_CSV_COLUMNS)} FROM comments")


def _csv(spark, sf, escape):
    path = scratch_path(spark, "lake_csv")
    files.write_csv(comments(spark, sf).select(*_CSV_COLUMNS), path, escape=escape)
    return files.read_comments_csv(spark, path, files.string_schema(_CSV_COLUMNS), escape=escape)


@query("a01_read_comments_csv", _CSV_SQL)
def a01(spark, sf):
    return _csv(spark, sf, '"')


@query("a02_read_hybrid_csv", _CSV_SQL)
def a02(spark, sf):
    return _csv(spark, sf, "\\")


def _split_csv(spark, sf, escape):
    """One file of quoted fields with line breaks, read in splits of 64 KB."""
    path, was = scratch_path(spark, "lake_split"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    comments(spark, sf).select(*_CSV_COLUMNS).coalesce(1).write.option("header", True).option("quote", '"').option("escape", escape).csv(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:  # the files are listed and split when the result is written
        return materialize(files.read_split_csv(spark, path, files.string_schema(_CSV_COLUMNS), escape), "lake")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


@query("a01_read_split_csv", _CSV_SQL)
def a01_split(spark, sf):
    return _split_csv(spark, sf, '"')


@query("a02_read_split_csv", _CSV_SQL)
def a02_split(spark, sf):
    return _split_csv(spark, sf, "\\")


@query("a09_csv_sink", S.chain(S.COMMENTS, final="SELECT count(*) AS rows, count(author) AS authors, 3 AS files FROM comments"))
def a09(spark, sf):
    path = scratch_path(spark, "sink_csv")
    files.write_csv(comments(spark, sf).select(*_CSV_COLUMNS), path, files=3)
    back = files.read_comments_csv(spark, path, files.string_schema(_CSV_COLUMNS), escape="\\")
    return back.withColumn("f", F.input_file_name()).agg(
        F.count(F.lit(1)).alias("rows"), F.count("author").alias("authors"), F.count_distinct("f").cast("int").alias("files"))


@query("a03_read_corpus", S.chain(S.CORPUS, final="SELECT split, label, count(*) AS rows, sum(length(comment))::BIGINT AS chars FROM corpus GROUP BY ALL"))
def a03(spark, sf):
    path = scratch_path(spark, "corpus")
    for name, df in tables.splits(spark, sf).items():
        df.write.parquet(f"{path}/{name}.parquet")
    parts = None
    for name, df in files.read_corpus(spark, path).items():
        part = df.withColumn("split", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("split", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("comment")).alias("chars"))


_STAGE_SQL = S.chain(S.COMMENTS, S.rules_cte("k"), final="SELECT event_id, kafka_partition, minute, has_fraude, local_risk_score FROM ruled")


@query("a04_read_stage", _STAGE_SQL)
def a04(spark, sf):
    path = scratch_path(spark, "stage")
    files.write_stage(batch.rules_stage(comments(spark, sf), rules("k")), path)
    return files.read_stage(spark, path).select("event_id", "kafka_partition", "minute", "has_fraude", "local_risk_score")


@query("a10_parquet_sink", _STAGE_SQL)
def a10(spark, sf):
    path = scratch_path(spark, "stage")
    for _ in range(2):  # the second write replaces the first
        files.write_stage(batch.rules_stage(comments(spark, sf), rules("k")), path, files=2, partition_by=["kafka_partition"])
    return files.read_stage(spark, path).select("event_id", F.col("kafka_partition").cast("int").alias("kafka_partition"), "minute", "has_fraude", "local_risk_score")


@query("a17_enriched_split", S.chain(S.CORPUS, final="""
SELECT split, kind, label, count(*) AS rows, CAST(sum(CASE WHEN label = 2 THEN 0 ELSE 1 END) AS BIGINT) AS toxic, CAST(sum(length(comment)) AS BIGINT) AS chars
FROM corpus, (VALUES ('parquet'), ('csv')) AS k(kind) GROUP BY ALL"""))
def a17(spark, sf):
    path, parts = scratch_path(spark, "enriched"), []
    for split, rows in tables.splits(spark, sf).items():
        files.write_enriched(enrich_labels(rows), f"{path}/{split}")
        back = spark.read.parquet(f"{path}/{split}.parquet")
        text = spark.read.schema(back.schema).option("header", True).option("escape", '"').option("multiLine", True).csv(f"{path}/{split}.csv")
        for kind, found in (("parquet", back), ("csv", text)):
            parts.append(found.groupBy("label").agg(
                F.count(F.lit(1)).alias("rows"), F.sum("label_binary").cast("long").alias("toxic"), F.sum(F.length("comment")).alias("chars"),
            ).select(F.lit(split).alias("split"), F.lit(kind).alias("kind"), "label", "rows", "toxic", "chars"))
    return reduce(lambda a, b: a.union(b), parts)


@query("a18_head_json", S.chain(S.CORPUS, final="""
SELECT comment_id, label, length(comment) AS chars FROM corpus ORDER BY doc_id LIMIT 200"""))
def a18(spark, sf):
    path = scratch_path(spark, "sample")
    files.head_json(tables.corpus(spark, sf), path, [F.col("comment_id").cast("long")])
    back = spark.read.schema("comment_id string, comment string, label long").json(path)
    return back.select("comment_id", "label", F.length("comment").cast("long").alias("chars"))


# --- topic events --------------------------------------------------------------------------------------

_LAKE_COLUMNS = ("row_number", "source_file", "video_id", "timestamp_text", "timestamp_usec", "video_offset_msec", "author", "author_channel_id")


def _lake(spark, sf):
    """Comments as lake rows with a byte-order mark on the first column name."""
    return comments(spark, sf).select(
        F.col("source_file").alias(topics.BOM + "source_file"), *[c for c in _LAKE_COLUMNS if c != "source_file"], F.col("message_raw").alias("message"))


def _topic_rows(spark, sf):
    """Events as a topic holds them; position and time from the comment of the same row."""
    events = topics.build_events(_lake(spark, sf), tables.SOURCE_PATH)
    number = F.get_json_object(F.col("value").cast("string"), "$.row_number")
    places = comments(spark, sf).select("row_number", F.col("kafka_topic").alias("topic"), F.col("kafka_partition").alias("partition"),
                                        F.col("kafka_offset").alias("offset"), F.col("kafka_timestamp").alias("timestamp"))
    return events.withColumn("row_number", number).join(places, "row_number").drop("row_number")


@query("a12_build_events", S.chain(S.COMMENTS, final="""
SELECT event_id, row_number, source_s3_path, video_id, timestamp_usec, author, message_raw, message_clean,
  video_id || '|' || timestamp_usec || '|' || author_channel_id || coalesce('|' || author, '') AS key FROM comments WHERE n BETWEEN 11 AND 410"""))
def a12(spark, sf):
    events = topics.build_events(_lake(spark, sf), tables.SOURCE_PATH, start_row=11, limit=400)
    e = F.from_json(F.col("value").cast("string"), topics.EVENT_SCHEMA)
    fields = ("event_id", "row_number", "source_s3_path", "video_id", "timestamp_usec", "author", "message_raw", "message_clean")
    return events.select(e.alias("e"), F.col("key").cast("string").alias("key")).select(*[f"e.{f}" for f in fields], "key")


@query("b10_event_id", S.chain(S.COMMENTS, final="SELECT row_number, event_id FROM comments"))
def b10(spark, sf):
    columns = ("source_s3_path", "video_id", "timestamp_usec", "author_channel_id", "author", "row_number")
    return comments(spark, sf).select("row_number", chat.event_id(*[F.col(c) for c in columns]).alias("event_id"))


@query("b11_event_key", S.chain(S.COMMENTS, final="""
SELECT row_number, video_id || '|' || timestamp_usec || '|' || author_channel_id || coalesce('|' || author, '') AS key, author AS author_key FROM comments"""))
def b11(spark, sf):
    none = F.lit("")
    return comments(spark, sf).select(
        "row_number", chat.event_key(*[F.col(c) for c in ("video_id", "timestamp_usec", "author_channel_id", "author")]).alias("key"),
        chat.event_key(none, none, none, F.col("author")).alias("author_key"))


@query("b12_message_columns", S.chain(S.COMMENTS, final="""
SELECT event_id, CASE WHEN n % 4 = 0 THEN '' WHEN n % 4 = 1 THEN 'm' || row_number ELSE message_raw END AS message_raw,
  CASE WHEN n % 8 < 4 THEN message_clean WHEN n % 4 = 0 THEN '' WHEN n % 4 = 1 THEN 'm' || row_number ELSE message_raw END AS message_clean FROM comments"""))
def b12(spark, sf):
    n = F.col("row_number").cast("long")
    raw = F.when(n % 4 == 1, F.lit(None).cast("string")).when(n % 4 == 0, "").otherwise(F.col("message_raw"))
    message = F.when(n % 4 == 1, F.concat(F.lit("m"), F.col("row_number")))
    chosen = first_text(raw, message)
    clean = F.when(n % 8 < 4, F.col("message_clean"))  # missing for the others: the raw text takes its place
    return comments(spark, sf).select("event_id", chosen.alias("message_raw"), first_text(clean, chosen).alias("message_clean"))


_PARSED = """SELECT event_id, row_number, source_s3_path, source_file, video_id, video_offset_msec, author, message_raw, message_clean,
  kafka_topic, kafka_partition, kafka_offset, kafka_timestamp FROM comments"""


@query("b13_parse_events", S.chain(S.COMMENTS, final=_PARSED))
def b13(spark, sf):
    return topics.parse_events(_topic_rows(spark, sf)).select(
        "event_id", "row_number", "source_s3_path", "source_file", "video_id", "video_offset_msec", "author", "message_raw", "message_clean",
        "kafka_topic", "kafka_partition", "kafka_offset", "kafka_timestamp")


@query("b14_source_file", S.chain(S.COMMENTS, final="""
SELECT row_number, CASE WHEN n % 3 = 2 THEN NULL ELSE source_file END AS source_file FROM comments"""))
def b14(spark, sf):
    # the name in the original row: plain, behind a byte-order mark, or missing
    n = F.col("row_number").cast("long")
    key = F.when(n % 3 == 0, "source_file").when(n % 3 == 1, topics.BOM + "source_file").otherwise("other")
    value = F.to_json(F.struct("row_number", F.create_map(key, F.col("source_file")).alias("raw")))
    rows = comments(spark, sf).select(
        F.lit(None).cast("binary").alias("key"), value.alias("value"), F.col("kafka_topic").alias("topic"),
        F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"), F.col("kafka_timestamp").alias("timestamp"))
    return topics.parse_events(rows).select("row_number", "source_file")


_BOUNDS = """
bounds AS (SELECT kafka_partition, (max(kafka_offset) + 1) // 4 AS lo, (max(kafka_offset) + 1) // 2 AS hi FROM comments GROUP BY 1)"""


@query("a05_topic_snapshot", S.chain(S.COMMENTS, _BOUNDS, final="""
SELECT event_id, kafka_partition, kafka_offset FROM comments JOIN bounds USING (kafka_partition) WHERE kafka_offset >= lo AND kafka_offset < hi"""))
def a05(spark, sf):
    raw = comments(spark, sf)
    end = F.col("end_offset")
    bounds = O.end_offsets(raw).select("kafka_topic", "kafka_partition", F.floor(end / 4).alias("start_offset"), F.floor(end / 2).alias("end_offset"))
    return O.snapshot_range(raw, bounds).select("event_id", "kafka_partition", "kafka_offset")


_CURSOR = """
ends AS (SELECT kafka_partition, max(kafka_offset) + 1 AS end_offset FROM comments GROUP BY 1),
starts AS (SELECT *, least(CASE WHEN kafka_partition < 2 THEN end_offset // 3 ELSE 0 END, end_offset) AS start_offset, 80 // (SELECT count(*) FROM ends) + 1 AS quota FROM ends),
wants AS (SELECT *, least(quota, end_offset - start_offset) AS want FROM starts),
takes AS (SELECT *, greatest(0, least(want, 80 - coalesce(sum(want) OVER (ORDER BY kafka_partition ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM wants)"""


def _cursor(spark, sf):
    raw = comments(spark, sf)
    cursor = O.end_offsets(raw).where("kafka_partition < 2").select("kafka_topic", "kafka_partition", F.floor(F.col("end_offset") / 3).alias("next_offset"))
    return O.read_delta(raw, cursor, 80)


@query("a08_read_delta", S.chain(S.COMMENTS, _CURSOR, final="""
SELECT event_id, kafka_partition, kafka_offset FROM comments JOIN takes USING (kafka_partition) WHERE kafka_offset >= start_offset AND kafka_offset < start_offset + take"""))
def a08(spark, sf):
    return _cursor(spark, sf)[0].select("event_id", "kafka_partition", "kafka_offset")


@query("a08_delta_cursor", S.chain(S.COMMENTS, _CURSOR, final="""
SELECT 'raw_youtube_chat' AS kafka_topic, kafka_partition, start_offset::BIGINT AS start_offset, (start_offset + take)::BIGINT AS next_offset, end_offset,
  greatest(0, end_offset - start_offset - take)::BIGINT AS lag FROM takes"""))
def a08_cursor(spark, sf):
    return _cursor(spark, sf)[1]


@query("b23_drop_empty", """
SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND trim(text) <> ''""")
def b23(spark, sf):
    t = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.trim("text"))
    return drop_empty(read(spark, sf, "documents").withColumn("text_clean", t)).select("doc_id")


@query("i01_union_all", S.chain(S.COMMENTS, final="""
SELECT video_id, count(*) * 2 AS rows FROM comments GROUP BY video_id"""))
def i01(spark, sf):
    df = comments(spark, sf)
    return I.union_all(df, df).groupBy("video_id").agg(F.count(F.lit(1)).alias("rows"))
