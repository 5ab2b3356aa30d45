"""Windows, sorts, top-k and read-side filters (families G, H, parts of B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.data import TEST_ACTORS, comments, predicted, read, rules, ruled, scored
from checks.registry import query
from murmullo.functions.scalars import author_or_default
from murmullo.operators import feed as FD
from murmullo.operators import ingest as I
from murmullo.operators import offsets as O
from murmullo.operators import ranking as K
from murmullo.operators.rules import add_signals
from murmullo.plans.diagnostics import samples
from checks import tables


@query("g01_examples_per_group", S.chain(S.CORPUS, """
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY doc_id) AS INTEGER) AS example FROM corpus)""",
       final="SELECT label, example, comment_id, media, comment FROM ranked WHERE example <= 12"))
def g01(spark, sf):
    df = tables.corpus(spark, sf).select("label", "comment_id", "media", "comment")
    return K.examples_per_group(df, "label", [F.col("comment_id").cast("long")], 12)


@query("g02_examples_per_flag", S.chain(S.COMMENTS, S.rules_cte("l"), """
long AS (""" + " UNION ALL ".join(f"SELECT '{f}' AS flag, event_id, message_raw, kafka_timestamp FROM ruled WHERE {f}" for f in S.FLAGS) + """),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY flag ORDER BY kafka_timestamp, event_id) AS INTEGER) AS example FROM long)""",
       final="SELECT flag, example, event_id, message_raw FROM ranked WHERE example <= 8"))
def g02(spark, sf):
    return K.examples_per_flag(ruled(spark, sf, "l"), "event_id", ["kafka_timestamp"])


@query("g03_cumulative_actor_counts", S.chain(S.COMMENTS, S.SIGNALS, f"""
points AS (SELECT {S.CANONICAL_ACTOR} AS actor, date_trunc('minute', kafka_timestamp) AS point, count(*) AS m FROM signals WHERE actor <> '' GROUP BY ALL),
running AS (SELECT actor, point, CAST(sum(m) OVER (PARTITION BY actor ORDER BY point) AS BIGINT) AS mentions,
  row_number() OVER (PARTITION BY actor ORDER BY point DESC) AS age FROM points)""",
       final="SELECT actor, point, mentions FROM running WHERE age <= 90"))
def g03(spark, sf):
    found = add_signals(comments(spark, sf), rules("s"), TEST_ACTORS)
    return K.cumulative_actor_counts(found, F.date_trunc("minute", "kafka_timestamp"))


@query("g04_rates", """
WITH per_hour AS (SELECT event_type AS kafka_topic, date_trunc('hour', ts) AS ts, count(*) AS m FROM events GROUP BY ALL),
snaps AS (SELECT kafka_topic, ts, CAST(sum(m) OVER (PARTITION BY kafka_topic ORDER BY ts) AS BIGINT) AS total FROM per_hour),
steps AS (SELECT *, total - lag(total) OVER w AS grown, epoch(ts) - epoch(lag(ts) OVER w) AS elapsed FROM snaps WINDOW w AS (PARTITION BY kafka_topic ORDER BY ts))
SELECT kafka_topic, ts, total, CASE WHEN elapsed > 0 THEN round(greatest(grown, 0)::DOUBLE / elapsed, 3) ELSE 0.0::DOUBLE END AS rate FROM steps""")
def g04(spark, sf):
    hourly = read(spark, sf, "events").select(F.col("event_type").alias("kafka_topic"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"))
    counts = hourly.groupBy("kafka_topic", "ts").agg(F.count(F.lit(1)).alias("m"))
    from pyspark.sql import Window

    running = F.sum("m").over(Window.partitionBy("kafka_topic").orderBy("ts"))
    return O.rates(counts.select("kafka_topic", "ts", running.alias("total")))


@query("g06_row_numbers", """
SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS row_number, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS lang_rank FROM documents""")
def g06(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "source", "lang")
    numbered = I.number_rows(docs, ["source", "doc_id"])
    return I.number_rows(numbered, ["doc_id"], within=["lang"], name="lang_rank").select("doc_id", "row_number", "lang_rank")


@query("h01_top_risk", S.chain(S.COMMENTS, S.rules_cte("v1"), final="""
SELECT event_id, local_risk_score, local_rule_tags, message_raw FROM ruled ORDER BY local_risk_score DESC, event_id LIMIT 20"""))
def h01(spark, sf):
    return K.top_risk(ruled(spark, sf, "v1"), "event_id")


_SAMPLES = {
    "confident_with_rules": ("pred_binary_sparkml = 1 AND confidence_binary_sparkml >= 0.80 AND has_strong_local_rule", "local_risk_score DESC, confidence_binary_sparkml DESC"),
    "confident_without_rules": ("pred_binary_sparkml = 1 AND confidence_binary_sparkml >= 0.80 AND NOT has_any_local_rule", "confidence_binary_sparkml DESC"),
    "unsure_without_rules": ("pred_binary_sparkml = 1 AND confidence_binary_sparkml < 0.60 AND NOT has_any_local_rule", "confidence_binary_sparkml"),
    "not_offensive_high_score": ("pred_binary_sparkml = 0 AND local_risk_score >= 4", "local_risk_score DESC"),
}


@query("h02_samples", S.chain(*S.scored("v1"), final=" UNION ALL ".join(
    f"(SELECT '{name}' AS sample, event_id, confidence_binary_sparkml, local_risk_score, hybrid_risk_reason FROM scored WHERE {where} ORDER BY {order}, event_id LIMIT 10)"
    for name, (where, order) in _SAMPLES.items())))
def h02(spark, sf):
    found = samples(scored(spark, sf, "v1"), "event_id")
    return found.select("sample", "event_id", "confidence_binary_sparkml", "local_risk_score", "hybrid_risk_reason")


@query("h03_first_by_offset", S.chain(S.COMMENTS, final="""
SELECT event_id, kafka_partition, kafka_offset FROM comments ORDER BY kafka_partition, kafka_offset LIMIT 5"""))
def h03(spark, sf):
    return K.first_by_offset(comments(spark, sf).select("event_id", "kafka_partition", "kafka_offset"))


_OFFENSIVE = """(coalesce(pred_multiclass_sparkml_label, '') IN ('ofensivo_directo', 'odio_agresion_grupal', 'vulgaridad_contextual')
  OR (coalesce(pred_binary_sparkml_label, '') = 'ofensivo' AND coalesce(hybrid_risk_level, '') IN ('medio', 'alto')))
  AND coalesce(pred_multiclass_sparkml_label, '') <> 'neutral_no_ofensivo'"""


@query("b19_offensive_comments", S.chain(*S.scored("k"), final=f"SELECT event_id, hybrid_risk_level FROM scored WHERE {_OFFENSIVE}"))
def b19(spark, sf):
    return K.offensive_comments(scored(spark, sf)).select("event_id", "hybrid_risk_level")


@query("h04_top_offensive", S.chain(*S.scored("k"), final=f"""
SELECT event_id, row_number, coalesce(author, 'youtube_user') AS author, coalesce(message_clean, message_raw, '') AS message,
  pred_binary_sparkml_label AS binary_label, pred_multiclass_sparkml_label AS multiclass_label, hybrid_risk_level AS risk_level, hybrid_risk_reason AS risk_reason,
  local_rule_tags, confidence_binary_sparkml AS confidence, CAST(kafka_partition AS VARCHAR) AS kafka_partition, CAST(kafka_offset AS VARCHAR) AS kafka_offset
FROM scored WHERE {_OFFENSIVE} ORDER BY confidence_binary_sparkml DESC, n LIMIT 250"""))
def h04(spark, sf):
    return K.top_offensive(scored(spark, sf))


@query("h05_order_events", S.chain(S.COMMENTS, final="SELECT event_id, kafka_partition, kafka_offset FROM comments ORDER BY 2, 3"))
def h05(spark, sf):
    return K.order_events(comments(spark, sf).select("event_id", "kafka_partition", "kafka_offset"))


@query("n06_replay_order", S.chain(S.COMMENTS, final="""
SELECT event_id, video_id, TRY_CAST(video_offset_msec AS DOUBLE) AS offset_msec FROM comments ORDER BY 2, 3 NULLS FIRST, n"""))
def n06(spark, sf):
    return K.replay_order(comments(spark, sf)).select("event_id", "video_id", F.col("video_offset_msec").try_cast("double").alias("offset_msec"))


@query("b15_row_range", S.chain(S.COMMENTS, final="SELECT event_id, row_number FROM comments WHERE n BETWEEN 101 AND 300"))
def b15(spark, sf):
    return I.row_range(comments(spark, sf), 101, 300).select("event_id", "row_number")


@query("b17_limit_rows", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def b17(spark, sf):
    return I.limit_rows(read(spark, sf, "documents").select("doc_id"), 50, ["doc_id"])


@query("b18_sample", S.chain(S.COMMENTS, final="SELECT event_id, message_raw FROM comments ORDER BY md5('42:' || event_id), event_id LIMIT 50"))
def b18(spark, sf):
    return I.sample_n(comments(spark, sf), 50, "event_id").select("event_id", "message_raw")


@query("b24_author_default", S.chain(S.COMMENTS, final="SELECT event_id, coalesce(author, 'youtube_user') AS author FROM comments"))
def b24(spark, sf):
    return comments(spark, sf).select("event_id", author_or_default(F.col("author")).alias("author"))


# --- read side: events with a payload structure made from signals, some of it missing

_EVENTS = """
fed AS (SELECT event_id, n, CASE n % 4 WHEN 0 THEN 'raw' WHEN 1 THEN 'alert' ELSE 'stream' END AS source,
  CASE WHEN n % 4 <> 0 THEN 'political_signals' END AS event_type,
  CASE WHEN n % 4 IN (1, 2) THEN message_text END AS p_text, CASE WHEN n % 4 <> 0 THEN local_rule_tags END AS p_tags,
  CASE WHEN n % 4 <> 0 THEN actor END AS p_actor, CASE WHEN n % 4 = 1 THEN 'high_local_risk' END AS p_alert,
  CASE WHEN n % 4 <> 0 THEN local_risk_score END AS p_score, CASE WHEN n % 8 = 2 THEN 'alto' END AS p_level,
  CASE WHEN n % 4 = 0 THEN message_raw END AS message_raw FROM signals)"""


def _fed(spark, sf):
    df = add_signals(comments(spark, sf), rules("s"), TEST_ACTORS)
    n = F.col("row_number").cast("long")
    q = n % 4
    payload = F.struct(
        F.lit(None).cast("string").alias("stream_text"), F.when(q.isin(1, 2), F.col("message_text")).alias("message_text"),
        F.lit(None).cast("string").alias("message_clean"), F.lit(None).cast("string").alias("message_raw"),
        F.lit(None).cast("string").alias("hybrid_risk_reason"), F.when(n % 8 == 2, "alto").alias("hybrid_risk_level"),
        F.lit(None).cast("string").alias("reason"), F.when(q != 0, F.col("local_rule_tags")).alias("local_rule_tags"),
        F.when(q != 0, F.col("local_risk_score")).alias("local_risk_score_stream"), F.when(q != 0, F.col("actor")).alias("actor"),
        F.when(q == 1, "high_local_risk").alias("alert_type"),
    )
    return df.select(
        "event_id", F.when(q == 0, "raw").when(q == 1, "alert").otherwise("stream").alias("source"),
        F.when(q != 0, "political_signals").alias("event_type"), payload.alias("payload"),
        F.lit(None).cast("string").alias("message_clean"), F.when(q == 0, F.col("message_raw")).alias("message_raw"),
        F.struct(F.lit(None).cast("string").alias("message_clean"), F.lit(None).cast("string").alias("message_raw")).alias("raw"),
    )


_TEXT = "coalesce(nullif(p_text, ''), nullif(message_raw, ''), event_type, '')"
_TAGS = """array_to_string(list_filter(list_concat([event_type], string_split(coalesce(p_tags, ''), '|'),
  [CASE WHEN p_level <> '' THEN 'risk:' || p_level END, p_actor, p_alert, CASE WHEN source = 'raw' THEN 'raw_youtube_chat' END]), lambda t: t <> '')[1:4], ',')"""


@query("b20_is_categorised", S.chain(S.COMMENTS, S.SIGNALS, _EVENTS, final="""
SELECT event_id, (coalesce(p_text, '') <> '' OR coalesce(message_raw, '') <> '')
  AND (coalesce(p_tags, '') <> '' OR coalesce(p_score, 0) <> 0 OR coalesce(p_actor, '') <> '' OR coalesce(p_alert, '') <> '') AS categorised FROM fed"""))
def b20(spark, sf):
    return _fed(spark, sf).select("event_id", FD.is_categorised().alias("categorised"))


@query("b21_search", S.chain(S.COMMENTS, S.SIGNALS, _EVENTS, final=f"""
SELECT event_id FROM fed WHERE contains(lower(concat_ws(' ', {_TEXT}, coalesce(event_type, ''), coalesce(p_actor, ''), coalesce(p_alert, ''), 'job ' || source, replace({_TAGS}, ',', ' '))), 'of the')
UNION ALL SELECT 'tag:' || event_id FROM fed WHERE contains(lower(concat_ws(' ', {_TEXT}, 'job ' || source, replace({_TAGS}, ',', ' '))), 'job alert')
UNION ALL SELECT 'risk:' || event_id FROM fed WHERE contains(lower(concat_ws(' ', {_TEXT}, 'job ' || source, replace({_TAGS}, ',', ' '))), 'risk:alto')"""))
def b21(spark, sf):
    columns = [FD.event_text(), "event_type", "payload.actor", "payload.alert_type", "job_name", F.array_join(FD.event_tags(), " ")]
    events = _fed(spark, sf).withColumn("job_name", F.concat(F.lit("job "), "source"))
    some = [columns[0], *columns[4:]]
    by_tag = FD.search(events, "Job alert", some).select(F.concat(F.lit("tag:"), "event_id").alias("event_id"))
    by_risk = FD.search(events, "RISK:alto", some).select(F.concat(F.lit("risk:"), "event_id").alias("event_id"))
    return FD.search(events, "  OF the ", columns).select("event_id").union(by_tag).union(by_risk)


@query("b22_event_text_tags", S.chain(S.COMMENTS, S.SIGNALS, _EVENTS, final=f"SELECT event_id, {_TEXT} AS text, {_TAGS} AS tags FROM fed"))
def b22(spark, sf):
    return _fed(spark, sf).select("event_id", FD.event_text().alias("text"), F.array_join(FD.event_tags(), ",").alias("tags"))
