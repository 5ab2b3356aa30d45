"""Stream queries (family J): real runs over a landed topic, compared with SQL over the same comments.

The topic lies in a folder per topic partition, in files of bounded size, and windowed streams read as many files per micro-batch
as a partition has, so partitions advance unevenly; their result is still compared with all comments.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S, tables
from checks.data import TEST_ACTORS, comments, read, rules
from checks.q_ingest import _topic_rows
from checks.q_rules import ALERTS_SQL
from checks.registry import query
from murmullo.session import scratch_path
from murmullo.sources import topics
from murmullo.streaming import jobs, runner

WINDOW = "10 seconds"
FILE_BYTES = 16 << 20  # message bytes of a topic partition that go to one file, written by one task
_LANDED: dict = {}


def _topic(spark, sf) -> tuple[str, int]:
    """The topic of a data folder as parquet files, landed once per application, and how many files its fullest partition needs."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LANDED:
        path = scratch_path(spark, "topic")
        sizes = comments(spark, sf).groupBy("kafka_partition").agg(F.sum(F.octet_length("message_raw")).alias("bytes"))
        files = 1 + (sizes.agg(F.max("bytes")).first()[0] or 0) // FILE_BYTES
        rows = _topic_rows(spark, sf).withColumn("part", F.col("partition"))
        # every partition in as many files, by the offset: hashes of so few keys would put several of them into one task
        place = F.col("part") * files + F.pmod(F.col("offset"), F.lit(files))
        rows.repartitionById(tables.PARTITIONS * files, place.cast("int")).write.partitionBy("part").parquet(path)
        _LANDED[key] = path, files
    return _LANDED[key]


def topic_stream(spark, sf, partitions_per_batch=None):
    path, files = _topic(spark, sf)
    per_batch = partitions_per_batch and partitions_per_batch * files
    return topics.parse_events(topics.stream_table(spark, path, spark.read.parquet(path).schema, per_batch).drop("part"))


def _run(spark, results, name):
    root = scratch_path(spark, "stream")
    runner.run_available(results, name, root)
    return spark.read.schema(results.schema).parquet(f"{root}/{name}")


_TEXT = S.norm("coalesce(nullif(message_clean, ''), nullif(message_raw, ''), '')", "stream")
_NORMAL = f"normal AS (SELECT *, {_TEXT} AS stream_text FROM comments)"
_POSITION = "kafka_topic, kafka_partition, kafka_offset, kafka_timestamp"


@query("j01_normalise", S.chain(S.COMMENTS, _NORMAL, final=f"""
SELECT event_id, stream_text, {S.utf16_length('stream_text')} AS message_length, stream_text = '' AS is_empty_message, {_POSITION} FROM normal"""))
def j01(spark, sf):
    return _run(spark, jobs.normalise(topic_stream(spark, sf, 1)), "normalise")


_METRICS = f"""
metrics AS (SELECT time_bucket(INTERVAL 10 SECOND, kafka_timestamp) AS window_start, count(*) AS comment_count,
  count(DISTINCT author) AS unique_authors, avg({S.utf16_length('stream_text')}) AS avg_message_length,
  count(*) FILTER (WHERE stream_text = '') AS empty_count,
  count(*) FILTER (WHERE length(stream_text) <= 2 OR contains(stream_text, ':orange_heart:')) AS spam_like_count FROM normal GROUP BY 1)"""
_WINDOW_OUT = "window_start, window_start + INTERVAL 10 SECOND AS window_end"
_METRIC_COLUMNS = "comment_count, unique_authors, avg_message_length, empty_count, spam_like_count"


@query("j02_window_metrics", S.chain(S.COMMENTS, _NORMAL, _METRICS, final=f"SELECT {_WINDOW_OUT}, {_METRIC_COLUMNS} FROM metrics"))
def j02(spark, sf):
    return jobs.window_metrics(comments(spark, sf), WINDOW)


@query("j02_window_metrics_stream", S.chain(S.COMMENTS, _NORMAL, _METRICS, final=f"SELECT {_WINDOW_OUT}, {_METRIC_COLUMNS} FROM metrics"))
def j02_stream(spark, sf):
    root = scratch_path(spark, "stream")
    return jobs.window_totals(runner.run_partials(topic_stream(spark, sf, 1), lambda e: jobs.window_partials(e, WINDOW), "window_metrics", root, jobs.window_merge))


@query("j03_signals", S.chain(S.COMMENTS, S.SIGNALS, final=f"""
SELECT event_id, {', '.join(S.FLAGS)}, local_risk_score AS local_risk_score_stream, local_rule_tags, actor, {_POSITION} FROM signals"""))
def j03(spark, sf):
    return _run(spark, jobs.signals(topic_stream(spark, sf, 1), rules("s"), TEST_ACTORS), "signals")


_ACTORS = """
per_actor AS (SELECT actor, time_bucket(INTERVAL 10 SECOND, kafka_timestamp) AS window_start, count(*) AS mention_count,
  count(*) FILTER (WHERE has_general_insult) AS insult_count, count(*) FILTER (WHERE has_fraude) AS fraud_count,
  count(*) FILTER (WHERE has_terruqueo) AS terruqueo_count, count(*) FILTER (WHERE has_discriminatory_language) AS discriminatory_count
  FROM signals WHERE actor <> '' GROUP BY ALL)"""
_ACTOR_OUT = f"""SELECT actor, {_WINDOW_OUT}, mention_count, insult_count, fraud_count, terruqueo_count, discriminatory_count,
  insult_count + fraud_count + terruqueo_count + discriminatory_count AS polarization_score FROM per_actor"""


@query("j04_actor_polarisation", S.chain(S.COMMENTS, S.SIGNALS, _ACTORS, final=_ACTOR_OUT))
def j04(spark, sf):
    return jobs.actor_polarisation(comments(spark, sf), WINDOW, rules=rules("s"), actors=TEST_ACTORS)


@query("j04_actor_polarisation_stream", S.chain(S.COMMENTS, S.SIGNALS, _ACTORS, final=_ACTOR_OUT))
def j04_stream(spark, sf):
    root = scratch_path(spark, "stream")
    found = runner.run_partials(topic_stream(spark, sf, 1), lambda e: jobs.actor_partials(e, WINDOW, rules("s"), TEST_ACTORS), "actors", root, jobs.actor_merge)
    return jobs.actor_totals(found)


@query("j05_risk_alerts", S.chain(S.COMMENTS, S.SIGNALS, ALERTS_SQL, final="SELECT * FROM alerts"))
def j05(spark, sf):
    return _run(spark, jobs.risk_alerts(topic_stream(spark, sf), rules("s"), TEST_ACTORS), "alerts")


_SPLIT_SQL = S.chain(S.COMMENTS, final="SELECT kafka_partition, count(*) AS rows, count(*) AS ids FROM comments GROUP BY 1")


@query("j06_restart_from_checkpoint", _SPLIT_SQL)
def j06(spark, sf):
    # a run that is stopped half way, new data in the topic, and a restart that goes on from the checkpoint
    root, topic = scratch_path(spark, "stream"), scratch_path(spark, "growing")
    path, files = _topic(spark, sf)
    landed = spark.read.parquet(path)

    def events():
        return topics.parse_events(topics.stream_table(spark, topic, landed.schema, files).drop("part"))

    landed.where("part < 2").repartition(2 * files, "offset").write.partitionBy("part").parquet(topic)
    runner.run_available(jobs.normalise(events()), "normalise", root, messages=1)
    landed.where("part >= 2").write.mode("append").partitionBy("part").parquet(topic)
    for _ in range(2):
        runner.run_available(jobs.normalise(events()), "normalise", root)
    rows = spark.read.parquet(f"{root}/normalise")
    return rows.groupBy("kafka_partition").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("ids"))


@query("j07_bounded_run", _SPLIT_SQL)
def j07(spark, sf):
    root = scratch_path(spark, "stream")
    # stops at the first micro-batch that reaches the number of messages; the next run reads the rest
    runner.run_available(jobs.normalise(topic_stream(spark, sf, 1)), "bounded", root, timeout=600, messages=1, idle=300)
    runner.run_available(jobs.normalise(topic_stream(spark, sf, 1)), "bounded", root, timeout=600)
    return spark.read.parquet(f"{root}/bounded").groupBy("kafka_partition").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("ids"))


_FAN_SQL = S.chain(S.COMMENTS, S.SIGNALS, ALERTS_SQL, final="""
SELECT 'normalise' AS query, count(*) AS rows FROM comments UNION ALL SELECT 'signals', count(*) FROM signals UNION ALL SELECT 'alerts', count(*) FROM alerts""")


def _fan_queries():
    return {
        "normalise": jobs.normalise,
        "signals": lambda e: jobs.signals(e, rules("s"), TEST_ACTORS),
        "alerts": lambda e: jobs.risk_alerts(e, rules("s"), TEST_ACTORS),
    }


def _fan_counts(spark, root):
    parts = None
    for name in _fan_queries():
        part = spark.read.parquet(f"{root}/{name}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("query"), "rows")
        parts = part if parts is None else parts.unionByName(part)
    return parts


@query("j08_fan_out", _FAN_SQL)
def j08(spark, sf):
    root = scratch_path(spark, "fan")
    for q in runner.fan_out(topic_stream(spark, sf), _fan_queries(), root).values():
        q.awaitTermination()
    return _fan_counts(spark, root)


@query("j08_fan_out_shared", _FAN_SQL)
def j08_shared(spark, sf):
    root = scratch_path(spark, "fan")
    runner.fan_out_shared(topic_stream(spark, sf, 2), _fan_queries(), root)
    return _fan_counts(spark, root)


@query("j09_envelope", S.chain(S.COMMENTS, _NORMAL, final=f"""
SELECT event_id, json_object('job_name', 'flink_job1_normalize_stream', 'event_type', 'normalized_comment', 'source_topic', kafka_topic, 'source_partition', kafka_partition,
  'source_offset', kafka_offset, 'payload', json_object('event_id', event_id, 'stream_text', stream_text, 'message_length', {S.utf16_length('stream_text')},
  'is_empty_message', stream_text = ''))::VARCHAR AS value FROM normal"""))
def j09(spark, sf):
    value = jobs.envelope(jobs.normalise(comments(spark, sf)), jobs.NORMALISE, with_time=False)
    return value.select(F.get_json_object("value", "$.payload.event_id").alias("event_id"), "value")


@query("a06_stream_topic", _SPLIT_SQL)
def a06(spark, sf):
    events = topic_stream(spark, sf, 1).select("kafka_partition", "event_id")
    return _run(spark, events, "topic").groupBy("kafka_partition").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("ids"))


@query("a11_envelope_sink", S.chain(S.COMMENTS, S.SIGNALS, ALERTS_SQL, final="""
SELECT alert_id, alert_type, 'risk_alert' AS event_type, CAST(kafka_offset AS BIGINT) AS source_offset FROM alerts"""))
def a11(spark, sf):
    out = jobs.envelope(jobs.risk_alerts(topic_stream(spark, sf), rules("s"), TEST_ACTORS), jobs.ALERTS)
    v = F.col("value")
    return _run(spark, out, "alert_topic").select(
        F.get_json_object(v, "$.payload.alert_id").alias("alert_id"), F.get_json_object(v, "$.payload.alert_type").alias("alert_type"),
        F.get_json_object(v, "$.event_type").alias("event_type"), F.get_json_object(v, "$.source_offset").cast("long").alias("source_offset"))


# --- sessions by event time ---

GAP, LATENESS = "10 seconds", "20 seconds"
_SESSIONS = """
placed AS (SELECT *, kafka_timestamp - lag(kafka_timestamp) OVER (PARTITION BY who ORDER BY kafka_timestamp) AS since FROM {source}),
islands AS (SELECT *, sum(CASE WHEN since IS NULL OR since > INTERVAL 10 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY who ORDER BY kafka_timestamp ROWS UNBOUNDED PRECEDING) AS island FROM placed),
sessions AS (SELECT who AS author, min(kafka_timestamp) AS session_start, max(kafka_timestamp) + INTERVAL 10 SECOND AS session_end, count(*) AS comments, avg(len) AS avg_message_length FROM islands GROUP BY who, island)"""
_TIMED = f"timed AS (SELECT *, coalesce(author, '') AS who, {S.utf16_length('stream_text')} AS len, kafka_partition * 2 + kafka_offset % 2 AS batch FROM normal)"
_SESSION_SQL = S.chain(S.COMMENTS, _NORMAL, _TIMED, _SESSIONS.format(source="timed"), final="SELECT * FROM sessions")


@query("j10_sessions", _SESSION_SQL)
def j10(spark, sf):
    return jobs.author_sessions(comments(spark, sf), GAP)


@query("j10_sessions_native", _SESSION_SQL)
def j10_native(spark, sf):
    return jobs.native_sessions(comments(spark, sf), GAP)


@query("j10_sessions_stream", _SESSION_SQL)
def j10_stream(spark, sf):
    # topic partitions advance unevenly; nothing is late without a watermark
    root = scratch_path(spark, "stream")
    found = runner.run_partials(topic_stream(spark, sf, 1), lambda e: jobs.session_partials(e, GAP), "sessions", root, jobs.session_merge)
    return jobs.session_totals(found, GAP)


_RUNS: dict = {}


def _event_time(spark, sf):
    """Sessions with a watermark over six slices of the topic, one a micro-batch: each topic partition after the other, in two halves."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        topic, root = scratch_path(spark, "slices"), scratch_path(spark, "stream")
        landed = spark.read.parquet(_topic(spark, sf)[0])
        for batch in range(6):  # a slice has any number of files: the run goes on from its checkpoint as each slice comes
            slice_rows = landed.where((F.col("part") == batch // 2) & (F.col("offset") % 2 == batch % 2)).drop("part")
            slice_rows.write.mode("append").parquet(topic)
            events = topics.parse_events(topics.stream_table(spark, topic, slice_rows.schema))
            _RUNS[key] = runner.run_event_time(events, lambda e: jobs.session_partials(e, GAP), "sessions", root, LATENESS, jobs.session_merge, jobs.EVENT_TIME, "last")
    return _RUNS[key]


_WATERMARKS = """
tops AS (SELECT batch, max(kafka_timestamp) AS top FROM timed GROUP BY batch),
marks AS (SELECT batch, (SELECT max(top) FROM tops t WHERE t.batch < tops.batch) - INTERVAL 20 SECOND AS mark FROM tops),
marked AS (SELECT timed.*, coalesce(kafka_timestamp < mark, false) AS late FROM timed JOIN marks USING (batch)),
taken AS (SELECT * FROM marked WHERE NOT late)"""


@query("j10_sessions_event_time", S.chain(S.COMMENTS, _NORMAL, _TIMED, _WATERMARKS, _SESSIONS.format(source="taken"), final="""
SELECT *, session_end < (SELECT max(top) FROM tops) - INTERVAL 20 SECOND AS is_closed FROM sessions"""))
def j10_event_time(spark, sf):
    found, _, watermark = _event_time(spark, sf)
    return jobs.session_totals(found, GAP, watermark)


@query("j10_late_events", S.chain(S.COMMENTS, _NORMAL, _TIMED, _WATERMARKS, final=f"SELECT event_id, {_POSITION} FROM marked WHERE late"))
def j10_late(spark, sf):
    _, late, _ = _event_time(spark, sf)
    return late.select("event_id", "kafka_topic", "kafka_partition", "kafka_offset", "kafka_timestamp")


@query("j10_balance", S.chain(S.COMMENTS, _NORMAL, _TIMED, _WATERMARKS, final="""
SELECT count(*) FILTER (WHERE NOT late) AS taken, count(*) FILTER (WHERE late) AS late, count(*) AS events FROM marked"""))
def j10_balance(spark, sf):
    found, late, _ = _event_time(spark, sf)
    taken = jobs.session_totals(found, GAP).select(F.col("comments").alias("taken"), F.lit(0).cast("long").alias("late"))
    return taken.union(late.select(F.lit(0).cast("long"), F.lit(1).cast("long"))).agg(
        F.sum("taken").alias("taken"), F.sum("late").alias("late"), F.sum(F.col("taken") + F.col("late")).alias("events"))
