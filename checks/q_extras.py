"""Historical profile and operational measures (families N and K01-K03, K05, K10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.data import TEST_TERMS, comments, read, rules
from checks.registry import query
from murmullo.functions import noise
from murmullo.functions.lexicon import fold_lexicon
from murmullo.operators import corpus as C
from murmullo.operators import joins as J
from murmullo.operators.rules import add_rules
from checks import tables
from murmullo.session import scratch_path
from murmullo.sources import topics
from murmullo.streaming import jobs, runner
from checks.q_streams import topic_stream
from checks.q_text import _NOISES, _NOISY, _noisy

_PREPARED = f"""
prepared AS (SELECT *, CAST(label AS DOUBLE) AS label_original, CASE WHEN label IN (0, 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label_binary,
  {S.clean('comment')} AS text_clean FROM corpus WHERE length({S.clean('comment')}) > 0)"""


@query("k01_prepare_corpus", S.chain(S.CORPUS, _PREPARED, final="""
SELECT comment_id, label_original, label_binary, sha256(comment) AS raw_digest, sha256(text_clean) AS clean_digest FROM prepared"""))
def k01(spark, sf):
    return C.prepare_corpus(tables.corpus(spark, sf)).select(
        "comment_id", "label_original", "label_binary", F.sha2("text_raw", 256).alias("raw_digest"), F.sha2("text_clean", 256).alias("clean_digest"))


@query("k02_enrich_labels", S.chain(S.CORPUS, final="""
SELECT comment_id, CASE label WHEN 0 THEN 'ofensivo_directo' WHEN 1 THEN 'odio_agresion_grupal' WHEN 2 THEN 'neutral_no_ofensivo' ELSE 'vulgaridad_contextual' END AS label_name,
  CASE WHEN label = 2 THEN 0 ELSE 1 END AS label_binary, CASE WHEN label = 2 THEN 'no_ofensivo' ELSE 'ofensivo_o_toxico' END AS label_binary_name FROM corpus"""))
def k02(spark, sf):
    return C.enrich_labels(tables.corpus(spark, sf)).select("comment_id", "label_name", "label_binary", "label_binary_name")


@query("k03_balanced_weights", S.chain(S.CORPUS, _PREPARED, final="""
SELECT comment_id, label_binary, (SELECT count(*) FROM prepared)::DOUBLE / ((SELECT count(DISTINCT label_binary) FROM prepared) * count(*) OVER (PARTITION BY label_binary)) AS weight_binary FROM prepared"""))
def k03(spark, sf):
    return J.attach_class_weight(C.prepare_corpus(tables.corpus(spark, sf)), "label_binary", "weight_binary").select("comment_id", "label_binary", "weight_binary")


_STOPS = ", ".join(S.lit(w) for w in C.FALLBACK_STOP_WORDS)


@query("k05_tfidf_table", S.chain(S.CORPUS, _PREPARED, f"""
words AS (SELECT comment_id, UNNEST(regexp_split_to_array(text_clean, '[^a-zA-Z0-9_]+')) AS token FROM prepared),
kept AS (SELECT * FROM words WHERE length(token) >= 2 AND token NOT IN ({_STOPS}))""", final="""
SELECT token, count(*) AS tf, count(DISTINCT comment_id) AS df, ln(((SELECT count(*) FROM prepared) + 1)::DOUBLE / (count(DISTINCT comment_id) + 1)) AS idf FROM kept GROUP BY token"""))
def k05(spark, sf):
    return C.tfidf_table(C.prepare_corpus(tables.corpus(spark, sf)))


@query("k10_split_distribution", S.chain(S.CORPUS, final="SELECT split, label AS value, count(*) AS count FROM corpus GROUP BY ALL"))
def k10(spark, sf):
    return C.split_distribution(tables.splits(spark, sf), "label")


_WORDS = f"words AS (SELECT UNNEST(string_split_regex({S.norm('text')}, '[ :]+')) AS word FROM documents)"


@query("n01_top_words", S.chain(_WORDS, final=f"""
SELECT word, count(*) AS uses FROM words WHERE length(word) >= 2 AND word NOT IN ({_STOPS}) GROUP BY word ORDER BY uses DESC, word LIMIT 20"""))
def n01(spark, sf):
    return C.top_words(read(spark, sf, "documents"), F.col("text"), 20, C.FALLBACK_STOP_WORDS)


_POLITICAL = tuple(t for t in fold_lexicon(rules("v1").lexicon)["political_mention"] if " " not in t)


@query("n01_top_political_words", S.chain(_WORDS, final=f"""
SELECT word, count(*) AS uses FROM words WHERE word IN ({', '.join(S.lit(w) for w in _POLITICAL)}) AND length(word) >= 2 GROUP BY word ORDER BY uses DESC, word LIMIT 20"""))
def n01_political(spark, sf):
    return C.top_words(read(spark, sf, "documents"), F.col("text"), 20, only=_POLITICAL)


@query("n01_top_hashtags", """
WITH tagged AS (SELECT '#' || source || ' ' || text || ' #Éxito_' || lang AS t FROM documents),
tags AS (SELECT UNNEST(regexp_extract_all(lower(t), '#([\\p{L}\\p{N}_]+)', 1)) AS hashtag FROM tagged)
SELECT hashtag, count(*) AS uses FROM tags GROUP BY hashtag ORDER BY uses DESC, hashtag LIMIT 20""")
def n01_hashtags(spark, sf):
    text = F.concat(F.lit("#"), "source", F.lit(" "), "text", F.lit(" #Éxito_"), "lang")
    return C.top_hashtags(read(spark, sf, "documents"), text, 20)


@query("n01_comments_per_video", S.chain(S.COMMENTS, final="SELECT video_id, count(*) AS comments FROM comments GROUP BY video_id"))
def n01_videos(spark, sf):
    return C.comments_per_video(comments(spark, sf))


@query("n01_repetitive_authors", """
SELECT source AS author, count(*) AS messages, count(*) - count(DISTINCT text) AS repeats FROM documents GROUP BY source ORDER BY repeats DESC, messages DESC, author LIMIT 20""")
def n01_authors(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("source").alias("author"), "text")
    return C.repetitive_authors(docs, F.col("text"), 20)


_EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
_REST = f"regexp_replace(t, '{_EMOJI}|\\s', '', 'g')"


@query("n02_emoji_features", S.chain(S.COMMENTS, _NOISY, f"counted AS (SELECT *, CAST(len(regexp_extract_all(t, '{_EMOJI}')) AS INTEGER) AS emoji_count FROM noisy)", final=f"""
SELECT event_id, emoji_count, emoji_count > 0 AND {_REST} = '' AS is_emoji_only, emoji_count = 1 AND {_REST} = '' AS is_single_emoji FROM counted"""))
def n02(spark, sf):
    t = F.col("t")
    return _noisy(spark, sf).select("event_id", noise.emoji_count(t).alias("emoji_count"), noise.is_emoji_only(t).alias("is_emoji_only"), noise.is_single_emoji(t).alias("is_single_emoji"))


def _event_stream(spark, sf):
    """The event table as a stream of six files, one a micro-batch, each with events of all times."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _EVENT_FILES:
        path = scratch_path(spark, "events")
        events = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
        events.withColumn("part", F.col("event_id") % 6).repartition("part").write.partitionBy("part").parquet(path)
        _EVENT_FILES[key] = path
    path = _EVENT_FILES[key]
    return topics.stream_table(spark, path, spark.read.parquet(path).schema, 1).drop("part")


_EVENT_FILES: dict = {}
_THROUGHPUT_SQL = """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) AS message_count,
  count(*) / 3600.0::DOUBLE AS throughput_msg_per_sec FROM events GROUP BY ALL"""


@query("n03_throughput", _THROUGHPUT_SQL)
def n03(spark, sf):
    return jobs.throughput(read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), 3600, time="ts")


@query("n03_throughput_stream", _THROUGHPUT_SQL)
def n03_stream(spark, sf):
    found = runner.run_partials(_event_stream(spark, sf), lambda e: jobs.throughput_partials(e, 3600, "ts"), "throughput", scratch_path(spark, "stream"), jobs.throughput_merge)
    return jobs.throughput_totals(found, 3600)


_LATENCY_SQL = """
WITH l AS (SELECT CAST(floor(value * 10) AS BIGINT) AS ms FROM events)
SELECT avg(ms) AS avg_latency_ms, quantile_cont(ms, 0.5) AS p50_latency_ms, quantile_cont(ms, 0.95) AS p95_latency_ms, max(ms) AS max_latency_ms FROM l"""


def _stamped(events):
    base = F.timestamp_millis(F.lit(1704067200000))
    later = F.timestamp_millis(F.lit(1704067200000) + F.floor(F.col("value") * 10).cast("long"))
    return events.select(base.alias("a"), later.alias("b"))


@query("n04_latency_stats", _LATENCY_SQL)
def n04(spark, sf):
    return jobs.latency_stats(_stamped(read(spark, sf, "events")), "a", "b")


@query("n04_latency_stats_stream", _LATENCY_SQL)
def n04_stream(spark, sf):
    stream = _event_stream(spark, sf)
    found = runner.run_partials(jobs.latencies(_stamped(stream), "a", "b"), jobs.latency_partials, "latency", scratch_path(spark, "stream"), jobs.latency_merge)
    # the percentiles' bins are read again from the files the stream has read
    files = spark.read.parquet(_EVENT_FILES[spark.sparkContext.applicationId, sf])
    return jobs.exact_latency_stats(found, jobs.latencies(_stamped(files), "a", "b"))


@query("n04_latency_bins", """
WITH l AS (SELECT CAST(floor(value * 10) AS BIGINT) AS ms FROM events),
b AS (SELECT *, CAST(floor(log2(abs(ms) + 1) * 64) * sign(ms) AS INTEGER) AS bin FROM l)
SELECT bin, count(*) AS n, CAST(sum(ms) AS BIGINT) AS total, min(ms) AS least, max(ms) AS most FROM b GROUP BY bin""")
def n04_bins(spark, sf):
    found = runner.run_partials(jobs.latencies(_stamped(_event_stream(spark, sf)), "a", "b"), jobs.latency_partials, "latency", scratch_path(spark, "stream"), jobs.latency_merge)
    return jobs.latency_merge(found).drop("sketch")


_THRESHOLD_SQL = S.chain(S.COMMENTS, S.rules_cte("v1"), """
w AS (SELECT time_bucket(INTERVAL 10 SECOND, kafka_timestamp) AS window_start, count(*) FILTER (WHERE has_fraude) AS hits, count(*) AS comments FROM ruled GROUP BY 1)""",
                         final="SELECT window_start, window_start + INTERVAL 10 SECOND AS window_end, hits, comments FROM w WHERE hits >= 3")


@query("n05_threshold_alerts", _THRESHOLD_SQL)
def n05(spark, sf):
    flagged = add_rules(comments(spark, sf), rules("v1"), columns=["has_fraude"])
    return jobs.threshold_alerts(flagged, F.col("has_fraude"), "10 seconds", 3)


@query("n05_threshold_alerts_stream", _THRESHOLD_SQL)
def n05_stream(spark, sf):
    def hits(events):
        return jobs.threshold_partials(add_rules(events, rules("v1"), columns=["has_fraude"]), F.col("has_fraude"), "10 seconds")

    found = runner.run_partials(topic_stream(spark, sf, 1), hits, "threshold", scratch_path(spark, "stream"), jobs.threshold_merge)
    return jobs.threshold_totals(found, 3)
