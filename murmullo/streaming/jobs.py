"""The five stream queries. Each takes parsed events and works on static and streaming frames alike.

Windowed queries are a partial and a total half. A stream writes the partial counts of every micro-batch,
and reading adds them up: no state is held, no event is too late, and a window that is still open shows what
has come so far. A topic read with uneven partitions therefore gives the same windows as an even one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from murmullo.functions import text
from murmullo.functions.lexicon import NOISE_SHORTCODE, RuleProfile
from murmullo.operators.rules import FLAG_COLUMNS, add_signals, alerts
from murmullo.session import materialize
from murmullo.sources.topics import ALERTS_TOPIC, RAW_TOPIC, RESULTS_TOPIC

# Job name, event type and target topic of each query.
NORMALISE = ("flink_job1_normalize_stream", "normalized_comment", RESULTS_TOPIC)
WINDOW_METRICS = ("flink_job2_window_metrics", "window_metrics", RESULTS_TOPIC)
SIGNALS = ("flink_job3_political_signals", "political_signals", RESULTS_TOPIC)
ACTORS = ("flink_job4_actor_polarization", "actor_polarization_window", RESULTS_TOPIC)
ALERTS = ("flink_job5_risk_alerts", "risk_alert", ALERTS_TOPIC)
WINDOW = "2 seconds"
SHORT_NOISE = 2

EVENT_TIME = "kafka_timestamp"


def _stream_text() -> Column:
    return text.norm_stream(text.main_text(F.col("message_clean"), F.col("message_raw")))


def normalise(events: DataFrame) -> DataFrame:
    """Stream text, its length in UTF-16 units and the empty flag of every comment."""
    return events.withColumn("stream_text", _stream_text()).select(
        F.coalesce("event_id", F.lit("")).alias("event_id"),
        "stream_text",
        text.message_length(F.col("stream_text"), "utf16").alias("message_length"),
        text.is_empty(F.col("stream_text")).alias("is_empty_message"),
        "kafka_topic", "kafka_partition", "kafka_offset", EVENT_TIME,
    )


def window_partials(events: DataFrame, duration: str = WINDOW) -> DataFrame:
    """Counts of the given events per window and author, to be added up by ``window_totals``.

    Splitting a window by author spreads a busy window over tasks and keeps the number of authors exact.
    """
    shaped = events.select(EVENT_TIME, F.coalesce("author", F.lit("")).alias("author"), _stream_text().alias("_t"))
    shaped = shaped.withColumn("_len", text.message_length(F.col("_t"), "utf16"))
    noisy = (F.col("_len") <= SHORT_NOISE) | F.contains("_t", F.lit(NOISE_SHORTCODE))
    return shaped.groupBy(F.window(EVENT_TIME, duration), "author").agg(
        F.count(F.lit(1)).alias("comments"),
        F.sum("_len").alias("chars"),
        F.count_if(F.col("_len") == 0).alias("empty"),
        F.count_if(noisy).alias("noise"),
    )


def window_merge(partials: DataFrame) -> DataFrame:
    """Partial counts of several micro-batches added up."""
    return partials.groupBy("window", "author").agg(*[F.sum(c).alias(c) for c in ("comments", "chars", "empty", "noise")])


def window_totals(partials: DataFrame) -> DataFrame:
    """Comments, exact number of authors, mean length, empty and noise-like comments per window."""
    per_window = window_merge(partials).groupBy("window").agg(
        F.sum("comments").alias("comment_count"),
        F.count_if(F.col("author") != "").alias("unique_authors"),
        F.sum("chars").alias("_chars"),
        F.sum("empty").alias("empty_count"),
        F.sum("noise").alias("spam_like_count"),
    )
    return per_window.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "comment_count", "unique_authors",
        (F.col("_chars") / F.col("comment_count")).alias("avg_message_length"),
        "empty_count", "spam_like_count",
    )


def window_metrics(events: DataFrame, duration: str = WINDOW) -> DataFrame:
    """Window metrics of a batch. A stream runs its two halves: see ``runner.run_partials``."""
    return window_totals(window_partials(events, duration))


def signals(events: DataFrame, rules: str | RuleProfile = "s", actors=None) -> DataFrame:
    """Rule flags, score, tags and actor of every comment."""
    return add_signals(events, rules, actors).select(
        F.coalesce("event_id", F.lit("")).alias("event_id"),
        *FLAG_COLUMNS,
        F.col("local_risk_score").alias("local_risk_score_stream"),
        "local_rule_tags", "actor",
        "kafka_topic", "kafka_partition", "kafka_offset", EVENT_TIME,
    )


ACTOR_COUNTS = {
    "mention_count": None, "insult_count": "has_general_insult", "fraud_count": "has_fraude",
    "terruqueo_count": "has_terruqueo", "discriminatory_count": "has_discriminatory_language",
}


def actor_partials(events: DataFrame, duration: str = WINDOW, rules: str | RuleProfile = "s", actors=None) -> DataFrame:
    """Mentions and hostile signals of the given events per political actor and window; other comments are left out."""
    needed = [flag for flag in ACTOR_COUNTS.values() if flag]
    flagged = add_signals(events, rules, actors, needed).where("actor != ''")
    counts = [(F.count_if(flag) if flag else F.count(F.lit(1))).alias(name) for name, flag in ACTOR_COUNTS.items()]
    return flagged.groupBy(F.window(EVENT_TIME, duration), "actor").agg(*counts)


def actor_merge(partials: DataFrame) -> DataFrame:
    """Partial counts of several micro-batches added up."""
    return partials.groupBy("window", "actor").agg(*[F.sum(c).alias(c) for c in ACTOR_COUNTS])


def actor_totals(partials: DataFrame) -> DataFrame:
    """Partial counts added up, with the polarisation score."""
    grouped = actor_merge(partials)
    hostile = F.col("insult_count") + F.col("fraud_count") + F.col("terruqueo_count") + F.col("discriminatory_count")
    return grouped.select(
        "actor", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *ACTOR_COUNTS, hostile.alias("polarization_score"),
    )


def actor_polarisation(events: DataFrame, duration: str = WINDOW, rules: str | RuleProfile = "s", actors=None) -> DataFrame:
    """Polarisation per actor and window of a batch. A stream runs its two halves: see ``runner.run_partials``."""
    return actor_totals(actor_partials(events, duration, rules, actors))


def risk_alerts(events: DataFrame, rules: str | RuleProfile = "s", actors=None) -> DataFrame:
    """Alert records of the comments that meet an alert condition."""
    return alerts(add_signals(events, rules, actors))


def envelope(results: DataFrame, job: tuple[str, str, str], with_time: bool = True) -> DataFrame:
    """Results as JSON messages: one column ``value`` with the payload inside the common frame.

    Window results have no source position: partition and offset are -1.
    """
    job_name, event_type, _ = job
    position = {"kafka_topic": F.lit(RAW_TOPIC), "kafka_partition": F.lit(-1), "kafka_offset": F.lit(-1).cast("long")}
    topic, partition, offset = [F.col(c) if c in results.columns else default for c, default in position.items()]
    payload = F.struct(*[c for c in results.columns if c not in (*position, EVENT_TIME)])
    stamp = [F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("processing_ts")] if with_time else []
    frame = F.struct(
        F.lit(job_name).alias("job_name"), F.lit(event_type).alias("event_type"), *stamp,
        topic.alias("source_topic"), partition.alias("source_partition"), offset.alias("source_offset"),
        payload.alias("payload"),
    )
    return results.select(F.to_json(frame).alias("value"))


# --- sessions -------------------------------------------------------------------------------------


def native_sessions(events: DataFrame, gap: str, lateness: str | None = None, time: str = EVENT_TIME) -> DataFrame:
    """Sessions per author by Spark's session windows, for batches and for streams.

    As a stream it holds state until the watermark has passed a session, and Spark drops what comes later than ``lateness``
    without a trace; ``runner.run_event_time`` over the halves below keeps late events.
    """
    timed = events if lateness is None else events.withWatermark(time, lateness)
    length = text.message_length(_stream_text(), "utf16")
    shaped = timed.select(time, F.coalesce("author", F.lit("")).alias("author"), length.alias("_len"))
    return shaped.groupBy("author", F.session_window(time, gap).alias("s")).agg(F.count(F.lit(1)).alias("comments"), F.avg("_len").alias("avg_message_length")).select(
        "author", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "comments", "avg_message_length")


def _micros(gap: str) -> Column:
    return F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {gap})")


def session_partials(events: DataFrame, gap: str, time: str = EVENT_TIME) -> DataFrame:
    """Events per author and slot of time as wide as the gap: first, last, comments, chars.

    Events of one slot are closer than the gap, so they belong to one session whatever else comes, and a busy author
    is down to one row a slot before any shuffle.
    """
    shaped = events.where(F.col(time).isNotNull()).select(
        F.coalesce("author", F.lit("")).alias("author"), F.floor(F.unix_micros(time) / _micros(gap)).alias("slot"), F.col(time).alias("_at"),
        text.message_length(_stream_text(), "utf16").alias("_len"))
    return shaped.groupBy("author", "slot").agg(
        F.min("_at").alias("first"), F.max("_at").alias("last"), F.count(F.lit(1)).alias("comments"), F.sum("_len").alias("chars"))


def session_merge(partials: DataFrame) -> DataFrame:
    """Partial rows of several micro-batches added up."""
    return partials.groupBy("author", "slot").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("comments").alias("comments"), F.sum("chars").alias("chars"))


def session_totals(partials: DataFrame, gap: str, watermark: Column | None = None) -> DataFrame:
    """Sessions of every author: slots run together while the next event comes no later than the gap after the last.

    A session ends a gap after its last event, as Spark's session windows do. With a watermark, ``is_closed`` tells the sessions no later event can reach.
    """
    order = Window.partitionBy("author").orderBy("slot")
    before = F.unix_micros(F.lag("last").over(order))
    slots = session_merge(partials).withColumn("_opens", F.coalesce((F.unix_micros("first") - before > _micros(gap)).cast("int"), F.lit(1)))
    slots = slots.withColumn("_session", F.sum("_opens").over(order))
    end = F.col("_last") + F.expr(f"INTERVAL {gap}")
    sessions = slots.groupBy("author", "_session").agg(
        F.min("first").alias("session_start"), F.max("last").alias("_last"), F.sum("comments").alias("comments"), F.sum("chars").alias("_chars"))
    closed = [] if watermark is None else [(end < watermark).alias("is_closed")]
    return sessions.select("author", "session_start", end.alias("session_end"), "comments", (F.col("_chars") / F.col("comments")).alias("avg_message_length"), *closed)


def author_sessions(events: DataFrame, gap: str, time: str = EVENT_TIME) -> DataFrame:
    """Sessions per author of a batch. A stream runs the halves: see ``runner.run_partials`` and ``runner.run_event_time``."""
    return session_totals(session_partials(events, gap, time), gap)


# --- operational measures -------------------------------------------------------------------------


def throughput_partials(events: DataFrame, seconds: int, time: str = EVENT_TIME) -> DataFrame:
    """Messages per window of the given events."""
    return events.groupBy(F.window(time, f"{seconds} seconds")).agg(F.count(F.lit(1)).alias("message_count"))


def throughput_merge(partials: DataFrame) -> DataFrame:
    return partials.groupBy("window").agg(F.sum("message_count").alias("message_count"))


def throughput_totals(partials: DataFrame, seconds: int) -> DataFrame:
    return throughput_merge(partials).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "message_count",
        (F.col("message_count") / seconds).alias("throughput_msg_per_sec"),
    )


def throughput(events: DataFrame, seconds: int, time: str = EVENT_TIME) -> DataFrame:
    """Messages and messages per second of each window of a batch. A stream runs the halves and loses no late event."""
    return throughput_totals(throughput_partials(events, seconds, time), seconds)


BINS_PER_DOUBLING = 64  # neighbouring bins of latencies differ by 1.1 %
RANK_ERROR = 0.0133  # of a bin's latencies: the sketch's normalised error at its default size, with 99 % confidence


def latencies(events: DataFrame, ingested: str, processed: str) -> DataFrame:
    """Processed minus ingested in milliseconds, with its bin (logarithmic, some thousand at most); rows without both times are left out."""
    ms = F.unix_millis(processed) - F.unix_millis(ingested)
    rows = events.select(ms.alias("ms")).where("ms is not null")
    return rows.withColumn("bin", (F.floor(F.log2(F.abs("ms") + 1) * BINS_PER_DOUBLING) * F.signum(F.col("ms").cast("double"))).cast("int"))


def latency_partials(rows: DataFrame) -> DataFrame:
    """Latencies (ms, bin) per bin: number, sum, least, most, and a mergeable quantile sketch."""
    return rows.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ms").alias("total"), F.min("ms").alias("least"), F.max("ms").alias("most"), F.kll_sketch_agg_bigint("ms").alias("sketch"))


def latency_merge(partials: DataFrame) -> DataFrame:
    return partials.groupBy("bin").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_bigint("sketch").alias("sketch"))


def latency_totals(partials: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """From partial rows alone, one row for each quantile: latency_ms, and least_ms and most_ms of its bin, which hold the true one.

    The bin is exact. Inside it the sketch errs by at most ``RANK_ERROR`` of the bin's latencies.
    """
    merged = latency_merge(partials)
    starts, total = _bin_starts(merged)
    found = None
    for q in quantiles:
        rank = max(math.ceil(q * total), 1)
        for bin_, (start, n) in starts.items():
            if start < rank <= start + n:
                one = merged.where(F.col("bin") == bin_).select(
                    F.lit(float(q)).alias("quantile"), F.kll_sketch_get_quantile_bigint("sketch", F.lit((rank - start) / n)).alias("latency_ms"),
                    F.col("least").alias("least_ms"), F.col("most").alias("most_ms"))
                found = one if found is None else found.union(one)
    if found is None:
        return merged.sparkSession.createDataFrame([], "quantile double, latency_ms bigint, least_ms bigint, most_ms bigint")
    return found


def _bin_starts(merged: DataFrame) -> tuple[dict[int, tuple[int, int]], int]:
    """Latencies before each bin and in it, and in all; there are some thousand bins at most."""
    starts, before = {}, 0
    for b in merged.select("bin", "n").orderBy("bin").collect():
        starts[b.bin], before = (before, b.n), before + b.n
    return starts, before


def exact_latency_stats(partials: DataFrame, rows: DataFrame) -> DataFrame:
    """Average, median, 95th percentile and maximum, all exact: partial rows say which bins hold the wanted
    ranks, and only the latencies of those (at most four) bins are read again from ``rows``."""
    merged = latency_merge(partials)
    starts, total = _bin_starts(merged)
    places = {q: (total - 1) * q for q in (0.5, 0.95)}
    ranks = {rank(p) for p in places.values() for rank in (math.floor, math.ceil)} if total else set()
    wanted = [b for b, (start, n) in starts.items() if any(start <= r < start + n for r in ranks)]
    start = F.create_map(*[x for b in wanted for x in (F.lit(b), F.lit(starts[b][0]))])[F.col("bin")] if wanted else F.lit(0)
    inside = Window.partitionBy("bin").orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)
    counts = rows.where(F.col("bin").isin(wanted)).groupBy("bin", "ms").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("upto", start + F.sum("n").over(inside))

    def at(q: float) -> Column:
        """Value at a rank between two neighbours, as an exact percentile interpolates."""
        low, high = (F.min(F.when(F.col("upto") > rank(places[q]), F.col("ms"))) for rank in (math.floor, math.ceil))
        return low + (high - low) * F.lit(places[q] - math.floor(places[q]))

    whole = merged.agg((F.sum("total") / F.sum("n")).alias("average"), F.max("most").alias("most"))
    return ranked.agg(at(0.5).alias("p50_latency_ms"), at(0.95).alias("p95_latency_ms")).select(
        whole.select("average").scalar().alias("avg_latency_ms"), "p50_latency_ms", "p95_latency_ms", whole.select("most").scalar().alias("max_latency_ms"))


def latency_stats(events: DataFrame, ingested: str, processed: str) -> DataFrame:
    """Average, median, 95th percentile and maximum of processed minus ingested in milliseconds, exact, in two reads of a batch.

    A stream keeps ``latency_partials`` and reads one bin again only if it wants exact percentiles.
    """
    rows = latencies(events, ingested, processed)
    return exact_latency_stats(materialize(latency_partials(rows), "latency"), rows)


def threshold_partials(flagged: DataFrame, condition: Column, duration: str, time: str = EVENT_TIME) -> DataFrame:
    """Hits of a condition and comments per window of the given events."""
    return flagged.groupBy(F.window(time, duration)).agg(F.count_if(condition).alias("hits"), F.count(F.lit(1)).alias("comments"))


def threshold_merge(partials: DataFrame) -> DataFrame:
    return partials.groupBy("window").agg(F.sum("hits").alias("hits"), F.sum("comments").alias("comments"))


def threshold_totals(partials: DataFrame, at_least: int) -> DataFrame:
    return threshold_merge(partials).where(F.col("hits") >= at_least).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "hits", "comments")


def threshold_alerts(flagged: DataFrame, condition: Column, duration: str, at_least: int, time: str = EVENT_TIME) -> DataFrame:
    """Windows of a batch in which a condition held for at least so many comments. A stream runs the halves and loses no late event."""
    return threshold_totals(threshold_partials(flagged, condition, duration, time), at_least)
