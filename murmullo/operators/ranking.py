"""Top-k lists, samples and running counts.

Top-k over a table is ``orderBy().limit()`` (each task keeps k rows). Top-k per group is
``row_number() <= k``, which Spark also applies per task before the shuffle (WindowGroupLimit).
Every order ends in a unique key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from murmullo.functions.actors import canonical_actor
from murmullo.operators.rules import FLAG_COLUMNS

# Labels that count as offensive, and the neutral one.
OFFENSIVE_CLASSES = ("ofensivo_directo", "odio_agresion_grupal", "vulgaridad_contextual")
NEUTRAL_CLASS = "neutral_no_ofensivo"
RAISED_LEVELS = ("medio", "alto")


def top_risk(rules: DataFrame, key: str, k: int = 20) -> DataFrame:
    return rules.select(key, "local_risk_score", "local_rule_tags", "message_raw").orderBy(F.desc("local_risk_score"), key).limit(k)


def examples_per_group(df: DataFrame, group: str, order: Sequence, n: int) -> DataFrame:
    """First n rows of each group, with their rank as ``example``."""
    ranked = df.withColumn("example", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("example") <= n)


def examples_per_flag(rules: DataFrame, key: str, order: Sequence, n: int = 8, flags: Sequence[str] = FLAG_COLUMNS) -> DataFrame:
    """First n messages of each raised flag (flag, example, key, message_raw)."""
    raised = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in flags]))
    long = rules.select(key, *[c for c in order if c != key], "message_raw", F.explode(raised).alias("flag"))
    return examples_per_group(long, "flag", [*order, key], n).select("flag", "example", key, "message_raw")


def sample_where(df: DataFrame, condition: Column, order: Sequence[Column], key: str, n: int = 10) -> DataFrame:
    """First n rows that meet a condition, ordered by all given keys together."""
    return df.where(condition).orderBy(*order, key).limit(n)


def samples_where(df: DataFrame, wanted: dict[str, tuple[Column, Sequence[Column]]], key: str, n: int = 10) -> DataFrame:
    """First n rows of each of several conditions, each by its own numbers (ascending), in one pass: columns ``sample`` and ``place`` are added.

    Every condition names equally many numbers, so that rows of all samples compare alike.
    """
    met = F.array_compact(F.array(*[
        F.when(condition, F.struct(F.lit(name).alias("sample"), *[o.cast("double").alias(f"_o{i}") for i, o in enumerate(order)]))
        for name, (condition, order) in wanted.items()]))
    numbers = [f"_o{i}" for i in range(len(next(iter(wanted.values()))[1]))]
    rows = df.select("*", F.inline(met))
    place = F.row_number().over(Window.partitionBy("sample").orderBy(*numbers, key))
    return rows.withColumn("place", place).where(F.col("place") <= n).drop(*numbers)


def first_by_offset(raw: DataFrame, n: int = 5) -> DataFrame:
    return raw.orderBy("kafka_partition", "kafka_offset").limit(n)


def order_events(events: DataFrame) -> DataFrame:
    return events.orderBy("kafka_partition", "kafka_offset")


def replay_order(events: DataFrame) -> DataFrame:
    """Events by video and offset in it; offsets that are no number come first."""
    return events.orderBy("video_id", F.col("video_offset_msec").try_cast("double"), F.col("row_number").cast("long"))


def offensive_comments(scored: DataFrame) -> DataFrame:
    """Comments with an offensive class, or offensive by the binary model at raised risk."""
    label = F.coalesce("pred_multiclass_sparkml_label", F.lit(""))
    binary = F.coalesce("pred_binary_sparkml_label", F.lit(""))
    risk = F.coalesce("hybrid_risk_level", F.lit(""))
    by_class = label.isin(*OFFENSIVE_CLASSES)
    by_binary = (binary == "ofensivo") & risk.isin(*RAISED_LEVELS) & (label != NEUTRAL_CLASS)
    return scored.where(by_class | by_binary)


def top_offensive(scored: DataFrame, k: int = 250, default_author: str = "youtube_user") -> DataFrame:
    """Most confident offensive comments, then by row number as a number."""
    confidence = F.coalesce(F.col("confidence_binary_sparkml"), F.lit(0.0))
    text_columns = {
        "binary_label": "pred_binary_sparkml_label", "multiclass_label": "pred_multiclass_sparkml_label",
        "risk_level": "hybrid_risk_level", "risk_reason": "hybrid_risk_reason", "local_rule_tags": "local_rule_tags",
        "kafka_partition": "kafka_partition", "kafka_offset": "kafka_offset", "event_id": "event_id", "row_number": "row_number",
    }
    return (
        offensive_comments(scored)
        .withColumn("_conf", confidence)
        .orderBy(F.desc("_conf"), F.col("row_number").try_cast("long"), "event_id")
        .limit(k)
        .select(
            F.coalesce("author", F.lit(default_author)).alias("author"),
            F.coalesce("message_clean", "message_raw", F.lit("")).alias("message"),
            F.col("_conf").alias("confidence"),
            *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in text_columns.items()],
        )
    )


def actor_leaderboard(signals: DataFrame, k: int = 8) -> DataFrame:
    """Canonical actors by mentions, with the summed risk score of their messages."""
    return (
        signals.where(F.coalesce("actor", F.lit("")) != "")
        .groupBy(canonical_actor(F.col("actor")).alias("actor"))
        .agg(F.count(F.lit(1)).alias("mentions"), F.sum("local_risk_score").alias("score"))
        .orderBy(F.desc("mentions"), "actor")
        .limit(k)
    )


def cumulative_actor_counts(signals: DataFrame, time: Column, last: int = 90) -> DataFrame:
    """Running mention count per canonical actor at each point in time, last points only.

    Mentions are summed per (actor, time point) first. The newest points are then kept per task
    (top-k), and the running count is the actor's total less what came later, so no window ever
    sees more than ``last`` points of an actor.
    """
    points = (
        signals.where(F.coalesce("actor", F.lit("")) != "")
        .groupBy(canonical_actor(F.col("actor")).alias("actor"), time.alias("point"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    newest = Window.partitionBy("actor").orderBy(F.desc("point"))
    recent = points.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= last)
    later = F.coalesce(F.sum("_n").over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = points.groupBy("actor").agg(F.sum("_n").alias("_total"))
    return recent.withColumn("_later", later).join(totals, "actor").select(
        "actor", "point", (F.col("_total") - F.col("_later")).alias("mentions")
    )
