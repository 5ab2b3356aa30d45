"""Summaries over rule, prediction and hybrid tables. One shuffle each, partial sums map-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from murmullo.functions.scalars import CONFIDENCE_EDGES, minute_or_fallback, clock_seconds, pct
from murmullo.operators.rules import FLAG_COLUMNS

# The keys here, and the column names given by ``alias`` in the minute tables and summaries of this module.
GROUP_KEYS = ("source_file", "video_id", "minute")


def _rows(weight: str | None) -> Column:
    """Number of rows, where each row stands for ``weight`` rows."""
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def _rows_if(condition: Column, weight: str | None) -> Column:
    return F.count_if(condition) if weight is None else F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0).cast("long"))


def _flags_wide(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f)).alias(f) for f in FLAG_COLUMNS])


def flag_summary(rules: DataFrame, digits: int = 4) -> DataFrame:
    """(flag, count, percentage), one row per flag, from a single pass."""
    long = _flags_wide(rules).unpivot(["_rows"], list(FLAG_COLUMNS), "flag", "count")
    return long.select("flag", "count", pct(F.col("count"), F.col("_rows"), digits).alias("percentage"))


def score_stats(rules: DataFrame) -> DataFrame:
    score = F.col("local_risk_score")
    return rules.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("avg_local_risk_score"),
        F.coalesce(F.min(score), F.lit(0)).alias("min_local_risk_score"),
        F.coalesce(F.max(score), F.lit(0)).alias("max_local_risk_score"),
    )


def _flag_count(flag: str, name: str) -> Column:
    return F.count_if(F.col(flag)).alias(name)


def minute_aggregates(rules: DataFrame, ordered: bool = False) -> DataFrame:
    """Activity and signals per source file, video and minute."""
    result = rules.groupBy(*GROUP_KEYS).agg(
        F.count(F.lit(1)).alias("comentarios"),
        _flag_count("has_terruqueo", "terruqueo"),
        _flag_count("has_fraude", "fraude"),
        _flag_count("has_political_mention", "menciones_politicas"),
        _flag_count("has_polarization_signal", "polarizacion"),
        _flag_count("has_discriminatory_language", "lenguaje_discriminatorio"),
        _flag_count("is_spam_noise", "spam"),
        F.avg("local_risk_score").alias("avg_local_risk_score"),
        F.max("local_risk_score").alias("max_local_risk_score"),
    )
    return result.orderBy(*GROUP_KEYS) if ordered else result


def minute_aggregates_hybrid(scored: DataFrame, ordered: bool = False, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Per-minute hybrid table; ``extra_keys`` (for instance the batch id) refine the groups."""
    result = scored.groupBy(*extra_keys, *GROUP_KEYS).agg(
        F.count(F.lit(1)).alias("comentarios"),
        F.count_if(F.col("pred_binary_sparkml") == 1).alias("ml_ofensivos"),
        _flag_count("has_terruqueo", "terruqueo"),
        _flag_count("has_fraude", "fraude"),
        _flag_count("has_polarization_signal", "polarizacion"),
        F.avg("local_risk_score").alias("avg_local_risk_score"),
    )
    return result.orderBy(*GROUP_KEYS) if ordered else result


def minute_aggregates_local(df: DataFrame, binary_label: str = "pred_binary_sparkml_label", times: DataFrame | None = None) -> DataFrame:
    """Per-minute table of the single-machine report: null groups kept, minute by best time field.

    Which time field is usable is a property of the whole table; it is read as a scalar subquery of
    one narrow aggregate over ``times`` (the rows before rules were added; ``df`` if not given). Without any, all rows form the group 'global'.
    """
    usable = (df if times is None else times).agg(F.struct(
        F.coalesce(F.bool_or(F.col("video_offset_msec").try_cast("double").isNotNull()), F.lit(False)).alias("offset"),
        F.coalesce(F.bool_or(clock_seconds(F.col("timestamp_text")).isNotNull()), F.lit(False)).alias("clock"),
    ).alias("usable"))
    found = usable.scalar()
    minute = minute_or_fallback(F.col("video_offset_msec"), F.col("timestamp_text"), found["offset"], found["clock"])
    timed = df.withColumn("minute", minute)
    is_global = F.col("minute") == "global"
    timed = timed.withColumns(
        {c: F.when(is_global, F.lit(None).cast("string")).otherwise(F.col(c)) for c in ("source_file", "video_id")}
    )
    return timed.groupBy(*GROUP_KEYS).agg(
        F.count(F.lit(1)).alias("comentarios"),
        F.count_if(F.col(binary_label) == "ofensivo").alias("ofensivos"),
        _flag_count("has_terruqueo", "terruqueo"),
        _flag_count("has_fraude", "fraude"),
        _flag_count("has_polarization_signal", "polarizacion"),
        _flag_count("is_spam_noise", "spam"),
        F.avg("local_risk_score").alias("avg_local_risk_score"),
    )


def combined_counts(df: DataFrame, columns: Sequence[str], weight: str = "n") -> DataFrame:
    """Rows of every combination of columns of few values: one pass, from which any of their count tables follows.

    The functions below that take a ``weight`` count such combinations as the rows they stand for.
    """
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(weight))


def distribution(df: DataFrame, col: str, order: str | None = None, weight: str | None = None) -> DataFrame:
    """(value, count, percentage) of a column; order 'count' (descending) or 'label' on request."""
    counts = df.groupBy(F.col(col).alias("value")).agg(_rows(weight).alias("count"))
    total = counts.agg(F.sum("count").alias("n")).scalar()
    result = counts.select("value", "count", pct(F.col("count"), total).alias("percentage"))
    if order == "label":
        return result.orderBy("value")
    return result.orderBy(F.desc("count"), "value") if order == "count" else result


def cross_counts(df: DataFrame, first: str, second: str, weight: str | None = None) -> DataFrame:
    return df.groupBy(first, second).agg(_rows(weight).alias("count"))


def cross_counts_many(df: DataFrame, first: str, others: Sequence[str], weight: str | None = None) -> DataFrame:
    """(first, column, value, count) for several two-way tables in one pass.

    The combination of all columns is counted first; only those few rows are unfolded.
    """
    combined = df.groupBy(first, *others).agg(_rows(weight).alias("_n"))
    text = combined.select(first, "_n", *[F.col(c).cast("string").alias(c) for c in others])
    long = text.unpivot([first, "_n"], list(others), "column", "value")
    return long.groupBy(first, "column", "value").agg(F.sum("_n").alias("count"))


def hybrid_counts(scored: DataFrame, weight: str | None = None) -> DataFrame:
    """Offensive rows without any / any strong rule, and high-confidence rows, in one pass."""
    offensive = F.col("pred_binary_sparkml") == 1
    return scored.agg(
        F.coalesce(_rows(weight), F.lit(0).cast("long")).alias("total_rows"),
        _rows_if(offensive & ~F.col("has_any_local_rule"), weight).alias("offensive_no_rules"),
        _rows_if(offensive & ~F.col("has_strong_local_rule"), weight).alias("offensive_no_strong_rules"),
        _rows_if(F.col("ml_offensive_high_confidence"), weight).alias("high_confidence"),
    )


def confidence_stats(ml: DataFrame, low: float = CONFIDENCE_EDGES[0], high: float = 0.7) -> DataFrame:
    """Average, bounds and the share of rows in the grey zone [low, high)."""
    c = F.col("confidence_binary_sparkml")
    return ml.agg(
        F.avg(c).alias("avg_confidence"),
        F.min(c).alias("min_confidence"),
        F.max(c).alias("max_confidence"),
        pct(F.count_if((c >= low) & (c < high)), F.count(F.lit(1))).alias("grey_zone_pct"),
    )


def compare_flag_runs(current: DataFrame, base: DataFrame, tolerance: float = 2.0, unusual_above: float = 40.0) -> DataFrame:
    """Flag percentages of two runs side by side: difference in points, trend and a check mark.

    'estable' within the tolerance, else 'sube' / 'baja'; a flag above ``unusual_above`` percent is
    unusual, political mentions excepted. Both inputs shrink to ten rows before they meet.
    """
    now = flag_summary(current).select("flag", F.col("percentage").alias("current_pct"))
    then = flag_summary(base).select("flag", F.col("percentage").alias("base_pct"))
    return _compared(now.join(then, "flag"), tolerance, unusual_above)


def compare_flags_with_part(rules: DataFrame, is_base: Column, tolerance: float = 2.0, unusual_above: float = 40.0) -> DataFrame:
    """As ``compare_flag_runs`` of a table with a part of itself, from one pass over the table."""
    base = F.coalesce(is_base, F.lit(False))
    named = rules.select(base.alias("_base"), *FLAG_COLUMNS)
    wide = named.agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if("_base").alias("_base_rows"),
        F.map_from_arrays(F.array(*[F.lit(f) for f in FLAG_COLUMNS]), F.array(*[
            F.struct(F.count_if(F.col(f)).alias("now"), F.count_if(F.col(f) & F.col("_base")).alias("then")) for f in FLAG_COLUMNS])).alias("_counts"))
    long = wide.select("_rows", "_base_rows", F.explode("_counts").alias("flag", "c"))
    sides = long.select("flag", pct(F.col("c.now"), F.col("_rows"), 4).alias("current_pct"), pct(F.col("c.then"), F.col("_base_rows"), 4).alias("base_pct"))
    return _compared(sides, tolerance, unusual_above)


def _compared(sides: DataFrame, tolerance: float, unusual_above: float) -> DataFrame:
    diff = F.round(F.col("current_pct") - F.col("base_pct"), 4)
    trend = F.when(F.abs(diff) <= tolerance, "estable").when(diff > 0, "sube").otherwise("baja")
    return sides.select(
        "flag", "current_pct", "base_pct", diff.alias("delta_pp"), trend.alias("trend"),
        ((F.col("current_pct") > unusual_above) & (F.col("flag") != "has_political_mention")).alias("unusual"),
    )


def count_by_type(df: DataFrame, col: str = "message_type") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def label_audit(corpus: DataFrame, label: str = "label", comment: str = "comment") -> DataFrame:
    """Rows, mean length (2 places) and exact median length per label.

    The median is read from the counts per (label, length): those merge map-side and are bounded
    by the number of distinct lengths, so a label with most of the rows is no single big group.
    """
    lengths = corpus.groupBy(label, F.length(comment).alias("_len")).agg(F.count(F.lit(1)).alias("_n"))
    return lengths.groupBy(label).agg(
        F.sum("_n").alias("count"),
        F.round(F.sum(F.col("_len") * F.col("_n")) / F.sum(F.when(F.col("_len").isNotNull(), F.col("_n"))), 2).alias("avg_len_chars"),
        F.expr("percentile(_len, 0.5, _n)").alias("median_len_chars"),
    )
