"""The diagnostics bundle of a hybrid table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from murmullo.operators.aggregates import combined_counts, cross_counts, cross_counts_many, distribution, hybrid_counts
from murmullo.operators.ranking import samples_where
from murmullo.session import materialize

# Flags crossed with the prediction, and sample conditions.
CROSSED_FLAGS = ("has_terruqueo", "has_fraude", "has_polarization_signal", "has_discriminatory_language", "has_general_insult")
SURE, UNSURE = 0.80, 0.60


COMBINED = (
    "pred_binary_sparkml", "pred_binary_sparkml_label", "pred_multiclass_sparkml_label", "confidence_binary_bucket", "hybrid_risk_level", "local_risk_score",
    *CROSSED_FLAGS, "has_any_local_rule", "has_strong_local_rule", "ml_offensive_high_confidence",
)


def samples(scored: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The four example lists in one pass: where models and rules agree or disagree most (column ``sample``, then ``place``)."""
    offensive, confidence, score = F.col("pred_binary_sparkml") == 1, F.col("confidence_binary_sparkml"), F.col("local_risk_score")
    no_rule, same = ~F.col("has_any_local_rule"), F.lit(0)
    wanted = {
        "confident_with_rules": (offensive & (confidence >= SURE) & F.col("has_strong_local_rule"), [-score, -confidence]),
        "confident_without_rules": (offensive & (confidence >= SURE) & no_rule, [-confidence, same]),
        "unsure_without_rules": (offensive & (confidence < UNSURE) & no_rule, [confidence, same]),
        "not_offensive_high_score": ((F.col("pred_binary_sparkml") == 0) & (score >= 4), [-score, same]),
    }
    return samples_where(scored, wanted, key, n)


def diagnostics(scored: DataFrame, key: str = "event_id") -> dict[str, DataFrame]:
    """Every table of the hybrid report. Two passes over ``scored``: its count tables are made
    from one table of combined counts, which is landed, and its example lists come from one pass for all."""
    counts = materialize(combined_counts(scored, COMBINED), "combined")
    listed = materialize(samples(scored, key), "samples")
    names = ("confident_with_rules", "confident_without_rules", "unsure_without_rules", "not_offensive_high_score")
    return {
        "binary": distribution(counts, "pred_binary_sparkml_label", order="count", weight="n"),
        "multiclass": distribution(counts, "pred_multiclass_sparkml_label", order="count", weight="n"),
        "confidence": distribution(counts, "confidence_binary_bucket", order="count", weight="n"),
        "levels": distribution(counts, "hybrid_risk_level", order="count", weight="n"),
        "prediction_by_score": cross_counts(counts, "pred_binary_sparkml_label", "local_risk_score", weight="n"),
        "prediction_by_flag": cross_counts_many(counts, "pred_binary_sparkml_label", CROSSED_FLAGS, weight="n"),
        "counts": hybrid_counts(counts, weight="n"),
        **{name: listed.where(F.col("sample") == name).orderBy("place") for name in names},
    }
