"""Hybrid risk: rule flags and model confidence combined into a level and a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from murmullo.functions.scalars import confidence_bucket, parse_bool
from murmullo.operators.rules import FLAG_COLUMNS, any_of

# Strong flags, thresholds, level names and reason texts per profile.
STRONG_FLAGS = {
    "v1": ("has_terruqueo", "has_fraude", "has_polarization_signal", "has_discriminatory_language", "has_general_insult"),
    "k": ("has_terruqueo", "has_fraude", "has_polarization_signal", "has_discriminatory_language", "has_homophobic_slur", "has_general_insult"),
}
HIGH_CONFIDENCE = 0.70
MEDIUM_CONFIDENCE = 0.60
HIGH_RISK_SCORE = 5
ELEVATED_SCORE = 3
ACTIVE_SCORE = 2
LEVEL_HIGH, LEVEL_MEDIUM, LEVEL_LOW = "alto", "medio", "bajo"
REASONS = {
    "ml_and_strong": "ML ofensivo alta confianza + reglas locales fuertes",
    "ml_no_rules": "ML ofensivo alta confianza sin reglas locales; revisar posible ofensividad general OffendES",
    "ml_low_no_rules": "ML ofensivo baja/media confianza sin reglas; no tomar como final",
    "rules_against_ml": "Modelo no ofensivo pero reglas locales elevadas; contexto peruano relevante",
    "rules_active": "Reglas locales activas",
    "ml_no_strong": "ML ofensivo sin evidencia local fuerte",
    "low": "Bajo riesgo hibrido",
    "rules_very_strong": "Reglas locales muy fuertes",
    "ml_and_rules": "ML ofensivo + reglas locales",
    "ml_review": "ML ofensivo sin evidencia local fuerte; revisar",
}

_PRED, _CONF, _SCORE = "pred_binary_sparkml", "confidence_binary_sparkml", "local_risk_score"


def cast_inputs(df: DataFrame, profile: str = "k") -> DataFrame:
    """Typed inputs whatever the files held: flags boolean (missing is false), numbers or defaults.

    Profile k also defaults a missing prediction and confidence to 0; v1 leaves them null.
    """
    columns = {f: parse_bool(F.col(f)) if f in df.columns else F.lit(False) for f in FLAG_COLUMNS}
    columns[_SCORE] = F.coalesce(F.col(_SCORE).try_cast("int"), F.lit(0))
    confidence, prediction = F.col(_CONF).try_cast("double"), F.col(_PRED).try_cast("int")
    if profile == "k":
        confidence, prediction = F.coalesce(confidence, F.lit(0.0)), F.coalesce(prediction, F.lit(0))
    columns[_CONF], columns[_PRED] = confidence, prediction
    if "pred_multiclass_sparkml" in df.columns:
        columns["pred_multiclass_sparkml"] = F.col("pred_multiclass_sparkml").try_cast("int")
    return df.withColumns(columns)


def rule_presence(df: DataFrame, profile: str = "k") -> DataFrame:
    return df.withColumns(
        {
            "has_any_local_rule": any_of(*[F.col(f) for f in FLAG_COLUMNS]),
            "has_strong_local_rule": any_of(*[F.col(f) for f in STRONG_FLAGS[profile]]),
        }
    )


def high_confidence(threshold: float = HIGH_CONFIDENCE) -> Column:
    return (F.col(_PRED) == 1) & (F.col(_CONF) >= threshold)


def risk_level() -> Column:
    offensive = (F.col(_PRED) == 1) & (F.col(_CONF) >= MEDIUM_CONFIDENCE)
    high = (F.col("ml_offensive_high_confidence") & F.col("has_strong_local_rule")) | (F.col(_SCORE) >= HIGH_RISK_SCORE)
    return (
        F.when(high, LEVEL_HIGH)
        .when(offensive | (F.col(_SCORE) >= ACTIVE_SCORE), LEVEL_MEDIUM)
        .otherwise(LEVEL_LOW)
    )


def _reason_cases(profile: str):
    pred, conf, score = F.col(_PRED), F.col(_CONF), F.col(_SCORE)
    sure, any_rule, strong = F.col("ml_offensive_high_confidence"), F.col("has_any_local_rule"), F.col("has_strong_local_rule")
    if profile == "k":
        offensive = (pred == 1) & (conf >= MEDIUM_CONFIDENCE)
        return [
            ("ml_and_strong", sure & strong),
            ("rules_very_strong", score >= HIGH_RISK_SCORE),
            ("ml_and_rules", offensive & any_rule),
            ("ml_review", offensive),
            ("rules_active", score >= ACTIVE_SCORE),
        ]
    return [
        ("ml_and_strong", sure & strong),
        ("ml_no_rules", sure & ~any_rule),
        ("ml_low_no_rules", (pred == 1) & (conf < HIGH_CONFIDENCE) & ~any_rule),
        ("rules_against_ml", (pred == 0) & (score >= ELEVATED_SCORE)),
        ("rules_active", score >= ACTIVE_SCORE),
        ("ml_no_strong", pred == 1),
    ]


def risk_reason(profile: str = "k") -> Column:
    """Text of the first reason that holds."""
    reason = F.lit(REASONS["low"])
    for key, condition in reversed(_reason_cases(profile)):
        reason = F.when(condition, REASONS[key]).otherwise(reason)
    return reason


def score_hybrid(df: DataFrame, profile: str = "k") -> DataFrame:
    """All hybrid columns of a rules-and-predictions frame; narrow, no shuffle."""
    df = rule_presence(cast_inputs(df, profile), profile)
    df = df.withColumn("ml_offensive_high_confidence", high_confidence())
    if profile == "v1" or "confidence_binary_bucket" not in df.columns:
        df = df.withColumn("confidence_binary_bucket", confidence_bucket(F.col(_CONF)))
    return df.withColumns({"hybrid_risk_level": risk_level(), "hybrid_risk_reason": risk_reason(profile)})
