"""Hybrid risk (family L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.data import comments, predicted, rules, scored
from checks.registry import query
from murmullo.operators import hybrid as H
from murmullo.operators.rules import add_rules
from murmullo.plans.diagnostics import diagnostics

# Inputs as files may hold them: flags as words, a missing flag, scores and predictions as text.
_LOOSE = """
loose AS (SELECT event_id, CASE n % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'FALSE' WHEN 2 THEN '1' WHEN 3 THEN NULL ELSE 'yes' END AS has_fraude,
  CASE n % 3 WHEN 0 THEN 'x' ELSE CAST(n % 7 AS VARCHAR) END AS score, CASE WHEN n % 4 > 0 THEN CAST(n % 2 AS VARCHAR) END AS pred,
  CASE n % 4 WHEN 1 THEN 'n/a' WHEN 2 THEN '0.75' WHEN 3 THEN '0.55' END AS conf FROM comments)"""


def _loose(spark, sf):
    n = F.col("row_number").cast("long")
    return comments(spark, sf).select(
        "event_id",
        F.when(n % 5 == 0, "true").when(n % 5 == 1, "FALSE").when(n % 5 == 2, "1").when(n % 5 == 4, "yes").alias("has_fraude"),
        F.when(n % 3 == 0, "x").otherwise((n % 7).cast("string")).alias("local_risk_score"),
        F.when(n % 4 > 0, (n % 2).cast("string")).alias("pred_binary_sparkml"),
        F.when(n % 4 == 1, "n/a").when(n % 4 == 2, "0.75").when(n % 4 == 3, "0.55").alias("confidence_binary_sparkml"),
    )


def _cast_sql(default):
    return S.chain(S.COMMENTS, _LOOSE, final=f"""
SELECT event_id, coalesce(lower(has_fraude) IN ('true', '1', 'yes'), false) AS has_fraude, false AS has_terruqueo,
  coalesce(TRY_CAST(score AS INTEGER), 0) AS local_risk_score, {default('TRY_CAST(pred AS INTEGER)')} AS pred_binary_sparkml,
  {default('TRY_CAST(conf AS DOUBLE)')} AS confidence_binary_sparkml FROM loose""")


_CAST_COLUMNS = ("event_id", "has_fraude", "has_terruqueo", "local_risk_score", "pred_binary_sparkml", "confidence_binary_sparkml")


@query("l01_cast_inputs_k", _cast_sql("coalesce({}, 0)".format))
def l01_k(spark, sf):
    return H.cast_inputs(_loose(spark, sf), "k").select(*_CAST_COLUMNS)


@query("l01_cast_inputs_v1", _cast_sql("{}".format))
def l01_v1(spark, sf):
    return H.cast_inputs(_loose(spark, sf), "v1").select(*_CAST_COLUMNS)


@query("l02_rule_presence", S.chain(*S.scored("k"), final="SELECT event_id, has_any_local_rule, has_strong_local_rule FROM scored"))
def l02(spark, sf):
    return H.rule_presence(add_rules(comments(spark, sf), rules("k")), "k").select("event_id", "has_any_local_rule", "has_strong_local_rule")


@query("l03_high_confidence", S.chain(S.COMMENTS, S.PREDICTED, final="""
SELECT event_id, pred_binary_sparkml = 1 AND confidence_binary_sparkml >= 0.70 AS high FROM predicted"""))
def l03(spark, sf):
    return predicted(spark, sf).select("event_id", H.high_confidence().alias("high"))


@query("l04_risk_level", S.chain(*S.scored("k"), final="SELECT event_id, hybrid_risk_level FROM scored"))
def l04(spark, sf):
    return scored(spark, sf, "k").select("event_id", "hybrid_risk_level")


_REASON = "SELECT event_id, hybrid_risk_level, hybrid_risk_reason, confidence_binary_bucket FROM scored"


@query("l05_risk_reason_v1", S.chain(*S.scored("v1"), final=_REASON))
def l05(spark, sf):
    return scored(spark, sf, "v1").select("event_id", "hybrid_risk_level", "hybrid_risk_reason", "confidence_binary_bucket")


@query("l06_risk_reason_k", S.chain(*S.scored("k"), final=_REASON))
def l06(spark, sf):
    return scored(spark, sf, "k").select("event_id", "hybrid_risk_level", "hybrid_risk_reason", "confidence_binary_bucket")


_BUNDLE = {
    "binary": "pred_binary_sparkml_label", "multiclass": "pred_multiclass_sparkml_label",
    "confidence": "confidence_binary_bucket", "levels": "hybrid_risk_level",
}


_FLAG_PAIRS = ("has_terruqueo", "has_fraude", "has_polarization_signal", "has_discriminatory_language", "has_general_insult")
_COUNTS = {
    "total_rows": "true", "offensive_no_rules": "pred_binary_sparkml = 1 AND NOT has_any_local_rule",
    "offensive_no_strong_rules": "pred_binary_sparkml = 1 AND NOT has_strong_local_rule", "high_confidence": "ml_offensive_high_confidence",
}
_LISTS = {
    "confident_with_rules": ("pred_binary_sparkml = 1 AND confidence_binary_sparkml >= 0.8 AND has_strong_local_rule", "local_risk_score DESC, confidence_binary_sparkml DESC"),
    "confident_without_rules": ("pred_binary_sparkml = 1 AND confidence_binary_sparkml >= 0.8 AND NOT has_any_local_rule", "confidence_binary_sparkml DESC"),
    "unsure_without_rules": ("pred_binary_sparkml = 1 AND confidence_binary_sparkml < 0.6 AND NOT has_any_local_rule", "confidence_binary_sparkml"),
    "not_offensive_high_score": ("pred_binary_sparkml = 0 AND local_risk_score >= 4", "local_risk_score DESC"),
}


@query("l07_diagnostics", S.chain(*S.scored("v1"), final=" UNION ALL ".join(
    [f"SELECT '{t}' AS part, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM scored GROUP BY {c}" for t, c in _BUNDLE.items()]
    + ["SELECT 'prediction_by_score', pred_binary_sparkml_label || ' ' || local_risk_score, count(*) FROM scored GROUP BY ALL"]
    + [f"SELECT 'prediction_by_flag', pred_binary_sparkml_label || ' {f} ' || CAST({f} AS VARCHAR), count(*) FROM scored GROUP BY ALL" for f in _FLAG_PAIRS]
    + [f"SELECT 'counts', '{name}', count(*) FILTER (WHERE {where}) FROM scored" for name, where in _COUNTS.items()]
    + [f"SELECT '{name}', event_id, place FROM (SELECT event_id, row_number() OVER (ORDER BY {order}, event_id) AS place FROM scored WHERE {where}) WHERE place <= 10"
       for name, (where, order) in _LISTS.items()])))
def l07(spark, sf):
    # all eleven tables of the report
    bundle = diagnostics(scored(spark, sf, "v1"))
    parts = [bundle[t].select(F.lit(t).alias("part"), "value", "count") for t in _BUNDLE]
    label = F.concat(F.col("pred_binary_sparkml_label"), F.lit(" "), F.col("local_risk_score").cast("string"))
    parts.append(bundle["prediction_by_score"].select(F.lit("prediction_by_score").alias("part"), label.alias("value"), "count"))
    label = F.concat(F.col("pred_binary_sparkml_label"), F.lit(" "), F.col("column"), F.lit(" "), F.col("value"))
    parts.append(bundle["prediction_by_flag"].select(F.lit("prediction_by_flag").alias("part"), label.alias("value"), "count"))
    parts.append(bundle["counts"].unpivot([], list(_COUNTS), "value", "count").select(F.lit("counts").alias("part"), "value", "count"))
    parts += [bundle[name].select(F.lit(name).alias("part"), F.col("event_id").alias("value"), F.col("place").cast("long").alias("count")) for name in _LISTS]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
