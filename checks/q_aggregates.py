"""Aggregations (family F) and the class-weight and metric tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.data import comments, predicted, read, rules, ruled, scored
from checks.registry import query
from murmullo.operators import aggregates as A
from murmullo.operators import joins as J
from murmullo.operators import metrics as M
from murmullo.operators import offsets as O
from murmullo.operators.batches import range_stats
from murmullo.operators.ranking import actor_leaderboard
from murmullo.operators.rules import add_rules, add_signals
from checks import tables
from checks.data import TEST_ACTORS

_V1 = (S.COMMENTS, S.rules_cte("v1"))


def _flag_rows(source: str, digits: int = 4) -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS flag, count(*) FILTER (WHERE {f}) AS count, round(count(*) FILTER (WHERE {f}) * 100.0::DOUBLE / count(*), {digits}) AS percentage FROM {source}"
        for f in S.FLAGS
    )


@query("f01_flag_summary", S.chain(*_V1, final=_flag_rows("ruled")))
def f01(spark, sf):
    return A.flag_summary(ruled(spark, sf, "v1"))


@query("f02_score_stats", S.chain(*_V1, final="""
SELECT count(*) AS total_rows, avg(local_risk_score) AS avg_local_risk_score, min(local_risk_score) AS min_local_risk_score,
  max(local_risk_score) AS max_local_risk_score FROM ruled"""))
def f02(spark, sf):
    return A.score_stats(ruled(spark, sf, "v1"))


def _sum(flag, name):
    return f"count(*) FILTER (WHERE {flag}) AS {name}"


@query("f03_minute_aggregates", S.chain(*_V1, final=f"""
SELECT source_file, video_id, minute, count(*) AS comentarios, {_sum('has_terruqueo', 'terruqueo')}, {_sum('has_fraude', 'fraude')},
  {_sum('has_political_mention', 'menciones_politicas')}, {_sum('has_polarization_signal', 'polarizacion')},
  {_sum('has_discriminatory_language', 'lenguaje_discriminatorio')}, {_sum('is_spam_noise', 'spam')},
  avg(local_risk_score) AS avg_local_risk_score, max(local_risk_score) AS max_local_risk_score
FROM ruled GROUP BY source_file, video_id, minute"""))
def f03(spark, sf):
    return A.minute_aggregates(ruled(spark, sf, "v1"))


@query("f04_minute_aggregates_hybrid", S.chain(*S.scored("k"), final=f"""
SELECT source_file, video_id, minute, count(*) AS comentarios, {_sum('pred_binary_sparkml = 1', 'ml_ofensivos')}, {_sum('has_terruqueo', 'terruqueo')},
  {_sum('has_fraude', 'fraude')}, {_sum('has_polarization_signal', 'polarizacion')}, avg(local_risk_score) AS avg_local_risk_score
FROM scored GROUP BY source_file, video_id, minute"""))
def f04(spark, sf):
    return A.minute_aggregates_hybrid(scored(spark, sf, "k"))


@query("f05_minute_aggregates_local", S.chain(S.COMMENTS, S.PREDICTED, S.rules_cte("l", source="predicted"), final=f"""
SELECT source_file, video_id, CAST(CAST(floor(coalesce(TRY_CAST(video_offset_msec AS DOUBLE), 0) / 60000) AS BIGINT) AS VARCHAR) AS minute,
  count(*) AS comentarios, {_sum("pred_binary_sparkml_label = 'ofensivo'", 'ofensivos')}, {_sum('has_terruqueo', 'terruqueo')},
  {_sum('has_fraude', 'fraude')}, {_sum('has_polarization_signal', 'polarizacion')}, {_sum('is_spam_noise', 'spam')},
  avg(local_risk_score) AS avg_local_risk_score FROM ruled GROUP BY ALL"""))
def f05(spark, sf):
    found = predicted(spark, sf)
    return A.minute_aggregates_local(add_rules(found, rules("l")), times=found)


def _dist(source, col):
    return f"SELECT {col} AS value, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS percentage FROM {source} GROUP BY {col}"


@query("f06_distribution", S.chain(*S.scored("k"), final=_dist("scored", "confidence_binary_bucket")))
def f06(spark, sf):
    return A.distribution(scored(spark, sf), "confidence_binary_bucket", order="count")


@query("f07_distribution_by_label", S.chain(S.COMMENTS, S.PREDICTED, final=_dist("predicted", "pred_multiclass_sparkml_label")))
def f07(spark, sf):
    return A.distribution(predicted(spark, sf), "pred_multiclass_sparkml_label", order="label")


@query("f08_cross_counts", S.chain(*S.scored("k"), final="""
SELECT pred_binary_sparkml_label, local_risk_score, count(*) AS count FROM scored GROUP BY ALL"""))
def f08(spark, sf):
    return A.cross_counts(scored(spark, sf), "pred_binary_sparkml_label", "local_risk_score")


_CROSSED = ("has_terruqueo", "has_fraude", "has_polarization_signal", "has_discriminatory_language", "has_general_insult")


@query("f08_cross_counts_flags", S.chain(*S.scored("k"), final=" UNION ALL ".join(
    f"SELECT pred_binary_sparkml_label, '{f}' AS \"column\", CAST({f} AS VARCHAR) AS value, count(*) AS count FROM scored GROUP BY ALL" for f in _CROSSED)))
def f08_flags(spark, sf):
    return A.cross_counts_many(scored(spark, sf), "pred_binary_sparkml_label", _CROSSED)


@query("f09_offset_stats", S.chain(S.COMMENTS, final="""
SELECT kafka_partition, min(kafka_offset) AS min_offset, max(kafka_offset) AS max_offset, count(*) AS records FROM comments GROUP BY 1"""))
def f09(spark, sf):
    return O.offset_stats(comments(spark, sf))


@query("f10_hybrid_counts", S.chain(*S.scored("k"), final=f"""
SELECT count(*) AS total_rows, {_sum('pred_binary_sparkml = 1 AND NOT has_any_local_rule', 'offensive_no_rules')},
  {_sum('pred_binary_sparkml = 1 AND NOT has_strong_local_rule', 'offensive_no_strong_rules')},
  {_sum('ml_offensive_high_confidence', 'high_confidence')} FROM scored"""))
def f10(spark, sf):
    return A.hybrid_counts(scored(spark, sf))


# --- metrics on fixed predictions: the true label of a labelled document against an arithmetic guess

_GUESSED = """
guessed AS (SELECT CAST(label AS INTEGER) AS label, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 3 AS INTEGER) ELSE CAST(label AS INTEGER) END AS guess FROM corpus)"""


def _guessed(spark, sf):
    doc = F.col("comment_id").cast("long")
    return tables.corpus(spark, sf).select(
        F.col("label").cast("int").alias("label"),
        F.when(doc % 3 == 0, (doc % 3).cast("int")).otherwise(F.col("label").cast("int")).alias("guess"),
    )


_CELLS = """
classes(k) AS (VALUES (0), (1), (2), (3)),
matrix AS (SELECT a.k AS label, p.k AS prediction, (SELECT count(*) FROM guessed g WHERE g.label = a.k AND g.guess = p.k) AS count FROM classes a, classes p)"""
_PER_CLASS = """
totals AS (SELECT k AS label, (SELECT sum(count) FROM matrix WHERE label = k)::BIGINT AS actual_total,
  (SELECT sum(count) FROM matrix WHERE prediction = k)::BIGINT AS predicted_total,
  (SELECT sum(count) FROM matrix WHERE label = k AND prediction = k)::BIGINT AS tp FROM classes),
pr AS (SELECT *, coalesce(tp::DOUBLE / nullif(predicted_total, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(actual_total, 0), 0) AS recall FROM totals),
per_class AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr)"""
_LABELS = (0, 1, 2, 3)


@query("f11_confusion", S.chain(S.CORPUS, _GUESSED, _CELLS, final="SELECT * FROM matrix"))
def f11(spark, sf):
    return M.confusion(_guessed(spark, sf), "label", "guess", _LABELS)


@query("f11_confusion_wide", S.chain(S.CORPUS, _GUESSED, _CELLS, final="""
SELECT 'class_' || label AS actual_label, """ + ", ".join(
    f"CAST(sum(CASE WHEN prediction = {k} THEN count ELSE 0 END) AS BIGINT) AS pred_class_{k}" for k in _LABELS) + " FROM matrix GROUP BY label"))
def f11_wide(spark, sf):
    return M.confusion_wide(_guessed(spark, sf), "label", "guess", {k: f"class_{k}" for k in _LABELS})


@query("f12_per_class_metrics", S.chain(S.CORPUS, _GUESSED, _CELLS, _PER_CLASS, final="SELECT * FROM per_class"))
def f12(spark, sf):
    return M.per_class_metrics(M.confusion(_guessed(spark, sf), "label", "guess", _LABELS))


@query("f12_macro", S.chain(S.CORPUS, _GUESSED, _CELLS, _PER_CLASS, final="""
SELECT avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM per_class"""))
def f12_macro(spark, sf):
    return M.macro(M.per_class_metrics(M.confusion(_guessed(spark, sf), "label", "guess", _LABELS)))


@query("f13_weighted_metrics", S.chain(S.CORPUS, _GUESSED, _CELLS, _PER_CLASS, final="""
SELECT sum(tp)::DOUBLE / sum(actual_total) AS accuracy, sum(precision * actual_total) / sum(actual_total) AS weighted_precision,
  sum(recall * actual_total) / sum(actual_total) AS weighted_recall, sum(f1 * actual_total) / sum(actual_total) AS weighted_f1 FROM per_class"""))
def f13(spark, sf):
    return M.weighted_metrics(M.confusion(_guessed(spark, sf), "label", "guess", _LABELS))


@query("f14_label_audit", S.chain(S.CORPUS, final="""
SELECT label, count(*) AS count, round(avg(length(comment)), 2) AS avg_len_chars, quantile_cont(length(comment), 0.5) AS median_len_chars
FROM corpus GROUP BY label"""))
def f14(spark, sf):
    return A.label_audit(tables.corpus(spark, sf))


@query("f15_class_weights", S.chain(S.CORPUS, final="""
SELECT label, (SELECT count(*) FROM corpus)::DOUBLE / ((SELECT count(DISTINCT label) FROM corpus) * count(*)) AS weight FROM corpus GROUP BY label"""))
def f15(spark, sf):
    return J.class_weights(tables.corpus(spark, sf), "label")


_EARLY = "CAST(row_number AS BIGINT) % 2 = 0"


def _compare_sql(tolerance, above):
    return S.chain(
        *_V1, "early AS (SELECT * FROM ruled WHERE video_offset_msec <> 'n/a' AND CAST(video_offset_msec AS BIGINT) < 40000)",
        f"a AS ({_flag_rows('ruled')})", f"b AS ({_flag_rows('early')})", final=f"""
SELECT a.flag, a.percentage AS current_pct, b.percentage AS base_pct, round(a.percentage - b.percentage, 4) AS delta_pp,
  CASE WHEN abs(round(a.percentage - b.percentage, 4)) <= {tolerance} THEN 'estable' WHEN a.percentage > b.percentage THEN 'sube' ELSE 'baja' END AS trend,
  a.percentage > {above} AND a.flag <> 'has_political_mention' AS unusual FROM a JOIN b USING (flag)""")


def _compare(spark, sf, **settings):
    every = ruled(spark, sf, "v1")
    return A.compare_flags_with_part(every, F.col("video_offset_msec").try_cast("long") < 40000, **settings)


@query("f17_compare_flag_runs", _compare_sql(2.0, 40.0))
def f17(spark, sf):
    return _compare(spark, sf)


@query("f18_delta_table", _compare_sql(0.5, 10.0))
def f18(spark, sf):
    return _compare(spark, sf, tolerance=0.5, unusual_above=10.0)


@query("f19_confidence_stats", S.chain(S.COMMENTS, S.PREDICTED, final="""
SELECT avg(confidence_binary_sparkml) AS avg_confidence, min(confidence_binary_sparkml) AS min_confidence, max(confidence_binary_sparkml) AS max_confidence,
  round(count(*) FILTER (WHERE confidence_binary_sparkml >= 0.5 AND confidence_binary_sparkml < 0.7) * 100.0::DOUBLE / count(*), 4) AS grey_zone_pct FROM predicted"""))
def f19(spark, sf):
    return A.confidence_stats(predicted(spark, sf))


_OFFSETS = """
ends AS (SELECT kafka_topic, kafka_partition, max(kafka_offset) + 1 AS end_offset FROM comments GROUP BY ALL),
committed AS (SELECT kafka_topic, kafka_partition, CASE kafka_partition WHEN 0 THEN end_offset // 2 WHEN 1 THEN end_offset + 5 END AS committed_offset FROM ends)"""


def _offsets(spark, sf):
    ends = O.end_offsets(comments(spark, sf))
    p, end = F.col("kafka_partition"), F.col("end_offset")
    done = F.when(p == 0, F.floor(end / 2)).when(p == 1, end + 5)
    return ends, ends.select("kafka_topic", "kafka_partition", done.alias("committed_offset"))


@query("f20_topic_totals_lag", S.chain(S.COMMENTS, _OFFSETS, final="""
SELECT kafka_topic, CAST(sum(end_offset) AS BIGINT) AS total, CAST(sum(greatest(0, end_offset - coalesce(committed_offset, 0))) AS BIGINT) AS lag
FROM ends JOIN committed USING (kafka_topic, kafka_partition) GROUP BY 1"""))
def f20(spark, sf):
    ends, committed = _offsets(spark, sf)
    return O.topic_totals(ends).join(O.consumer_lag(ends, committed), "kafka_topic")


@query("f21_normalised_progress", S.chain(S.COMMENTS, _OFFSETS, final="""
SELECT kafka_topic, CAST(sum(least(end_offset, coalesce(committed_offset, 0))) AS BIGINT) AS normalised, CAST(sum(end_offset) AS BIGINT) AS total
FROM ends JOIN committed USING (kafka_topic, kafka_partition) GROUP BY 1"""))
def f21(spark, sf):
    return O.normalised_progress(*_offsets(spark, sf))


@query("f22_actor_leaderboard", S.chain(S.COMMENTS, S.SIGNALS, f"named AS (SELECT {S.CANONICAL_ACTOR} AS actor, local_risk_score FROM signals WHERE actor <> '')", final="""
SELECT actor, count(*) AS mentions, CAST(sum(local_risk_score) AS BIGINT) AS score FROM named GROUP BY actor ORDER BY mentions DESC, actor LIMIT 8"""))
def f22(spark, sf):
    return actor_leaderboard(add_signals(comments(spark, sf), rules("s"), TEST_ACTORS))


@query("f23_range_stats", S.chain(S.COMMENTS, final="SELECT count(*) AS rows, min(n) AS min_row, max(n) AS max_row FROM comments"))
def f23(spark, sf):
    return range_stats(comments(spark, sf))
