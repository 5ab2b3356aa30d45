"""Joins (family E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.data import comments, predicted, rules, ruled
from checks.registry import query
from murmullo.operators import joins as J
from murmullo.operators.ingest import row_range
from murmullo.plans.batch import IDENTITY_COLUMNS, RULE_COLUMNS
from checks import tables

_ML = ("pred_binary_sparkml", "pred_binary_sparkml_label", "confidence_binary_sparkml", "pred_multiclass_sparkml", "pred_multiclass_sparkml_label")


def _ml(spark, sf):
    return predicted(spark, sf).where(F.col("row_number").cast("long") % 4 > 0).select(*IDENTITY_COLUMNS, *_ML)




_JOINED = S.chain(S.COMMENTS, S.PREDICTED, S.rules_cte("k", source="predicted"), final=f"""
SELECT event_id, kafka_partition, kafka_offset, author, local_risk_score, local_rule_tags, {', '.join(_ML)} FROM ruled WHERE n % 4 > 0""")
_OUT = ("event_id", "kafka_partition", "kafka_offset", "author", "local_risk_score", "local_rule_tags", *_ML)


def _rules(spark, sf):
    return ruled(spark, sf, "k").select(*IDENTITY_COLUMNS, *RULE_COLUMNS)


@query("e01_join_rules_ml", _JOINED)
def e01(spark, sf):
    return J.join_rules_ml(_rules(spark, sf), _ml(spark, sf)).select(*_OUT)


@query("e02_join_by_event_id", _JOINED)
def e02(spark, sf):
    return J.join_rules_ml(_rules(spark, sf), _ml(spark, sf), keys=J.FALLBACK_KEYS).select(*_OUT)


@query("e03_drop_shared", S.chain(S.COMMENTS, S.PREDICTED, final=f"SELECT event_id, {', '.join(_ML)} FROM predicted WHERE n % 4 > 0"))
def e03(spark, sf):
    return J.drop_shared(_ml(spark, sf), keep=("event_id",))


@query("e04_id_overlap", S.chain(S.COMMENTS, final="""
SELECT count(*) AS overlap FROM (SELECT author FROM comments WHERE n <= 300) a JOIN (SELECT author FROM comments WHERE n > 200) b USING (author)"""))
def e04(spark, sf):
    df = comments(spark, sf)
    return J.id_overlap(row_range(df, 0, 300), row_range(df, 201), key="author")


@query("e05_attach_class_weight", S.chain(S.CORPUS, """
w AS (SELECT label, (SELECT count(*) FROM corpus)::DOUBLE / ((SELECT count(DISTINCT label) FROM corpus) * count(*)) AS weight FROM corpus GROUP BY label)""",
       final="SELECT comment_id, label, weight FROM corpus JOIN w USING (label)"))
def e05(spark, sf):
    return J.attach_class_weight(tables.corpus(spark, sf), "label").select("comment_id", "label", "weight")


@query("e06_attach_label_names", S.chain(S.CORPUS, final="""
SELECT comment_id, CASE label WHEN 0 THEN 'ofensivo_directo' WHEN 1 THEN 'odio_agresion_grupal' WHEN 2 THEN 'neutral_no_ofensivo' ELSE 'vulgaridad_contextual' END AS label_multiclass_name,
  CASE WHEN label < 2 THEN 1 ELSE 0 END AS label_binary_v2, CASE WHEN label < 2 THEN 'ofensivo' ELSE 'no_ofensivo' END AS label_binary_name_v2 FROM corpus"""))
def e06(spark, sf):
    return J.attach_label_names(tables.corpus(spark, sf)).select("comment_id", "label_multiclass_name", "label_binary_v2", "label_binary_name_v2")


@query("e07_join_by_key", S.chain(S.COMMENTS, S.PREDICTED, S.rules_cte("l", source="predicted"), final=f"""
SELECT event_id, {', '.join(_ML)}, has_fraude, local_risk_score FROM ruled WHERE n % 4 > 0"""))
def e07(spark, sf):
    flags = ruled(spark, sf, "l").select("event_id", "has_fraude", "local_risk_score")
    return J.join_by_key(_ml(spark, sf), flags).select("event_id", *_ML, "has_fraude", "local_risk_score")
