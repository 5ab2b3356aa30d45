"""Model training and inference (family K, A13, L08). Fitted values depend on the solver, so the queries
that return them have no SQL; beside them, ``*_checked`` queries state what holds whatever was fitted, and
the tables around them (K01-K03, K05, K10, F11-F15) have SQL."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks import sql as S
from checks.data import comments, rules, ruled
from checks.registry import query
from murmullo.operators.corpus import prepare_corpus
from murmullo.plans import batch, training
from murmullo.session import materialize, scratch_path
from checks import tables

_FITTED: dict = {}


def _models(spark, sf) -> training.ModelBundle:
    """Both models of a data folder, fitted once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITTED:
        _FITTED[key] = training.fit_models(prepare_corpus(tables.splits(spark, sf)["train"]))
    return _FITTED[key]


def _test(spark, sf):
    return prepare_corpus(tables.splits(spark, sf)["test"])


_PREDICTION = ("pred_binary_sparkml", "pred_binary_sparkml_label", "confidence_binary_sparkml", "confidence_binary_bucket",
               "pred_multiclass_sparkml", "pred_multiclass_sparkml_label", "confidence_multiclass_sparkml")


@query("k04_text_pipeline")
def k04(spark, sf):
    train = prepare_corpus(tables.splits(spark, sf)["train"])
    weighted = training.attach_class_weight(train, "label_binary", "weight_binary")
    model = training.build_pipeline("label_binary", "weight_binary", training.BINARY).fit(weighted)
    return model.transform(_test(spark, sf)).select("comment_id", training.BINARY)


@query("k06_fit_binary")
def k06_binary(spark, sf):
    models = training.fit_binary(prepare_corpus(tables.splits(spark, sf)["train"]))
    scored = training.apply_models(_test(spark, sf), models)
    return scored.groupBy("label_binary", training.BINARY).agg(F.count(F.lit(1)).alias("rows"))


@query("k06_fit_multiclass")
def k06_multi(spark, sf):
    models = training.fit_multiclass(prepare_corpus(tables.splits(spark, sf)["train"]))
    scored = training.apply_models(_test(spark, sf), models)
    return scored.groupBy("label_original", training.MULTI).agg(F.count(F.lit(1)).alias("rows"))


@query("k07_apply_models")
def k07(spark, sf):
    return training.apply_models(prepare_corpus(tables.corpus(spark, sf)), _models(spark, sf)).select("comment_id", *_PREDICTION)


@query("k08_evaluate")
def k08(spark, sf):
    parts = None
    for name, report in training.evaluate_heads(training.apply_models(_test(spark, sf), _models(spark, sf))).items():
        row = report["weighted"].withColumn("model", F.lit(name)).join(report["macro"].withColumn("model", F.lit(name)), "model")
        parts = row if parts is None else parts.unionByName(row)
    return parts


@query("k09_ngram_baseline")
def k09(spark, sf):
    key = (spark.sparkContext.applicationId, sf, "ngram")
    if key not in _FITTED:
        _FITTED[key] = training.fit_ngram_models(prepare_corpus(tables.splits(spark, sf)["train"]))
    return training.apply_ngram_models(_test(spark, sf), _FITTED[key]).select("comment_id", *_PREDICTION)


@query("k11_infer_lake")
def k11(spark, sf):
    return training.infer(ruled(spark, sf, "k"), _models(spark, sf)).select("event_id", "local_risk_score", *_PREDICTION)


@query("a13_save_load")
def a13(spark, sf):
    path = scratch_path(spark, "models")
    _models(spark, sf).save(path)
    return training.apply_models(prepare_corpus(tables.corpus(spark, sf)), training.ModelBundle.load(path)).select("comment_id", *_PREDICTION)


@query("l08_run_batch", S.chain(S.COMMENTS, S.rules_cte("k"), """
placed AS (SELECT *, 'batch_' || lpad(CAST(CAST(ceil(n / 50.0) AS BIGINT) * 50 AS VARCHAR), 7, '0') AS batch_id FROM ruled)""", final="""
SELECT batch_id, CASE WHEN count(*) = 50 THEN 'done' ELSE 'waiting' END AS status, count(*) AS rows,
  CAST(CASE WHEN count(*) = 50 THEN sum(local_risk_score) END AS BIGINT) AS score, CASE WHEN count(*) = 50 THEN count(*) FILTER (WHERE has_fraude) END AS fraude,
  CAST(CASE WHEN count(*) = 50 THEN count(*) END AS BIGINT) AS in_minutes FROM placed GROUP BY batch_id"""))
def l08(spark, sf):
    """Every range of 50 rows from raw to hybrid and aggregates, the last one waiting, then the same run again."""
    root, raw, models = scratch_path(spark, "curated"), comments(spark, sf), _models(spark, sf)
    for _ in range(2):  # the second run finds every complete range done
        out = batch.run_batch(raw, models, root, 50, rules("k"))
    hybrid = out["hybrid"].groupBy("batch_id").agg(F.sum("local_risk_score").alias("score"), F.count_if("has_fraude").alias("fraude"))
    minutes = out["aggregates"].groupBy("batch_id").agg(F.sum("comentarios").alias("in_minutes"))
    found = out["ledger"].select("batch_id", "status", "rows").join(hybrid, "batch_id", "left").join(minutes, "batch_id", "left")
    return found


@query("l08_one_pass")
def l08_one_pass(spark, sf):
    scored = batch.score_in_one_pass(comments(spark, sf), _models(spark, sf), rules("k"))
    return scored.select("event_id", "local_risk_score", "hybrid_risk_level", "hybrid_risk_reason")


# --- what holds for any fitted model


def _consistent(binary_probability=None):
    """Names fit the predictions, and buckets the confidences."""
    p, m, c = F.col("pred_binary_sparkml"), F.col("pred_multiclass_sparkml"), F.col("confidence_binary_sparkml")
    names = F.col("pred_binary_sparkml_label") == F.when(p == 1, "ofensivo").otherwise("no_ofensivo")
    bounds = (c >= 0.5) & (c <= 1) & (F.col("confidence_multiclass_sparkml") >= 0.25) & (F.col("confidence_multiclass_sparkml") <= 1)
    return p.isin(0, 1) & m.isin(0, 1, 2, 3) & names & bounds & F.col("pred_multiclass_sparkml_label").isNotNull() & F.col("confidence_binary_bucket").isNotNull()


_TEST_ROWS = "SELECT comment_id, true AS consistent FROM corpus WHERE split = 'test' AND trim(comment) <> ''"


@query("k04_text_checked", S.chain(S.CORPUS, final=_TEST_ROWS))
def k04_checked(spark, sf):
    """One row a document, and the confidence is the probability of the predicted class, which is the largest."""
    train = training.attach_class_weight(prepare_corpus(tables.splits(spark, sf)["train"]), "label_binary", "weight_binary")
    found = training.build_pipeline("label_binary", "weight_binary", training.BINARY, max_iter=5).fit(train).transform(_test(spark, sf))
    chances = vector_to_array(F.col(f"{training.BINARY}_probability"))
    at = F.get(chances, F.col(training.BINARY).cast("int"))
    ok = (at == F.array_max(chances)) & (F.abs(F.get(chances, F.lit(0)) + F.get(chances, F.lit(1)) - 1) < 1e-9)
    return found.select("comment_id", ok.alias("consistent"))


@query("k06_fit_checked", S.chain(S.CORPUS, final="""
SELECT 'binary' AS head, CASE WHEN label IN (0, 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, count(*) AS rows FROM corpus WHERE split = 'test' AND trim(comment) <> '' GROUP BY ALL
UNION ALL SELECT 'multiclass', CAST(label AS DOUBLE), count(*) FROM corpus WHERE split = 'test' AND trim(comment) <> '' GROUP BY ALL"""))
def k06_checked(spark, sf):
    """The cells of both fitted models add up per label."""
    scored = training.apply_models(_test(spark, sf), _models(spark, sf))
    cells = scored.groupBy("label_binary", training.BINARY, "label_original", training.MULTI).agg(F.count(F.lit(1)).alias("n"))
    binary = cells.where(F.col(training.BINARY).isin(0, 1)).groupBy("label_binary").agg(F.sum("n").alias("rows"))
    multi = cells.where(F.col(training.MULTI).isin(0, 1, 2, 3)).groupBy("label_original").agg(F.sum("n").alias("rows"))
    return binary.select(F.lit("binary").alias("head"), F.col("label_binary").alias("label"), "rows").union(multi.select(F.lit("multiclass"), "label_original", "rows"))


@query("k07_two_pipelines_checked", S.chain(S.CORPUS, final=_TEST_ROWS))
def k07_pipelines(spark, sf):
    """Two separately trained pipelines, saved and loaded, applied one after the other: each gives what it gives alone."""
    train = materialize(prepare_corpus(tables.splits(spark, sf)["train"]).select("text_clean", "label_binary", "label_original"), "train")
    path, test, alone = scratch_path(spark, "pipelines"), materialize(_test(spark, sf).select("comment_id", "text_clean"), "test"), {}
    for name in training.HEADS:
        training.fit_pipeline(train, name, max_iter=5).write().save(f"{path}/{name}")
        alone[name] = PipelineModel.load(f"{path}/{name}").transform(test).select("comment_id", F.col(name).cast("int").alias(f"alone_{name}"))
    both = training.apply_pipelines(test, *[PipelineModel.load(f"{path}/{name}") for name in (training.BINARY, training.MULTI)])
    same = both.join(alone[training.BINARY], "comment_id").join(alone[training.MULTI], "comment_id")
    equal = (F.col(training.BINARY) == F.col(f"alone_{training.BINARY}")) & (F.col(training.MULTI) == F.col(f"alone_{training.MULTI}"))
    return same.select("comment_id", (_consistent() & equal).alias("consistent"))


@query("k09_ngram_checked", S.chain(S.CORPUS, final=_TEST_ROWS))
def k09_checked(spark, sf):
    return k09(spark, sf).select("comment_id", _consistent().alias("consistent"))


@query("k07_apply_checked", S.chain(S.CORPUS, final="SELECT comment_id, true AS consistent FROM corpus"))
def k07_checked(spark, sf):
    return k07(spark, sf).select("comment_id", _consistent().alias("consistent"))


@query("k11_infer_checked", S.chain(S.COMMENTS, S.rules_cte("k"), final="SELECT event_id, local_risk_score, true AS consistent FROM ruled"))
def k11_checked(spark, sf):
    return k11(spark, sf).select("event_id", "local_risk_score", _consistent().alias("consistent"))


@query("a13_reload_checked", S.chain(S.CORPUS, final="SELECT count(*) AS rows, 0::BIGINT AS different FROM corpus"))
def a13_checked(spark, sf):
    before, after = k07(spark, sf), a13(spark, sf)
    both = before.join(after.toDF("comment_id", *[f"after_{c}" for c in _PREDICTION]), "comment_id")
    same = F.lit(True)
    for c in _PREDICTION:
        same = same & F.col(c).eqNullSafe(F.col(f"after_{c}"))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~same).alias("different"))


@query("k08_evaluate_checked", S.chain(S.CORPUS, final="""
SELECT 'pred_binary_sparkml' AS model, count(*) AS rows, 0::BIGINT AS wrong FROM corpus WHERE split = 'test'
UNION ALL SELECT 'pred_multiclass_sparkml', count(*), 0 FROM corpus WHERE split = 'test'"""))
def k08_checked(spark, sf):
    """Cells add up to the rows of every label, and accuracy is the weighted recall."""
    parts = None
    for name, report in training.evaluate_heads(training.apply_models(_test(spark, sf), _models(spark, sf))).items():
        cells = report["confusion"].agg(F.sum("count").alias("rows"))
        off = report["weighted"].agg(F.count_if(F.abs(F.col("accuracy") - F.col("weighted_recall")) > 1e-9).alias("wrong"))
        row = cells.select(F.lit(name).alias("model"), "rows", off.scalar().alias("wrong"))
        parts = row if parts is None else parts.union(row)
    return parts


@query("l08_one_pass_checked", S.chain(S.COMMENTS, S.rules_cte("k"), final="SELECT event_id, local_risk_score, true AS consistent FROM ruled"))
def l08_one_pass_checked(spark, sf):
    found = l08_one_pass(spark, sf)
    ok = F.col("hybrid_risk_level").isin("bajo", "medio", "alto") & (F.length("hybrid_risk_reason") > 0)
    return found.select("event_id", "local_risk_score", ok.alias("consistent"))
