"""What a batch run sends to the driver: lists of files, and no stage table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from murmullo.operators import batches as B
from murmullo.plans import batch, training


def _files(path):
    return {len(list(folder.glob("*.parquet"))) for folder in path.glob("batch_group=*")}


def test_a_folder_of_small_batches_is_one_file(spark, tmp_path):
    rows = B.assign_batch(spark.range(1, 6401).select(F.col("id").alias("row_number")), 10).select("row_number", "batch_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        B.write_batch(rows, str(tmp_path / "t"), 10)
        B.write_batch(rows.where("row_number <= 20"), str(tmp_path / "t"), 10, force=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert _files(tmp_path / "t") == {1}
    assert B.read_batches(spark, str(tmp_path / "t"), 10).count() == 6400


def test_a_file_has_so_many_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "FILE_ROWS", 160)  # 16 batches of 10 rows
    rows = B.assign_batch(spark.range(1, 1281).select(F.col("id").alias("row_number")), 10).select("row_number", "batch_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        B.write_batch(rows, str(tmp_path / "t"), 10)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert _files(tmp_path / "t") <= {3, 4}  # two of four may meet in a task


def test_run_batch_broadcasts_no_stage_table_and_lists_each_twice(spark, tmp_path, monkeypatch):
    train = spark.createDataFrame([(f"palabra{i % 7} otra", float(i % 2), float(i % 4)) for i in range(16)], "text_clean string, label_binary double, label_original double")
    models = training.fit_models(train, max_iter=1, stages=training.feature_stages(64))
    n = F.col("row_number").cast("long")
    raw = spark.range(1, 46).select(F.col("id").cast("string").alias("row_number")).withColumns({
        "event_id": F.concat(F.lit("e"), n), "kafka_topic": F.lit("t"), "kafka_partition": F.lit(0), "kafka_offset": n,
        "kafka_timestamp": F.timestamp_seconds(n), "source_file": F.lit("f"), "video_id": F.lit("v"), "timestamp_text": F.lit("0:01"), "video_offset_msec": F.lit("1000"),
        "author": F.lit("a"), "author_channel_id": F.lit("c"), "message_raw": F.lit("hola palabra1"), "message_clean": F.lit("hola palabra1")})
    plans, listed, score, reader = [], [], batch.score_hybrid, type(spark.read)
    monkeypatch.setattr(batch, "score_hybrid", lambda df, profile: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or score(df, profile))
    monkeypatch.setattr(reader, "parquet", lambda self, path, *more, f=reader.parquet: listed.append(path) or f(self, path, *more))
    for _ in range(2):
        listed.clear()
        out = batch.run_batch(raw, models, str(tmp_path), 10)
        assert all(re.search(r"Join Inner.*strategy=merge", plan) for plan in plans) and plans
        assert {name: listed.count(f"{tmp_path}/{name}") for name in batch.STAGES} == dict.fromkeys(batch.STAGES, 2)
        assert {r["status"]: r["count"] for r in out["ledger"].groupBy("status").count().collect()} == {"done": 4, "waiting": 1}
        assert out["raw"].count() == 45 and out["hybrid"].count() == 40 and out["aggregates"].agg(F.sum("comentarios")).first()[0] == 40
