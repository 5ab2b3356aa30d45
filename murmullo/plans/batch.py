"""End-to-end runs: from raw comments to hybrid risk, as one pass or as stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from murmullo.operators.aggregates import minute_aggregates_hybrid
from murmullo.operators.batches import append_status, assign_batch, ledger_latest, pick_batches, stored_table, write_batch
from murmullo.operators.hybrid import score_hybrid
from murmullo.operators.joins import join_rules_ml
from murmullo.operators.rules import FLAG_COLUMNS, add_rules
from murmullo.plans.training import ModelBundle, apply_models, infer
from murmullo.functions.text import clean_text
from murmullo.session import materialize

# Identity columns every stage carries, and stage names.
IDENTITY_COLUMNS = (
    "event_id", "row_number", "source_s3_path", "kafka_topic", "kafka_partition", "kafka_offset",
    "kafka_timestamp", "source_file", "video_id", "timestamp_text", "timestamp_usec", "video_offset_msec",
    "author", "author_channel_id", "message_raw", "message_clean",
)
RULE_COLUMNS = ("minute", "text_norm", *FLAG_COLUMNS, "local_risk_score", "local_rule_tags")
STAGES = ("raw", "rules", "ml", "hybrid", "aggregates")


def _existing(df: DataFrame, columns) -> list[str]:
    return [c for c in columns if c in df.columns]


def rules_stage(raw: DataFrame, rules="k", extra=()) -> DataFrame:
    scored = add_rules(raw, rules)
    return scored.select(*_existing(scored, (*IDENTITY_COLUMNS, *RULE_COLUMNS, *extra)))


def ml_stage(raw: DataFrame, models: ModelBundle, extra=()) -> DataFrame:
    scored = infer(raw, models)
    columns = (
        *IDENTITY_COLUMNS, "text_clean", "pred_binary_sparkml", "pred_binary_sparkml_label", "confidence_binary_sparkml",
        "confidence_binary_bucket", "pred_multiclass_sparkml", "pred_multiclass_sparkml_label", "confidence_multiclass_sparkml", *extra,
    )
    return scored.select(*_existing(scored, columns))


def score_in_one_pass(raw: DataFrame, models: ModelBundle, rules="k") -> DataFrame:
    """Rules, predictions and hybrid risk of the same rows without the join of two stage tables.

    Both sides are per-row functions of the raw table, so no row has to move.
    """
    ruled = add_rules(raw, rules).withColumn("text_clean", clean_text(F.col("message_clean")))
    return score_hybrid(apply_models(ruled, models), "k")


def _status(spark: SparkSession, batches: DataFrame, job: str, status: str, size: int, message: str) -> DataFrame:
    return batches.select(
        "batch_id", F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"),
        F.lit("spark").alias("worker"), F.lit(status).alias("status"), F.lit(job).alias("current_job"),
        F.lit(message).alias("message"), "range_start", "range_end", F.col("range_end").alias("target_count"),
        F.lit(size).cast("bigint").alias("spark_batch_size"), "rows",
    )


def done_batches(spark: SparkSession, ledger_path: str) -> DataFrame | None:
    """Ids of the batches that the ledger has as done."""
    log = stored_table(spark, ledger_path)
    return None if log is None else ledger_latest(log).where("status = 'done'").select("batch_id")


def landed_ranges(landed: DataFrame, size: int) -> DataFrame:
    """(batch_id, range_start, range_end, rows, complete) of landed batches."""
    ranges = landed.groupBy("batch_id").agg(
        F.max("range_start").alias("range_start"), F.max("range_end").alias("range_end"), F.count(F.lit(1)).alias("rows")
    )
    return materialize(ranges.withColumn("complete", F.col("rows") == size), "ranges")


def run_batch(raw: DataFrame, models: ModelBundle, root: str, size: int, rules="k", force: bool = False) -> dict[str, DataFrame]:
    """Raw rows of one or many ranges to curated tables below ``root``.

    The raw rows of every batch that isn't done (of all, if forced) are landed first, in the only read
    of ``raw``. Complete batches go on; each of the others is noted as waiting with its number of rows
    and keeps no other batch back. Each stage is a table of grouped batches and every write
    replaces whole batches, so a run that was cut short can simply be started again. Many ranges go
    through one Spark job. A table's folders are listed before and after its one write, and the join of
    stage tables sends neither of them to the driver.
    """
    spark, tables = raw.sparkSession, {}
    ledger_path, extra = f"{root}/ledger", ("batch_id",)
    batched = assign_batch(raw, size)
    done = None if force else done_batches(spark, ledger_path)
    if done is not None:
        done = materialize(done, "done")
        batched = batched.join(done, "batch_id", "left_anti")
    write_batch(batched, f"{root}/raw", size, force=True)
    tables["raw"] = spark.read.parquet(f"{root}/raw")
    landed = pick_batches(tables["raw"], size)
    ranges = landed_ranges(landed if done is None else landed.join(done, "batch_id", "left_anti"), size)
    todo = ranges.where("complete")
    append_status(spark, ledger_path, _status(spark, ranges.where("not complete"), "raw", "waiting", size, "incomplete"))

    def land(name: str, df: DataFrame) -> DataFrame:
        """Write a stage table; its rows of this run."""
        write_batch(df, f"{root}/{name}", size, force=True)
        append_status(spark, ledger_path, _status(spark, todo, name, "running", size, name))
        tables[name] = spark.read.parquet(f"{root}/{name}")
        return pick_batches(tables[name], size, todo)

    append_status(spark, ledger_path, _status(spark, todo, "raw", "running", size, "raw"))
    landed = pick_batches(tables["raw"], size, todo)
    ruled = land("rules", rules_stage(landed, rules, extra))
    predicted = land("ml", ml_stage(landed, models, extra))
    hybrid = land("hybrid", score_hybrid(join_rules_ml(ruled.hint("merge"), predicted.drop("batch_id")), "k"))
    land("aggregates", minute_aggregates_hybrid(hybrid, extra_keys=extra))
    append_status(spark, ledger_path, _status(spark, todo, "complete", "done", size, "complete"))
    return {**{name: pick_batches(tables[name], size) for name in STAGES}, "ledger": ledger_latest(spark.read.parquet(ledger_path))}
