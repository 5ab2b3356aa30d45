"""Row-range batches as tables: assignment, completeness, progress, ledger and idempotent writes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Ledger states and retry bound.
ACTIVE_STATES = ("launching", "queued", "running")
MAX_ATTEMPTS = 3

LEDGER_SCHEMA = (
    "batch_id string, created_at timestamp, updated_at timestamp, worker string, status string, "
    "current_job string, message string, range_start bigint, range_end bigint, target_count bigint, "
    "spark_batch_size bigint, rows bigint"
)


def batch_id_of(target: Column) -> Column:
    """``batch_`` and the target padded to seven digits; longer targets keep all their digits."""
    digits = target.cast("string")
    return F.concat(F.lit("batch_"), F.when(F.length(digits) < 7, F.lpad(digits, 7, "0")).otherwise(digits))


def assign_batch(df: DataFrame, size: int, number: str = "row_number") -> DataFrame:
    """Add target_count, batch_id, range_start and range_end of each row's batch."""
    row = F.col(number).try_cast("long")
    target = F.ceil(row / size).cast("long") * size
    return df.withColumn("target_count", target).withColumns(
        {
            "batch_id": batch_id_of(F.col("target_count")),
            "range_start": F.greatest(F.col("target_count") - size + 1, F.lit(1)),
            "range_end": F.col("target_count"),
        }
    )


def check_complete(batched: DataFrame, size: int) -> DataFrame:
    """Rows per batch and whether the range is complete."""
    counts = batched.groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("complete", F.col("rows") == size)


def require_complete(batched: DataFrame, size: int) -> None:
    """Stop the job when a range has another number of rows than its size."""
    bad = check_complete(batched, size).where(~F.col("complete")).orderBy("batch_id").limit(5).collect()
    if bad:
        raise ValueError("incomplete batches: " + ", ".join(f"{r['batch_id']} has {r['rows']}" for r in bad))


def eligible_target(raw_total: Column, size: int, cap: Column | None = None) -> Column:
    """Highest batch target the landed rows fill, not above the cap."""
    full = F.floor(raw_total / size).cast("long") * size
    return full if cap is None else F.least(full, cap)


def expected_batches(ledger: DataFrame, eligible: int, size: int) -> DataFrame:
    """Every target up to the eligible one with its ledger status ('pending' when missing)."""
    spark = ledger.sparkSession
    targets = spark.range(size, eligible + 1, size).withColumnRenamed("id", "target_count")
    known = ledger.drop("batch_id", "range_start", "range_end")
    return targets.join(known, "target_count", "left").withColumns(
        {
            "batch_id": batch_id_of(F.col("target_count")),
            "range_start": F.greatest(F.col("target_count") - size + 1, F.lit(1)),
            "range_end": F.col("target_count"),
            "status": F.coalesce("status", F.lit("pending")),
        }
    )


def contiguous_done(ledger: DataFrame, eligible: int, size: int) -> DataFrame:
    """High-water mark: the last target before the first batch that is not done.

    A plain minimum over the expected targets; no ordered pass over the ledger is needed.
    """
    targets = expected_batches(ledger, eligible, size)
    first_open = F.min(F.when(F.col("status") != "done", F.col("target_count")))
    return targets.agg(F.coalesce(first_open - size, F.max("target_count"), F.lit(0)).alias("contiguous_done"))


def next_batch(ledger: DataFrame, eligible: int, size: int, now: Column | None = None) -> DataFrame:
    """Target to start next (0 for none).

    Only the first batch that is not done is considered: it starts when it is missing, or when it
    waits for a retry that is allowed and due. Nothing starts while a batch is active.
    """
    now = F.current_timestamp() if now is None else now
    optional = {"retryable": "boolean", "attempts": "int", "next_retry_at": "timestamp"}
    ledger = ledger.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in ledger.columns})
    due = (
        (F.col("status") == "retrying")
        & F.coalesce("retryable", F.lit(True))
        & (F.coalesce("attempts", F.lit(0)) < MAX_ATTEMPTS)
        & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))
    )
    targets = expected_batches(ledger, eligible, size).select(
        "target_count", "status", ((F.col("status") == "pending") | due).alias("startable")
    )
    open_only = targets.where(F.col("status") != "done")
    first_open = open_only.agg(F.min_by(F.struct("target_count", "startable"), "target_count").alias("f")).select("f")
    active = ledger.agg(F.count_if(F.col("status").isin(*ACTIVE_STATES)).alias("n")).scalar()
    return first_open.select(
        F.when((active == 0) & F.col("f.startable"), F.col("f.target_count")).otherwise(0).alias("next_target")
    )


def ledger_latest(ledger_log: DataFrame) -> DataFrame:
    """Latest status row per batch of an append-only ledger; creation time from the first row."""
    newest = F.max_by(
        F.struct("worker", "status", "current_job", "message", "range_start", "range_end", "target_count", "spark_batch_size", "rows"),
        "updated_at",
    )
    latest = ledger_log.groupBy("batch_id").agg(
        F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), newest.alias("n")
    )
    return latest.select("batch_id", "created_at", "updated_at", "n.*")


def stage_status(ledger_log: DataFrame) -> DataFrame:
    """Latest status and rows of every stage of every batch."""
    return ledger_log.groupBy("batch_id", "current_job").agg(
        F.max_by("status", "updated_at").alias("status"),
        F.max_by("rows", "updated_at").alias("rows"),
        F.max("updated_at").alias("updated_at"),
    )


def append_status(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Append status rows to the ledger table."""
    fields = [c.split(" ")[0] for c in LEDGER_SCHEMA.split(", ")]
    rows.select(*fields).write.mode("append").parquet(path)


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """Latest batch by range end, and active / done / failed counts."""
    status = F.col("status")
    return ledger.agg(
        F.coalesce(F.max_by("batch_id", "range_end"), F.lit("")).alias("latest_batch_id"),
        F.count_if(status.isin("queued", "running")).alias("active_batches"),
        F.count_if(status == "done").alias("done_batches"),
        F.count_if(status == "failed").alias("failed_batches"),
    )


GROUP = "batch_group"  # folder of a batch table
BATCHES_PER_GROUP = 64
FILE_ROWS = 100_000  # a file of a batch table has whole batches of so many rows, or one batch


def _batch_index(batch_id: Column, size: int) -> Column:
    return F.substring_index(batch_id, "_", -1).cast("long") / size - 1


def batch_group(batch_id: Column, size: int) -> Column:
    """Folder number of a batch: 64 batches of ``size`` rows that follow each other share one."""
    return F.floor(_batch_index(batch_id, size) / BATCHES_PER_GROUP).cast("int")


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that may not have been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def write_batch(batched: DataFrame, path: str, size: int, force: bool = False) -> None:
    """Write batches (column batch_id) into a table of grouped folders so that a re-run changes nothing it should not.

    A batch already in the table is left alone; ``force`` replaces exactly the batches given. A write replaces the folders
    of its batches as a whole and carries the other batches of those folders along. Rows of a folder's files are ordered by
    batch_id, so a reader of one batch skips the row groups of others.
    """
    rows = batched.withColumn(GROUP, batch_group(F.col("batch_id"), size))
    known = stored_table(batched.sparkSession, path)
    if known is not None:
        ids = rows.select(GROUP, "batch_id").distinct()
        if force:
            others = known.join(ids.select("batch_id"), "batch_id", "left_anti")
        else:
            there = known.select("batch_id").distinct()
            rows, ids, others = (rows.join(there, "batch_id", "left_anti"), ids.join(there, "batch_id", "left_anti"), known)
        touched = others.join(ids.select(GROUP).distinct(), GROUP, "left_semi")
        rows = rows.unionByName(touched.select(rows.columns))
    # batches that follow each other go to one task, a file's worth: every listing of the table tells the driver of each file
    following = F.floor(_batch_index(F.col("batch_id"), size) / max(FILE_ROWS // size, 1))
    (
        rows.repartition(GROUP, following).sortWithinPartitions(GROUP, "batch_id").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(GROUP)
        .parquet(path)
    )


def read_batches(spark: SparkSession, path: str, size: int, ids: DataFrame | None = None) -> DataFrame:
    """Rows of a batch table, of the given batches (batch_id) only if told; their folders prune the scan."""
    return pick_batches(spark.read.parquet(path), size, ids)


def pick_batches(table: DataFrame, size: int, ids: DataFrame | None = None) -> DataFrame:
    """As ``read_batches``, of a table whose folders have been listed (``stored_table``) and not written since."""
    if ids is not None:
        wanted = ids.select("batch_id").distinct().withColumn(GROUP, batch_group(F.col("batch_id"), size))
        table = table.join(wanted, [GROUP, "batch_id"], "left_semi")
    return table.drop(GROUP)


def rows_to_resume(lake: DataFrame, landed: DataFrame, cap: int, key: str = "event_id") -> DataFrame:
    """Lake rows within the cap that have not landed yet, by key (robust to gaps)."""
    within = lake.where(F.col("row_number").try_cast("long") <= cap)
    return within.join(landed.select(key), key, "left_anti")


def resume_point(landed: DataFrame, cap: int) -> DataFrame:
    """Next row number and remaining count when rows landed without gaps."""
    return landed.agg(F.count(F.lit(1)).alias("landed")).select(
        (F.col("landed") + 1).alias("start_row"), F.greatest(F.lit(0), F.lit(cap) - F.col("landed")).alias("remaining")
    )


def range_stats(batch: DataFrame) -> DataFrame:
    number = F.col("row_number").try_cast("long")
    return batch.agg(F.count(F.lit(1)).alias("rows"), F.min(number).alias("min_row"), F.max(number).alias("max_row"))


def validate_disjoint(first: DataFrame, second: DataFrame, expected: int = 0, key: str = "event_id") -> DataFrame:
    """One-row verdict: no shared id, first range before second, and the expected counts.

    ``overlap`` is the number of matching pairs of non-null ids. Each batch is read once: both, tagged, are counted per id and then added up.
    """
    number = F.col("row_number").try_cast("long").alias("_number")
    tagged = first.select(F.lit(True).alias("_a"), F.col(key).alias("_id"), number).union(second.select(F.lit(False), F.col(key), number))
    a, b = F.col("_a"), ~F.col("_a")
    per_id = tagged.groupBy("_id").agg(
        F.count_if(a).alias("a_rows"), F.count_if(b).alias("b_rows"), F.min(F.when(a, F.col("_number"))).alias("a_min"), F.max(F.when(a, F.col("_number"))).alias("a_max"),
        F.min(F.when(b, F.col("_number"))).alias("b_min"), F.max(F.when(b, F.col("_number"))).alias("b_max"))
    pairs = F.when(F.col("_id").isNotNull(), F.col("a_rows") * F.col("b_rows"))
    facts = per_id.agg(
        F.coalesce(F.sum("a_rows"), F.lit(0)).alias("a_rows"), F.min("a_min").alias("a_min"), F.max("a_max").alias("a_max"),
        F.coalesce(F.sum("b_rows"), F.lit(0)).alias("b_rows"), F.min("b_min").alias("b_min"), F.max("b_max").alias("b_max"),
        F.coalesce(F.sum(pairs), F.lit(0)).alias("overlap"))
    valid = (F.col("overlap") == 0) & (F.col("a_max") < F.col("b_min"))
    if expected:
        valid = valid & (F.col("a_rows") == expected) & (F.col("b_rows") == expected)
    return facts.withColumn("disjoint", F.coalesce(valid, F.lit(False)))
