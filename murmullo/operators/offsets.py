"""Topic offsets as tables: snapshots, deltas from a cursor, totals, lag and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

PARTITION_KEYS = ("kafka_topic", "kafka_partition")


def offset_stats(raw: DataFrame) -> DataFrame:
    """Lowest and highest offset and row count per partition."""
    return raw.groupBy("kafka_partition").agg(
        F.min("kafka_offset").alias("min_offset"),
        F.max("kafka_offset").alias("max_offset"),
        F.count(F.lit(1)).alias("records"),
    )


def end_offsets(raw: DataFrame) -> DataFrame:
    """(topic, partition, end_offset): the next offset of every partition."""
    return raw.groupBy(*PARTITION_KEYS).agg((F.max("kafka_offset") + 1).alias("end_offset"))


def snapshot_range(raw: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows of a landed topic between per-partition bounds (start inclusive, end exclusive).

    ``bounds`` has one row per topic partition with columns start_offset and end_offset.
    """
    inside = (F.col("kafka_offset") >= F.col("start_offset")) & (F.col("kafka_offset") < F.col("end_offset"))
    # brokers hold some thousand partitions at most; a join by partition would put a whole
    # partition's rows into one task
    return raw.join(F.broadcast(bounds), list(PARTITION_KEYS), "inner").where(inside).drop("start_offset", "end_offset")


def delta_plan(ends: DataFrame, cursor: DataFrame, limit: int) -> DataFrame:
    """Which offsets a reader with a saved cursor should fetch next, per partition.

    Every partition gets ``limit // partitions + 1`` rows at most, and all together no more than
    ``limit``, partitions served in order. Returns start, end of the slice, the new cursor and lag.
    """
    known = ends.join(cursor.select(*PARTITION_KEYS, F.col("next_offset")), list(PARTITION_KEYS), "left")
    start = F.least(F.greatest(F.coalesce("next_offset", F.lit(0)), F.lit(0)), F.col("end_offset"))
    in_topic = Window.partitionBy("kafka_topic")  # one row per partition of a topic
    quota = F.floor(F.lit(limit) / F.count(F.lit(1)).over(in_topic)).cast("long") + 1
    sized = known.select(*PARTITION_KEYS, "end_offset", start.cast("long").alias("start_offset"), quota.alias("_quota"))
    wish = sized.withColumn("_want", F.least("_quota", F.col("end_offset") - F.col("start_offset")))
    served = Window.partitionBy("kafka_topic").orderBy("kafka_partition").rowsBetween(Window.unboundedPreceding, -1)
    take = F.greatest(F.lit(0), F.least(F.col("_want"), F.lit(limit) - F.coalesce(F.sum("_want").over(served), F.lit(0))))
    return wish.withColumn("next_offset", F.col("start_offset") + take).select(
        *PARTITION_KEYS, "start_offset", "next_offset", "end_offset",
        F.greatest(F.lit(0), F.col("end_offset") - F.col("next_offset")).alias("lag"),
    )


def read_delta(raw: DataFrame, cursor: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows after a cursor within the quota, and the plan holding the new cursor and lag."""
    plan = delta_plan(end_offsets(raw), cursor, limit)
    slices = plan.select(*PARTITION_KEYS, "start_offset", F.col("next_offset").alias("end_offset"))
    return snapshot_range(raw, slices), plan


def topic_totals(offsets: DataFrame) -> DataFrame:
    return offsets.groupBy("kafka_topic").agg(F.sum("end_offset").alias("total"))


def consumer_lag(offsets: DataFrame, committed: DataFrame) -> DataFrame:
    """Rows not yet committed, per topic; a missing commit counts from 0."""
    joined = offsets.join(committed, list(PARTITION_KEYS), "left")
    behind = F.greatest(F.lit(0), F.col("end_offset") - F.coalesce("committed_offset", F.lit(0)))
    return joined.groupBy("kafka_topic").agg(F.sum(behind).alias("lag"))


def normalised_progress(offsets: DataFrame, committed: DataFrame) -> DataFrame:
    """Processed rows per topic: commits never count beyond what the partition holds."""
    joined = offsets.join(committed, list(PARTITION_KEYS), "left")
    done = F.least(F.col("end_offset"), F.greatest(F.coalesce("committed_offset", F.lit(0)), F.lit(0)))
    return joined.groupBy("kafka_topic").agg(
        F.least(F.sum("end_offset"), F.sum(done)).alias("normalised"), F.sum("end_offset").alias("total")
    )


def rates(snapshots: DataFrame) -> DataFrame:
    """Messages per second between consecutive snapshots (topic, ts, total) of each topic; 0 for the first."""
    order = Window.partitionBy("kafka_topic").orderBy("ts")
    grown = F.greatest(F.col("total") - F.lag("total").over(order), F.lit(0))
    elapsed = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))) / 1e6
    rate = F.when(elapsed > 0, F.round(grown / elapsed, 3)).otherwise(0.0)
    return snapshots.select("kafka_topic", "ts", "total", rate.alias("rate"))
