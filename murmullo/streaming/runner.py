"""Starting and bounding stream queries: one checkpoint per query, one source read or several."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from murmullo.streaming.partials import PartialTable

POLL_SECONDS = 1


def start(results: DataFrame, name: str, root: str, fmt: str = "parquet", available_now: bool = False,
          every: str = "5 seconds", **options) -> StreamingQuery:
    """Start a query whose identity is its checkpoint folder ``root/checkpoints/name``.

    A restart continues where the last commit ended; the parquet sink writes each row once.
    """
    writer = (
        results.writeStream.queryName(name)
        .format(fmt)
        .outputMode("append")
        .option("checkpointLocation", f"{root}/checkpoints/{name}")
        .options(**options)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start(f"{root}/{name}") if fmt != "memory" else writer.start()


def run_available(results: DataFrame, name: str, root: str, timeout: int | None = None, messages: int | None = None,
                  idle: int | None = None) -> StreamingQuery:
    """Process what the source holds now and stop: the bounded run of a stream query.

    It also ends after ``timeout`` seconds, once ``messages`` have been read (the micro-batch that reaches
    the number is finished), or after ``idle`` seconds without a new micro-batch. What is left waits for the next run.
    """
    query = start(results, name, root, available_now=True)
    started = moved = time.time()
    read, batch = 0, -1
    while not query.awaitTermination(POLL_SECONDS):
        for progress in query.recentProgress:
            if progress["batchId"] > batch:
                read, batch, moved = read + progress["numInputRows"], progress["batchId"], time.time()
        late = timeout is not None and time.time() - started >= timeout
        silent = idle is not None and time.time() - moved >= idle
        if late or silent or (messages is not None and read >= messages):
            query.stop()
            query.awaitTermination()
            break
    return query


def run_partials(events: DataFrame, partials: Callable[[DataFrame], DataFrame], name: str, root: str,
                 merge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a partial aggregation over every micro-batch that the source holds now; returns all partial rows so far.

    A repeated micro-batch adds nothing twice. Any later event adds partial rows of its window, however old it is.
    ``merge`` adds up partial rows; folders of older micro-batches are merged as new ones come (see ``partials``).
    """
    table = PartialTable(events.sparkSession, f"{root}/{name}", partials(events).schema, merge)
    _run_batches(events, lambda batch, batch_id: table.write(batch_id, partials(batch)), name, root)
    return table.read()


def run_event_time(events: DataFrame, partials: Callable[[DataFrame], DataFrame], name: str, root: str, lateness: str,
                   merge: Callable[[DataFrame], DataFrame], time: str, latest: str) -> tuple[DataFrame, DataFrame, Column]:
    """As ``run_partials``, with late events set aside: (partial rows, late events, watermark so far).

    A micro-batch's watermark is the latest time of all events taken before it, less ``lateness``. Events before
    it, and events without a time, go to the table ``name-late`` as they are; all others are taken. The two hold every event
    once. ``latest`` is the partial column with the latest event time of its rows.
    """
    spark = events.sparkSession
    table = PartialTable(spark, f"{root}/{name}", partials(events).schema, merge)
    aside = PartialTable(spark, f"{root}/{name}-late", events.schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        mark = table.read(batch_id - 1).agg((F.max(latest) - F.expr(f"INTERVAL {lateness}")).alias("mark")).first()["mark"]
        late = F.col(time).isNull() if mark is None else F.col(time).isNull() | (F.col(time) < F.lit(mark))
        batch.persist()
        try:
            aside.write(batch_id, batch.where(late))
            table.write(batch_id, partials(batch.where(~late)))
        finally:
            batch.unpersist()

    _run_batches(events, write, name, root)
    taken = table.read()
    watermark = taken.agg((F.max(latest) - F.expr(f"INTERVAL {lateness}")).alias("mark")).scalar()
    return taken, aside.read(), watermark


def _run_batches(events: DataFrame, write: Callable[[DataFrame, int], None], name: str, root: str) -> None:
    query = (
        events.writeStream.foreachBatch(write).queryName(name)
        .option("checkpointLocation", f"{root}/checkpoints/{name}")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def fan_out(events: DataFrame, queries: Mapping[str, Callable[[DataFrame], DataFrame]], root: str,
            available_now: bool = True) -> dict[str, StreamingQuery]:
    """Several consumers of one source, each with its own checkpoint and its own pace."""
    return {name: start(query(events), name, root, available_now=available_now) for name, query in queries.items()}


def fan_out_shared(events: DataFrame, queries: Mapping[str, Callable[[DataFrame], DataFrame]], root: str) -> StreamingQuery:
    """Several stateless results from one read and one parse of each micro-batch.

    Files are written below a folder named after the batch id and replaced as a whole, so a
    repeated batch leaves no duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, query in queries.items():
                query(batch).write.mode("overwrite").parquet(f"{root}/{name}/micro_batch={batch_id}")
        finally:
            batch.unpersist()

    query = (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{root}/checkpoints/shared")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
