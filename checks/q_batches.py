"""Batch ranges (family M), disjointness (I02), ledger roll-ups and table profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.data import comments, read
from checks.registry import query
from murmullo.operators import batches as B
from murmullo.operators import feed as FD
from murmullo.operators.ingest import row_range
from murmullo.operators.rules import add_signals, is_alert
from checks.data import TEST_ACTORS, rules
from murmullo.session import scratch_path
from murmullo.sources.profile import profile_table, schema_rows

SIZE = 100

_TARGET = f"CAST(ceil(n / {SIZE}.0) AS BIGINT) * {SIZE}"
_BATCHED = f"""
batched AS (SELECT *, {_TARGET} AS target_count, 'batch_' || lpad(CAST({_TARGET} AS VARCHAR), 7, '0') AS batch_id FROM comments)"""


@query("m01_assign_batch", S.chain(S.COMMENTS, _BATCHED, final=f"""
SELECT event_id, batch_id, target_count, greatest(target_count - {SIZE} + 1, 1) AS range_start, target_count AS range_end FROM batched"""))
def m01(spark, sf):
    return B.assign_batch(comments(spark, sf), SIZE).select("event_id", "batch_id", "target_count", "range_start", "range_end")


@query("m02_check_complete", S.chain(S.COMMENTS, _BATCHED, final=f"SELECT batch_id, count(*) AS rows, count(*) = {SIZE} AS complete FROM batched GROUP BY 1"))
def m02(spark, sf):
    return B.check_complete(B.assign_batch(comments(spark, sf), SIZE), SIZE)


@query("m03_eligible_target", f"""
WITH t AS (SELECT count(*) AS n FROM conversations)
SELECT n // {SIZE} * {SIZE} AS eligible, least(n // {SIZE} * {SIZE}, 300) AS capped FROM t""")
def m03(spark, sf):
    total = read(spark, sf, "conversations").agg(F.count(F.lit(1)).alias("n"))
    return total.select(B.eligible_target(F.col("n"), SIZE).alias("eligible"), B.eligible_target(F.col("n"), SIZE, F.lit(300).cast("long")).alias("capped"))


# The ledger log: every batch of the comments gets 'running' and then a last state; the third from
# the end waits for a retry, the last two are missing.
_STATE = "CASE WHEN k > last - 2 THEN NULL WHEN k = last - 2 THEN 'retrying' ELSE 'done' END"
_LEDGER = f"""
targets AS (SELECT DISTINCT target_count, batch_id, target_count // {SIZE} AS k, (SELECT max(target_count) // {SIZE} FROM batched) AS last FROM batched),
ledger AS (SELECT batch_id, target_count, k, {_STATE} AS status FROM targets WHERE {_STATE} IS NOT NULL)"""


def _targets(spark, sf):
    targets = B.assign_batch(comments(spark, sf), SIZE).select("batch_id", "target_count", "range_start", "range_end").distinct()
    last = targets.agg(F.max("target_count").alias("m")).select("m").scalar()
    k = F.col("target_count") / SIZE
    state = F.when(k > last / SIZE - 2, F.lit(None).cast("string")).when(k == last / SIZE - 2, "retrying").otherwise("done")
    return targets.withColumn("final", state).where("final IS NOT NULL")


def _log(spark, sf):
    """Append-only status rows: created first, final state an hour later."""
    start = F.timestamp_seconds(F.lit(1704067200) + F.col("target_count"))
    steps = F.explode(F.array(
        F.struct(F.lit("running").alias("status"), F.lit("raw").alias("current_job"), F.lit(0).alias("h"), F.lit(0).cast("long").alias("rows")),
        F.struct(F.col("final").alias("status"), F.lit("complete").alias("current_job"), F.lit(1).alias("h"), F.lit(SIZE).cast("long").alias("rows")),
    ))
    rows = _targets(spark, sf).select("*", start.alias("created"), steps.alias("s"))
    return rows.select(
        "batch_id", F.col("created").alias("created_at"), F.timestamp_seconds(F.unix_seconds("created") + 3600 * F.col("s.h")).alias("updated_at"),
        F.lit("w").alias("worker"), "s.status", "s.current_job", F.lit("").alias("message"), "range_start", "range_end", "target_count",
        F.lit(SIZE).cast("long").alias("spark_batch_size"), "s.rows")


def _eligible(spark, sf) -> int:
    return B.range_stats(comments(spark, sf)).select(B.eligible_target(F.col("rows"), SIZE)).first()[0]


@query("m04_next_batch", S.chain(S.COMMENTS, _BATCHED, _LEDGER, final=f"""
SELECT coalesce(min(target_count), 0) AS next_target FROM ledger WHERE status = 'retrying'"""))
def m04(spark, sf):
    ledger = B.ledger_latest(_log(spark, sf))
    return B.next_batch(ledger, _eligible(spark, sf), SIZE)


@query("m04_next_missing", S.chain(S.COMMENTS, _BATCHED, _LEDGER, final=f"""
SELECT CASE WHEN target <= (SELECT count(*) // {SIZE} * {SIZE} FROM comments) THEN target ELSE 0 END AS next_target
FROM (SELECT coalesce(max(target_count), 0) + {SIZE} AS target FROM ledger)"""))
def m04_missing(spark, sf):
    ledger = B.ledger_latest(_log(spark, sf)).withColumn("status", F.lit("done"))
    return B.next_batch(ledger, _eligible(spark, sf), SIZE)


@query("g05_contiguous_done", S.chain(S.COMMENTS, _BATCHED, _LEDGER, final="SELECT coalesce(max(target_count), 0) AS contiguous_done FROM ledger WHERE status = 'done'"))
def g05(spark, sf):
    return B.contiguous_done(B.ledger_latest(_log(spark, sf)), _eligible(spark, sf), SIZE)


@query("m05_write_batch", S.chain(S.COMMENTS, _BATCHED, final="""
SELECT batch_id, count(*) AS rows, CASE WHEN min(target_count) <= 200 THEN 1 WHEN min(target_count) <= 300 THEN 3 ELSE 2 END AS version FROM batched GROUP BY 1"""))
def m05(spark, sf):
    path = scratch_path(spark, "batches")
    batched = B.assign_batch(comments(spark, sf), SIZE).select("event_id", "target_count", "batch_id")

    def version(n):
        return batched.withColumn("version", F.lit(n))

    B.write_batch(version(1).where("target_count <= 300"), path, SIZE)
    B.write_batch(version(2), path, SIZE)  # 1-3 are recorded and stay; the rest is new
    B.write_batch(version(3).where("target_count = 300"), path, SIZE, force=True)
    return B.read_batches(spark, path, SIZE).groupBy("batch_id").agg(F.count(F.lit(1)).alias("rows"), F.max("version").alias("version"))


_TIMES = f"make_timestamp((1704067200 + target_count) * 1000000)"


@query("m06_ledger_latest", S.chain(S.COMMENTS, _BATCHED, _LEDGER, final=f"""
SELECT batch_id, status, 'complete' AS current_job, {SIZE}::BIGINT AS rows, {_TIMES} AS created_at, {_TIMES} + INTERVAL 1 HOUR AS updated_at FROM ledger"""))
def m06(spark, sf):
    path = scratch_path(spark, "ledger")
    B.append_status(spark, path, _log(spark, sf))
    return B.ledger_latest(spark.read.parquet(path)).select("batch_id", "status", "current_job", "rows", "created_at", "updated_at")


@query("m06_stage_status", S.chain(S.COMMENTS, _BATCHED, _LEDGER, final=f"""
SELECT batch_id, 'raw' AS current_job, 'running' AS status, 0::BIGINT AS rows FROM ledger UNION ALL
SELECT batch_id, 'complete', status, {SIZE} FROM ledger"""))
def m06_stages(spark, sf):
    return B.stage_status(_log(spark, sf)).select("batch_id", "current_job", "status", "rows")


@query("m07_ledger_summary", S.chain(S.COMMENTS, _BATCHED, _LEDGER, final="""
SELECT coalesce(max_by(batch_id, target_count), '') AS latest_batch_id, 0::BIGINT AS active_batches, count(*) FILTER (WHERE status = 'done') AS done_batches, 0::BIGINT AS failed_batches FROM ledger"""))
def m07(spark, sf):
    return B.ledger_summary(B.ledger_latest(_log(spark, sf)))


@query("m08_rows_to_resume", S.chain(S.COMMENTS, final="SELECT event_id FROM comments WHERE n <= 400 AND (n > 150 OR n % 10 = 0)"))
def m08(spark, sf):
    lake = comments(spark, sf)
    landed = row_range(lake, 0, 150).where(F.col("row_number").cast("long") % 10 != 0)
    return B.rows_to_resume(lake, landed, 400).select("event_id")


@query("m08_resume_point", S.chain(S.COMMENTS, final="SELECT count(*) + 1 AS start_row, greatest(0, 400 - count(*)) AS remaining FROM comments WHERE n <= 150"))
def m08_point(spark, sf):
    return B.resume_point(row_range(comments(spark, sf), 0, 150), 400)


def _disjoint_sql(low: int, expected: int = 0) -> str:
    counts = f"AND a_rows = {expected} AND b_rows = {expected}" if expected else ""
    return S.chain(S.COMMENTS, f"""
facts AS (SELECT count(*) FILTER (WHERE n <= 200) AS a_rows, min(n) FILTER (WHERE n <= 200) AS a_min, max(n) FILTER (WHERE n <= 200) AS a_max,
  count(*) FILTER (WHERE n > {low}) AS b_rows, min(n) FILTER (WHERE n > {low}) AS b_min, max(n) FILTER (WHERE n > {low}) AS b_max,
  count(*) FILTER (WHERE n > {low} AND n <= 200) AS overlap FROM comments)""",
                   final=f"SELECT *, coalesce(overlap = 0 AND a_max < b_min {counts}, false) AS disjoint FROM facts")


@query("i02_validate_disjoint", _disjoint_sql(200))
def i02(spark, sf):
    df = comments(spark, sf)
    return B.validate_disjoint(row_range(df, 1, 200), row_range(df, 201))


@query("i02_overlapping", _disjoint_sql(150, 200))
def i02_overlap(spark, sf):
    df = comments(spark, sf)
    return B.validate_disjoint(row_range(df, 1, 200), row_range(df, 151), expected=200)


@query("i03_unified_feed", S.chain(S.COMMENTS, S.SIGNALS, _BATCHED, _LEDGER, """
flagged AS (SELECT * FROM signals WHERE has_ethnic_racial_slur OR has_homophobic_slur OR (has_terruqueo AND has_general_insult)
  OR (has_fraude AND has_electoral_institution) OR local_risk_score >= 4)""", final=f"""
SELECT 'stream' AS source, 'political_signals' AS event_type, NULL AS job_name, message_text AS text, event_id, kafka_partition AS source_partition,
  CAST(kafka_offset AS BIGINT) AS source_offset, NULL AS output_path FROM signals UNION ALL
SELECT 'alert', 'risk_alert', NULL, message_text, event_id, kafka_partition, kafka_offset, NULL FROM flagged UNION ALL
SELECT 'spark', 'spark_batch_output', batch_id, status || ': {SIZE} filas escritas', NULL, 0, target_count, 'out/hybrid/batch_group=' || CAST((target_count // {SIZE} - 1) // 64 AS INTEGER) FROM ledger"""))
def i03(spark, sf):
    found = FD.signal_feed(add_signals(comments(spark, sf), rules("s"), TEST_ACTORS), is_alert())
    return FD.unified_feed(found, B.ledger_latest(_log(spark, sf)), "out/hybrid", SIZE).select(
        "source", "event_type", "job_name", "text", "event_id", "source_partition", "source_offset", "output_path")


@query("f24_profile_table", """
WITH s AS (SELECT doc_id, source, lang, length(text)::BIGINT AS chars FROM documents ORDER BY doc_id LIMIT 5)
SELECT doc_id, source, lang, chars, (SELECT count(*) FROM documents) AS total_rows FROM s""")
def f24(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "source", "lang", F.length("text").cast("long").alias("chars"))
    return profile_table(docs, ["doc_id"], 5)


@query("f24_schema", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS filled FROM documents"
    for c, t in (("doc_id", "bigint"), ("lang", "string"), ("n_chars", "bigint"), ("source", "string"), ("text", "string"))))
def f24_schema(spark, sf):
    return schema_rows(read(spark, sf, "documents"))
