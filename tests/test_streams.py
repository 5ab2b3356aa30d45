"""Partial tables, sessions with late events, and mergeable latency sketches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from murmullo.streaming import jobs, runner
from murmullo.streaming.partials import FAN, PartialTable, live, place

START = dt.datetime(2024, 1, 1)


def test_places_hold_every_batch_once_in_few_folders():
    content = {}  # folder -> last micro-batch that wrote it and what it holds
    for batch in range(1000):
        below = [f for f in live(batch - 1) if f[0] < place(batch)[0]]
        held = {batch}.union(*[content[t, s][1] for t, s, _ in below])
        content[place(batch)] = batch, held
        view = live(batch)
        assert all(content[t, s][0] == upto for t, s, upto in view)
        parts = [content[t, s][1] for t, s, _ in view]
        assert sum(map(len, parts)) == batch + 1 and set().union(*parts) == set(range(batch + 1))
        if batch == 200:
            assert len(content) <= 12 and len(view) <= 12
    assert len(content) <= 5 * (FAN - 1)


def test_partial_table_survives_a_repeated_batch(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, n long").schema
    add = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    table, beside = PartialTable(spark, f"{tmp_path}/a", schema, add), PartialTable(spark, f"{tmp_path}/b", schema)
    assert table.last() == -1 and table.read().count() == 0
    want = {}
    for batch in range(18):
        rows = [(f"k{i % 3}", batch * 10 + i) for i in range(batch % 4)]  # some micro-batches are empty
        for k, n in rows:
            want[k] = want.get(k, 0) + n
        df = spark.createDataFrame(rows, schema)
        for t in (table, beside):
            for _ in range(2 if batch in (3, 7, 9, 15) else 1):  # run again after a crash
                t.write(batch, df)
        if batch in (2, 3, 4, 14, 15, 17):
            for t in (table, beside):
                assert {r.k: r.n for r in add(t.read()).collect()} == {r.k: r.n for r in add(t.read(batch)).collect()} == want
    assert len(list(tmp_path.glob("a/*/*"))) <= 9
    with pytest.raises(ValueError):
        PartialTable(spark, "x", spark.createDataFrame([], "micro_slot int").schema)


def _events(rows):
    """(event_id, author, seconds or None) with the columns the stream queries read."""
    at = lambda s: None if s is None else START + dt.timedelta(seconds=s)
    return [(i, a, "tëxt " * (i % 3), "raw", at(s)) for i, a, s in rows]


SCHEMA = "event_id long, author string, message_clean string, message_raw string, kafka_timestamp timestamp"


def _sessions(rows, gap):
    out, by = [], {}
    for _, a, s in rows:
        by.setdefault(a or "", []).append(s)
    for a, times in by.items():
        times.sort()
        for s in times:
            if out and out[-1][0] == a and s - out[-1][2] <= gap:
                out[-1][2], out[-1][3] = s, out[-1][3] + 1
            else:
                out.append([a, s, s, 1])
    return sorted((a, START + dt.timedelta(seconds=b), START + dt.timedelta(seconds=e + gap), n) for a, b, e, n in out)


def test_sessions_of_any_spacing(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["ann", "bob", None, ""]), rnd.choice([0, 5, 10, 15, 20]) + 100 * rnd.randrange(12) + rnd.choice([0, 0.5])) for i in range(300)]
    df = spark.createDataFrame(_events(rows), SCHEMA).repartition(4)
    halves, native = jobs.author_sessions(df, "10 seconds"), jobs.native_sessions(df, "10 seconds")
    found = sorted(tuple(r)[:4] for r in halves.collect())
    assert found == _sessions(rows, 10)
    assert sorted(map(tuple, halves.collect())) == sorted(map(tuple, native.collect()))


def test_late_events_are_set_aside_and_nothing_is_lost(spark, tmp_path):
    rnd = random.Random(6)
    slices = [[(100 * b + i, rnd.choice(["ann", "bob"]), max(0, 40 * b + rnd.randrange(-90, 60))) for i in range(40)] + [(100 * b + 99, "ann", None)] for b in range(6)]
    partials = lambda e: jobs.session_partials(e, "10 seconds")

    def run():
        events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/topic")
        return runner.run_event_time(events, partials, "s", f"{tmp_path}/out", "30 seconds", jobs.session_merge, "kafka_timestamp", "last")

    taken, late, top = [], [], None
    for rows in slices:
        aside = [r for r in rows if r[2] is None or (top is not None and r[2] < top - 30)]
        late += aside
        taken += [r for r in rows if r not in aside]
        top = max([r[2] for r in rows if r not in aside] + ([] if top is None else [top]))
    for b, rows in enumerate(slices):
        spark.createDataFrame(_events(rows), SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/topic")
        if b == 3:
            run()  # a first run, and a second that goes on from its checkpoint
    partial, aside, mark = run()
    assert sorted(r.event_id for r in aside.collect()) == sorted(r[0] for r in late) and len(late) > 10
    sessions = jobs.session_totals(partial, "10 seconds", mark).collect()
    assert sorted(tuple(r)[:4] for r in sessions) == _sessions(taken, 10)
    assert sum(r.comments for r in sessions) + aside.count() == sum(map(len, slices))
    for r in sessions:
        assert r.is_closed == (r.session_end < START + dt.timedelta(seconds=top - 30))
    assert {r.is_closed for r in sessions} == {True, False}


def test_latency_quantiles_from_sketches(spark):
    rnd = random.Random(8)
    values = [int(rnd.lognormvariate(4, 1.5)) - 20 for _ in range(20_000)]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select(F.timestamp_millis(F.lit(0)).alias("a"), F.timestamp_millis("v").alias("b"))
    latencies = jobs.latencies(rows, "a", "b")
    parts = [jobs.latency_partials(latencies.where(F.pmod(F.xxhash64("ms"), F.lit(3)) == k)) for k in range(3)]
    merged = jobs.latency_merge(parts[0].union(parts[1]).union(parts[2]))
    ordered, n = sorted(values), len(values)
    for r in jobs.latency_totals(merged, (0.01, 0.5, 0.95, 1.0)).collect():
        true = ordered[max(1, -int(-r.quantile * n // 1)) - 1]
        assert r.least_ms <= true <= r.most_ms and r.least_ms <= r.latency_ms <= r.most_ms
        in_bin = sum(r.least_ms <= v <= r.most_ms for v in values)
        rank = sum(v <= r.latency_ms for v in values)
        ties = sum(v == r.latency_ms for v in values)
        assert rank - ties - jobs.RANK_ERROR * in_bin - 1 <= r.quantile * n <= rank + jobs.RANK_ERROR * in_bin + 1
    exact = jobs.exact_latency_stats(merged, latencies).first()
    assert exact.p50_latency_ms == (ordered[n // 2 - 1] + ordered[n // 2]) / 2 and exact.max_latency_ms == ordered[-1]
    assert tuple(jobs.latency_stats(rows.where("false"), "a", "b").first()) == (None,) * 4


def test_topic_is_landed_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    from checks import q_streams

    turns = [(conv, turn, "user", f"message {conv} {turn} " + "x" * 50) for conv in range(30) for turn in range(40)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(q_streams, "FILE_BYTES", 8000, raising=False)
    q_streams._topic(spark, str(tmp_path))
    landed = spark.read.parquet(q_streams._LANDED[spark.sparkContext.applicationId, str(tmp_path)][0])
    per_file = [r["count"] for r in landed.groupBy(F.input_file_name()).count().collect()]
    assert sum(per_file) == 1200 and max(per_file) <= 150
    found, late, _ = q_streams._event_time(spark, str(tmp_path))
    assert jobs.session_totals(found, q_streams.GAP).agg(F.sum("comments")).first()[0] + late.count() == 1200
    # slices are micro-batches whatever the number of their files
    times = {b: [t for p, o, t in landed.select("partition", "offset", F.unix_micros("timestamp")).collect() if p * 2 + o % 2 == b] for b in range(6)}
    marks = [max((t for b in range(batch) for t in times[b]), default=None) for batch in range(6)]
    assert late.count() == sum(1 for b in range(1, 6) for t in times[b] if t < marks[b] - 20_000_000)
