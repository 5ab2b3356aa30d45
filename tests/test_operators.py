"""Operators: numbering, dedup, batches, hybrid boundaries, metrics."""

import itertools
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from murmullo.operators import batches as B
from murmullo.operators import hybrid as H
from murmullo.operators import ingest as I
from murmullo.operators import joins as J
from murmullo.operators import metrics as M
from murmullo.operators import offsets as O
from murmullo.sources import files, topics


def test_numbering_with_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("g"), (F.col("id") * 7919 % 3001).alias("o"))
    rows = I.number_rows(I.number_rows(df, ["o"]), ["o"], within=["g"], name="r").collect()
    for i, row in enumerate(sorted(rows, key=lambda r: r["o"]), start=1):
        assert row["row_number"] == i
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r["g"], r["o"])), key=lambda r: r["g"]):
        ranks = [r["r"] for r in group]
        assert ranks == list(range(1, 1 + len(ranks)))


def test_dedup_limits_copies_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, o int")
    result = I.dedup_comments(df, ["o"], ["k"])
    assert sorted(map(tuple, result.collect())) == [("a", 1), ("b", 3)]
    assert result._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


@settings(max_examples=10, deadline=None)
@given(st.integers(1, 60), st.integers(1, 9))
def test_batches_partition_the_rows(spark, n, size):
    df = spark.range(1, n + 1).select(F.col("id").cast("string").alias("row_number"), F.col("id").cast("string").alias("event_id"))
    rows = B.assign_batch(df, size).collect()
    for r in rows:
        assert r["range_start"] <= int(r["row_number"]) <= r["range_end"]
        assert r["batch_id"] == f"batch_{r['target_count']:07d}"
    done = B.check_complete(B.assign_batch(df, size), size).where("complete").count()
    assert done == n // size
    if n > size:
        verdict = B.validate_disjoint(I.row_range(df, 1, size), I.row_range(df, size + 1), 0).first()
        assert verdict["disjoint"] is True


def test_incomplete_batch_stops_the_job(spark):
    df = spark.range(1, 16).select(F.col("id").cast("string").alias("row_number"))
    with pytest.raises(ValueError, match="batch_0000020 has 5"):
        B.require_complete(B.assign_batch(df, 10), 10)


def _ledger(spark, *states):
    return spark.createDataFrame(
        [(f"batch_{t:07d}", t, s, t - 9, t) for t, s in states],
        "batch_id string, target_count long, status string, range_start long, range_end long")


def test_next_batch(spark):
    def following(*states):
        return B.next_batch(_ledger(spark, *states), 40, 10).first()[0]

    assert following((10, "done")) == 20
    assert following((10, "done"), (30, "done")) == 20
    assert following((10, "failed")) == 0
    assert following((10, "done"), (20, "running")) == 0
    assert following((10, "retrying")) == 10
    assert following((10, "done"), (20, "done"), (30, "done"), (40, "done")) == 0
    assert B.contiguous_done(_ledger(spark, (10, "done"), (30, "done")), 40, 10).first()[0] == 10


def test_hybrid_boundaries(spark):
    confidences = [None, 0.4999, 0.5, 0.5999, 0.6, 0.6999, 0.7, 0.9, 1.0]
    rows = [(c, p, s, weak, strong) for c in confidences for p in (0, 1, None) for s in range(6) for weak, strong in ((False, False), (True, False), (True, True))]
    df = spark.createDataFrame(rows, "confidence_binary_sparkml double, pred_binary_sparkml int, local_risk_score int, has_electoral_institution boolean, has_fraude boolean")
    for profile in ("k", "v1"):
        for r in H.score_hybrid(df, profile).collect():
            p, c, s = r["pred_binary_sparkml"], r["confidence_binary_sparkml"], r["local_risk_score"]
            offensive = p == 1 and c is not None
            high = (offensive and c >= 0.7 and r["has_fraude"]) or s >= 5
            medium = (offensive and c >= 0.6) or s >= 2
            assert r["hybrid_risk_level"] == ("alto" if high else "medio" if medium else "bajo")
            if profile == "k":
                assert p is not None and c is not None
            if s >= 5 and profile == "k" and not (offensive and c >= 0.7 and r["has_fraude"]):
                assert r["hybrid_risk_reason"] == "Reglas locales muy fuertes"


def test_strict_labels_and_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (2,), (3,)], "label long")
    assert {r["label"]: r["weight"] for r in J.attach_class_weight(df, "label").collect()} == {0: 4 / 6, 2: 4 / 3, 3: 4 / 3}
    weighted = J.attach_class_weight(df, "label")
    assert weighted.rdd.getNumPartitions() == df.rdd.getNumPartitions()  # rows are not moved by label
    with pytest.raises(Exception, match="unknown label"):
        J.attach_label_names(spark.createDataFrame([(7,)], "label long")).collect()


def test_overlap_counts_pairs(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "event_id string")
    b = spark.createDataFrame([("x",), ("x",), ("x",), (None,)], "event_id string")
    assert J.id_overlap(a, b).first()[0] == 6


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2)), min_size=1, max_size=40))
def test_metric_identities(spark, pairs):
    df = spark.createDataFrame(pairs, "label int, p int")
    matrix = M.confusion(df, "label", "p", (0, 1, 2))
    assert sum(r["count"] for r in matrix.collect()) == len(pairs)
    weighted = M.weighted_metrics(matrix).first()
    hits = sum(a == b for a, b in pairs) / len(pairs)
    assert weighted["accuracy"] == pytest.approx(hits) and weighted["weighted_recall"] == pytest.approx(hits)


def test_delta_serves_partitions_in_order(spark):
    ends = spark.createDataFrame([("t", 0, 100), ("t", 1, 3), ("t", 2, 100)], "kafka_topic string, kafka_partition int, end_offset long")
    cursor = spark.createDataFrame([("t", 0, 95), ("t", 1, 9)], "kafka_topic string, kafka_partition int, next_offset long")
    rows = O.delta_plan(ends, cursor, 12).orderBy("kafka_partition").collect()
    assert [(r["start_offset"], r["next_offset"], r["lag"]) for r in rows] == [(95, 100, 0), (3, 3, 0), (0, 5, 95)]


def test_live_chat_file(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    item = '{"liveChatTextMessageRenderer": {"message": {"runs": [{"text": "hola "}, {"emoji": {"shortcuts": [":a:"]}}]}, "timestampUsec": "1"}}'
    line = '{"replayChatItemAction": {"videoOffsetTimeMsec": "5", "actions": [{"addChatItemAction": {"item": %s}}]}}'
    (folder / "Un video + más [abcdefgh123].live_chat.json").write_text("\n".join([line % item, line % item, '{"broken', line % '{"other": 1}']), encoding="utf-8")
    rows = I.flatten_live_chat(files.read_live_chat(spark, str(folder))).collect()
    assert [(r["source_file"], r["video_id"], r["message"], r["video_offset_msec"]) for r in rows] == [
        ("Un video + más [abcdefgh123].live_chat.json", "abcdefgh123", "hola :a:", "5")]


def test_topic_readers_need_only_options(spark):
    with pytest.raises(Exception):  # no connector on this class path: the source is named, not found
        topics.read_topic_snapshot(spark, "nowhere:1")


def test_start_row_is_checked(spark):
    with pytest.raises(ValueError):
        topics.build_events(spark.range(1), "p", start_row=0)


def test_diagnostics_read_the_table_twice_for_eleven_tables(spark, sf):
    from checks.data import scored
    from murmullo.operators import aggregates as A
    from murmullo.plans.diagnostics import diagnostics

    table = scored(spark, sf, "v1")
    bundle = diagnostics(table)
    assert len(bundle) == 11
    for name, df in bundle.items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "message_raw" not in plan or name in ("confident_with_rules", "confident_without_rules", "unsure_without_rules", "not_offensive_high_score")
        assert "conversations" not in plan and "regexp" not in plan  # only landed results are read
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(bundle["levels"]) == rows(A.distribution(table, "hybrid_risk_level"))
    assert rows(bundle["counts"]) == rows(A.hybrid_counts(table))
    assert rows(A.hybrid_counts(A.combined_counts(table.where("false"), ["pred_binary_sparkml", "has_any_local_rule", "has_strong_local_rule", "ml_offensive_high_confidence"]), "n")) == [(0, 0, 0, 0)]


def test_comparison_with_a_part_equals_that_of_two_runs(spark, sf):
    from checks.data import ruled
    from murmullo.operators import aggregates as A

    every = ruled(spark, sf, "v1")
    early = F.col("video_offset_msec").try_cast("long") < 40000
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(A.compare_flags_with_part(every, early)) == rows(A.compare_flag_runs(every, every.where(early)))


@pytest.mark.parametrize("escape", ['"', "\\"])
def test_split_csv_gives_the_records_of_the_multi_line_reader(spark, tmp_path, escape):
    """Quotes, escapes, commas, blank lines and line breaks inside fields, over splits of a few hundred bytes."""
    rnd = random.Random(7)
    field = lambda: rnd.choice([None, "", "plain", 'say "hi"', "a,b", "two\nlines", '"\n\n"', "back\\slash", 'end"', "x" * 900, "é\nñ\r\nz", "\n" * 40])
    rows = [(str(i), field(), field()) for i in range(400)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    for part in range(2):
        df.where(F.col("a").cast("int") % 2 == part).coalesce(1).write.mode("append").option("header", True).option("escape", escape).csv(str(tmp_path / "lake"))
    schema = files.string_schema(["a", "b", "c"])
    key = lambda r: (int(r[0]), *r[1:])
    want = sorted(map(tuple, files.read_comments_csv(spark, str(tmp_path / "lake"), schema, escape).collect()), key=key)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300", "5000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = files.read_split_csv(spark, str(tmp_path / "lake"), schema, escape)
            assert sorted(map(tuple, got.collect()), key=key) == want and len(want) == 400
            if size == "5000":
                lines = spark.read.text(str(tmp_path / "lake"))
                assert lines.rdd.getNumPartitions() >= 4 or lines.select("_metadata.file_block_start").distinct().count() >= 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_heavy_hitters_are_exact(spark):
    from murmullo.operators.corpus import heavy_hitters

    rnd = random.Random(9)
    values = [f"w{int(rnd.paretovariate(0.7)) % 5000}" for _ in range(20_000)] + [None] * 10
    df = spark.createDataFrame([(v,) for v in values], "value string").repartition(4)
    counts = {}
    for v in values:
        if v is not None:
            counts[v] = counts.get(v, 0) + 1
    for k in (1, 20, 300, 10_000):
        want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
        for buckets in (16, 1 << 16):
            assert [tuple(r) for r in heavy_hitters(df, k, buckets=buckets).collect()] == want
    flat = spark.range(3000).select(F.col("id").cast("string").alias("value"))  # all alike: every bucket is counted
    assert [tuple(r) for r in heavy_hitters(flat, 3).collect()] == [("0", 1), ("1", 1), ("10", 1)]
    assert heavy_hitters(flat.where("false"), 3).count() == 0


def test_a_thousand_batches_lie_in_few_folders(spark, tmp_path):
    rows = B.assign_batch(spark.range(1, 10_001).select(F.col("id").alias("row_number"), F.lit(1).alias("version")), 10).select("row_number", "batch_id", "version")
    path = str(tmp_path / "t")
    B.write_batch(rows, path, 10)
    assert len(list((tmp_path / "t").glob("batch_group=*"))) == 16
    some = rows.where("row_number > 495 and row_number <= 520").withColumn("version", F.lit(2))
    B.write_batch(some, path, 10)  # known batches are left alone
    assert B.read_batches(spark, path, 10).where("version = 2").count() == 0
    B.write_batch(some.where("row_number > 500"), path, 10, force=True)
    back = B.read_batches(spark, path, 10)
    assert back.count() == 10_000 and sorted(r.row_number for r in back.where("version = 2").collect()) == list(range(501, 521))
    ids = rows.where("row_number in (7, 9999)").select("batch_id")
    assert B.read_batches(spark, path, 10, ids).count() == 20
