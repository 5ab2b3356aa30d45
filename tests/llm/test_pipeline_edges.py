"""The pipeline's defined cases: nulls, empty texts, rows that share an id, an empty table, extra columns."""

from pyspark.sql import functions as F

import corpus_pipeline as P

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def _text(k):
    return " ".join(f"word{(k * 97 + i * i) % 5003}" for i in range(60))


def test_rows_that_share_an_id_keep_their_texts(spark, sf):
    rows = [(1, _text(1)), (1, _text(1)), (1, _text(2)), (2, _text(2)), (3, _text(3)), (None, _text(3)), (None, None), (4, ""), (5, None)]
    docs = spark.createDataFrame([(d, t, "en", "src1", len(t or "")) for d, t in rows], KINDS).repartition(3)
    kept = P.near_dedup(spark, docs, sf)
    assert kept.columns == P.COLUMNS
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    # texts 1, 2 and 3 once each, under the smallest id; of the two without words one; rows without id stay
    assert got == sorted([(1, _text(1)), (1, _text(2)), (3, _text(3)), (4, ""), (None, _text(3)), (None, None)], key=repr)


def test_stages_bear_nulls_extra_columns_and_nothing(spark, sf):
    rows = [(1, _text(1), "en", "src1", 9), (2, None, None, None, None), (None, _text(5), None, "", 3), (4, "", "de", "src2", 0), (1, _text(1), "en", "src1", 9)]
    docs = spark.createDataFrame(rows, KINDS).withColumns({c: F.lit(1) for c in ("row", "group", "Removed_lines", "a.b")})
    for start in (docs, docs.where("false")):
        at = start
        for name, stage in P.STAGES[:-1]:
            at = stage(spark, at, sf)
            assert at.columns == P.COLUMNS, name
        ids = P.STAGES[-1][1](spark, at, sf)
        assert ids.where("not lossless").count() == 0
        assert ids.count() == at.count()
