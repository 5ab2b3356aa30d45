"""Nulls, empty and long texts, repeated rows, empty tables, and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from murmullo.llm import crf, descent, lines, mixing, packing, pieces, quality_rules, secrets, simhash, warc

LONG = "\n".join(f"line {i} of a text with words number{i * 7 % 911} and more{i}" for i in range(4000))
KEY = "api_key = 'abcdef123' and deadbeefdeadbeefdeadbeef"
ROWS = [
    (1, "one two three four five six seven eight nine ten.\nA b c d e f", "en", "src1"), (1, "one two three four five six seven eight nine ten.\nA b c d e f", "en", "src1"),
    (2, None, None, None), (3, "", "en", "src2"), (4, " \n\t\n ", "de", ""), (None, KEY, "en", "src1"), (5, KEY, None, "srcx"), (6, LONG, "en", "src3"),
    (7, "a" * 100_000, "en", "src3"), (8, "wörd 日本 𝒳\x00\x1c end", "fr", "src1"),
]
EXTRA = ["h", "w", "v", "s", "p", "id", "fp", "words", "doc", "line", "removed_lines", "key", "bucket", "weights", "kept_0", "Quality", "n_ids", "a.b", "place", "copies"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(f"x{c}") for c in EXTRA}).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, "e"), (3, 0, "e"), (6, 1, "e"), (None, 1, "e"), (5, None, "e"), (7, 0, "e")], "doc_id long, quality int, text string")


def _ids(rows):
    return sorted((r.doc_id for r in rows), key=lambda x: (x is None, x))


ALL = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))


def test_quality_rules(docs, labels):
    rows = quality_rules.judge(docs, labels).collect()
    assert _ids(rows) == ALL
    by = {r.doc_id: r for r in rows}
    for d in (2, 3, 4):
        assert (by[d].n_words, by[d].llr, by[d].base_failed, by[d].kept) == (0, 0.0, True, False)
    assert by[6].n_words == len(LONG.split()) and by[7].n_words == 1
    assert quality_rules.judge(docs.where("false"), labels).count() == 0
    assert all(r.llr == 0 for r in quality_rules.judge(docs, labels.where("false")).collect())
    kept = quality_rules.judge(docs, labels, keep=["doc_id", "text", "a.b", "h"])
    assert kept.where("not kept").count() == sum(not r.kept for r in rows) and kept.columns[:4] == ["doc_id", "text", "a.b", "h"]


def test_quality_rules_count_all_trusted_documents(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat_ws(' ', 'word', id % 97, 'of', id % 89, 'and', id) AS text")
    judged = quality_rules.judge(docs, docs.selectExpr("doc_id", "1 AS quality"))
    assert judged.where("llr <> 0").count() == 0  # all are good, so target and raw counts are the same


def test_secrets(docs):
    rows = secrets.find_secrets(docs).collect()
    assert _ids(rows) == ALL
    found = {r.doc_id: r.spans for r in rows}
    assert found[5] == found[None] == "assign:0:20,hex:26:50"
    assert found[2] == found[3] == found[4] == found[8] == "" and found[7] == "hex:0:100000"
    assert secrets.find_secrets(docs.where("false")).count() == 0


def test_packing(docs):
    rows = [r.asDict() for r in packing.pack(docs, length=128).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(packing.unpack(rows), key=key) == sorted(((r[0], r[1] or "") for r in ROWS), key=key)  # ids that are null or repeat too
    held = [d for r in packing.pack(docs).collect() for d in r.doc_ids if d is None]
    assert len(held) == 1 and packing.pack(docs.where("false")).count() == 0


def test_classifier(docs, labels):
    rows = crf.score_quality(docs, labels, folds=1).collect()
    assert _ids(rows) == ALL and all(0 <= r.score <= 1 for r in rows)
    assert {r.predicted for r in rows} <= {0, 1} and not [r for r in rows if r.doc_id is None and r.held_out]
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert crf.score_quality(docs.where("false"), labels).count() == 0
    assert {r.score for r in crf.score_quality(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert {r.score for r in crf.score_quality(docs, labels.where("false")).collect()} == {0.5}


def test_warc(spark):
    same = "<p>" + "x" * 200
    rows = [(3, "http://b.org/", same), (1, "http://a.org/", same), (1, "http://a.org/", same), (2, None, None), (None, "http://c.org/", same),
            (4, "http://a.org/", "short"), (5, "http://a.org/", "short"), (6, "http://a.org/é \n", "é" * 60), (7, "x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("z") for c in ("digest", "first", "bytes", "file", "date")})
    got = warc.archive(df.repartition(3)).collect()
    kinds = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str)
    assert kinds == sorted([(3, "revisit", 1, 203), (1, "response", None, 203), (1, "response", None, 203), (2, "response", None, 0), (None, "response", None, 203),
                            (4, "response", None, 5), (5, "response", None, 5), (6, "response", None, 120), (7, "response", None, 0)], key=str)
    order = [(r.url_key, r.captured) for r in sorted(got, key=lambda r: (r.range_no, r.place))]
    assert order == sorted(order)
    assert warc.archive(df.where("false")).count() == 0


def test_merge_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "MERGE_ROWS", 50)
    df = spark.range(400).selectExpr("id page_id", "if(id % 3 = 0, 'http://hot.org/', concat('http://x', id % 40, '.org/')) url", "repeat('y', cast(id % 150 as int)) html")
    got = warc.archive(df.repartition(6)).collect()
    order = [(r.url_key, r.captured, r.page_id) for r in sorted(got, key=lambda r: (r.range_no, r.place))]
    assert order == sorted(order) and len(order) == 400 and len({r.range_no for r in got if r.url_key == "org,hot)/"}) > 1


def test_simhash(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert _ids(rows) == ALL
    by = {r.doc_id: (r.fingerprint, r.component_id) for r in rows}
    assert by[2] == by[3] == by[4] == ("0" * 16, 2)
    assert by[None][1] is None and by[None][0] == by[5][0] and by[5][1] == 5
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_mixing(docs):
    rows = mixing.select_mix(docs, share=1.0, epochs=1).collect()
    assert {r.doc_id for r in rows} == {1, 5, 6, 7, 8, None} and len(rows) == 7  # texts without words are never taken
    assert {r.domain for r in rows} == {"d1", "d", "d3"}
    assert mixing.select_mix(docs.where("false")).count() == 0
    carried = mixing.select_mix(docs, keep=docs.columns)
    assert carried.columns[:len(docs.columns)] == docs.columns and carried.count() >= 1
    assert mixing.select_mix(docs, {"domain": {"d1": 0, "d3": 0, "d": 0}}).count() == 0


def test_descent(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]),
            (9, [None, 1.0]), (None, [1.0, 0.0]), (10, [1.0]), (11, [1e30, 1e28])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "u", "v", "sim", "component")})
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in descent.near_duplicates(df).collect()), key=str)
    linked = [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (10, 4, 1, False), (11, 4, 1, False)]
    alone = [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9)] + [(None, 0, None, True)]
    assert got == sorted(linked + alone, key=str)
    assert descent.near_duplicates(df.where("false")).count() == 0
    assert descent.near_duplicates(df.where("vec_id = 4")).count() == 1


def test_line_dedup(docs):
    rows = lines.report(docs).collect()
    assert _ids(rows) == ALL and all(r.n_removed == 0 for r in rows)  # the only copies are one document's rows
    out = lines.deduplicate(docs)
    assert out.columns[:len(docs.columns)] == docs.columns and len(out.columns) == len(docs.columns) + 2
    assert sorted((str(r.text) for r in out.collect())) == sorted(str(r[1]) for r in ROWS)
    again = docs.where("doc_id = 6").withColumn("doc_id", F.lit(60)).union(docs)
    cut = {r.doc_id: r.text for r in lines.deduplicate(again).where("doc_id in (6, 60)").collect()}
    assert cut == {6: LONG, 60: ""}
    assert lines.report(docs.where("false")).count() == 0 and lines.deduplicate(docs.where("false")).count() == 0


def test_large_groups_and_frequent_words_lose_nothing(spark, monkeypatch):
    from . import brute

    import random
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    base = [rng.sample(words, 9) for _ in range(30)]
    texts = []
    for d in range(120):
        some = [list(rng.choice(base)) for _ in range(5)]
        for x in some:
            for _ in range(rng.randrange(3)):
                x[rng.randrange(9)] = rng.choice(words)
        texts.append((d, "\n".join(" ".join(x) for x in some)))
    want = brute.line_dedup(texts)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for changed in ({}, {"GROUP": 2, "MOST": 1}, {"GROUP": 2, "MOST": 1, "SURE": 1}, {"BLOCK_ENTRIES": 40}):
        with monkeypatch.context() as m:
            for k, v in changed.items():
                m.setattr(lines, k, v)
            assert {r.doc_id: set(r.removed_lines) for r in lines.report(df).collect() if r.n_removed} == want


def test_short_lines_go_like_long_ones(spark):
    from . import brute

    texts = [(1, "All rights reserved.\nhome\n\nshare this page now"), (2, "home\nother words here\nAll rights reserved.\nnow share this page today"), (3, "\nHome\nhome")]
    want = {2: {0, 2, 3}, 3: {2}}
    assert brute.line_dedup(texts) == want
    rows = lines.report(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: set(r.removed_lines) for r in rows if r.n_removed} == want


def test_pieces(docs):
    rows = pieces.encode_documents(docs, keep=["a.b"]).collect()
    assert _ids(rows) == ALL and all(r.lossless and r["a.b"] == "xa.b" for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[2].n_ids == by[3].n_ids == 0 and list(by[2].ids) == []
    one = [list(r.ids) for r in rows if r.doc_id == 1]
    assert one[0] == one[1]
    back = {r.doc_id: r.text for r in pieces.decode_documents(pieces.encode_documents(docs)).collect()}
    assert back == {r[0]: r[1] or "" for r in ROWS}
    assert pieces.encode_documents(docs.where("false")).count() == 0
