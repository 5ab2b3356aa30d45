"""The registered queries: against SQL where there is some, else against plain versions on the whole smallest tables."""

import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from checks.compare import check, duck
from murmullo.llm import mixing, pieces
from murmullo.llm.queries import MIX_WEIGHTS, ORACLES, QUERIES, mix_sql

from . import brute


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, con, sf, name):
    status, detail, _ = check(spark, con, name, QUERIES[name], ORACLES[name], sf)
    assert status == "ok", detail


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "source_mix", "merge_dropout"]


def _good(labels):
    return {d for d, q in labels.items() if q == 1}


def test_quality_rules(spark, sf, corpus, quality_labels):
    want = brute.quality_rules([r[:2] for r in corpus], _good(quality_labels))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
           for r in QUERIES["op1_quality_rules"](spark, sf).collect()}
    assert got == want


def test_simhash(spark, sf, corpus):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash"](spark, sf).collect()}
    assert got == brute.simhash([r[:2] for r in corpus])


def test_line_dedup(spark, sf, corpus):
    rows = QUERIES["op9_line_dedup"](spark, sf).collect()
    assert {r.doc_id: set(r.removed_lines) for r in rows if r.n_removed} == brute.line_dedup([r[:2] for r in corpus])
    assert {r.doc_id: r.n_lines for r in rows} == {d: len(t.split("\n")) for d, t, *_ in corpus}


def test_mix(spark, sf, corpus):
    got = {r.doc_id: (r.copies, r.last_epoch) for r in QUERIES["op7_source_mix"](spark, sf).collect()}
    assert got == brute.mix(corpus, MIX_WEIGHTS)


ZERO_WEIGHTS = {"domain": {"d0": 3, "d2": 0.5}, "lang": {"en": 0, "de": 2}, "source": {"src1": 0, "src6": 0, "src2": 5}}


def test_mix_with_weights_of_zero_below_the_top(spark, con, sf, corpus):
    """What a domain can't use because a language or source of it weighs nothing goes to the other domains."""
    mixed = lambda spark, sf: mixing.select_mix(spark.read.parquet(f"{sf}/documents.parquet"), ZERO_WEIGHTS, share=1.0, epochs=2)
    assert {r.doc_id: (r.copies, r.last_epoch) for r in mixed(spark, sf).collect()} == brute.mix(corpus, ZERO_WEIGHTS)
    status, detail, _ = check(spark, con, "mix", mixed, mix_sql(ZERO_WEIGHTS), sf)
    assert status == "ok", detail
    # two domains of 4,000 words, half of the second unusable: all of 4,800 due are given out
    rows = [(i, "w " * 40, "en" if i < 100 or i % 2 else "fr", f"src{i // 100}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = mixing.select_mix(docs, {"lang": {"fr": 0}}, share=0.6, epochs=1)
    assert taken.agg({"n_tokens": "sum"}).first()[0] == 4800 and taken.where("lang = 'fr'").count() == 0


def test_merge_dropout(spark, sf, corpus):
    rows = QUERIES["op10_merge_dropout"](spark, sf).collect()
    assert len(rows) == len(corpus) and all(r.lossless for r in rows)
    model = pieces.load(pieces.MODEL)
    assert {r.doc_id: model.processor.decode(r.ids) for r in rows} == {d: t for d, t, *_ in corpus}


def test_secret_scan_finds_what_a_plain_scan_finds(spark, sf, corpus):
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for r in QUERIES["op2_secret_scan"](spark, sf).collect():
        text = next(t for d, t, *_ in corpus if d == r.doc_id)
        found = [("assign", m) for m in assign.finditer(text) if len(m[2]) >= 6]
        found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        found.sort(key=lambda x: (x[1].start(), ("assign", "access", "hex").index(x[0])))
        said = ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _ in found) for x in ("assign", "access", "hex"))
        assert set(said.split(",")) <= set(r.spans.split(","))


def test_classifier_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table holds three bad documents to learn from
    quality_labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op4_quality_classifier"](spark, sf).collect()}
    held = [(rows[d].score, rows[d].predicted, q) for d, q in quality_labels.items() if rows[d].held_out]
    assert all(0 <= r.score <= 1 for r in rows.values())
    good, bad = (np.array([s for s, _, q in held if q == k]) for k in (1, 0))
    assert np.mean([p == q for _, p, q in held]) >= 0.95
    assert (good[:, None] > bad).mean() >= 0.95


def test_pipeline(spark, sf, corpus, quality_labels):
    docs, got = corpus, spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, sf)
        assert got.columns == corpus_pipeline.COLUMNS
        if name == "quality_rules":
            kept = brute.quality_rules([r[:2] for r in docs], _good(quality_labels))
            docs = [r for r in docs if kept[r[0]][-1]]
        elif name == "line_dedup":
            gone = brute.line_dedup([r[:2] for r in docs])
            docs = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())), *rest) for d, t, *rest in docs]
        elif name == "simhash_dedup":
            found = brute.simhash([r[:2] for r in docs])
            docs = [r for r in docs if found[r[0]][1] == r[0]]
        else:
            taken = brute.mix(docs, MIX_WEIGHTS, share=corpus_pipeline.MIX_SHARE, epochs=1)
            docs = [r for r in docs if r[0] in taken]
    rows = {r.doc_id: r for r in corpus_pipeline.encode(spark, got, sf).collect()}
    model = pieces.load(pieces.MODEL)
    keys = pieces.document_keys([r[0] for r in docs], pieces.SEED)
    want = {r[0]: x.tolist() for r, x in zip(docs, model.encode([r[1] for r in docs], keys, pieces.RATE))}
    assert {d: list(r.ids) for d, r in rows.items()} == want
    assert {d: model.decode(r.ids) for d, r in rows.items()} == {r[0]: r[1] for r in docs}
    whole = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.ids for r in whole} == {d: r.ids for d, r in rows.items()}
