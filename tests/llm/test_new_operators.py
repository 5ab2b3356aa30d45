"""Token counts, prefix trie and fill-in-the-middle: whole tables, random inputs, and the defined cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmullo.llm import fim, prefix_trie, token_counts
from murmullo.llm.queries import QUERIES

from . import brute

EXTRA = ["id", "n", "n_bytes", "n_tokens", "form", "output", "kept_0", "path", "seq", "member", "base", "own", "t", "Kind", "a.b"]
TEXTS = [None, "", " ", " \n\t ", "one", " one two  three\n", "wörd 日本 𝒳\x00\x1c end", "a" * 30_000, "ab" * 700, "x  　y's 'll''s",
         "see <|endoftext|> and <|endoftext|><|endof", "has <P> inside", "<", "\n".join(f"line {i} of words{i * 7 % 911}" for i in range(3000))]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.vocabulary_path(token_counts.VOCABULARY))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, "one"), (None, "no id at all"), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"x{c}") for c in EXTRA}).repartition(3)


def _sizes(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts_of_the_table(spark, sf, corpus, library):
    want = {d: (len((t or "").encode()), n) for (d, t, *_), n in zip(corpus, _sizes(library, [r[1] for r in corpus]))}
    rows = QUERIES["op11_token_counts"](spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)


def test_token_counts_of_defined_cases(docs, library):
    rows = token_counts.count_tokens(docs, keep=["text", "a.b", "n_bytes"]).collect()
    assert len(rows) == len(TEXTS) + 3
    assert [r.n_tokens for r in rows] == _sizes(library, [r.text for r in rows])
    assert sorted(token_counts.count_tokens(docs, limit=0, keep=["text"]).where("not over_limit").select("n_tokens").collect()) == [(0,)] * 3
    assert token_counts.count_tokens(docs.where("false")).count() == 0


def test_token_counts_of_random_texts_and_every_code_point(library):
    words, rnd = token_counts.load(token_counts.vocabulary_path(token_counts.VOCABULARY)), random.Random(3)
    pieces = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "'s", "'ll", "'", "!!", "1", "é", "日本", " ", "\x1c", "<|endoftext|>", "<|endo", "😀", "aaaa"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    texts += ["a" * 5000, "".join(rnd.choice("abcdefghijklmnop") for _ in range(9000)), " " * 3000, "\n" * 999, "aab" * 100, "".join(rnd.choice("ae") for _ in range(400))]
    assert words.count(texts) == _sizes(library, texts)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 7 == 0)]
    texts = ["a" + c + "a1" + c + "1 " + c for c in points]
    assert words.count(texts) == _sizes(library, texts)


def test_token_counts_start_anew_beyond_the_known(monkeypatch, library):
    words = token_counts.Vocabulary(token_counts.vocabulary_path(token_counts.VOCABULARY))
    monkeypatch.setattr(token_counts, "MOST_KNOWN", 20)
    texts = [f"some words {i} and number{i}" for i in range(50)]
    assert [n for t in texts for n in words.count([t])] == _sizes(library, texts) and len(words.known) <= 20


def test_fill_in_middle_of_the_table(spark, sf, corpus):
    rows = {r.doc_id: r for r in QUERIES["op13_fill_in_middle"](spark, sf).collect()}
    for d, t, *_ in corpus:
        *said, output = brute.fill_in_middle(d, t)
        assert [rows[d].n, rows[d].form, rows[d].prefix_chars, rows[d].middle_chars] == said
        assert rows[d].output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert rows[d].restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_fill_in_middle_of_defined_cases(docs):
    made = fim.transform(docs, fim_rate=100, keep=["text", "a.b"])
    rows = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(TEXTS) + 3 and all(r.back == (r.text or "") for r in rows)
    assert {r.form for r in rows if r.text in (None, "", "has <P> inside")} == {"plain"} and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in fim.transform(docs, keep=["text"]).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute.fill_in_middle(r.doc_id, r.text)
    assert fim.transform(docs.where("false")).count() == 0


def test_rank_index_gives_every_border(docs):
    rnd = random.Random(5)
    for steps in ([1], [1, 2, 5, 300, 100_000], [4, 5, 6, 7], [1] * 50 + [9_000]):
        offsets = np.cumsum([0] + [rnd.choice(steps) for _ in range(3000)])
        index = fim.RankIndex.fit(offsets)
        assert (index.offsets(np.arange(len(offsets))) == offsets).all()
        assert abs(index.residuals.astype(int)).max() <= fim.ERROR + 1
    assert len(fim.RankIndex.fit(np.arange(5000) * 6).starts) == 1
    for r in fim.rank_index(docs, error=3).join(docs.select("doc_id", "text"), "doc_id").collect():
        index = fim.RankIndex(np.array(r.starts), np.array(r.bases), np.array(r.slopes), np.frombuffer(bytes(r.residuals), np.int8))
        assert (index.offsets(np.arange(r.n + 1)) == fim.borders(r.text or "")).all()


def _conversations(seed):
    rnd = random.Random(seed)
    return [
        (c if rnd.random() < 0.98 else None, rnd.choice([t, t, t, None]), rnd.choice(["user", "bot", None]) if t > 2 else "user",
         rnd.choice(["a b", "c", "", "hello world x", None]) if t else rnd.choice(["hi there", "yo"]))
        for c in rnd.sample(range(300), 160) for t in range(rnd.choice([1, 2, 3, 5, 8]))
    ]


@pytest.mark.parametrize("block", [4, 30, 16_384])
def test_prefix_trie_of_random_conversations(spark, block):
    rows = _conversations(block)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(f"x{c}") for c in EXTRA}).repartition(5)
    assert sorted(tuple(r) for r in prefix_trie.prefix_trie(df, block=block).collect()) == brute.prefix_trie(rows)


def test_prefix_trie_of_copies_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(c, t, "user", f"same words {t}") for c in range(100, 400) for t in range(3)]
    rows += [(c, t, "user", f"turn {t}") for c in (20, 25) for t in range(200)] + [(401, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    assert sorted(tuple(r) for r in prefix_trie.prefix_trie(df).collect()) == brute.prefix_trie(rows)


def test_prefix_trie_of_nothing(spark):
    df = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(df).count() == 0 and prefix_trie.prefix_trie(df.where("false")).count() == 0


def test_prefix_trie_rounds_do_not_depend_on_the_memory_bound(spark):
    rows = _conversations(99)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_trie.build_trie(prefix_trie.rebuild(df), block=1000, most_turns=40)
    assert sorted(tuple(r) for r in got.collect()) == brute.prefix_trie(rows)
