"""Inner parts of the operators against plain versions."""

import io
import itertools
import random
import re

import numpy as np
import pytest

from murmullo.llm import crf, descent, graph, lines, packing, pieces, secrets, simhash, warc

from . import brute


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ("all", (b"aki", b"kia"))
    assert secrets.trigram_query("[0-9a-f]{24,}") is True
    assert secrets.trigram_query("ab|cde") is True  # one branch is too short for a trigram
    assert secrets.trigrams_of(secrets.trigram_query("(abc|xyz)+d?")) == {b"abc", b"xyz"}
    assert secrets.trigram_query("(?:abc)?") is True


@pytest.mark.parametrize("pattern", ["ab?cd[ef]g", "(foo|ba[rz])+x", "a{3}bc", "x.*key=", "(ab|c)(de|fg)h", r"\bword\b", "[^a]bcd"])
def test_queries_never_miss_a_match(pattern):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghorzfkwyx= ") for _ in range(12)) for _ in range(300)]
    texts += [t[:5] + x + t[5:] for t in texts[:40] for x in ("abcdeg", "foobarx", "aaabc", "x1key=", "abdeh", " word ", "Bbcd")]
    query = secrets.trigram_query(pattern)
    terms = sorted(secrets.trigrams_of(query))
    wanted = np.zeros(1 << 24, np.uint16)
    for i, t in enumerate(terms):
        wanted[t[0] << 16 | t[1] << 8 | t[2]] = i + 1
    found = set(secrets.Segment([t.encode() for t in texts], terms, wanted).search(query).tolist())
    assert {i for i, t in enumerate(texts) if re.search(pattern, t)} <= found


@pytest.mark.parametrize("pattern,texts", [
    ("ÉCLAIRKEY[0-9]+", ["ÉCLAIRKEY12", "éCLAIRKEY12", "xÉCLAIRKEY9"]),
    ("(?i)secretkey[0-9]+", ["SecretKey1", "\u017fecretkey1", "secret\u212aey2", "sekretkey1"]),
    ("(?i:kis)T[a-d]e[ÀÉ]f", ["\u212a\u0130\u017fTbeÉf", "kisTdeÀf", "kistdeÀf"]),
    ("(?i)clé=[A-C]id", ["CLÉ=B\u0131D", "clé=aid", "cle=aid"]),
    ("(?i)ab(?-i:XYZ)q", ["ABXYZQ", "abxyzq"]),
])
def test_queries_follow_case_as_the_expressions_do(pattern, texts):
    scanner = secrets.Scanner((secrets.Rule("x", pattern),))
    assert [bool(s) for s in scanner.spans(texts)] == [bool(re.search(pattern, t)) for t in texts] and any(re.search(pattern, t) for t in texts)


def test_partners_are_all_there_are():
    every = [chr(c) for c in range(128, 0x110000)]
    for c in "abcdefghijklmnopqrstuvwxyz":
        one = re.compile(f"(?i){c}")
        assert {x for x in every if one.match(x)} == set(secrets.PARTNERS.get(c, "")), c


def test_scanner_of_many_trigrams():
    every = ["".join(x) for x in itertools.product("0123456789abcdefghijklmnopqrstuvwxyz_,;:!~", repeat=3)]
    scanner = secrets.Scanner((secrets.Rule("long", ".".join(every)), secrets.Rule("last", "~~~=~")))
    assert len(scanner.trigrams) > 1 << 16
    assert scanner.spans(["a~~~=~", "~~=~", " ".join(every)]) == [[(1, 1, 6)], [], [(0, 0, 4 * len(every) - 1)]]


def test_segment_reads_no_trigram_across_documents():
    wanted = np.zeros(1 << 24, np.uint16)
    wanted[0x616263] = 1
    assert secrets.Segment([b"ab", b"c", b"xabc", b""], [b"abc"], wanted).search(b"abc").tolist() == [2]


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 300, 1) if i % 50] + [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(400)] + [(1000, 1000)]
    links += [(2000, 2001 + i) for i in range(300)]
    df = spark.createDataFrame(links, "a long, b long")
    want = brute.components({x for p in links for x in p if p[0] != p[1]}, [p for p in links if p[0] != p[1]])
    assert {r.node: r.component for r in graph.components(df).collect()} == want
    assert graph.components(df.where("a < 0")).count() == 0


def _gray_sorted(x):
    rank = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return x[np.argsort(rank)]


def _near_prints(n, copies, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    found = [base]
    for _ in range(copies):
        x = base.copy()
        for _ in range(3):
            x = x ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        found.append(x)
    return _gray_sorted(np.unique(np.concatenate(found)))


@pytest.mark.parametrize("n,copies", [(200, 6), (1, 400), (900, 0)])
def test_gray_tree_links(n, copies):
    x = _near_prints(n, copies, n)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    parent = np.arange(len(x))
    simhash.unite(parent, *np.nonzero(near))
    assert (simhash._roots(parent, np.arange(len(x))) == simhash.link_blocks(x, None)).all()
    if len(x) > 4:
        half, parent = len(x) // 2, np.arange(len(x))
        a, b = np.nonzero(near[:half, half:])
        simhash.unite(parent, a, b + half)
        assert (simhash._roots(parent, np.arange(len(x))) == simhash.link_blocks(x[:half], x[half:])).all()


def test_links_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    x = _near_prints(150, 5, 2)
    df = spark.createDataFrame([(int(v.astype(np.int64)), i) for i, v in enumerate(x)], "fp long, id long")
    links = [(r.a, r.b) for r in simhash.linked(df, len(x)).collect()]
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
    assert brute.components(range(len(x)), links) == brute.components(range(len(x)), zip(a.tolist(), b.tolist()))


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(30) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(itertools.chain(*runs))


def test_record_round_trip():
    import zlib

    def member(raw):
        pack = zlib.compressobj(3, zlib.DEFLATED, 31)
        return pack.compress(raw) + pack.flush()

    import hashlib
    html = "<p>é\r\n\r\nWARC/1.1\r\n".encode() * 20
    digest = hashlib.sha256(html).hexdigest()
    first = warc.record(4, "http://a.org/x y\r\nEvil: 1", "2020-01-01T00:00:04Z", digest, html, None)
    again = warc.record(9, None, "2020-01-01T00:00:09Z", digest, html, 4)
    blob = member(first) + member(again)
    (at, one), (place, two) = warc.records(io.BytesIO(blob))
    assert at == 0 and place == len(member(first)) and (one, two) == (first, again)
    one, two = warc.parse(one), warc.parse(two)
    assert one["payload"] == html and one["record_type"] == "response" and one["url"] == "http://a.org/x%20y%0D%0AEvil:%201"
    assert (two["record_type"], two["refers_to"], two["payload_bytes"], two["payload"]) == ("revisit", 4, len(html), b"")
    with pytest.raises(ValueError):
        warc.parse(first.replace(b"<p>", b"<q>", 1))
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(blob[:-3])))


@pytest.mark.parametrize("url,key", [
    ("http://www.Example.org:80/a?b=1#c", "org,example,www)/a?b=1"), ("https://x.de", "de,x)/"), ("http://x.de:8080/", "de,x:8080)/"), (None, ")/"), ("http://[bad", "http://[bad"),
])
def test_url_key(url, key):
    assert warc.url_key(url) == key


def test_best_fit():
    rng = random.Random(2)
    for _ in range(30):
        lengths = [rng.randint(1, 20) for _ in range(rng.randrange(60))]
        rows, free, want = packing.best_fit(lengths, 20), [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [(f, k) for k, f in enumerate(free) if f >= lengths[i]]
            k = min(fits)[1] if fits else len(free)
            if not fits:
                free.append(20)
                want.append(0)
            free[k] -= lengths[i]
        assert sorted(x for r in rows for x in r) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in r) <= 20 for r in rows)
        assert sorted(20 - sum(lengths[i] for i in r) for r in rows) == sorted(free)


def test_encoder_equals_the_library(corpus):
    encoder = packing.Encoder()
    texts = [r[1] for r in corpus] + ["", " a", "a  b", "a \nb c", "x\x1c y z", "don't 's a", "a  b c", "é日本 x"]
    assert all(encoder.encode(t).tolist() == encoder.encoding.encode_ordinary(t) for t in texts)


def test_packing_loses_nothing(spark, corpus, tmp_path):
    docs = spark.createDataFrame([r[:2] for r in corpus] + [(9001, None), (9002, "")], "doc_id long, text string").repartition(3)
    packed = packing.pack(docs, length=256, window_ids=50_000)
    rows = [r.asDict() for r in packed.collect()]
    assert sorted(packing.unpack(rows)) == sorted([*(r[:2] for r in corpus), (9001, ""), (9002, "")])
    used = sum(r["n_ids"] for r in rows) / 256 / len(rows)
    assert used > 0.95
    for r in rows:
        positions, cuts = np.frombuffer(r["position_ids"], "<u2"), r["cu_seqlens"]
        assert cuts[0] == 0 and cuts[-1] == r["n_ids"] and len(positions) == 256
        assert [0, *np.flatnonzero(np.diff(positions[:r["n_ids"]].astype(int)) != 1) + 1] == cuts[:-1] or len(cuts) > 2
        assert all((positions[a:b] == np.arange(b - a)).all() for a, b in zip(cuts, cuts[1:]))
    files = packing.write_matrices(packed, str(tmp_path / "matrices"), 256).collect()
    ids = b"".join(open(f.ids_path, "rb").read() for f in files)
    assert sum(f.n_rows for f in files) == len(rows) and len(ids) == 512 * len(rows)
    assert sorted(ids[i:i + 512] for i in range(0, len(ids), 512)) == sorted(r["input_ids"] for r in rows)


def test_positions_of_rows_beyond_two_bytes():
    long = np.arange(70_000, dtype="<u2")
    (row,) = next(packing.pack_window([(1, 0, long, 0)], "w", 70_000, 9, "<u2")).to_pylist()
    assert (np.frombuffer(row["position_ids"], packing.position_kind(70_000)) == np.arange(70_000)).all()
    assert row["input_ids"] == long.tobytes() and packing.position_kind(1 << 16) == "<u2"


def test_marginals():
    rng = np.random.default_rng(4)
    counts = np.array([3, 1, 5, 2])
    good, trans = rng.normal(size=11), rng.normal(size=(2, 2))
    got, pairs = crf.Chains(counts).marginals(good, trans)
    at = 0
    for n in counts:
        total, one, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(good[at + i] * y[i] for i in range(n)) + sum(trans[y[i - 1], y[i]] for i in range(1, n)))
            total += p
            one += p * np.array(y)
            for i in range(1, n):
                both[i, y[i - 1], y[i]] += p
        assert np.allclose(got[at:at + n], one / total) and np.allclose(pairs[at:at + n], both / total)
        at += n


def test_line_features_see_only_their_text():
    texts = [b"a b c d e f. \n\nx | y", b"", b"A!! B!!\nA!! B!!", b"w w w w w w w w"]
    x, size, counts = crf.line_features(texts)
    assert counts.tolist() == [2, 1, 2, 1] and size.tolist() == [13, 5, 1, 7, 7, 15]
    at = 0
    for t, n in zip(texts, counts):
        alone, _, _ = crf.line_features([t])
        assert np.allclose(alone, x[at:at + n])
        at += n


@pytest.fixture(scope="module")
def model():
    return pieces.load(pieces.MODEL)


ODD = ["", " ", "   ", " a", "a  b", "x\x1c y z", "é𝒳日本語 梦想 a b", "aaaa" * 100, "\t\n", "a" * 300 + " b", "  lead  trail  "]


def test_rate_0_is_the_plain_encoding(model, corpus):
    texts = [r[1] for r in corpus] + ODD
    got = model.encode(texts, pieces.document_keys([None] * len(texts), 1), 0.0)
    assert [x.tolist() for x in got] == model.processor.encode(texts)


def test_dropout(model, corpus, monkeypatch):
    texts = [r[1] for r in corpus[:40]] + ODD + ["own ▁ mark▁s"]
    keys = [pieces.document_keys(list(range(len(texts))), seed) for seed in (1, 2)]
    one, two, same = (model.encode(texts, k, 0.1) for k in (*keys, keys[0]))
    assert all((a == b).all() for a, b in zip(one, same)) and any(len(a) != len(b) or (a != b).any() for a, b in zip(one, two))
    assert [model.decode(x.tolist()) for x in one] == texts == [model.decode(x.tolist()) for x in two]
    monkeypatch.setattr(pieces, "LONG", 1)  # a heap for every segment
    assert all((a == b).all() for a, b in zip(one, model.encode(texts, keys[0], 0.1)))
    none = model.encode(texts, keys[0], 1.0)
    assert [model.decode(x.tolist()) for x in none] == texts and sum(map(len, none)) > sum(map(len, one))


def test_descent_finds_the_links(spark, monkeypatch):
    monkeypatch.setattr(descent, "BLOCK", 64)
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    far, centre = rng.normal(size=(500, 16)), rng.normal(size=(1, 16))
    pairs = far[:80] + 0.05 * rng.normal(size=(80, 16))
    dense = centre + 0.02 * rng.normal(size=(300, 16)) * np.abs(centre).mean()
    x = np.vstack([far, pairs, dense, dense[:40]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = unit(x.astype(float))
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = brute.components(range(len(x)), zip(*(k.tolist() for k in np.nonzero(near))))
    assert got == {i: (int(near[i].sum()), want[i], want[i] == i) for i in range(len(x))}


def test_descent_links_groups_that_fill_their_lists(spark, monkeypatch):
    monkeypatch.setattr(descent, "MOST", 12)  # much less than the groups hold
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    a, b = unit(rng.normal(size=(2, 32)))
    b = unit(b - (a @ b) * a)
    centres = a, 0.958 * a + np.sqrt(1 - 0.958 ** 2) * b  # the cosines of the two groups are 0.95 to 0.97, those inside 0.99
    x = np.vstack([rng.normal(size=(200, 32)), *(c + 0.001 * rng.normal(size=(150, 32)) for c in centres)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in descent.near_duplicates(df).collect()}
    assert got == {i: (0, i) if i < 200 else (299, 200) for i in range(500)}


def test_descent_says_when_the_audit_fails(spark, monkeypatch):
    df = spark.createDataFrame([(i, [1.0, i / 1000]) for i in range(20)], "vec_id long, embedding array<float>")
    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="of 380 links"):
        m.setattr(descent, "RECALL", 1.1)
        descent.near_duplicates(df)
    with pytest.warns(UserWarning, match="not measured"):
        descent.near_duplicates(df.where("vec_id = 1"))


def test_words_of_any_length_differ_by_every_byte():
    texts = [b"x" * n for n in (1, 7, 8, 9, 16, 17, 4097)]
    texts += [b"x" * k + b"y" + b"x" * (40 - k) for k in range(41)] + [b"\0", b"\0\0", "ÄÖ漢".encode()]
    raw, starts, size, words = lines.Lines._hashed([(0, 0, b" ".join(texts)), (1, 0, b"\t\n " + b"  ".join(texts) + b" ")])
    assert size.tolist() == 2 * [len(t) for t in texts]
    assert words[:len(texts)].tolist() == words[len(texts):].tolist() and len(set(words.tolist())) == len(texts)
    assert not len(lines.Lines._hashed([(0, 0, b" \n ")])[3])
