"""Rule sentences per profile, with the differences between profiles that the lexicons imply."""

import random
import re

import pytest
from pyspark.sql import functions as F

from murmullo.functions.lexicon import PROFILES, fold_lexicon, lexicon_frame, load_lexicon, merge
from murmullo.functions.text import contains_any, norm_text
from murmullo.operators import rules as R
from murmullo.operators import terms as T

T_, F_ = True, False
SENTENCES = {
    "JP terruco": dict(has_terruqueo=T_, has_political_mention=T_, has_polarization_signal=T_),
    "fraude en la ONPE": dict(has_fraude=T_, has_electoral_institution=T_),
    "calla serrano": dict(has_ethnic_racial_slur=T_, has_discriminatory_language=T_),
    "vamos Keiko": dict(has_political_mention=T_, has_polarization_signal=F_),
    "rojos comunistas": dict(has_terruqueo=T_, has_political_mention=F_),
    "ptm que gane": dict(has_general_insult=F_, is_spam_noise=F_),
    "\U0001F602\U0001F602\U0001F602\U0001F602": dict(is_spam_noise=T_),
    "puro kbraso bota por keiko": dict(
        has_homophobic_slur=T_, has_discriminatory_language=T_, has_political_mention=T_, has_polarization_signal=T_),
    "actas del JNE": dict(has_fraude=F_, has_electoral_institution=T_),
}
DIFFERENT = {
    "k": {
        "rojos comunistas": dict(has_terruqueo=F_),
        "puro kbraso bota por keiko": dict(has_homophobic_slur=F_, has_discriminatory_language=F_, has_polarization_signal=F_),
    },
    "s": {
        "JP terruco": dict(has_polarization_signal=F_),
        "puro kbraso bota por keiko": dict(has_homophobic_slur=F_, has_discriminatory_language=F_, has_polarization_signal=F_),
        "\U0001F602\U0001F602\U0001F602\U0001F602": dict(is_spam_noise=F_),
    },
}


def run(spark, texts, profile):
    df = spark.createDataFrame([(t, t, "61000") for t in texts], "message_raw string, message_clean string, video_offset_msec string")
    df = df.withColumn("given", F.col("message_raw"))
    return {r["given"]: r for r in R.add_rules(df, profile).collect()}


@pytest.mark.parametrize("profile", ["v1", "k", "s", "l"])
def test_sentences(spark, profile):
    got = run(spark, list(SENTENCES), profile)
    for sentence, expected in SENTENCES.items():
        wanted = {**expected, **DIFFERENT.get(profile, {}).get(sentence, {})}
        assert {k: got[sentence][k] for k in wanted} == wanted, (profile, sentence)
    assert got["JP terruco"]["minute"] == 1


def test_scores(spark):
    everything = "keiko terruco fraude cholo marica mierda onpe"
    got = run(spark, [everything, "marica", "ok", "", "jajajajajaja keiko", "jajajajajaja", "jajajajajaja fraude"], "v1")
    assert got[everything]["local_risk_score"] == 10
    assert got["marica"]["local_risk_score"] == 4
    assert got["ok"]["local_risk_score"] == 0 and got["ok"]["is_spam_noise"]
    assert got[""]["is_spam_noise"] and got[""]["local_risk_score"] == 0
    assert got["jajajajajaja keiko"]["local_risk_score"] == 0  # 1 - 1
    assert got["jajajajajaja fraude"]["local_risk_score"] == 2  # a strong flag lifts the penalty
    assert got[everything]["local_rule_tags"].split("|")[0] == "terruqueo"
    stream = run(spark, ["keiko mierda"], "s")["keiko mierda"]
    assert stream["local_risk_score"] == 2  # insult counts in the streaming profile


def test_boundaries(spark):
    got = run(
        spark,
        ["fraude", "x fraude", "fraude fraude", "fraudes", "sendero   luminoso", "sendero:luminoso", "fraaaude", "http://fraude.pe",
         "fraude:robo", "fraude_x", "mi ¡FRAUDE!"],
        "v1",
    )
    hits = {t for t, r in got.items() if r["has_fraude"]}
    assert hits == {"fraude", "x fraude", "fraude fraude", "fraaaude", "fraude:robo", "mi ¡FRAUDE!"}
    assert got["sendero   luminoso"]["has_terruqueo"]
    assert run(spark, ["fraaaude"], "k")["fraaaude"]["has_fraude"] is False
    assert run(spark, ["superfraudes"], "s")["superfraudes"]["has_fraude"] is True


def test_symbol_only_is_ascii_in_v1_and_unicode_in_l(spark):
    assert run(spark, ["áéíóú"], "v1")["áéíóú"]["is_spam_noise"] is True
    assert run(spark, ["áéíóú"], "l")["áéíóú"]["is_spam_noise"] is False
    assert run(spark, [":a_b: :c:"], "l")[":a_b: :c:"]["is_spam_noise"] is True


def test_null_text(spark):
    df = spark.createDataFrame([(None, None)], "message_raw string, message_clean string")
    for profile in PROFILES:
        row = R.add_rules(df, profile).first()
        assert row["is_spam_noise"] is True and row["local_risk_score"] == 0


def test_find_terms_against_regex(spark):
    """The hit list agrees with a boundary regex for every term, one by one."""
    import re

    terms = sorted({t for ts in fold_lexicon(PROFILES["v1"].lexicon).values() for t in ts})
    texts = [" ".join(terms[i:i + 7]) for i in range(0, len(terms), 5)] + ["rafael lopez aliaga", "a:votos perdidos:b", "boca de urna"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, hits in df.select("t", R.find_terms(norm_text(F.col("t")), terms)).collect():
        wanted = {x for x in terms if re.search(r"(?<!\w)" + r"\s+".join(x.split()) + r"(?!\w)", t)}
        assert set(hits) == wanted


def test_many_phrases_use_one_lambda(spark):
    phrases = [f"palabra n{i}" for i in range(400)]
    df = spark.createDataFrame([("una palabra n7 y palabra n399",), ("nada",)], "t string")
    got = [sorted(r[0]) for r in df.select(R.find_terms(F.col("t"), phrases)).collect()]
    assert got == [["palabra n399", "palabra n7"], []]


def test_costly_columns_are_computed_once(spark):
    df = spark.createDataFrame([("fraude",)], "message string")
    plan = R.add_rules(df, "v1").where("has_fraude OR has_terruqueo OR is_spam_noise")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array_intersect") <= 2
    assert "BatchEvalPython" not in plan and "Exchange" not in plan


def test_lexicon_file_round_trip(spark, tmp_path):
    lexicon_frame(spark, PROFILES["k"].lexicon, "mine").write.option("header", True).csv(str(tmp_path / "lex"))
    loaded = load_lexicon(spark, str(tmp_path / "lex"), "mine")
    assert {c: sorted(t) for c, t in loaded.items()} == {c: sorted(t) for c, t in fold_lexicon(merge(PROFILES["k"].lexicon)).items()}
    assert all(not terms for terms in load_lexicon(spark, str(tmp_path / "lex"), "other").values())


def test_join_lexicon_agrees_with_inline_matching(spark):
    texts = [("a", "robo electoral y actas falsas"), ("b", "peru libre peru libre"), ("c", "actas: falsas"), ("d", "")]
    df = spark.createDataFrame(texts, "event_id string, message_raw string")
    inline = {tuple(r) for r in R.matched_terms(df, "v1").collect()}
    lexicon = lexicon_frame(spark, PROFILES["v1"].lexicon)
    joined = T.join_lexicon(T.explode_words(df, "event_id", F.col("message_raw"), 5), lexicon, "event_id")
    assert {tuple(r) for r in joined.collect()} == inline
    assert ("a", "fraude", "robo electoral") in inline and ("c", "fraude", "actas falsas") not in inline


def test_lexicons_have_no_largest_size(spark):
    """30,000 terms as a table, and 400 phrases as literals, give the rows of a join."""
    many = {"fraude": [f"term{i}" for i in range(30000)]}
    df = spark.createDataFrame([("a", "un term29999 y term5"), ("b", "term30000")], "event_id string, message_raw string")
    words = T.explode_words(df, "event_id", F.col("message_raw"), 1)
    assert {tuple(r) for r in T.join_lexicon(words, lexicon_frame(spark, many), "event_id").collect()} == {("a", "fraude", "term29999"), ("a", "fraude", "term5")}
    phrases = {"fraude": [f"head{i % 7} tail{i}" for i in range(400)]}
    df = spark.createDataFrame([("a", "head3 tail3 y head6 tail398 tail1"), ("b", "head1 tail2")], "event_id string, message_raw string")
    inline = {tuple(r) for r in R.matched_terms(df, PROFILES["v1"].with_lexicon(phrases)).collect()}
    joined = T.join_lexicon(T.explode_words(df, "event_id", F.col("message_raw"), 2), lexicon_frame(spark, phrases), "event_id")
    assert inline == {tuple(r) for r in joined.collect()} == {("a", "fraude", "head3 tail3"), ("a", "fraude", "head6 tail398")}


@pytest.mark.parametrize("size", [40, 400])
def test_short_and_long_lexicons_find_every_whole_term(spark, size):
    rnd = random.Random(size)
    word = lambda: "".join(rnd.choice("ab1_") for _ in range(rnd.randint(1, 3)))
    terms = list({" ".join(word() for _ in range(rnd.randint(1, 3))) for _ in range(3 * size)})[:size - 5] + ["a:b", ":ab:", "b:"]
    texts = [(str(i), rnd.choice([" ", ":"]).join(word() for _ in range(rnd.randint(0, 12)))) for i in range(200)]
    df = spark.createDataFrame([(i, " ".join(t.split())) for i, t in texts], "event_id string, t string")
    whole = lambda t: {x for x in terms if re.search(rf"(?<!\w){x}(?!\w)", t, re.A)}
    for r in df.select("t", R.find_terms(F.col("t"), terms).alias("found"), contains_any(F.col("t"), terms).alias("any")).collect():
        assert len(r.found) == len(set(r.found)) and set(r.found) == whole(r.t)
        assert r.any == any(x in r.t for x in terms)


def test_long_lexicons_flag_as_short_ones_do(spark):
    """A category beyond the set size, with the terms of the profile among others."""
    df = spark.createDataFrame([("a", "robo electoral y actas falsas"), ("b", "terruco de mierda"), ("c", ""), ("d", "cosa7 fina")], "event_id string, message_raw string")
    df = df.withColumn("message_clean", F.col("message_raw"))
    many = {"fraude": [f"palabra{i} rara" for i in range(600)], "terruqueo": [f"otra{i}" for i in range(300)]}
    for name in ("v1", "k", "s", "l"):
        given, more = R.add_rules(df, name), R.add_rules(df, PROFILES[name].with_terms(many))
        assert sorted(map(tuple, given.collect())) == sorted(map(tuple, more.collect()))
    more = PROFILES["v1"].with_terms({**many, "fraude": [*many["fraude"], "cosa7 fina"]})
    assert [r.event_id for r in R.add_rules(df, more).where("has_fraude").orderBy("event_id").collect()] == ["a", "d"]
    assert ("d", "fraude", "cosa7 fina") in {tuple(r) for r in R.matched_terms(df, more).collect()}


def test_only_words_that_may_start_a_term_are_emitted(spark):
    lexicon = spark.createDataFrame([("c", f"head{i} tail") for i in range(50)] + [("c", "solo")], "category string, term string")
    df = spark.createDataFrame([("a", "head3 tail y muchas otras palabras que no son de la lista solo"), ("b", ""), ("c", None)], "event_id string, t string")
    _, longest, starts = T.first_word_filter(lexicon)
    words = T.explode_words(df, "event_id", F.col("t"), longest, starts=starts)
    assert longest == 2 and {"head3", "solo"} <= {r.word for r in words.collect()} and words.count() <= 4
    assert {tuple(r) for r in T.match_lexicon(df, "event_id", F.col("t"), lexicon).collect()} == {("a", "c", "head3 tail"), ("a", "c", "solo")}
    assert T.match_lexicon(df, "event_id", F.col("t"), lexicon.where("false")).count() == 0


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_wanted_rule_columns_are_computed(spark):
    df = spark.createDataFrame([("a", "robo electoral y actas falsas"), ("b", "terruco de mierda"), ("c", "")], "event_id string, message_raw string")
    for name in ("v1", "k", "l"):
        given = df.withColumn("message_clean", F.col("message_raw"))
        full = R.add_rules(given, name)
        for wanted in (["has_fraude"], ["local_risk_score"], ["has_polarization_signal", "is_spam_noise"], ["local_rule_tags"]):
            some = R.add_rules(given, name, columns=wanted)
            assert [c for c in some.columns if c in R.RULE_OUTPUT] == [c for c in full.columns if c in wanted]
            assert sorted(map(tuple, some.select("event_id", *wanted).collect())) == sorted(map(tuple, full.select("event_id", *wanted).collect()))
    one = _plan(R.add_rules(df, "v1", columns=["has_fraude"]).select("event_id", "has_fraude"))
    assert one.count("arrays_overlap") <= 2 and "terruco" not in one
    none = _plan(R.add_rules(df, "v1", columns=[]).select("event_id"))
    assert "regexp" not in none and "Generate" not in none
