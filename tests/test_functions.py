"""Column functions on literal rows."""

import unicodedata

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from murmullo.functions import actors, chat, noise, scalars, text


def column(spark, values, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_cleaning(spark):
    raw = ["Hola  HTTPS://a.b/c fin", None, "\r\n a\tb ", "a​b﻿c", "x y WWW.z.pe"]
    assert column(spark, raw, text.clean_text) == ["hola fin", "", "a b", "a​b﻿c", "x y"]
    assert column(spark, raw, text.clean_text_unicode) == ["hola fin", "", "a b", "a b c", "x y"]
    assert column(spark, raw, text.clean_lake_text)[3:] == ["a b c", "x y WWW.z.pe"]


def test_normal_forms(spark):
    raw = ["¡Buenaaaas! Nñ", "ÁÁÁ á", "árbol", "holllla", "x:y_z"]
    assert column(spark, raw, text.norm_text)[:2] == ["buenas nn", "a a"]
    assert column(spark, raw, lambda c: text.norm_text(c, None))[0] == "buenaaaas nn"
    assert column(spark, raw, lambda c: text.norm_text(c, "any")) == ["buenas nn", "a a", "arbol", "hola", "x:y_z"]
    assert column(spark, ["  A\n B\x00 "], text.norm_stream) == ["a b"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x24F), max_size=30), min_size=1, max_size=20))
def test_mark_folding_like_decomposition(spark, values):
    def wanted(value):
        import re

        low = re.sub(r"\s+", " ", value).strip().lower()
        bare = "".join(c for c in unicodedata.normalize("NFD", low) if unicodedata.category(c) != "Mn")
        bare = re.sub(r"(.)\1{2,}", r"\1", bare)
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9:_\s]", " ", bare)).strip()

    kept = [v for v in values if "http" not in v.lower() and "www" not in v.lower()]
    assert column(spark, kept, lambda c: text.norm_text(c, "any")) == [wanted(v) for v in kept] if kept else True


def test_lengths(spark):
    raw = ["abc", "\U0001F602a", None]
    assert column(spark, raw, text.message_length) == [3, 2, 0]
    assert column(spark, raw, lambda c: text.message_length(c, "utf16")) == [3, 3, 0]


def test_noise(spark):
    assert column(spark, ["\U0001F602 !!", "a", "", " ", "9"], noise.is_symbol_only) == [True, False, False, False, False]
    assert column(spark, ["jajajajaja", "xdxdxdxd", "zzzzzzzzz", "jaja"], noise.is_laughter) == [True, True, True, False]
    repeated = column(
        spark, ["holaaaaaa", "no no no", "no no", "a b c d", "si:no no no", "\U0001F602" * 6],
        lambda c: noise.has_repetition(c, text.norm_text(c, "any")))
    assert repeated == [True, True, False, False, True, True]
    assert column(spark, ["\U0001F602☀ x", "x"], noise.emoji_count) == [2, 0]
    assert column(spark, ["\U0001F602 ", "\U0001F602\U0001F602", "x\U0001F602"], noise.is_single_emoji) == [True, False, False]


def test_scalars(spark):
    assert column(spark, ["59999", "60000", "x", None, "-1"], scalars.minute_bucket) == [0, 1, None, None, -1]
    assert column(spark, ["1:02", "1:00:01", "-0:05", "abc", None], scalars.clock_seconds) == [62, 3601, -5, None, None]
    buckets = column(spark, [None, "0.4999", "0.5", "0.5999", "0.6", "0.7", "0.9", "1.0", "1.1"], lambda c: scalars.confidence_bucket(c.cast("double")))
    assert buckets == ["out_of_range", "out_of_range", "0.50-0.60", "0.50-0.60", "0.60-0.70", "0.70-0.80", "0.90-1.00", "0.90-1.00", "out_of_range"]
    assert column(spark, ["0", "3", "9", None], lambda c: scalars.label_name(c, scalars.MULTICLASS_LABELS)) == [
        "ofensivo_directo", "vulgaridad_contextual", "unknown", "unknown"]
    assert column(spark, ["TRUE", "1", "Yes", "0", None], scalars.parse_bool) == [True, True, True, False, False]


def test_json_string(spark):
    raw = ['{"a": "x\\ny \\"q\\""}', '{"a": 5}', '{"b": "x"}', "not json", None]
    assert column(spark, raw, lambda c: text.json_string(c, "a")) == ['x y "q"', "", "", "", ""]


def test_chat_fields(spark):
    assert column(spark, ["t [abcDEF_-12].live_chat.json", "t [short].live_chat.json", "x"], chat.video_id_from_file) == ["abcDEF_-12", "", ""]
    assert column(spark, ["JP", "ok", "S Í", "  ", "abc"], chat.is_worth_keeping) == [True, False, True, False, True]
    keys = column(spark, ["v", "", None], lambda c: chat.event_key(c, F.lit(""), F.lit(None).cast("string"), c))
    assert keys == ["v|v", None, None]
    import hashlib

    ids = column(spark, ["v", None], lambda c: chat.event_id(F.lit("p"), c, c, c, c, F.lit(7)))
    assert ids == [hashlib.sha256(s.encode()).hexdigest()[:32] for s in ("p|v|v|v|v|7", "p|||||7")]


def test_actors(spark):
    found = column(spark, ["keiko", "perú libre", "mfpx", "jp", "nada"], lambda c: actors.resolve_actor(text.norm_stream(c)))
    assert found == ["keiko_fujimori_fp", "castillo_peru_libre", "keiko_fujimori_fp", "jp_juntos_por_el_peru", ""]
    assert column(spark, ["antauro", "Jp", "jp_x", "a  b", None], actors.canonical_actor) == [
        "antauro_humala", "jp_juntos_por_el_peru", "jp_juntos_por_el_peru", "a_b", ""]
