"""What costly steps are made of, and that their cheaper forms give what the plain ones give."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmullo.functions import noise, text
from murmullo.operators.rules import add_rules

TEXTS = [
    None, "", " ", "www.", "www.a b", "http://", "https://x.y/z?q=1 fin", "HTTPS://X.Y Z", "ftp://a b", "a://b", "wwwa.b", "\u00c1rbol aaaa \u00d1and\u00fa ooo",
    "jajajajaj", "JAJAjajaja", "xdxdxdx", "XDXDXDXD", "zzzzzzzz", "zzZZzzzzz", "\U0001F600 !!", "\U0001F600a", "...", "\u00f1", "\t\n", "a::b  ::c",
]


def _old_norm(col):
    folded = F.regexp_replace(F.lower(text.text_or_empty(col)), text.URL_PATTERN, " ")
    folded = F.regexp_replace(F.translate(folded, text.ACCENTED, text.FOLDED), r"([aeiou])\1{2,}", "$1")
    return F.trim(F.regexp_replace(folded, r"[^\w:]+", " "))


def _old_clean(col):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text.text_or_empty(col)), text.URL_PATTERN, " "), r"\s+", " "))


def _old_symbol_only(col):
    rest = F.regexp_replace(text.text_or_empty(col), noise.EMOJI_CLASS + r"|\s", "")
    return (F.length(F.trim(text.text_or_empty(col))) > 0) & ~rest.rlike(r"[a-zA-Z0-9]")


def test_cheap_forms_are_equal(spark):
    t = F.col("t")
    pairs = [
        (text.norm_text(t), _old_norm(t)), (text.clean_text(t), _old_clean(t)), (noise.is_symbol_only(t), _old_symbol_only(t)),
        (noise.is_laughter(t), t.rlike(r"(?i)((ja){5,}|(jaja){3,}|(xd){4,}|(zzz){3,})")),
        (noise.is_laughter(t, with_z=False), t.rlike(r"(?i)((ja){5,}|(jaja){3,}|(xd){4,})")),
    ]
    df = spark.createDataFrame([(x,) for x in TEXTS], "t string")
    for row in df.select("t", *[F.struct(a.alias("new"), b.alias("old")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).collect():
        for found in row[1:]:
            assert found["new"] == found["old"], row


def test_rules_have_few_patterns(spark):
    """Patterns over the whole message: URLs, vowel runs, words and the search for a letter or digit; no look-up of every character."""
    df = add_rules(spark.createDataFrame([("hola",)], "message string"), "v1").select("is_spam_noise")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan
    assert noise.EMOJI_CLASS not in plan and "(ja)" not in plan
