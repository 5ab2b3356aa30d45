"""Text and scalar functions (family C) over whole documents and comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.data import comments, predicted, read
from checks.registry import query
from murmullo.functions import actors, noise, scalars, text

# Documents have no URLs, zero-width characters or emoji: these pieces, appended by arithmetic on
# the id, give the cleaners something to do.
_SPICE = {
    0: " see https://a.b/c?d=1 www.x.org\tend ",
    1: "​HOLA﻿  Árbooool \U0001F602\U0001F602 ",
    2: " ¿qué? jajajajaja :orange_heart: ",
    3: "",
}


def _spiced(spark, sf):
    piece = F.lit("")
    for k, v in _SPICE.items():
        piece = F.when(F.col("doc_id") % 4 == k, v).otherwise(piece)
    return read(spark, sf, "documents").select("doc_id", F.concat("text", piece).alias("t"))


_SPICED = "docs AS (SELECT doc_id, text || CASE doc_id % 4 " + " ".join(
    f"WHEN {k} THEN {S.lit(v)}" for k, v in _SPICE.items()
) + " END AS t FROM documents)"


def _hashed(col):
    """Long texts are compared by their SHA-256."""
    return F.sha2(col, 256).alias("digest")


def _digest_sql(expr: str) -> str:
    return S.chain(_SPICED, final=f"SELECT doc_id, sha256({expr}) AS digest, length({expr}) AS chars FROM docs")


def _digest(spark, sf, expr):
    return _spiced(spark, sf).withColumn("x", expr).select("doc_id", _hashed(F.col("x")), F.length("x").cast("long").alias("chars"))


@query("c01_clean_text", _digest_sql(S.clean("t")))
def c01(spark, sf):
    return _digest(spark, sf, text.clean_text(F.col("t")))


_VISIBLE = "translate(t, '​﻿', '  ')"


@query("c02_clean_text_unicode", _digest_sql(
    f"lower(trim(regexp_replace(regexp_replace({_VISIBLE}, '(?i)https?://\\S+|www\\.\\S+', ' ', 'g'), '\\s+', ' ', 'g')))"))
def c02(spark, sf):
    return _digest(spark, sf, text.clean_text_unicode(F.col("t")))


@query("c03_clean_lake_text", _digest_sql(f"trim(regexp_replace({_VISIBLE}, '\\s+', ' ', 'g'))"))
def c03(spark, sf):
    return _digest(spark, sf, text.clean_lake_text(F.col("t")))


@query("c04_norm_text", _digest_sql(S.norm("t", "vowels")))
def c04(spark, sf):
    return _digest(spark, sf, text.norm_text(F.col("t"), "vowels"))


@query("c05_norm_text_plain", _digest_sql(S.norm("t", None)))
def c05(spark, sf):
    return _digest(spark, sf, text.norm_text(F.col("t"), None))


@query("c06_norm_text_marks", _digest_sql(S.norm(_VISIBLE, "any")))
def c06(spark, sf):
    return _digest(spark, sf, text.norm_text(F.col("t"), "any"))


@query("c07_norm_stream", _digest_sql(S.norm("t", "stream")))
def c07(spark, sf):
    return _digest(spark, sf, text.norm_stream(F.col("t")))


_HOLES = """
holes AS (SELECT event_id, CASE WHEN n % 3 = 0 THEN NULL WHEN n % 3 = 1 THEN '' ELSE message_clean END AS cl,
  CASE WHEN n % 5 = 0 THEN NULL WHEN n % 5 = 1 THEN '' ELSE message_raw || '!' END AS rw FROM comments)"""


def _holes(spark, sf):
    n = F.col("row_number").cast("long")
    return comments(spark, sf).select(
        "event_id",
        F.when(n % 3 == 1, "").when(n % 3 == 2, F.col("message_clean")).alias("cl"),
        F.when(n % 5 == 1, "").when(n % 5 > 1, F.concat("message_raw", F.lit("!"))).alias("rw"),
    )


@query("c08_main_text", S.chain(S.COMMENTS, _HOLES, final="""
SELECT event_id, coalesce(nullif(cl, ''), nullif(rw, ''), '') AS non_empty, coalesce(cl, rw, '') AS non_null FROM holes"""))
def c08(spark, sf):
    return _holes(spark, sf).select(
        "event_id", text.main_text(F.col("cl"), F.col("rw")).alias("non_empty"),
        text.main_text(F.col("cl"), F.col("rw"), empty_is_missing=False).alias("non_null"),
    )


@query("c09_json_string", """
SELECT event_id, CASE WHEN json_type(props, '$.k') = 'VARCHAR' THEN props ->> '$.k' ELSE '' END AS k_text,
  CASE WHEN event_id % 2 = 0 THEN event_type || ' "x"' ELSE '' END AS typed
FROM events""")
def c09(spark, sf):
    name = F.when(F.col("event_id") % 2 == 0, F.concat("event_type", F.lit(' "x"')))
    made = F.to_json(F.struct(name.alias("typed"), F.col("value").alias("k")))
    return read(spark, sf, "events").select(
        "event_id", text.json_string(F.col("props"), "k").alias("k_text"), text.json_string(made, "typed").alias("typed")
    )


@query("c10_message_length", S.chain(_SPICED, final=f"""
SELECT doc_id, CAST(length(t) AS INTEGER) AS code_points, {S.utf16_length('t')} AS utf16, length(t) = 0 AS is_empty FROM docs"""))
def c10(spark, sf):
    t = F.col("t")
    return _spiced(spark, sf).select(
        "doc_id", text.message_length(t).alias("code_points"), text.message_length(t, "utf16").alias("utf16"),
        text.is_empty(t).alias("is_empty"),
    )


_PADDED = (" que ", "of the", "NICHT", "zzz")


@query("c12_contains_any", f"SELECT doc_id, {S.substrings(S.norm('text', 'stream'), _PADDED)} AS found FROM documents")
def c12(spark, sf):
    return read(spark, sf, "documents").select(
        "doc_id", text.contains_any(text.norm_stream(F.col("text")), _PADDED).alias("found")
    )


@query("c13_minute_bucket", S.chain(S.COMMENTS, final=f"SELECT event_id, {S.MINUTE} AS minute FROM comments"))
def c13(spark, sf):
    return comments(spark, sf).select("event_id", scalars.minute_bucket(F.col("video_offset_msec")).alias("minute"))


@query("c14_minute_or_fallback", S.chain(S.COMMENTS, final="""
SELECT event_id,
  CAST(CAST(floor(coalesce(TRY_CAST(video_offset_msec AS DOUBLE), 0) / 60000) AS BIGINT) AS VARCHAR) AS by_offset,
  CAST(CAST(split_part(timestamp_text, ':', 1) AS BIGINT) AS VARCHAR) AS by_clock, 'global' AS by_nothing FROM comments"""))
def c14(spark, sf):
    offset, clock = F.col("video_offset_msec"), F.col("timestamp_text")
    yes, no = F.lit(True), F.lit(False)
    return comments(spark, sf).select(
        "event_id",
        scalars.minute_or_fallback(offset, clock, yes, yes).alias("by_offset"),
        scalars.minute_or_fallback(offset, clock, no, yes).alias("by_clock"),
        scalars.minute_or_fallback(offset, clock, no, no).alias("by_nothing"),
    )


@query("c15_confidence_bucket", S.chain(S.COMMENTS, S.PREDICTED, final=f"""
SELECT event_id, {S.bucket('confidence_binary_sparkml')} AS bucket, {S.bucket('confidence_multiclass_sparkml')} AS other_bucket FROM predicted"""))
def c15(spark, sf):
    return predicted(spark, sf).select(
        "event_id", scalars.confidence_bucket(F.col("confidence_binary_sparkml")).alias("bucket"),
        scalars.confidence_bucket(F.col("confidence_multiclass_sparkml")).alias("other_bucket"),
    )


@query("c16_label_name", S.chain(S.COMMENTS, S.PREDICTED, final="""
SELECT event_id, pred_binary_sparkml_label AS b, pred_multiclass_sparkml_label AS m FROM predicted"""))
def c16(spark, sf):
    return predicted(spark, sf).select(
        "event_id", scalars.label_name(F.col("pred_binary_sparkml"), scalars.BINARY_LABELS).alias("b"),
        scalars.label_name(F.col("pred_multiclass_sparkml"), scalars.MULTICLASS_LABELS).alias("m"),
    )


@query("c17_probability_at", """
SELECT vec_id, CAST(embedding[(vec_id * 7) % 100 + 1] AS DOUBLE) AS p FROM embeddings""")
def c17(spark, sf):
    df = read(spark, sf, "embeddings")
    p = scalars.probability_at(F.col("embedding"), (F.col("vec_id") * 7) % 100, is_vector=False)
    return df.select("vec_id", p.cast("double").alias("p"))


@query("c18_max_probability", "SELECT vec_id, CAST(list_max(embedding) AS DOUBLE) AS p FROM embeddings")
def c18(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", scalars.max_probability(F.col("embedding"), False).cast("double").alias("p"))


@query("c19_parse_bool", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS flag FROM events""")
def c19(spark, sf):
    words = F.array(*[F.lit(w) for w in ("TRUE", "1", "yes", "no", "2")])
    return read(spark, sf, "events").select(
        "event_id", scalars.parse_bool(F.get(words, (F.col("event_id") % 6).cast("int"))).alias("flag")
    )


@query("c20_pct", """
SELECT source, round(count(*) FILTER (WHERE lang = 'en') * 100.0::DOUBLE / count(*), 4) AS share,
  CAST(0 AS DOUBLE) AS empty_share FROM documents GROUP BY source""")
def c20(spark, sf):
    return read(spark, sf, "documents").groupBy("source").agg(
        scalars.pct(F.count_if(F.col("lang") == "en"), F.count(F.lit(1))).alias("share"),
        scalars.pct(F.count(F.lit(1)), F.count_if(F.lit(False))).alias("empty_share"),
    )


# Every second comment is cut down to one of these: the tests below need noise to find.
_NOISES = ("\U0001F602\U0001F602", "!!! ...", "áé", ":a: :b_c:", "jajajajajaja", "zzzzzzzzz", "xdxdxdxd x", "no no no no",
           "muuuuuuuucho", "hola", "", "\U0001F602 x")


def _noisy(spark, sf):
    n = F.col("row_number").cast("long")
    pick = F.get(F.array(*[F.lit(x) for x in _NOISES]), ((n / 2).cast("long") % len(_NOISES)).cast("int"))
    return comments(spark, sf).select("event_id", F.when(n % 2 == 0, pick).otherwise(F.col("message_raw")).alias("t"))


_NOISY = "noisy AS (SELECT event_id, CASE WHEN n % 2 = 0 THEN CASE (n // 2) % 12 " + " ".join(
    f"WHEN {i} THEN {S.lit(x)}" for i, x in enumerate(_NOISES)) + " END ELSE message_raw END AS t FROM comments)"
_BARE = r"regexp_replace(t, '[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]|\s', '', 'g')"


@query("c21_symbol_only", S.chain(S.COMMENTS, _NOISY, final=f"""
SELECT event_id, length(trim(t)) > 0 AND ({_BARE} = '' OR regexp_matches({_BARE}, '^[^a-zA-Z0-9]+$')) AS symbols FROM noisy"""))
def c21(spark, sf):
    return _noisy(spark, sf).select("event_id", noise.is_symbol_only(F.col("t")).alias("symbols"))


@query("c22_symbol_only_unicode", S.chain(S.COMMENTS, _NOISY, f"normal AS (SELECT *, {S.norm('t', 'any')} AS nt FROM noisy)", final=f"""
SELECT event_id, trim(t) = '' OR regexp_matches(trim(t), '^:\\S+:(\\s+:\\S+:)*$')
  OR ({_BARE} <> '' AND NOT regexp_matches({_BARE}, '[\\p{{L}}\\p{{N}}]')) OR (nt <> '' AND NOT regexp_matches(nt, '[a-z0-9]')) AS symbols FROM normal"""))
def c22(spark, sf):
    t = F.col("t")
    return _noisy(spark, sf).select("event_id", noise.is_symbol_only_unicode(t, text.norm_text(t, "any")).alias("symbols"))


_LAUGH = "(ja){5,}|(jaja){3,}|(xd){4,}"


@query("c23_laughter", S.chain(S.COMMENTS, _NOISY, f"normal AS (SELECT event_id, {S.norm('t')} AS nt FROM noisy)", final=f"""
SELECT event_id, regexp_matches(nt, '{_LAUGH}|(zzz){{3,}}') AS with_z, regexp_matches(nt, '{_LAUGH}') AS without_z FROM normal"""))
def c23(spark, sf):
    nt = text.norm_text(F.col("t"))
    return _noisy(spark, sf).select("event_id", noise.is_laughter(nt).alias("with_z"), noise.is_laughter(nt, False).alias("without_z"))


@query("c24_repetition", S.chain(
    S.COMMENTS, _NOISY,
    f"""parts AS (SELECT event_id, string_split({S.clean('t')}, '') AS c, string_split({S.norm('t', 'any')}, ' ') AS w FROM noisy)""",
    final="""
SELECT event_id,
  len(list_filter(range(1, len(c) - 4), lambda i: c[i] = c[i+1] AND c[i] = c[i+2] AND c[i] = c[i+3] AND c[i] = c[i+4] AND c[i] = c[i+5])) > 0
  OR len(list_filter(range(1, len(w) - 1), lambda i: w[i] <> '' AND w[i] = w[i+1] AND w[i] = w[i+2])) > 0
  OR (len(w) >= 4 AND len(list_distinct(w)) = 1) AS repeated FROM parts"""))
def c24(spark, sf):
    t = F.col("t")
    return _noisy(spark, sf).select("event_id", noise.has_repetition(t, text.norm_text(t, "any")).alias("repeated"))


_FLAT = "replace(replace(message_raw, chr(10), ' '), '|', '/')"


@query("c25_truncate", S.chain(S.COMMENTS, final=f"""
SELECT event_id, CASE WHEN length({_FLAT}) > 220 THEN substr({_FLAT}, 1, 217) || '...' ELSE {_FLAT} END AS short,
  CASE WHEN length({_FLAT}) > 260 THEN substr({_FLAT}, 1, 257) || '...' ELSE {_FLAT} END AS longer FROM comments"""))
def c25(spark, sf):
    return comments(spark, sf).select(
        "event_id", text.truncate(F.col("message_raw"), 220).alias("short"), text.truncate(F.col("message_raw"), 260).alias("longer")
    )


_ALIASES = ("Keiko F", "ONPE oficial", "Peru Libre x", "jp", "jp_2026", "jpx", "Lopez Aliaga", "ANTAURO", "Otro  Actor", "")


@query("c26_canonical_actor", S.chain(
    S.COMMENTS,
    "aliases AS (SELECT event_id, CASE n % 11 " + " ".join(f"WHEN {i} THEN {S.lit(a)}" for i, a in enumerate(_ALIASES)) + " END AS a FROM comments)",
    final=f"SELECT event_id, {S.canonical('a')} AS actor FROM aliases"))
def c26(spark, sf):
    alias = F.get(F.array(*[F.lit(a) for a in _ALIASES]), (F.col("row_number").cast("long") % 11).cast("int"))
    return comments(spark, sf).select("event_id", actors.canonical_actor(alias).alias("actor"))
