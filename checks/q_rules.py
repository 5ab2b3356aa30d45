"""Rule engine (family D) on comments and whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S
from checks.data import TEST_ACTORS, TEST_TERMS, comments, read, rules, ruled
from checks.registry import query
from murmullo.functions import actors
from murmullo.functions.lexicon import PROFILES, fold_lexicon, lexicon_frame
from murmullo.functions.text import norm_stream, norm_text
from murmullo.operators import rules as R
from murmullo.operators import terms as T

_FLAG_LIST = ", ".join(S.FLAGS)


def _flags(spark, sf, name):
    return ruled(spark, sf, name).select("event_id", *S.FLAGS, "local_risk_score", "local_rule_tags", "minute")


def _flags_sql(name):
    return S.chain(S.COMMENTS, S.rules_cte(name), final=f"SELECT event_id, {_FLAG_LIST}, local_risk_score, local_rule_tags, minute FROM ruled")


for _id, _profile in (("d02", "v1"), ("d03", "k"), ("d04", "s"), ("d05", "l")):
    query(f"{_id}_rules_{_profile}", _flags_sql(_profile))(lambda spark, sf, p=_profile: _flags(spark, sf, p))

_DOCS = "docs AS (SELECT doc_id, text AS message_raw, text AS message_clean, CAST(NULL AS VARCHAR) AS video_offset_msec FROM documents)"


@query("d02_rules_v1_documents", S.chain(_DOCS, S.rules_cte("v1", source="docs"), final=f"SELECT doc_id, {_FLAG_LIST}, local_risk_score, local_rule_tags FROM ruled"))
def d02_documents(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", F.col("text").alias("message"))
    return R.add_rules(docs, rules("v1")).select("doc_id", *S.FLAGS, "local_risk_score", "local_rule_tags")


def _lexicon_values(name, terms=None):
    lexicon = fold_lexicon(terms if terms is not None else rules(name).lexicon)
    return "lexicon(category, term) AS (VALUES " + ", ".join(f"({S.lit(c)}, {S.lit(t)})" for c, ts in lexicon.items() for t in ts) + ")"


_SPACED = "' ' || replace(text_norm, ':', ' : ') || ' '"


def _matched_sql(name, source="comments", key="event_id"):
    squeeze = rules(name).squeeze
    return f"""
normal AS (SELECT {key}, {S.norm('message_raw', squeeze)} AS text_norm FROM {source}),
matched AS (SELECT {key}, category, term FROM normal JOIN lexicon ON contains({_SPACED}, ' ' || term || ' '))"""


@query("d01_lexicon", S.chain(_lexicon_values("v1"), _DOCS, _matched_sql("v1", "docs", "doc_id"), final="""
SELECT lexicon.category, lexicon.term, count(doc_id) AS documents FROM lexicon LEFT JOIN matched USING (category, term) GROUP BY ALL"""))
def d01(spark, sf):
    lexicon = lexicon_frame(spark, rules("v1").lexicon, "v1")
    docs = read(spark, sf, "documents")
    hits = T.term_counts(T.match_lexicon(docs, "doc_id", F.col("text"), lexicon))
    joined = lexicon.drop("profile").distinct().join(hits, ["category", "term"], "left")
    return joined.select("category", "term", F.coalesce("messages", F.lit(0)).alias("documents"))


@query("d06_risk_score", S.chain(S.COMMENTS, *[S.rules_cte(p, out=f"r_{p}") for p in ("v1", "k", "s")], final="""
SELECT event_id, r_v1.local_risk_score AS v1, r_k.local_risk_score AS k, r_s.local_risk_score AS s
FROM r_v1 JOIN r_k USING (event_id) JOIN r_s USING (event_id)"""))
def d06(spark, sf):
    # three profiles of the same rows: chained projections, no join
    df = comments(spark, sf).select("event_id", "message_raw", "message_clean")
    for name in ("v1", "k", "s"):
        kept = [c for c in df.columns if c in ("event_id", "message_raw", "message_clean") or c.startswith("score_")]
        df = R.add_rules(df.select(*kept), rules(name)).withColumnRenamed("local_risk_score", f"score_{name}")
    return df.select("event_id", *[F.col(f"score_{n}").alias(n) for n in ("v1", "k", "s")])


@query("d07_rule_tags", S.chain(S.COMMENTS, S.rules_cte("v1"), final="SELECT local_rule_tags, count(*) AS comments FROM ruled GROUP BY local_rule_tags"))
def d07(spark, sf):
    return ruled(spark, sf, "v1").groupBy("local_rule_tags").agg(F.count(F.lit(1)).alias("comments"))


@query("d08_matched_terms", S.chain(S.COMMENTS, _lexicon_values("l"), _matched_sql("l"), final="SELECT event_id, category, term FROM matched"))
def d08(spark, sf):
    return R.matched_terms(comments(spark, sf), rules("l"))


_LIST = ("the", "de la", "einheit", "nosuchterm", "que")


@query("d09_contains_term", f"SELECT doc_id, {S.whole_terms(S.norm('text'), _LIST)} AS found FROM documents")
def d09(spark, sf):
    return read(spark, sf, "documents").select("doc_id", R.contains_term(norm_text(F.col("text")), _LIST).alias("found"))


@query("d10_resolve_actor", f"SELECT doc_id, {S.actor(S.norm('text', 'stream'))} AS actor FROM documents")
def d10(spark, sf):
    return read(spark, sf, "documents").select("doc_id", actors.resolve_actor(norm_stream(F.col("text")), TEST_ACTORS).alias("actor"))


_ALERT = """((has_terruqueo AND has_general_insult) OR (has_fraude AND has_electoral_institution)
  OR has_ethnic_racial_slur OR has_homophobic_slur OR local_risk_score >= 4)"""
_ALERT_TYPE = """CASE WHEN has_ethnic_racial_slur THEN 'ethnic_racial_discrimination' WHEN has_homophobic_slur THEN 'homophobic_slur'
  WHEN has_terruqueo AND has_general_insult THEN 'terruqueo_plus_insult'
  WHEN has_fraude AND has_electoral_institution THEN 'fraude_plus_institution' ELSE 'high_local_risk' END"""
_SEVERITY = "CASE WHEN local_risk_score >= 5 THEN 'high' ELSE 'medium' END"
ALERTS_SQL = f"""
alerts AS (SELECT substr(sha256(kafka_topic || '|' || kafka_partition || '|' || kafka_offset), 1, 32) AS alert_id,
  {_ALERT_TYPE} AS alert_type, {_SEVERITY} AS severity, local_rule_tags AS reason, event_id, actor, message_text, local_rule_tags,
  local_risk_score AS local_risk_score_stream, kafka_topic, kafka_partition, kafka_offset, kafka_timestamp
FROM signals WHERE {_ALERT})"""


def _signals(spark, sf):
    return R.add_signals(comments(spark, sf), rules("s"), TEST_ACTORS)


@query("d11_is_alert", S.chain(S.COMMENTS, S.SIGNALS, final=f"SELECT event_id, {_ALERT} AS alert FROM signals"))
def d11(spark, sf):
    return _signals(spark, sf).select("event_id", R.is_alert().alias("alert"))


@query("d12_alert_type", S.chain(S.COMMENTS, S.SIGNALS, final=f"SELECT event_id, {_ALERT_TYPE} AS alert_type FROM signals"))
def d12(spark, sf):
    return _signals(spark, sf).select("event_id", R.alert_type().alias("alert_type"))


@query("d13_severity", S.chain(S.COMMENTS, S.SIGNALS, final=f"SELECT event_id, {_SEVERITY} AS severity FROM signals"))
def d13(spark, sf):
    return _signals(spark, sf).select("event_id", R.severity().alias("severity"))


@query("d14_alerts", S.chain(S.COMMENTS, S.SIGNALS, ALERTS_SQL, final="SELECT * FROM alerts"))
def d14(spark, sf):
    return R.alerts(_signals(spark, sf))


@query("e08_join_lexicon", S.chain(S.COMMENTS, _lexicon_values("v1"), _matched_sql("v1"), final="SELECT event_id, category, term FROM matched"))
def e08(spark, sf):
    lexicon = lexicon_frame(spark, rules("v1").lexicon, "v1")
    return T.match_lexicon(comments(spark, sf), "event_id", F.col("message_raw"), lexicon)


@query("f16_top_terms", S.chain(_lexicon_values("l"), _DOCS, _matched_sql("l", "docs", "doc_id"), """
counts AS (SELECT category, term, count(*) AS messages FROM matched GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY messages DESC, term) AS INTEGER) AS rank FROM counts)""",
       final="SELECT category, term, messages, rank FROM ranked WHERE rank <= 20"))
def f16(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", F.col("text").alias("message"))
    return T.top_terms(R.matched_terms(docs, rules("l"), key="doc_id"))
