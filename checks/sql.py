"""SQL text pieces for the oracles, written against the given tables only."""

from __future__ import annotations

from murmullo.functions.actors import ACTOR_ALIASES
from murmullo.functions.lexicon import CATEGORIES, RuleProfile, fold_lexicon

from checks.data import TEST_ACTORS, rules


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chain(*ctes: str, final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final


COMMENTS = """
numbered AS (
  SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations
),
comments0 AS (
  SELECT n, CAST(n AS VARCHAR) AS row_number, 'lake/chat.csv' AS source_s3_path, 'raw_youtube_chat' AS kafka_topic,
    CAST(conv_id % 3 AS INTEGER) AS kafka_partition,
    row_number() OVER (PARTITION BY conv_id % 3 ORDER BY n) - 1 AS kafka_offset,
    make_timestamp(1704067200000000 + n * 700000) AS kafka_timestamp,
    'chat [vid' || lpad(CAST(conv_id AS VARCHAR), 8, '0') || '].live_chat.json' AS source_file,
    'vid' || lpad(CAST(conv_id AS VARCHAR), 8, '0') AS video_id,
    CAST(turn * 20 // 60 AS VARCHAR) || ':' || lpad(CAST(turn * 20 % 60 AS VARCHAR), 2, '0') AS timestamp_text,
    CAST(1704067200000000 + n * 700000 AS VARCHAR) AS timestamp_usec,
    CASE WHEN role = 'system' THEN 'n/a' ELSE CAST(turn * 20000 AS VARCHAR) END AS video_offset_msec,
    CASE WHEN role <> 'system' THEN role || '_' || CAST(conv_id % 17 AS VARCHAR) END AS author,
    'ch' || CAST(conv_id % 41 AS VARCHAR) AS author_channel_id,
    text AS message_raw, text AS message_clean
  FROM numbered
),
comments AS (
  SELECT *, substr(sha256(source_s3_path || '|' || video_id || '|' || timestamp_usec || '|' || author_channel_id || '|' ||
    coalesce(author, '') || '|' || row_number), 1, 32) AS event_id
  FROM comments0
)"""

MINUTE = "CAST(floor(TRY_CAST(video_offset_msec AS DOUBLE) / 60000) AS BIGINT)"


def clean(x: str) -> str:
    no_url = f"regexp_replace(lower(coalesce({x}, '')), 'https?://\\S+|www\\.\\S+', ' ', 'g')"
    return f"trim(regexp_replace({no_url}, '\\s+', ' ', 'g'))"


def norm(x: str, squeeze: str | None = "vowels") -> str:
    """Normal form, step by step as documented (vowel runs one vowel at a time)."""
    if squeeze == "stream":
        return f"trim(regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g'))"
    if squeeze == "any":
        text = f"strip_accents({clean(x)})"
        for char in "abcdefghijklmnopqrstuvwxyz0123456789:_":
            text = f"regexp_replace({text}, '{char}{{3,}}', '{char}', 'g')"
    else:
        text = f"translate({clean(x)}, 'áéíóúüñ', 'aeiouun')"
        if squeeze == "vowels":
            for vowel in "aeiou":
                text = f"regexp_replace({text}, '{vowel}{{3,}}', '{vowel}', 'g')"
    text = f"regexp_replace({text}, '[^a-z0-9:_\\s]', ' ', 'g')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def utf16_length(x: str) -> str:
    return f"CAST(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS INTEGER)"


def whole_terms(x: str, terms) -> str:
    body = "|".join(r"\s+".join(t.split(" ")) for t in terms)
    return f"regexp_matches({x}, '(^|[^A-Za-z0-9_])({body})($|[^A-Za-z0-9_])')"


def substrings(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(' '.join(t.lower().split()))})" for t in terms) + ")"


def _noise(rule: RuleProfile) -> str:
    compact = "length(replace(text_norm, ' ', ''))"
    if rule.noise == "stream":
        return f"({utf16_length('text_norm')} <= {rule.short_limit} OR contains(text_norm, ':orange_heart:'))"
    short = f"{compact} <= {rule.short_limit}"
    laugh = "regexp_matches(text_norm, '((ja){5,}|(jaja){3,}|(xd){4,}"
    if rule.noise == "short":
        return f"({short} OR {laugh})'))"
    bare = "regexp_replace(rule_text, '[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]|\\s', '', 'g')"
    if rule.noise == "full":
        return f"({short} OR (length(trim(rule_text)) > 0 AND NOT regexp_matches({bare}, '[a-zA-Z0-9]')) OR {laugh}|(zzz){{3,}})'))"
    run = "len(list_filter(range(1, len(chars) - 4), lambda i: chars[i] = chars[i + 1] AND chars[i] = chars[i + 2] AND chars[i] = chars[i + 3] AND chars[i] = chars[i + 4] AND chars[i] = chars[i + 5])) > 0"
    triple = "len(list_filter(range(1, len(words) - 1), lambda i: words[i] = words[i + 1] AND words[i] = words[i + 2] AND words[i] NOT IN (':', ''))) > 0"
    only_codes = r"regexp_matches(trim(rule_text), '^:\S+:(\s+:\S+:)*$')"
    equal = "(len(string_split(text_norm, ' ')) >= 4 AND len(list_distinct(string_split(text_norm, ' '))) = 1)"
    symbols = f"(trim(rule_text) = '' OR {only_codes} OR ({bare} <> '' AND NOT regexp_matches({bare}, '[\\p{{L}}\\p{{N}}]')) OR (text_norm <> '' AND NOT regexp_matches(text_norm, '[a-z0-9]')))"
    return f"({short} OR {symbols} OR {run} OR {triple} OR {equal})"


FLAGS = (
    "has_terruqueo", "has_fraude", "has_electoral_institution", "has_political_mention", "has_polarization_signal",
    "has_discriminatory_language", "has_ethnic_racial_slur", "has_homophobic_slur", "has_general_insult", "is_spam_noise",
)


def rules_cte(name: str, source: str = "comments", out: str = "ruled") -> str:
    """CTEs that compute the rule columns of a profile by regular expressions."""
    rule = rules(name)
    text = {
        "message": "coalesce(message_raw, '')",
        "clean_first": "coalesce(message_clean, message_raw, '')",
        "clean_non_empty": "coalesce(nullif(message_clean, ''), nullif(message_raw, ''), '')",
    }[rule.text]
    lexicon = rule.lexicon if rule.match == "substring" else fold_lexicon(rule.lexicon)
    match = substrings if rule.match == "substring" else whole_terms
    cats = ", ".join(f"{match('text_norm', lexicon[c])} AS c_{c}" for c in CATEGORIES)
    lists = ""
    if rule.noise == "unicode":
        lists = f", string_split({clean('rule_text')}, '') AS chars, string_split(replace(text_norm, ':', ' : '), ' ') AS words"
    charged = "c_polarization"
    if rule.implied_polarization:
        charged = "(c_polarization OR c_terruqueo OR c_fraude OR c_general_insult OR c_ethnic_racial_slur OR c_homophobic_slur)"
    strong = "(has_terruqueo OR has_discriminatory_language OR has_homophobic_slur OR has_fraude)"
    score = (
        "(CASE WHEN has_terruqueo THEN 2 ELSE 0 END + CASE WHEN has_fraude THEN 2 ELSE 0 END"
        " + CASE WHEN has_discriminatory_language THEN 2 ELSE 0 END + CASE WHEN has_homophobic_slur THEN 2 ELSE 0 END"
        " + CASE WHEN has_political_mention THEN 1 ELSE 0 END + CASE WHEN has_polarization_signal THEN 1 ELSE 0 END"
    )
    if rule.insult_weight:
        score += " + CASE WHEN has_general_insult THEN 1 ELSE 0 END"
    if rule.noise_penalty:
        score += f" - CASE WHEN is_spam_noise AND NOT {strong} THEN 1 ELSE 0 END"
    score += ")"
    tag_names = {
        "has_terruqueo": "terruqueo", "has_fraude": "fraude", "has_electoral_institution": "electoral_institution",
        "has_political_mention": "political_mention", "has_polarization_signal": "polarization",
        "has_ethnic_racial_slur": "ethnic_racial_slur", "has_homophobic_slur": "homophobic_slur",
        "has_general_insult": "general_insult", "is_spam_noise": "spam_noise",
    }
    tags = "concat_ws('|', " + ", ".join(f"CASE WHEN {f} THEN '{t}' END" for f, t in tag_names.items()) + ")"
    return f"""
{out}_1 AS (SELECT *, {text} AS rule_text FROM {source}),
{out}_2 AS MATERIALIZED (SELECT *, {norm('rule_text', rule.squeeze)} AS text_norm FROM {out}_1),
{out}_3 AS MATERIALIZED (SELECT *, {cats}{lists} FROM {out}_2),
{out}_4 AS (SELECT *, c_terruqueo AS has_terruqueo, c_fraude AS has_fraude, c_electoral_institution AS has_electoral_institution,
  c_political_mention AS has_political_mention, c_political_mention AND {charged} AS has_polarization_signal,
  c_ethnic_racial_slur OR c_homophobic_slur AS has_discriminatory_language, c_ethnic_racial_slur AS has_ethnic_racial_slur,
  c_homophobic_slur AS has_homophobic_slur, c_general_insult AS has_general_insult, {_noise(rule)} AS is_spam_noise FROM {out}_3),
{out}_5 AS (SELECT *, CAST(greatest({score}, 0) AS INTEGER) AS local_risk_score FROM {out}_4),
{out} AS (SELECT *, {tags} AS local_rule_tags, {MINUTE} AS minute FROM {out}_5)"""


def case_first(cases: dict[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {lit(key)}" for key, cond in cases.items()) + f" ELSE {otherwise} END"


def actor(x: str, actors=TEST_ACTORS) -> str:
    return case_first({k: substrings(x, t) for k, t in actors.items()}, "''")


def canonical(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    return case_first({k: f"regexp_matches({low}, {lit(p)})" for k, p in ACTOR_ALIASES.items()}, f"regexp_replace({low}, '\\s+', '_', 'g')")


SIGNALS = rules_cte("s", out="sig0") + f""",
signals AS (SELECT *, {actor('text_norm')} AS actor, rule_text AS message_text FROM sig0)"""

PREDICTED = """
predicted0 AS (SELECT *, (n * 7919) % 1000 AS h FROM comments),
predicted AS (SELECT * EXCLUDE (h),
  CASE WHEN h % 50 <> 0 THEN CAST(h % 2 AS INTEGER) END AS pred_binary_sparkml,
  CASE WHEN h % 50 <> 0 THEN CAST(0.5 AS DOUBLE) + h / CAST(2000 AS DOUBLE) END AS confidence_binary_sparkml,
  CAST((n * 31) % 5 AS INTEGER) AS pred_multiclass_sparkml,
  (h % 100) / CAST(100 AS DOUBLE) AS confidence_multiclass_sparkml,
  CASE WHEN h % 50 = 0 THEN 'unknown' WHEN h % 2 = 1 THEN 'ofensivo' ELSE 'no_ofensivo' END AS pred_binary_sparkml_label,
  CASE (n * 31) % 5 WHEN 0 THEN 'ofensivo_directo' WHEN 1 THEN 'odio_agresion_grupal' WHEN 2 THEN 'neutral_no_ofensivo'
    WHEN 3 THEN 'vulgaridad_contextual' ELSE 'unknown' END AS pred_multiclass_sparkml_label
  FROM predicted0)"""


def bucket(c: str) -> str:
    return (
        f"CASE WHEN {c} >= 0.5 AND {c} < 0.6 THEN '0.50-0.60' WHEN {c} >= 0.6 AND {c} < 0.7 THEN '0.60-0.70'"
        f" WHEN {c} >= 0.7 AND {c} < 0.8 THEN '0.70-0.80' WHEN {c} >= 0.8 AND {c} < 0.9 THEN '0.80-0.90'"
        f" WHEN {c} >= 0.9 AND {c} <= 1.0 THEN '0.90-1.00' ELSE 'out_of_range' END"
    )


def scored_cte(profile: str, source: str = "ruled_p", out: str = "scored") -> str:
    """Hybrid columns over rules with predictions."""
    p, c, s = "p", "c", "local_risk_score"
    strong = "has_terruqueo OR has_fraude OR has_polarization_signal OR has_discriminatory_language OR has_general_insult"
    any_rule = " OR ".join(FLAGS)
    default = ("coalesce({}, 0)" if profile == "k" else "{}").format
    offensive = "(p = 1 AND c >= 0.60)"
    if profile == "k":
        reasons = {
            "ML ofensivo alta confianza + reglas locales fuertes": "hi AND strong",
            "Reglas locales muy fuertes": f"{s} >= 5",
            "ML ofensivo + reglas locales": f"{offensive} AND anyr",
            "ML ofensivo sin evidencia local fuerte; revisar": offensive,
            "Reglas locales activas": f"{s} >= 2",
        }
    else:
        reasons = {
            "ML ofensivo alta confianza + reglas locales fuertes": "hi AND strong",
            "ML ofensivo alta confianza sin reglas locales; revisar posible ofensividad general OffendES": "hi AND NOT anyr",
            "ML ofensivo baja/media confianza sin reglas; no tomar como final": "p = 1 AND c < 0.70 AND NOT anyr",
            "Modelo no ofensivo pero reglas locales elevadas; contexto peruano relevante": f"p = 0 AND {s} >= 3",
            "Reglas locales activas": f"{s} >= 2",
            "ML ofensivo sin evidencia local fuerte": "p = 1",
        }
    return f"""
{out}_1 AS (SELECT *, {default('pred_binary_sparkml')} AS p, {default('confidence_binary_sparkml')} AS c,
  ({any_rule}) AS anyr, ({strong}) AS strong FROM {source}),
{out}_2 AS MATERIALIZED (SELECT *, (p = 1 AND c >= 0.70) AS hi FROM {out}_1),
{out} AS (SELECT * EXCLUDE (pred_binary_sparkml, confidence_binary_sparkml, p, c), p AS pred_binary_sparkml, c AS confidence_binary_sparkml,
  anyr AS has_any_local_rule, strong AS has_strong_local_rule, hi AS ml_offensive_high_confidence, {bucket('c')} AS confidence_binary_bucket,
  CASE WHEN (hi AND strong) OR {s} >= 5 THEN 'alto' WHEN {offensive} OR {s} >= 2 THEN 'medio' ELSE 'bajo' END AS hybrid_risk_level,
  {case_first(reasons, lit('Bajo riesgo hibrido'))} AS hybrid_risk_reason FROM {out}_2)"""


def scored(profile: str = "k") -> tuple[str, str, str, str]:
    return COMMENTS, PREDICTED, rules_cte("k" if profile == "k" else "v1", source="predicted", out="ruled_p"), scored_cte(profile)


CORPUS = """
corpus AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS comment_id, d.text AS comment, d.lang AS media, d.source AS influencer,
    CAST((1 - l.toxic) * 2 + (1 - l.quality) AS BIGINT) AS label, d.doc_id AS doc_id,
    CASE WHEN d.doc_id % 10 < 8 THEN 'train' WHEN d.doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split
  FROM documents d JOIN labels l USING (doc_id)
)"""


# Canonical actor of an alias, by hand: first match wins, others become lower case with underscores.
CANONICAL_ACTOR = r"""CASE WHEN regexp_matches(lower(actor), 'keiko|fujimori') THEN 'keiko_fujimori_fp'
  WHEN regexp_matches(lower(actor), 'onpe|jne') THEN 'onpe_jne'
  WHEN regexp_matches(lower(actor), 'castillo|peru libre') THEN 'castillo_peru_libre'
  WHEN regexp_matches(lower(actor), 'juntos|^jp$|jp_') THEN 'jp_juntos_por_el_peru'
  WHEN regexp_matches(lower(actor), 'porky|aliaga|rla') THEN 'lopez_aliaga_porky'
  WHEN contains(lower(actor), 'antauro') THEN 'antauro_humala'
  ELSE regexp_replace(lower(actor), '\s+', '_', 'g') END"""
