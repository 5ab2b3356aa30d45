"""The multi-label rule engine: flags, risk score, tags, matched terms and alerts.

A short lexicon is intersected with a message's words once, and phrases are looked for only where their first words
stand. A long one is a pattern that follows the terms' common beginnings, of whole terms or of substrings,
so the cost per message hardly grows with the number of terms. The category flags are tests on the short hit list.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from murmullo.functions import noise, text
from murmullo.functions.actors import resolve_actor
from murmullo.functions.lexicon import CATEGORIES, NOISE_SHORTCODE, RuleProfile, fold_lexicon, profile
from murmullo.functions.scalars import minute_bucket

# Flag columns and the tag of each flag, in output order.
FLAG_COLUMNS = (
    "has_terruqueo",
    "has_fraude",
    "has_electoral_institution",
    "has_political_mention",
    "has_polarization_signal",
    "has_discriminatory_language",
    "has_ethnic_racial_slur",
    "has_homophobic_slur",
    "has_general_insult",
    "is_spam_noise",
)
TAGS = {
    "has_terruqueo": "terruqueo",
    "has_fraude": "fraude",
    "has_electoral_institution": "electoral_institution",
    "has_political_mention": "political_mention",
    "has_polarization_signal": "polarization",
    "has_ethnic_racial_slur": "ethnic_racial_slur",
    "has_homophobic_slur": "homophobic_slur",
    "has_general_insult": "general_insult",
    "is_spam_noise": "spam_noise",
}
# Points of each flag in the risk score.
SCORE_POINTS = {
    "has_terruqueo": 2,
    "has_fraude": 2,
    "has_discriminatory_language": 2,
    "has_homophobic_slur": 2,
    "has_political_mention": 1,
    "has_polarization_signal": 1,
}
STRONG_SCORE_FLAGS = ("has_terruqueo", "has_discriminatory_language", "has_homophobic_slur", "has_fraude")

_CATEGORY_FLAGS = {
    "terruqueo": "has_terruqueo",
    "fraude": "has_fraude",
    "electoral_institution": "has_electoral_institution",
    "political_mention": "has_political_mention",
    "ethnic_racial_slur": "has_ethnic_racial_slur",
    "homophobic_slur": "has_homophobic_slur",
    "general_insult": "has_general_insult",
}


def _strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def any_of(*conditions: Column) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result | condition
    return result


def _without_nulls(array: Column) -> Column:
    """Array without nulls; unlike a filter lambda this stays in generated code."""
    return F.array_except(array, F.array(F.lit(None).cast("string")))


# Lists of up to so many terms are probed as sets; a longer one is a pattern that follows common beginnings once, whose cost
# hardly grows with the list.
FEW = 256


def _common(array: Column, terms: list[str]) -> Column:
    """Distinct elements of a short array that are in a list of terms."""
    if len(terms) <= FEW:
        return F.array_intersect(array, _strings(terms))
    return F.array_distinct(F.filter(array, lambda x: x.rlike(f"^{text.whole_pattern(terms)}$")))


def _overlaps(array: Column, terms: list[str]) -> Column:
    """Whether a short array has an element in a list of terms."""
    if not terms:
        return F.lit(False)
    if len(terms) <= FEW:
        return F.arrays_overlap(array, _strings(terms))
    return F.exists(array, lambda x: x.rlike(f"^{text.whole_pattern(terms)}$"))


def _found_phrases(tokens: Column, phrases: list[str], heads: list[str]) -> Column:
    """Distinct phrases among the words: only places of a first word are looked at, once for each length of a phrase."""
    lengths = sorted({p.count(" ") + 1 for p in phrases})

    def search(words: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(heads))
        runs = F.flatten(F.transform(places, lambda i: F.array(*[F.array_join(F.slice(words, i + 1, F.lit(n)), " ") for n in lengths])))
        return F.array_distinct(F.filter(runs, lambda run: run.isin(phrases)))

    # the outer one-element transform makes the words once for all places
    return F.get(F.transform(F.array(tokens), search), F.lit(0))


def _layers(terms: Iterable[str]) -> list[list[str]]:
    """Terms in as few lists as it takes that no list has a term that another of its terms begins with, at a word's end."""
    known, depth = set(terms), {}
    for term in sorted(known, key=len):
        begins = [term[:i] for i in range(1, len(term)) if not (term[i].isalnum() or term[i] == "_") and term[:i] in known]
        depth[term] = 1 + max((depth[b] for b in begins), default=-1)
    return [sorted(t for t in known if depth[t] == d) for d in range(max(depth.values(), default=-1) + 1)]


def find_terms(normalized: Column, terms: Iterable[str]) -> Column:
    """Distinct whole terms of a folded term list that occur in a normalised text."""
    terms = tuple(dict.fromkeys(terms))
    if len(terms) > FEW:
        # in a layer at most one term starts at a place, so a look ahead from every place finds them all
        found = [F.regexp_extract_all(normalized, F.lit(rf"(?<!\w)(?=({text.whole_pattern(layer)})(?!\w))"), F.lit(1)) for layer in _layers(terms)]
        return F.array_distinct(F.concat(*found))
    words = [t for t in terms if " " not in t and ":" not in t]
    phrases = [t for t in terms if " " in t and ":" not in t]
    marked = [t for t in terms if ":" in t]
    # ':' bounds a word but does not join the words of a phrase: it becomes a word of its own
    tokens = F.split(F.replace(normalized, F.lit(":"), F.lit(" : ")), " ")
    hits = F.array_intersect(tokens, _strings(words))
    if phrases:
        heads = sorted({p.split(" ")[0] for p in phrases})
        hits = F.when(_overlaps(tokens, heads), F.concat(hits, _found_phrases(tokens, phrases, heads))).otherwise(hits)
    if marked:
        found = [F.when(normalized.rlike(rf"(?<!\w){term}(?!\w)"), F.lit(term)) for term in marked]
        hits = F.concat(hits, _without_nulls(F.array(*found)))
    return hits


def contains_term(normalized: Column, terms: Iterable[str]) -> Column:
    """Whether any whole term of a list occurs in a normalised text."""
    folded = fold_lexicon({"": tuple(terms)})[""]
    return F.size(find_terms(normalized, folded)) > 0


def _with_text(df: DataFrame, rules: RuleProfile) -> tuple[DataFrame, Column]:
    """Message columns as the profile wants them, and the text its flags are computed from."""
    if rules.text == "message":
        raw = F.col("message") if "message" in df.columns else F.col("message_raw")
        df = df.withColumns(
            {"message_raw": text.text_or_empty(raw), "message_clean": text.clean_text(raw)}
        )
        return df, F.col("message_raw")
    source = text.main_text(F.col("message_clean"), F.col("message_raw"), rules.text == "clean_non_empty")
    df = df.withColumns(
        {
            "_text": source,
            "message_clean": F.coalesce("message_clean", "message_raw", F.lit("")),
            "message_raw": F.coalesce("message_raw", F.lit("")),
        }
    )
    return df, F.col("_text")


def _normalize(source: Column, rules: RuleProfile) -> Column:
    if rules.squeeze == "stream":
        return text.norm_stream(source)
    return text.norm_text(source, rules.squeeze)


def _category_matches(df: DataFrame, rules: RuleProfile, categories: Iterable[str]) -> DataFrame:
    """One boolean ``_<category>`` per wanted lexicon category from ``text_norm``."""
    lexicon = {c: terms for c, terms in rules.lexicon.items() if c in categories}
    if rules.match == "substring":
        return df.withColumns({f"_{c}": text.contains_any(F.col("text_norm"), terms) for c, terms in lexicon.items()})
    folded = fold_lexicon(lexicon, rules.squeeze)
    every_term = [term for terms in folded.values() for term in terms]
    df = df.withColumn("_hits", find_terms(F.col("text_norm"), every_term))
    return df.withColumns(
        {
            f"_{c}": _overlaps(F.col("_hits"), list(terms))
            for c, terms in folded.items()
        }
    )


def compute_once(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Keep costly columns from being computed again above this point.

    Catalyst moves a filter below the projection that makes its columns and puts the whole
    expression in their place, once per mention. A one-row ``inline`` stands in the way: later
    filters and projections read plain columns. Filters on other columns still move below it.
    """
    names = list(columns)
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names))))


def _noise_flag(source: Column, rules: RuleProfile) -> Column:
    norm = F.col("text_norm")
    if rules.noise == "stream":
        return (text.message_length(norm, "utf16") <= rules.short_limit) | F.contains(norm, F.lit(NOISE_SHORTCODE))
    short = F.length(F.replace(norm, F.lit(" "), F.lit(""))) <= rules.short_limit
    if rules.noise == "unicode":
        return short | noise.is_symbol_only_unicode(source, norm) | noise.has_repetition(source, norm)
    if rules.noise == "short":
        return short | noise.is_laughter(norm, with_z=False)
    return short | noise.is_symbol_only(source) | noise.is_laughter(norm)


def risk_score(rules: str | RuleProfile = "v1") -> Column:
    """Weighted sum of the flags; noise without a strong flag costs a point where the profile says so."""
    rules = profile(rules)
    score = F.lit(0)
    for flag, points in SCORE_POINTS.items():
        score = score + F.col(flag).cast("int") * points
    if rules.insult_weight:
        score = score + F.col("has_general_insult").cast("int") * rules.insult_weight
    if rules.noise_penalty:
        weak = ~any_of(*[F.col(flag) for flag in STRONG_SCORE_FLAGS])
        score = score - (F.col("is_spam_noise") & weak).cast("int")
    return F.greatest(score, F.lit(0))


def rule_tags() -> Column:
    """'|'-joined names of the raised flags (the discriminatory flag is a union and has no tag)."""
    return F.concat_ws("|", *[F.when(F.col(flag), tag) for flag, tag in TAGS.items()])


_IMPLIED = ("terruqueo", "fraude", "general_insult", "ethnic_racial_slur", "homophobic_slur")


def _needed(columns: Iterable[str], rules: RuleProfile) -> tuple[set[str], set[str]]:
    """(rule columns, lexicon categories) that the wanted rule columns are made of."""
    wanted = set(columns)
    if "local_rule_tags" in wanted:
        wanted |= set(TAGS)
    if "local_risk_score" in wanted:
        wanted |= set(SCORE_POINTS)
        if rules.insult_weight:
            wanted.add("has_general_insult")
        if rules.noise_penalty:
            wanted |= {"is_spam_noise", *STRONG_SCORE_FLAGS}
    categories = {c for c, flag in _CATEGORY_FLAGS.items() if flag in wanted}
    if "has_discriminatory_language" in wanted:
        categories |= {"ethnic_racial_slur", "homophobic_slur"}
    if "has_polarization_signal" in wanted:
        categories |= {"political_mention", "polarization", *(_IMPLIED if rules.implied_polarization else ())}
    return wanted, categories


RULE_OUTPUT = ("text_norm", *FLAG_COLUMNS, "local_risk_score", "local_rule_tags")


def add_rules(df: DataFrame, rules: str | RuleProfile = "v1", with_terms: bool = False, columns: Iterable[str] = RULE_OUTPUT) -> DataFrame:
    """Add text_norm, the ten flags, local_risk_score, local_rule_tags and minute.

    A narrow transformation: no shuffle, no Python, rows in equal rows out. The same function
    serves static and streaming frames. ``with_terms`` keeps the matched terms as a column.
    ``columns`` names the rule columns that are wanted: only what they need is computed.
    """
    rules, columns = profile(rules), list(columns)
    wanted, categories = _needed(columns, rules)
    with_terms = with_terms and rules.match == "term"
    if with_terms:
        categories |= set(rules.lexicon)
    df, source = _with_text(df, rules)
    costly = [f"_{c}" for c in rules.lexicon if c in categories]
    if costly or "is_spam_noise" in wanted or "text_norm" in wanted:
        df = df.withColumn("text_norm", _normalize(source, rules))
        costly.append("text_norm")
    if categories:
        df = _category_matches(df, rules, categories)
    if "is_spam_noise" in wanted:
        df = df.withColumn("is_spam_noise", _noise_flag(source, rules))
        costly.append("is_spam_noise")
    if with_terms:
        df = df.withColumn("matched_terms", F.sort_array("_hits"))
        costly.append("matched_terms")
    if costly:
        df = compute_once(df.drop("_hits"), costly)
    flags = {flag: F.col(f"_{category}") for category, flag in _CATEGORY_FLAGS.items() if flag in wanted}
    if "has_discriminatory_language" in wanted:
        flags["has_discriminatory_language"] = F.col("_ethnic_racial_slur") | F.col("_homophobic_slur")
    if "has_polarization_signal" in wanted:
        charged = [F.col(f"_{c}") for c in ("polarization", *(_IMPLIED if rules.implied_polarization else ()))]
        flags["has_polarization_signal"] = F.col("_political_mention") & any_of(*charged)
    df = df.withColumns(flags) if flags else df
    if "local_risk_score" in wanted:
        df = df.withColumn("local_risk_score", risk_score(rules))
    if "local_rule_tags" in wanted:
        df = df.withColumn("local_rule_tags", rule_tags())
    df = df.drop(*[c for c in RULE_OUTPUT if c not in columns])
    if "video_offset_msec" in df.columns:
        df = df.withColumn("minute", minute_bucket(F.col("video_offset_msec")))
    return df.drop("_text", *[f"_{category}" for category in CATEGORIES])


def matched_terms(df: DataFrame, rules: str | RuleProfile = "l", key: str = "event_id") -> DataFrame:
    """(key, category, term) for every distinct lexicon term in every message."""
    rules = profile(rules)
    df, source = _with_text(df, rules)
    folded = fold_lexicon(rules.lexicon, rules.squeeze)
    every_term = [term for terms in folded.values() for term in terms]
    # the short hit list is probed again per category instead of the whole text
    normal = df.select(key, _normalize(source, rules).alias("_norm"))
    hits = compute_once(normal.select(key, find_terms(F.col("_norm"), every_term).alias("_hits")), ["_hits"])
    per_category = F.array(
        *[
            F.struct(F.lit(c).alias("category"), _common(F.col("_hits"), list(terms)).alias("terms"))
            for c, terms in folded.items()
        ]
    )
    return (
        hits.select(key, F.explode(per_category).alias("m"))
        .select(key, "m.category", F.explode("m.terms").alias("term"))
    )


# --- alerts -------------------------------------------------------------------------------------

# Severity bounds; below, the alert types named in ``alert_type`` and the columns of ``alerts``.
HIGH_SCORE = 4
SEVERE_SCORE = 5


def is_alert() -> Column:
    return (
        (F.col("has_terruqueo") & F.col("has_general_insult"))
        | (F.col("has_fraude") & F.col("has_electoral_institution"))
        | F.col("has_ethnic_racial_slur")
        | F.col("has_homophobic_slur")
        | (F.col("local_risk_score") >= HIGH_SCORE)
    )


def alert_type() -> Column:
    return (
        F.when(F.col("has_ethnic_racial_slur"), "ethnic_racial_discrimination")
        .when(F.col("has_homophobic_slur"), "homophobic_slur")
        .when(F.col("has_terruqueo") & F.col("has_general_insult"), "terruqueo_plus_insult")
        .when(F.col("has_fraude") & F.col("has_electoral_institution"), "fraude_plus_institution")
        .otherwise("high_local_risk")
    )


def severity() -> Column:
    return F.when(F.col("local_risk_score") >= SEVERE_SCORE, "high").otherwise("medium")


def alerts(signals: DataFrame) -> DataFrame:
    """Alert records of a signal frame (rules of profile s plus ``actor``).

    The id is a hash of the topic position, so a replay gives the same alerts.
    """
    return signals.where(is_alert()).select(
        F.substring(F.sha2(F.concat_ws("|", "kafka_topic", "kafka_partition", "kafka_offset"), 256), 1, 32).alias("alert_id"),
        alert_type().alias("alert_type"),
        severity().alias("severity"),
        F.col("local_rule_tags").alias("reason"),
        "event_id",
        "actor",
        F.col("message_text"),
        "local_rule_tags",
        F.col("local_risk_score").alias("local_risk_score_stream"),
        "kafka_topic",
        "kafka_partition",
        "kafka_offset",
        "kafka_timestamp",
    )


def add_signals(events: DataFrame, rules: str | RuleProfile = "s", actors=None, columns: Iterable[str] = RULE_OUTPUT) -> DataFrame:
    """Rules of the streaming profile (the wanted columns) plus the message text and its political actor."""
    rules = profile(rules)
    df = events.withColumn("message_text", text.main_text(F.col("message_clean"), F.col("message_raw")))
    df = add_rules(df, rules, columns=[*columns, "text_norm"])
    actor = resolve_actor(F.col("text_norm")) if actors is None else resolve_actor(F.col("text_norm"), actors)
    return compute_once(df.withColumn("actor", actor), ["actor"])
