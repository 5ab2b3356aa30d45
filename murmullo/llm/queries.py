"""Registered queries of the operators, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from murmullo.llm import crf, descent, fim, lines, mixing, packing, pieces, prefix_trie, quality_rules, secrets, simhash, token_counts, warc
from murmullo.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_quality_rules(spark, sf):
    return quality_rules.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op2_secret_scan(spark, sf):
    return secrets.find_secrets(table(spark, sf, "documents"))


def _secret_sql() -> str:
    """Places of all matches from the pieces between them: a match starts after all pieces and matches before it."""
    parts = []
    for k, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, {rule.base} AS base, m[i] AS found,
  list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM documents))
  WHERE length(regexp_extract(m[i], '{pattern}', {rule.group})) >= {rule.least}""")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)
    return f"""
WITH f AS ({" UNION ALL ".join(parts)}),
t AS (SELECT *, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(found) AS BIGINT) AS span FROM f),
g AS (SELECT doc_id, {counts}, count(*) AS n_spans, string_agg(span, ',' ORDER BY s, k) FILTER (WHERE base) AS base, string_agg(span, ',' ORDER BY s, k) AS spans FROM t GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE_RULES)}, coalesce(n_spans, 0) AS n_spans,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN g USING (doc_id)"""


ORACLES["op2_secret_scan"] = _secret_sql()


# Target weights of the mix: by level and name; what is not named weighs 1.
MIX_WEIGHTS = {
    "domain": {"d0": 3, "d1": 2, "d2": 2, "d3": 1},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 2},
    "source": {"src0": 2},
}


@query
def op7_source_mix(spark, sf):
    return mixing.select_mix(table(spark, sf, "documents"), MIX_WEIGHTS, share=1.0, epochs=2)


def _mix_split(name: str, parent: str, source: str) -> str:
    """Budgets of the children of each parent in a table with budget, weight and capacity."""
    over = f"PARTITION BY {parent} ORDER BY ratio, {name}"
    return f"""
{name}_1 AS (SELECT * REPLACE (greatest(weight, 0) AS weight), CASE WHEN weight > 0 THEN capacity / weight ELSE 0 END AS ratio FROM {source}),
{name}_2 AS (SELECT *, (budget - coalesce(sum(capacity) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / nullif(sum(weight) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level FROM {name}_1),
{name}_3 AS (SELECT *, row_number() OVER (PARTITION BY {parent}, level <= ratio ORDER BY ratio, {name}) AS place FROM {name}_2),
{name}_4 AS (SELECT * EXCLUDE (level), max(CASE WHEN level <= ratio AND place = 1 THEN level END) OVER (PARTITION BY {parent}) AS level FROM {name}_3),
{name}_b AS (SELECT * EXCLUDE (budget), CASE WHEN level IS NULL THEN capacity::DOUBLE ELSE least(capacity::DOUBLE, level * weight) END AS budget FROM {name}_4)"""


def _mix_weight(weights: dict, level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in weights.get(level, {"": 1}).items()) + " ELSE 1.0 END::DOUBLE"


def mix_sql(weights: dict) -> str:
    """Rows of the mix with all tokens given out and two epochs at most."""
    usable = " AND ".join(f"{_mix_weight(weights, level)} > 0" for level in ("domain", "lang", "source"))
    return rf"""
WITH d AS (SELECT doc_id, 'd' || coalesce(CAST(TRY_CAST(regexp_extract(source, '(\d+)', 1) AS BIGINT) % 4 AS VARCHAR), '') AS domain, coalesce(lang, '') AS lang,
  coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens, substr(md5('7:' || doc_id), 1, 3) AS bin FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(CASE WHEN {usable} THEN 2 * sum(n_tokens) ELSE 0 END AS BIGINT) AS capacity FROM d GROUP BY domain, lang, source),
top AS (SELECT domain, sum(capacity) AS capacity, {_mix_weight(weights, "domain")} AS weight, (SELECT sum(tokens) FROM leaf)::DOUBLE AS budget FROM leaf GROUP BY domain),
{_mix_split("domain", "1", "top")},
mid AS (SELECT l.domain, lang, sum(l.capacity) AS capacity, {_mix_weight(weights, "lang")} AS weight, any_value(b.budget) AS budget FROM leaf l JOIN domain_b b USING (domain) GROUP BY l.domain, lang),
{_mix_split("lang", "domain", "mid")},
low AS (SELECT l.domain, l.lang, source, tokens, l.capacity, {_mix_weight(weights, "source")} AS weight, b.budget FROM leaf l JOIN lang_b b ON l.domain = b.domain AND l.lang = b.lang),
{_mix_split("source", "domain, lang", "low")},
plan AS (SELECT domain, lang, source, budget, CASE WHEN tokens > 0 THEN CAST(floor(budget / tokens) AS BIGINT) ELSE 0 END AS whole, tokens FROM source_b),
bins AS (SELECT domain, lang, source, bin, sum(n_tokens) AS n, any_value(whole) AS whole FROM d JOIN plan USING (domain, lang, source) GROUP BY ALL),
starts AS (SELECT domain, lang, source, bin, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5('7:' || whole || ':' || bin), bin
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM bins),
rows AS (SELECT d.*, whole, budget, budget - whole * tokens AS rest, start + coalesce(sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source, d.bin
  ORDER BY md5('7:' || whole || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN plan USING (domain, lang, source) JOIN starts USING (domain, lang, source, bin)),
taken AS (SELECT *, n_tokens > 0 AND before < rest AS last_epoch FROM rows)
SELECT doc_id, domain, lang, source, n_tokens, budget AS leaf_budget, CAST(CASE WHEN n_tokens > 0 THEN whole ELSE 0 END + last_epoch::BIGINT AS BIGINT) AS copies, last_epoch
FROM taken WHERE CASE WHEN n_tokens > 0 THEN whole ELSE 0 END + last_epoch::BIGINT > 0
"""


ORACLES["op7_source_mix"] = mix_sql(MIX_WEIGHTS)


@query
def op6_simhash(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op5_warc(spark, sf):
    captures = warc.archive(table(spark, sf, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


ORACLES["op5_warc"] = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d),
u AS (SELECT *, regexp_extract(url, '^https?://([^/?#:]*)', 1) AS host, regexp_extract(url, '^https?://[^/]*([^#]*)', 1) AS path FROM r)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to,
       array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END AS url_key,
       strftime(TIMESTAMP '2020-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM u
"""


@query
def op4_quality_classifier(spark, sf):
    return crf.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op3_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


@query
def op8_embedding_descent(spark, sf):
    return descent.near_duplicates(table(spark, sf, "embeddings"))


# All pairs: for the small scales this SQL is run on.
ORACLES["op8_embedding_descent"] = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS s, vec_id AS t FROM embeddings UNION SELECT r.s, l.b FROM r JOIN l ON r.t = l.a),
c AS (SELECT s AS vec_id, min(t) AS component_id FROM r GROUP BY s)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""


@query
def op10_merge_dropout(spark, sf):
    return pieces.encode_documents(table(spark, sf, "documents"))


@query
def op9_line_dedup(spark, sf):
    return lines.report(table(spark, sf, "documents"))


@query
def op11_token_counts(spark, sf):
    return token_counts.count_tokens(table(spark, sf, "documents"))


@query
def op13_fill_in_middle(spark, sf):
    made = fim.transform(table(spark, sf, "documents"))
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLES["op13_fill_in_middle"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""


@query
def op12_prefix_trie(spark, sf):
    return prefix_trie.prefix_trie(table(spark, sf, "conversations"))


# Every node by its prefix, every subtree by the prefixes of its nodes; the checksum is stated bit by bit.
ORACLES["op12_prefix_trie"] = r"""
WITH o AS (SELECT conv_id, list(sha256(length(r) || ':' || r || t) ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || t)) AS own,
  list(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || t)) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
h AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 4 AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h], h.own[h + 1:len(h.own)]) AS path, list_concat(coalesce(b.words, [])[1:h], h.words[h + 1:len(h.words)]) AS words
  FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, d, len(path) AS size, sha256(array_to_string(path[1:d], ',')) AS prefix, CASE WHEN d > 0 THEN sha256(array_to_string(path[1:d - 1], ',')) END AS above,
  CASE WHEN d > 0 THEN words[d] ELSE 0 END AS last_words FROM r, unnest(range(0, len(path) + 1)) AS u(d)),
n AS (SELECT d, prefix, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(last_words) AS own_saved,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = d), '') AS ends FROM p GROUP BY d, prefix),
k AS (SELECT a.d, a.prefix, count(b.prefix) AS n_children FROM n a LEFT JOIN n b ON b.d = a.d + 1 AND b.above = a.prefix GROUP BY a.d, a.prefix),
s AS (SELECT p.d, p.prefix, sum(n.own_saved) AS saved_tokens, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves
  FROM n JOIN k USING (d, prefix) JOIN p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY p.d, p.prefix)
SELECT n.conv_id, n.d AS depth, m.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN k USING (d, prefix) JOIN s USING (d, prefix) LEFT JOIN n m ON m.d = n.d - 1 AND m.prefix = n.above
"""
