"""Quality rules and a hashed n-gram log-likelihood ratio. DataFrame operations only.

N-grams are pairs of neighbouring words, each by its last three characters (which carry inflection,
punctuation and mark-up), hashed into ``buckets``. One pass over all documents counts the buckets of the
raw corpus and, of all trusted documents (labelled good), those of the target. Both are smoothed to
multinomials; a document's score is the sum of log(target / raw) over its n-grams, divided by their number, and a document is kept when no base rule rejects it and its score reaches ``threshold``.

To learn which documents are trusted, their bucket ids (two bytes an n-gram) are joined with the ids; no text is shuffled.
The counts shrink to one row per bucket and task before they are shuffled. The weights come back as one
array of ``buckets`` doubles, a scalar, so scoring moves no row and needs no join.

Defined cases: a null text has no words; a document without words fails the base rules and scores 0; a
null id is scored but can't be trusted; repeated rows count as often as they occur; without any trusted
document all weights are 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from murmullo.llm.common import quoted, words

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\f\r"
WINDOW = 5
ENDING = 3


def word_codes(word_list: Column) -> Column:
    """A long for each word: 48 bits of the word's hash, then 16 bits of the hash of its last three characters."""
    return F.transform(word_list, lambda w: F.xxhash64(w).bitwiseAND(F.lit(~0xFFFF)).bitwiseOR(
        F.xxhash64(F.substring(w, -ENDING, ENDING)).bitwiseAND(F.lit(0xFFFF))))


def bucket_ids(codes: str, buckets: int) -> Column:
    """Buckets of the n-grams: pairs of the endings of neighbouring words (of the last word: with none)."""
    ending = lambda c: c.bitwiseAND(F.lit(0xFFFF))
    return F.transform(codes, lambda c, i: F.pmod(F.xxhash64(ending(c), ending(F.get(codes, i + 1))), F.lit(buckets)).cast("int"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def bucket_weights(documents: DataFrame, labels: DataFrame, buckets: int, smoothing: float) -> DataFrame:
    """One row with ``weights``: log ratio of target and raw probability of each bucket, in order."""
    if buckets > 1 << 15:
        raise ValueError("bucket ids are two signed bytes: at most 32,768 buckets")
    trusted = trusted_ids(labels).select(F.col("doc_id").alias("trusted_id"))
    narrow = documents.select("doc_id", word_codes(words(F.col("text"))).alias("h")).select("doc_id", bucket_ids("h", buckets).cast("array<smallint>").alias("b"))
    # two bytes an n-gram meet the trusted ids, not the texts, and by the same join at every size; rows without an id need no join
    known = narrow.where("doc_id is not null").join(trusted.hint("merge"), F.col("doc_id") == F.col("trusted_id"), "left")
    rows = known.select(F.col("trusted_id").isNotNull().cast("long").alias("good"), "b").union(narrow.where("doc_id is null").select(F.lit(0).cast("long"), "b"))
    counts = (
        # an outer explode: of a plain one Spark would infer a filter on the ids' number and compute them again below the join
        rows.select("good", F.explode_outer("b").alias("id")).where("id is not null")
        .groupBy(F.col("id").cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target"))
    )
    every = documents.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    one = filled.agg(
        F.array_sort(F.collect_list(F.struct("bucket", "target", "raw"))).alias("all"), F.sum("target").alias("n_target"), F.sum("raw").alias("n_raw"),
    )
    ratio = lambda x: (
        F.log((x["target"] + F.lit(smoothing)) / (F.col("n_target") + F.lit(smoothing * buckets)))
        - F.log((x["raw"] + F.lit(smoothing)) / (F.col("n_raw") + F.lit(smoothing * buckets)))
    )
    return one.select(F.when(F.col("n_target") > 0, F.transform("all", ratio)).otherwise(F.transform("all", lambda x: F.lit(0.0))).alias("weights"))


def base_counts(documents: DataFrame) -> DataFrame:
    """The given frame with ``h`` (word codes) and the base counts of its column ``text``."""
    text = F.coalesce("text", F.lit(""))
    word = lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0
    counted = (
        documents.withColumn("w", words(F.col("text")))
        .withColumn("lines", F.filter(F.split(text, "\n", -1), word))
        .withColumn("h", word_codes(F.col("w")))
        .withColumn("n_words", F.size("w").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("w", "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .drop("w", "lines")
    )
    hashes = F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))
    windows = counted.withColumn("v", F.when(F.col("n_words") >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    # places of windows that occur twice or more, in order; looked for only in texts that have some
    ordered = F.array_sort(F.transform("v", lambda x, i: F.struct(x.alias("v"), i.alias("i"))))
    found = windows.withColumn("s", F.when(F.size(F.array_distinct("v")) < F.size("v"), ordered))
    same = lambda x, i: F.coalesce(F.get("s", i)["v"] == x["v"], F.lit(False))
    placed = found.withColumn("p", F.sort_array(F.transform(F.filter("s", lambda x, i: same(x, i + 1) | same(x, i - 1)), lambda x: x["i"])))
    reach = F.transform("p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("p", i + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)
    return placed.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("v", "s", "p")


def judge(
    documents: DataFrame,
    labels: DataFrame,
    buckets: int = 1 << 14,
    smoothing: float = 1.0,
    threshold: float = -0.12,
    keep: list[str] | None = None,
) -> DataFrame:
    """Every document with its counts, ``n_grams``, ``llr`` (per n-gram), ``base_failed`` and ``kept``.

    labels: doc_id and quality; all good ones make the target. keep: columns of the
    documents to carry along.
    """
    carried = {c: f"kept_{i}" for i, c in enumerate(keep or [])}
    narrow = documents.select("doc_id", "text", *[quoted(c).alias(v) for c, v in carried.items()])
    weights = bucket_weights(documents.select("doc_id", "text"), labels, buckets, smoothing)
    counted = base_counts(narrow).withColumn("b", bucket_ids("h", buckets)).withColumn("weights", weights.scalar())
    scored = counted.withColumn("n_grams", F.size("b").cast("long")).withColumn(
        "llr", F.coalesce(F.aggregate("b", F.lit(0.0), lambda a, x: a + F.get("weights", x)) / F.nullif(F.col("n_grams"), F.lit(0)), F.lit(0.0)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_grams", "llr", "base_failed", "kept"]
    judged = scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    # made as one row of an array: a filter on a result column is then tested on its value, not pushed below and computed again
    once = F.inline(F.array(F.struct(*[c for c in columns if c not in (keep or [])])))
    return judged.select(*([F.col(v).alias(c) for c, v in carried.items()] or ["doc_id"]), once)
