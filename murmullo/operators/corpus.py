"""The labelled corpus: preparation, label enrichment, TF-IDF table, corpus profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from murmullo.functions.scalars import OFFENSIVE_LABELS, MULTICLASS_LABELS
from murmullo.functions.text import clean_text, norm_text, text_or_empty
from murmullo.operators.joins import _strict
from murmullo.session import materialize
from murmullo.operators.rules import compute_once

# Neutral label and names of the alternative binary mapping, fallback stop words, and the columns ``prepare_corpus`` makes.
NEUTRAL_LABEL = 2
ALTERNATIVE_NAMES = ("no_ofensivo", "ofensivo_o_toxico")
FALLBACK_STOP_WORDS = (
    "de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no",
    "una", "su", "al", "lo", "es", "como", "mas", "pero", "sus", "le", "ya", "o",
)


def drop_empty(df: DataFrame, text: str = "text_clean") -> DataFrame:
    return df.where(F.length(text) > 0)


def prepare_corpus(df: DataFrame) -> DataFrame:
    """Label as double, binary label, raw and clean text; rows without text are dropped."""
    prepared = df.withColumns(
        {
            "label_original": F.col("label").cast("double"),
            "label_binary": F.coalesce(F.col("label").isin(*OFFENSIVE_LABELS), F.lit(False)).cast("double"),
            "text_raw": text_or_empty(F.col("comment")),
            "text_clean": clean_text(F.col("comment")),
        }
    )
    return drop_empty(compute_once(prepared, ["text_clean"]))


def enrich_labels(df: DataFrame) -> DataFrame:
    """Label name and the alternative binary mapping (everything but neutral is 1); unknown labels fail."""
    flag = (F.col("label") != NEUTRAL_LABEL).cast("int")
    return df.withColumns(
        {
            "label_name": _strict("label", F.col("label").cast("int"), MULTICLASS_LABELS),
            "label_binary": flag,
            "label_binary_name": F.when(flag == 0, ALTERNATIVE_NAMES[0]).otherwise(ALTERNATIVE_NAMES[1]),
        }
    )


def split_distribution(splits: dict[str, DataFrame], col: str) -> DataFrame:
    """Rows per value of a column in each split, in one job."""
    tagged = None
    for name, df in splits.items():
        part = df.select(F.lit(name).alias("split"), F.col(col).alias("value"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("split", "value").agg(F.count(F.lit(1)).alias("count"))


def is_token(word: Column, stop_words: Sequence[str], shortest: int = 2) -> Column:
    """Long enough and no stop word."""
    return (F.length(word) >= shortest) & ~word.isin(*stop_words)


def tfidf_table(corpus: DataFrame, stop_words: Sequence[str] = FALLBACK_STOP_WORDS) -> DataFrame:
    """(token, tf, df, idf) over a prepared corpus, idf = ln((n + 1) / (df + 1)).

    Each row gives all its words (for tf) followed by its distinct words (for df), told apart by
    position. One aggregation with partial sums counts both, so the shuffle moves one row per task
    and token, and the whole pipeline stays in generated code.
    """
    n = corpus.agg(F.count(F.lit(1)).alias("n")).scalar()
    words = corpus.select(F.split("text_clean", r"\W+").alias("_w"))
    # the size is a column of its own, so that the exploded rows do not carry the array along
    sized = compute_once(words.withColumn("_n", F.size("_w")), ["_w", "_n"])
    rows = sized.select("_n", F.posexplode(F.concat("_w", F.array_distinct("_w"))).alias("_pos", "token"))
    is_use = F.col("_pos") < F.col("_n")
    counts = rows.where(is_token(F.col("token"), stop_words)).groupBy("token").agg(
        F.count_if(is_use).alias("tf"), F.count_if(~is_use).alias("df")
    )
    return counts.withColumn("idf", F.log((n + 1).cast("double") / (F.col("df") + 1)))


# --- historical profile ---------------------------------------------------------------------------


BUCKETS = 1 << 16


def heavy_hitters(values: DataFrame, k: int, value: str = "value", buckets: int = BUCKETS) -> DataFrame:
    """The k most frequent values with their ``uses``, ties by value: exact, without counting most values one by one.

    Values are counted by hash bucket first; no value is more frequent than its bucket. The values of the fullest buckets are counted
    exactly, and any further bucket that is at least as full as the k-th of these could still hold one of the k, so such buckets
    are counted too. What is shuffled is a row per bucket and task, and the values of those few buckets.
    """
    bucketed = values.where(F.col(value).isNotNull()).withColumn("_bucket", F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int"))
    full = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_bucket").collect()  # a row a bucket at most

    def counted(chosen: list[int]) -> DataFrame:
        return bucketed.where(F.col("_bucket").isin(chosen)).groupBy(value).agg(F.count(F.lit(1)).alias("uses"))

    chosen = [r["_bucket"] for r in full[:4 * k]]
    best = materialize(counted(chosen).orderBy(F.desc("uses"), value).limit(k), "heavy")
    rest = full[4 * k:]
    n, least = best.agg(F.count(F.lit(1)), F.min("uses")).first()
    more = [r["_bucket"] for r in rest if n < k or r["n"] >= least]
    found = best.unionByName(counted(more)) if more else best
    return found.orderBy(F.desc("uses"), value).limit(k)


def top_words(df: DataFrame, text: Column, k: int = 20, stop_words: Sequence[str] = (), only: Sequence[str] | None = None) -> DataFrame:
    """Most used words; ``only`` restricts to a given vocabulary (for instance political terms)."""
    words = F.filter(F.split(norm_text(text), r"[ :]+"), lambda w: F.length(w) >= 2)
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    if only is not None:
        words = F.filter(words, lambda w: w.isin(*only))
    # an outer explode: of a plain one Spark would infer a filter on the words' number and make them twice
    rows = df.select(F.explode_outer(words).alias("word"))
    if only is not None:  # few values: one pass
        counts = rows.where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
        return counts.orderBy(F.desc("uses"), "word").limit(k)
    return heavy_hitters(rows, k, "word")


def top_hashtags(df: DataFrame, text: Column, k: int = 20) -> DataFrame:
    tags = F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(r"#([\p{L}\p{N}_]+)"), 1)
    return heavy_hitters(df.select(F.explode_outer(tags).alias("hashtag")), k, "hashtag")


def comments_per_video(df: DataFrame) -> DataFrame:
    return df.groupBy("video_id").agg(F.count(F.lit(1)).alias("comments"))


def repetitive_authors(df: DataFrame, text: Column, k: int = 20) -> DataFrame:
    """Authors by the number of messages that repeat one of their earlier messages.

    Counting per (author, message) first merges the copies map-side.
    """
    copies = df.groupBy("author", text.alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    per_author = copies.groupBy("author").agg(
        F.sum("_n").alias("messages"), F.sum(F.col("_n") - 1).alias("repeats")
    )
    return per_author.orderBy(F.desc("repeats"), F.desc("messages"), "author").limit(k)
