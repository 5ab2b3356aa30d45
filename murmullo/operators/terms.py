"""Terms as tables: the words of a text joined with a lexicon of any size, and term rankings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from murmullo.functions.text import norm_text


LEAST_BITS, MOST_BITS = 12, 22  # of the first-word filter, as powers of two


def _bit(word: Column, bits: int) -> Column:
    return F.xxhash64(word).bitwiseAND((1 << bits) - 1)


def first_word_filter(lexicon: DataFrame) -> tuple[int, int, Callable[[Column], Column]]:
    """(bits, words of the longest term, filter): a test that is true of every word that starts a term of a (category, term) table.

    The filter is a bitmap of the first words' hashes, at most 2^22 bits whatever the lexicon's size; it is right about
    all first words and lets some others through, fewer than 1 in 30 up to 130,000 first words.
    """
    heads = lexicon.select(F.substring_index("term", " ", 1).alias("head"), (F.size(F.split("term", " "))).alias("n"))
    count, longest = heads.agg(F.approx_count_distinct("head"), F.max("n")).first()
    bits = min(max(LEAST_BITS, (32 * count).bit_length()), MOST_BITS)
    at = _bit(F.col("head"), bits)
    lots = heads.select(F.shiftright(at, 6).alias("lot"), F.expr("1L").alias("one"), at.bitwiseAND(63).cast("int").alias("place"))
    rows = lots.groupBy("lot").agg(F.bit_or(F.expr("shiftleft(one, place)")).alias("word")).collect()  # 65,536 rows at most
    words = [0] * (1 << bits - 6)
    for row in rows:
        words[row.lot] = row.word
    table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    return bits, longest or 1, lambda word: F.getbit(F.get(table, F.shiftright(_bit(word, bits), 6).cast("int")), _bit(word, bits).bitwiseAND(63).cast("int")) == 1


def explode_words(df: DataFrame, key: str, text: Column, longest: int = 1, squeeze: str | None = "vowels", starts=None) -> DataFrame:
    """(key, word, phrase) for the words of the normalised text.

    ``phrase`` is the word and its next ``longest`` - 1 neighbours, closed by a blank; ':' is a word
    that no term contains. ``starts`` is a test of words: only those that pass it are emitted, and phrases are
    made for them alone.
    """
    spaced = F.replace(norm_text(text, squeeze), F.lit(":"), F.lit(" : "))
    words = df.select(key, F.array_remove(F.split(spaced, " "), "").alias("_w"))

    def found(w: Column) -> Column:
        places = F.slice(F.sequence(F.lit(0), F.size(w)), F.lit(1), F.size(w))
        if starts is not None:
            places = F.filter(places, lambda i: starts(F.get(w, i)))
        return F.transform(places, lambda i: F.struct(
            F.get(w, i).alias("word"), F.concat(F.array_join(F.slice(w, i + 1, F.lit(longest)), " "), F.lit(" ")).alias("phrase")))

    # the outer one-element transform makes the words once for all places
    return words.select(key, F.inline(F.get(F.transform(F.array("_w"), found), F.lit(0))))


def match_lexicon(df: DataFrame, key: str, text: Column, lexicon: DataFrame, squeeze: str | None = "vowels") -> DataFrame:
    """Distinct (key, category, term) for the terms of a (category, term) table of any size in the normalised text."""
    _, longest, starts = first_word_filter(lexicon)
    return join_lexicon(explode_words(df, key, text, longest, squeeze, starts), lexicon, key)


def join_lexicon(words: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """Distinct (key, category, term) for the terms of a (category, term) table found in exploded words.

    An equality join on a term's first word, then a check of the whole term. Spark picks the join by
    the lexicon's measured size, and AQE splits a frequent word.
    """
    table = lexicon.select("category", "term").distinct().withColumn("word", F.substring_index("term", " ", 1))
    found = words.join(table, "word", "inner").where(
        F.startswith("phrase", F.concat("term", F.lit(" ")))
    )
    return found.select(key, "category", "term").distinct()


def term_counts(matched: DataFrame) -> DataFrame:
    """Messages per (category, term)."""
    return matched.groupBy("category", "term").agg(F.count(F.lit(1)).alias("messages"))


def top_terms(matched: DataFrame, k: int = 20) -> DataFrame:
    """Most frequent terms of each category, ties by term."""
    ranked = term_counts(matched).withColumn(
        "rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("messages"), "term"))
    )
    return ranked.where(F.col("rank") <= k)
