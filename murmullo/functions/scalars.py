"""Small scalar helpers: minute buckets, confidence buckets, labels, percentages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, functions as F

# Label names and confidence ranges.
MULTICLASS_LABELS = {
    0: "ofensivo_directo",
    1: "odio_agresion_grupal",
    2: "neutral_no_ofensivo",
    3: "vulgaridad_contextual",
}
BINARY_LABELS = {0: "no_ofensivo", 1: "ofensivo"}
OFFENSIVE_LABELS = (0, 1)
CONFIDENCE_EDGES = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
OUT_OF_RANGE = "out_of_range"

MINUTE_MSEC = 60000


def minute_bucket(offset_msec: Column) -> Column:
    """Whole minutes of a millisecond offset; null when the offset is not a number."""
    return F.floor(offset_msec.try_cast("double") / MINUTE_MSEC).cast("long")


def clock_seconds(text: Column) -> Column:
    """Seconds of a ``[-][h:]mm:ss`` text, null when it has another form."""
    clean = F.trim(text.cast("string"))
    parts = F.split(F.regexp_replace(clean, "^-", ""), ":")
    seconds = F.aggregate(
        parts, F.lit(0).cast("long"), lambda total, part: total * 60 + part.try_cast("long")
    )
    signed = F.when(F.startswith(clean, F.lit("-")), -seconds).otherwise(seconds)
    return F.when(clean.rlike(r"^-?(\d+:)?\d{1,2}:\d{2}$"), signed)


def minute_or_fallback(offset_msec: Column, clock_text: Column, has_offsets: Column, has_clock: Column) -> Column:
    """Minute by the best time field a table has: offset, else clock text, else 'global'.

    ``has_offsets`` / ``has_clock`` say whether the *table* has any usable value of that field;
    within the chosen field a missing value counts as 0.
    """
    by_offset = F.floor(F.coalesce(offset_msec.try_cast("double"), F.lit(0.0)) / MINUTE_MSEC)
    by_clock = F.floor(F.coalesce(clock_seconds(clock_text), F.lit(0)) / 60)
    return (
        F.when(has_offsets, by_offset.cast("long").cast("string"))
        .when(has_clock, by_clock.cast("long").cast("string"))
        .otherwise(F.lit("global"))
    )


def confidence_bucket(confidence: Column) -> Column:
    """Ten-percent range of a confidence from 0.5 up; the last range includes 1.0."""
    last = len(CONFIDENCE_EDGES) - 2
    bucket = F.lit(OUT_OF_RANGE)
    for i in reversed(range(last + 1)):
        low, high = CONFIDENCE_EDGES[i], CONFIDENCE_EDGES[i + 1]
        below = confidence <= high if i == last else confidence < high
        bucket = F.when((confidence >= low) & below, f"{low:.2f}-{high:.2f}").otherwise(bucket)
    return bucket


def label_name(col: Column, names: Mapping[int, str], unknown: str = "unknown") -> Column:
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col.try_cast("int")), F.lit(unknown))


def as_array(probability: Column, is_vector: bool = True) -> Column:
    return vector_to_array(probability) if is_vector else probability


def probability_at(probability: Column, prediction: Column, is_vector: bool = True) -> Column:
    """Probability of the predicted class; null when the prediction is no valid index."""
    return F.get(as_array(probability, is_vector), prediction.cast("int"))


def max_probability(probability: Column, is_vector: bool = True) -> Column:
    return F.array_max(as_array(probability, is_vector))


def parse_bool(col: Column) -> Column:
    """True for 'true', '1' and 'yes' in any case; everything else, null included, is false."""
    return F.coalesce(F.lower(col.cast("string")).isin("true", "1", "yes"), F.lit(False))


def pct(part: Column, total: Column, digits: int = 4) -> Column:
    """Percentage of a total, 0 for an empty total."""
    share = F.try_divide(part.cast("double"), total.cast("double")) * 100.0
    return F.round(F.coalesce(share, F.lit(0.0)), digits)


def author_or_default(author: Column, default: str = "youtube_user") -> Column:
    return F.coalesce(author.cast("string"), F.lit(default))

