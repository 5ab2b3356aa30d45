"""Keyed joins between stage tables and small look-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from murmullo.functions.scalars import BINARY_LABELS, MULTICLASS_LABELS, OFFENSIVE_LABELS

# Join keys and the identity columns both stages carry.
TOPIC_KEYS = ("kafka_topic", "kafka_partition", "kafka_offset")
FALLBACK_KEYS = ("event_id",)
SHARED_COLUMNS = (
    "message_raw", "message_clean", "source_file", "video_id", "timestamp_text", "timestamp_usec",
    "video_offset_msec", "author", "author_channel_id", "row_number", "source_s3_path", "kafka_topic",
    "kafka_partition", "kafka_offset", "kafka_timestamp", "minute", "event_id",
)


def drop_shared(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Drop identity columns that the other side of a join already has."""
    return df.drop(*[c for c in SHARED_COLUMNS if c not in keep])


def join_rules_ml(rules: DataFrame, ml: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Inner join of rule output and predictions by topic position, else by event id.

    Both keys are unique per row, so a hash exchange spreads evenly; the narrow prediction side
    may be broadcast by AQE when it is small.
    """
    if keys is None:
        both = set(rules.columns) & set(ml.columns)
        keys = TOPIC_KEYS if both.issuperset(TOPIC_KEYS) else FALLBACK_KEYS
    return rules.join(drop_shared(ml, keys), list(keys), "inner")


def join_by_key(predictions: DataFrame, rules: DataFrame, key: str = "event_id") -> DataFrame:
    """Predictions and rule columns side by side, matched by key."""
    extra = [c for c in rules.columns if c == key or c not in predictions.columns]
    return predictions.join(rules.select(*extra), key, "inner")


def id_overlap(first: DataFrame, second: DataFrame, key: str = "event_id") -> DataFrame:
    """One row ``overlap``: number of matching pairs of non-null ids.

    Pairs are counted from per-id counts, so a repeated id does not multiply rows.
    """
    counts = [
        df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(f"_n{i}"))
        for i, df in enumerate((first, second))
    ]
    pairs = counts[0].join(counts[1], key, "inner")
    return pairs.agg(F.coalesce(F.sum(F.col("_n0") * F.col("_n1")), F.lit(0)).alias("overlap"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight) with the balanced weight rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("classes"))
    rows, classes = totals.select("rows").scalar(), totals.select("classes").scalar()
    return counts.select(label, (rows / (classes * F.col("_n")).cast("double")).alias("weight"))


def attach_class_weight(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Look up each row's class weight.

    The weights come as one map from a scalar subquery, so the rows stay where they are: a join on
    the label would bring all rows of a class into one task. The map holds an entry per class; a
    classifier holds a row of coefficients per class on the driver in any case.
    """
    table = class_weights(df, label).agg(
        F.map_from_entries(F.collect_list(F.struct(label, "weight"))).alias("weights")
    )
    return df.withColumn(weight, F.try_element_at(table.scalar(), F.col(label)))


def _strict(name: str, col, mapping: Mapping[int, object]):
    """Mapped value; an unmapped label stops the job instead of passing as null."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    value = F.try_element_at(F.create_map(*pairs), col)
    return F.when(value.isNull(), F.raise_error(F.concat(F.lit(f"unknown {name}: "), col.cast("string")))).otherwise(value)


def attach_label_names(df: DataFrame, label: str = "label") -> DataFrame:
    """Four-class name, binary label and binary name of each row; unknown labels fail."""
    code = F.col(label).cast("int")
    binary = {k: int(k in OFFENSIVE_LABELS) for k in MULTICLASS_LABELS}
    return df.withColumns(
        {
            "label_multiclass_name": _strict("label", code, MULTICLASS_LABELS),
            "label_binary_v2": _strict("label", code, binary),
            "label_binary_name_v2": _strict("label", code, {k: BINARY_LABELS[v] for k, v in binary.items()}),
        }
    )
