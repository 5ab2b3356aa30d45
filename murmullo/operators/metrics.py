"""Classification metrics from one confusion table: a few rows, whatever the data size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def confusion(df: DataFrame, label: str, prediction: str, labels: Sequence[int], weight: str | None = None) -> DataFrame:
    """(label, prediction, count) with a row for every pair, zero cells included.

    The counts come from one pass with one conditional count per cell; a row stands for ``weight`` rows if that is given.
    """
    def rows_if(condition: Column) -> Column:
        return F.count_if(condition) if weight is None else F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0).cast("long"))

    cells = [(a, p) for a in labels for p in labels]
    counted = df.agg(
        *[rows_if((F.col(label) == a) & (F.col(prediction) == p)).alias(f"{a}_{p}") for a, p in cells]
    )
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("label"), F.lit(p).alias("prediction"), F.col(f"{a}_{p}").alias("count"))
            for a, p in cells
        ]
    )
    return counted.select(F.inline(rows))


def confusion_wide(df: DataFrame, label: str, prediction: str, names: dict[int, str]) -> DataFrame:
    """One row per actual label and one ``pred_<name>`` column per predicted label."""
    counts = df.where(F.col(label).isin(*names)).groupBy(label).agg(
        *[F.count_if(F.col(prediction) == p).alias(f"pred_{n}") for p, n in names.items()]
    )
    every = df.sparkSession.createDataFrame(list(names.items()), "code int, actual_label string")
    joined = every.join(counts, every["code"] == counts[label], "left")
    return joined.select("actual_label", *[F.coalesce(f"pred_{n}", F.lit(0)).alias(f"pred_{n}") for n in names.values()])


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def per_class_metrics(matrix: DataFrame) -> DataFrame:
    """Totals, hits, precision, recall and F1 per class; 0 where undefined."""
    cell = F.explode(
        F.array(
            F.struct(F.col("label").alias("label"), F.col("count").alias("actual"), F.lit(0).cast("long").alias("predicted"), F.lit(0).cast("long").alias("tp")),
            F.struct(F.col("prediction").alias("label"), F.lit(0).cast("long").alias("actual"), F.col("count").alias("predicted"),
                     F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0).alias("tp")),
        )
    )
    totals = matrix.select(cell.alias("c")).groupBy("c.label").agg(
        F.sum("c.actual").alias("actual_total"), F.sum("c.predicted").alias("predicted_total"), F.sum("c.tp").alias("tp")
    )
    scored = totals.withColumns(
        {"precision": _ratio(F.col("tp"), F.col("predicted_total")), "recall": _ratio(F.col("tp"), F.col("actual_total"))}
    )
    harmonic = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.withColumn("f1", harmonic)


def macro(per_class: DataFrame) -> DataFrame:
    return per_class.agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1")
    )


def weighted_metrics(matrix: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    classes = per_class_metrics(matrix)
    rows = F.sum("actual_total")

    def weighted(name: str) -> Column:
        return _ratio(F.sum(F.col(name) * F.col("actual_total")), rows)

    return classes.agg(
        _ratio(F.sum("tp"), rows).alias("accuracy"),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"),
        weighted("f1").alias("weighted_f1"),
    )
