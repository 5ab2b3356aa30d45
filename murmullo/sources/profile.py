"""Checks on a written table: row count, schema and an ordered sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def profile_table(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First n rows in key order, each with the row count of the table."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.orderBy(*order).limit(n).withColumn("total_rows", total)


def schema_rows(df: DataFrame) -> DataFrame:
    """(column_name, data_type, filled): the schema with each column's number of non-null values."""
    counted = df.agg(*[F.count(c).alias(c) for c in df.columns])
    rows = [
        F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f.name).alias("filled"))
        for f in df.schema.fields
    ]
    return counted.select(F.inline(F.array(*rows)))
