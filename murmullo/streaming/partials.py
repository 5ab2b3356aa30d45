"""Partial rows of a stream's micro-batches, kept in a bounded number of folders.

Every micro-batch writes one folder. Its place follows from its number alone, as in a counter with digits to
the base ``FAN``: where a digit runs over, the micro-batch writes the merged rows of the folders of all lower digits with its own,
one tier higher. n micro-batches so lie in at most (FAN - 1) * log_FAN(n) folders, and a row is rewritten once a tier. A merge
names its inputs by being in its place: of two folders that hold the same micro-batches, readers take the merged one.

A micro-batch that is repeated finds its inputs as they were, since only the next one may write over them, and replaces its own folder
as a whole. Rows carry the last micro-batch they hold (``_upto``), so what an overwritten place held before is never counted.
A reader beside a running stream may find a file gone and has to read again; after a run the table is still.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

FAN = 4
MARK = "_upto"
PLACES = ("micro_tier", "micro_slot")  # folder names


def place(batch: int) -> tuple[int, int]:
    """(tier, slot) of the folder that a micro-batch writes."""
    tier = 0
    while batch % FAN == FAN - 1:
        batch, tier = batch // FAN, tier + 1
    return tier, batch % FAN


def live(batch: int) -> list[tuple[int, int, int]]:
    """(tier, slot, last micro-batch) of the folders that hold micro-batches 0 to ``batch``, each once, the oldest first."""
    count, digits = batch + 1, []
    while count:
        digits.append(count % FAN)
        count //= FAN
    found, upto = [], -1
    for tier in reversed(range(len(digits))):
        for slot in range(digits[tier]):
            upto += FAN**tier
            found.append((tier, slot, upto))
    return found


class PartialTable:
    """Rows that micro-batches add to; ``merge`` adds up rows of several micro-batches (none: they stay side by side)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.schema, self.merge = spark, path, schema, merge
        if {MARK, *PLACES} & set(schema.names):
            raise ValueError(f"partial rows can't have columns named {MARK}, {', '.join(PLACES)}")
        self.stored = T.StructType([*schema.fields, T.StructField(MARK, T.LongType())])

    def write(self, batch: int, rows: DataFrame) -> None:
        """Lands the rows of a micro-batch, with those of the folders it stands for from now on."""
        tier, slot = place(batch)
        below = [f for f in live(batch - 1) if f[0] < tier]
        if below:
            rows = self._folders(below).unionByName(rows.select(*self.schema.names))
            rows = self.merge(rows) if self.merge else rows
        rows.select(*self.schema.names, F.lit(batch).cast("long").alias(MARK)).write.mode("overwrite").parquet(f"{self.path}/{PLACES[0]}={tier}/{PLACES[1]}={slot}")

    def read(self, batch: int | None = None) -> DataFrame:
        """Rows of micro-batches 0 to ``batch``, or of all there are; no rows before the first."""
        batch = self.last() if batch is None else batch
        if batch < 0:
            return self.spark.createDataFrame([], self.schema)
        return self._folders(live(batch))

    def last(self) -> int:
        """The last micro-batch that left rows, -1 if none did."""
        try:
            stored = self.spark.read.schema(self.stored).parquet(self.path)
        except AnalysisException:
            return -1  # nothing has been written
        top = stored.agg(F.max(MARK)).first()[0]
        return -1 if top is None else top

    def _folders(self, folders: list[tuple[int, int, int]]) -> DataFrame:
        places = T.StructType([*self.stored.fields, *[T.StructField(c, T.IntegerType()) for c in PLACES]])
        rows = self.spark.read.option("basePath", self.path).schema(places).parquet(*[f"{self.path}/{PLACES[0]}={t}/{PLACES[1]}={s}" for t, s, _ in folders])
        wanted = [(F.col(PLACES[0]) == t) & (F.col(PLACES[1]) == s) & (F.col(MARK) == u) for t, s, u in folders]
        return rows.where(reduce(lambda a, b: a | b, wanted)).select(*self.schema.names)
