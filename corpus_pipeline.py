"""From raw documents to token ids in five stages, each over all that the stage before has kept.

Every stage but the last is written to the shared folder and read again, so no stage is computed twice.

Defined cases: a null or empty text has no words and goes with the quality rules; rows without an id are judged like others, are each
a document of their own for near-duplicates, and stay; rows that repeat an id are each a row: of rows with one id and equal
words one stays, rows with one id and different texts are near-duplicates only if their fingerprints say so; an empty table gives an
empty result with the same columns; columns besides those of documents are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from murmullo.llm import lines, mixing, pieces, quality_rules, simhash
from murmullo.llm.common import table
from murmullo.llm.queries import MIX_WEIGHTS
from murmullo.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIX_SHARE = 0.95  # of the tokens that come in


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.judge(docs, table(spark, sf_dir, "labels"), keep=COLUMNS).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line resembles; n_chars counts what is left."""
    return lines.deduplicate(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; rows without id stay.

    Rows are told apart by their place in a written table of row numbers, so an id that several rows share loses no other text.
    """
    rows = materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    known = rows.where("doc_id is not null")
    groups = simhash.near_duplicates(known.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    placed = known.select("row", "doc_id").join(groups, "row")
    # the smallest id of a group, and of rows with that id the first
    first = placed.groupBy("group").agg(F.min(F.struct("doc_id", "row"))["row"].alias("row")).select("row")
    return known.join(first, "row", "left_semi").select(*COLUMNS).union(rows.where("doc_id is null").select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, at most once each."""
    return mixing.select_mix(docs, MIX_WEIGHTS, share=MIX_SHARE, epochs=1, keep=COLUMNS).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return pieces.encode_documents(docs, keep=["lang", "source"])


STAGES = [
    ("quality_rules", quality), ("line_dedup", line_dedup), ("simhash_dedup", near_dedup), ("source_mix", mix), ("merge_dropout", encode),
]
ORACLE_SQL = None  # hashes, components and merges have no SQL; tests/llm has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
