"""Inputs of the registered queries: test vocabulary and derived tables.

The given texts hardly contain the election vocabulary, so the rule queries add a few of their
frequent words to the real lexicon. The real terms stay in the lexicon and are searched for too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from murmullo.functions.lexicon import PROFILES, RuleProfile
from murmullo.operators.hybrid import score_hybrid
from murmullo.operators.rules import add_rules
from checks import tables

TEST_TERMS = {
    "political_mention": ("that", "les"),
    "polarization": ("with", "dans"),
    "electoral_institution": ("der", "on the"),
    "terruqueo": ("que",),
    "fraude": ("of the", "und"),
    "general_insult": ("los", "une"),
    "ethnic_racial_slur": ("de la",),
    "homophobic_slur": ("por",),
}
TEST_ACTORS = {
    "keiko_fujimori_fp": ("keiko", " that ", "dans"),
    "castillo_peru_libre": ("castillo", "with"),
    "jp_juntos_por_el_peru": ("juntos por el perú", "die der"),
    "lopez_aliaga_porky": ("porky", "que la"),
    "antauro": ("antauro", "los"),
    "onpe_jne": ("onpe", "und"),
}
SHORT_LIMIT = 60


def rules(name: str) -> RuleProfile:
    return PROFILES[name].with_terms(TEST_TERMS).with_short_limit(SHORT_LIMIT)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    table = tables.read(spark, sf, name)
    return tables.spread(table) if name == "documents" else table


def comments(spark: SparkSession, sf: str) -> DataFrame:
    return tables.comments(spark, sf)


def ruled(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return add_rules(comments(spark, sf), rules(name))


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    return tables.pseudo_predictions(comments(spark, sf))


def scored(spark: SparkSession, sf: str, name: str = "k") -> DataFrame:
    """Rules and pseudo predictions with hybrid columns, in one narrow pass."""
    profile = "k" if name == "k" else "v1"
    return score_hybrid(add_rules(predicted(spark, sf), rules(profile)), name)
