"""Every registered query with SQL agrees with it on the smallest data folder."""

import re

import pytest

import __spark_entry__ as entry
from checks.compare import check, duck

NAMES = sorted(q for q in entry.oracle_sql() if not re.match(r"op\d+_|pipeline$", q))
SLOW = {"k09_ngram_baseline", "a13_save_load", "k08_evaluate", "k11_infer_lake", "k07_apply_models", "l08_one_pass",
        "k06_fit_binary", "k06_fit_multiclass", "k04_text_pipeline"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, sf, name):
    status, detail, _ = check(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf)
    assert status in ("ok", "empty"), detail


def test_rows_only_queries_are_the_known_ones():
    # the optional operators state in their own tests which of them have no SQL
    assert {q for q in set(entry.queries()) - set(entry.oracle_sql()) if not re.match(r"op\d+_|pipeline$", q)} == SLOW


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
