"""Registered queries against their SQL on the smallest tables. TICKLOOM_ALL=1 runs every one of them."""

import os

import pytest

from tests.check import compare, duck
from tickloom.registry import oracles, queries

SF = "/root/testdata/sf0.001"
QUICK = (
    "bars_from_lineitem bars_from_events headlines_fixture target_return static_strategies_sharpe data_profile price_block "
    "technical_rsi technical_autocorr legacy_block parse_headlines event_table company_session company_relevance "
    "sequence_session category_counts_long price_interaction tfidf_documents session_folds size_positions cv_experiment"
).split()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(oracles()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracles()) if os.environ.get("TICKLOOM_ALL") else QUICK)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF, queries()[name], oracles()[name]) is None


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["strategy", "sharpe"] and df.count() == 9
