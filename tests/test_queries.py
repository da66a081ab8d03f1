"""Registered queries against their SQL on the smallest scale. The whole catalogue runs with ALL_QUERIES=1."""

import os

import pytest

from grainwise.plans import load
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
# One or two per module, so that an ordinary run stays short.
CORE = ("top_n", "scope_counts", "summary_stats", "distribution", "cross_tab_measure", "ranking_shift", "calendar_coverage_day", "trend_split",
        "growth_decomposition", "mix_shift", "correlated_shift", "chi_square", "anova_many", "ci_mean_bounds", "repeat_consecutive_gap", "cohort_retention_week",
        "load_csv_typed", "footer_skip", "column_evidence", "duplicate_rows", "clean_drop_duplicates", "key_pairs", "fk_orphans", "validation_report",
        "caveat_date_order", "contract_history")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_is_named_once_and_has_sql():
    found = load()
    assert len(found) > 150
    assert not {n for n, q in found.items() if q.sql is None}


@pytest.mark.parametrize("name", sorted(load()) if os.environ.get("ALL_QUERIES") else CORE)
def test_query_matches_its_sql(spark, con, name):
    assert compare(con, spark, load()[name], FOLDER) is None


def test_entry_runs(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
