"""Every analysis accounts for its rows in the job that computes it."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from grainwise import accounting
from grainwise.accounting import Account
from grainwise.errors import LostRows, ScopeError
from grainwise.plans.base import events, sales
from grainwise.registry import accounted, catalogue

FOLDER = "/root/testdata/sf0.001"
PAIR = {"period": "1998-02", "baseline": "1997-02"}
RUNS = {
    "summary_stats": {}, "frequency": {"column": "priority", "limit": 2}, "top_n": {"dimension": "o_custkey", "measure": "price", "n": 3},
    "distribution": {"measure": "price_avg"}, "cross_tab": {"rows": "status", "columns": "priority", "measure": "price_mid"},
    "group_compare": {"dimension": "status", "measure": "price"}, "pareto": {"dimension": "o_custkey", "measure": "price"},
    "concentration": {"dimension": "o_custkey", "measure": "price"},
    "ranking_shift": {"dimension": "status", "measure": "price", "before_start": date(1997, 1, 1), "before_end": date(1997, 12, 31),
                      "after_start": date(1997, 6, 1), "after_end": date(1998, 12, 31)},
    "calendar_coverage": {}, "trend": {"measure": "price", "dimension": "status"}, "seasonality": {"measure": "price"},
    "period_compare": {"measure": "price", **PAIR}, "growth_decomposition": {"measure": "price", "dimension": "status", **PAIR},
    "correlation": {"measure": "price", "against": "gross"}, "bivariate": {"measure": "price", "against": "gross"},
    "driver_analysis": {"measure": "price"}, "mix_shift": {"measure": "price_avg", "dimension": "status", **PAIR},
    "changepoint": {"measure": "price"}, "correlated_shift": {"measure": "price", "against": "buyers"},
    "outlier_detection": {"measure": "price", "dimension": "status"}, "hypothesis_test": {"dimension": "priority", "measure": "price_avg"},
    "confidence_interval": {"dimension": "status"}, "effect_size": {"dimension": "status", "second_dimension": "priority"},
    "sample_adequacy": {"dimension": "status", "measure": "price_avg"}, "repeat_behaviour": {"entity": "o_custkey"},
    "cohort_retention": {"entity": "o_custkey"},
}


def test_every_analysis_is_run_here():
    assert set(RUNS) == {a.name for a in catalogue()}


@pytest.mark.parametrize("name", RUNS)
def test_rows_add_back(spark, name):
    result, account = accounted(sales(spark, FOLDER), name, **RUNS[name])
    result.collect()
    counts = account.check()
    assert counts["held"] > 0 and counts["entered"] == counts["held"] + counts["set_aside"]


def test_lost_rows_are_refused(spark, monkeypatch):
    monkeypatch.setattr(accounting, "ARRIVES", 0.1)
    account = Account("leaky")
    rows = account.entering(spark.range(10), F.col("id") == 0)
    groups = account.held(rows.where("id > 2").groupBy((F.col("id") % 2).alias("k")).count(), F.sum("count"))
    with pytest.raises(ScopeError, match="not been read"):
        account.check()
    groups.collect()
    monkeypatch.setattr(accounting, "ARRIVES", 30.0)
    with pytest.raises(LostRows, match="holds 7 rows and set 1 aside, of 10"):
        account.check()


def test_accounting_keeps_filters_and_columns_at_the_scan(spark):
    from grainwise.plans.base import orders
    from tests.test_plans import plan_of
    result, _ = accounted(orders(spark, FOLDER), "confidence_interval", measure="gross", confidence=0.9)
    text = plan_of(result)
    assert "GreaterThanOrEqual(o_orderdate" in text and "CollectMetrics" in text and "o_custkey" not in text
    empty, account = accounted(events(spark, FOLDER).where("value > -1").groups("event_type", ["click"]), "repeat_behaviour", entity="user_id")
    empty.collect()
    assert account.check()["held"] > 0
