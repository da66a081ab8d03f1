"""What the physical plans must and must not do."""

import re
from datetime import date

from grainwise.operators.describe import ranked_groups
from grainwise.operators.people import person_days
from grainwise.operators.time import in_periods
from grainwise.plans.base import events, lines, orders
from grainwise.registry import run

FOLDER = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_window_and_columns_reach_the_scan(spark):
    grouped, _ = ranked_groups(orders(spark, FOLDER), "o_orderpriority", "gross")
    text = plan_of(grouped)
    pushed = re.findall(r"PushedFilters: \[(.*)\]", text)
    assert any("GreaterThanOrEqual(o_orderdate" in p and "LessThan(o_orderdate" in p for p in pushed)
    assert all("o_custkey" not in s for s in re.findall(r"ReadSchema: (.*)", text))


def test_named_periods_reach_the_scan(spark):
    scope = orders(spark, FOLDER)
    text = plan_of(scope.frame.where(in_periods(scope, (date(1998, 1, 1), date(1999, 2, 1)), "month")))
    assert "Or(And(GreaterThanOrEqual(o_orderdate" in text


def test_no_cross_join_and_no_python(spark):
    frames = [run(lines(spark, FOLDER), "cross_tab", rows="flag", columns="l_linestatus"), run(lines(spark, FOLDER), "driver_analysis", measure="price"), run(lines(spark, FOLDER), "frequency", column="flag"),
              run(events(spark, FOLDER), "cohort_retention", entity="user_id", period="week"),
              run(orders(spark, FOLDER), "concentration", dimension="o_custkey", measure="gross")]
    for df in frames:
        text = plan_of(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert "Python" not in text and "MapInPandas" not in text


def test_people_are_folded_before_they_are_ordered(spark):
    """An entity of any size reaches a window as one row a day."""
    text = plan_of(person_days(events(spark, FOLDER), "user_id"))
    assert "partial_count" in text
