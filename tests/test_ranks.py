"""Ranks and quantiles across slices must agree with plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from grainwise.functions.ranks import midranks, positions, quantiles, running


def skewed(spark, n=3000):
    """A third of the rows share one value, another part of the groups is NULL."""
    rng = random.Random(7)
    rows = [(None if i % 11 == 0 else f"g{rng.randrange(4)}", 5.0 if i % 3 == 0 else round(rng.gauss(0, 50), 1)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(7)


def interpolated(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    lo = int(at)
    hi = min(lo + 1, len(values) - 1)
    return values[lo] + (values[hi] - values[lo]) * (at - lo)


def test_quantiles_are_exact_in_every_group(spark):
    data, df = skewed(spark)
    got = {r["g"]: r["q"] for r in quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0], ("g",)).collect()}
    for g in {x for x, _ in data}:
        values = [v for x, v in data if x == g]
        assert got[g] == pytest.approx([interpolated(values, p) for p in (0.0, 0.25, 0.5, 0.9, 1.0)])


def test_running_totals_follow_the_order(spark):
    data, df = skewed(spark)
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = running(counts, [("v", True)], {"before": "n"}, ("g",)).collect()
    for r in placed[::17]:
        group = [v for x, v in data if x == r["g"]]
        assert r["before"] == sum(v > r["v"] for v in group)
        assert r["before_whole"] == len(group)


def test_midranks_average_over_ties(spark):
    data, df = skewed(spark)
    values = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = {r["v"]: r["midrank"] for r in midranks(values, "v", "n").collect()}
    everything = [v for _, v in data]
    for v in list(got)[::50] + [5.0]:
        below = sum(x < v for x in everything)
        assert got[v] == below + (everything.count(v) + 1) / 2


def test_positions_number_every_row_once(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10).alias("score"))
    got = sorted((r["position"], r["score"], r["id"]) for r in positions(df, [("score", True), ("id", False)]).collect())
    assert [p for p, _, _ in got] == list(range(1, 1001))
    assert got == sorted(got, key=lambda r: (-r[1], r[2]))


def test_median_of_even_counts(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    assert quantiles(df, "v", [0.5]).first()["q"] == [statistics.median([1, 2, 3, 4])]


def test_quantiles_of_counted_values(spark):
    data, df = skewed(spark)
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {r["g"]: r["q"] for r in quantiles(counts, "v", [0.25, 0.5], ("g",), "n").collect()}
    for g in {x for x, _ in data}:
        assert got[g] == pytest.approx([interpolated([v for x, v in data if x == g], p) for p in (0.25, 0.5)])


def test_positions_start_anew_in_every_group(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    got = {(r["g"], r["id"]): (r["position"], r["position_whole"]) for r in positions(df, [("id", True)], ("g",)).collect()}
    for g in range(3):
        ids = sorted((i for i in range(1000) if i % 3 == g), reverse=True)
        assert [got[g, i] for i in ids] == [(n, len(ids)) for n in range(1, len(ids) + 1)]
