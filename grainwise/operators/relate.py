"""Tier 4: how measures and dimensions go together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainwise.errors import ParamsInvalid
from grainwise.functions import calendar as cal
from grainwise.functions.exprs import finite_value, quoted, ratio
from grainwise.functions.moments import safe_corr, weighted_corr
from grainwise.functions.ranks import midranks, quantiles, running
from grainwise.operators.common import valued
from grainwise.operators.time import in_periods, labelled_pair
from grainwise.registry import analysis
from grainwise.scope import ScopedFrame
from grainwise.session import cut


def pairs(scope: ScopedFrame, measure: str, against: str) -> DataFrame:
    """x, y over the analysed rows; either may be NULL."""
    if measure == against:
        raise ParamsInvalid(f"measure and against are both {measure!r}")
    m, a = valued(scope, measure), valued(scope, against)
    frame = scope
    for one in (m, a):
        if one.per:
            frame = frame.per_unit(one, [measure, against])
    f = frame.frame
    return f.select(finite_value(f, measure).alias("x"), finite_value(f, against).alias("y"))


@analysis("correlation", 4, "Pearson and Spearman of two measures over complete pairs.")
def correlation(scope: ScopedFrame, measure: str, against: str) -> DataFrame:
    """Pairs are counted before anything is ranked, so repeated values cross the shuffle once."""
    both = scope.entering(pairs(scope, measure, against))
    present = F.col("x").isNotNull() & F.col("y").isNotNull()
    linear = both.agg(F.count_if(present).alias("pairs"), F.count_if(~present).alias("dropped"),
                      safe_corr(F.col("x"), F.col("y")).alias("pearson"))
    counted = cut(both.where(present).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    ranks = {}
    for side in ("x", "y"):
        values = counted.groupBy(side).agg(F.sum("n").alias("n"))
        ranks[side] = midranks(values, side, "n").select(side, F.col("midrank").alias(f"r{side}"))
    placed = counted.join(ranks["x"], "x").join(ranks["y"], "y")
    rank = placed.agg(weighted_corr(F.col("rx"), F.col("ry"), F.col("n")).alias("spearman"))
    return scope.held(linear, F.sum(F.col("pairs") + F.col("dropped"))).select("pairs", "dropped", "pearson",
                         rank.select("spearman").scalar().alias("spearman"))


def correlation_gap(result: DataFrame) -> DataFrame:
    """The two coefficients and whether they differ by 0.1 or more."""
    gap = F.abs(F.col("pearson") - F.col("spearman"))
    return result.withColumns({"gap": gap, "differs": gap >= 0.1})


@analysis("bivariate", 4, "One measure's mean and median in equal slices of another's values.")
def bivariate(scope: ScopedFrame, measure: str, against: str, bins: int = 10) -> DataFrame:
    """Distinct values are divided, and every row follows its own value.

    Pairs are counted and written once; edges, means and medians come from there. The slices are ranges, so at most `bins` edges place the rows; no value-to-bin join is needed.
    """
    if isinstance(bins, bool) or not isinstance(bins, int) or not 2 <= bins <= 50:
        raise ParamsInvalid(f"bins must be a whole number from 2 to 50; got {bins!r}")
    absent = F.col("x").isNull() | F.col("y").isNull()
    complete = scope.entering(pairs(scope, measure, against), absent).where(~absent)
    both = cut(complete.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    edges = slice_edges(both.select("x").distinct(), bins)
    if not edges:
        return both.select(F.lit(None).cast("int").alias("bin"), F.col("x").alias("lo"), F.col("x").alias("hi"),
                           F.lit(0).cast("long").alias("rows"), F.col("y").alias("mean"), F.col("y").alias("median")).limit(0)
    slot = F.lit(1)
    for edge in edges[1:]:
        slot = slot + (F.col("x") >= F.lit(edge)).cast("int")
    placed = both.withColumn("bin", slot)
    result = placed.groupBy("bin").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("rows"),
        (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("mean"))
    medians = quantiles(placed, "y", [0.5], ("bin",), "n").select("bin", F.col("q")[0].alias("median"))
    return scope.held(result, F.sum("rows")).join(medians, "bin").select("bin", "lo", "hi", "rows", "mean", "median")


def slice_edges(distinct_values: DataFrame, bins: int) -> list[float]:
    """The lowest value of each of `bins` equal slices of distinct `x` values, at most `bins` rows."""
    placed = running(distinct_values.withColumn("__one", F.lit(1).cast("long")), [("x", False)],
                     {"before": "__one"})
    size, extra = F.floor(F.col("before_whole") / bins), F.col("before_whole") % bins
    # The first `extra` slices hold one value more than the rest.
    fat = extra * (size + 1)
    slot = F.when(F.col("before") < fat, F.floor(F.try_divide(F.col("before"), size + 1))).otherwise(
        extra + F.floor(F.try_divide(F.col("before") - fat, size)))
    lowest = placed.groupBy(slot.alias("slot")).agg(F.min("x").alias("lo")).orderBy("slot")
    return [r["lo"] for r in lowest.collect()]


def turns(result: DataFrame) -> DataFrame:
    """How often the slice means change direction."""
    order = Window.orderBy("bin")  # at most 50 slices
    steps = result.withColumn("step", F.signum(F.col("mean") - F.lag("mean").over(order)))
    moving = steps.where(F.col("step") != 0)
    flips = moving.withColumn("flip", F.col("step") != F.lag("step").over(order))
    return flips.agg(F.count_if(F.col("flip")).alias("turns"))


@analysis("driver_analysis", 4, "How much of a measure's variation each dimension accounts for.")
def driver_analysis(scope: ScopedFrame, measure: str) -> DataFrame:
    """Grouping sets read every dimension in one scan, as counts and sums per group."""
    m = valued(scope, measure)
    dims = list(scope.contract.dimensions)
    if not dims:
        raise ParamsInvalid("the contract declares no dimension")
    unit = scope.per_unit(m, dims) if m.per else scope
    f = unit.frame
    frame = unit.entering(f.select(finite_value(f, measure).alias("y"), *[F.col(quoted(d)).cast("string").alias(f"d{i}") for i, d in enumerate(dims)]),
                          F.col("y").isNull()).where(F.col("y").isNotNull())
    names = [f"d{i}" for i in range(len(dims))]
    which = F.lit(None).cast("string")
    for i, d in enumerate(dims):
        which = F.when(F.grouping(f"d{i}") == 0, F.lit(d)).otherwise(which)
    groups = frame.groupingSets([[n] for n in names], *names).agg(
        F.count("y").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("var"), which.alias("dimension"))
    groups = cut(unit.held(groups, F.sum(F.when(F.col("dimension") == dims[0], F.col("n")))))
    # The groups of any one dimension hold the grand mean and variance, so the table is read once.
    whole = groups.where(F.col("dimension") == dims[0])
    w = F.col("n").cast("double")
    n = whole.agg(F.sum("n").alias("n")).scalar()
    mean = whole.agg((F.sum(w * F.col("mean")) / F.sum(w)).alias("m")).scalar()
    var = whole.agg((F.sum(w * (F.col("var") + F.pow(F.col("mean") - mean, 2))) / F.sum(w)).alias("v")).scalar()
    per = groups.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"),
        F.sum(F.col("n") * F.pow(F.col("mean") - mean, 2)).alias("ssb"),
        F.count_if(F.col("n") == 1).alias("one_row_groups"))
    share = ratio(F.col("ssb"), var * n)
    chance = ratio(F.col("groups") - 1, n - 1)
    return per.where(var > 0).select("dimension", "groups", "rows", share.alias("share"), chance.alias("chance"),
                      (share - chance).alias("excess"), "one_row_groups")


@analysis("mix_shift", 4, "A mean's change split into rate, mix and interaction.")
def mix_shift(scope: ScopedFrame, measure: str, dimension: str, period: str, baseline: str,
              grain: str = cal.DEFAULT_GRAIN) -> DataFrame:
    scope.contract.dimension(dimension)
    m = valued(scope, measure)
    grain, base, current = labelled_pair(scope, period, baseline, grain)
    unit = scope.per_unit(m, [dimension, scope.contract.dated()])
    f = unit.frame
    is_base = (unit.date >= F.lit(base)) & (unit.date < F.lit(cal.next_period(base, grain)))
    rows = unit.entering(f.where(in_periods(unit, (base, current), grain)).select(
        F.col(quoted(dimension)).alias("member"), is_base.alias("is_base"), F.col(quoted(measure)).cast("double").alias("v")),
        F.col("v").isNull()).where(F.col("v").isNotNull())
    side = {0: F.col("is_base"), 1: ~F.col("is_base")}
    members = rows.groupBy("member").agg(
        *[F.avg(F.when(t, F.col("v"))).alias(f"mean{k}") for k, t in side.items()],
        *[F.count_if(t).alias(f"n{k}") for k, t in side.items()])
    members = cut(unit.held(members, F.sum(F.col("n0") + F.col("n1"))))
    whole = [members.agg(F.sum(f"n{k}").alias("n")).scalar() for k in (0, 1)]
    shares = members.where((whole[0] > 0) & (whole[1] > 0)).withColumns({
        "share0": ratio(F.col("n0"), whole[0]), "share1": ratio(F.col("n1"), whole[1])})
    dm, dw = F.col("mean1") - F.col("mean0"), F.col("share1") - F.col("share0")
    part = lambda k: F.coalesce(F.col(f"share{k}") * F.col(f"mean{k}"), F.lit(0.0))
    return shares.select(
        "member", "mean0", "mean1", "share0", "share1", (F.col("share0") * dm).alias("rate"),
        (F.when(F.col("mean1").isNotNull(), F.col("mean0") * dw)).alias("mix"), (dw * dm).alias("interaction"),
        (part(1) - part(0)).alias("contribution"))
