"""Tier 2: how groups differ."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.contract import is_number
from grainwise.errors import NotPossible, ParamsInvalid
from grainwise.functions.exprs import declared, finite_value, quoted, ratio, type_of
from grainwise.functions.ranks import positions, quantiles, running
from grainwise.operators.common import combinable, count_below_zero, totals
from grainwise.operators.describe import ranked_groups
from grainwise.registry import analysis
from grainwise.scope import ScopedFrame, within
from grainwise.session import cut

# The cuts a concentration reports.
TOP_CUTS = (1, 3, 5, 10, 20)
PERCENT_CUTS = (1, 5, 10)
PERCENT_CUTS_FROM = 100


@analysis("group_compare", 2, "Seven statistics of a measure per group.", selects=True)
def group_compare(scope: ScopedFrame, dimension: str, measure: str) -> DataFrame:
    """Per group and over all rows. The `(all)` row is computed from rows, not from groups."""
    scope.contract.dimension(dimension)
    m = scope.contract.measure(measure)
    if m.is_ratio:
        raise NotPossible(f"{measure} is a ratio of sums and has no value per row")
    unit = scope.per_unit(m, [dimension])
    frame = unit.entering(unit.frame).withColumn("member", F.col(quoted(dimension)))
    number = is_number(type_of(frame, measure))
    blank = F.lit(None).cast("double")
    v = finite_value(frame, measure) if number else blank
    frame = frame.withColumn("__v", v)
    summed = blank if m.agg in (None, "none", "median") else declared(frame, m)
    c = F.col(quoted(measure))
    stats = [F.count(c).alias("n"), (F.count(F.lit(1)) - F.count(c)).alias("nulls"),
             summed.alias("total"), F.min("__v").alias("min"), F.max("__v").alias("max"),
             F.avg("__v").alias("mean"), blank.alias("median"),
             F.stddev_samp("__v").alias("stddev"), F.count(F.lit(1)).alias("rows")]
    result = frame.groupingSets([["member"], []], "member").agg(
        *stats, (F.grouping("member") == 1).alias("is_all"))
    if number:
        result = _with_ranked_medians(result, frame, m)
    result = cut(unit.held(result, F.sum(F.when(~F.col("is_all"), F.col("rows")))))  # the share reads the groups again, not the table
    members = result.where(~F.col("is_all"))
    if m.additive:
        whole = members.agg(
            F.when(count_below_zero("total") == 0, F.sum("total")).alias("whole")).scalar()
        share = F.when(whole > 0, ratio(F.col("total"), whole))
    else:
        share = blank
    return result.withColumn("share", share).select(
        "member", "is_all", "n", "nulls", "total", "min", "max", "mean", "median", "stddev",
        "share", "rows")


def _with_ranked_medians(result: DataFrame, frame: DataFrame, m) -> DataFrame:
    counts = cut(frame.groupBy("member", "__v").agg(F.count(F.lit(1)).alias("__n")))  # read by both rankings
    by = quantiles(counts, "__v", [0.5], ("member",), "__n").select(
        F.col("member").alias("__m"), F.lit(False).alias("__all"), F.col("q")[0].alias("__q"))
    whole = quantiles(counts, "__v", [0.5], n="__n").select(
        F.lit(None).cast(frame.schema["member"].dataType).alias("__m"),
        F.lit(True).alias("__all"), F.col("q")[0].alias("__q"))
    medians = by.unionByName(whole)
    joined = result.join(medians, result["member"].eqNullSafe(medians["__m"])
                         & (result["is_all"] == medians["__all"]), "left")
    total = F.col("__q") if m.agg == "median" else F.col("total")
    return joined.withColumns({"median": F.col("__q"), "total": total}).drop("__m", "__all", "__q")


@analysis("pareto", 2, "Running share of groups, biggest first.", narrows=True)
def pareto(scope: ScopedFrame, dimension: str, measure: str, threshold: float = 80.0) -> DataFrame:
    """Any number of groups: positions and running totals come from range-partitioned slices."""
    if not 0 < threshold <= 100:
        raise ParamsInvalid(f"threshold is a percentage above 0 and at most 100; got {threshold}")
    placed, whole = _placed(scope, dimension, measure)
    before = ratio(F.col("before"), F.lit(whole))
    upto = ratio(F.col("before") + F.coalesce(F.col("value"), F.lit(0)), F.lit(whole))
    limit = F.lit(threshold / 100.0)
    return placed.select(
        F.col("position").alias("rank"), "member", F.col("value").alias("total"),
        ratio(F.col("value"), F.lit(whole)).alias("share"), upto.alias("running_share"),
        ((before < limit)).alias("reached"), "rows")


def pareto_crossing(scope: ScopedFrame, dimension: str, measure: str, threshold: float = 80.0) -> DataFrame:
    """One row: groups needed to reach the threshold, of how many, what they hold, and the groups tied with the one that crosses it."""
    placed = cut(pareto(scope, dimension, measure, threshold))
    edge = placed.agg(F.min(F.when(F.col("reached"), F.col("total"))).alias("edge")).scalar()
    tied = F.coalesce(F.col("total") == edge, F.lit(False))
    return placed.agg(F.count_if("reached").alias("needed"), F.count(F.lit(1)).alias("groups"), F.max(F.when(F.col("reached"), F.col("running_share"))).alias("share"),
                      F.count_if(tied).alias("tied"), F.count_if(tied & ~F.col("reached")).alias("tied_left_out"))


def _placed(scope: ScopedFrame, dimension: str, measure: str):
    """Groups with their position, the total before them, and the checked whole."""
    m = combinable(scope, measure)
    if not m.additive:
        raise NotPossible(f"{m.agg or 'ratio'} of {measure} does not add up across groups")
    grouped, _ = ranked_groups(scope, dimension, measure)
    amount = grouped.withColumns({"__amount": F.coalesce(F.col("value"), F.lit(0)),
                                  "__one": F.lit(1).cast("long")})
    placed = running(amount, [("value", True), ("member", False)],
                     {"before": "__amount", "position": "__one"})
    # Held once placed: a range partitioning samples what it reads, and would count it twice.
    counted = scope.held(placed.withColumn("position", F.col("position") + 1), F.sum("rows"))
    facts = counted.agg(F.max("before_whole").alias("whole"),
                        count_below_zero("value").alias("negative")).first()
    if facts["negative"]:
        raise NotPossible(f"{facts['negative']} group(s) total below zero, so no share is a proportion")
    if not facts["whole"] or facts["whole"] <= 0:
        raise NotPossible("the totals sum to zero or less, so there is nothing to be a share of")
    return counted, facts["whole"]


@analysis("concentration", 2, "How much the largest groups hold.", narrows=True)
def concentration(scope: ScopedFrame, dimension: str, measure: str) -> DataFrame:
    """Shares at fixed cuts, the Herfindahl index and the effective number of groups."""
    placed, whole = _placed(scope, dimension, measure)
    share = ratio(F.coalesce(F.col("value"), F.lit(0)), F.lit(whole))
    n = F.col("groups")
    top = [F.sum(F.when(F.col("position") <= c, share)).alias(f"top_{c}") for c in TOP_CUTS]
    size = {p: F.greatest(F.lit(1), F.floor(F.col("position_whole") * p / 100)) for p in PERCENT_CUTS}
    pct = [F.sum(F.when(F.col("position") <= size[p], share)).alias(f"pct_{p}") for p in PERCENT_CUTS]
    one = placed.agg(*top, *pct, F.sum(share).alias("all"), F.sum(share * share).alias("squares"),
                     F.count(F.lit(1)).alias("groups"))
    hhi = F.col("squares") * 10_000
    rows = [_cut(F.lit(f"top {c}"), F.lit(c).cast("long"), F.col(f"top_{c}"), n > c) for c in TOP_CUTS]
    for p in PERCENT_CUTS:
        size = F.greatest(F.lit(1).cast("long"), F.floor(n * p / 100).cast("long"))
        rows.append(_cut(F.lit(f"top {p}%"), size, F.col(f"pct_{p}"), n >= PERCENT_CUTS_FROM))
    rows.append(_cut(F.lit("all"), n, F.col("all"), F.lit(True)))
    return (one.select(F.explode(F.array(*rows)).alias("s"), hhi.alias("hhi"),
                       F.try_divide(F.lit(10_000.0), hhi).alias("effective_groups"))
            .where("s.shown").select("s.cut", "s.groups", "s.share", "hhi", "effective_groups"))


def _cut(name, groups, share, shown):
    return F.struct(name.alias("cut"), groups.alias("groups"), share.alias("share"), shown.alias("shown"))


@analysis("ranking_shift", 2, "Positions of groups in two date ranges.")
def ranking_shift(scope: ScopedFrame, dimension: str, measure: str, before_start, before_end,
                  after_start, after_end) -> DataFrame:
    """One grouped pass reads both ranges and one ranked pass places the members of each, however many there are."""
    scope.contract.dimension(dimension)
    m = combinable(scope, measure)
    unit = scope.per_unit(m, [dimension, scope.contract.dated()])
    sides = {"before": _range(before_start, before_end), "after": _range(after_start, after_end)}
    day = F.col(quoted(scope.contract.dated()))
    tests = {k: within(day, *v) for k, v in sides.items()}
    # A row in both ranges counts in both, so its sides are opened into rows of one scan.
    opened = F.explode(F.array_compact(F.array(*[F.when(t, k) for k, t in tests.items()])))
    frame = unit.frame.where(tests["before"] | tests["after"]).withColumn("__side", opened)
    grouped = totals(unit.entering(frame), m, [F.col(quoted(dimension)), F.col("__side")], ["member", "side"])
    placed = unit.held(positions(grouped, [("value", True), ("member", False)], ("side",)), F.sum("rows"))
    merged = placed.groupBy("member").agg(
        *[F.max(F.when(F.col("side") == k, F.col("value"))).alias(f"total_{k}") for k in sides],
        *[F.max(F.when(F.col("side") == k, F.col("position"))).alias(f"rank_{k}") for k in sides])
    state = F.when(F.col("rank_before").isNull(), "new").when(F.col("rank_after").isNull(), "gone").otherwise("moved")
    return merged.select("member", "total_before", "rank_before", "total_after", "rank_after",
                              (F.col("rank_before") - F.col("rank_after")).alias("change"),
                              state.alias("state"))


def ranking_shift_rows(scope: ScopedFrame, before_start, before_end, after_start, after_end) -> DataFrame:
    """One row: where the analysed rows of `ranking_shift` lie, those in neither range and those without a date among them."""
    day = F.col(quoted(scope.contract.dated()))
    before, after = (F.coalesce(within(day, *_range(*r)), F.lit(False)) for r in ((before_start, before_end), (after_start, after_end)))
    return scope.frame.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(before & ~after).alias("before_only"), F.count_if(after & ~before).alias("after_only"),
        F.count_if(before & after).alias("in_both"), F.count_if(day.isNotNull() & ~before & ~after).alias("in_neither"), F.count_if(day.isNull()).alias("undated"))


def _range(start, end) -> tuple[date, date]:
    try:
        pair = tuple(d if isinstance(d, date) else date.fromisoformat(str(d)) for d in (start, end))
    except ValueError as bad:
        raise ParamsInvalid(str(bad)) from None
    if pair[1] < pair[0]:
        raise ParamsInvalid(f"the range ends {pair[1]} before it starts {pair[0]}")
    return pair
