"""Tier 3: the calendar. An absent period is a row with a blank value, never a zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainwise.errors import ParamsInvalid
from grainwise.functions import calendar as cal
from grainwise.functions.exprs import quoted, ratio
from grainwise.operators.common import additive, combinable, totals
from grainwise.registry import analysis
from grainwise.scope import ScopedFrame
from grainwise.session import cut

# The grains that repeat inside a longer cycle.
CYCLES = ("day", "week", "month", "quarter")


def series(scope: ScopedFrame, measures: list, grain: str, only: Column | None = None) -> DataFrame:
    """period, v0…, rows: one row per calendar period. The grouped side is one row per period, so
    neither side of this join grows with the table."""
    usable = scope.date.isNotNull() if only is None else scope.date.isNotNull() & only
    frame = scope.entering(scope.frame, ~F.coalesce(usable, F.lit(False))).where(usable)
    period = cal.period_of(scope.date, grain)
    grouped = None
    for i, m in enumerate(measures):
        one = totals(frame, m, [period], ["period"])
        one = one.select("period", F.col("value").alias(f"v{i}"), F.col("rows").alias(f"rows{i}"))
        grouped = one if grouped is None else grouped.join(one, "period")
    if grouped is None:
        grouped = frame.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("rows0"))
    spine = scope.calendar(grain).spine()
    values = [F.col(f"v{i}") for i in range(len(measures))]
    out = spine.join(grouped, "period", "left").select(
        "period", *values, F.coalesce(F.col("rows0"), F.lit(0)).alias("rows"))
    return scope.held(out, F.sum("rows"))


def unit_series(scope: ScopedFrame, measure: str, grain: str):
    """The series of one combinable measure, over its units when it has one."""
    m = combinable(scope, measure)
    unit = scope.per_unit(m, [scope.contract.dated()])
    return series(unit, [m], grain)


def runs(spine: DataFrame, flag: Column) -> DataFrame:
    """Add `run_length`: how long the run of equal flags around each period is.

    The windows are over periods, whose number is set by the calendar.
    """
    order = Window.orderBy("period")
    both = Window.partitionBy("__flag").orderBy("period")
    tagged = spine.withColumn("__flag", flag)
    islands = tagged.withColumn("__island", F.row_number().over(order) - F.row_number().over(both))
    counted = islands.withColumn(
        "run_length", F.count(F.lit(1)).over(Window.partitionBy("__flag", "__island")))
    return counted.drop("__flag", "__island")


@analysis("calendar_coverage", 3, "Every period of the calendar and the rows it holds.")
def calendar_coverage(scope: ScopedFrame, grain: str = cal.DEFAULT_GRAIN) -> DataFrame:
    grain = cal.check_grain(grain)
    covered = series(scope, [], grain)
    absent = F.col("rows") == 0
    marked = runs(covered, absent).withColumn("is_absent", absent)
    return marked.select(cal.label_of(F.col("period"), grain).alias("period"), "rows", "is_absent",
                         "run_length")


def longest_gap(scope: ScopedFrame, grain: str = cal.DEFAULT_GRAIN) -> DataFrame:
    """One row: periods, how many are absent, and the longest run of absent ones."""
    covered = calendar_coverage(scope, grain)
    return covered.agg(
        F.count(F.lit(1)).alias("periods"), F.count_if("is_absent").alias("absent"),
        F.coalesce(F.max(F.when(F.col("is_absent"), F.col("run_length"))), F.lit(0)).alias("longest_gap"))


def calendar_edges(scope: ScopedFrame, grain: str = cal.DEFAULT_GRAIN) -> DataFrame:
    """One row: what the data reaches at both ends, undated rows, and a window that opens mid-period."""
    day = scope.date.cast("date")
    window = scope.contract.window
    seen = scope.frame.agg(F.min(day).alias("seen_lo"), F.max(day).alias("seen_hi"),
                           F.count_if(scope.date.isNull()).alias("undated"))
    if window is None:
        no = F.lit(False)
        return seen.select(F.col("seen_lo").alias("lo"), F.col("seen_hi").alias("hi"), "seen_lo",
                           "seen_hi", "undated", no.alias("starts_late"), no.alias("ends_early"),
                           no.alias("opens_mid_period"))
    return seen.select(
        F.lit(window.start).alias("lo"), F.lit(window.end).alias("hi"), "seen_lo", "seen_hi", "undated",
        (F.col("seen_lo") > F.lit(window.start)).alias("starts_late"),
        (F.col("seen_hi") < F.lit(window.end)).alias("ends_early"),
        F.lit(cal.truncated(window.start, grain) != window.start).alias("opens_mid_period"))


@analysis("trend", 3, "A measure per period, optionally split by a dimension.")
def trend(scope: ScopedFrame, measure: str, grain: str = cal.DEFAULT_GRAIN,
          dimension: str | None = None) -> DataFrame:
    grain = cal.check_grain(grain)
    label = cal.label_of(F.col("period"), grain).alias("period")
    if dimension is None:
        return unit_series(scope, measure, grain).select(label, F.col("v0").alias("value"), "rows")
    scope.contract.dimension(dimension)
    m = combinable(scope, measure)
    unit = scope.per_unit(m, [scope.contract.dated(), dimension])
    members = unit.frame.select(F.col(quoted(dimension)).alias("member")).distinct()
    frame = unit.frame.where(unit.date.isNotNull())
    keys = [cal.period_of(unit.date, grain), F.col(quoted(dimension))]
    grouped = totals(frame, m, keys, ["p", "g"])
    # Each member gets its own calendar, so its absent periods are rows too.
    calendar = unit.calendar(grain)
    lo, hi = (cal.period_of(calendar.bounds.select(c).scalar(), grain) for c in ("lo", "hi"))
    slots = members.select("member", F.explode(F.sequence(lo, hi, F.expr(cal.STEPS[grain]))).alias("period"))
    split = slots.join(grouped, (F.col("period") == F.col("p")) & F.col("member").eqNullSafe(F.col("g")), "left")
    whole = series(unit, [m], grain).select(
        label, F.lit(None).cast(members.schema["member"].dataType).alias("member"),
        F.lit(True).alias("is_all"), F.col("v0").alias("value"), "rows")
    return split.select(label, "member", F.lit(False).alias("is_all"), "value",
                        F.coalesce(F.col("rows"), F.lit(0)).alias("rows")).unionByName(whole)


def _position(period: Column, grain: str) -> Column:
    return {"day": F.weekday(period) + 1, "week": F.weekofyear(period),
            "month": F.month(period), "quarter": F.quarter(period)}[grain]


@analysis("seasonality", 3, "A measure folded onto the positions of its cycle.")
def seasonality(scope: ScopedFrame, measure: str, grain: str = cal.DEFAULT_GRAIN) -> DataFrame:
    """Each position is the mean of its periods that hold rows; the index is against all of them."""
    grain = cal.check_grain(grain)
    if grain not in CYCLES:
        raise ParamsInvalid(f"a {grain} repeats inside no longer cycle; use trend")
    held = unit_series(scope, measure, grain)
    folded = held.groupBy(_position(F.col("period"), grain).alias("position")).agg(
        F.avg(F.col("v0").cast("double")).alias("mean"), F.sum(F.col("v0").cast("double")).alias("__sum"),
        F.count("v0").alias("observed"), F.count(F.lit(1)).alias("__slots"), F.sum("rows").alias("rows"))
    every = Window.partitionBy()  # at most 53 positions
    grand = ratio(F.sum("__sum").over(every), F.sum("observed").over(every))
    return folded.select("position", "mean", ratio(F.col("mean"), grand).alias("index"), "observed",
                         (F.col("__slots") - F.col("observed")).alias("absent"), "rows")


def labelled_pair(scope: ScopedFrame, period: str, baseline: str, grain: str):
    """The first days of two named periods, both inside the calendar."""
    grain = cal.check_grain(grain)
    if period == baseline:
        raise ParamsInvalid(f"period and baseline are both {period!r}")
    firsts = [cal.parse_label(x, grain) for x in (baseline, period)]
    lo, hi = scope.bounds()
    for label, first in zip((baseline, period), firsts):
        if lo is None or not cal.truncated(lo, grain) <= first <= cal.truncated(hi, grain):
            raise ParamsInvalid(f"{label!r} is not a {grain} of the calendar, {lo} to {hi}")
    return grain, firsts[0], firsts[1]


def in_periods(scope: ScopedFrame, firsts, grain: str) -> Column:
    """A row of one of the named periods, as literal date ranges the scan can use."""
    test = F.lit(False)
    for first in firsts:
        test = test | ((scope.date >= F.lit(first)) & (scope.date < F.lit(cal.next_period(first, grain))))
    return test


@analysis("period_compare", 3, "A measure in two named periods.")
def period_compare(scope: ScopedFrame, measure: str, period: str, baseline: str,
                   grain: str = cal.DEFAULT_GRAIN) -> DataFrame:
    """Two rows. The change sits on the compared period, blank unless both periods hold rows."""
    grain, base, current = labelled_pair(scope, period, baseline, grain)
    m = combinable(scope, measure)
    unit = scope.per_unit(m, [scope.contract.dated()])
    day = cal.period_of(unit.date, grain)
    rows = unit.entering(unit.frame.where(in_periods(unit, (base, current), grain)))
    grouped = unit.held(totals(rows, m, [day], ["p"]), F.sum("rows"))
    spark = unit.source.sparkSession
    pair = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(first).alias("first"), F.lit(label).alias("period"), F.lit(is_base).alias("is_base"),
                 F.lit((cal.next_period(first, grain) - first).days).alias("days"))
        for first, label, is_base in ((base, baseline, True), (current, period, False))])).alias("s")).select("s.*")
    rows = pair.join(grouped, F.col("first") == F.col("p"), "left").select(
        "period", "is_base", "value", F.coalesce(F.col("rows"), F.lit(0)).alias("rows"), "days")
    two = Window.partitionBy()  # two rows
    was = F.max(F.when(F.col("is_base"), F.col("value"))).over(two)
    delta = F.when(~F.col("is_base"), F.col("value") - was)
    pct = F.when(was > 0, ratio(delta, was))
    return rows.select("period", "value", "rows", "days", delta.alias("delta"), pct.alias("pct"))


def period_gaps(scope: ScopedFrame, period: str, baseline: str, grain: str = cal.DEFAULT_GRAIN) -> DataFrame:
    """period, month: months of either compared period that hold no row, as a change may be theirs alone."""
    grain, base, current = labelled_pair(scope, period, baseline, grain)
    month = F.trunc(scope.date.cast("date"), "month")
    held = scope.frame.where(in_periods(scope, (base, current), grain)).select(month.alias("m")).distinct()
    spans = [F.struct(F.lit(label).alias("period"), F.lit(cal.truncated(first, "month")).alias("lo"), F.date_sub(F.lit(cal.next_period(first, grain)), 1).alias("hi"))
             for label, first in ((baseline, base), (period, current))]
    months = scope.source.sparkSession.range(1).select(F.explode(F.array(*spans)).alias("s")).select(
        "s.period", F.explode(F.sequence("s.lo", F.trunc("s.hi", "month"), F.expr("INTERVAL 1 MONTH"))).alias("m"))
    return months.join(held, "m", "left_anti").select("period", cal.label_of(F.col("m"), "month").alias("month"))


def empty_months(scope: ScopedFrame, today: Column | None = None) -> DataFrame:
    """Months inside the span of the rows' dates, up to today, that hold none."""
    upto = F.current_date() if today is None else today
    day = scope.date.cast("date")
    held = scope.frame.where(scope.date.isNotNull()).groupBy(F.trunc(day, "month").alias("period")).agg(
        F.min(F.when(day <= upto, day)).alias("lo"), F.max(F.when(day <= upto, day)).alias("hi"))
    span = held.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spine = cal.Calendar("month", span).spine()
    return spine.join(held, "period", "left_anti").select(
        cal.label_of(F.col("period"), "month").alias("month"))


@analysis("growth_decomposition", 3, "Each member's part in the change between two periods.")
def growth_decomposition(scope: ScopedFrame, measure: str, dimension: str, period: str, baseline: str,
                         grain: str = cal.DEFAULT_GRAIN) -> DataFrame:
    """A missing member counts zero; the contributions add up to the change by construction."""
    scope.contract.dimension(dimension)
    m = additive(scope, measure)
    grain, base, current = labelled_pair(scope, period, baseline, grain)
    unit = scope.per_unit(m, [scope.contract.dated(), dimension])
    frame = unit.entering(unit.frame.where(in_periods(unit, (base, current), grain)))
    # The base period comes first exactly when a row is before its end.
    is_base = (unit.date >= F.lit(base)) & (unit.date < F.lit(cal.next_period(base, grain)))
    grouped = totals(frame, m, [F.col(quoted(dimension)), is_base], ["member", "is_base"])
    sides = grouped.groupBy("member").agg(
        F.max(F.when(F.col("is_base"), F.col("value"))).alias("base"),
        F.max(F.when(~F.col("is_base"), F.col("value"))).alias("current"),
        F.coalesce(F.sum(F.when(F.col("is_base"), F.col("rows"))), F.lit(0)).alias("base_rows"),
        F.coalesce(F.sum(F.when(~F.col("is_base"), F.col("rows"))), F.lit(0)).alias("current_rows"))
    sides = unit.held(sides, F.sum(F.col("base_rows") + F.col("current_rows")))
    zero = F.lit(0)
    change = F.coalesce(F.col("current"), zero) - F.coalesce(F.col("base"), zero)
    parts = cut(sides.withColumn("change", change))
    whole = parts.agg(F.when((F.sum("base_rows") > 0) & (F.sum("current_rows") > 0),
                             F.sum("change")).alias("net")).scalar()
    state = F.when(F.col("base_rows") == 0, "entered").when(F.col("current_rows") == 0, "left").otherwise("stayed")
    # A period with no rows did not fall to zero, so then there is no change to decompose.
    return parts.where(whole.isNotNull()).select(
        "member", "base", "current", "change", ratio(F.col("change"), whole).alias("share_of_change"),
        state.alias("state"))


def growth_summary(parts: DataFrame) -> DataFrame:
    """Net and gross movement of a decomposition, and how many members rose, fell, came and went."""
    c = F.col("change")
    return parts.agg(F.sum(c).alias("net"), F.sum(F.abs(c)).alias("gross"), F.count_if(c > 0).alias("rose"),
                     F.count_if(c < 0).alias("fell"), F.count_if(F.col("state") == "entered").alias("entered"),
                     F.count_if(F.col("state") == "left").alias("left_out"))
