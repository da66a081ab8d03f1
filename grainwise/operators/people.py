"""Tier 7: who comes back, and when.

Events are first counted per person and day. A person's days are bounded by the calendar, so even
an entity that holds a third of all rows is a small group afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainwise.errors import NotPossible, ParamsInvalid
from grainwise.functions import calendar as cal
from grainwise.functions.exprs import quoted, ratio
from grainwise.functions.ranks import running
from grainwise.registry import analysis
from grainwise.scope import ScopedFrame
from grainwise.session import cut

# The buckets of repeat behaviour, with the most events each one holds.
BUCKETS = ((1, "once"), (2, "twice"), (3, "three times"), (5, "4 to 5 times"))
MORE = "more than 5 times"
COHORT_PERIODS = ("month", "week", "quarter")
LOW_REPEAT = 0.05


def events(scope: ScopedFrame, entity: str, event: str | None = None) -> DataFrame:
    """k, d: one row per event with a person and a moment. An event key takes its earliest moment."""
    scope.contract.dimension(entity)
    day = scope.date
    k = F.col(quoted(entity))
    dated_ = k.isNotNull() & day.isNotNull()
    rows = scope.entering(scope.frame, ~dated_).where(dated_)
    if event is None:
        return rows.select(k.alias("k"), day.alias("d"))
    named = set(scope.contract.dimensions) | {m.name for m in scope.contract.measures}
    if event not in named:
        raise NotPossible(f"{event} is not declared, so it cannot be the event key")
    e = F.col(quoted(event))
    return (rows.where(e.isNotNull()).groupBy(k.alias("k"), e.alias("e")).agg(F.min(day).alias("d")).select("k", "d"))


def person_days(scope: ScopedFrame, entity: str, event: str | None = None) -> DataFrame:
    """k, day, n: events per person and day."""
    return events(scope, entity, event).groupBy("k", F.col("d").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"))


def _check_entity(scope: ScopedFrame, entity: str) -> dict:
    """Refuse a key that is distinct per row, or whose every value has a single moment.

    One pass: events, people, people seen at more than one moment, and the rows left aside.
    """
    k, d = F.col(quoted(entity)), scope.date
    per = scope.frame.groupBy(k.alias("k")).agg(
        F.count(d).alias("n"), F.count(F.lit(1)).alias("rows"), F.min(d).alias("lo"), F.max(d).alias("hi"))
    here = F.col("k").isNotNull() & (F.col("n") > 0)
    row = per.agg(
        F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias("events"), F.count_if(here).alias("people"),
        F.count_if(here & (F.col("lo") < F.col("hi"))).alias("returned"),
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("rows"))), F.lit(0)).alias("no_entity"),
        F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("rows") - F.col("n"))), F.lit(0)).alias("no_date"),
    ).first().asDict()
    if row["events"] and row["people"] == row["events"]:
        raise NotPossible(f"{entity} is distinct on every row, so it names events, not people")
    if row["events"] and not row["returned"]:
        raise NotPossible(f"no value of {entity} appears at more than one moment, so it names events")
    return row


@analysis("repeat_behaviour", 7, "How many people come once and how many come back.")
def repeat_behaviour(scope: ScopedFrame, entity: str, event: str | None = None) -> DataFrame:
    """bucket, people, share, events. The distribution is counted twice over, people then counts."""
    _check_entity(scope, entity)
    per = events(scope, entity, event).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    if event is None:  # rows of one event key are one event
        per = scope.held(per, F.sum("n"))
    spread = per.groupBy("n").agg(F.count(F.lit(1)).alias("people"))
    chain = None
    for most, word in BUCKETS:
        test = F.col("n") <= most
        chain = F.when(test, word) if chain is None else chain.when(test, word)
    bucketed = spread.groupBy(chain.otherwise(MORE).alias("bucket")).agg(
        F.sum("people").alias("people"), F.sum(F.col("people") * F.col("n")).alias("events"))
    every = Window.partitionBy()  # five buckets
    return bucketed.select("bucket", "people", ratio(F.col("people"), F.sum("people").over(every)).alias("share"), "events")


def repeat_summary(scope: ScopedFrame, entity: str, event: str | None = None) -> DataFrame:
    """One row: people, events, repeat rate, busiest count, median events, and both median gaps."""
    _check_entity(scope, entity)
    days = cut(person_days(scope, entity, event))
    per = days.groupBy("k").agg(F.sum("n").alias("n"))
    spread = per.groupBy("n").agg(F.count(F.lit(1)).alias("people"))
    placed = running(spread, [("n", False)], {"before": "people"}).withColumn("upto", F.col("before") + F.col("people"))
    middle = placed.withColumn("half", F.floor((F.col("before_whole") + 1) / 2))
    summary = middle.agg(
        F.sum("people").alias("people"), F.sum(F.col("people") * F.col("n")).alias("events"),
        ratio(F.sum(F.when(F.col("n") > 1, F.col("people")).otherwise(0)), F.sum("people")).alias("repeat_rate"),
        F.max("n").alias("busiest"), F.min(F.when(F.col("upto") >= F.col("half"), F.col("n"))).alias("median_events"))
    return summary.withColumns({
        "first_gap": _median_gap(_first_gaps(days)).select("days").scalar(),
        "consecutive_gap": _median_gap(_consecutive_gaps(days)).select("days").scalar()})


def _first_gaps(days: DataFrame) -> DataFrame:
    """gap, n: days from each person's first event to their second."""
    order = Window.partitionBy("k").orderBy("day")
    first = days.withColumns({"seq": F.row_number().over(order), "next": F.lead("day").over(order)}).where("seq = 1")
    gap = F.when(F.col("n") > 1, F.lit(0)).otherwise(F.datediff("next", "day"))
    return first.select(gap.alias("gap"), F.lit(1).cast("long").alias("n")).where(F.col("gap").isNotNull())


def _consecutive_gaps(days: DataFrame) -> DataFrame:
    """gap, n: days between each event and the person's one before it. Events of one day are 0 apart."""
    order = Window.partitionBy("k").orderBy("day")
    stepped = days.withColumn("gap", F.datediff("day", F.lag("day").over(order)))
    both = F.array(F.struct(F.lit(0).alias("gap"), (F.col("n") - 1).alias("n")),
                   F.struct(F.col("gap").alias("gap"), F.lit(1).cast("long").alias("n")))
    opened = stepped.select(F.explode(both).alias("s")).select("s.*")
    return opened.where(F.col("gap").isNotNull() & (F.col("n") > 0))


def _median_gap(gaps: DataFrame) -> DataFrame:
    """The median of (gap, n) rows. Distinct gaps are bounded by the days of the calendar."""
    counted = gaps.groupBy("gap").agg(F.sum("n").alias("n"))
    return counted.agg(F.percentile("gap", F.lit(0.5), F.col("n")).alias("days"), F.sum("n").alias("gaps"))


def repeat_first_gap(scope: ScopedFrame, entity: str, event: str | None = None) -> DataFrame:
    return _median_gap(_first_gaps(person_days(scope, entity, event)))


def repeat_consecutive_gap(scope: ScopedFrame, entity: str, event: str | None = None) -> DataFrame:
    return _median_gap(_consecutive_gaps(person_days(scope, entity, event)))


def _offset(start, period, grain: str):
    if grain == "week":
        return F.floor(F.datediff(period, start) / 7)
    months = (F.year(period) - F.year(start)) * 12 + F.month(period) - F.month(start)
    return months if grain == "month" else F.floor(months / 3)


@analysis("cohort_retention", 7, "People per first period and periods since.")
def cohort_retention(scope: ScopedFrame, entity: str, period: str = "month") -> DataFrame:
    """Long form. A person's periods are one bounded set, so people shuffle once."""
    if period not in COHORT_PERIODS:
        raise ParamsInvalid(f"period must be one of {', '.join(COHORT_PERIODS)}; got {period!r}")
    _check_entity(scope, entity)
    k = F.col(quoted(entity))
    known = k.isNotNull() & scope.date.isNotNull()
    active = scope.entering(scope.frame, ~known).where(known).groupBy(k.alias("k")).agg(
        F.collect_set(cal.period_of(scope.date, period)).alias("periods"), F.count(F.lit(1)).alias("rows"))
    active = scope.held(active, F.sum("rows"))
    cells = active.select(F.array_min("periods").alias("cohort"), F.explode("periods").alias("p"))
    counted = cells.groupBy("cohort", _offset(F.col("cohort"), F.col("p"), period).cast("int").alias("offset")).agg(
        F.count(F.lit(1)).alias("people"))
    size = F.max(F.when(F.col("offset") == 0, F.col("people"))).over(Window.partitionBy("cohort"))
    return counted.select("cohort", size.alias("cohort_size"), "offset", "people")


def check_entity(scope: ScopedFrame, entity: str) -> dict:
    return _check_entity(scope, entity)


def returning(scope: ScopedFrame, entity: str, period: str = "month") -> DataFrame:
    """One row beside `cohort_retention`: people, those active in more than one period, their share, and whether that is low."""
    if period not in COHORT_PERIODS:
        raise ParamsInvalid(f"period must be one of {', '.join(COHORT_PERIODS)}; got {period!r}")
    _check_entity(scope, entity)
    k = F.col(quoted(entity))
    p = cal.period_of(scope.date, period)
    per = scope.frame.where(k.isNotNull() & scope.date.isNotNull()).groupBy(k.alias("k")).agg(F.min(p).alias("lo"), F.max(p).alias("hi"))
    rate = ratio(F.col("returned"), F.col("people"))
    return per.agg(F.count(F.lit(1)).alias("people"), F.count_if(F.col("lo") < F.col("hi")).alias("returned")).select(
        "people", "returned", rate.alias("rate"), (rate < LOW_REPEAT).alias("is_low"))
