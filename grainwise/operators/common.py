"""What several analyses need of a measure: its totals by group, and when a share means anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.contract import Measure
from grainwise.errors import NotPossible, TooManyGroups
from grainwise.functions.exprs import declared, finite_only, finite_value, quoted, ratio, summable
from grainwise.functions.ranks import quantiles
from grainwise.scope import ScopedFrame

#: Members a column-per-member table can show beside its total.
MAX_GROUPS = 49


def combinable(scope: ScopedFrame, measure: str) -> Measure:
    """A measure with a declared way to combine rows."""
    m = scope.contract.measure(measure)
    if not m.is_ratio and m.agg in (None, "none"):
        raise NotPossible(f"{measure} declares agg={m.agg}, so no total of it means anything")
    return m


def valued(scope: ScopedFrame, measure: str) -> Measure:
    """A measure with a value on each row, which a ratio of sums has not."""
    m = scope.contract.measure(measure)
    if m.is_ratio:
        raise NotPossible(f"{measure} is a ratio of sums and has no value per row")
    return m


def additive(scope: ScopedFrame, measure: str) -> Measure:
    m = combinable(scope, measure)
    if not m.additive:
        raise NotPossible(f"{m.agg or 'ratio'} of {measure} does not add up across groups")
    return m


def totals(frame: DataFrame, m: Measure, keys: list[Column],
           names: list[str]) -> DataFrame:
    """`names`, value, rows: the declared aggregate per group, NULL kept as a group."""
    keyed = frame.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(keys)])
    held = [f"__k{i}" for i in range(len(keys))]
    if m.agg == "median":
        values = keyed.withColumn("__v", finite_value(keyed, m.name))
        medians = quantiles(values, "__v", [0.5], tuple(held))
        counted = keyed.groupBy(*held).agg(F.count(F.lit(1)).alias("rows"))
        same = F.lit(True)
        for h in held:
            same = same & counted[h].eqNullSafe(medians[h])
        grouped = (counted.join(medians, same, "left")
                   .select(*[counted[h] for h in held], F.col("q")[0].alias("value"), "rows"))
    else:
        grouped = keyed.groupBy(*held).agg(declared(keyed, m).alias("value"),
                                           F.count(F.lit(1)).alias("rows"))
    return grouped.select(*[F.col(h).alias(n) for h, n in zip(held, names)], "value", "rows")


def share_of(grouped: DataFrame, value: str, m: Measure) -> Column:
    """Each group's share of the whole, or NULL where a share would mean nothing.

    Only sums and counts share; a group below zero or a whole of zero leaves every share blank.
    The whole is a scalar subquery over the grouped rows.
    """
    if not m.additive:
        return F.lit(None).cast("double")
    whole = grouped.agg(
        F.when(count_below_zero(value) == 0, F.sum(value)).alias("whole")).scalar()
    return F.when(whole > 0, ratio(F.col(value), whole))


def count_below_zero(value: str) -> Column:
    return F.count_if(F.coalesce(F.col(value) < 0, F.lit(False)))


def cap_groups(members: DataFrame, dimension: str) -> list:
    """The members of a dimension, refused beyond what a column-per-member table can show."""
    found = [r[0] for r in members.limit(MAX_GROUPS + 1).collect()]
    if len(found) > MAX_GROUPS:
        raise TooManyGroups(f"{dimension} has more than {MAX_GROUPS} groups; top_n says which matter")
    return sorted(found, key=lambda v: (v is None, str(v)))


def mergeable(frame: DataFrame, m: Measure) -> tuple[list[Column], Column] | None:
    """Partial aggregates that can be rolled up again, and the roll-up. None when there are none."""
    if m.is_ratio:
        parts = [F.sum(finite_only(frame, f"{m.name}__{k}")).alias(f"__p{i}") for i, k in enumerate("nd")]
        return parts, F.lit(float(m.scale)) * ratio(F.sum("__p0"), F.sum("__p1"))
    c = F.col(quoted(m.name))
    if m.agg == "sum":
        return [F.sum(summable(frame, m.name)).alias("__p0")], F.sum("__p0")
    if m.agg == "count":
        return [F.count(c).alias("__p0")], F.sum("__p0")
    if m.agg == "mean":
        v = finite_value(frame, m.name)
        parts = [F.sum(v).alias("__p0"), F.count(v).alias("__p1")]
        return parts, ratio(F.sum("__p0"), F.sum("__p1"))
    if m.agg in ("min", "max"):
        pick = {"min": F.min, "max": F.max}[m.agg]
        return [pick(finite_only(frame, m.name)).alias("__p0")], pick("__p0")
    return None
