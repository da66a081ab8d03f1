"""Tier 5: what stands out, in time or in value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainwise.errors import ParamsInvalid
from grainwise.functions import calendar as cal
from grainwise.functions.exprs import finite_value, quoted, ratio
from grainwise.functions.ranks import quantiles
from grainwise.operators.common import combinable, valued
from grainwise.operators.time import series, unit_series
from grainwise.registry import analysis
from grainwise.scope import ScopedFrame
from grainwise.session import cut

# Periods a side must hold, the separation called clear, and the outlier fences.
MIN_SEGMENT = 3
SEPARATION = 2.0
IQR_FENCE = 1.5
DEVIATIONS = 3.0
MAD_TO_SIGMA = 1.4826
MIN_VALUES = 8
TOLERANCE = 1


def splits(spine: DataFrame, value: str, rows: str = "rows") -> DataFrame:
    """Every admissible split of a series, from running sums over its periods.

    The windows are over calendar periods, so their length does not grow with the table. Values are
    taken about their mean before squaring, which keeps the spread exact.
    """
    order = Window.orderBy("period")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    every = Window.partitionBy()
    held = F.col(rows) > 0
    v = F.when(held, F.col(value).cast("double"))
    base = spine.withColumns({"__held": held, "__v": v}).withColumn("__m", F.avg("__v").over(every))
    base = base.withColumn("__c", F.col("__v") - F.col("__m"))
    sums = {}
    for side, w in (("before", upto), ("after", after)):
        sums[f"n_{side}"] = F.sum(F.col("__held").cast("int")).over(w)
        sums[f"__s_{side}"] = F.sum("__c").over(w)
        sums[f"__q_{side}"] = F.sum(F.col("__c") * F.col("__c")).over(w)
    sums["__next"] = F.lead("__held").over(order)
    sums["slot"] = F.row_number().over(order)
    s = base.withColumns(sums)
    mean = {k: F.col("__m") + ratio(F.col(f"__s_{k}"), F.col(f"n_{k}")) for k in ("before", "after")}
    spread = sum((F.col(f"__q_{k}") - ratio(F.col(f"__s_{k}") * F.col(f"__s_{k}"), F.col(f"n_{k}"))
                  for k in ("before", "after")), F.lit(0.0))
    free = F.col("n_before") + F.col("n_after") - 2
    within = F.sqrt(F.greatest(ratio(spread, free), F.lit(0.0)))
    admissible = ((F.col("n_before") >= MIN_SEGMENT) & (F.col("n_after") >= MIN_SEGMENT)
                  & F.col("__held") & F.col("__next"))
    out = s.where(admissible).withColumns({"mean_before": mean["before"], "mean_after": mean["after"]})
    out = out.withColumn("difference", F.col("mean_after") - F.col("mean_before"))
    # A spread of rounding dust is no spread.
    solid = spread > F.lit(1e-18) * F.greatest(F.col("__q_before") + F.col("__q_after"), F.lit(1e-300))
    return out.select("period", "slot", "n_before", "n_after", "mean_before", "mean_after", "difference",
                      F.when(solid, F.try_divide(F.abs("difference"), within)).alias("spread_ratio"))


@analysis("changepoint", 5, "Where a measure changes level, with every admissible split.")
def changepoint(scope: ScopedFrame, measure: str, grain: str = cal.DEFAULT_GRAIN) -> DataFrame:
    grain = cal.check_grain(grain)
    found = splits(unit_series(scope, measure, grain), "v0")
    return found.select(cal.label_of(F.col("period"), grain).alias("split_after"), "n_before", "n_after",
                        "mean_before", "mean_after", "difference", "spread_ratio",
                        (F.col("spread_ratio") >= SEPARATION).alias("is_clear"))


@analysis("correlated_shift", 5, "Whether two measures change level at the same place.")
def correlated_shift(scope: ScopedFrame, measure: str, against: str,
                     grain: str = cal.DEFAULT_GRAIN) -> DataFrame:
    """A period counts only where both measures have values on the same rows."""
    grain = cal.check_grain(grain)
    if measure == against:
        raise ParamsInvalid(f"measure and against are both {measure!r}")
    pair = [combinable(scope, measure), combinable(scope, against)]
    unit = scope
    for m in pair:
        if m.per:
            unit = unit.per_unit(m, [scope.contract.dated(), measure, against])
    both = F.lit(True)
    for m in pair:
        for c in ([f"{m.name}__n", f"{m.name}__d"] if m.is_ratio else [m.name]):
            both = both & F.col(quoted(c)).isNotNull()
    spine = cut(series(unit, pair, grain, only=both))
    parts = None
    for i, m in enumerate(pair):
        found = splits(spine, f"v{i}").withColumn("series", F.lit(m.name))
        parts = found if parts is None else parts.unionByName(found)
    best = Window.partitionBy("series").orderBy(F.abs("difference").desc(), F.col("slot"))
    top = parts.withColumns({"__rank": F.row_number().over(best),
                             "admissible": F.count(F.lit(1)).over(Window.partitionBy("series"))})
    one = top.where(F.col("__rank") == 1)
    apart = F.max("slot").over(Window.partitionBy()) - F.min("slot").over(Window.partitionBy())
    chance = F.least(F.lit(1.0), ratio(F.lit(2 * TOLERANCE + 1), F.col("admissible")))
    return one.select("series", cal.label_of(F.col("period"), grain).alias("split_after"), "difference",
                      F.col("spread_ratio").alias("separation"), "admissible", chance.alias("chance"),
                      (apart <= TOLERANCE).alias("coincide"))


def _fences(q: Column, mean: Column, sd: Column, mad: Column) -> list[tuple[str, Column, Column]]:
    iqr = q[2] - q[0]
    robust = F.when(mad > 0, F.lit(DEVIATIONS * MAD_TO_SIGMA) * mad)
    classic = F.when(sd > 0, F.lit(DEVIATIONS) * sd)
    return [("tukey", q[0] - IQR_FENCE * iqr, q[2] + IQR_FENCE * iqr),
            ("zscore", mean - classic, mean + classic), ("mad", q[1] - robust, q[1] + robust)]


def _values(scope: ScopedFrame, measure: str, dimension: str | None):
    m = valued(scope, measure)
    unit = scope.per_unit(m, [dimension] if dimension else [])
    f = unit.frame
    member = [F.col(quoted(dimension)).alias("member")] if dimension else []
    rows = unit.entering(f.select(*member, finite_value(f, measure).alias("v")), F.col("v").isNull())
    return unit, rows.where(F.col("v").isNotNull())


@analysis("outlier_detection", 5, "Unusual values by Tukey's fence, z-score and MAD.")
def outlier_detection(scope: ScopedFrame, measure: str, dimension: str | None = None) -> DataFrame:
    if dimension is not None:
        return outliers_within(scope, measure, dimension)
    unit, values = _values(scope, measure, None)
    stats = values.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd")).first()
    counts = cut(unit.held(values.groupBy("v").agg(F.count(F.lit(1)).alias("rows")), F.sum("rows")))  # all that follows reads the counted values
    q = quantiles(counts, "v", [0.25, 0.5, 0.75], n="rows").first()
    n = stats["n"]
    if n < MIN_VALUES:
        return values.select(F.lit("").alias("method"), F.col("v").alias("lower"), F.col("v").alias("upper"),
                             F.lit(n).alias("flagged"), F.col("v").alias("share")).limit(0)
    away = counts.select(F.abs(F.col("v") - F.lit(q["q"][1])).alias("v"), "rows")
    mad = quantiles(away, "v", [0.5], n="rows").first()["q"][0]
    array = F.array(*[F.lit(x) for x in q["q"]])
    fences = _fences(array, F.lit(stats["mean"]), F.lit(stats["sd"]), F.lit(mad))
    outside = [(F.col("v") < lo) | (F.col("v") > hi) for _, lo, hi in fences]
    counted = counts.agg(*[F.coalesce(F.sum(F.when(o, F.col("rows"))), F.lit(0)).alias(f"f{i}") for i, o in enumerate(outside)])
    rows = [F.struct(F.lit(name).alias("method"), lo.alias("lower"), hi.alias("upper"),
                     F.when(lo.isNotNull(), F.col(f"f{i}")).alias("flagged"),
                     F.when(lo.isNotNull(), ratio(F.col(f"f{i}"), F.lit(n))).alias("share"))
            for i, (name, lo, hi) in enumerate(fences)]
    return counted.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def outlier_agreement(scope: ScopedFrame, measure: str) -> DataFrame:
    """How many values one, two or all three methods flag."""
    bounds = outlier_detection(scope, measure).collect()  # three rows
    _, values = _values(scope, measure, None)
    flags = F.lit(0)
    for b in bounds:
        if b["lower"] is not None:
            flags = flags + ((F.col("v") < b["lower"]) | (F.col("v") > b["upper"])).cast("int")
    return (values.select(flags.alias("methods")).where(F.col("methods") > 0)
            .groupBy("methods").agg(F.count(F.lit(1)).alias("rows")))


def outliers_beside_all(scope: ScopedFrame, measure: str, dimension: str) -> DataFrame:
    """member, n, own, overall, both: values each member's own fence flags, the fence over all rows flags, and both do."""
    scope.contract.dimension(dimension)
    _, values = _values(scope, measure, dimension)
    counts = cut(values.groupBy("member", "v").agg(F.count(F.lit(1)).alias("rows")))
    whole = quantiles(counts.groupBy("v").agg(F.sum("rows").alias("rows")), "v", [0.25, 0.75], n="rows").first()["q"]
    own = quantiles(counts, "v", [0.25, 0.75], ("member",), "rows").select(F.col("member").alias("g"), "q")
    reach = lambda lo, hi: (lo - IQR_FENCE * (hi - lo), hi + IQR_FENCE * (hi - lo))
    beyond = lambda ends: F.coalesce((F.col("v") < ends[0]) | (F.col("v") > ends[1]), F.lit(False))
    here, over = beyond(reach(F.col("q")[0], F.col("q")[1])), beyond(reach(*map(F.lit, whole or (None, None))))
    judged = counts.join(own, F.col("member").eqNullSafe(F.col("g")))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("rows"))), F.lit(0))
    return judged.groupBy("member").agg(F.sum("rows").alias("n"), total(here).alias("own"), total(over).alias("overall"), total(here & over).alias("both"))


def outliers_within(scope: ScopedFrame, measure: str, dimension: str) -> DataFrame:
    """The same fences within each member, however many there are."""
    scope.contract.dimension(dimension)
    unit, values = _values(scope, measure, dimension)
    stats = values.groupBy("member").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    stats = cut(unit.held(stats, F.sum("n")))
    q = quantiles(values, "v", [0.25, 0.5, 0.75], ("member",))
    known = cut(stats.join(q.withColumnRenamed("member", "__m"), F.col("member").eqNullSafe(F.col("__m")))
                .drop("__m").withColumnRenamed("member", "g"))
    near = values.join(known, F.col("member").eqNullSafe(F.col("g")))
    away = near.select(F.col("g"), F.abs(F.col("v") - F.col("q")[1]).alias("d"))
    mad = quantiles(away, "d", [0.5], ("g",)).select(
        F.col("g").alias("__g"), F.col("q")[0].alias("mad"))
    bounds = cut(known.join(mad, F.col("g").eqNullSafe(F.col("__g"))).drop("__g"))
    judged = values.join(bounds, F.col("member").eqNullSafe(F.col("g")))
    fences = _fences(F.col("q"), F.col("mean"), F.col("sd"), F.col("mad"))
    outside = [F.count_if(F.coalesce((F.col("v") < lo) | (F.col("v") > hi), F.lit(False))).alias(name)
               for name, lo, hi in fences]
    lower, upper = fences[0][1], fences[0][2]
    flagged = judged.groupBy("g").agg(F.first("n").alias("n"), F.first(lower).alias("lower"),
                                      F.first(upper).alias("upper"), *outside)
    enough = F.col("n") >= MIN_VALUES
    return flagged.select(F.col("g").alias("member"), "n",
                          *[F.when(enough, F.col(c)).alias(c) for c in ("lower", "upper", "tukey", "zscore", "mad")])
