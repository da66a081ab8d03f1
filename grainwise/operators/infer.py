"""Tier 6: inference. Groups are folded by Spark, however many there are: one row of sums reaches the driver, and its tail is one number.

Intervals stay one row a group; their quantiles are columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.contract import is_number
from grainwise.errors import NotPossible, ParamsInvalid
from grainwise.functions import tails
from grainwise.functions.exprs import finite, finite_value, quoted, ratio, type_of
from grainwise.functions.moments import sample_kurtosis, sample_skewness
from grainwise.functions.ranks import midranks
from grainwise.functions.tail_columns import t_quantile
from grainwise.operators.common import valued
from grainwise.registry import analysis
from grainwise.scope import ScopedFrame
from grainwise.session import cut

# Cohen's conventional bands for each effect size, and the targets of a size plan.
COHEN = {
    "hedges_g": ((0.2, "small"), (0.5, "medium"), (0.8, "large")),
    "eta_squared": ((0.01, "small"), (0.06, "medium"), (0.14, "large")),
    "cramers_v": ((0.1, "small"), (0.3, "medium"), (0.5, "large")),
}
TARGETS = ((0.2, "small"), (0.5, "medium"), (0.8, "large"))
METHODS = ("auto", "parametric", "rank")
_RESULT = "test string, statistic double, df1 double, df2 double, effect double, p double, smallest_expected double"


@dataclass(frozen=True)
class Group:
    name: object
    n: int
    mean: float
    variance: float | None
    skewness: float | None
    kurtosis: float | None


def group_moments(scope: ScopedFrame, dimension: str, measure: str) -> DataFrame:
    """n, mean, sample variance, skewness and kurtosis per group; rows without either are left out."""
    unit, f = _usable(scope, dimension, measure)
    usable = F.col(quoted(dimension)).isNotNull() & finite(f, measure)
    kept = unit.entering(f, ~usable).where(usable).select(F.col(quoted(dimension)).alias("member"), finite_value(f, measure).alias("v"))
    v = F.col("v")
    groups = kept.groupBy("member").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"),
        sample_skewness(v).alias("skewness"), sample_kurtosis(v).alias("kurtosis"))
    return unit.held(groups, F.sum("n"))


def _usable(scope: ScopedFrame, dimension: str, measure: str):
    scope.contract.dimension(dimension)
    m = valued(scope, measure)
    unit = scope.per_unit(m, [dimension])
    if not is_number(type_of(unit.frame, measure)):
        raise NotPossible(f"{measure} is not numeric")
    return unit, unit.frame


def set_aside(scope: ScopedFrame, dimension: str, measure: str) -> DataFrame:
    """Analysed rows no group holds: no member, no value, or a value that is not finite."""
    _, f = _usable(scope, dimension, measure)
    d, c = F.col(quoted(dimension)), F.col(quoted(measure))
    return f.agg(F.count_if(d.isNull()).alias("no_group"),
                 F.count_if(d.isNotNull() & c.isNull()).alias("no_value"),
                 F.count_if(d.isNotNull() & c.isNotNull() & ~finite(f, measure)).alias("not_finite"))


@dataclass(frozen=True)
class Fold:
    """All groups of a comparison as one row: how many, how many of one row, the sums of squares, and the first and last by name."""

    groups: int
    lonely: int
    total: int
    between: float
    within: float
    first: Group | None
    last: Group | None


def fold(scope: ScopedFrame, dimension: str, measure: str) -> Fold:
    """Group moments folded in one job; the groups themselves stay where they are."""
    # Written once: the grand mean and the sums around it read the groups, not the table.
    held = cut(group_moments(scope, dimension, measure).select("member", "n", "mean", "variance"))
    n, mean = F.col("n"), F.col("mean")
    grand = held.agg(F.sum(n * mean) / F.sum(n)).scalar()
    one = F.struct("member", "n", "mean", "variance")
    row = held.agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("variance").isNull()).alias("lonely"), F.sum("n").alias("total"),
        F.sum(n * (mean - grand) * (mean - grand)).alias("between"), F.sum((n - 1) * F.coalesce("variance", F.lit(0.0))).alias("within"),
        F.min_by(one, "member").alias("first"), F.max_by(one, "member").alias("last")).first()
    ends = [Group(x["member"], x["n"], x["mean"], x["variance"], None, None) if x else None for x in (row["first"], row["last"])]
    return Fold(row["groups"], row["lonely"], row["total"] or 0, row["between"] or 0.0, row["within"] or 0.0, *ends)


def _one(scope: ScopedFrame, *values) -> DataFrame:
    """One result row as literals."""
    names = [c.split(" ") for c in _RESULT.split(", ")]
    row = [F.lit(v).cast(t).alias(n) for v, (n, t) in zip(values, names)]
    return scope.source.sparkSession.range(1).select(*row)


def welch(a: Group, b: Group) -> tuple[float, float, float]:
    """t, fractional degrees of freedom, two-sided p."""
    sa, sb = a.variance / a.n, b.variance / b.n
    if sa + sb == 0:
        raise NotPossible("both groups have zero variance")
    t = (a.mean - b.mean) / math.sqrt(sa + sb)
    df = (sa + sb) ** 2 / (sa ** 2 / (a.n - 1) + sb ** 2 / (b.n - 1))
    return t, df, 2 * tails.t_sf(abs(t), df)


def anova(f: Fold) -> tuple[float, int, int, float]:
    d1, d2 = f.groups - 1, f.total - f.groups
    if f.within == 0 or d2 <= 0:
        raise NotPossible("no group varies")
    statistic = (f.between / d1) / (f.within / d2)
    return statistic, d1, d2, tails.f_sf(statistic, d1, d2)


def hedges(a: Group, b: Group) -> float | None:
    pooled = pooled_sd(a, b)
    if not pooled:
        return None
    return (a.mean - b.mean) / pooled * (1 - 3 / (4 * (a.n + b.n - 2) - 1))


def pooled_sd(a: Group, b: Group) -> float:
    return math.sqrt(((a.n - 1) * a.variance + (b.n - 1) * b.variance) / (a.n + b.n - 2))


def eta(f: Fold) -> float:
    return f.between / (f.between + f.within) if f.between + f.within else 0.0


@dataclass(frozen=True)
class RankSums:
    """Midranks folded: rows, the tie term, groups, the sum of (rank sum squared / size), and the first group's rank sum and size."""

    n: int
    ties: float
    groups: int
    squares: float
    first_sum: float
    first_n: int


def rank_sums(scope: ScopedFrame, dimension: str, measure: str) -> RankSums:
    """Midrank sums per group, for any number of groups, without joining ranks back to rows.

    Rows are counted per value and group first, so a value a third of the rows share is one row a group; ranks are read over
    the distinct values and meet those counts.
    """
    _, f = _usable(scope, dimension, measure)
    kept = f.where(F.col(quoted(dimension)).isNotNull() & finite(f, measure)).select(
        F.col(quoted(dimension)).alias("member"), finite_value(f, measure).alias("v"))
    counted = cut(kept.groupBy("v", "member").agg(F.count(F.lit(1)).alias("m")))
    placed = cut(midranks(counted.groupBy("v").agg(F.sum("m").alias("n")), "v", "n").select("v", "n", "midrank"))
    per = counted.join(placed, "v").groupBy("member").agg(F.sum(F.col("m") * F.col("midrank")).alias("r"), F.sum("m").alias("m"))
    n = F.col("n").cast("double")
    whole = placed.agg(F.sum("n").alias("n"), F.sum(n * n * n - n).alias("ties")).first()
    row = per.agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("r") * F.col("r") / F.col("m")).alias("squares"),
                  F.min_by(F.struct("r", "m"), "member").alias("first")).first()
    return RankSums(whole["n"], whole["ties"], row["groups"], row["squares"], row["first"]["r"], row["first"]["m"])


def mann_whitney(ranks: RankSums) -> tuple[float, float]:
    """U of the first of two groups and a two-sided p, corrected for ties and continuity."""
    n, n1 = ranks.n, ranks.first_n
    n2 = n - n1
    u = ranks.first_sum - n1 * (n1 + 1) / 2
    spread = n1 * n2 / 12 * ((n + 1) - ranks.ties / (n * (n - 1)))
    if spread <= 0:
        raise NotPossible("every value is tied")
    z = (abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(spread)
    return u, min(1.0, 2 * tails.normal_sf(z))


def kruskal(ranks: RankSums) -> tuple[float, int, float]:
    n = ranks.n
    correction = 1 - ranks.ties / (n ** 3 - n)
    if correction <= 0:
        raise NotPossible("every value is tied")
    h = (12 / (n * (n + 1)) * ranks.squares - 3 * (n + 1)) / correction
    df = ranks.groups - 1
    return h, df, tails.chi2_sf(max(h, 0.0), df)


@dataclass(frozen=True)
class Association:
    """A chi-square test of two dimensions: statistic (Yates-corrected on 2x2), df, Cramer's V, p, smallest expected count."""

    statistic: float
    df: int
    v: float
    p: float
    smallest: float


def associated(scope: ScopedFrame, dimension: str, second: str) -> Association:
    """Chi-square from the cells that occur and the margins, so absent cells need no table of all combinations.

    A cell that occurs adds (seen - expected)^2 / expected; all absent ones together add what is left of the expected counts. Rows
    without either member are left out.
    """
    for d in (dimension, second):
        scope.contract.dimension(d)
    if dimension == second:
        raise ParamsInvalid("a dimension cannot be tested against itself")
    a, b = F.col(quoted(dimension)), F.col(quoted(second))
    named = a.isNotNull() & b.isNotNull()
    cells = scope.entering(scope.frame, ~named).where(named).groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    cells = cut(scope.held(cells, F.sum("n")))
    rows = cells.groupBy("a").agg(F.sum("n").alias("row"))
    columns = cells.groupBy("b").agg(F.sum("n").alias("column"))
    ends = [m.agg(F.count(F.lit(1)).alias("k"), F.min(c).alias("least"), F.max(c).alias("most"), F.sum(c).alias("n")).first()
            for m, c in ((rows, "row"), (columns, "column"))]
    (r, c), n = (x["k"] for x in ends), ends[0]["n"]
    if r < 2 or c < 2:
        raise NotPossible(f"a {r}x{c} table has nothing to compare")
    smallest = ends[0]["least"] * ends[1]["least"] / n
    expected = F.col("row").cast("double") * F.col("column") / F.lit(n)
    gap = F.abs(F.col("n") - expected)
    met = cells.join(rows, "a").join(columns, "b")
    sums = met.agg(F.sum(gap * gap / expected).alias("seen"), F.sum(expected).alias("expected"), F.max(gap).alias("gap")).first()
    statistic = sums["seen"] + max(n - sums["expected"], 0.0)
    if r == 2 and c == 2:
        # All four cells are as far from what is expected of them.
        off = sums["gap"] - min(0.5, sums["gap"])
        statistic = off * off * n * math.prod(1 / x["least"] + 1 / x["most"] for x in ends)
    df = (r - 1) * (c - 1)
    return Association(statistic, df, math.sqrt(statistic / (n * (min(r, c) - 1))), tails.chi2_sf(statistic, df), smallest)


@analysis("hypothesis_test", 6, "Whether groups differ, or two dimensions are related.", selects=True)
def hypothesis_test(scope: ScopedFrame, dimension: str, measure: str | None = None,
                    second_dimension: str | None = None, method: str = "auto") -> DataFrame:
    if (measure is None) == (second_dimension is None):
        raise ParamsInvalid("pass exactly one of measure and second_dimension")
    if method not in METHODS:
        raise ParamsInvalid(f"method must be one of {', '.join(METHODS)}")
    if second_dimension is not None:
        if method == "rank":
            raise ParamsInvalid("two dimensions are compared by chi-square, not by rank")
        t = associated(scope, dimension, second_dimension)
        return _one(scope, "chi_square", t.statistic, t.df, None, t.v, t.p, t.smallest)
    f = fold(scope, dimension, measure)
    if f.groups < 2:
        raise NotPossible(f"{dimension} has {f.groups} group(s); a comparison needs two")
    if method == "rank" or (method == "auto" and f.lonely):
        ranks = rank_sums(scope, dimension, measure)
        if f.groups == 2:
            u, p = mann_whitney(ranks)
            return _one(scope, "mann_whitney", u, None, None, None, p, None)
        h, df, p = kruskal(ranks)
        return _one(scope, "kruskal_wallis", h, df, None, eta(f), p, None)
    if f.lonely:
        raise NotPossible(f"{f.lonely} group(s) of {dimension} hold one row and so have no spread")
    if f.groups == 2:
        t, df, p = welch(f.first, f.last)
        return _one(scope, "welch_t", t, df, None, hedges(f.first, f.last), p, None)
    statistic, d1, d2, p = anova(f)
    return _one(scope, "anova", statistic, d1, d2, eta(f), p, None)


@analysis("confidence_interval", 6, "Intervals around means or around shares.", selects=True)
def confidence_interval(scope: ScopedFrame, dimension: str | None = None, measure: str | None = None,
                        confidence: float = 0.95) -> DataFrame:
    """Student's t around a mean; Wilson around each group's share when no measure is named."""
    if not 0.5 <= confidence < 1:
        raise ParamsInvalid(f"confidence must be at least 0.5 and below 1; got {confidence}")
    if measure is None:
        if dimension is None:
            raise ParamsInvalid("name a measure, a dimension, or both")
        return _wilson(scope, dimension, confidence)
    if dimension is None:
        m = valued(scope, measure)
        unit = scope.per_unit(m, [])
        f = unit.entering(unit.frame, ~finite(unit.frame, measure))
        v = finite_value(f, measure)
        groups = f.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance")).withColumn("member", F.lit("(all)"))
        groups = unit.held(groups, F.sum("n"))
    else:
        groups = cut(group_moments(scope, dimension, measure).select("member", "n", "mean", "variance"))
    # A quantile depends on the group's size alone, so it is solved once for each size there is.
    sizes = groups.select("n").distinct().where("n >= 2").withColumn("reach", t_quantile(0.5 + confidence / 2, F.col("n") - 1))
    half = F.col("reach") * F.sqrt(F.col("variance") / F.col("n"))
    return groups.join(sizes, "n", "left").select(
        F.col("member").cast("string").alias("member"), F.col("n").cast("long").alias("n"), F.col("mean").cast("double").alias("estimate"),
        (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))


def _wilson(scope: ScopedFrame, dimension: str, confidence: float) -> DataFrame:
    """Closed form over grouped counts. The base is every analysed row, unnamed members included."""
    scope.contract.dimension(dimension)
    z = tails.normal_quantile(0.5 + confidence / 2)
    counted = scope.entering(scope.frame).groupBy(F.col(quoted(dimension)).alias("member")).agg(F.count(F.lit(1)).alias("n"))
    counted = cut(scope.held(counted, F.sum("n")))
    whole = counted.agg(F.sum("n").alias("whole")).scalar().cast("double")
    p = ratio(F.col("n"), whole)
    base = counted.where(F.col("member").isNotNull()).select("member", "n", p.alias("estimate"), whole.alias("__w"))
    e, w = F.col("estimate"), F.col("__w")
    centre = e + z * z / (2 * w)
    reach = z * F.sqrt(e * (1 - e) / w + z * z / (4 * w * w))
    scale = 1 + z * z / w
    return base.select("member", "n", "estimate", ((centre - reach) / scale).alias("lo"),
                       ((centre + reach) / scale).alias("hi"))


@analysis("effect_size", 6, "How large a difference or an association is.", selects=True)
def effect_size(scope: ScopedFrame, dimension: str, measure: str | None = None,
                second_dimension: str | None = None) -> DataFrame:
    if (measure is None) == (second_dimension is None):
        raise ParamsInvalid("pass exactly one of measure and second_dimension")
    if second_dimension is not None:
        return _effect(scope, "cramers_v", associated(scope, dimension, second_dimension).v)
    f = fold(scope, dimension, measure)
    if f.groups < 2:
        raise NotPossible(f"{dimension} has {f.groups} group(s); an effect needs two")
    if f.groups == 2:
        if f.lonely:
            raise NotPossible("a group of one row has no spread to size an effect by")
        return _effect(scope, "hedges_g", hedges(f.first, f.last))
    return _effect(scope, "eta_squared", eta(f))


def _effect(scope: ScopedFrame, name: str, value: float | None) -> DataFrame:
    band = None
    if value is not None:
        band = "negligible"
        for bar, word in COHEN[name]:
            band = word if abs(value) >= bar else band
    return scope.source.sparkSession.range(1).select(
        F.lit(name).alias("effect"), F.lit(value).cast("double").alias("value"), F.lit(band).cast("string").alias("band"))


@analysis("sample_adequacy", 6, "The smallest difference two groups could have shown.", selects=True)
def sample_adequacy(scope: ScopedFrame, dimension: str, measure: str, power: float = 0.8,
                    alpha: float = 0.05) -> DataFrame:
    if not 0.5 <= power < 1:
        raise ParamsInvalid(f"power must be at least 0.5 and below 1; got {power}")
    if not 0 < alpha < 0.5:
        raise ParamsInvalid(f"alpha must lie between 0 and 0.5; got {alpha}")
    f = fold(scope, dimension, measure)
    if f.groups != 2 or f.lonely:
        raise NotPossible("sample adequacy compares two groups of two or more rows")
    a, b = f.first, f.last
    d = tails.detectable_effect(a.n, b.n, alpha, power)
    sd = pooled_sd(a, b)
    needed = {word: tails.rows_for_effect(target, alpha, power) for target, word in TARGETS}
    return scope.source.sparkSession.range(1).select(
        F.lit(a.n).alias("n1"), F.lit(b.n).alias("n2"), F.lit(d).alias("detectable_d"),
        F.lit(sd).alias("pooled_sd"), F.lit(d * sd).alias("detectable_difference"),
        F.lit(abs(a.mean - b.mean)).alias("observed_difference"),
        *[F.lit(n).alias(f"rows_for_{word}") for word, n in needed.items()])
