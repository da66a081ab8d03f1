"""Distribution tails as columns, for results of any number of rows.

The same continued fraction as in `tails`, folded over a sequence of steps by `aggregate`, so it runs where the rows are. A fold has no
early end; the steps it takes grow with the root of the larger parameter, as the fraction needs them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainwise.functions import tails

_TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """Stirling's series eight steps up, for x > 0."""
    up = x + 8
    steps = x
    for i in range(1, 8):
        steps = steps * (x + i)
    r = F.lit(1.0) / up
    s = r * r
    series = r * (F.lit(1 / 12) - s * (F.lit(1 / 360) - s * (F.lit(1 / 1260) - s * (F.lit(1 / 1680) - s * F.lit(1 / 1188)))))
    return (up - 0.5) * F.ln(up) - up + 0.5 * math.log(2 * math.pi) + series - F.ln(steps)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The beta function's continued fraction in Lentz's form, one term a step; x, a and b are lambda variables or columns."""
    def step(s: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        # A tiny summand keeps a divisor from zero and changes nothing else.
        return _let(F.when(k % 2 == 0, even).otherwise(odd), lambda term: _let(
            F.struct((1 + term / s["c"] + _TINY).alias("c"), (1 / (1 + term * s["d"] + _TINY)).alias("d")),
            lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (s["t"] * n["c"] * n["d"]).alias("t"))))

    one = F.lit(1.0)
    steps = (F.lit(80) + F.lit(10) * F.sqrt(F.greatest(a, b))).cast("int")
    return F.aggregate(F.sequence(F.lit(1), steps), F.struct(F.lit(1 / _TINY).alias("c"), one.alias("d"), one.alias("t")), step, lambda s: s["t"])


def beta_cdf(x: Column, a: Column, b: Column, whole: Column | None = None) -> Column:
    """The regularised incomplete beta function; `whole` is the logarithm of the complete one's reciprocal, where it is at hand."""
    # The fraction is quick on one side of the mean; the other side is its mirror image.
    inside = F.least(F.greatest(x, F.lit(1e-300)), F.lit(1 - 1e-16))
    low = x < (a + 1) / (a + b + 2)
    part = _let(F.struct(F.when(low, inside).otherwise(1 - inside).alias("x"), F.when(low, a).otherwise(b).cast("double").alias("a"),
                         F.when(low, b).otherwise(a).cast("double").alias("b")), lambda v: _part(v, whole))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(low, part).otherwise(1 - part)


def _part(v: Column, whole: Column | None) -> Column:
    x, a, b = v["x"], v["a"], v["b"]
    if whole is None:
        whole = log_gamma(a + b) - log_gamma(a) - log_gamma(b)
    return F.exp(whole + a * F.ln(x) + b * F.log1p(-x)) * _fraction(x, a, b) / a


def t_sf(t: Column, df: Column, whole: Column | None = None) -> Column:
    half = F.lit(0.5) * beta_cdf(df / (df + t * t), df / 2, F.lit(0.5), whole)
    return F.when(t >= 0, half).otherwise(1 - half)


def t_quantile(p: float, df: Column) -> Column:
    """The quantile of Student's t at one probability of 0.5 or more, for a column of degrees of freedom.

    Newton's steps from the normal quantile: the density falls to the right, so they close in from below and never pass the root.
    From 1,000 degrees on the expansion around the normal quantile serves, as its next term is below a double's last digit.
    """
    z = tails.normal_quantile(p)
    few = F.least(df.cast("double"), F.lit(float(tails.MANY)))

    def solve(v: Column) -> Column:
        n, scale = v["n"], v["scale"]

        def step(t: Column, _: Column) -> Column:
            # The density's scale is the reciprocal beta function over the root of n.
            return t + (t_sf(t, n, F.ln(scale * F.sqrt(n))) - (1 - p)) / (scale * F.pow(1 + t * t / n, -(n + 1) / 2) + _TINY)

        return F.aggregate(F.sequence(F.lit(1), F.when(n < 5, 60).otherwise(12)), F.lit(z), step)

    scale = F.exp(log_gamma((few + 1) / 2) - log_gamma(few / 2)) / F.sqrt(few * math.pi)
    root = _let(F.struct(few.alias("n"), scale.alias("scale")), solve)
    v = df.cast("double")
    wide = F.lit(0.0)
    for term in reversed(tails.expansion(z)):
        wide = wide / v + term
    return F.when(v < 1, F.lit(None).cast("double")).when(v < tails.MANY, root).otherwise(wide)
