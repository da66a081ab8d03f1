"""Sample-corrected moments. Spark's skewness and kurtosis are the population ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainwise.functions.exprs import ratio


def sample_skewness(c: Column) -> Column:
    n = F.count(c).cast("double")
    spread = F.var_pop(c)
    return F.when((n >= 3) & (spread > 0), F.skewness(c) * ratio(F.sqrt(n * (n - 1)), n - 2))


def sample_kurtosis(c: Column) -> Column:
    """Excess kurtosis with the sample correction; NULL under four values."""
    n = F.count(c).cast("double")
    spread = F.var_pop(c)
    body = (n + 1) * F.kurtosis(c) + 6
    return F.when((n >= 4) & (spread > 0), ratio((n - 1) * body, (n - 2) * (n - 3)))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson's r; NULL under three pairs or when either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    cx, cy = F.when(both, x), F.when(both, y)
    steady = (F.min(cx) == F.max(cx)) | (F.min(cy) == F.max(cy))
    r = F.try_divide(F.covar_samp(cx, cy), F.stddev_samp(cx) * F.stddev_samp(cy))
    return F.when((F.count(cx) >= 3) & ~steady, r)


def weighted_corr(x: Column, y: Column, n: Column) -> Column:
    """Pearson's r over values that each stand for `n` rows."""
    w = n.cast("double")
    sw, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    sxx, syy, sxy = F.sum(w * x * x), F.sum(w * y * y), F.sum(w * x * y)
    cov = sxy - sx * sy / sw
    vx, vy = sxx - sx * sx / sw, syy - sy * sy / sw
    steady = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    r = F.try_divide(cov, F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0))))
    return F.when((sw >= 3) & ~steady, r)
