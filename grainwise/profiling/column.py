"""One column in detail."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.functions import calendar as cal
from grainwise.functions.exprs import count_where, finite_value, quoted, ranked, ratio
from grainwise.operators.time import runs
from grainwise.session import cut


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """value, rows, share, not_shown: the commonest values, NULL among them."""
    n = max(1, n)
    counted = cut(df.groupBy(F.col(quoted(column)).alias("value")).agg(F.count(F.lit(1)).alias("rows")))
    facts = counted.agg(F.sum("rows").alias("rows"), F.count("value").alias("distinct"))
    whole, distinct = facts.select("rows").scalar(), facts.select("distinct").scalar()
    top = counted.orderBy(*ranked("rows", "value")).limit(n)
    shown = top.agg(F.count("value").alias("n")).scalar()
    return top.withColumns({"share": ratio(F.col("rows"), whole), "not_shown": F.greatest(distinct - shown, F.lit(0))})


def nice_edges(lo: float, hi: float, bins: int) -> list[float]:
    """Upper edges of about `bins` equal bins at round numbers (steps of 1, 2 or 5 times a power of ten)."""
    if lo == hi:
        return [hi]
    raw = (hi - lo) / bins
    power = math.floor(math.log10(raw))
    lead = raw / 10.0 ** power
    nice = next((step for bar, step in ((1.5, 1), (3, 2), (7.5, 5)) if lead < bar), 10)
    step = Decimal(nice).scaleb(power)
    first = math.floor(Decimal(repr(lo)) / step) + 1
    last = math.ceil(Decimal(repr(hi)) / step)
    return [float(step * k) for k in range(first, last + 1)]


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """lo, hi, rows: counts up to each edge. The edges come from one aggregate row."""
    v = finite_value(df, column)
    row = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    edges = [] if row["lo"] is None else nice_edges(row["lo"], row["hi"], bins)
    lows = [row["lo"], *edges[:-1]]
    if not edges:
        return df.select(v.alias("lo"), v.alias("hi"), F.lit(0).alias("rows")).limit(0)
    held = []
    for i, (lo, hi) in enumerate(zip(lows, edges)):
        above = v >= F.lit(lo) if i == 0 else v > F.lit(lo)
        held.append(count_where(above & (v <= F.lit(hi))).alias(f"b{i}"))
    slots = [F.struct(F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"), F.col(f"b{i}").alias("rows"))
             for i, (lo, hi) in enumerate(zip(lows, edges))]
    return df.agg(*held).select(F.explode(F.array(*slots)).alias("s")).select("s.*")


def lengths(df: DataFrame, column: str) -> DataFrame:
    """shortest, longest, mean, is_fixed_width of a text column."""
    size = F.length(quoted(column))
    return df.agg(F.min(size).alias("shortest"), F.max(size).alias("longest"), F.avg(size).alias("mean")).withColumn(
        "is_fixed_width", F.col("shortest") == F.col("longest"))


def date_coverage(df: DataFrame, column: str) -> DataFrame:
    """first, last, days_in_span, days_present, days_missing, longest_gap.

    The table is folded to its days before anything is ordered.
    """
    present = df.where(F.col(quoted(column)).isNotNull()).groupBy(
        F.col(quoted(column)).cast("date").alias("period")).agg(F.count(F.lit(1)).alias("rows"))
    span = present.agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    spine = cal.Calendar("day", span).spine().join(present, "period", "left")
    held = F.col("rows").isNotNull()
    marked = runs(spine, held)
    return marked.agg(
        F.min("period").alias("first"), F.max("period").alias("last"), F.count(F.lit(1)).alias("days_in_span"),
        F.count_if(held).alias("days_present"), F.count_if(~held).alias("days_missing"),
        F.coalesce(F.max(F.when(~held, F.col("run_length"))), F.lit(0)).alias("longest_gap"))
