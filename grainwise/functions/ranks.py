"""Global order without a one-task window.

A range repartition puts the rows of one order in consecutive partitions, so a running total is
the total inside a partition plus the totals of the partitions before it. Both parts are ordinary
shuffled work; the only small table is one row per (partition, group).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainwise.functions.exprs import quoted
from grainwise.session import cut, shuffle_width

_SLICE = "__slice"


def running(df: DataFrame, order: list[tuple[str, bool]], amounts: dict[str, str],
            by: tuple[str, ...] = ()) -> DataFrame:
    """For each (name, column) of `amounts` add `name`, the column's total over the rows that
    precede each row, and `name_whole`, its total over the row's group.

    `order` lists (column, descending); it must be unique within `by`, which holds for the
    grouped frames the callers pass. NULLs come last.
    """
    def direction(column: str, down: bool) -> Column:
        c = F.col(quoted(column))
        return c.desc_nulls_last() if down else c.asc_nulls_last()

    keys = [F.col(quoted(b)) for b in by]
    sorts = [direction(c, down) for c, down in order]
    everything = Window.partitionBy(*keys)
    width = shuffle_width(df.sparkSession)
    ranged = df.repartitionByRange(width, *[k.asc_nulls_last() for k in keys], *sorts)
    # The range bounds are sampled, so the slices are written once and read back from there on.
    held = cut(ranged.withColumn(_SLICE, F.spark_partition_id()))

    inside = (Window.partitionBy(_SLICE, *keys).orderBy(*sorts)
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = held.withColumns({
        name: F.coalesce(F.sum(quoted(c)).over(inside), F.lit(0)) for name, c in amounts.items()})

    earlier = everything.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    slices = held.groupBy(_SLICE, *keys).agg(
        *[F.sum(quoted(c)).alias(f"__held_{name}") for name, c in amounts.items()])
    offsets = slices.select(
        F.col(_SLICE).alias("__at"),
        *[F.col(quoted(b)).alias(f"__by{i}") for i, b in enumerate(by)],
        *[F.coalesce(F.sum(f"__held_{name}").over(earlier), F.lit(0)).alias(f"__offset_{name}")
          for name in amounts],
        *[F.sum(f"__held_{name}").over(everything).alias(f"{name}_whole") for name in amounts],
    )
    same = F.col(_SLICE) == F.col("__at")
    for i, b in enumerate(by):
        same = same & F.col(quoted(b)).eqNullSafe(F.col(f"__by{i}"))
    joined = rows.join(offsets, same, "inner")
    lifted = joined.withColumns({name: F.col(name) + F.col(f"__offset_{name}") for name in amounts})
    return lifted.drop(_SLICE, "__at", *[f"__offset_{name}" for name in amounts],
                       *[f"__by{i}" for i in range(len(by))])


def positions(df: DataFrame, order: list[tuple[str, bool]], by: tuple[str, ...] = ()) -> DataFrame:
    """Add `position` (from 1) and `position_whole`, the number of rows, within `by`."""
    placed = running(df.withColumn("__one", F.lit(1).cast("long")), order, {"position": "__one"}, by)
    return placed.withColumn("position", F.col("position") + 1).drop("__one")


def midranks(values: DataFrame, value: str, n: str) -> DataFrame:
    """Average ranks of distinct `value`s that each stand for `n` rows, as column `midrank`."""
    placed = running(values, [(value, False)], {"before": n})
    return placed.withColumn("midrank", F.col("before") + (F.col(n) + 1) / F.lit(2.0))


def quantiles(df: DataFrame, value: str, probs: list[float], by: tuple[str, ...] = (),
              n: str | None = None) -> DataFrame:
    """Exact interpolated quantiles of a double column, one array column `q` per group.

    The distinct values are counted and then ranked across partitions, so neither a group nor a
    value of any size has to fit one task. `n` names the rows that each row of `df` stands for.
    """
    present = df.where(F.col(quoted(value)).isNotNull())
    keys = [F.col(quoted(b)) for b in by]
    counts = present.groupBy(*keys, F.col(quoted(value)).alias("__v")).agg(
        (F.sum(quoted(n)) if n else F.count(F.lit(1))).alias("__n"))
    placed = running(counts, [("__v", False)], {"before": "__n"}, by)
    picks = []
    for i, p in enumerate(probs):
        spot = F.lit(float(p)) * (F.col("before_whole") - 1)
        for side, at in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            held = (F.col("before") <= at) & (at < F.col("before") + F.col("__n"))
            picks.append(F.max(F.when(held, F.col("__v"))).alias(f"__{side}{i}"))
    found = placed.groupBy(*keys).agg(*picks, F.max("before_whole").alias("before_whole"))
    parts = []
    for i, p in enumerate(probs):
        spot = F.lit(float(p)) * (F.col("before_whole") - 1)
        step = spot - F.floor(spot)
        parts.append(F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * step)
    return found.select(*keys, F.array(*parts).alias("q"))
