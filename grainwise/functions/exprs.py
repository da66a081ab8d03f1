"""Column expressions shared by the operators. All stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.contract import Measure, is_floating


def type_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def finite(df: DataFrame, column: str) -> Column:
    """True for a present, finite value. Only floating columns pay for the extra test."""
    c = F.col(quoted(column))
    if is_floating(type_of(df, column)):
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return c.isNotNull()


def finite_value(df: DataFrame, column: str) -> Column:
    """The value as a double, NULL where it is absent, NaN or infinite."""
    c = F.col(quoted(column))
    if is_floating(type_of(df, column)):
        return F.when(finite(df, column), c.cast("double"))
    return c.cast("double")


def finite_only(df: DataFrame, column: str) -> Column:
    """The value in its own type, NULL where it is NaN or infinite."""
    c = F.col(quoted(column))
    return F.when(finite(df, column), c) if is_floating(type_of(df, column)) else c


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ratio(numerator: Column, denominator: Column) -> Column:
    """A division that is NULL, not an error, when the divisor is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def summable(df: DataFrame, column: str) -> Column:
    """The column's finite values, widened so that a whole-number sum cannot overflow."""
    t = type_of(df, column)
    c = finite_only(df, column)
    if isinstance(t, T.BooleanType):
        return c.cast("int").cast("decimal(38,0)")
    return c.cast("decimal(38,0)") if isinstance(t, T.IntegralType) else c


def declared(df: DataFrame, m: Measure) -> Column:
    """The aggregate a measure declares, over the finite values of a frame that carries its derived columns.

    Counts are of all present values. A median has none: it is ranked (see `functions.ranks`).
    """
    if m.is_ratio:
        return F.lit(float(m.scale)) * ratio(
            F.sum(finite_only(df, f"{m.name}__n")), F.sum(finite_only(df, f"{m.name}__d")))
    c = F.col(quoted(m.name))
    if m.agg == "sum":
        return F.sum(summable(df, m.name))
    if m.agg == "mean":
        return F.avg(finite_value(df, m.name))
    if m.agg in ("min", "max"):
        return {"min": F.min, "max": F.max}[m.agg](finite_only(df, m.name))
    return {"count": F.count, "count_distinct": F.count_distinct}[m.agg](c)


def ranked(value: str, name: str) -> list[Column]:
    """Biggest first, absent totals last, ties by name with the NULL group last."""
    return [F.col(value).desc_nulls_last(), F.col(name).asc_nulls_last()]


def matches(c: Column, pattern: str) -> Column:
    """The whole text matches `pattern`."""
    return c.rlike(f"^(?:{pattern})$")
