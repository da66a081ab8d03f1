"""Generated calendars: an absent period is a row, so the spine comes first and the data joins it."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.errors import ParamsInvalid

# The grains, the interval each one steps by, and how many months or days that is.
STEPS = {
    "day": "interval 1 day",
    "week": "interval 7 days",
    "month": "interval 1 month",
    "quarter": "interval 3 months",
    "year": "interval 1 year",
}
DEFAULT_GRAIN = "month"


def check_grain(grain: str) -> str:
    key = str(grain).strip().lower()
    if key not in STEPS:
        raise ParamsInvalid(f"grain must be one of {', '.join(STEPS)}; got {grain!r}")
    return key


def period_of(column: Column, grain: str) -> Column:
    """The first day of the period a date falls in. Weeks start on Monday."""
    if grain == "day":
        return column.cast("date")
    return F.trunc(column.cast("date"), grain)


def label_of(period: Column, grain: str) -> Column:
    if grain == "month":
        return F.date_format(period, "yyyy-MM")
    if grain == "year":
        return F.date_format(period, "yyyy")
    if grain == "quarter":
        return F.concat(F.date_format(period, "yyyy"), F.lit("-Q"),
                        F.quarter(period).cast("string"))
    return F.date_format(period, "yyyy-MM-dd")


def truncated(day: date, grain: str) -> date:
    """The same truncation for a single literal date."""
    if grain == "week":
        return day - timedelta(days=day.weekday())
    if grain == "month":
        return day.replace(day=1)
    if grain == "quarter":
        return day.replace(month=3 * ((day.month - 1) // 3) + 1, day=1)
    return day.replace(month=1, day=1) if grain == "year" else day


def next_period(day: date, grain: str) -> date:
    if grain in ("day", "week"):
        return day + timedelta(days=1 if grain == "day" else 7)
    months = {"month": 1, "quarter": 3, "year": 12}[grain]
    index = day.year * 12 + day.month - 1 + months
    return date(index // 12, index % 12 + 1, 1)


def parse_label(label: str, grain: str) -> date:
    """The first day of a labelled period."""
    shapes = {
        "year": r"(\d{4})", "month": r"(\d{4})-(\d\d)", "quarter": r"(\d{4})-Q([1-4])",
        "week": r"(\d{4})-(\d\d)-(\d\d)", "day": r"(\d{4})-(\d\d)-(\d\d)",
    }
    found = re.fullmatch(shapes[grain], str(label).strip())
    if not found:
        raise ParamsInvalid(f"period {label!r} is not labelled like a {grain}")
    parts = [int(p) for p in found.groups()]
    try:
        if grain == "quarter":
            return date(parts[0], 3 * parts[1] - 2, 1)
        day = date(*(parts + [1, 1])[:3])
    except ValueError as bad:
        raise ParamsInvalid(f"period {label!r}: {bad}") from None
    if truncated(day, grain) != day:
        raise ParamsInvalid(f"period {label!r} does not open a {grain}")
    return day


@dataclass(frozen=True)
class Calendar:
    """The periods one analysis reports, as a frame of first days."""

    grain: str
    bounds: DataFrame  # one row: lo, hi

    def spine(self) -> DataFrame:
        """One row per period. Its length is bounded by the calendar, not by the table."""
        lo, hi = (period_of(F.col(c), self.grain) for c in ("lo", "hi"))
        steps = F.sequence(lo, hi, F.expr(STEPS[self.grain]))
        return (self.bounds.where(F.col("lo").isNotNull() & F.col("hi").isNotNull())
                .select(F.explode(steps).alias("period")))
