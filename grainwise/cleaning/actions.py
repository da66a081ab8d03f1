"""The kinds of cleaning action, and what each does to a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.contract import is_floating
from grainwise.errors import ParamsInvalid
from grainwise.functions import readings
from grainwise.functions.exprs import finite, matches, quoted

# The kinds, the texts that mean absent by default, and how many losses are shown.
DROP_DUPLICATE_ROWS = "DROP_DUPLICATE_ROWS"
DROP_HEADER_ROWS = "DROP_HEADER_ROWS"
CONVERT_TYPE = "CONVERT_TYPE"
NORMALISE_MISSING = "NORMALISE_MISSING"
TRIM_WHITESPACE = "TRIM_WHITESPACE"
NORMALISE_CASE = "NORMALISE_CASE"
NULL_NON_FINITE = "NULL_NON_FINITE"
EXCLUDE_COLUMN = "EXCLUDE_COLUMN"
DEFAULT_MISSING = ("", "NA", "N/A", "-", "--", "null", "NULL", "None")
SAMPLE = 5
NUMERIC = ("BIGINT", "DOUBLE", "DECIMAL(18,2)")


@dataclass(frozen=True)
class Action:
    """One proposed change. A lossy one must show what it would lose."""

    action_id: str
    kind: str
    column: str | None = None
    to_type: str | None = None
    reading: str | None = None
    rows_affected: int = 0
    values_lost: int = 0
    loss_unit: str = "value"
    sample: tuple[str, ...] = ()
    tokens: tuple[str, ...] = ()

    def __post_init__(self):
        if self.values_lost and not self.sample:
            raise ValueError(f"{self.action_id} loses {self.values_lost} {self.loss_unit}(s) and shows none")

    @property
    def statement(self) -> str:
        """The change in one line, as it will be ledgered."""
        parts = [self.kind, self.column or "", f"to {self.to_type}" if self.to_type else "",
                 f"reading {self.reading}" if self.reading else ""]
        return " ".join(p for p in parts if p)


def is_token(c: Column, tokens) -> Column:
    return F.upper(F.trim(c)).isin([t.upper() for t in tokens]) if tokens else F.lit(False)


def text_of(c: Column, reading: str) -> Column:
    """The text a number reading parses."""
    return {"cast": lambda: c, "currency": lambda: readings.currency_text(c), "percent": lambda: readings.percent_text(c),
            "us": lambda: readings.us_text(c), "eu": lambda: readings.eu_text(c)}[reading]()


def converted(c: Column, to_type: str, reading: str) -> Column:
    """The value under a reading; NULL where it cannot be read."""
    if reading.startswith("dates"):
        order = {"dates:day": "day", "dates:month": "month", "dates": None}[reading]
        at = readings.written_date(c, order)
        return at.cast("date") if to_type == "DATE" else at
    if to_type == "BOOLEAN":
        return readings.literal_truth(c)
    if to_type in ("DATE", "TIMESTAMP"):
        at = readings.moment(c)
        return at.cast("date") if to_type == "DATE" else at
    text = text_of(c, reading)
    if to_type == "BIGINT":
        return readings.whole_number(text)
    return readings.cents(text) if to_type == "DECIMAL(18,2)" else readings.number(text)


def lost(c: Column, to_type: str, reading: str, tokens) -> Column:
    """A present value a conversion cannot keep and nobody declared missing."""
    fails = converted(c, to_type, reading).isNull()
    if to_type in NUMERIC and reading != "currency":
        fails = fails | F.trim(c).rlike(readings.LEADING_ZERO)
    if to_type in ("DATE", "TIMESTAMP"):
        fails = fails & ~matches(F.trim(c), readings.ZERO_DATE)
    return c.isNotNull() & fails & ~is_token(c, tokens)


def header_copy(df: DataFrame) -> Column:
    """True for a row whose values repeat at least half of the column names."""
    need = max(2, (len(df.columns) + 1) // 2)
    hits = F.lit(0)
    for name in df.columns:
        spelled = sorted({name.lower(), name.lower().replace("_", " ")})
        same = F.lower(F.trim(F.col(quoted(name)).cast("string"))).isin(spelled)
        hits = hits + F.coalesce(same, F.lit(False)).cast("int")
    return hits >= need


def perform(df: DataFrame, action: Action) -> DataFrame:
    """The table after one action. Column order is kept."""
    if action.kind == DROP_DUPLICATE_ROWS:
        return df.dropDuplicates()
    if action.kind == DROP_HEADER_ROWS:
        return df.where(~header_copy(df))
    if action.column not in df.columns:
        raise ParamsInvalid(f"{action.action_id} names {action.column}, which is not a column")
    if action.kind == EXCLUDE_COLUMN:
        return df.drop(action.column)
    c = F.col(quoted(action.column))
    if action.kind == CONVERT_TYPE:
        new = converted(c, action.to_type, action.reading)
    elif action.kind == NORMALISE_MISSING:
        new = F.when(~F.coalesce(is_token(c, action.tokens), F.lit(False)), c)
    elif action.kind == TRIM_WHITESPACE:
        new = F.trim(c)
    elif action.kind == NORMALISE_CASE:
        new = F.lower(c) if action.reading == "lower" else F.upper(c)
    elif action.kind == NULL_NON_FINITE:
        new = F.when(finite(df, action.column), c) if is_floating(df.schema[action.column].dataType) else c
    else:
        raise ParamsInvalid(f"{action.kind} is not a cleaning action")
    return df.withColumn(action.column, new)
