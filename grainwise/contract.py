"""The dataset contract: what the rows of one table mean and which of them count."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, fields
from datetime import date

from pyspark.sql import types as T

from grainwise.errors import ContractError

# The aggregates a measure may declare, and those whose group totals add up.
AGGREGATES = ("sum", "mean", "min", "max", "count", "count_distinct", "median", "none")
ADDITIVE = ("sum", "count")
# The operators a comparison measure may use.
COMPARISONS = (">", ">=", "<", "<=", "=", "<>")


def is_whole(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType) or (isinstance(t, T.DecimalType) and t.scale == 0)


def is_floating(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_date(t: T.DataType) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_text(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


@dataclass(frozen=True)
class Measure:
    """A number the table can give, and how it combines across rows.

    `column` reads the measure from another column. `per` counts it once per unit. `numerator` and
    `denominator` are signed column lists of a ratio of sums. `compare` is (left, op, right),
    read as 1, 0 or unknown.
    """

    name: str
    agg: str | None = None
    definition: str = ""
    unit: str = ""
    column: str | None = None
    per: tuple[str, ...] = ()
    numerator: tuple[str, ...] = ()
    denominator: tuple[str, ...] = ()
    scale: float = 1.0
    compare: tuple[str, str, str] | None = None

    @property
    def is_ratio(self) -> bool:
        return bool(self.numerator)

    @property
    def additive(self) -> bool:
        return self.agg in ADDITIVE and not self.is_ratio

    def reads(self) -> list[str]:
        """The physical columns this measure is computed from."""
        if self.compare:
            return [self.compare[0], self.compare[2]]
        if self.is_ratio:
            return [c.lstrip("-") for c in (*self.numerator, *self.denominator)]
        return [self.column or self.name]


@dataclass(frozen=True)
class Rule:
    """A boolean expression over one row, and why it is there."""

    rule: str
    reason: str = ""


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    references: str
    referenced: tuple[str, ...]


@dataclass(frozen=True)
class Domain:
    column: str
    allowed: tuple


@dataclass(frozen=True)
class Window:
    """Inclusive at both ends."""

    start: date
    end: date

    def __post_init__(self):
        if self.end < self.start:
            raise ContractError(f"the window ends {self.end} before it starts {self.start}")


@dataclass(frozen=True)
class Binding:
    """The table a contract was confirmed against: ordered columns and the rows seen then."""

    columns: tuple[tuple[str, str], ...]
    row_count: int

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.columns)


def fingerprint(columns) -> str:
    """Twelve hex digits that identify an ordered list of (name, type). Row count is left out."""
    text = ",".join(f"{name}:{dtype.upper()}" for name, dtype in columns)
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def columns_of(schema: T.StructType) -> tuple[tuple[str, str], ...]:
    return tuple((f.name, f.dataType.simpleString()) for f in schema.fields)


@dataclass(frozen=True)
class DatasetContract:
    dataset: str
    grain: str = ""
    key: tuple[str, ...] = ()
    date_column: str | None = None
    window: Window | None = None
    measures: tuple[Measure, ...] = ()
    dimensions: tuple[str, ...] = ()
    exclusions: tuple[Rule, ...] = ()
    expectations: tuple[Rule, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    domains: tuple[Domain, ...] = ()
    missing_values: tuple[str, ...] | None = None
    caveats: tuple[str, ...] = ()
    unresolved: tuple[str, ...] = ()
    binding: Binding | None = field(default=None, compare=False)

    def measure(self, name: str) -> Measure:
        for m in self.measures:
            if m.name == name:
                return m
        known = ", ".join(m.name for m in self.measures) or "none"
        raise ContractError(f"{name!r} is not a declared measure of {self.dataset}: {known}")

    def dimension(self, name: str) -> str:
        if name not in self.dimensions:
            known = ", ".join(self.dimensions) or "none"
            raise ContractError(f"{name!r} is not a declared dimension of {self.dataset}: {known}")
        return name

    def dated(self) -> str:
        if not self.date_column:
            raise ContractError(f"{self.dataset} declares no date column, so it has no calendar")
        return self.date_column

    def check(self, schema: T.StructType) -> None:
        """Every rule a contract must meet before it can be confirmed over `schema`."""
        problems = list(self._problems(schema))
        if problems:
            raise ContractError("; ".join(problems))

    def _problems(self, schema: T.StructType):
        types = {f.name: f.dataType for f in schema.fields}
        open_fields = {u.split(":")[0] for u in self.unresolved}
        if not self.grain.strip() and "grain" not in open_fields:
            yield "grain is blank and not listed as unresolved"
        names = [m.name for m in self.measures]
        for name in sorted({n for n in names if names.count(n) > 1}):
            yield f"measure {name} is declared twice"
        for name in sorted(set(names) & set(self.dimensions)):
            yield f"{name} is both a measure and a dimension"
        if self.window and not self.date_column:
            yield "a window needs a date column"
        if self.date_column in types and not is_date(types[self.date_column]):
            yield f"{self.date_column} is {types[self.date_column].simpleString()}, not a date"
        stated = [("key", c) for c in self.key]
        stated += [("date column", self.date_column)] if self.date_column else []
        stated += [("dimension", d) for d in self.dimensions]
        stated += [("domain", d.column) for d in self.domains]
        stated += [("foreign key", c) for k in self.foreign_keys for c in k.columns]
        for what, column in stated:
            if column not in types:
                yield f"{what} {column} is not a column"
        for m in self.measures:
            yield from _measure_problems(m, types, open_fields)
        for k in self.foreign_keys:
            if len(k.columns) != len(k.referenced):
                yield f"foreign key to {k.references} pairs {len(k.columns)} with {len(k.referenced)} columns"


def _measure_problems(m: Measure, types: dict, open_fields: set):
    if m.agg is None and not m.is_ratio and m.name not in open_fields:
        yield f"measure {m.name} declares no aggregate and is not listed as unresolved"
    if m.agg is not None and m.agg not in AGGREGATES:
        yield f"measure {m.name} declares {m.agg}, which is none of {', '.join(AGGREGATES)}"
    if m.is_ratio and not m.denominator:
        yield f"ratio {m.name} has no denominator"
    if m.compare and m.compare[1] not in COMPARISONS:
        yield f"measure {m.name} compares with {m.compare[1]!r}"
    for c in (*m.reads(), *m.per):
        if c not in types:
            yield f"measure {m.name} reads {c}, which is not a column"
    if m.compare and all(c in types for c in m.reads()):
        left, right = (types[c] for c in m.reads())
        if not (is_number(left) and is_number(right)) and not (is_date(left) and is_date(right)):
            yield f"measure {m.name} compares {left.simpleString()} with {right.simpleString()}"
    elif not m.compare and m.agg in ("sum", "mean", "median"):
        for c in m.reads():
            if c in types and not (is_number(types[c]) or isinstance(types[c], T.BooleanType)):
                yield f"measure {m.name} cannot {m.agg} {types[c].simpleString()} values"


def changed_fields(old: DatasetContract, new: DatasetContract) -> list[str]:
    """The names of the fields two versions of a contract disagree on."""
    return [f.name for f in fields(old) if f.compare and getattr(old, f.name) != getattr(new, f.name)]
