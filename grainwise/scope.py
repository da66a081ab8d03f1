"""The rows an analysis may see, and where every other row went."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.accounting import Account
from grainwise.contract import DatasetContract, Measure, is_date, is_number
from grainwise.errors import LostRows, NotPossible, ParamsInvalid, ScopeError
from grainwise.functions import calendar as cal
from grainwise.functions.exprs import count_where, quoted, type_of

# Where a row may end up, in the order the counters are reported.
BUCKETS = ("excluded", "outside_window", "no_date", "unselected", "filtered", "analysed")


def rule_column(df: DataFrame, rule: str) -> Column:
    """A boolean rule over `df`'s own columns, checked by Spark's analyser.

    A rule that is not one boolean expression, or that brings in another relation, is refused.
    """
    if not rule or not rule.strip():
        raise ParamsInvalid("the rule is empty")
    try:
        read = df.select(F.expr(rule).alias("rule"))
        kind = read.schema["rule"].dataType
    except Exception as bad:
        first = str(bad).strip().splitlines()[0]
        raise ParamsInvalid(f"the rule {rule!r} cannot be read: {first}") from None
    if not isinstance(kind, T.BooleanType):
        raise ParamsInvalid(f"the rule {rule!r} is {kind.simpleString()}, not boolean")
    plan = read._jdf.queryExecution().analyzed()
    if plan.subqueriesAll().size():
        raise ParamsInvalid(f"the rule {rule!r} holds a subquery")
    if "aggregate" in plan.nodeName().lower():
        raise ParamsInvalid(f"the rule {rule!r} aggregates; a rule judges one row")
    return F.expr(rule)


def negated(condition: Column) -> Column:
    """True where the condition is false or unknown."""
    return ~F.coalesce(condition, F.lit(False))


def within(column: Column, start: date, end: date) -> Column:
    """Inclusive days as a half-open range of literals, which reaches the scan as a filter."""
    return (column >= F.lit(start)) & (column < F.lit(end + timedelta(days=1)))


def derived(df: DataFrame, measures) -> DataFrame:
    """Add the columns declared measures are computed from, keeping the table's own."""
    added: dict[str, Column] = {}
    for m in measures:
        if m.compare:
            added[m.name] = comparison(df, m)
        elif m.is_ratio:
            added[f"{m.name}__n"] = signed_sum(m.numerator)
            added[f"{m.name}__d"] = signed_sum(m.denominator)
        else:
            source = m.column or m.name
            c = F.col(quoted(source))
            if isinstance(type_of(df, source), T.BooleanType):
                added[m.name] = c.cast("int")
            elif source != m.name:
                added[m.name] = c
    return df.withColumns(added) if added else df


def comparison(df: DataFrame, m: Measure) -> Column:
    left, op, right = m.compare
    kinds = [type_of(df, left), type_of(df, right)]
    if not (all(map(is_number, kinds)) or all(map(is_date, kinds))):
        raise NotPossible(f"{m.name} compares {left} with {right}, which are not both numbers or dates")
    a, b = F.col(quoted(left)), F.col(quoted(right))
    outcome = {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b, "=": a == b, "<>": a != b}[op]
    return outcome.cast("int")


def signed_sum(columns) -> Column:
    total = None
    for name in columns:
        c = F.col(quoted(name.lstrip("-")))
        term = -c if name.startswith("-") else c
        total = term if total is None else total + term
    return total


@dataclass(frozen=True)
class ScopedFrame:
    """A table, its contract, and the ordered tests a row must pass to be analysed."""

    source: DataFrame
    contract: DatasetContract
    tests: tuple[tuple[str, Column], ...] = ()
    unknown: Column | None = None
    notes: tuple[str, ...] = ()
    account: Account | None = None
    _known: dict = field(default_factory=dict, compare=False)

    @property
    def frame(self) -> DataFrame:
        """The analysed rows, lazily, one filter per test so each can be pushed to the scan."""
        rows = self.source
        for _, keep in self.tests:
            rows = rows.where(keep)
        return rows

    def entering(self, rows: DataFrame, aside: Column | None = None) -> DataFrame:
        """`rows` as an analysis takes them in, counted where a run is accounted for; `aside` marks those no group will hold."""
        return rows if self.account is None else self.account.entering(rows, aside)

    def held(self, groups: DataFrame, rows: Column) -> DataFrame:
        """The groups that hold those rows; `rows` is an aggregate of how many."""
        return groups if self.account is None else self.account.held(groups, rows)

    @property
    def date(self) -> Column:
        return F.col(quoted(self.contract.dated()))

    def _bucket(self) -> Column:
        chain = None
        for bucket, keep in self.tests:
            test = negated(keep)
            chain = F.when(test, bucket) if chain is None else chain.when(test, bucket)
        return F.lit("analysed") if chain is None else chain.otherwise("analysed")

    def counts(self) -> DataFrame:
        """One row of counters, from one pass: every row is in exactly one of them."""
        tagged = self.source.withColumn("__bucket", self._bucket())
        unknown = F.lit(False) if self.unknown is None else self.unknown
        return tagged.agg(
            F.count(F.lit(1)).alias("rows"),
            *[count_where(F.col("__bucket") == b).alias(b) for b in BUCKETS],
            count_where(unknown & (F.col("__bucket") == "analysed")).alias("rule_unknown"),
        )

    def counted(self) -> dict:
        """The counters as numbers. Runs once per scope; refuses a scope that loses rows."""
        if not self._known:
            row = self.counts().first().asDict()
            if sum(row[b] for b in BUCKETS) != row["rows"]:
                raise LostRows(f"the scope of {self.contract.dataset} does not add back: {row}")
            self._known.update(row)
        return self._known

    @property
    def analysed(self) -> int:
        return self.counted()["analysed"]

    def _narrow(self, bucket: str, keep: Column, note: str) -> ScopedFrame:
        return replace(self, tests=(*self.tests, (bucket, keep)), notes=(*self.notes, note), _known={})

    def where(self, rule: str) -> ScopedFrame:
        """A caller's filter. An unknown answer leaves the row out; keeping nothing is refused."""
        kept = self._narrow("filtered", F.coalesce(rule_column(self.source, rule), F.lit(False)),
                            f"where {rule}")
        if not kept.frame.take(1):
            raise ParamsInvalid(f"the filter {rule!r} keeps no analysed row")
        return kept

    def groups(self, dimension: str, members: list) -> ScopedFrame:
        """Only the named members of a dimension, compared as text. NULL is named by None."""
        self.contract.dimension(dimension)
        text = F.col(quoted(dimension)).cast("string")
        named = [str(m) for m in members if m is not None]
        keep = F.coalesce(text.isin(named), F.lit(False)) if named else F.lit(False)
        if None in members:
            keep = keep | text.isNull()
        held = {r[0] for r in self.frame.where(keep).select(text).distinct().collect()}
        missing = [m for m in members if (None if m is None else str(m)) not in held]
        if missing:
            known = [r[0] for r in self.frame.select(text.alias("m")).distinct()
                     .orderBy(F.col("m").asc_nulls_last()).take(50)]
            raise ParamsInvalid(f"{dimension} has no member {missing}; it has {known}")
        return self._narrow("unselected", keep, f"{dimension} in {list(members)}")

    def period(self, label: str, grain: str = cal.DEFAULT_GRAIN) -> ScopedFrame:
        """One labelled period of the calendar. Undated rows move to `no_date`."""
        grain = cal.check_grain(grain)
        first = cal.parse_label(label, grain)
        lo, hi = self.bounds()
        if lo is None or not cal.truncated(lo, grain) <= first <= cal.truncated(hi, grain):
            raise ParamsInvalid(f"period {label!r} is outside the calendar, {lo} to {hi}")
        last = cal.next_period(first, grain) - timedelta(days=1)
        dated = self._narrow("no_date", self.date.isNotNull(), f"the {grain} {label}")
        return replace(dated, tests=(*dated.tests, ("outside_window", within(self.date, first, last))))

    def bounds(self) -> tuple[date | None, date | None]:
        """The calendar's first and last day: the window, or what the rows hold."""
        if self.contract.window:
            return self.contract.window.start, self.contract.window.end
        row = self.calendar("day").bounds.first()
        return row["lo"], row["hi"]

    def calendar(self, grain: str) -> cal.Calendar:
        grain = cal.check_grain(grain)
        window = self.contract.window
        self.contract.dated()
        if window:
            one = self.source.sparkSession.range(1)
            bounds = one.select(F.lit(window.start).alias("lo"), F.lit(window.end).alias("hi"))
        else:
            day = self.date.cast("date")
            bounds = self.frame.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
        return cal.Calendar(grain, bounds)

    def per_unit(self, m: Measure, needed: list[str], optional: list[str] = ()) -> ScopedFrame:
        """The distinct units of a per-unit measure, with the columns an analysis needs.

        One grouped job judges every column at once: a needed column that varies inside a unit is
        refused, an optional one is dropped.
        """
        if not m.per:
            return self
        asked = list(dict.fromkeys([*needed, *optional]))
        value = [f"{m.name}__n", f"{m.name}__d"] if m.is_ratio else [m.name]
        judged = [c for c in dict.fromkeys([*value, *asked]) if c not in m.per]
        varying = varying_within(self.frame, list(m.per), judged)
        bad = [c for c in judged if c in varying and c not in optional]
        if bad:
            raise NotPossible(f"{', '.join(bad)} varies within one {' + '.join(m.per)}, so "
                              f"{m.name} cannot be counted once per unit")
        kept = [c for c in judged if c not in varying]
        units = self.frame.select(*[quoted(c) for c in (*m.per, *kept)]).dropDuplicates()
        return replace(self, source=units, tests=(), unknown=None, _known={},
                       notes=(*self.notes, f"one row per {' + '.join(m.per)}"))


def varying_within(df: DataFrame, unit: list[str], columns: list[str]) -> set[str]:
    """The columns that hold more than one value (NULL counted) inside some unit."""
    if not columns:
        return set()
    spread = []
    for i, c in enumerate(columns):
        v = F.col(quoted(c))
        mixed = (~F.min(v).eqNullSafe(F.max(v))) | ((F.count(v) > 0) & (F.count(v) < F.count(F.lit(1))))
        spread.append(mixed.alias(f"v{i}"))
    judged = df.groupBy(*[quoted(u) for u in unit]).agg(*spread)
    row = judged.agg(*[F.max(f"v{i}").alias(f"v{i}") for i in range(len(columns))]).first()
    return {c for i, c in enumerate(columns) if row[f"v{i}"]}


def scope_for(df: DataFrame, contract: DatasetContract) -> ScopedFrame:
    """The contract's scope over a table: exclusions first, then the window."""
    tests: list[tuple[str, Column]] = []
    unknown = None
    for exclusion in contract.exclusions:
        rule = rule_column(df, exclusion.rule)
        tests.append(("excluded", negated(rule)))
        unknown = rule.isNull() if unknown is None else unknown | rule.isNull()
    if contract.window:
        if not contract.date_column:
            raise ScopeError(f"{contract.dataset} has a window and no date column")
        day = F.col(quoted(contract.date_column))
        tests.append(("no_date", day.isNotNull()))
        tests.append(("outside_window", within(day, contract.window.start, contract.window.end)))
    return ScopedFrame(derived(df, contract.measures), contract, tuple(tests), unknown)
