"""Profiles of a whole table. Every function reads the table once and returns one row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.contract import is_floating, is_number, is_text
from grainwise.functions import readings
from grainwise.functions.exprs import count_where, finite, finite_value, matches, quoted, ratio
from grainwise.functions.ranks import quantiles
from grainwise.profiling.evidence import column_evidence, hashable, with_roles
from grainwise.session import cut, spread

# Texts that mean a missing value, compared without case.
MISSING_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NAN",
    "1.#IND", "1.#QNAN", "N/A", "NA", "NAN", "NULL",
)
# The types a text column is tested against, narrowest first, and the shares named.
TYPE_ORDER = ("BIGINT", "DOUBLE", "DATE", "TIMESTAMP", "BOOLEAN")
NAMED_SHARE = 0.9
MOSTLY_MISSING = 0.5
FENCE = 1.5


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def number_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def fused(df: DataFrame, columns: list[str], metrics: dict) -> DataFrame:
    """One aggregate over the table for every (column, metric), opened into a row per column.

    `metrics` maps a name to a function of the column name that gives an aggregate.
    """
    if not columns:
        blank = df.agg(*[make(df.columns[0]).alias(k) for k, make in metrics.items()])
        return blank.select(F.lit("").alias("column"), "*").where(F.lit(False))
    aggregates, rows = [], []
    for i, c in enumerate(columns):
        for k, make in metrics.items():
            aggregates.append(make(c).alias(f"{k}_{i}"))
        rows.append(F.struct(F.lit(c).alias("column"), *[F.col(f"{k}_{i}").alias(k) for k in metrics]))
    one = df.agg(*aggregates)
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def melted(df: DataFrame, columns: list[str], value=None) -> DataFrame:
    """column, value: the named columns as rows, NULLs left out."""
    read = value or (lambda c: F.col(quoted(c)))
    cells = [F.when(F.col(quoted(c)).isNotNull(), F.struct(F.lit(c).alias("column"), read(c).alias("value")))
             for c in columns]
    return df.select(F.explode(F.array(*cells)).alias("s")).where("s IS NOT NULL").select("s.*")


#: A text column with at most this share of distinct values is judged once per value; judging costs many times a move.
REPEATING = 0.5


class TextCells:
    """The values of text columns as (column, value, n) rows, folded where values repeat.

    A column whose values repeat is folded to its distinct values, weighted by their rows and
    written once. A column of mostly distinct texts is read where its rows are, because moving
    whole texts would cost more than judging them again.
    """

    def __init__(self, df: DataFrame, columns: list[str]):
        self.df = df
        self.columns = columns
        self.folded: list[str] = []
        self._small = None
        self._sizes: dict[str, int] = {}
        if not columns:
            return
        wide = spread(df.select(*[quoted(c) for c in columns]))
        sizes = wide.agg(*[F.struct(F.approx_count_distinct(quoted(c)), F.count(quoted(c))).alias(f"c{i}")
                         for i, c in enumerate(columns)]).first()
        self.folded = [c for i, c in enumerate(columns) if sizes[i][0] <= REPEATING * sizes[i][1]]
        self._sizes = {c: sizes[i][0 if c in self.folded else 1] for i, c in enumerate(columns)}
        if self.folded:
            self._small = cut(melted(wide, self.folded).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))

    def values(self, columns: list[str] | None = None) -> DataFrame:
        """column, value, n of the named columns, NULLs left out."""
        wanted = self.columns if columns is None else columns
        parts = []
        small = [c for c in wanted if c in self.folded]
        direct = [c for c in wanted if c not in self.folded]
        if small:
            parts.append(spread(self._small.where(F.col("column").isin(small)), self._count(small)))
        if direct:
            parts.append(melted(spread(self.df.select(*[quoted(c) for c in direct]), self._count(direct)), direct).withColumn("n", F.lit(1).cast("long")))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _count(self, columns: list[str]) -> int:
        return sum(self._sizes[c] for c in columns)

    def counts(self, judge, flags: list[str], keep: Column | None = None) -> DataFrame:
        """column and one count per flag. `judge` adds the flags to the values in one projection,
        so a wide table compiles the same code as a narrow one."""
        if not self.columns:
            return self.df.sparkSession.createDataFrame([], "column string, " + ", ".join(f"{k} bigint" for k in flags))
        values = self.values() if keep is None else self.values().where(keep)
        counted = judge(values).groupBy("column").agg(
            *[F.sum(F.when(F.col(k), F.col("n")).otherwise(0)).alias(k) for k in flags])
        names = F.explode(F.array(*[F.lit(c) for c in self.columns])).alias("column")
        every = self.df.sparkSession.range(1).select(names)
        return every.join(counted, "column", "left").select("column", *[F.coalesce(k, F.lit(0)).alias(k) for k in flags])


def numeric_profile(df: DataFrame) -> DataFrame:
    """column, mean, stddev, q1, median, q3, non_finite over finite values. One ranked pass serves every column."""
    columns = number_columns(df)
    value = {c: finite_value(df, c) for c in columns}

    def strange(c: str) -> Column:
        return count_where(F.col(quoted(c)).isNotNull() & ~finite(df, c)) if is_floating(df.schema[c].dataType) else F.lit(0).cast("long")

    basics = {"mean": lambda c: F.avg(value[c]), "stddev": lambda c: F.stddev_samp(value[c]), "non_finite": strange}
    out = fused(df, columns, basics)
    if columns:
        values = melted(df, columns, lambda c: value[c])
        out = out.join(quantiles(values, "value", [0.25, 0.5, 0.75], ("column",)), "column", "left")
    else:
        out = out.withColumn("q", F.lit(None).cast("array<double>"))
    return out.select("column", "mean", "stddev", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                      F.col("q")[2].alias("q3"), "non_finite")


def _token(c: str, tokens) -> Column:
    return F.upper(F.trim(F.col(quoted(c)))).isin([t.upper() for t in tokens]) if tokens else F.lit(False)


def missing_profile(df: DataFrame, tokens=MISSING_TOKENS) -> DataFrame:
    """column, nulls, blank, tokens, missing: every way a text value can be absent."""
    return fused(df, text_columns(df), {
        "nulls": lambda c: F.count_if(F.col(quoted(c)).isNull()),
        "blank": lambda c: count_where(F.trim(F.col(quoted(c))) == ""),
        "tokens": lambda c: count_where(_token(c, tokens)),
    }).withColumn("missing", F.col("nulls") + F.col("blank") + F.col("tokens"))


def token_breakdown(df: DataFrame, tokens=MISSING_TOKENS) -> DataFrame:
    """column, token, rows: missing tokens as they are written."""
    cells = [F.when(F.coalesce(_token(c, tokens), F.lit(False)),
                    F.struct(F.lit(c).alias("column"), F.trim(F.col(quoted(c))).alias("token")))
             for c in text_columns(df)]
    if not cells:
        return df.select(F.lit("").alias("column"), F.lit("").alias("token"), F.lit(0).alias("rows")).limit(0)
    found = df.select(F.explode(F.array_compact(F.array(*cells))).alias("s")).select("s.*")
    return found.groupBy("column", "token").agg(F.count(F.lit(1)).alias("rows"))


def considered(c: str, tokens) -> Column:
    """A value a type reading is judged on: present, not blank, not a missing token."""
    v = F.col(quoted(c))
    return v.isNotNull() & (F.trim(v) != "") & ~_token(c, tokens)


def reads_as(c: Column, kind: str) -> Column:
    reading = {"BIGINT": readings.whole_number, "DOUBLE": readings.number, "DATE": readings.day,
               "TIMESTAMP": readings.moment, "BOOLEAN": readings.truth}[kind]
    return reading(c).isNotNull()


def _read_cells(cells: DataFrame) -> DataFrame:
    """Each reading once per value, in steps, so that no generated method grows past the JIT."""
    v, d, at = F.col("value"), F.col("__d"), F.col("__at")
    bare = readings.number(readings.currency_text(v))
    read = cells.withColumns({"__d": readings.number(v), "__at": readings.moment(v), "__w": F.trim(v)})
    whole = matches(F.col("__w"), r"[+-]?\d+") & F.col("__w").try_cast("bigint").isNotNull()
    return read.withColumns({
        "considered": F.lit(True),
        "bigint": whole | ((d == F.floor(d)) & (F.abs(d) < F.lit(9.2e18))),
        "double": d.isNotNull(), "timestamp": at.isNotNull(), "date": at == F.date_trunc("day", at),
        "boolean": readings.truth(v).isNotNull(), "leading_zeros": v.rlike(readings.LEADING_ZERO),
        "currency": F.when(v.rlike(readings.CURRENCY), bare.isNotNull()),
    })


def type_reading(df: DataFrame, tokens=MISSING_TOKENS) -> DataFrame:
    """column, considered, hits per type, leading_zeros, currency, best, ratio, is_named.

    The casts run where the rows are and only counts are shuffled: at scale that is cheaper than
    moving every distinct text to count it once. One projection serves every column.
    """
    columns = text_columns(df)
    flags = [*[k.lower() for k in TYPE_ORDER], "considered", "leading_zeros", "currency"]
    counts = TextCells(df, columns).counts(_read_cells, flags, considered("value", tokens))
    top = F.greatest(*[F.col(k.lower()) for k in TYPE_ORDER])
    best = F.lit(None).cast("string")
    for k in reversed(TYPE_ORDER):
        best = F.when((top > 0) & (F.col(k.lower()) == top), F.lit(k)).otherwise(best)
    share = ratio(top, F.col("considered"))
    return counts.withColumns({"best": best, "ratio": F.when(top > 0, share),
                               "is_named": F.coalesce(share >= NAMED_SHARE, F.lit(False)) & (top > 0)})


def parse_failures(df: DataFrame, column: str, kind: str, limit: int = 3, tokens=MISSING_TOKENS) -> DataFrame:
    """The first distinct values, in order, that do not read as a type."""
    v = F.col(quoted(column))
    bad = df.where(considered(column, tokens) & ~reads_as(v, kind))
    return bad.select(v.alias("value")).distinct().orderBy("value").limit(limit)


def outlier_profile(df: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """column, lower_fence, upper_fence, below, above: Tukey's counts of every numeric column.

    The fences are one row per column and come to the driver as literals, so the counting pass is
    one plain aggregate. A zero spread gives no fence.
    """
    numbers = numeric_profile(df) if numbers is None else numbers
    fences = {}
    for r in numbers.collect():  # one row per column
        if r["q1"] is not None and r["q3"] > r["q1"]:
            reach = FENCE * (r["q3"] - r["q1"])
            fences[r["column"]] = (r["q1"] - reach, r["q3"] + reach)
    none = F.lit(None).cast("double")

    def side(c, at, test):
        return count_where(finite(df, c) & test(F.col(quoted(c)).cast("double"), F.lit(fences[c][at]))) if c in fences else F.lit(None).cast("long")

    return fused(df, number_columns(df), {
        "lower_fence": lambda c: F.max(F.lit(fences[c][0])) if c in fences else none,
        "upper_fence": lambda c: F.max(F.lit(fences[c][1])) if c in fences else none,
        "below": lambda c: side(c, 0, lambda v, f: v < f),
        "above": lambda c: side(c, 1, lambda v, f: v > f),
    })


def row_key(df: DataFrame) -> list[Column]:
    """Two hashes of the whole row, NULL apart from every value."""
    parts = []
    for f in df.schema.fields:
        parts += [hashable(f), F.col(quoted(f.name)).isNull()]
    return [F.xxhash64(*parts).alias("__h0"), F.xxhash64(F.lit(1), *parts).alias("__h1")]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """rows, distinct_rows, duplicates. Rows travel as two hashes, folded before the shuffle."""
    groups = df.select(*row_key(df)).groupBy("__h0", "__h1").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows")).withColumn(
        "duplicates", F.col("rows") - F.col("distinct_rows"))


def profile_table(df: DataFrame, only: str | None = None, tokens=MISSING_TOKENS) -> DataFrame:
    """Everything above, one row per column. Naming a column prunes the scan to it."""
    table = df.select(quoted(only)) if only else df
    evidence = with_roles(column_evidence(table))
    numbers = cut(numeric_profile(table))  # one row a column, read for the fences and for the result
    parts = [missing_profile(table, tokens).drop("nulls"), numbers,
             type_reading(table, tokens).select("column", "best", "ratio", "is_named", "leading_zeros", "currency"),
             outlier_profile(table, numbers)]
    out = evidence
    for part in parts:
        out = out.join(part, "column", "left")  # one row per column on both sides
    missing = F.coalesce("missing", F.col("nulls"))
    return out.withColumns({
        "missing": missing, "missing_ratio": ratio(missing, F.col("rows")),
        "is_mostly_missing": F.coalesce(ratio(missing, F.col("rows")) >= MOSTLY_MISSING, F.lit(False)),
        "is_constant": F.col("distinct") <= 1,
        "is_unique": (F.col("rows") > 0) & (F.col("distinct") == F.col("rows")),
        "is_misread": F.coalesce(F.col("is_named"), F.lit(False)),
        "has_outliers": F.coalesce(F.col("below") + F.col("above") > 0, F.lit(False)),
    })


def profile_flags(df: DataFrame) -> DataFrame:
    """column, flag: the findings worth a line, in the order a summary would give them."""
    p = profile_table(df)
    named = {
        "mostly_missing": F.col("is_mostly_missing"), "constant": F.col("is_constant"),
        "unique": F.col("is_unique"), "misread": F.col("is_misread"),
        "hidden_missing": F.coalesce(F.col("blank") + F.col("tokens") > 0, F.lit(False)),
        "outliers": F.col("has_outliers") & (F.col("role") == "measure"),
    }
    flags = F.array_compact(F.array(*[F.when(test, F.lit(k)) for k, test in named.items()]))
    return p.select("column", F.explode(flags).alias("flag"))
