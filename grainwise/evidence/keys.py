"""Keys: found, verified, and how near the nearest one came."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.functions.exprs import quoted
from grainwise.profiling.evidence import IDENTIFIER_NAME, ColumnEvidence, gather, hashable
from grainwise.profiling.table import duplicate_rows
from grainwise.scope import varying_within

# The roles a key may be made of.
KEY_ROLES = ("identifier", "dimension", "date", "flag")
#: Pairs estimated in one aggregate. All are probed, in as many aggregates as that takes.
PAIRS_AT_ONCE = 200
#: A pair whose estimate falls this far under the row count cannot be unique (the estimate is within 2%).
SCREEN = 0.85


@dataclass(frozen=True)
class KeyVerdict:
    columns: tuple[str, ...]
    rows: int
    keyed_rows: int
    distinct: int
    nulls: tuple[int, ...]

    @property
    def duplicates(self) -> int:
        return self.keyed_rows - self.distinct

    @property
    def holds(self) -> bool:
        return self.duplicates == 0 and not any(self.nulls)


def _key_hash(df: DataFrame, columns) -> list:
    """Two hashes of a tuple in which NULL is a value like any other."""
    parts = []
    for c in columns:
        parts += [hashable(df.schema[c]), F.col(quoted(c)).isNull()]
    return [F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)]


def verify(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows, keyed_rows, distinct, duplicates, null_rows, holds of a stated key.

    A single column leaves its NULLs out of the distinct test; a composite keeps them. Tuples are
    folded to hashes and counted before the shuffle merges them.
    """
    nulls = [F.col(quoted(c)).isNull() for c in columns]
    any_null = nulls[0]
    for n in nulls[1:]:
        any_null = any_null | n
    h = _key_hash(df, columns)
    keyed = df.select(h[0].alias("a"), h[1].alias("b"), any_null.alias("is_null"))
    groups = keyed.groupBy("a", "b", "is_null").agg(F.count(F.lit(1)).alias("n"))
    counts = (F.col("is_null") == F.lit(False)) if len(columns) == 1 else F.lit(True)
    total = lambda test, v: F.coalesce(F.sum(F.when(test, v)), F.lit(0))
    out = groups.agg(
        total(F.lit(True), F.col("n")).alias("rows"), total(counts, F.col("n")).alias("keyed_rows"),
        F.count_if(counts).alias("distinct"), total(F.col("is_null"), F.col("n")).alias("null_rows"))
    return out.withColumn("duplicates", F.col("keyed_rows") - F.col("distinct")).withColumn(
        "holds", (F.col("duplicates") == 0) & (F.col("null_rows") == 0))


def repeated_keys(df: DataFrame, columns: list[str], limit: int = 10) -> DataFrame:
    """The keys held by most rows, as evidence."""
    keys = [F.col(quoted(c)) for c in columns]
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return grouped.orderBy(F.col("rows").desc(), *[k.asc_nulls_last() for k in keys]).limit(limit)


def exact_copies(df: DataFrame) -> DataFrame:
    return duplicate_rows(df).select(F.col("duplicates").alias("copies"))


def key_singles(df: DataFrame, evidence: list[ColumnEvidence] | None = None) -> DataFrame:
    """column, rows, distinct, is_key: a key's distinct values equal its rows, which NULLs cannot."""
    ev = evidence or gather(df)
    rows = [(c.name, c.rows, c.distinct, c.is_unique) for c in ev]
    return df.sparkSession.createDataFrame(rows, "column string, rows bigint, distinct bigint, is_key boolean")


def candidate_pairs(evidence: list[ColumnEvidence]) -> list[tuple[str, str]]:
    """Pairs worth probing, likeliest first.

    A column unique by itself makes every pair unique, a constant adds nothing, and a pair cannot
    be unique when its sides do not multiply to the row count.
    """
    n = evidence[0].rows if evidence else 0
    usable = [c for c in evidence if c.distinct > 1 and not c.is_unique and c.role in KEY_ROLES]
    pairs = [(a, b) for a, b in itertools.combinations(usable, 2) if a.distinct * b.distinct >= n]

    def likelihood(pair):
        named = any(re.search(IDENTIFIER_NAME, c.name) for c in pair)
        return (not named, min(c.distinct for c in pair))

    return [(a.name, b.name) for a, b in sorted(pairs, key=likelihood)]


def key_pairs(df: DataFrame, evidence: list[ColumnEvidence] | None = None) -> DataFrame:
    """first, second, distinct, rows, is_unique for the pairs that survive an estimate.

    Estimates screen every pair; one exact job counts the survivors together.
    """
    ev = evidence or gather(df)
    schema = "first string, second string, distinct bigint, rows bigint, is_unique boolean"
    pairs = candidate_pairs(ev)
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], schema)
    n = ev[0].rows
    alive = []
    for at in range(0, len(pairs), PAIRS_AT_ONCE):
        some = pairs[at:at + PAIRS_AT_ONCE]
        estimate = df.agg(*[F.approx_count_distinct(_key_hash(df, p)[0], 0.02) for p in some]).first()
        alive += [p for p, seen in zip(some, estimate) if seen >= SCREEN * n]
    if not alive:
        return spark.createDataFrame([], schema)
    cells = []
    for i, p in enumerate(alive):
        h = _key_hash(df, p)
        cells.append(F.struct(F.lit(i).alias("i"), h[0].alias("a"), h[1].alias("b")))
    seen = df.select(F.explode(F.array(*cells)).alias("s")).select("s.*").distinct()
    counts = {r["i"]: r["n"] for r in seen.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = [(a, b, counts.get(i, 0), n, counts.get(i, 0) == n) for i, (a, b) in enumerate(alive)]
    return spark.createDataFrame(rows, schema)


def nearest_key(df: DataFrame, evidence: list[ColumnEvidence] | None = None) -> DataFrame:
    """column, repeats, null_rows, copies, fixed_by_removing_copies for the nearest identifier.

    Removing copies fixes a column when its values number as many as the distinct rows.
    """
    ev = evidence or gather(df)
    names = [c for c in ev if c.role == "identifier"]
    schema = "column string, repeats bigint, null_rows bigint, copies bigint, fixed_by_removing_copies boolean"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    best = min(names, key=lambda c: (c.non_null - c.distinct) + c.nulls)
    copies = duplicate_rows(df).first()
    fixed = best.distinct == copies["distinct_rows"] and best.nulls == 0
    return df.sparkSession.createDataFrame(
        [(best.name, best.non_null - best.distinct, best.nulls, copies["duplicates"], fixed)], schema)


def unit_constancy(df: DataFrame, unit: list[str], columns: list[str]) -> DataFrame:
    """column, is_constant: whether each column holds one value within every unit. One grouped job."""
    varying = varying_within(df, unit, columns)
    rows = [(c, c not in varying) for c in columns]
    return df.sparkSession.createDataFrame(rows, "column string, is_constant boolean")
