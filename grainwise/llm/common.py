"""What the operators of this package share: words, sizes, numbering, and groups of linked nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainwise.session import cut, shuffle_width

#: A word: anything between blanks (space, tab, line feed, vertical tab, form feed, return).
WORD = r"[^\x20\x09-\x0D]+"
#: The column of row numbers, and bits of a row's place within its file.
ROW, PLACE_BITS = "__row", 40


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _scanned(df: DataFrame) -> bool:
    """Whether `df` is a file scan with no more than filters and plain columns over it: each row is one row of a file then."""
    node = df._jdf.queryExecution().analyzed()
    while node.deterministic() and node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    return node.nodeName() == "LogicalRelation"


def numbered(df: DataFrame) -> DataFrame:
    """`df` with ROW, a number of the row that every later read gives again.

    It is the row's place within its Parquet file, and the file's place among the files, so it does not depend on how a scan
    is split, which follows the cores at hand. Rows of anything else are numbered once and written. The driver holds
    the names of the files.
    """
    if "_metadata" not in df.columns and _scanned(df):
        try:
            at = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
        except AnalysisException:  # not Parquet
            return cut(df.withColumn(ROW, F.monotonically_increasing_id()))
        names = sorted(r["__file"] for r in at.select("__file").distinct().collect())
        files = df.sparkSession.createDataFrame(list(enumerate(names)), "__number long, __file string")
        return (at.join(F.broadcast(files), "__file")
                .select(*df.columns, (F.shiftleft("__number", PLACE_BITS) + F.col("__at")).alias(ROW)))
    return cut(df.withColumn(ROW, F.monotonically_increasing_id()))


def row_of(df: DataFrame) -> Column:
    """The rows' numbers where `numbered` gave them, else numbers that hold within this one read."""
    return F.col(ROW) if ROW in df.columns else F.monotonically_increasing_id()


def remainder(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def bounds_of(df: DataFrame, key: str, parts: int) -> list[int]:
    """Up to `parts` - 1 ascending cut points that deal the rows about evenly by a long `key`.

    Only the cut points reach the driver: their number is `parts`, not the number of rows.
    """
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(key, shares, 100 * parts).alias("q")).first()["q"]
    return sorted({int(x) for x in found or []})


def place(key: Column, bounds: Sequence[int]) -> Column:
    """How many of the ascending `bounds` lie below `key`, found by halving."""
    if not bounds:
        return F.lit(0)
    held, n = F.lit(list(bounds)), len(bounds)
    steps = [1 << i for i in reversed(range(n.bit_length()))]
    return F.aggregate(
        F.lit(steps), F.lit(0),
        lambda low, step: F.when((low + step <= n) & (F.get(held, low + step - 1) < key), low + step).otherwise(low))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round of hooking: the neighbours of a node on one side are tied to its smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both if large else both.where("b < a")
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    near = around.where("b > a") if large else around
    tied = near.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = tied if large else tied.union(least.select("a", F.col("m").alias("b")))
    return own.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the long pairs (a, b); component is the smallest node reachable.

    Large-star and small-star rounds run until the pairs stay as they are. Every round is written to the
    shared folder, so a lost executor costs one round and no plan grows.
    """
    now = cut(edges.where("a <> b").distinct())
    mark = None
    while True:
        now = cut(_star(_star(now, large=True), large=False))
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h"),
                       F.sum(F.xxhash64("b", "a") % 998_244_353).alias("g")).first()
        if mark == seen:
            break
        mark = seen
    tops = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops.select("b", "b"))


__all__ = ["ROW", "WORD", "Window", "bounds_of", "components", "cut", "numbered", "place", "remainder", "row_of", "shuffle_width",
           "table", "whole_text", "words_of"]
