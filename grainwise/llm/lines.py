"""Line deduplication: a run of three lines that occurs earlier in the corpus is removed where it occurs again.

Built-in functions only. Only hashes of windows move in the search; texts move once, to lose their repeated lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from grainwise.llm.common import ROW, F, cut, numbered, whole_text

RUN = 3


def _windows(rows: DataFrame, run: int) -> DataFrame:
    """(row, doc, at, h, g): a 128-bit hash for every window of `run` lines; a shorter text is one window."""
    line, n = F.col("lines"), F.size("lines")
    text = lambda i: F.array_join(F.slice(line, i + 1, F.lit(run)), "\n")
    return (rows.select("row", "doc", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(n - run, F.lit(0))), lambda i: F.struct(
                i.alias("at"), F.xxhash64(text(i)).alias("h"), F.xxhash64(text(i), F.lit(1)).alias("g")))).alias("x"))
            .select("row", "doc", "x.*"))


def repeated_lines(df: DataFrame, run: int = RUN, cycles: bool = False) -> DataFrame:
    """(row, gone): the numbers, ascending, of the lines that each row of `df` loses; `df` has row, doc_id, text.

    A window is `run` neighbouring lines; it goes wherever it has occurred before (in order of doc_id, then row, then place; null ids
    last), also where new windows overlap it. Of a window that overlaps its own first occurrence, which a line or a cycle of two lines
    said over and over gives, `cycles` removes what lies beyond that first one; else it stays. A line's first occurrence in the corpus
    is never lost: what goes stands at an earlier place. Blank lines count as lines; a text of fewer lines is one window and names
    `run` numbers, an empty text has none.
    """
    rows = (df.where(F.length("text") > 0)
            .select("row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("doc"), F.split("text", "\n").alias("lines")))
    spots = cut(_windows(rows, run))
    first = (spots.groupBy("h", "g").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n"))
             .where("n > 1").select("h", "g", "first"))
    again = spots.join(first, ["h", "g"]).where(F.struct("doc", "at") != F.col("first"))
    beyond = F.when(F.col("doc") == F.col("first.doc"), F.greatest("at", F.col("first.at") + run)).otherwise(F.col("at"))
    if not cycles:
        again = again.where(beyond == F.col("at"))
    later = again.groupBy("row").agg(F.collect_set(F.struct(beyond.alias("opens"), (F.col("at") + run - 1).alias("ends"))).alias("spans"))
    return later.select("row", F.sort_array(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["opens"], s["ends"]))))).alias("gone"))


def dedup_lines(df: DataFrame, run: int = RUN, cycles: bool = False) -> DataFrame:
    """(doc_id, text, n_lines, removed): text without the repeated lines, and the numbers of those removed, as `repeated_lines` says.

    One row per row of `df`, repeated rows and null ids included; other columns are ignored. A null or empty text has no lines and
    stays empty; an empty table gives none. The work on a text is linear in its lines.
    """
    rows = numbered(df.select("doc_id", whole_text().alias("text"))).withColumnRenamed(ROW, "row")
    lines = F.when(F.length("text") > 0, F.split("text", "\n")).otherwise(F.array().cast("array<string>"))
    # The lists grow with the texts, so they are never broadcast, however few they are at first.
    gone = F.filter(F.coalesce("gone", F.array().cast("array<int>")), lambda i: i < F.size("lines"))
    out = rows.join(cut(repeated_lines(rows, run, cycles)).hint("merge"), "row", "left").withColumn("lines", lines).select("doc_id", "lines", gone.alias("removed"))
    # What stays lies between one removed line and the next.
    ended = lambda i: F.coalesce(F.get("removed", i - 1) + 1, F.lit(0))
    n = F.size("lines")
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("removed")), lambda i: F.slice(
        "lines", ended(i) + 1, F.coalesce(F.get("removed", i), n) - ended(i))))
    return out.select("doc_id", F.array_join(kept, "\n").alias("text"), n.cast("long").alias("n_lines"), "removed")


def op8_lines(df: DataFrame) -> DataFrame:
    """The numbers of the lines each document loses, cycles included, and the digest of what stays; odd rows as in `dedup_lines`."""
    return dedup_lines(df, cycles=True).select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"),
                                  F.array_join("removed", ",").alias("removed"), F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, i - 1 AS p0, array_to_string(l[i:i + 2], chr(10)) AS g
      FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 2, 1) + 1)) AS i FROM d)),
r AS (SELECT doc_id, p0, row_number() OVER o AS k, first_value(doc_id) OVER o AS d0, first_value(p0) OVER o AS f0 FROM w
      WINDOW o AS (PARTITION BY g ORDER BY doc_id, p0)),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, d0, f0, unnest(range(p0, p0 + 3)) AS p FROM r WHERE k > 1)
         WHERE NOT (doc_id = d0 AND p < f0 + 3)),
lines AS (SELECT doc_id, unnest(range(0, len(l))) AS p, unnest(l) AS line FROM d),
s AS (SELECT lines.doc_id, string_agg(CASE WHEN gone.p IS NULL THEN line END, chr(10) ORDER BY lines.p) AS kept,
             string_agg(CAST(gone.p AS VARCHAR), ',' ORDER BY lines.p) AS removed, count(*) AS n_lines, count(gone.p) AS n_removed
      FROM lines LEFT JOIN gone ON lines.doc_id = gone.doc_id AND lines.p = gone.p GROUP BY lines.doc_id)
SELECT x.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(removed, '') AS removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents x LEFT JOIN s USING (doc_id)
"""
