"""Cleaning: what is proposed for orders as a damaged export, and what applying it does."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainwise.cleaning import actions as act
from grainwise.cleaning import detect
from grainwise.cleaning.actions import Action, perform
from grainwise.cleaning.apply import apply, safe_actions
from grainwise.plans.base import DIRTY_SQL, REPEATED_SQL, dirty, query, r6, repeated, table
from grainwise.profiling.table import TextCells
from grainwise.session import cut, shared_folder, spread
from grainwise.store import Workspace


@query("clean_proposed_type", DIRTY_SQL + """SELECT 'units' AS "column", 'BIGINT' AS to_type FROM d WHERE TRY_CAST(units AS DOUBLE) IS NOT NULL HAVING count(*) >= 0.9 * (SELECT count(units) FROM d)
UNION ALL SELECT 'price_text', 'DECIMAL(18,2)' FROM d WHERE TRY_CAST(price_text AS DOUBLE) IS NOT NULL HAVING count(*) >= 0.9 * (SELECT count(price_text) FROM d)
UNION ALL SELECT 'iso_day', 'DATE' FROM d WHERE TRY_CAST(iso_day AS DATE) IS NOT NULL HAVING count(*) >= 0.9 * (SELECT count(iso_day) FROM d)
UNION ALL SELECT 'mixed_day', 'DATE' FROM d WHERE regexp_full_match(mixed_day, '\\d{4}-\\d{2}-\\d{2}') HAVING count(*) >= 0.9 * (SELECT count(mixed_day) FROM d)
UNION ALL SELECT 'large', 'BOOLEAN' FROM d WHERE upper(large) IN ('TRUE', 'FALSE') HAVING count(*) = (SELECT count(large) FROM d)""")
def _(spark, folder):
    counts = detect.text_counts(dirty(spark, folder), act.DEFAULT_MISSING, flags=detect.TYPE_FLAGS).collect()
    rows = [(r["column"], detect.proposed_type(r.asDict())) for r in counts]
    return spark.createDataFrame([r for r in rows if r[1]], "column string, to_type string")


@query("clean_currency", DIRTY_SQL + f"""SELECT count(TRY_CAST(regexp_replace(amount, '[₹$€£¥,\\s]', '', 'g') AS DECIMAL(18,2))) AS parsed,
{r6("sum(TRY_CAST(regexp_replace(amount, '[₹$€£¥,\\s]', '', 'g') AS DECIMAL(18,2)))", 'total')} FROM d""")
def _(spark, folder):
    df = perform(dirty(spark, folder), Action("C001", act.CONVERT_TYPE, "amount", "DECIMAL(18,2)", "currency"))
    return df.agg(F.count("amount").alias("parsed"), F.sum("amount").alias("total"))


@query("clean_separators", DIRTY_SQL + f"""SELECT {r6("sum(CAST(replace(eu_amount, ',', '.') AS DECIMAL(18,2)))", 'eu')}, sum(CAST(replace(rate, '%', '') AS BIGINT)) AS percent,
{r6("sum(CASE WHEN ledger LIKE '(%' THEN -CAST(replace(replace(ledger, '(', ''), ')', '') AS DECIMAL(18,2)) ELSE CAST(ledger AS DECIMAL(18,2)) END)", 'accounting')} FROM d""")
def _(spark, folder):
    df = dirty(spark, folder)
    for c, t, r in (("eu_amount", "DECIMAL(18,2)", "eu"), ("rate", "BIGINT", "percent"), ("ledger", "DECIMAL(18,2)", "us")):
        df = perform(df, Action("C001", act.CONVERT_TYPE, c, t, r))
    return df.agg(F.sum("eu_amount").alias("eu"), F.sum("rate").alias("percent"), F.sum("ledger").alias("accounting"))


@query("clean_mixed_dates", """SELECT count(*) AS rows, count(*) AS mixed, count(*) AS short, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last,
CAST(sum(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))) AS BIGINT) AS days FROM orders""")
def _(spark, folder):
    df = dirty(spark, folder)
    for c in ("mixed_day", "short_day"):
        df = perform(df, Action("C001", act.CONVERT_TYPE, c, "DATE", "dates:day"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count("mixed_day").alias("mixed"), F.count("short_day").alias("short"), F.min("short_day").alias("first"),
                  F.max("mixed_day").alias("last"), F.sum(F.datediff("short_day", F.lit("1990-01-01"))).alias("days"))


@query("clean_drop_duplicates", REPEATED_SQL + f"SELECT count(*) AS rows, {r6('sum(CAST(o_totalprice AS DECIMAL(18,2)))', 'total')} FROM (SELECT DISTINCT * FROM d)")
def _(spark, folder):
    kept = perform(repeated(spark, folder), Action("C001", act.DROP_DUPLICATE_ROWS))
    return kept.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))


@query("clean_header_rows", "SELECT count(*) AS rows, (SELECT count(*) FROM region) AS headers FROM nation")
def _(spark, folder):
    # A pasted header line per region, among the nations as text.
    data = table(spark, folder, "nation").select(*[F.col(c).cast("string") for c in ("n_nationkey", "n_name", "n_regionkey")])
    heads = table(spark, folder, "region").select(F.lit("n_nationkey").alias("n_nationkey"), F.lit("N NAME").alias("n_name"), F.lit("n_regionkey").alias("n_regionkey"))
    both = data.unionByName(heads)
    kept = perform(both, Action("C001", act.DROP_HEADER_ROWS))
    found = both.agg(F.count_if(act.header_copy(both)).alias("n")).scalar()
    return kept.agg(F.count(F.lit(1)).alias("rows"), F.max(found).alias("headers"))


@query("clean_convert_type", DIRTY_SQL + f"""SELECT count(TRY_CAST(price_text AS DECIMAL(18,2))) AS converted, {r6('sum(TRY_CAST(price_text AS DECIMAL(18,2)))', 'total')},
count(*) FILTER (WHERE price_text = 'not priced') AS lost, count(*) AS padded FROM d""")
def _(spark, folder):
    df = dirty(spark, folder)
    done = perform(df, Action("C001", act.CONVERT_TYPE, "price_text", "DECIMAL(18,2)", "cast"))
    lost = df.agg(F.count_if(act.lost(F.col("price_text"), "DECIMAL(18,2)", "cast", act.DEFAULT_MISSING)).alias("lost"),
                  F.count_if(act.lost(F.col("account"), "BIGINT", "cast", act.DEFAULT_MISSING)).alias("padded"))
    return done.agg(F.count("price_text").alias("converted"), F.sum("price_text").alias("total"),
                    F.max(lost.select("lost").scalar()).alias("lost"), F.max(lost.select("padded").scalar()).alias("padded"))


@query("clean_normalise_missing", DIRTY_SQL + "SELECT count(*) - count(*) FILTER (WHERE upper(trim(units)) IN ('N/A', '')) AS present FROM d")
def _(spark, folder):
    df = perform(dirty(spark, folder), Action("C001", act.NORMALISE_MISSING, "units", tokens=act.DEFAULT_MISSING))
    return df.agg(F.count("units").alias("present"))


@query("clean_trim", DIRTY_SQL + "SELECT trim(status) AS status, count(*) AS rows FROM d GROUP BY 1")
def _(spark, folder):
    return perform(dirty(spark, folder), Action("C001", act.TRIM_WHITESPACE, "status")).groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


@query("clean_case", DIRTY_SQL + """SELECT upper(priority) AS priority, count(*) AS rows, (SELECT count(DISTINCT priority) - count(DISTINCT upper(priority)) FROM d) AS merged FROM d GROUP BY 1""")
def _(spark, folder):
    df = dirty(spark, folder)
    merged = detect.merged_spellings(TextCells(df, ["priority"]), ["priority"])["priority"]
    done = perform(df, Action("C001", act.NORMALISE_CASE, "priority", reading="upper"))
    return done.groupBy("priority").agg(F.count(F.lit(1)).alias("rows"), F.max(F.lit(merged)).alias("merged"))


@query("clean_non_finite", DIRTY_SQL + f"SELECT count(*) FILTER (WHERE isfinite(reading)) AS present, {r6('max(reading) FILTER (WHERE isfinite(reading))', 'highest')} FROM d")
def _(spark, folder):
    df = perform(dirty(spark, folder), Action("C001", act.NULL_NON_FINITE, "reading"))
    return df.agg(F.count("reading").alias("present"), F.max("reading").alias("highest"))


@query("clean_exclude_column", "SELECT count(*) AS rows, 'o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority' AS columns FROM orders")
def _(spark, folder):
    df = perform(table(spark, folder, "orders"), Action("C001", act.EXCLUDE_COLUMN, "o_orderstatus"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(", ".join(df.columns)).alias("columns"))


_PLAN = {
    "C001": ("CONVERT_TYPE", "amount", "DECIMAL(18,2)", "count(amount)", "0"),
    "C002": ("CONVERT_TYPE", "units", "BIGINT", "count(units)", "0"),
    "C003": ("NORMALISE_MISSING", "units", None, "count(*) FILTER (WHERE units IN ('n/a', ''))", "0"),
    "C004": ("CONVERT_TYPE", "price_text", "DECIMAL(18,2)", "count(price_text)", "count(*) FILTER (WHERE price_text = 'not priced')"),
    "C005": ("CONVERT_TYPE", "iso_day", "DATE", "count(iso_day)", "0"),
    "C006": ("CONVERT_TYPE", "eu_day", "DATE", "count(eu_day)", "0"),
    "C007": ("CONVERT_TYPE", "mixed_day", "DATE", "count(mixed_day)", "0"),
    "C008": ("CONVERT_TYPE", "short_day", "DATE", "count(short_day)", "0"),
    "C009": ("NORMALISE_CASE", "priority", None, "count(*) FILTER (WHERE priority <> upper(priority))", "count(DISTINCT priority) - count(DISTINCT upper(priority))"),
    "C010": ("TRIM_WHITESPACE", "status", None, "count(*) FILTER (WHERE status <> trim(status))", "0"),
    "C011": ("CONVERT_TYPE", "large", "BOOLEAN", "count(large)", "0"),
    "C012": ("CONVERT_TYPE", "rate", "BIGINT", "count(rate)", "0"),
    "C013": ("CONVERT_TYPE", "eu_amount", "DECIMAL(18,2)", "count(eu_amount)", "0"),
    "C014": ("CONVERT_TYPE", "ledger", "DECIMAL(18,2)", "count(ledger)", "0"),
    "C015": ("NULL_NON_FINITE", "reading", None, "count(*) FILTER (WHERE NOT isfinite(reading))", "count(*) FILTER (WHERE NOT isfinite(reading))"),
}


@query("clean_plan", DIRTY_SQL + " UNION ALL ".join(
    f"""SELECT '{i}' AS action_id, '{k}' AS kind, '{c}' AS "column", {f"'{t}'" if t else 'CAST(NULL AS VARCHAR)'} AS to_type, {a} AS rows_affected, {lost} AS values_lost FROM d"""
    for i, (k, c, t, a, lost) in _PLAN.items()))
def _(spark, folder):
    df = cut(spread(dirty(spark, folder)))  # as loaded: a plan is made for a written table
    return detect.plan_rows(df, detect.detect(df, "export")).select("action_id", "kind", "column", "to_type", "rows_affected", "values_lost")


def _narrow(spark, folder):
    """Five damaged columns with repeated rows: enough for every kind of step of an apply."""
    df = dirty(spark, folder).select("account", "units", "price_text", "status", "large")
    return df.unionAll(df.where("price_text < '15'"))


_NARROW_SQL = DIRTY_SQL + """, e AS (SELECT account, units, price_text, status, "large" FROM d UNION ALL SELECT account, units, price_text, status, "large" FROM d WHERE price_text < '15')
"""


@query("clean_safe_actions", _NARROW_SQL + """SELECT 'NORMALISE_MISSING' AS kind, 'units' AS "column" FROM e WHERE units IN ('n/a', '') HAVING count(*) > 0
UNION ALL SELECT 'TRIM_WHITESPACE', 'status' FROM e WHERE status <> trim(status) HAVING count(*) > 0
UNION ALL SELECT 'CONVERT_TYPE', 'large' FROM e WHERE "large" IN ('true', 'false') HAVING count(*) > 0""")
def _(spark, folder):
    df = _narrow(spark, folder)
    picked = safe_actions(detect.detect(df, "export"))
    return spark.createDataFrame([(a.kind, a.column) for a in picked], "kind string, column string")


def _applied(spark, folder) -> Workspace:
    from datetime import datetime
    space = Workspace(spark, shared_folder(spark, "space"))
    space.register("export", _narrow(spark, folder))
    plan = detect.detect(space.read("export"), "export")
    wanted = [a.action_id for a in plan.actions if a.kind in (act.DROP_DUPLICATE_ROWS, act.NORMALISE_MISSING, act.TRIM_WHITESPACE) or a.column == "large"]
    apply(space, plan, wanted, "plan-1", at=datetime(2024, 1, 1))
    return space


@query("clean_apply", _NARROW_SQL + """, u AS (SELECT DISTINCT * FROM e)
SELECT count(*) AS rows, count(CASE WHEN units NOT IN ('n/a', '') THEN 1 END) AS units, count(DISTINCT trim(status)) AS statuses, count(*) FILTER (WHERE "large" = 'true') AS "large" FROM u""")
def _(spark, folder):
    df = _applied(spark, folder).read("export")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count("units").alias("units"), F.count_distinct("status").alias("statuses"), F.count_if("large").alias("large"))


@query("cleaning_ledger", _NARROW_SQL + """, n AS (SELECT (SELECT count(*) FROM e) AS b, (SELECT count(*) FROM (SELECT DISTINCT * FROM e)) AS a)
SELECT kind, CASE WHEN kind = 'DROP_DUPLICATE_ROWS' THEN b ELSE a END AS rows_before, a AS rows_after, 1 AS history_version
FROM n, (SELECT unnest(['DROP_DUPLICATE_ROWS', 'NORMALISE_MISSING', 'TRIM_WHITESPACE', 'CONVERT_TYPE']) AS kind)""")
def _(spark, folder):
    return _applied(spark, folder).log("ledger").select("kind", "rows_before", "rows_after", "history_version")


@query("snapshot_read", _NARROW_SQL + """SELECT 1 AS version, count(*) AS rows FROM e UNION ALL SELECT 2, count(*) FROM (SELECT DISTINCT * FROM e)""")
def _(spark, folder):
    space = _applied(spark, folder)
    parts = [space.read("export", v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("rows")) for v in (1, 2)]
    return parts[0].unionByName(parts[1])
