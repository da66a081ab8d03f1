"""Profiles of the given tables, and of orders as a damaged export would write them."""

from __future__ import annotations

from grainwise.plans.base import (
    DIRTY_SQL, DIRTY_TEXT, REPEATED_SQL, dirty, query, r6, repeated, table)
from grainwise.profiling import column as one
from grainwise.profiling import evidence as ev
from grainwise.profiling import table as profile

_NUMBER = {"bigint", "int", "double"}


def _evidence(source: str, columns: dict[str, str]) -> str:
    """The evidence of each column, as one SELECT per column."""
    out = []
    for c, kind in columns.items():
        low, high = (r6(f"{f}({c})", a) if kind in _NUMBER else f"CAST(NULL AS DOUBLE) AS {a}" for f, a in (("min", "low"), ("max", "high")))
        if kind in ("timestamp", "timestamp_ntz"):
            first, last = (f"strftime({f}({c}), '%Y-%m-%d %H:%M:%S')" for f in ("min", "max"))
        elif kind == "string":
            first, last = f"min({c})", f"max({c})"
        else:
            first = last = "CAST(NULL AS VARCHAR)"
        out.append(f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS non_null, count(*) - count({c}) AS nulls, "
                   f"count(DISTINCT {c}) AS \"distinct\", {low}, {high}, {first} AS first, {last} AS last FROM {source}")
    return " UNION ALL ".join(out)


_ORDERS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
           "o_orderdate": "timestamp", "o_orderpriority": "string"}
_LINEITEM = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
             "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
             "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp"}
_DOCS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


@query("column_evidence", _evidence("lineitem", _LINEITEM))
def _(spark, folder):
    return ev.column_evidence(table(spark, folder, "lineitem")).drop("dtype", "at")


@query("column_evidence_text", _evidence("documents", _DOCS))
def _(spark, folder):
    return ev.column_evidence(table(spark, folder, "documents")).drop("dtype", "at")


def _numeric(source: str, columns) -> str:
    out = []
    for c in columns:
        v = f"CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END"
        q = [r6(f"quantile_cont({v}, {p})", a) for p, a in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
        out.append(f"SELECT '{c}' AS \"column\", {r6(f'avg({v})', 'mean')}, {r6(f'stddev_samp({v})', 'stddev')}, {', '.join(q)}, "
                   f"count(*) FILTER (WHERE {c} IS NOT NULL AND NOT isfinite(CAST({c} AS DOUBLE))) AS non_finite FROM {source}")
    return " UNION ALL ".join(out)


@query("profile_numeric", _numeric("lineitem", [c for c, k in _LINEITEM.items() if k in _NUMBER]))
def _(spark, folder):
    return profile.numeric_profile(table(spark, folder, "lineitem"))


@query("profile_non_finite", DIRTY_SQL + _numeric("d", ["o_orderkey", "reading"]))
def _(spark, folder):
    return profile.numeric_profile(dirty(spark, folder))


_TOKENS = ", ".join(f"'{t}'" for t in profile.MISSING_TOKENS)


@query("profile_missing", DIRTY_SQL + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) FILTER (WHERE trim({c}) = '') AS blank,
count(*) FILTER (WHERE upper(trim({c})) IN ({_TOKENS})) AS tokens,
count(*) FILTER (WHERE {c} IS NULL OR trim({c}) = '' OR upper(trim({c})) IN ({_TOKENS})) AS missing FROM d""" for c in DIRTY_TEXT))
def _(spark, folder):
    return profile.missing_profile(dirty(spark, folder))


@query("token_breakdown", DIRTY_SQL + f"""SELECT 'units' AS "column", trim(units) AS token, count(*) AS rows FROM d
WHERE upper(trim(units)) IN ({_TOKENS}) GROUP BY 2""")
def _(spark, folder):
    return profile.token_breakdown(dirty(spark, folder))


def _reading(c: str) -> str:
    keep = f"{c} IS NOT NULL AND trim({c}) <> '' AND upper(trim({c})) NOT IN ({_TOKENS})"
    full = f"regexp_full_match(trim({c}), '\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}')"
    hits = {
        "bigint": f"TRY_CAST({c} AS BIGINT) IS NOT NULL AND TRY_CAST({c} AS DOUBLE) = CAST(TRY_CAST({c} AS BIGINT) AS DOUBLE)",
        "double": f"TRY_CAST({c} AS DOUBLE) IS NOT NULL",
        "date": f"{full} AND TRY_CAST({c} AS DATE) IS NOT NULL",
        "timestamp": f"{full} AND TRY_CAST({c} AS TIMESTAMP) IS NOT NULL",
        "boolean": f"TRY_CAST({c} AS BOOLEAN) IS NOT NULL",
    }
    counts = ", ".join(f"count(*) FILTER (WHERE {keep} AND {h}) AS \"{k}\"" for k, h in hits.items())
    return f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {keep}) AS considered, {counts},
count(*) FILTER (WHERE {keep} AND regexp_matches({c}, '^[+-]?0[0-9]')) AS leading_zeros,
count(*) FILTER (WHERE {keep} AND regexp_matches({c}, '[₹$€£¥,]') AND TRY_CAST(regexp_replace({c}, '[₹$€£¥,\\s]', '', 'g') AS DOUBLE) IS NOT NULL) AS currency FROM d"""


@query("type_reading", DIRTY_SQL + ", k AS (" + " UNION ALL ".join(_reading(c) for c in DIRTY_TEXT) + f"""),
t AS (SELECT *, greatest("bigint", "double", "date", "timestamp", "boolean") AS top FROM k)
SELECT "column", considered, "bigint", "double", "date", "timestamp", "boolean", leading_zeros, currency,
CASE WHEN top = 0 THEN NULL WHEN "bigint" = top THEN 'BIGINT' WHEN "double" = top THEN 'DOUBLE' WHEN "date" = top THEN 'DATE'
WHEN "timestamp" = top THEN 'TIMESTAMP' ELSE 'BOOLEAN' END AS best,
{r6('CASE WHEN top > 0 THEN top * 1.0 / considered END', 'ratio')}, top > 0 AND top * 1.0 / considered >= 0.9 AS is_named FROM t""")
def _(spark, folder):
    return profile.type_reading(dirty(spark, folder))


@query("parse_failures", DIRTY_SQL + """SELECT DISTINCT price_text AS value FROM d WHERE TRY_CAST(price_text AS DOUBLE) IS NULL
UNION SELECT value FROM (SELECT DISTINCT amount AS value FROM d ORDER BY 1 LIMIT 3)""")
def _(spark, folder):
    df = dirty(spark, folder)
    return profile.parse_failures(df, "price_text", "DOUBLE").union(profile.parse_failures(df, "amount", "DOUBLE"))


def _fences(source: str, columns) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", {r6('lo', 'lower_fence')}, {r6('hi', 'upper_fence')},
(SELECT count(*) FROM {source} WHERE {c} < lo) AS below, (SELECT count(*) FROM {source} WHERE {c} > hi) AS above
FROM (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source}))""" for c in columns)


@query("profile_outliers", _fences("lineitem", [c for c, k in _LINEITEM.items() if k in _NUMBER]))
def _(spark, folder):
    return profile.outlier_profile(table(spark, folder, "lineitem"))


@query("duplicate_rows", REPEATED_SQL + """SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS distinct_rows,
count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicates FROM d""")
def _(spark, folder):
    return profile.duplicate_rows(repeated(spark, folder))


@query("profile_table", f"""WITH e AS ({_evidence('orders', _ORDERS)})
SELECT "column", rows, nulls, "distinct", "distinct" = rows AS is_unique, "distinct" <= 1 AS is_constant FROM e""")
def _(spark, folder):
    return profile.profile_table(table(spark, folder, "orders")).select(
        "column", "rows", "nulls", "distinct", "is_unique", "is_constant")


@query("profile_table_one_column", DIRTY_SQL + f"""SELECT 'reading' AS "column", count(*) AS rows, count(DISTINCT reading) AS "distinct",
{r6('max(reading) FILTER (WHERE isfinite(reading))', 'high')}, count(*) FILTER (WHERE NOT isfinite(reading)) AS non_finite FROM d""")
def _(spark, folder):
    return profile.profile_table(dirty(spark, folder), only="reading").select("column", "rows", "distinct", "high", "non_finite")


@query("profile_flags", DIRTY_SQL + f""", f AS ({_fences('d', ['o_orderkey'])}),
r AS ({_fences('fin', ['reading'])}), fin AS (SELECT reading FROM d WHERE isfinite(reading)),
k AS ({" UNION ALL ".join(_reading(c) for c in DIRTY_TEXT)})
SELECT 'o_orderkey' AS "column", 'unique' AS flag
UNION ALL SELECT "column", 'misread' FROM k WHERE greatest("bigint", "double", "date", "timestamp", "boolean") >= 0.9 * considered AND considered > 0
UNION ALL SELECT 'units', 'hidden_missing' WHERE (SELECT count(*) FROM d WHERE trim(units) = '' OR upper(trim(units)) IN ({_TOKENS})) > 0
UNION ALL SELECT 'reading', 'outliers' WHERE (SELECT below + above FROM r) > 0
UNION ALL SELECT c, 'unique' FROM (SELECT 'amount' AS c, count(DISTINCT amount) AS n, count(*) AS t FROM d
UNION ALL SELECT 'eu_amount', count(DISTINCT eu_amount), count(*) FROM d UNION ALL SELECT 'reading', count(DISTINCT reading), count(*) FROM d
UNION ALL SELECT 'price_text', count(DISTINCT price_text), count(*) FROM d) WHERE n = t""".replace("r AS (", "fin AS (SELECT reading FROM d WHERE isfinite(reading)), r AS (", 1).replace(", fin AS (SELECT reading FROM d WHERE isfinite(reading)),\nk", ",\nk", 1))
def _(spark, folder):
    return profile.profile_flags(dirty(spark, folder))


@query("column_top_values", f"""SELECT source AS value, count(*) AS rows, {r6('count(*) * 1.0 / (SELECT count(*) FROM documents)', 'share')},
greatest((SELECT count(DISTINCT source) FROM documents) - 10, 0) AS not_shown FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 10""")
def _(spark, folder):
    return one.top_values(table(spark, folder, "documents"), "source")


@query("column_histogram", f"""WITH e AS (SELECT equi_width_bins(min(o_totalprice), max(o_totalprice), 10, true) AS b, min(o_totalprice) AS lo FROM orders),
h AS (SELECT unnest(b) AS hi, generate_subscripts(b, 1) AS i, lo FROM e),
s AS (SELECT coalesce(lag(hi) OVER (ORDER BY i), lo) AS lo, hi, i FROM h)
SELECT {r6('lo', 'lo')}, {r6('hi', 'hi')}, (SELECT count(*) FROM orders WHERE (o_totalprice > lo OR (i = 1 AND o_totalprice >= lo)) AND o_totalprice <= hi) AS rows FROM s""")
def _(spark, folder):
    return one.histogram(table(spark, folder, "orders"), "o_totalprice")


@query("column_histogram_text_length", f"""WITH e AS (SELECT equi_width_bins(CAST(min(n_chars) AS DOUBLE), CAST(max(n_chars) AS DOUBLE), 20, true) AS b, min(n_chars) AS lo FROM documents),
h AS (SELECT unnest(b) AS hi, generate_subscripts(b, 1) AS i, lo FROM e),
s AS (SELECT coalesce(lag(hi) OVER (ORDER BY i), lo) AS lo, hi, i FROM h)
SELECT {r6('lo', 'lo')}, {r6('hi', 'hi')}, (SELECT count(*) FROM documents WHERE (n_chars > lo OR (i = 1 AND n_chars >= lo)) AND n_chars <= hi) AS rows FROM s""")
def _(spark, folder):
    return one.histogram(table(spark, folder, "documents"), "n_chars", bins=20)


@query("column_lengths", f"""SELECT min(length(text)) AS shortest, max(length(text)) AS longest, {r6('avg(length(text))', 'mean')},
min(length(text)) = max(length(text)) AS is_fixed_width FROM documents""")
def _(spark, folder):
    return one.lengths(table(spark, folder, "documents"), "text")


@query("date_coverage", """WITH o AS (SELECT ts AS d FROM events), p AS (SELECT DISTINCT CAST(d AS DATE) AS day FROM o WHERE d IS NOT NULL),
b AS (SELECT min(day) AS lo, max(day) AS hi FROM p), a AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b),
m AS (SELECT day FROM a WHERE day NOT IN (SELECT day FROM p)), r AS (SELECT day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS anchor FROM m)
SELECT CAST(lo AS VARCHAR) AS first, CAST(hi AS VARCHAR) AS last, (SELECT count(*) FROM a) AS days_in_span, (SELECT count(*) FROM p) AS days_present,
(SELECT count(*) FROM m) AS days_missing, coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM r GROUP BY anchor)), 0) AS longest_gap FROM b""")
def _(spark, folder):
    return one.date_coverage(table(spark, folder, "events"), "ts")


_ROLE = """CASE WHEN rows > 0 AND non_null = 0 THEN 'ignore' WHEN kind = 'timestamp' THEN 'date'
WHEN rows > 1 AND "distinct" = rows AND kind = 'string' THEN 'identifier'
WHEN regexp_matches("column", '(^|_)(id|ids|key|code|codes|uuid|guid|no|num|number|sku|ref)($|_)') THEN 'identifier'
WHEN rows > 1 AND "distinct" <= 1 THEN 'ignore' WHEN kind IN ('bigint', 'int') AND rows > 1 AND "distinct" <= 12 THEN 'dimension'
WHEN kind IN ('bigint', 'int', 'double') THEN 'measure' WHEN rows > 1 AND "distinct" * 1.0 / rows >= 0.5 THEN 'free_text' ELSE 'dimension' END"""


@query("column_roles", "WITH e AS (" + " UNION ALL ".join(
    f"SELECT e.*, '{k}' AS kind FROM ({_evidence(t, {c: k})}) e"
    for t, cs in (("lineitem", _LINEITEM), ("documents", _DOCS)) for c, k in cs.items()) + f""")
SELECT "column", {_ROLE} AS role FROM e""")
def _(spark, folder):
    found = [ev.with_roles(ev.column_evidence(table(spark, folder, t))).select("column", "role") for t in ("lineitem", "documents")]
    return found[0].unionByName(found[1])
