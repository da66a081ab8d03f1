"""The 27 analyses over the given tables."""

from __future__ import annotations

from grainwise.contract import DatasetContract, Measure
from grainwise.operators import compare, describe, infer, people, relate, time, unusual
from grainwise.plans.base import (
    DIRTY_SQL, DOCS_SQL, EVENTS_SQL, LINES_SQL, ORDERS_SQL, SALES_SQL, dirty, documents, events, lines, orders, query, r6, sales)
from grainwise.plans.tail_sql import chi2_upper, f_upper, t_power, t_quantile, t_two_sided
from grainwise.registry import run
from grainwise.scope import scope_for


def _stat_row(name: str, agg: str, total: str, column: str, filled: bool = True) -> str:
    c = f"CAST({column} AS DOUBLE)"
    return (f"SELECT '{name}' AS measure, '{agg}' AS agg, count({column}) AS n, "
            f"count(*) - count({column}) AS nulls, {r6(total, 'total')}, {r6(f'min({c})', 'min')}, "
            f"{r6(f'max({c})', 'max')}, {r6(f'avg({c})', 'mean')}, {r6(f'median({c})', 'median')}, "
            f"{r6(f'stddev_samp({c})', 'stddev')} FROM s")


# --- tier 1 -----------------------------------------------------------------------------------

@query("summary_stats", SALES_SQL + " UNION ALL ".join([
    _stat_row("price", "sum", "sum(price)", "price"),
    _stat_row("price_avg", "mean", "avg(CAST(price AS DOUBLE))", "price"),
    _stat_row("price_mid", "median", "median(CAST(price AS DOUBLE))", "price"),
    _stat_row("price_low", "min", "min(price)", "price"),
    _stat_row("price_high", "max", "max(price)", "price"),
    _stat_row("priced", "count", "count(price)", "price"),
    _stat_row("buyers", "count_distinct", "count(DISTINCT o_custkey)", "o_custkey"),
    _stat_row("large", "mean", "avg(CAST(is_large AS INTEGER))", "CAST(is_large AS INTEGER)"),
    _stat_row("gross", "none", "NULL", "gross"),
]))
def _(spark, folder):
    return run(sales(spark, folder), "summary_stats")


@query("frequency", SALES_SQL + f"""SELECT status AS value, count(*) AS rows,
{r6('count(*) * 1.0 / (SELECT count(*) FROM s)', 'share')} FROM s GROUP BY status""")
def _(spark, folder):
    return run(sales(spark, folder), "frequency", column="status")


_TOP = """SELECT {d} AS member, sum(price) AS total, count(*) AS rows FROM s GROUP BY {d}"""


@query("top_n", SALES_SQL + f""", g AS ({_TOP.format(d='o_custkey')}),
k AS (SELECT *, row_number() OVER (ORDER BY total DESC NULLS LAST, member ASC NULLS LAST) AS rank FROM g)
SELECT member, {r6('total', 'total')}, rows, {r6('total / (SELECT sum(total) FROM g)', 'share')}, rank
FROM k WHERE rank <= 10""")
def _(spark, folder):
    return run(sales(spark, folder), "top_n", dimension="o_custkey", measure="price")


@query("top_n_period", ORDERS_SQL + f""", p AS (SELECT * FROM s WHERE date_trunc('quarter', o_orderdate) = DATE '1998-04-01'),
g AS (SELECT o_orderpriority AS member, sum(gross) AS total, count(*) AS rows FROM p GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY total DESC NULLS LAST, member ASC NULLS LAST) AS rank FROM g)
SELECT member, {r6('total', 'total')}, rows, {r6('total / (SELECT sum(total) FROM g)', 'share')}, rank
FROM k WHERE rank <= 3""")
def _(spark, folder):
    return run(orders(spark, folder), "top_n", dimension="o_orderpriority", measure="gross", n=3,
               period="1998-Q2", grain="quarter")


@query("top_n_ties", EVENTS_SQL + """, g AS (SELECT user_id AS member, count(value) AS v FROM s GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY v DESC, member) AS rn FROM g),
b AS (SELECT v FROM k WHERE rn = 10)
SELECT count(*) AS tied, CAST(max(v) AS DOUBLE) AS at_value, count(*) FILTER (WHERE rn > 10) AS left_out
FROM k WHERE v = (SELECT v FROM b)""")
def _(spark, folder):
    from dataclasses import replace
    from grainwise.contract import Measure
    from grainwise.scope import scope_for
    scope = events(spark, folder)
    counted = replace(scope.contract, measures=(Measure("seen", "count", column="value"),))
    return describe.top_n_ties(scope_for(scope.source, counted), "user_id", "seen", n=10)


@query("distribution", SALES_SQL + f""", v AS (SELECT CAST(price AS DOUBLE) AS x FROM s WHERE price IS NOT NULL),
b AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n FROM v),
e AS (SELECT i, CASE WHEN i = 0 THEN lo ELSE lo + (hi - lo) * i / 10 END AS lo,
             CASE WHEN i = 9 THEN hi ELSE lo + (hi - lo) * (i + 1) / 10 END AS hi, n FROM b, range(10) t(i)),
c AS (SELECT e.i + 1 AS bin, e.lo, e.hi, e.n, count(v.x) AS rows FROM e LEFT JOIN v
      ON v.x >= e.lo AND (v.x < e.hi OR (e.i = 9 AND v.x <= e.hi)) GROUP BY ALL)
SELECT bin, {r6('lo', 'lo')}, {r6('hi', 'hi')}, rows, {r6('rows * 1.0 / n', 'share')},
{r6('sum(rows) OVER (ORDER BY bin) * 1.0 / n', 'cumulative')} FROM c""")
def _(spark, folder):
    return run(sales(spark, folder), "distribution", measure="price")


@query("distribution_int", DOCS_SQL + f""", b AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi, count(*) AS n FROM s),
w AS (SELECT *, (hi - lo + 7) // 7 AS width FROM b),
e AS (SELECT i, lo + i * width AS lo, least(lo + (i + 1) * width, hi) AS hi, n,
             i = (hi - lo + width) // width - 1 AS last
      FROM w, range(7) t(i) WHERE i < (hi - lo + width) // width),
c AS (SELECT e.i + 1 AS bin, e.lo, e.hi, e.n, count(s.n_chars) AS rows FROM e LEFT JOIN s
      ON s.n_chars >= e.lo AND (s.n_chars < e.hi OR (e.last AND s.n_chars <= e.hi)) GROUP BY ALL)
SELECT bin, {r6('lo', 'lo')}, {r6('hi', 'hi')}, rows, {r6('rows * 1.0 / n', 'share')},
{r6('sum(rows) OVER (ORDER BY bin) * 1.0 / n', 'cumulative')} FROM c""")
def _(spark, folder):
    return run(documents(spark, folder), "distribution", measure="n_chars", bins=7)


@query("distribution_quantiles", SALES_SQL + f""", q AS (SELECT unnest([0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]) AS prob,
unnest(quantile_cont(CAST(price AS DOUBLE), [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])) AS value FROM s)
SELECT {r6('prob', 'prob')}, {r6('value', 'value')} FROM q""")
def _(spark, folder):
    return describe.distribution_quantiles(sales(spark, folder), "price")


def _cross(value: str) -> str:
    return f"""SELECT status AS row_member, priority AS column_member, {value}, count(*) AS rows,
grouping(priority) = 1 AS is_row_total, grouping(status) = 1 AS is_column_total
FROM s GROUP BY GROUPING SETS ((status, priority), (status), (priority), ())"""


@query("cross_tab_count", SALES_SQL + _cross("count(*) AS value"))
def _(spark, folder):
    return run(sales(spark, folder), "cross_tab", rows="status", columns="priority")


@query("cross_tab_wide", SALES_SQL + "SELECT priority AS row_member, " + ", ".join(
    f"nullif(count(*) FILTER (WHERE status IS NOT DISTINCT FROM {v}), 0) AS \"{n}\"" for v, n in (("'F'", "F"), ("'O'", "O"), ("NULL", "(none)"))) + " FROM s GROUP BY 1")
def _(spark, folder):
    return describe.cross_tab_wide(sales(spark, folder), "priority", "status")


@query("cross_tab_measure", SALES_SQL + _cross(r6("avg(CAST(price AS DOUBLE))", "value")))
def _(spark, folder):
    return run(sales(spark, folder), "cross_tab", rows="status", columns="priority", measure="price_avg")


@query("cross_tab_distinct", SALES_SQL + _cross("count(DISTINCT o_custkey) AS value"))
def _(spark, folder):
    return run(sales(spark, folder), "cross_tab", rows="status", columns="priority", measure="buyers")


# --- tier 2 -----------------------------------------------------------------------------------

_P = "CAST(price AS DOUBLE)"


@query("group_compare", SALES_SQL + f""", g AS (SELECT status AS member, grouping(status) = 1 AS is_all, count(price) AS n,
count(*) - count(price) AS nulls, sum(price) AS total, min({_P}) AS min, max({_P}) AS max, avg({_P}) AS mean,
median({_P}) AS median, stddev_samp({_P}) AS stddev, count(*) AS rows
FROM s GROUP BY GROUPING SETS ((status), ()))
SELECT member, is_all, n, nulls, {r6('total', 'total')}, {r6('min', 'min')}, {r6('max', 'max')}, {r6('mean', 'mean')},
{r6('median', 'median')}, {r6('stddev', 'stddev')},
{r6('total / (SELECT sum(total) FROM g WHERE NOT is_all)', 'share')}, rows FROM g""")
def _(spark, folder):
    return run(sales(spark, folder), "group_compare", dimension="status", measure="price")


_FINITE = "FILTER (WHERE isfinite(reading))"


@query("group_compare_median_non_finite", DIRTY_SQL + f"""SELECT status AS member, grouping(status) = 1 AS is_all, count(reading) AS n,
count(*) - count(reading) AS nulls, {r6(f'median(reading) {_FINITE}', 'total')}, {r6(f'min(reading) {_FINITE}', 'min')},
{r6(f'max(reading) {_FINITE}', 'max')}, {r6(f'avg(reading) {_FINITE}', 'mean')}, {r6(f'median(reading) {_FINITE}', 'median')},
{r6(f'stddev_samp(reading) {_FINITE}', 'stddev')}, {r6('NULL', 'share')}, count(*) AS rows
FROM d GROUP BY GROUPING SETS ((status), ())""")
def _(spark, folder):
    contract = DatasetContract(dataset="readings", grain="one order", key=("o_orderkey",), measures=(Measure("reading", "median"),),
                               dimensions=("status",))
    return run(scope_for(dirty(spark, folder), contract), "group_compare", dimension="status", measure="reading")


_PARETO = """, g AS (SELECT o_custkey AS member, sum(price) AS total, count(*) AS rows FROM s GROUP BY 1),
k AS (SELECT *, row_number() OVER w AS rank, sum(coalesce(total, 0)) OVER w AS upto, (SELECT sum(total) FROM g) AS whole FROM g
WINDOW w AS (ORDER BY total DESC NULLS LAST, member ASC NULLS LAST))
"""


@query("pareto", SALES_SQL + _PARETO + f"""SELECT rank, member, {r6('total', 'total')}, {r6('total / whole', 'share')},
{r6('upto / whole', 'running_share')}, CAST(upto - coalesce(total, 0) AS DOUBLE) / CAST(whole AS DOUBLE) < 0.8 AS reached, rows FROM k""")
def _(spark, folder):
    return run(sales(spark, folder), "pareto", dimension="o_custkey", measure="price")


@query("concentration", SALES_SQL + _PARETO + f""", n AS (SELECT count(*) AS n FROM k),
h AS (SELECT sum(power(CAST(coalesce(total, 0) AS DOUBLE) / CAST(whole AS DOUBLE), 2)) * 10000 AS hhi FROM k),
c AS (SELECT 'top ' || c AS cut, CAST(c AS BIGINT) AS groups FROM (SELECT unnest([1, 3, 5, 10, 20]) AS c), n WHERE c < n
UNION ALL SELECT 'top ' || p || '%', greatest(1, n * p // 100) FROM (SELECT unnest([1, 5, 10]) AS p), n WHERE n >= 100
UNION ALL SELECT 'all', n FROM n)
SELECT cut, groups, {r6('(SELECT max(upto) / max(whole) FROM k WHERE rank <= groups)', 'share')}, {r6('hhi', 'hhi')},
{r6('10000 / hhi', 'effective_groups')} FROM c, h""")
def _(spark, folder):
    return run(sales(spark, folder), "concentration", dimension="o_custkey", measure="price")


def _shift_sql(member: str) -> str:
    def side(name: str, start: str, stop: str) -> str:
        return f"""{name} AS (SELECT {member} AS member, sum(price) AS t, row_number() OVER (ORDER BY sum(price) DESC NULLS LAST, {member}) AS rk
FROM s WHERE odate >= DATE '{start}' AND odate < DATE '{stop}' GROUP BY 1)"""
    return SALES_SQL + f""", {side('f', '1996-01-01', '1998-01-01')}, {side('a', '1997-06-01', '2000-07-01')}
SELECT coalesce(f.member, a.member) AS member, {r6('f.t', 'total_before')}, f.rk AS rank_before, {r6('a.t', 'total_after')},
a.rk AS rank_after, f.rk - a.rk AS change,
CASE WHEN f.member IS NULL THEN 'new' WHEN a.member IS NULL THEN 'gone' ELSE 'moved' END AS state
FROM f FULL JOIN a ON f.member IS NOT DISTINCT FROM a.member"""


def _shift(spark, folder, dimension):
    return run(sales(spark, folder), "ranking_shift", dimension=dimension, measure="price",
               before_start="1996-01-01", before_end="1997-12-31", after_start="1997-06-01", after_end="2000-06-30")


@query("ranking_shift", _shift_sql("priority"))
def _(spark, folder):
    return _shift(spark, folder, "priority")


@query("ranking_shift_many", _shift_sql("o_custkey"))
def _(spark, folder):
    return _shift(spark, folder, "o_custkey")


# --- tier 3 -----------------------------------------------------------------------------------

def _spine(grain: str, step: str, lo: str = "DATE '1996-01-01'", hi: str = "DATE '2000-06-30'", source: str = "s",
           column: str = "odate", values: str = "") -> str:
    return f""", spine AS (SELECT CAST(unnest(generate_series(date_trunc('{grain}', {lo}), date_trunc('{grain}', {hi}), INTERVAL {step})) AS DATE) AS period),
d AS (SELECT CAST(date_trunc('{grain}', {column}) AS DATE) AS period, count(*) AS rows{values} FROM {source}
      WHERE {column} IS NOT NULL GROUP BY 1),
t AS (SELECT spine.period, coalesce(d.rows, 0) AS rows, d.* EXCLUDE (period, rows) FROM spine LEFT JOIN d USING (period))
"""


_RUN = """, i AS (SELECT *, rows = 0 AS absent, row_number() OVER (ORDER BY period)
- row_number() OVER (PARTITION BY rows = 0 ORDER BY period) AS island FROM t)
"""


@query("calendar_coverage_month", SALES_SQL + _spine("month", "1 MONTH") + _RUN + """
SELECT strftime(period, '%Y-%m') AS period, rows, absent AS is_absent,
count(*) OVER (PARTITION BY absent, island) AS run_length FROM i""")
def _(spark, folder):
    return run(sales(spark, folder), "calendar_coverage")


@query("calendar_coverage_day", SALES_SQL + _spine("day", "1 DAY") + _RUN + """
SELECT strftime(period, '%Y-%m-%d') AS period, rows, absent AS is_absent,
count(*) OVER (PARTITION BY absent, island) AS run_length FROM i""")
def _(spark, folder):
    return run(sales(spark, folder), "calendar_coverage", grain="day")


@query("longest_gap", SALES_SQL + _spine("day", "1 DAY") + _RUN + """, c AS (SELECT absent, count(*) AS n FROM i GROUP BY absent, island)
SELECT (SELECT count(*) FROM i) AS periods, (SELECT count(*) FROM i WHERE absent) AS absent,
coalesce(max(n) FILTER (WHERE absent), 0) AS longest_gap FROM c""")
def _(spark, folder):
    return time.longest_gap(sales(spark, folder), "day")


@query("calendar_edges", SALES_SQL + """SELECT '1996-01-01' AS lo, '2000-06-30' AS hi, strftime(min(odate), '%Y-%m-%d') AS seen_lo,
strftime(max(odate), '%Y-%m-%d') AS seen_hi, count(*) FILTER (WHERE odate IS NULL) AS undated,
CAST(min(odate) AS DATE) > DATE '1996-01-01' AS starts_late, CAST(max(odate) AS DATE) < DATE '2000-06-30' AS ends_early,
false AS opens_mid_period FROM s""")
def _(spark, folder):
    return time.calendar_edges(sales(spark, folder), "week")


@query("trend", SALES_SQL + _spine("month", "1 MONTH", values=", sum(price) AS v") + f"""
SELECT strftime(period, '%Y-%m') AS period, {r6('v', 'value')}, rows FROM t""")
def _(spark, folder):
    return run(sales(spark, folder), "trend", measure="price")


@query("trend_median", SALES_SQL + _spine("quarter", "3 MONTH", values=", median(CAST(price AS DOUBLE)) AS v") + f"""
SELECT strftime(period, '%Y-Q') || quarter(period) AS period, {r6('v', 'value')}, rows FROM t""")
def _(spark, folder):
    return run(sales(spark, folder), "trend", measure="price_mid", grain="quarter")


@query("trend_split", SALES_SQL + f""", spine AS (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '2000-06-01', INTERVAL 1 MONTH)) AS DATE) AS period),
m AS (SELECT DISTINCT status AS member FROM s),
d AS (SELECT CAST(date_trunc('month', odate) AS DATE) AS period, status AS member, sum(price) AS v, count(*) AS rows FROM s GROUP BY 1, 2),
w AS (SELECT CAST(date_trunc('month', odate) AS DATE) AS period, sum(price) AS v, count(*) AS rows FROM s GROUP BY 1)
SELECT strftime(spine.period, '%Y-%m') AS period, m.member, false AS is_all, {r6('d.v', 'value')}, coalesce(d.rows, 0) AS rows
FROM spine CROSS JOIN m LEFT JOIN d ON d.period = spine.period AND d.member IS NOT DISTINCT FROM m.member
UNION ALL SELECT strftime(spine.period, '%Y-%m'), NULL, true, {r6('w.v', 'value')}, coalesce(w.rows, 0) FROM spine LEFT JOIN w USING (period)""")
def _(spark, folder):
    return run(sales(spark, folder), "trend", measure="price", dimension="status")


def _season(position: str) -> str:
    return f""", q AS (SELECT {position} AS position, v, rows FROM t)
SELECT position, {r6('avg(v)', 'mean')}, {r6('avg(v) / (SELECT avg(v) FROM q)', 'index')}, count(v) AS observed,
count(*) - count(v) AS absent, CAST(sum(rows) AS BIGINT) AS rows FROM q GROUP BY position"""


@query("seasonality_month", SALES_SQL + _spine("month", "1 MONTH", values=", CAST(sum(price) AS DOUBLE) AS v")
       + _season("month(period)"))
def _(spark, folder):
    return run(sales(spark, folder), "seasonality", measure="price")


@query("seasonality_weekday", SALES_SQL + _spine("day", "1 DAY", values=", CAST(sum(price) AS DOUBLE) AS v")
       + _season("isodow(period)"))
def _(spark, folder):
    return run(sales(spark, folder), "seasonality", measure="price", grain="day")


@query("seasonality_week", SALES_SQL + _spine("week", "7 DAY", values=", CAST(sum(price) AS DOUBLE) AS v")
       + _season("week(period)"))
def _(spark, folder):
    return run(sales(spark, folder), "seasonality", measure="price", grain="week")


@query("period_compare", SALES_SQL + _spine("year", "1 YEAR", values=", sum(price) AS v") + f""", b AS (SELECT v FROM t WHERE period = DATE '1997-01-01')
SELECT strftime(period, '%Y') AS period, {r6('v', 'value')}, rows, date_diff('day', period, CAST(period + INTERVAL 1 YEAR AS DATE)) AS days,
{r6("CASE WHEN period = DATE '1998-01-01' THEN v - (SELECT v FROM b) END", 'delta')},
{r6("CASE WHEN period = DATE '1998-01-01' AND (SELECT v FROM b) > 0 THEN (v - (SELECT v FROM b)) / (SELECT v FROM b) END", 'pct')}
FROM t WHERE period IN (DATE '1997-01-01', DATE '1998-01-01')""")
def _(spark, folder):
    return run(sales(spark, folder), "period_compare", measure="price", period="1998", baseline="1997", grain="year")


_CHANGE = SALES_SQL + """, g AS (SELECT o_custkey AS member,
sum(price) FILTER (WHERE odate < DATE '1998-02-01') AS base, sum(price) FILTER (WHERE odate >= DATE '1999-02-01') AS current,
count(*) FILTER (WHERE odate < DATE '1998-02-01') AS nb, count(*) FILTER (WHERE odate >= DATE '1999-02-01') AS nc
FROM s WHERE (odate >= DATE '1998-01-01' AND odate < DATE '1998-02-01') OR (odate >= DATE '1999-02-01' AND odate < DATE '1999-03-01') GROUP BY 1),
c AS (SELECT *, coalesce(current, 0) - coalesce(base, 0) AS change,
CASE WHEN nb = 0 THEN 'entered' WHEN nc = 0 THEN 'left' ELSE 'stayed' END AS state FROM g)
"""


@query("growth_decomposition", _CHANGE + f"""SELECT member, {r6('base', 'base')}, {r6('current', 'current')}, {r6('change', 'change')},
{r6('CAST(change AS DOUBLE) / (SELECT CAST(sum(change) AS DOUBLE) FROM c)', 'share_of_change')}, state FROM c""")
def _(spark, folder):
    return run(sales(spark, folder), "growth_decomposition", measure="price", dimension="o_custkey", period="1999-02",
               baseline="1998-01")


@query("growth_summary", _CHANGE + f"""SELECT {r6('sum(change)', 'net')}, {r6('sum(abs(change))', 'gross')},
count(*) FILTER (WHERE change > 0) AS rose, count(*) FILTER (WHERE change < 0) AS fell,
count(*) FILTER (WHERE state = 'entered') AS entered, count(*) FILTER (WHERE state = 'left') AS left_out FROM c""")
def _(spark, folder):
    parts = run(sales(spark, folder), "growth_decomposition", measure="price", dimension="o_custkey", period="1999-02",
                baseline="1998-01")
    return time.growth_summary(parts)


@query("empty_months", """WITH src AS (SELECT CAST(ts AS DATE) - CAST(62 * (user_id % 3) AS INTEGER) AS d FROM events),
b AS (SELECT min(d) AS lo, max(d) AS hi FROM src),
m AS (SELECT CAST(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS DATE) AS period FROM b)
SELECT strftime(period, '%Y-%m') AS month FROM m WHERE period NOT IN (SELECT CAST(date_trunc('month', d) AS DATE) FROM src)""")
def _(spark, folder):
    from dataclasses import replace
    from grainwise.plans.base import EVENTS_CONTRACT, table
    from grainwise.scope import scope_for
    from pyspark.sql import functions as F
    spread = table(spark, folder, "events").select(
        "user_id", F.expr("date_sub(CAST(ts AS DATE), CAST(62 * (user_id % 3) AS INT)) AS d"))
    scope = scope_for(spread, replace(EVENTS_CONTRACT, date_column="d", measures=(), key=()))
    return time.empty_months(scope)


# --- tier 4 -----------------------------------------------------------------------------------

@query("correlation", LINES_SQL + f"""SELECT count(*) AS pairs, CAST(0 AS BIGINT) AS dropped,
{r6('corr(CAST(price AS DOUBLE), CAST(qty AS DOUBLE))', 'pearson')},
(WITH k AS (SELECT rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 AS rx,
rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2.0 AS ry FROM s)
SELECT round(corr(rx, ry), 6) + 0.0 FROM k) AS spearman FROM s""")
def _(spark, folder):
    return run(lines(spark, folder), "correlation", measure="price", against="qty")


@query("spearman", SALES_SQL + f""", w AS (SELECT CAST(price AS DOUBLE) AS x, CAST(o_custkey AS DOUBLE) AS y FROM s),
p AS (SELECT * FROM w WHERE x IS NOT NULL AND y IS NOT NULL),
k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p)
SELECT count(*) AS pairs, (SELECT count(*) FROM w) - count(*) AS dropped, {r6('corr(x, y)', 'pearson')},
{r6('corr(rx, ry)', 'spearman')}, {r6('abs(corr(x, y) - corr(rx, ry))', 'gap')}, abs(corr(x, y) - corr(rx, ry)) >= 0.1 AS differs FROM k""")
def _(spark, folder):
    return relate.correlation_gap(run(sales(spark, folder), "correlation", measure="price", against="buyers"))


@query("bivariate", LINES_SQL + f""", v AS (SELECT x, ntile(8) OVER (ORDER BY x) AS bin FROM (SELECT DISTINCT CAST(price AS DOUBLE) AS x FROM s)),
p AS (SELECT v.bin, v.x, CAST(s.qty AS DOUBLE) AS y FROM s JOIN v ON CAST(s.price AS DOUBLE) = v.x)
SELECT bin, {r6('min(x)', 'lo')}, {r6('max(x)', 'hi')}, count(*) AS rows, {r6('avg(y)', 'mean')}, {r6('median(y)', 'median')} FROM p GROUP BY bin""")
def _(spark, folder):
    return run(lines(spark, folder), "bivariate", measure="price", against="qty", bins=8)


@query("bivariate_turns", LINES_SQL + """, v AS (SELECT x, ntile(8) OVER (ORDER BY x) AS bin FROM (SELECT DISTINCT CAST(price AS DOUBLE) AS x FROM s)),
p AS (SELECT v.bin, avg(CAST(s.discount AS DOUBLE)) AS m FROM s JOIN v ON CAST(s.price AS DOUBLE) = v.x GROUP BY 1),
d AS (SELECT bin, sign(m - lag(m) OVER (ORDER BY bin)) AS step FROM p),
f AS (SELECT step <> lag(step) OVER (ORDER BY bin) AS flip FROM d WHERE step <> 0)
SELECT count(*) FILTER (WHERE flip) AS turns FROM f""")
def _(spark, folder):
    return relate.turns(run(lines(spark, folder), "bivariate", measure="price", against="discount", bins=8))


def _driver(d: str) -> str:
    return f"""SELECT '{d}' AS dimension, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, sum(n * power(m - (SELECT m FROM g), 2)) AS ssb,
count(*) FILTER (WHERE n = 1) AS one_row_groups FROM (SELECT {d}, count(*) AS n, avg(y) AS m FROM p GROUP BY {d})"""


@query("driver_analysis", SALES_SQL + f""", p AS (SELECT *, CAST(price AS DOUBLE) AS y FROM s WHERE price IS NOT NULL),
g AS (SELECT avg(y) AS m, var_pop(y) * count(*) AS sst, count(*) AS n FROM p),
d AS ({' UNION ALL '.join(map(_driver, ('status', 'priority', 'o_custkey', 'full_status')))})
SELECT dimension, groups, rows, {r6('ssb / sst', 'share')}, {r6('(groups - 1) * 1.0 / (n - 1)', 'chance')},
{r6('ssb / sst - (groups - 1) * 1.0 / (n - 1)', 'excess')}, one_row_groups FROM d, g""")
def _(spark, folder):
    return run(sales(spark, folder), "driver_analysis", measure="price")


@query("mix_shift", SALES_SQL + f""", p AS (SELECT status AS member, CAST(price AS DOUBLE) AS v, odate < DATE '1999-01-01' AS b FROM s
WHERE price IS NOT NULL AND ((odate >= DATE '1998-01-01' AND odate < DATE '1999-01-01') OR (odate >= DATE '1999-01-01' AND odate < DATE '2000-01-01'))),
g AS (SELECT member, avg(v) FILTER (WHERE b) AS m0, avg(v) FILTER (WHERE NOT b) AS m1,
count(*) FILTER (WHERE b) * 1.0 / (SELECT count(*) FROM p WHERE b) AS w0, count(*) FILTER (WHERE NOT b) * 1.0 / (SELECT count(*) FROM p WHERE NOT b) AS w1
FROM p GROUP BY member)
SELECT member, {r6('m0', 'mean0')}, {r6('m1', 'mean1')}, {r6('w0', 'share0')}, {r6('w1', 'share1')}, {r6('w0 * (m1 - m0)', 'rate')},
{r6('CASE WHEN m1 IS NOT NULL THEN m0 * (w1 - w0) END', 'mix')}, {r6('(w1 - w0) * (m1 - m0)', 'interaction')},
{r6('coalesce(w1 * m1, 0) - coalesce(w0 * m0, 0)', 'contribution')} FROM g""")
def _(spark, folder):
    return run(sales(spark, folder), "mix_shift", measure="price_avg", dimension="status", period="1999", baseline="1998", grain="year")


# --- tier 5 -----------------------------------------------------------------------------------

def _splits(value: str, name: str) -> str:
    """Every admissible split of series `t`, by re-reading both sides of each split."""
    return f"""SELECT a.period, a.slot, '{name}' AS series,
(SELECT count(*) FROM z WHERE z.slot <= a.slot AND z.rows > 0) AS nb, (SELECT count(*) FROM z WHERE z.slot > a.slot AND z.rows > 0) AS na,
(SELECT avg({value}) FROM z WHERE z.slot <= a.slot AND z.rows > 0) AS mb, (SELECT avg({value}) FROM z WHERE z.slot > a.slot AND z.rows > 0) AS ma,
(SELECT var_pop({value}) * count({value}) FROM z WHERE z.slot <= a.slot AND z.rows > 0) + (SELECT var_pop({value}) * count({value}) FROM z WHERE z.slot > a.slot AND z.rows > 0) AS ss
FROM z a JOIN z b ON b.slot = a.slot + 1 WHERE a.rows > 0 AND b.rows > 0"""


@query("changepoint", SALES_SQL + _spine("month", "1 MONTH", values=", CAST(sum(price) AS DOUBLE) AS v") + f""", z AS (SELECT *, row_number() OVER (ORDER BY period) AS slot FROM t),
k AS ({_splits('v', 'price')})
SELECT strftime(period, '%Y-%m') AS split_after, nb AS n_before, na AS n_after, {r6('mb', 'mean_before')}, {r6('ma', 'mean_after')},
{r6('ma - mb', 'difference')}, {r6('abs(ma - mb) / sqrt(ss / (nb + na - 2))', 'spread_ratio')}, abs(ma - mb) / sqrt(ss / (nb + na - 2)) >= 2 AS is_clear
FROM k WHERE nb >= 3 AND na >= 3""")
def _(spark, folder):
    return run(sales(spark, folder), "changepoint", measure="price")


@query("correlated_shift", SALES_SQL + """, paired AS (SELECT * FROM s WHERE price IS NOT NULL AND o_custkey IS NOT NULL)"""
       + _spine("month", "1 MONTH", source="paired", values=", CAST(sum(price) AS DOUBLE) AS v, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS u")
       + f""", z AS (SELECT *, row_number() OVER (ORDER BY period) AS slot FROM t),
k AS (SELECT * FROM ({_splits('v', 'price')} UNION ALL {_splits('u', 'buyers')}) WHERE nb >= 3 AND na >= 3),
o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY abs(ma - mb) DESC, slot) AS rk, count(*) OVER (PARTITION BY series) AS admissible FROM k),
f AS (SELECT * FROM o WHERE rk = 1)
SELECT series, strftime(period, '%Y-%m') AS split_after, {r6('ma - mb', 'difference')}, {r6('abs(ma - mb) / sqrt(ss / (nb + na - 2))', 'separation')},
admissible, {r6('least(1.0, 3.0 / admissible)', 'chance')}, (SELECT max(slot) - min(slot) FROM f) <= 1 AS coincide FROM f""")
def _(spark, folder):
    return run(sales(spark, folder), "correlated_shift", measure="price", against="buyers")


_FENCE = """, v AS (SELECT CAST(value AS DOUBLE) AS x FROM s WHERE value IS NOT NULL),
q AS (SELECT quantile_cont(x, 0.25) AS q1, median(x) AS med, quantile_cont(x, 0.75) AS q3, avg(x) AS m, stddev_samp(x) AS sd, count(*) AS n FROM v),
d AS (SELECT median(abs(x - (SELECT med FROM q))) AS mad FROM v),
b AS (SELECT 'tukey' AS method, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, n FROM q
UNION ALL SELECT 'zscore', m - 3 * sd, m + 3 * sd, n FROM q
UNION ALL SELECT 'mad', med - 3 * 1.4826 * mad, med + 3 * 1.4826 * mad, n FROM q, d)
"""


@query("outliers_global", EVENTS_SQL + _FENCE + f"""SELECT method, {r6('lo', 'lower')}, {r6('hi', 'upper')}, count(x) AS flagged, {r6('count(x) * 1.0 / n', 'share')}
FROM b LEFT JOIN v ON x < lo OR x > hi GROUP BY method, lo, hi, n""")
def _(spark, folder):
    return run(events(spark, folder), "outlier_detection", measure="value")


@query("outlier_agreement", EVENTS_SQL + _FENCE + """, c AS (SELECT (SELECT count(*) FROM b WHERE x < lo OR x > hi) AS methods FROM v)
SELECT methods, count(*) AS rows FROM c WHERE methods > 0 GROUP BY methods""")
def _(spark, folder):
    return unusual.outlier_agreement(events(spark, folder), "value")


@query("outliers_within_group", EVENTS_SQL + f""", v AS (SELECT event_type AS g, CAST(value AS DOUBLE) AS x FROM s WHERE value IS NOT NULL),
q AS (SELECT g, quantile_cont(x, 0.25) AS q1, median(x) AS med, quantile_cont(x, 0.75) AS q3, avg(x) AS m, stddev_samp(x) AS sd, count(*) AS n FROM v GROUP BY g),
d AS (SELECT v.g, median(abs(x - med)) AS mad FROM v JOIN q USING (g) GROUP BY v.g)
SELECT v.g AS member, n, {r6('q1 - 1.5 * (q3 - q1)', 'lower')}, {r6('q3 + 1.5 * (q3 - q1)', 'upper')},
count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS tukey, count(*) FILTER (WHERE abs(x - m) > 3 * sd) AS zscore,
count(*) FILTER (WHERE abs(x - med) > 3 * 1.4826 * mad) AS mad FROM v JOIN q USING (g) JOIN d USING (g) GROUP BY ALL""")
def _(spark, folder):
    return run(events(spark, folder), "outlier_detection", measure="value", dimension="event_type")


# --- tier 6 -----------------------------------------------------------------------------------

_NO_SMALLEST = "CAST(NULL AS DOUBLE) AS smallest_expected"


def _moments(d: str, extra: str = "") -> str:
    return f""", m AS (SELECT {d} AS g, count(*) AS n, avg(CAST(price AS DOUBLE)) AS m, var_samp(CAST(price AS DOUBLE)) AS v
FROM s WHERE {d} IS NOT NULL AND price IS NOT NULL {extra} GROUP BY 1)
"""


@query("group_moments", SALES_SQL + f"""SELECT priority AS member, count(*) AS n, {r6('avg(CAST(price AS DOUBLE))', 'mean')},
{r6('var_samp(CAST(price AS DOUBLE)) / 1e9', 'variance')}, {r6('skewness(CAST(price AS DOUBLE))', 'skewness')}, {r6('kurtosis(CAST(price AS DOUBLE))', 'kurtosis')}
FROM s WHERE priority IS NOT NULL AND price IS NOT NULL GROUP BY 1""")
def _(spark, folder):
    from pyspark.sql import functions as F
    moments = infer.group_moments(sales(spark, folder), "priority", "price_avg")
    return moments.withColumn("variance", F.col("variance") / 1e9)


_WELCH = """SELECT a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, a.v / a.n AS s1, b.v / b.n AS s2, a.v AS v1, b.v AS v2 FROM m a JOIN m b ON a.g < b.g"""


@query("welch_t", SALES_SQL + _moments("status") + f""", w AS ({_WELCH})
SELECT 'welch_t' AS test, {r6('(m1 - m2) / sqrt(s1 + s2)', 'statistic')},
{r6('power(s1 + s2, 2) / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1))', 'df1')}, CAST(NULL AS DOUBLE) AS df2,
{r6('(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * (1 - 3.0 / (4 * (n1 + n2 - 2) - 1))', 'effect')},
{r6(t_two_sided('((m1 - m2) / sqrt(s1 + s2))', '(power(s1 + s2, 2) / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1)))'), 'p')}, {_NO_SMALLEST} FROM w""")
def _(spark, folder):
    return run(sales(spark, folder), "hypothesis_test", dimension="status", measure="price_avg")


_ANOVA = """, a AS (SELECT sum(n) AS t, count(*) AS k, sum(n * m) / sum(n) AS gm FROM m),
b AS (SELECT sum(n * power(m.m - gm, 2)) AS ssb, sum((n - 1) * coalesce(v, 0)) AS ssw, max(k) AS k, max(t) AS t FROM m, a)
"""


_ANOVA_TEST = f"""SELECT 'anova' AS test, {r6('(ssb / (k - 1)) / (ssw / (t - k))', 'statistic')},
{r6('k - 1', 'df1')}, {r6('t - k', 'df2')}, {r6('ssb / (ssb + ssw)', 'effect')},
{r6(f_upper('((ssb / (k - 1)) / (ssw / (t - k)))', '(k - 1)', '(t - k)'), 'p')}, {_NO_SMALLEST} FROM b"""


@query("anova", SALES_SQL + _moments("priority") + _ANOVA + _ANOVA_TEST)
def _(spark, folder):
    return run(sales(spark, folder), "hypothesis_test", dimension="priority", measure="price_avg")


@query("anova_many", LINES_SQL + """, m AS (SELECT l_suppkey AS g, count(*) AS n, avg(CAST(discount AS DOUBLE)) AS m, var_samp(CAST(discount AS DOUBLE)) AS v
FROM s WHERE l_suppkey IS NOT NULL AND discount IS NOT NULL GROUP BY 1)
""" + _ANOVA + _ANOVA_TEST)
def _(spark, folder):
    return run(lines(spark, folder), "hypothesis_test", dimension="l_suppkey", measure="discount", method="parametric")


_RANKS = """, p AS (SELECT {d} AS g, CAST(price AS DOUBLE) AS x FROM s WHERE {d} IS NOT NULL AND price IS NOT NULL),
k AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM p),
rs AS (SELECT g, count(*) AS n, sum(r) AS r FROM k GROUP BY g), t AS (SELECT count(*) AS n FROM p),
ties AS (SELECT sum(power(c, 3) - c) AS ties FROM (SELECT count(*) AS c FROM p GROUP BY x))
"""


@query("mann_whitney", SALES_SQL + _RANKS.format(d="status") + f"""SELECT 'mann_whitney' AS test, {r6('r - n * (n + 1) / 2.0', 'statistic')},
CAST(NULL AS DOUBLE) AS df1, CAST(NULL AS DOUBLE) AS df2, CAST(NULL AS DOUBLE) AS effect,
{r6(chi2_upper('z2', '1.0'), 'p')}, {_NO_SMALLEST} FROM (SELECT *, power(greatest(abs(r - n * (n + 1) / 2.0 - n * (t - n) / 2.0) - 0.5, 0), 2)
/ (n * (t - n) / 12.0 * ((t + 1) - ties / (t * (t - 1.0)))) AS z2 FROM rs, (SELECT n AS t FROM t), ties) WHERE g = (SELECT min(g) FROM rs)""")
def _(spark, folder):
    return run(sales(spark, folder), "hypothesis_test", dimension="status", measure="price_avg", method="rank")


_KRUSKAL_TEST = f""", h AS (SELECT (12.0 / (t.n * (t.n + 1.0)) * sum(r * r / rs.n) - 3 * (t.n + 1)) / (1 - max(ties) / (power(t.n, 3) - t.n)) AS h FROM rs, t, ties GROUP BY t.n)
SELECT 'kruskal_wallis' AS test, {r6('h', 'statistic')}, {r6('k - 1', 'df1')}, CAST(NULL AS DOUBLE) AS df2, {r6('ssb / (ssb + ssw)', 'effect')},
{r6(chi2_upper('h', '(k - 1)'), 'p')}, {_NO_SMALLEST} FROM b, h"""


@query("kruskal", SALES_SQL + _RANKS.format(d="priority") + _moments("priority") + _ANOVA + _KRUSKAL_TEST)
def _(spark, folder):
    return run(sales(spark, folder), "hypothesis_test", dimension="priority", measure="price_avg", method="rank")


@query("kruskal_many", SALES_SQL + _RANKS.format(d="o_custkey") + _moments("o_custkey") + _ANOVA + _KRUSKAL_TEST)
def _(spark, folder):
    return run(sales(spark, folder), "hypothesis_test", dimension="o_custkey", measure="price_avg", method="rank")


def _chi(a: str, b: str, yates: bool = False) -> str:
    gap = "abs(o - e) - least(0.5, abs(o - e))" if yates else "o - e"
    return f""", f AS (SELECT {a} AS a, {b} AS b FROM s WHERE {a} IS NOT NULL AND {b} IS NOT NULL), n AS (SELECT count(*) AS n FROM f),
ra AS (SELECT a, count(*) AS c FROM f GROUP BY 1), rb AS (SELECT b, count(*) AS c FROM f GROUP BY 1),
x AS (SELECT ra.a, rb.b, ra.c * 1.0 * rb.c / n AS e, (SELECT count(*) FROM f WHERE f.a = ra.a AND f.b = rb.b) AS o FROM ra, rb, n),
c AS (SELECT sum(power({gap}, 2) / e) AS chi, (SELECT count(*) FROM ra) AS r, (SELECT count(*) FROM rb) AS k, min(e) AS smallest FROM x)
"""


_CHI_TEST = f"""SELECT 'chi_square' AS test, {r6('chi', 'statistic')}, {r6('(r - 1) * (k - 1)', 'df1')}, CAST(NULL AS DOUBLE) AS df2,
{r6('sqrt(chi / (n * (least(r, k) - 1)))', 'effect')}, {r6(chi2_upper('chi', '((r - 1) * (k - 1))'), 'p')}, {r6('smallest', 'smallest_expected')} FROM c, n"""


@query("chi_square", SALES_SQL + _chi("status", "priority") + _CHI_TEST)
def _(spark, folder):
    return run(sales(spark, folder), "hypothesis_test", dimension="status", second_dimension="priority")


# Absent cells add what is expected of them: all of it that the cells that occur leave over.
@query("chi_square_many", SALES_SQL + """, f AS (SELECT o_custkey AS a, priority AS b FROM s WHERE o_custkey IS NOT NULL AND priority IS NOT NULL), n AS (SELECT count(*) AS n FROM f),
ra AS (SELECT a, count(*) AS c FROM f GROUP BY 1), rb AS (SELECT b, count(*) AS c FROM f GROUP BY 1), o AS (SELECT a, b, count(*) AS o FROM f GROUP BY 1, 2),
x AS (SELECT ra.c * 1.0 * rb.c / n AS e, coalesce(o, 0) AS o FROM ra CROSS JOIN rb CROSS JOIN n LEFT JOIN o ON o.a = ra.a AND o.b = rb.b),
c AS (SELECT sum(power(o - e, 2) / e) AS chi, (SELECT count(*) FROM ra) AS r, (SELECT count(*) FROM rb) AS k, min(e) AS smallest FROM x)
""" + _CHI_TEST)
def _(spark, folder):
    return run(sales(spark, folder), "hypothesis_test", dimension="o_custkey", second_dimension="priority")


_LABELS_SQL = "WITH s AS (SELECT * FROM labels)\n"


@query("cramers_v", _LABELS_SQL + _chi("quality", "toxic", yates=True) + f""", e AS (SELECT sqrt(chi / (n * (least(r, k) - 1))) AS v FROM c, n)
SELECT 'cramers_v' AS effect, {r6('v', 'value')}, CASE WHEN v >= 0.5 THEN 'large' WHEN v >= 0.3 THEN 'medium' WHEN v >= 0.1 THEN 'small' ELSE 'negligible' END AS band FROM e""")
def _(spark, folder):
    from grainwise.contract import DatasetContract
    from grainwise.plans.base import table
    from grainwise.scope import scope_for
    contract = DatasetContract(dataset="labels", grain="one document", dimensions=("quality", "toxic"))
    return run(scope_for(table(spark, folder, "labels"), contract), "effect_size", dimension="quality", second_dimension="toxic")


@query("hedges_g", SALES_SQL + _moments("status") + f""", w AS ({_WELCH}),
e AS (SELECT (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * (1 - 3.0 / (4 * (n1 + n2 - 2) - 1)) AS v FROM w)
SELECT 'hedges_g' AS effect, {r6('v', 'value')}, CASE WHEN abs(v) >= 0.8 THEN 'large' WHEN abs(v) >= 0.5 THEN 'medium' WHEN abs(v) >= 0.2 THEN 'small' ELSE 'negligible' END AS band FROM e""")
def _(spark, folder):
    return run(sales(spark, folder), "effect_size", dimension="status", measure="price_avg")


@query("eta_squared", SALES_SQL + _moments("priority") + _ANOVA + f"""SELECT 'eta_squared' AS effect, {r6('ssb / (ssb + ssw)', 'value')},
CASE WHEN ssb / (ssb + ssw) >= 0.14 THEN 'large' WHEN ssb / (ssb + ssw) >= 0.06 THEN 'medium' WHEN ssb / (ssb + ssw) >= 0.01 THEN 'small' ELSE 'negligible' END AS band FROM b""")
def _(spark, folder):
    return run(sales(spark, folder), "effect_size", dimension="priority", measure="price_avg")


def _ci(d: str, source: str, measure: str) -> str:
    """Bounds to three places: they are of the size of the measure, and its digits are."""
    reach = "(reach * sqrt(v / n))"
    return f""", m AS (SELECT CAST({d} AS VARCHAR) AS member, count(*) AS n, avg(CAST({measure} AS DOUBLE)) AS m, var_samp(CAST({measure} AS DOUBLE)) AS v
FROM {source} WHERE {d} IS NOT NULL AND {measure} IS NOT NULL GROUP BY 1),
q AS (SELECT n AS size, {t_quantile(0.975, 1.959963984540054, '(n - 1)')} AS reach FROM (SELECT DISTINCT n FROM m WHERE n >= 2))
SELECT member, n, {r6('m', 'estimate')}, round(m - {reach}, 3) + 0.0 AS lo, round(m + {reach}, 3) + 0.0 AS hi FROM m LEFT JOIN q ON size = n"""


def _to_thousandths(df):
    from pyspark.sql import functions as F
    return df.withColumns({c: F.round(c, 3) for c in ("lo", "hi")})


@query("ci_mean", SALES_SQL + _ci("priority", "s", "price"))
def _(spark, folder):
    return _to_thousandths(run(sales(spark, folder), "confidence_interval", dimension="priority", measure="price_avg"))


@query("ci_mean_many", LINES_SQL + _ci("l_partkey", "s", "discount"))
def _(spark, folder):
    return _to_thousandths(run(lines(spark, folder), "confidence_interval", dimension="l_partkey", measure="discount"))


@query("ci_mean_bounds", SALES_SQL + _ci("'(all)'", "s", "price"))
def _(spark, folder):
    return _to_thousandths(run(sales(spark, folder), "confidence_interval", measure="price_avg"))


_Z = "1.9599639845400545"


@query("ci_share_wilson", SALES_SQL + f""", w AS (SELECT count(*) AS w FROM s),
g AS (SELECT status AS member, count(*) AS n, count(*) * 1.0 / max(w) AS p, CAST(max(w) AS DOUBLE) AS w FROM s, w WHERE status IS NOT NULL GROUP BY 1)
SELECT member, n, {r6('p', 'estimate')},
{r6(f'(p + {_Z} * {_Z} / (2 * w) - {_Z} * sqrt(p * (1 - p) / w + {_Z} * {_Z} / (4 * w * w))) / (1 + {_Z} * {_Z} / w)', 'lo')},
{r6(f'(p + {_Z} * {_Z} / (2 * w) + {_Z} * sqrt(p * (1 - p) / w + {_Z} * {_Z} / (4 * w * w))) / (1 + {_Z} * {_Z} / w)', 'hi')} FROM g""")
def _(spark, folder):
    return run(sales(spark, folder), "confidence_interval", dimension="status")


@query("set_aside", SALES_SQL + """SELECT count(*) FILTER (WHERE status IS NULL) AS no_group,
count(*) FILTER (WHERE status IS NOT NULL AND price IS NULL) AS no_value, CAST(0 AS BIGINT) AS not_finite FROM s""")
def _(spark, folder):
    return infer.set_aside(sales(spark, folder), "status", "price_avg")


@query("sample_adequacy", SALES_SQL + _moments("status") + f""", w AS ({_WELCH})
SELECT n1, n2, {r6('sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))', 'pooled_sd')}, {r6('abs(m1 - m2)', 'observed_difference')} FROM w""")
def _(spark, folder):
    return run(sales(spark, folder), "sample_adequacy", dimension="status", measure="price_avg").select(
        "n1", "n2", "pooled_sd", "observed_difference")


# The size of effect, and the rows, at which the power is 0.8, each halved in on from both sides.
_PLAN = f""", w AS (SELECT n1, n2, m1, m2, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS sd FROM ({_WELCH})),
z AS (SELECT 0 AS step, kind, CAST(a AS DOUBLE) AS n1, CAST(b AS DOUBLE) AS n2, CAST(d AS DOUBLE) AS d, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM (
SELECT 'd' AS kind, n1 AS a, n2 AS b, NULL AS d, 0.0 AS lo, 1.0 AS hi FROM w UNION ALL SELECT kind, NULL, NULL, d, 2.0, 1026.0 FROM w, (VALUES ('small', 0.2), ('medium', 0.5), ('large', 0.8)) AS x(kind, d))
UNION ALL SELECT step + 1, kind, n1, n2, d, CASE WHEN {t_power('e', 'a', 'b', 'edge')} < 0.8 THEN (lo + hi) / 2 ELSE lo END,
CASE WHEN {t_power('e', 'a', 'b', 'edge')} < 0.8 THEN hi ELSE (lo + hi) / 2 END FROM (SELECT *, {t_quantile(0.975, 1.959963984540054, '(a + b - 2.0)')} AS edge
FROM (SELECT *, coalesce(n1, (lo + hi) / 2) AS a, coalesce(n2, (lo + hi) / 2) AS b, coalesce(d, (lo + hi) / 2) AS e FROM z WHERE step < 42))),
f AS (SELECT kind, (lo + hi) / 2 AS x FROM z WHERE step = 42), d AS (SELECT x AS d FROM f WHERE kind = 'd')
SELECT n1, n2, {r6('d', 'detectable_d')}, {r6('sd', 'pooled_sd')}, round(d * sd, 3) + 0.0 AS detectable_difference, {r6('abs(m1 - m2)', 'observed_difference')},
(SELECT CAST(ceil(x - 1e-6) AS BIGINT) FROM f WHERE kind = 'small') AS rows_for_small, (SELECT CAST(ceil(x - 1e-6) AS BIGINT) FROM f WHERE kind = 'medium') AS rows_for_medium,
(SELECT CAST(ceil(x - 1e-6) AS BIGINT) FROM f WHERE kind = 'large') AS rows_for_large FROM w, d"""


@query("sample_adequacy_plan", (SALES_SQL + _moments("status") + _PLAN).replace("WITH src", "WITH RECURSIVE src", 1))
def _(spark, folder):
    from pyspark.sql import functions as F
    return run(sales(spark, folder), "sample_adequacy", dimension="status", measure="price_avg").withColumn(
        "detectable_difference", F.round("detectable_difference", 3))


# --- tier 7 -----------------------------------------------------------------------------------

@query("repeat_behaviour", SALES_SQL + f""", k AS (SELECT o_custkey, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT CASE WHEN n <= 1 THEN 'once' WHEN n <= 2 THEN 'twice' WHEN n <= 3 THEN 'three times' WHEN n <= 5 THEN '4 to 5 times' ELSE 'more than 5 times' END AS bucket, n FROM k)
SELECT bucket, count(*) AS people, {r6('count(*) * 1.0 / (SELECT count(*) FROM k)', 'share')}, CAST(sum(n) AS BIGINT) AS events FROM b GROUP BY bucket""")
def _(spark, folder):
    return run(sales(spark, folder), "repeat_behaviour", entity="o_custkey")


_SEQ = """, e AS (SELECT user_id AS k, ts AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS seq,
date_diff('day', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) AS gap FROM s)
"""


@query("repeat_first_gap", EVENTS_SQL + _SEQ + f"SELECT {r6('median(gap)', 'days')}, count(*) AS gaps FROM e WHERE seq = 2")
def _(spark, folder):
    return people.repeat_first_gap(events(spark, folder), "user_id")


@query("repeat_consecutive_gap", SALES_SQL + f""", e AS (SELECT date_diff('day', lag(odate) OVER (PARTITION BY o_custkey ORDER BY odate), odate) AS gap FROM s)
SELECT {r6('median(gap)', 'days')}, count(gap) AS gaps FROM e""")
def _(spark, folder):
    return people.repeat_consecutive_gap(sales(spark, folder), "o_custkey")


@query("repeat_summary", EVENTS_SQL + _SEQ + f""", k AS (SELECT k, count(*) AS n FROM e GROUP BY 1), o AS (SELECT n, row_number() OVER (ORDER BY n) AS rn, count(*) OVER () AS c FROM k)
SELECT (SELECT count(*) FROM k) AS people, count(*) AS events, {r6('(SELECT count(*) FILTER (WHERE n > 1) * 1.0 / count(*) FROM k)', 'repeat_rate')},
(SELECT max(n) FROM k) AS busiest, (SELECT n FROM o WHERE rn = (c + 1) // 2) AS median_events,
{r6('median(gap) FILTER (WHERE seq = 2)', 'first_gap')}, {r6('median(gap)', 'consecutive_gap')} FROM e""")
def _(spark, folder):
    return people.repeat_summary(events(spark, folder), "user_id")


def _cohort(key: str, d: str, grain: str) -> str:
    return f""", a AS (SELECT DISTINCT {key} AS k, CAST(date_trunc('{grain}', {d}) AS DATE) AS p FROM s WHERE {key} IS NOT NULL AND {d} IS NOT NULL),
f AS (SELECT k, min(p) AS cohort FROM a GROUP BY 1), g AS (SELECT cohort, date_diff('{grain}', cohort, p) AS o, count(*) AS people FROM a JOIN f USING (k) GROUP BY 1, 2)
SELECT CAST(cohort AS VARCHAR) AS cohort, max(people) FILTER (WHERE o = 0) OVER (PARTITION BY cohort) AS cohort_size, o AS "offset", people FROM g"""


@query("cohort_retention", SALES_SQL + _cohort("o_custkey", "odate", "month"))
def _(spark, folder):
    return run(sales(spark, folder), "cohort_retention", entity="o_custkey")


@query("cohort_retention_week", EVENTS_SQL + _cohort("user_id", "ts", "week"))
def _(spark, folder):
    return run(events(spark, folder), "cohort_retention", entity="user_id", period="week")


# --- what stands beside a result --------------------------------------------------------------

@query("frequency_rest", SALES_SQL + """, g AS (SELECT o_custkey AS m, count(*) AS n FROM s GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, m NULLS LAST) AS k FROM g),
e AS (SELECT min(n) AS edge FROM r WHERE k <= 20)
SELECT count(*) FILTER (WHERE k <= 20) AS shown, CAST(sum(n) FILTER (WHERE k <= 20) AS BIGINT) AS shown_rows, count(*) FILTER (WHERE k > 20) AS values_left,
CAST(sum(n) FILTER (WHERE k > 20) AS BIGINT) AS rows_left, count(*) FILTER (WHERE n = edge) AS tied, count(*) FILTER (WHERE n = edge AND k > 20) AS tied_left_out FROM r, e""")
def _(spark, folder):
    return describe.frequency_rest(sales(spark, folder), "o_custkey")


@query("top_n_joint", SALES_SQL + f""", g AS (SELECT o_custkey AS m, sum(price) AS v, count(*) AS n FROM s GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v DESC NULLS LAST, m NULLS LAST) AS k FROM g)
SELECT count(*) FILTER (WHERE k <= 10) AS shown, CAST(sum(n) FILTER (WHERE k <= 10) AS BIGINT) AS rows, {r6('sum(v) FILTER (WHERE k <= 10) / sum(v)', 'joint_share')}, count(*) AS groups FROM r""")
def _(spark, folder):
    return describe.top_n_joint(sales(spark, folder), "o_custkey", "price")


@query("pareto_crossing", SALES_SQL + f""", g AS (SELECT o_custkey AS m, count(price) AS v FROM s GROUP BY 1),
r AS (SELECT *, sum(v) OVER (ORDER BY v DESC, m NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto, sum(v) OVER () AS whole FROM g),
t AS (SELECT *, (upto - v) * 1.0 / whole < 0.8 AS reached FROM r), e AS (SELECT min(v) AS edge FROM t WHERE reached)
SELECT count(*) FILTER (WHERE reached) AS needed, count(*) AS groups, {r6('max(upto) FILTER (WHERE reached) * 1.0 / max(whole)', 'share')}, count(*) FILTER (WHERE v = edge) AS tied,
count(*) FILTER (WHERE v = edge AND NOT reached) AS tied_left_out FROM t, e""")
def _(spark, folder):
    return compare.pareto_crossing(sales(spark, folder), "o_custkey", "priced")


@query("ranking_shift_rows", EVENTS_SQL + """, d AS (SELECT CAST(ts AS DATE) AS day FROM s),
b AS (SELECT day BETWEEN DATE '2024-01-03' AND DATE '2024-01-12' AS b, day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AS a, day FROM d)
SELECT count(*) AS rows, count(*) FILTER (WHERE b AND NOT a) AS before_only, count(*) FILTER (WHERE a AND NOT b) AS after_only, count(*) FILTER (WHERE a AND b) AS in_both,
count(*) FILTER (WHERE NOT a AND NOT b) AS in_neither, count(*) FILTER (WHERE day IS NULL) AS undated FROM b""")
def _(spark, folder):
    return compare.ranking_shift_rows(events(spark, folder), "2024-01-03", "2024-01-12", "2024-01-10", "2024-01-20")


@query("period_gaps", SALES_SQL + """, m AS (SELECT CAST(unnest(generate_series(DATE '1997-01-01', DATE '1998-12-01', INTERVAL 1 MONTH)) AS DATE) AS m)
SELECT strftime(m, '%Y') AS period, strftime(m, '%Y-%m') AS month FROM m WHERE m NOT IN (SELECT CAST(date_trunc('month', odate) AS DATE) FROM s WHERE odate IS NOT NULL)""")
def _(spark, folder):
    return time.period_gaps(sales(spark, folder), "1998", "1997", "year")


@query("outliers_beside_all", EVENTS_SQL + """, v AS (SELECT event_type AS g, CAST(value AS DOUBLE) AS x FROM s WHERE value IS NOT NULL),
q AS (SELECT g, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM v GROUP BY g), w AS (SELECT quantile_cont(x, 0.25) AS c, quantile_cont(x, 0.75) AS d FROM v),
f AS (SELECT v.g, x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a) AS own, x < c - 1.5 * (d - c) OR x > d + 1.5 * (d - c) AS overall FROM v JOIN q ON v.g IS NOT DISTINCT FROM q.g, w)
SELECT g AS member, count(*) AS n, count(*) FILTER (WHERE own) AS own, count(*) FILTER (WHERE overall) AS overall, count(*) FILTER (WHERE own AND overall) AS both FROM f GROUP BY g""")
def _(spark, folder):
    return unusual.outliers_beside_all(events(spark, folder), "value", "event_type")


@query("returning", SALES_SQL + f""", k AS (SELECT o_custkey, min(date_trunc('quarter', odate)) AS lo, max(date_trunc('quarter', odate)) AS hi FROM s WHERE odate IS NOT NULL GROUP BY 1)
SELECT count(*) AS people, count(*) FILTER (WHERE lo < hi) AS returned, {r6('count(*) FILTER (WHERE lo < hi) * 1.0 / count(*)', 'rate')},
count(*) FILTER (WHERE lo < hi) * 1.0 / count(*) < {people.LOW_REPEAT} AS is_low FROM k""")
def _(spark, folder):
    return people.returning(sales(spark, folder), "o_custkey", "quarter")
