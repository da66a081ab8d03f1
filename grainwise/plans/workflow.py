"""Validation, contract history, gates, logs and the report over the given tables."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import functions as F

from grainwise import report
from grainwise.contract import Binding, DatasetContract, Domain, ForeignKey, Measure, Rule, Window, columns_of
from grainwise.plans.base import SALES, SALES_SQL, query, r6, sales, table
from grainwise.registry import run
from grainwise.session import shared_folder
from grainwise.store import Workspace, gate
from grainwise.validation import checks


def _check(check: str, subject: str, failed: str, not_checked: str, source: str, lines: str = "", fixed: str = "") -> str:
    """A check row; `lines` is a query of all its evidence (line), `fixed` an expression for evidence that is told whole."""
    evidence = (f"coalesce((SELECT string_agg(line, ' | ' ORDER BY line) FROM (SELECT line FROM ({lines}) ORDER BY line LIMIT 10)), '')" if lines
                else f"CASE WHEN {failed} > 0 THEN {fixed} ELSE '' END" if fixed else "''")
    withheld = f"greatest((SELECT count(*) FROM ({lines})) - 10, 0)" if lines else "0"
    return f"""SELECT '{check}' AS check_id, '{subject}' AS subject, CASE WHEN {failed} > 0 THEN 'FAIL' ELSE 'PASS' END AS outcome, count(*) AS rows,
count(*) - {failed} - {not_checked} AS passed, {failed} AS failed, {not_checked} AS not_checked, {evidence} AS evidence, {withheld} AS withheld FROM {source}"""


def _keyed(source: str, key: str, where: str) -> str:
    return f"SELECT concat_ws(', ', {', '.join(f'coalesce({c}::VARCHAR, {chr(39)}(null){chr(39)})' for c in key.split(', '))}) AS line FROM {source} WHERE {where}"


_REPEATS = "SELECT l_orderkey || ', ' || l_linenumber || ' x' || count(*) AS line FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"
_REPEATED = "(SELECT CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber))"


@query("check_key_unique", _check("key.unique", "l_orderkey, l_linenumber", _REPEATED, "0", "lineitem", _REPEATS))
def _(spark, folder):
    return checks.key_unique(table(spark, folder, "lineitem"), ("l_orderkey", "l_linenumber"))


@query("check_key_complete", SALES_SQL + _check("key.complete", "o_orderkey, status", "count(*) FILTER (WHERE status IS NULL)", "0", "src",
                                                _keyed("src", "o_orderkey, status", "status IS NULL")))
def _(spark, folder):
    return checks.key_complete(sales(spark, folder).source, ("o_orderkey", "status"))


_UNDATED = "count(*) FILTER (WHERE odate IS NULL)"


def _sides(d: str, start: str, end: str) -> tuple[str, str]:
    """Failed rows outside [start, end), and what is told of them."""
    before, after = f"count(*) FILTER (WHERE {d} < DATE '{start}')", f"count(*) FILTER (WHERE {d} >= DATE '{end}')"
    return f"({before} + {after})", f"'before ' || {before} || ' | after ' || {after}"


_SALES_SIDES = _sides("odate", "1996-01-01", "2000-07-01")


@query("check_dates", SALES_SQL + " UNION ALL ".join((
    _check("date.present", "odate", _UNDATED, "0", "src"), _check("date.in_window", "odate", _SALES_SIDES[0], _UNDATED, "src", fixed=_SALES_SIDES[1]),
    _check("date.not_future", "odate", "count(*) FILTER (WHERE CAST(odate AS DATE) > DATE '2000-12-31')", _UNDATED, "src"))))
def _(spark, folder):
    scope = sales(spark, folder)
    return checks.dates(scope.source, scope.contract, F.lit("2000-12-31").cast("date"))


@query("check_row_count", """SELECT 'table.row_count' AS check_id, 'orders' AS subject, 'FAIL' AS outcome, count(*) AS rows, count(*) AS passed, 100 AS failed, 0 AS not_checked,
'' AS evidence, 0 AS withheld FROM orders""")
def _(spark, folder):
    o = table(spark, folder, "orders")
    contract = DatasetContract(dataset="orders", grain="one order", binding=Binding(columns_of(o.schema), o.count() + 100))
    return checks.row_count(o, contract)


_ORPHAN_SQL = """WITH p AS (SELECT CASE WHEN o_totalprice >= 20000 AND o_totalprice <= 480000 THEN o_orderkey ELSE -o_orderkey END AS k FROM orders),
c AS (SELECT CASE WHEN l_quantity = 50 THEN NULL ELSE l_orderkey END AS k FROM lineitem),
o AS (SELECT k, count(*) AS n FROM c WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM p WHERE k IS NOT NULL) GROUP BY k)
"""


@query("fk_orphans", _ORPHAN_SQL + _check("reference.integrity[0]", "k -> orders", "(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM o)",
                                          "count(*) FILTER (WHERE k IS NULL)", "c", "SELECT k || ' x' || n AS line FROM o"))
def _(spark, folder):
    # Every order is there; some go by another number, so their lines have no parent.
    known = F.col("o_totalprice").between(20000, 480000)
    parent = table(spark, folder, "orders").select(F.when(known, F.col("o_orderkey")).otherwise(-F.col("o_orderkey")).alias("k"))
    child = table(spark, folder, "lineitem").select(F.when(F.col("l_quantity") != 50, F.col("l_orderkey")).alias("k"))
    return checks.reference(child, parent, ("k",), ("k",), 0, "orders")


@query("check_domain", SALES_SQL + _check("value.domain[status]", "status", "count(*) FILTER (WHERE status NOT IN ('O'))", "count(*) FILTER (WHERE status IS NULL)", "src",
                                          "SELECT status || ' x' || count(*) AS line FROM src WHERE status NOT IN ('O') GROUP BY status"))
def _(spark, folder):
    return checks.domain(sales(spark, folder).source, "status", ("O",))


@query("check_domain_many", """WITH src AS (SELECT * FROM lineitem)
""" + _check("value.domain[l_partkey]", "l_partkey", "count(*) FILTER (WHERE l_partkey NOT IN (1, 2, 3))", "0", "src",
             "SELECT l_partkey || ' x' || count(*) AS line FROM src WHERE l_partkey NOT IN (1, 2, 3) GROUP BY l_partkey"))
def _(spark, folder):
    return checks.domain(table(spark, folder, "lineitem"), "l_partkey", (1, 2, 3))


@query("check_expectation", SALES_SQL + _check("rule[price > 25000]", "price > 25000", "count(*) FILTER (WHERE NOT (price > 25000))", "count(*) FILTER (WHERE price IS NULL)", "src",
                                               _keyed("src", "o_orderkey", "NOT (price > 25000)")))
def _(spark, folder):
    return checks.expectation(sales(spark, folder).source, "price > 25000", ("o_orderkey",))


_LINE_CONTRACT = DatasetContract(
    dataset="lines", grain="one line", key=("l_orderkey", "l_linenumber"), date_column="l_shipdate", window=Window(date(1995, 6, 1), date(2001, 6, 30)),
    measures=(Measure("l_quantity", "sum"),), dimensions=("l_returnflag",), domains=(Domain("l_returnflag", ("A", "R")),),
    foreign_keys=(ForeignKey(("l_orderkey",), "orders", ("o_orderkey",)), ForeignKey(("l_partkey",), "missing", ("p_partkey",))),
    expectations=(Rule("l_discount <= 0.08", "no deep discounts"),))
_LINE_SIDES = _sides("l_shipdate", "1995-06-01", "2001-07-01")


def _line_report(window: bool, today: str) -> str:
    return " UNION ALL ".join((
        _check("key.unique", "l_orderkey, l_linenumber", _REPEATED, "0", "lineitem", _REPEATS),
        _check("key.complete", "l_orderkey, l_linenumber", "0", "0", "lineitem"), _check("date.present", "l_shipdate", "0", "0", "lineitem"),
        *([_check("date.in_window", "l_shipdate", _LINE_SIDES[0], "0", "lineitem", fixed=_LINE_SIDES[1])] if window else []),
        _check("date.not_future", "l_shipdate", f"count(*) FILTER (WHERE l_shipdate > DATE '{today}')", "0", "lineitem"),
        _check("reference.integrity[0]", "l_orderkey -> orders", "(SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))", "0", "lineitem",
               "SELECT l_orderkey || ' x' || count(*) AS line FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey"),
        "SELECT 'reference.integrity[1]', 'l_partkey -> missing', 'NOT RUN', count(*), 0, 0, count(*), '', 0 FROM lineitem",
        _check("value.domain[l_returnflag]", "l_returnflag", "count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'R'))", "0", "lineitem",
               "SELECT l_returnflag || ' x' || count(*) AS line FROM lineitem WHERE l_returnflag NOT IN ('A', 'R') GROUP BY l_returnflag"),
        _check("rule[l_discount <= 0.08]", "l_discount <= 0.08", "count(*) FILTER (WHERE NOT l_discount <= 0.08)", "0", "lineitem",
               _keyed("lineitem", "l_orderkey, l_linenumber", "NOT l_discount <= 0.08"))))


@query("validation_report", _line_report(True, "2001-10-01"))
def _(spark, folder):
    return checks.validate(table(spark, folder, "lineitem"), _LINE_CONTRACT, {"orders": table(spark, folder, "orders")}, F.lit("2001-10-01").cast("date"))


@query("validation_headline", f"""SELECT count(*) FILTER (WHERE outcome = 'PASS') AS passed, count(*) FILTER (WHERE outcome = 'FAIL') AS failed,
count(*) FILTER (WHERE outcome = 'NOT RUN') AS not_run FROM ({_line_report(True, '2002-10-01')})""")
def _(spark, folder):
    results = checks.validate(table(spark, folder, "lineitem"), _LINE_CONTRACT, {"orders": table(spark, folder, "orders")}, F.lit("2002-10-01").cast("date"))
    return checks.headline(results)


def _space(spark, folder) -> Workspace:
    """Orders under a contract whose second version adds a dimension; customers under none."""
    space = Workspace(spark, shared_folder(spark, "space"))
    space.register("sales", table(spark, folder, "orders").selectExpr(*SALES), at=datetime(2024, 1, 1))
    space.register("customers", table(spark, folder, "customer"), at=datetime(2024, 1, 1))
    first = DatasetContract(dataset="sales", grain="one order", key=("o_orderkey",), date_column="odate", measures=(Measure("price", "sum", "order value"),),
                            dimensions=("status",), caveats=("undated orders are the largest",))
    space.confirm(first, at=datetime(2024, 1, 2))
    space.confirm(first, at=datetime(2024, 1, 3))
    space.confirm(replace(first, dimensions=("status", "priority")), at=datetime(2024, 1, 4))
    return space


@query("contract_history", """SELECT 1 AS version, '' AS changed, count(*) AS row_count, '2024-01-02 00:00:00' AS valid_from, '2024-01-04 00:00:00' AS valid_to, false AS is_current FROM orders
UNION ALL SELECT 2, 'dimensions', count(*), '2024-01-04 00:00:00', NULL, true FROM orders""")
def _(spark, folder):
    return _space(spark, folder).contract_history("sales").select("version", "changed", "row_count", "valid_from", "valid_to", "is_current")


@query("gate_status", """SELECT 'sales' AS dataset, true AS has_contract, 'IDENTICAL' AS drift, count(*) = count(DISTINCT o_orderkey) AS key_holds, count(*) - count(DISTINCT o_orderkey) AS repeats,
CAST(NULL AS BIGINT) AS copies, count(*) = count(DISTINCT o_orderkey) AS is_open FROM orders""")
def _(spark, folder):
    return gate.gate_status(_space(spark, folder), "sales")


@query("workflow_state", """SELECT 'customers' AS dataset, count(*) AS row_count, false AS has_contract, CAST(NULL AS VARCHAR) AS drift, false AS is_open, 'draft a contract' AS next_step FROM customer
UNION ALL SELECT 'sales', count(*), true, 'IDENTICAL', true, 'analyse' FROM orders""")
def _(spark, folder):
    return gate.workflow_state(_space(spark, folder))


_RUNS_SQL = """SELECT 'top_n' AS name, 'top_n(dimension=''status'', measure=''price'')' AS call, 2 AS contract_version, count(*) AS rows_analysed FROM orders
UNION ALL SELECT 'trend', 'trend(grain=''year'', measure=''price'')', 2, count(*) FROM orders"""


@query("analysis_runs", _RUNS_SQL)
def _(spark, folder):
    space = _space(spark, folder)
    gate.analyse(space, "sales", "top_n", at=datetime(2024, 1, 5), dimension="status", measure="price")
    gate.analyse(space, "sales", "trend", at=datetime(2024, 1, 6), measure="price", grain="year")
    return space.log("analyses").select("name", "call", "contract_version", "rows_analysed")


@query("profile_runs", "SELECT count(*) AS rows_was, count(*) FILTER (WHERE o_totalprice >= 100000) AS rows_now, false AS changed FROM orders")
def _(spark, folder):
    space = _space(spark, folder)
    report.record_profile(space, "sales", at=datetime(2024, 1, 5))
    space.register("sales", space.read("sales").where("gross >= 100000"))
    return report.profile_drift(space, "sales")


@query("validation_drift", """SELECT 'rule[gross > 200000]' AS check_id, (SELECT count(*) FROM orders WHERE NOT o_totalprice > 200000) AS before,
(SELECT count(*) FROM orders WHERE o_totalprice >= 100000 AND NOT o_totalprice > 200000) AS now FROM orders HAVING count(*) > 0""")
def _(spark, folder):
    space = _space(spark, folder)
    contract = DatasetContract(dataset="sales", grain="one order", expectations=(Rule("gross > 200000"),))
    checks.record(space, "sales", checks.validate(space.read("sales"), contract), at=datetime(2024, 1, 5))
    space.register("sales", space.read("sales").where("gross >= 100000"))
    checks.record(space, "sales", checks.validate(space.read("sales"), contract), at=datetime(2024, 1, 6))
    return checks.run_drift(space, "sales")


@query("report_sections", """WITH n AS (SELECT count(*) AS n FROM orders)
SELECT 'The question asked' AS section, 1 AS line_no, 'Who buys?' AS text FROM n UNION ALL SELECT 'Dataset and grain', 1, 'version 2 - one order' FROM n
UNION ALL SELECT 'Data quality', 1, n || ' rows, 9 columns' FROM n UNION ALL SELECT 'Cleaning ledger', 0, '(nothing recorded)' FROM n
UNION ALL SELECT 'Validation results', 1, 'key.complete PASS 0 failed' FROM n UNION ALL SELECT 'Validation results', 2, 'key.unique PASS 0 failed' FROM n
UNION ALL SELECT 'Findings', 1, 'top_n: 3 row(s); ' || n || ' of ' || n || ' rows analysed' FROM n
UNION ALL SELECT 'Method notes', 1, n || ' rows analysed under contract version 2' FROM n
UNION ALL SELECT 'Caveats and exclusions', 1, '["undated orders are the largest"]' FROM n
UNION ALL SELECT 'Reproduction appendix', 1, 'top_n(dimension=''status'', measure=''price'')' FROM n""")
def _(spark, folder):
    space = _space(spark, folder)
    report.record_profile(space, "sales", at=datetime(2024, 1, 5))
    contract = DatasetContract(dataset="sales", grain="one order", key=("o_orderkey",))
    checks.record(space, "sales", checks.validate(space.read("sales"), contract), at=datetime(2024, 1, 5))
    gate.analyse(space, "sales", "top_n", at=datetime(2024, 1, 6), dimension="status", measure="price")
    return report.report_sections(space, "sales", "Who buys?")


_SERIES = SALES_SQL + """, p AS (SELECT status AS x, sum(price) AS total FROM s GROUP BY status)
"""


@query("chart_series", _SERIES + f"SELECT 'total' AS series, x, {r6('total', 'y')} FROM p UNION ALL SELECT 'share', x, {r6('total / (SELECT sum(total) FROM p)', 'y')} FROM p")
def _(spark, folder):
    result = run(sales(spark, folder), "group_compare", dimension="status", measure="price")
    return report.chart_series(result, x="member", y=["total", "share"])


@query("chart_facts", SALES_SQL + f""", m AS (SELECT strftime(CAST(unnest(generate_series(DATE '1996-01-01', DATE '2000-06-01', INTERVAL 1 MONTH)) AS DATE), '%Y-%m') AS x),
v AS (SELECT strftime(odate, '%Y-%m') AS x, CAST(sum(price) AS DOUBLE) AS y FROM s GROUP BY 1), j AS (SELECT m.x, v.y FROM m LEFT JOIN v USING (x))
SELECT 'value' AS series, count(y) AS points, count(*) FILTER (WHERE y IS NULL) AS empty, {r6('min(y)', 'lowest')}, {r6('max(y)', 'highest')}, {r6('arg_min(y, x)', 'first')}, {r6('arg_max(y, x)', 'last')} FROM j""")
def _(spark, folder):
    return report.series_facts(report.chart_series(run(sales(spark, folder), "trend", measure="price")))
