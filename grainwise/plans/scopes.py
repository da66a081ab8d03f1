"""Scopes, predicates, joins and aggregates that no single analysis owns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from grainwise.contract import Measure
from grainwise.operators.common import totals
from grainwise.plans.base import (
    DIRTY_SQL, LINES_SQL, OUTAGE, SALES_SQL, UNSURE, WINDOW_SQL, dirty, lines, query, r6, sales, table)
from grainwise.registry import accounted
from grainwise.scope import rule_column, scope_for

_EXCLUDED = f"coalesce({OUTAGE}, false) OR coalesce({UNSURE}, false)"


def _buckets(extra: dict[str, str] | None = None) -> str:
    """The counters of a scope: each row in the first bucket that takes it."""
    chain = {"excluded": _EXCLUDED, "no_date": "odate IS NULL", "outside_window": f"NOT ({WINDOW_SQL})", **(extra or {})}
    case = " ".join(f"WHEN {test} THEN '{name}'" for name, test in chain.items())
    names = ("excluded", "outside_window", "no_date", "unselected", "filtered", "analysed")
    counts = ", ".join(f"count(*) FILTER (WHERE b = '{n}') AS {n}" for n in names)
    return f""", t AS (SELECT *, CASE {case} ELSE 'analysed' END AS b FROM src)
SELECT count(*) AS rows, {counts}, count(*) FILTER (WHERE b = 'analysed' AND (({OUTAGE}) IS NULL OR ({UNSURE}) IS NULL)) AS rule_unknown FROM t"""


@query("scope_counts", SALES_SQL + _buckets())
def _(spark, folder):
    return sales(spark, folder).counts()


@query("scope_filter", SALES_SQL + _buckets({"filtered": "NOT coalesce(price > 100000, false)"}))
def _(spark, folder):
    return sales(spark, folder).where("price > 100000").counts()


@query("scope_groups", SALES_SQL + _buckets({"unselected": "NOT coalesce(status IN ('O'), false) AND status IS NOT NULL"}))
def _(spark, folder):
    return sales(spark, folder).groups("status", ["O", None]).counts()


@query("scope_period", SALES_SQL + _buckets({"outside_window": f"NOT ({WINDOW_SQL}) OR NOT (odate >= DATE '1998-04-01' AND odate < DATE '1998-07-01')"}))
def _(spark, folder):
    return sales(spark, folder).period("1998-Q2", "quarter").counts()


@query("rule_validation", SALES_SQL + """SELECT count(*) FILTER (WHERE status = 'F' AND price > 50000) AS held, count(*) FILTER (WHERE NOT (status = 'F' AND price > 50000)) AS failed,
count(*) FILTER (WHERE (status = 'F' AND price > 50000) IS NULL) AS unknown, 4 AS refused FROM src""")
def _(spark, folder):
    from grainwise.errors import ParamsInvalid
    from grainwise.functions.exprs import count_where
    df = sales(spark, folder).source
    refused = 0
    for rule in ("price", "price > ", "price > (SELECT avg(gross) FROM other)", "price > 1; DROP TABLE orders"):
        try:
            rule_column(df, rule)
        except ParamsInvalid:
            refused += 1
    test = rule_column(df, "status = 'F' AND price > 50000")
    return df.agg(count_where(test).alias("held"), count_where(~test).alias("failed"), F.count_if(test.isNull()).alias("unknown"),
                  F.lit(refused).alias("refused"))


@query("derived_measures", SALES_SQL + f"SELECT count(large) AS n, {r6('sum(CAST(is_large AS INTEGER))', 'total')}, {r6('avg(CAST(is_large AS INTEGER))', 'mean')} FROM (SELECT *, is_large AS large FROM s)")
def _(spark, folder):
    return sales(spark, folder).frame.agg(F.count("large").alias("n"), F.sum("large").cast("double").alias("total"), F.avg("large").alias("mean"))


@query("compare_measure", LINES_SQL + f"""SELECT l_linestatus AS member, {r6('avg(CASE WHEN tax > discount THEN 1.0 WHEN tax <= discount THEN 0.0 END)', 'value')}, count(*) AS rows FROM s GROUP BY 1""")
def _(spark, folder):
    scope = lines(spark, folder)
    return totals(scope.frame, scope.contract.measure("taxed_more"), [F.col("l_linestatus")], ["member"])


_UNIT_SQL = """WITH j AS (SELECT l_orderkey, l_linenumber, CAST(o_totalprice AS DECIMAL(18,2)) AS order_value, o_orderpriority AS priority
FROM lineitem JOIN orders ON l_orderkey = o_orderkey), u AS (SELECT DISTINCT l_orderkey, order_value, priority FROM j)
"""


@query("per_unit_scope", _UNIT_SQL + f"""SELECT priority AS member, {r6('sum(order_value)', 'total')}, count(*) AS rows, {r6('sum(order_value) / (SELECT sum(order_value) FROM u)', 'share')},
row_number() OVER (ORDER BY sum(order_value) DESC, priority) AS rank FROM u GROUP BY 1""")
def _(spark, folder):
    from grainwise.contract import DatasetContract
    from grainwise.registry import run
    joined = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", F.col("o_totalprice").cast("decimal(18,2)").alias("order_value"), F.col("o_orderpriority").alias("priority"))
    contract = DatasetContract(dataset="order_lines", grain="one line", dimensions=("priority",),
                               measures=(Measure("order_value", "sum", per=("l_orderkey",)),))
    return run(scope_for(joined, contract), "top_n", dimension="priority", measure="order_value")


_AGGS = {"price": "sum(price)", "price_avg": "avg(CAST(price AS DOUBLE))", "price_mid": "median(CAST(price AS DOUBLE))", "price_low": "min(price)",
         "price_high": "max(price)", "priced": "count(price)", "buyers": "count(DISTINCT o_custkey)"}


@query("agg_declared", SALES_SQL + " UNION ALL ".join(f"SELECT '{m}' AS measure, status AS member, {r6(a, 'value')}, count(*) AS rows FROM s GROUP BY status" for m, a in _AGGS.items()))
def _(spark, folder):
    scope = sales(spark, folder)
    out = None
    for name in _AGGS:
        one = totals(scope.frame, scope.contract.measure(name), [F.col("status")], ["member"]).select(
            F.lit(name).alias("measure"), "member", F.col("value").cast("double").alias("value"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("ratio_of_sums", LINES_SQL + f"""SELECT flag AS member, {r6('CAST(sum(price) AS DOUBLE) / nullif(CAST(sum(qty) AS DOUBLE), 0)', 'value')},
{r6('100 * CAST(sum(price) - sum(tax) AS DOUBLE) / nullif(CAST(sum(price) AS DOUBLE), 0)', 'net_rate')}, count(*) AS rows FROM s GROUP BY flag""")
def _(spark, folder):
    scope = lines(spark, folder)
    from grainwise.functions.exprs import declared
    f, c = scope.frame, scope.contract
    return f.groupBy(F.col("flag").alias("member")).agg(declared(f, c.measure("unit_price")).alias("value"),
                                                        declared(f, c.measure("net_rate")).alias("net_rate"), F.count(F.lit(1)).alias("rows"))


@query("ratio_cross_tab", LINES_SQL + f"""SELECT flag AS row_member, l_linestatus AS column_member, {r6('CAST(sum(price) AS DOUBLE) / nullif(CAST(sum(qty) AS DOUBLE), 0)', 'value')},
count(*) AS rows, grouping(l_linestatus) = 1 AS is_row_total, grouping(flag) = 1 AS is_column_total
FROM s GROUP BY GROUPING SETS ((flag, l_linestatus), (flag), (l_linestatus), ())""")
def _(spark, folder):
    from grainwise.registry import run
    return run(lines(spark, folder), "cross_tab", rows="flag", columns="l_linestatus", measure="unit_price")


@query("column_replace_keeps_order", DIRTY_SQL + "SELECT count(*) AS rows, 16 AS columns, 'account' AS second, count(DISTINCT upper(priority)) AS spellings FROM d")
def _(spark, folder):
    from grainwise.cleaning.actions import EXCLUDE_COLUMN, NORMALISE_CASE, Action, perform
    df = perform(perform(dirty(spark, folder), Action("C1", NORMALISE_CASE, "priority")), Action("C2", EXCLUDE_COLUMN, "ledger"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"), F.lit(df.columns[1]).alias("second"),
                  F.count_distinct("priority").alias("spellings"))


@query("finite_filter", DIRTY_SQL + f"SELECT count(reading) AS present, count(*) FILTER (WHERE isfinite(reading)) AS finite, {r6('avg(reading) FILTER (WHERE isfinite(reading))', 'mean')} FROM d")
def _(spark, folder):
    from grainwise.functions.exprs import finite, finite_value
    df = dirty(spark, folder)
    return df.agg(F.count("reading").alias("present"), F.count_if(finite(df, "reading")).alias("finite"), F.avg(finite_value(df, "reading")).alias("mean"))


@query("summary_stats_ratio", LINES_SQL + f"""SELECT 'unit_price' AS measure, 'ratio' AS agg, count(*) AS n, {r6('CAST(sum(price) AS DOUBLE) / CAST(sum(qty) AS DOUBLE)', 'total')} FROM s
UNION ALL SELECT 'qty', 'sum', count(qty), {r6('sum(qty)', 'total')} FROM s""")
def _(spark, folder):
    from grainwise.registry import run
    scope = lines(spark, folder)
    kept = tuple(m for m in scope.contract.measures if m.name in ("unit_price", "qty"))
    return run(scope_for(scope.source.drop("unit_price__n", "unit_price__d", "net_rate__n", "net_rate__d", "taxed_more"), replace(scope.contract, measures=kept)),
               "summary_stats").select("measure", "agg", "n", "total")


#: Runs whose rows are accounted for: (scope, name, parameters, SQL of the rows set aside over `s`).
_ACCOUNTED = (
    ("frequency", {"column": "o_custkey", "limit": 3}, "0"), ("top_n", {"dimension": "o_custkey", "measure": "price"}, "0"),
    ("cross_tab", {"rows": "status", "columns": "priority"}, "0"), ("group_compare", {"dimension": "status", "measure": "price"}, "0"),
    ("distribution", {"measure": "price_avg"}, "count(*) FILTER (WHERE price IS NULL)"), ("trend", {"measure": "price"}, "count(*) FILTER (WHERE odate IS NULL)"),
    ("bivariate", {"measure": "price", "against": "gross"}, "count(*) FILTER (WHERE price IS NULL OR gross IS NULL)"),
    ("hypothesis_test", {"dimension": "status", "second_dimension": "priority"}, "count(*) FILTER (WHERE status IS NULL OR priority IS NULL)"),
    ("outlier_detection", {"measure": "price"}, "count(*) FILTER (WHERE price IS NULL)"),
    ("cohort_retention", {"entity": "o_custkey"}, "count(*) FILTER (WHERE o_custkey IS NULL OR odate IS NULL)"),
)


@query("row_accounting", SALES_SQL + " UNION ALL ".join(
    f"SELECT '{name}' AS analysis, count(*) AS entered, {aside} AS set_aside, count(*) - {aside} AS held FROM s" for name, _, aside in _ACCOUNTED))
def _(spark, folder):
    rows = []
    for name, params, _ in _ACCOUNTED:
        result, account = accounted(sales(spark, folder), name, **params)
        result.write.format("noop").mode("overwrite").save()
        counts = account.check()
        rows.append((name, counts["entered"], counts["set_aside"], counts["held"]))
    return spark.createDataFrame(rows, "analysis string, entered long, set_aside long, held long")
