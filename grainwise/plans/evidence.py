"""Keys, drafts, suggestions, caveats and claims over the given tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from grainwise.contract import Binding, Measure, columns_of
from grainwise.evidence import caveats, claims, draft, keys, suggest
from grainwise.plans.base import (
    DIRTY_SQL, PLAIN_ORDERS, REPEATED_SQL, dirty, query, r6, repeated, table)
from grainwise.profiling.evidence import gather
from grainwise.session import shared_folder
from grainwise.store import Workspace

_LINE_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                 "l_returnflag", "l_linestatus", "l_shipdate")
_CONV = ("conv_id", "turn", "role", "text")


@query("key_singles", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS rows, count(DISTINCT {c}) AS "distinct", count(DISTINCT {c}) = count(*) AS is_key FROM orders"""
                                         for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def _(spark, folder):
    return keys.key_singles(table(spark, folder, "orders"))


@query("key_pairs", """SELECT 'conv_id' AS first, 'turn' AS second, (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn FROM conversations)) AS "distinct",
count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn FROM conversations)) = count(*) AS is_unique FROM conversations""")
def _(spark, folder):
    return keys.key_pairs(table(spark, folder, "conversations"))


@query("key_verify", "SELECT count(*) AS rows, count(o_orderkey) AS keyed_rows, count(DISTINCT o_orderkey) AS \"distinct\", 0 AS null_rows, count(o_orderkey) - count(DISTINCT o_orderkey) AS duplicates, count(DISTINCT o_orderkey) = count(*) AS holds FROM orders")
def _(spark, folder):
    return keys.verify(table(spark, folder, "orders"), ["o_orderkey"])


_NULLED = """WITH k AS (SELECT l_orderkey AS a, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_linenumber END AS b FROM lineitem)
"""


@query("key_verify_composite", _NULLED + """SELECT count(*) AS rows, count(*) AS keyed_rows, (SELECT count(*) FROM (SELECT DISTINCT a, b FROM k)) AS "distinct",
count(*) FILTER (WHERE b IS NULL) AS null_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT a, b FROM k)) AS duplicates, false AS holds FROM k""")
def _(spark, folder):
    df = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("a"), F.when(F.col("l_returnflag") != "N", F.col("l_linenumber")).alias("b"))
    return keys.verify(df, ["a", "b"])


@query("repeated_keys", """SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 3 DESC, 1, 2 LIMIT 10""")
def _(spark, folder):
    return keys.repeated_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("exact_copies", REPEATED_SQL + "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS copies FROM d")
def _(spark, folder):
    return keys.exact_copies(repeated(spark, folder))


@query("nearest_key", REPEATED_SQL + """SELECT 'o_orderkey' AS "column", count(*) - count(DISTINCT o_orderkey) AS repeats, 0 AS null_rows,
count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS copies, count(DISTINCT o_orderkey) = (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS fixed_by_removing_copies FROM d""")
def _(spark, folder):
    # Orders have no column named like an identifier, so theirs are named so here.
    df = repeated(spark, folder).withColumnsRenamed({"o_orderkey": "order_id", "o_custkey": "cust_id"})
    return keys.nearest_key(df).withColumn("column", F.regexp_replace("column", "order_id", "o_orderkey"))


_JOINED_SQL = """WITH j AS (SELECT l_orderkey AS order_id, l_linenumber AS line_no, CAST(o_totalprice AS DECIMAL(18,2)) AS order_value, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def _joined(spark, folder):
    """Order lines with what a shop would know: one value per order, a price per row, a flag."""
    lines, heads = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    j = lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("string").alias("line_label"), F.col("o_totalprice").alias("order_fee"),
        F.col("l_extendedprice").alias("amount"), F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), F.col("l_tax").alias("tax_share"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_returned"), F.year("l_shipdate").alias("ship_year"),
        F.datediff("l_shipdate", "o_orderdate").alias("delivery_days"), (F.col("o_custkey") % 1000 * 1.5).alias("stock_level"),
        (F.col("l_partkey") % 90 / 1.5).alias("drop_lat"), (F.col("l_suppkey") * 1.25).alias("distance_km"))


@query("unit_constancy", _JOINED_SQL + """SELECT 'order_value' AS "column", (SELECT max(n) FROM (SELECT count(DISTINCT order_value) AS n FROM j GROUP BY order_id)) = 1 AS is_constant
UNION ALL SELECT 'amount', (SELECT max(n) FROM (SELECT count(DISTINCT amount) AS n FROM j GROUP BY order_id)) = 1""")
def _(spark, folder):
    df = _joined(spark, folder).withColumnRenamed("order_fee", "order_value")
    return keys.unit_constancy(df, ["order_id"], ["order_value", "amount"])


_MEASURES = ("order_fee", "amount", "quantity", "unit_price", "tax_share", "is_returned", "ship_year", "delivery_days", "stock_level", "drop_lat", "distance_km")
_EXPECTED = {"order_fee": ("sum", "strong", "P1"), "amount": ("sum", "strong", "A1"), "quantity": ("sum", "strong", "A1"), "unit_price": ("none", "strong", "R1"),
             "tax_share": ("none", "strong", "N2"), "is_returned": ("mean", "strong", "F1"), "ship_year": ("none", "strong", "N1"), "delivery_days": ("mean", "likely", "D2"),
             "stock_level": ("none", "likely", "S1"), "drop_lat": ("none", "strong", "G1"), "distance_km": ("sum", "likely", "G2")}


def _suggested(names) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS measure, '{a}' AS agg, '{s}' AS strength, '{r}' AS rule WHERE (SELECT count(*) FROM lineitem) > 0"
                              for m, (a, s, r) in _EXPECTED.items() if m in names)


@query("suggest_by_name", _suggested([m for m in _EXPECTED if m not in ("order_fee", "unit_price", "is_returned")]))
def _(spark, folder):
    df = _joined(spark, folder).drop("order_fee", "unit_price", "is_returned")
    names = [m for m in _MEASURES if m in df.columns]
    # Renamed, so that only names and ranges speak: stock_level is one value per order here.
    found = suggest.suggest(df.drop("order_id"), names)
    return suggest.suggestion_rows(df, found).select("measure", "agg", "strength", "rule")


@query("suggest_per_unit", """SELECT 'order_fee' AS measure, 'order_id' AS unit FROM (SELECT max(n) AS n FROM (SELECT count(DISTINCT o_totalprice) AS n FROM orders GROUP BY o_orderkey)) WHERE n = 1
UNION ALL SELECT 'stock_level', 'order_id' FROM (SELECT max(n) AS n FROM (SELECT count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderkey)) WHERE n = 1""")
def _(spark, folder):
    df = _joined(spark, folder)
    found = suggest.per_units(df, gather(df), list(_MEASURES))
    return spark.createDataFrame(sorted(found.items()), "measure string, unit string")


@query("suggest_ratio", """SELECT 'unit_price' AS measure, 'none' AS agg, 'R1' AS rule, 'amount / quantity' AS ratio, 'amount' AS numerator, 'quantity' AS denominator, CAST(1 AS DOUBLE) AS scale
FROM lineitem WHERE abs(l_extendedprice / l_quantity - l_extendedprice / l_quantity) <= 0.00006 HAVING count(*) >= 50""")
def _(spark, folder):
    df = _joined(spark, folder)
    found = [s for s in suggest.suggest(df, list(_MEASURES)) if s.rule == "R1"]
    return suggest.suggestion_rows(df, found).select("measure", "agg", "rule", "ratio", "numerator", "denominator", "scale")


@query("suggest_credit", """WITH c AS (SELECT l_orderkey, l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS credit FROM lineitem), g AS (SELECT abs(sum(credit) - 1) <= 0.011 AS ok FROM c GROUP BY l_orderkey)
SELECT 'credit' AS measure, 'sum' AS agg, 'A2' AS rule FROM g HAVING count(*) FILTER (WHERE ok) >= 0.99 * count(*)""")
def _(spark, folder):
    lines = table(spark, folder, "lineitem")
    per = lines.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("whole"))
    df = lines.join(per, "l_orderkey").select(F.col("l_orderkey").alias("order_id"), (F.col("l_extendedprice") / F.col("whole")).alias("credit"))
    found = [s for s in suggest.suggest(df, ["credit"]) if s.rule == "A2"]
    return suggest.suggestion_rows(df, found).select("measure", "agg", "rule")


def _priced(spark, folder):
    o = table(spark, folder, "orders")
    code = F.when(F.col("o_orderstatus") == "F", "EUR").when(F.col("o_orderstatus") == "O", "USD").otherwise("GBP")
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("amount"), (F.col("o_totalprice") * 1.1).alias("amount_usd"), code.alias("currency"))


@query("suggest_currency", """SELECT 'amount' AS "column", 'currency' AS currency_column, string_agg(c, ' | ' ORDER BY c) AS codes
FROM (SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 'EUR' WHEN 'O' THEN 'USD' ELSE 'GBP' END AS c FROM orders)""")
def _(spark, folder):
    df = _priced(spark, folder)
    return caveats.mixed_currencies(df, gather(df))


@query("suggest_flags", """SELECT 'quality_rate' AS measure, 'mean' AS agg, 'F1' AS rule, 'quality' AS "column" FROM labels HAVING count(DISTINCT quality) = 2 AND min(quality) = 0 AND max(quality) = 1
UNION ALL SELECT 'toxic_rate', 'mean', 'F1', 'toxic' FROM labels HAVING count(DISTINCT toxic) = 2 AND min(toxic) = 0 AND max(toxic) = 1""")
def _(spark, folder):
    df = table(spark, folder, "labels")
    return suggest.suggestion_rows(df, suggest.flag_rates(gather(df), [])).select("measure", "agg", "rule", "column")


@query("contract_draft", """SELECT 'grain' AS field, CAST(NULL AS VARCHAR) AS subject, 'one row = one o_orderkey' AS value, true AS is_unresolved FROM orders HAVING count(*) = count(DISTINCT o_orderkey)
UNION ALL SELECT 'key', NULL, 'o_orderkey', false FROM orders HAVING count(*) = count(DISTINCT o_orderkey)
UNION ALL SELECT 'date_column', NULL, 'o_orderdate', false UNION ALL SELECT 'analysis_window', 'o_orderdate', NULL, true
UNION ALL SELECT 'measure', 'o_orderkey', NULL, true UNION ALL SELECT 'measure', 'o_custkey', NULL, true UNION ALL SELECT 'measure', 'o_totalprice', NULL, true
UNION ALL SELECT 'dimension', 'o_orderstatus', NULL, false UNION ALL SELECT 'dimension', 'o_orderpriority', NULL, false""")
def _(spark, folder):
    return draft.contract_draft(table(spark, folder, "orders"))


@query("vocabulary_notes", """SELECT 'o_orderstatus' AS "column", string_agg(DISTINCT o_orderstatus, ' | ' ORDER BY o_orderstatus) AS values FROM orders
UNION ALL SELECT 'o_orderpriority', string_agg(DISTINCT o_orderpriority, ' | ' ORDER BY o_orderpriority) FROM orders""")
def _(spark, folder):
    return draft.vocabulary_notes(table(spark, folder, "orders"))


@query("contract_audit", """SELECT 'date_column' AS path, 'data' AS status, 'ordered_at' AS final, CAST(NULL AS VARCHAR) AS stated, '' AS rule
UNION ALL SELECT 'primary_key', 'agree', 'order_id', 'order_id', '' FROM orders HAVING count(*) = count(DISTINCT o_orderkey)
UNION ALL SELECT 'measures[nothing]', 'blocked', NULL, 'nothing', ''
UNION ALL SELECT 'measures[amount].agg', 'agree', 'sum', 'sum', 'A1' UNION ALL SELECT 'measures[cust_id].agg', 'overruled', 'count_distinct', 'sum', 'id'
UNION ALL SELECT 'measures[status].agg', 'blocked', NULL, 'mean', ''""")
def _(spark, folder):
    df = table(spark, folder, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("cust_id"), F.col("o_totalprice").alias("amount"),
                                               F.col("o_orderdate").alias("ordered_at"), F.col("o_orderstatus").alias("status"))
    return draft.contract_audit(df, {"primary_key": ["order_id"], "measures": {
        "nothing": {"agg": "sum"}, "amount": {"agg": "sum"}, "cust_id": {"agg": "sum"}, "status": {"agg": "mean"}}})


@query("schema_drift", """SELECT 'DESTRUCTIVE' AS drift, 'note' AS added, 'o_orderstatus' AS removed, 'o_totalprice' AS retyped, false AS reordered,
'o_orderstatus' AS breaking, count(*) AS rows_was, count(*) FILTER (WHERE o_totalprice >= 50000) AS rows_now FROM orders""")
def _(spark, folder):
    o = table(spark, folder, "orders")
    bound = replace(PLAIN_ORDERS, measures=(Measure("o_custkey", "count_distinct"),), binding=Binding(columns_of(o.schema), o.count()))
    now = o.drop("o_orderstatus").withColumn("o_totalprice", F.col("o_totalprice").cast("string")).withColumn("note", F.lit("x"))
    return draft.schema_drift(bound, now.where(F.col("o_totalprice").cast("double") >= 50000))


# --- caveats ------------------------------------------------------------------------------------

@query("caveat_placeholders", DIRTY_SQL + """SELECT 'units' AS "column", 'n/a' AS token, count(*) AS rows FROM d WHERE units = 'n/a' HAVING count(*) > 0
UNION ALL SELECT 'segment', 'Unknown', count(*) FROM d WHERE segment = 'Unknown' HAVING count(*) > 0""")
def _(spark, folder):
    df = dirty(spark, folder)
    return caveats.placeholders(df, gather(df))


@query("caveat_subtotals", DIRTY_SQL + """SELECT 'segment' AS "column", 'Total' AS token, count(*) AS rows FROM d WHERE segment = 'Total'""")
def _(spark, folder):
    df = dirty(spark, folder)
    return caveats.subtotals(df, gather(df))


@query("caveat_negatives", f"""SELECT 'balance' AS "column", count(*) AS rows, {r6('min(c_acctbal - 3000)', 'lowest')} FROM customer WHERE c_acctbal - 3000 < -3900""")
def _(spark, folder):
    # Shifted so that only a few balances stay below zero, as a correction would.
    df = table(spark, folder, "customer").select("c_name", F.when(F.col("c_acctbal") - 3000 < -3900, F.col("c_acctbal") - 3000).otherwise(F.abs("c_acctbal")).alias("balance"))
    return caveats.negatives(df, gather(df))


@query("caveat_text_dates", DIRTY_SQL + """SELECT 'mixed_day' AS "column", count(*) FILTER (WHERE regexp_full_match(mixed_day, '\\d{4}-\\d{2}-\\d{2}')) AS dates,
count(*) FILTER (WHERE NOT regexp_full_match(mixed_day, '\\d{4}-\\d{2}-\\d{2}')) AS others FROM d""")
def _(spark, folder):
    df = dirty(spark, folder)
    return caveats.text_dates(df, gather(df))


@query("caveat_coordinates", """SELECT 'out_of_range' AS kind, 'lat' AS "column", count(*) AS rows FROM supplier WHERE abs(s_acctbal / 100) > 90 HAVING count(*) > 0
UNION ALL SELECT 'swapped', 'lat, lng', count(*) FROM supplier WHERE abs(s_acctbal / 100) > 90 AND abs(s_acctbal / 100) <= 180 AND abs(s_nationkey * 3) <= 90 HAVING count(*) > 0""")
def _(spark, folder):
    df = table(spark, folder, "supplier").select("s_name", (F.col("s_acctbal") / 100).alias("lat"), (F.col("s_nationkey") * 3).alias("lng"))
    return caveats.coordinates(df, gather(df))


@query("spelling_variants", DIRTY_SQL + """SELECT 'priority' AS "column", lower(trim(priority)) AS folded, string_agg(DISTINCT priority, ' | ' ORDER BY priority) AS spellings, count(*) AS rows FROM d GROUP BY 2 HAVING count(DISTINCT priority) > 1
UNION ALL SELECT 'status', lower(trim(status)), string_agg(DISTINCT status, ' | ' ORDER BY status), count(*) FROM d GROUP BY 2 HAVING count(DISTINCT status) > 1""")
def _(spark, folder):
    df = dirty(spark, folder)
    return caveats.spelling_variants(df, gather(df))


@query("caveat_over_whole", f"""SELECT 'fill_rate' AS "column", 1 AS whole, count(*) FILTER (WHERE o_totalprice / 498000 > 1) AS rows, {r6('max(o_totalprice / 498000)', 'highest')} FROM orders""")
def _(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", (F.col("o_totalprice") / 498000).alias("fill_rate"))
    return caveats.over_whole(df, gather(df))


@query("caveat_split_ids", """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS k, min(CASE WHEN l_suppkey <= 3 THEN 'depot' ELSE 'store' END) <> max(CASE WHEN l_suppkey <= 3 THEN 'depot' ELSE 'store' END) AS mixed FROM lineitem GROUP BY 1)
SELECT 'line_id' AS "column", 'channel' AS dimension, count(*) AS ids, count(*) FILTER (WHERE mixed) AS split FROM c""")
def _(spark, folder):
    # A line's identifier repeats a few times only, as an event's does.
    df = table(spark, folder, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), F.when(F.col("l_suppkey") <= 3, "depot").otherwise("store").alias("channel"))
    return caveats.split_identifiers(df, gather(df))


@query("caveat_future", "SELECT 'future' AS kind, 'o_orderdate' AS \"column\", count(*) AS rows FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '2000-12-31'")
def _(spark, folder):
    df = table(spark, folder, "orders")
    return caveats.future_dates(df, gather(df), F.lit("2000-12-31").cast("date"))


_ORDERED = "SELECT o_orderdate AS ordered, o_orderdate + INTERVAL 3 DAY - CASE WHEN o_totalprice > 497000 THEN INTERVAL 9 DAY ELSE INTERVAL 0 DAY END AS shipped FROM orders"


@query("caveat_date_order", f"WITH o AS ({_ORDERED}) SELECT 'shipped' AS late, 'ordered' AS early, count(*) AS rows FROM o WHERE shipped < ordered")
def _(spark, folder):
    df = table(spark, folder, "orders").selectExpr(
        "o_orderdate AS ordered", "o_orderdate + INTERVAL 3 DAY - CASE WHEN o_totalprice > 497000 THEN INTERVAL 9 DAY ELSE INTERVAL 0 DAY END AS shipped")
    return caveats.date_order(df, gather(df))


def _gapped(spark, folder, late: float):
    """Returned lines have a reason and a day; `late` gives a few others one as well."""
    lines = table(spark, folder, "lineitem")
    back = (F.col("l_returnflag") == "R") | (F.col("l_extendedprice") > late)
    return lines.select("l_orderkey", F.col("l_returnflag").alias("flag"), F.when(back, F.col("l_linestatus")).alias("reason"),
                        F.when(back, F.col("l_shipdate")).alias("back_on"), F.when(F.col("l_linestatus") != "O", F.col("l_suppkey")).alias("closed_by"), F.col("l_linestatus").alias("state"))


@query("blank_explained", """SELECT 'closed_by' AS columns, count(*) FILTER (WHERE l_linestatus = 'O') AS rows, 'state = ''O''' AS explained_by, CAST(NULL AS VARCHAR) AS near, CAST(NULL AS BIGINT) AS extra FROM lineitem
UNION ALL SELECT 'reason | back_on', count(*) FILTER (WHERE l_returnflag <> 'R'), '', NULL, NULL FROM lineitem""")
def _(spark, folder):
    df = _gapped(spark, folder, 1e12)
    return caveats.blank_rows(df, caveats.blanks(df, gather(df)))


@query("caveat_near_miss", """SELECT 'owner' AS columns, count(*) FILTER (WHERE l_linestatus = 'O' AND l_extendedprice <= 104000) AS rows, '' AS explained_by, 'state = ''O''' AS near,
count(*) FILTER (WHERE l_linestatus = 'O' AND l_extendedprice > 104000) AS extra FROM lineitem""")
def _(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_linestatus").alias("state"),
        F.when((F.col("l_linestatus") != "O") | (F.col("l_extendedprice") > 104000), F.col("l_suppkey")).alias("owner"))
    return caveats.blank_rows(df, caveats.blanks(df, gather(df)))


@query("measured_caveats", DIRTY_SQL + """SELECT 'placeholder' AS kind, 'segment' AS subject, 'Unknown' AS detail, count(*) FILTER (WHERE segment = 'Unknown') AS rows FROM d
UNION ALL SELECT 'placeholder', 'units', 'n/a', count(*) FILTER (WHERE units = 'n/a') FROM d
UNION ALL SELECT 'text_dates', 'mixed_day', CAST(count(*) FILTER (WHERE regexp_full_match(mixed_day, '\\d{4}-\\d{2}-\\d{2}')) AS VARCHAR), count(*) FILTER (WHERE NOT regexp_full_match(mixed_day, '\\d{4}-\\d{2}-\\d{2}')) FROM d
UNION ALL SELECT 'spellings', 'priority', CAST(count(DISTINCT lower(priority)) AS VARCHAR), count(*) FROM d
UNION ALL SELECT 'spellings', 'status', CAST(count(DISTINCT trim(status)) AS VARCHAR), count(*) FROM d
UNION ALL SELECT 'subtotal', 'segment', 'Total', count(*) FILTER (WHERE segment = 'Total') FROM d
UNION ALL SELECT 'blank', 'units', '', count(*) FILTER (WHERE units = '') FROM d""")
def _(spark, folder):
    return caveats.measured_caveats(dirty(spark, folder)).drop("position")


@query("caveat_claims", """WITH c AS (SELECT (SELECT count(*) FROM orders WHERE o_totalprice > 400000) AS big, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS f)
SELECT 'o_totalprice > 400000 in 2,911 rows' AS caveat, 'comparison' AS shape, CASE WHEN big = 2911 THEN 'agrees' ELSE 'differs' END AS status, 2911 AS claimed, big AS measured FROM c
UNION ALL SELECT 'o_orderstatus is ''F'' in 7 rows', 'quoted', CASE WHEN f = 7 THEN 'agrees' ELSE 'differs' END, 7, f FROM c
UNION ALL SELECT '0 duplicate rows', 'duplicates', 'agrees', 0, 0 UNION ALL SELECT 'o_custkey is blank in 0 rows', 'blank', 'agrees', 0, 0
UNION ALL SELECT 'prices include tax', 'unchecked', 'unchecked', NULL, NULL""")
def _(spark, folder):
    return claims.check_caveats(table(spark, folder, "orders"), [
        "o_totalprice > 400000 in 2,911 rows", "o_orderstatus is 'F' in 7 rows", "0 duplicate rows", "o_custkey is blank in 0 rows", "prices include tax"])


@query("provisional_metric", """SELECT 'over_taxed' AS name, count(*) AS judged, count(*) FILTER (WHERE l_tax > l_discount) AS true_rows, 'approved' AS status FROM lineitem
UNION ALL SELECT 'at_cost', count(*), count(*) FILTER (WHERE l_quantity = l_tax), 'rejected' FROM lineitem""")
def _(spark, folder):
    from datetime import datetime
    space = Workspace(spark, shared_folder(spark, "space"))
    space.register("lines", table(spark, folder, "lineitem"))
    for i, (name, left, op, right, yes) in enumerate((("over_taxed", "l_tax", ">", "l_discount", True), ("at_cost", "l_quantity", "=", "l_tax", False))):
        claims.propose_metric(space, "lines", name, left, op, right, "a comparison of two columns", at=datetime(2024, 1, 1, i))
        claims.decide_metric(space, "lines", name, yes, at=datetime(2024, 1, 2, i))
    return claims.metrics(space).select("name", "judged", "true_rows", "status")
