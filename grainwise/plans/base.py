"""How a query and its SQL are registered, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.contract import DatasetContract, Domain, Measure, Rule, Window
from grainwise.functions.exprs import quoted
from grainwise.scope import ScopedFrame, scope_for


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query. Its result is brought to plain types so that two engines can agree."""
    def keep(function):
        if name in CATALOGUE:
            raise ValueError(f"{name} is registered twice")
        CATALOGUE[name] = Query(name, lambda spark, folder: plain(function(spark, folder)), sql)
        return function
    return keep


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, other numbers as double to six places, dates and lists as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, (T.DecimalType, T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DateType,)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), " | ")
        out.append(c.alias(f.name))
    return df.select(*out)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(expression: str, alias: str) -> str:
    """A SQL number as `plain` writes it."""
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0 AS {alias}"


# One list of expressions, readable by Spark and by the checking engine alike.
SALES = (
    "o_orderkey", "o_custkey", "o_orderpriority AS priority",
    "nullif(o_orderstatus, 'P') AS status", "o_orderstatus AS full_status",
    "CAST(o_totalprice AS DECIMAL(18,2)) AS gross",
    "CASE WHEN o_totalprice < 20000 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS price",
    "CASE WHEN o_totalprice > 480000 THEN NULL ELSE o_orderdate END AS odate",
    "o_totalprice > 250000 AS is_large",
)
LINES = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_linestatus",
    "nullif(l_returnflag, 'N') AS flag", "l_returnflag",
    "CAST(l_quantity AS DECIMAL(18,2)) AS qty",
    "CAST(l_extendedprice AS DECIMAL(18,2)) AS price",
    "CAST(l_discount AS DECIMAL(18,2)) AS discount", "CAST(l_tax AS DECIMAL(18,2)) AS tax",
)
EVENTS = ("event_id", "user_id", "event_type", "ts", "CAST(value AS DECIMAL(18,2)) AS value")

OUTAGE = "odate >= DATE '1997-03-01' AND odate < DATE '1997-04-01'"
UNSURE = "status = 'F' AND gross > 300000"

SALES_CONTRACT = DatasetContract(
    dataset="sales", grain="one order", key=("o_orderkey",), date_column="odate",
    window=Window(date(1996, 1, 1), date(2000, 6, 30)),
    measures=(
        Measure("price", "sum", "order value", "EUR"),
        Measure("price_avg", "mean", column="price"), Measure("price_mid", "median", column="price"),
        Measure("price_low", "min", column="price"), Measure("price_high", "max", column="price"),
        Measure("priced", "count", column="price"), Measure("buyers", "count_distinct", column="o_custkey"),
        Measure("large", "mean", column="is_large"), Measure("gross", "none"),
    ),
    dimensions=("status", "priority", "o_custkey", "full_status"),
    exclusions=(Rule(OUTAGE, "the feed was down"), Rule(UNSURE, "finished large orders are audited apart")),
    expectations=(Rule("price > 25000", "small orders are typing errors"),),
    domains=(Domain("priority", ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")),),
)
PLAIN_ORDERS = DatasetContract(
    dataset="orders", grain="one order", key=("o_orderkey",), date_column="o_orderdate",
    window=Window(date(1996, 1, 1), date(2000, 6, 30)),
    measures=(Measure("gross", "sum"),), dimensions=("o_orderpriority", "o_orderstatus", "o_custkey"),
)
LINES_CONTRACT = DatasetContract(
    dataset="lines", grain="one order line", date_column="l_shipdate",
    measures=(
        Measure("price", "sum"), Measure("qty", "sum"), Measure("discount", "mean"),
        Measure("unit_price", None, numerator=("price",), denominator=("qty",)),
        Measure("net_rate", None, numerator=("price", "-tax"), denominator=("price",), scale=100.0),
        Measure("taxed_more", "mean", compare=("tax", ">", "discount")),
    ),
    dimensions=("flag", "l_linestatus", "l_returnflag", "l_suppkey", "l_partkey"),
)
EVENTS_CONTRACT = DatasetContract(
    dataset="events", grain="one event", key=("event_id",), date_column="ts",
    measures=(Measure("value", "sum"), Measure("value_avg", "mean", column="value")),
    dimensions=("user_id", "event_type"),
)
DOCS_CONTRACT = DatasetContract(
    dataset="documents", grain="one document", key=("doc_id",),
    measures=(Measure("n_chars", "sum"),), dimensions=("lang", "source"),
)


def sales(spark, folder) -> ScopedFrame:
    return scope_for(table(spark, folder, "orders").selectExpr(*SALES), SALES_CONTRACT)


def orders(spark, folder) -> ScopedFrame:
    read = table(spark, folder, "orders").selectExpr("*", "CAST(o_totalprice AS DECIMAL(18,2)) AS gross")
    return scope_for(read, PLAIN_ORDERS)


def lines(spark, folder) -> ScopedFrame:
    return scope_for(table(spark, folder, "lineitem").selectExpr(*LINES), LINES_CONTRACT)


def events(spark, folder) -> ScopedFrame:
    return scope_for(table(spark, folder, "events").selectExpr(*EVENTS), EVENTS_CONTRACT)


def documents(spark, folder) -> ScopedFrame:
    return scope_for(table(spark, folder, "documents"), DOCS_CONTRACT)


# The same scopes as SQL: `src` is every row, `s` the analysed ones.
WINDOW_SQL = "odate >= DATE '1996-01-01' AND odate < DATE '2000-07-01'"
SALES_SQL = f"""WITH src AS (SELECT {', '.join(SALES)} FROM orders),
s AS (SELECT * FROM src WHERE NOT coalesce({OUTAGE}, false) AND NOT coalesce({UNSURE}, false) AND {WINDOW_SQL})
"""
ORDERS_SQL = """WITH s AS (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS gross FROM orders
WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '2000-07-01')
"""
LINES_SQL = f"WITH s AS (SELECT {', '.join(LINES)} FROM lineitem)\n"
EVENTS_SQL = f"WITH s AS (SELECT {', '.join(EVENTS)} FROM events)\n"
DOCS_SQL = "WITH s AS (SELECT * FROM documents)\n"

_ISO = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_EU = ("lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') "
       "|| '/' || CAST(year(o_orderdate) AS STRING)")
_EU_SHORT = ("lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '.' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') "
             "|| '.' || lpad(CAST(year(o_orderdate) % 100 AS STRING), 2, '0')")
_MONEY = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"
# Orders as an export might write them: text for everything, with the usual damage.
DIRTY = (
    "o_orderkey",
    "lpad(CAST(o_custkey AS STRING), 8, '0') AS account",
    f"'$' || {_MONEY} AS amount",
    "CASE WHEN o_totalprice < 12000 THEN 'n/a' WHEN o_totalprice < 14000 THEN '' ELSE CAST(o_custkey AS STRING) END AS units",
    f"CASE WHEN o_totalprice > 490000 THEN 'not priced' ELSE {_MONEY} END AS price_text",
    f"{_ISO} AS iso_day",
    f"{_EU} AS eu_day",
    f"CASE WHEN o_totalprice > 450000 THEN {_EU} ELSE {_ISO} END AS mixed_day",
    f"{_EU_SHORT} AS short_day",
    "CASE WHEN o_orderstatus = 'P' AND o_totalprice < 250000 THEN lower(o_orderpriority) ELSE o_orderpriority END AS priority",
    "CASE WHEN o_totalprice > 400000 THEN '  ' || o_orderstatus ELSE o_orderstatus END AS status",
    "CASE WHEN o_totalprice > 250000 THEN 'true' ELSE 'false' END AS large",
    "CASE WHEN o_totalprice > 470000 THEN 'Unknown' WHEN o_totalprice < 16000 THEN 'Total' ELSE o_orderpriority END AS segment",
    "CAST(o_custkey % 100 AS STRING) || '%' AS rate",
    f"replace({_MONEY}, '.', ',') AS eu_amount",
    "CASE WHEN o_totalprice < 100000 THEN '(' || CAST(o_custkey AS STRING) || '.50)' ELSE CAST(o_custkey AS STRING) || '.25' END AS ledger",
    "CASE WHEN o_totalprice > 495000 THEN CAST('Infinity' AS DOUBLE) WHEN o_totalprice > 490000 THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice / 1000 END AS reading",
)
DIRTY_SQL = f"WITH d AS (SELECT {', '.join(DIRTY)} FROM orders)\n"
DIRTY_TEXT = ("account", "amount", "units", "price_text", "iso_day", "eu_day", "mixed_day", "short_day", "priority",
              "status", "large", "segment", "rate", "eu_amount", "ledger")


def dirty(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(*DIRTY)


# Every order again when it is small: a union that repeats whole rows.
REPEATED_SQL = "WITH d AS (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_totalprice < 50000)\n"


def repeated(spark, folder) -> DataFrame:
    read = table(spark, folder, "orders")
    return read.unionAll(read.where("o_totalprice < 50000"))
