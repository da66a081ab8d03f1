"""Loading: orders written as delimited files, then read back with every change counted."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainwise.plans.base import DIRTY_SQL, dirty, query, r6, table
from grainwise.session import shared_folder
from grainwise.sources import delimited, landed, names, results
from grainwise.store import Workspace


def _written(spark, df) -> str:
    path = shared_folder(spark, "landed")
    df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


_PINS = {"units": "bigint", "price_text": "decimal(18,2)", "iso_day": "date", "large": "boolean"}


@query("load_csv_typed", DIRTY_SQL + f"""SELECT count(*) AS rows, {r6("sum(TRY_CAST(price_text AS DECIMAL(18,2)))", 'price')}, sum(TRY_CAST(units AS BIGINT)) AS units,
count(*) FILTER (WHERE units = '' OR units = 'n/a') AS no_units, strftime(min(CAST(iso_day AS DATE)), '%Y-%m-%d') AS first_day,
count(*) FILTER (WHERE large = 'true') AS large, count(DISTINCT account) AS accounts FROM d""")
def _(spark, folder):
    path = _written(spark, dirty(spark, folder).select("account", "units", "price_text", "iso_day", "large", "status"))
    df = delimited.load(spark, path, types=_PINS, na_values=("n/a", ""), on_error="null")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum("price_text").alias("price"), F.sum("units").alias("units"),
                  F.count_if(F.col("units").isNull()).alias("no_units"), F.min("iso_day").alias("first_day"),
                  F.count_if("large").alias("large"), F.count_distinct("account").alias("accounts"))


@query("coercion_counts", DIRTY_SQL + """SELECT 'units' AS "column", 'bigint' AS to_type, count(*) FILTER (WHERE units <> '') AS present, count(*) FILTER (WHERE units = 'n/a') AS failed FROM d
UNION ALL SELECT 'price_text', 'decimal(18,2)', count(price_text), count(*) FILTER (WHERE price_text = 'not priced') FROM d
UNION ALL SELECT 'iso_day', 'date', count(iso_day), 0 FROM d UNION ALL SELECT 'large', 'boolean', count(large), 0 FROM d""")
def _(spark, folder):
    path = _written(spark, dirty(spark, folder).select("units", "price_text", "iso_day", "large"))
    return delimited.coercion_counts(delimited.read_text(spark, path), _PINS)


@query("null_token_counts", DIRTY_SQL + """SELECT 'units' AS "column", units AS token, count(*) AS rows FROM d WHERE units = 'n/a' GROUP BY 2
UNION ALL SELECT 'price_text', price_text, count(*) FROM d WHERE price_text = 'not priced' GROUP BY 2""")
def _(spark, folder):
    path = _written(spark, dirty(spark, folder).select("units", "price_text", "iso_day"))
    return delimited.null_token_counts(delimited.read_text(spark, path), ("n/a", "not priced", "-", "N/A"))


# One landed file per priority: a title and a blank line over a header, the orders, and two lines of notes.
def _landed(spark, folder) -> str:
    path = shared_folder(spark, "landed")
    rows = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("part"), F.lit(5).alias("at"), F.col("o_orderkey").alias("n"),
        F.concat_ws(",", "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderdate").cast("date")).alias("line"))
    parts = rows.select("part").distinct()

    def fixed(at, text):
        return parts.select("part", F.lit(at).alias("at"), F.lit(0).cast("long").alias("n"), text.alias("line"))

    lines = (rows.unionByName(fixed(1, F.concat(F.lit("Export of "), F.col("part"), F.lit(",,,")))).unionByName(fixed(2, F.lit(",,,")))
             .unionByName(fixed(3, F.lit("key,status,value,day")))
             .unionByName(fixed(8, F.lit("Total,,12345.00,"))).unionByName(fixed(9, F.lit("Source: ledger,,,"))))
    (lines.repartition("part").sortWithinPartitions("part", "at", "n").select("part", F.col("line").alias("value"))
     .write.partitionBy("part").text(path))
    return path


@query("header_guess", """SELECT o_orderpriority AS part, '3' AS header_lines, 4 AS data_start, 'high' AS confidence FROM orders GROUP BY 1""")
def _(spark, folder):
    found = landed.header_lines(spark, _landed(spark, folder))
    part = F.url_decode(F.regexp_extract("file", "part=([^/]+)", 1))
    return found.select(part.alias("part"), "header_lines", "data_start", "confidence")


@query("footer_detect", """SELECT o_orderpriority AS part, count(*) + 5 AS lines, 2 AS footer_lines FROM orders GROUP BY 1""")
def _(spark, folder):
    found = landed.footer_lines(spark, _landed(spark, folder))
    return found.select(F.url_decode(F.regexp_extract("file", "part=([^/]+)", 1)).alias("part"), "lines", "footer_lines")


# Files of three and of seventy columns in one folder, one with a preamble longer than any preview.
def _mixed(spark, folder) -> str:
    path = shared_folder(spark, "landed")
    body = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("part"), F.lit(3).alias("at"), F.col("o_orderkey").cast("long").alias("n"), "o_orderstatus")
    parts = body.select("part").distinct()
    many = F.col("part") == "1-URGENT"

    def fixed(at, n=1):
        return parts.select("part", F.lit(at).alias("at"), F.explode(F.sequence(F.lit(1).cast("long"), (F.lit(n) if isinstance(n, int) else n).cast("long"))).alias("n"), F.lit(None).cast("string").alias("o_orderstatus"))

    key = F.col("n").cast("string")
    cell = F.when(many, F.concat_ws(",", key, "o_orderstatus", F.lit(",".join(["x"] * 67)), F.lit("1"))).otherwise(F.concat_ws(",", key, "o_orderstatus", F.lit("1")))
    header = F.when(many, F.lit("key,status," + ",".join(f"c{i}" for i in range(67)).translate(str.maketrans("0123456789", "abcdefghij")) + ",last")).otherwise(F.lit("key,status,last"))
    # A total that misses only the last column: a footer by the columns its own file always fills.
    total = F.when(many, F.lit("Total," + ",".join(["x"] * 68) + ",")).otherwise(F.lit("Total,x,"))
    places = body.unionByName(fixed(1, F.when(many, F.lit(80)).otherwise(F.lit(1)))).unionByName(fixed(2).withColumn("n", F.lit(0).cast("long"))).unionByName(fixed(2)).unionByName(fixed(8))
    at = F.col("at")
    line = F.when(at == 1, "A note about this file").when((at == 2) & (F.col("n") == 0), "").when(at == 2, header).when(at == 3, cell).otherwise(total)
    # One task writes a file, so it sorts places, and each line is made when it is written.
    places.repartition("part").sortWithinPartitions("part", "at", "n").select("part", line.alias("value")).write.partitionBy("part").text(path)
    return path


@query("header_below_long_preamble", """SELECT o_orderpriority AS part, CASE WHEN o_orderpriority = '1-URGENT' THEN '82' ELSE '3' END AS header_lines,
CASE WHEN o_orderpriority = '1-URGENT' THEN 83 ELSE 4 END AS data_start, 'high' AS confidence FROM orders GROUP BY 1""")
def _(spark, folder):
    found = landed.header_lines(spark, _mixed(spark, folder))
    return found.select(F.url_decode(F.regexp_extract("file", "part=([^/]+)", 1)).alias("part"), "header_lines", "data_start", "confidence")


@query("footer_detect_mixed", """SELECT o_orderpriority AS part, count(*) + CASE WHEN o_orderpriority = '1-URGENT' THEN 83 ELSE 4 END AS lines, 1 AS footer_lines FROM orders GROUP BY 1""")
def _(spark, folder):
    found = landed.footer_lines(spark, _mixed(spark, folder))
    return found.select(F.url_decode(F.regexp_extract("file", "part=([^/]+)", 1)).alias("part"), "lines", "footer_lines")


@query("footer_skip", f"""SELECT o_orderpriority AS part, count(*) + 3 AS rows, {r6('sum(CAST(o_totalprice AS DECIMAL(18,2)))', 'value')} FROM orders GROUP BY 1""")
def _(spark, folder):
    from pyspark.sql import types as T
    path = _landed(spark, folder)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("key", "status", "value", "day", "part")])
    read = spark.read.schema(schema).csv(path)
    kept = delimited.skip_footer(read, 2)
    return kept.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("value").try_cast("decimal(18,2)")).alias("value"))


@query("ragged_rows", "SELECT count(*) AS rows, count(*) FILTER (WHERE o_totalprice < 100000) AS short, count(*) FILTER (WHERE o_totalprice > 400000) AS long FROM orders")
def _(spark, folder):
    path = shared_folder(spark, "landed")
    o = table(spark, folder, "orders")
    line = (F.when(F.col("o_totalprice") < 100000, F.concat_ws(",", "o_orderkey", "o_orderstatus"))
            .when(F.col("o_totalprice") > 400000, F.concat_ws(",", "o_orderkey", "o_orderstatus", F.lit('"a,b"'), F.lit("more")))
            .otherwise(F.concat_ws(",", "o_orderkey", "o_orderstatus", "o_orderpriority")))
    o.select(line.alias("value")).write.text(path)
    return landed.ragged_rows(spark, path, 3)


_RAGGED = ("CASE WHEN o_totalprice < 60000 THEN 'short' WHEN o_totalprice > 400000 THEN 'long' WHEN o_totalprice > 300000 THEN 'broken' ELSE 'plain' END")


def _overflowing(spark, folder) -> str:
    """Records of three columns: some one cell short, some with two cells more, some with a line break inside quotes."""
    path = shared_folder(spark, "landed")
    kind, key = F.expr(_RAGGED), F.col("o_orderkey").cast("string")
    line = (F.when(kind == "short", F.concat_ws(",", key, F.lit("s")))
            .when(kind == "long", F.concat_ws(",", key, F.lit("l"), F.lit('"a, b"'), F.lit(""), F.lit('"x""y"')))
            .when(kind == "broken", F.concat(key, F.lit(',b,"first\nsecond, half"'))).otherwise(F.concat_ws(",", key, F.lit("p"), "o_orderpriority")))
    table(spark, folder, "orders").select(line.alias("value")).write.text(path)
    return path


@query("load_overflow", f"""WITH k AS (SELECT {_RAGGED} AS kind, o_orderkey FROM orders)
SELECT kind, count(*) AS rows, sum(o_orderkey) AS keys, CASE kind WHEN 'long' THEN 'a, b' WHEN 'broken' THEN 'first' || chr(10) || 'second, half' END AS note,
CASE kind WHEN 'long' THEN ' | x"y' ELSE '' END AS overflow, CASE kind WHEN 'short' THEN 1 ELSE 0 END AS missing FROM k GROUP BY kind""")
def _(spark, folder):
    df = delimited.read_records(spark, _overflowing(spark, folder), ["key", "kind", "note"], header=False)
    kind = F.create_map(*[F.lit(x) for x in ("s", "short", "l", "long", "b", "broken", "p", "plain")])[F.col("kind")]
    note = F.when(kind != "plain", F.col("note"))
    return df.groupBy(kind.alias("kind"), note.alias("note"), "overflow", "missing").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("key").cast("bigint")).alias("keys"))


@query("ragged_rows_quoted", f"""SELECT count(*) AS rows, count(*) FILTER (WHERE kind = 'short') AS short, count(*) FILTER (WHERE kind = 'long') AS long,
2 * count(*) FILTER (WHERE kind = 'long') AS overflow_cells FROM (SELECT {_RAGGED} AS kind FROM orders)""")
def _(spark, folder):
    return delimited.record_counts(delimited.read_records(spark, _overflowing(spark, folder), ["key", "kind", "note"], header=False))


@query("two_digit_years", DIRTY_SQL + """SELECT 'short_day' AS "column", count(*) AS rows FROM d""")
def _(spark, folder):
    return delimited.two_digit_years(dirty(spark, folder))


@query("huge_integers", """WITH h AS (SELECT CAST(9007199254740993 + o_orderkey AS HUGEINT) AS k FROM orders)
SELECT 'big' AS "column", count(*) AS rows, CAST(sum(k - 9007199254740993) AS BIGINT) AS kept FROM h""")
def _(spark, folder):
    df = table(spark, folder, "orders").select((F.lit(9007199254740993) + F.col("o_orderkey")).cast("string").alias("big"), F.col("o_custkey").cast("string").alias("small"))
    found = delimited.huge_integers(df)
    exact = delimited.exact_integers(df, ["big"]).agg(F.sum(F.col("big") - F.lit(9007199254740993)).cast("bigint").alias("kept"))
    return found.withColumn("kept", exact.scalar())


@query("trailing_empty_columns", "SELECT 'column_3, column_4' AS dropped, count(*) AS rows FROM orders")
def _(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", F.lit(None).cast("string").alias("column_3"), F.lit(None).cast("string").alias("column_4"))
    gone = delimited.trailing_empty_columns(df)
    return df.drop(*gone).agg(F.lit(", ".join(gone)).alias("dropped"), F.count(F.lit(1)).alias("rows"))


@query("normalised_names", """SELECT 'order_key, col_2024_amt, pct_of_total, column_4, order_key_2' AS names, count(*) AS rows FROM orders""")
def _(spark, folder):
    header = names.target_names(names.assemble_names([["Order Key", "2024 Amt", "% of total", "", "Order Key"]]))
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority").toDF(*header)
    return df.agg(F.lit(", ".join(df.columns)).alias("names"), F.count(header[0]).alias("rows"))


@query("pivot_dump_unpivot", f"""SELECT o_orderpriority AS priority, CAST(year(o_orderdate) AS VARCHAR) AS period, {r6('sum(CAST(o_totalprice AS DECIMAL(18,2)))', 'value')}
FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999 GROUP BY 1, 2""")
def _(spark, folder):
    years = ("1996", "1997", "1998", "1999")
    o = table(spark, folder, "orders")
    wide = o.groupBy(F.col("o_orderpriority").alias("priority")).agg(*[
        F.sum(F.when(F.year("o_orderdate") == int(y), F.col("o_totalprice").cast("decimal(18,2)"))).alias(y) for y in years])
    found = names.period_columns(wide.columns)
    return wide.unpivot(["priority"], [f"`{c}`" for c in found], "period", "value")


@query("narrowed_load", """SELECT count(*) AS rows, 'subset: ' || count(*) || ' of ' || (SELECT count(*) FROM orders) || ' rows (where o_orderstatus = ''F'')' AS note
FROM orders WHERE o_orderstatus = 'F'""")
def _(spark, folder):
    space = Workspace(spark, shared_folder(spark, "space"))
    space.narrowed_load("finished", table(spark, folder, "orders"), where="o_orderstatus = 'F'")
    return space.read("finished").agg(F.count(F.lit(1)).alias("rows"), F.lit(space.subset_note("finished")).alias("note"))


@query("utc_timestamps", """SELECT count(*) AS rows, strftime(min(ts - INTERVAL 330 MINUTE), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts - INTERVAL 330 MINUTE), '%Y-%m-%d %H:%M:%S') AS last FROM events""")
def _(spark, folder):
    zoned = table(spark, folder, "events").select(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")).alias("at"))
    utc = delimited.to_utc(zoned, ["at"])
    return utc.agg(F.count("at").alias("rows"), F.date_format(F.min("at"), "yyyy-MM-dd HH:mm:ss").alias("first"),
                   F.date_format(F.max("at"), "yyyy-MM-dd HH:mm:ss").alias("last"))


@query("dataset_registry", """SELECT 'customers' AS name, 2 AS version, count(*) AS row_count FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT 'orders', 1, count(*) FROM orders""")
def _(spark, folder):
    space = Workspace(spark, shared_folder(spark, "space"))
    space.register("orders", table(spark, folder, "orders"))
    space.register("customers", table(spark, folder, "customer"))
    space.register("customers", table(spark, folder, "customer").where("c_acctbal >= 0"))
    space.register("gone", table(spark, folder, "nation"))
    space.unregister("gone")
    return space.datasets().select("name", "version", "row_count")


def _describe(t: str, columns) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls, {r6(f'(count(*) - count({c})) * 1.0 / count(*)', 'null_share')}, count(DISTINCT {c}) AS "distinct" FROM {t}""" for c in columns)


@query("describe_dataset", _describe("conversations", ("conv_id", "turn", "role", "text")))
def _(spark, folder):
    return results.describe_dataset(table(spark, folder, "conversations")).drop("dtype")


@query("describe_pages", _describe("pages", ("page_id", "url", "html")))
def _(spark, folder):
    return results.describe_dataset(table(spark, folder, "pages")).drop("dtype")


@query("describe_embeddings", _describe("embeddings", ("vec_id", "embedding", '"label"')).replace("""'"label"'""", "'label'"))
def _(spark, folder):
    return results.describe_dataset(table(spark, folder, "embeddings")).drop("dtype")


@query("result_page", f"""WITH g AS (SELECT o_custkey AS member, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY 1),
k AS (SELECT row_number() OVER (ORDER BY total DESC, member) AS position, * FROM g) SELECT position, member, {r6('total', 'total')} FROM k WHERE position BETWEEN 101 AND 125""")
def _(spark, folder):
    path = shared_folder(spark, "results")
    totals = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("member")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    results.write_result(totals, path, [("total", True), ("member", False)])
    return results.read_page(spark, path, start=101, limit=25)
