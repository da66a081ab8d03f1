"""Delimited files as text first, typed second, so that everything a load changes can be counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.contract import is_date
from grainwise.errors import ParamsInvalid
from grainwise.functions import readings
from grainwise.functions.exprs import count_where, matches, quoted
from grainwise.profiling.table import fused
from grainwise.session import cut
from grainwise.sources.names import assemble_names, target_names

#: Whole numbers past this are not exact as doubles.
EXACT_DOUBLE = 2.0 ** 53


def read_text(spark: SparkSession, path: str, names: list[str] | None = None, delimiter: str = ",", header: bool = True,
              encoding: str = "UTF-8", width: int | None = None) -> DataFrame:
    """Every column as text. Short rows are padded with NULL; long ones keep what fits (`read_records` keeps the rest).

    The schema is built from the first line or from `names`, so nothing is inferred by a scan.
    """
    reader = spark.read.option("sep", delimiter).option("encoding", encoding).option("mode", "PERMISSIVE")
    if names is None:
        first = spark.read.option("sep", delimiter).option("encoding", encoding).csv(path).first()
        if first is None:
            raise ParamsInvalid(f"{path} holds no line")
        given = [first[i] for i in range(len(first))]
        names = target_names(assemble_names([given])) if header else [f"column_{i + 1}" for i in range(len(given))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return reader.option("header", header).option("enforceSchema", True).schema(schema).csv(path)


def read_records(spark: SparkSession, path: str, names: list[str] | None = None, delimiter: str = ",", header: bool = True,
                 encoding: str = "UTF-8", multiline: bool = True) -> DataFrame:
    """`read_text` with two columns more: `overflow`, the cells past the last column, and `missing`, how many cells a record is short.

    Quotes are doubled inside quotes. `multiline` keeps a quoted line break inside its record; a file is one task then, so turn it off for huge files without such
    breaks. The reader hands over the whole text of a record that does not fit, and only those are parsed again, to the width of
    the widest. The records are written once, as the reader keeps no such text for a later, narrower read.
    """
    plain = read_text(spark, path, names, delimiter, header, encoding)
    raw = "__record"
    fields = [*plain.schema.fields, T.StructField(raw, T.StringType())]
    reader = (spark.read.option("sep", delimiter).option("encoding", encoding).option("mode", "PERMISSIVE").option("header", header)
              .option("escape", '"').option("enforceSchema", True).option("multiLine", multiline).option("columnPruning", False).option("columnNameOfCorruptRecord", raw))
    records = cut(reader.schema(T.StructType(fields)).csv(path))
    width, text = len(plain.columns), F.col(raw)
    # A record has as many cells as separators outside its quotes, and one.
    bare = F.regexp_replace(text, '"[^"]*+"', "")
    cells = (F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit("")))) / len(delimiter) + 1
    records = records.withColumn("__cells", cells.cast("int"))
    widest = records.agg(F.max("__cells")).first()[0]
    none = F.array().cast("array<string>")
    if widest is None:
        return records.select(*[quoted(c) for c in plain.columns], none.alias("overflow"), F.lit(0).alias("missing"))
    schema = ", ".join(f"c{i} string" for i in range(max(widest, width)))
    again = F.from_csv(F.rtrim(text), F.lit(schema), {"sep": delimiter, "escape": '"', "mode": "PERMISSIVE"})
    past = F.array(*[F.coalesce(again.getField(f"c{i}"), F.lit("")) for i in range(width, widest)]) if widest > width else none
    n = F.col("__cells")
    return records.select(*[quoted(c) for c in plain.columns], F.when(n > width, F.slice(past, 1, n - width)).otherwise(none).alias("overflow"),
                          F.greatest(width - F.coalesce(n, F.lit(width)), F.lit(0)).alias("missing"))


def record_counts(records: DataFrame) -> DataFrame:
    """rows, short, long, overflow_cells of what `read_records` gives."""
    return records.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("missing") > 0).alias("short"), F.count_if(F.size("overflow") > 0).alias("long"),
                       F.coalesce(F.sum(F.size("overflow")), F.lit(0)).alias("overflow_cells"))


def tokens_to_null(df: DataFrame, tokens) -> DataFrame:
    """The listed texts as NULL, exactly as written."""
    return df.select(*[F.when(~F.coalesce(F.col(quoted(c)).isin(list(tokens)), F.lit(False)), F.col(quoted(c))).alias(c)
                       for c in df.columns])


def null_token_counts(df: DataFrame, tokens) -> DataFrame:
    """column, token, rows: how many values each token turns to NULL, in one aggregate."""
    cells = [(c, t) for c in df.columns for t in tokens]
    one = df.agg(*[count_where(F.col(quoted(c)) == t).alias(f"n{i}") for i, (c, t) in enumerate(cells)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("token"), F.col(f"n{i}").alias("rows")) for i, (c, t) in enumerate(cells)]
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.*").where("rows > 0")


def typed(c: Column, kind: str) -> Column:
    """A text as a type, NULL where it cannot be read."""
    k = kind.lower()
    if k in ("bigint", "long", "int", "integer"):
        value = readings.whole_number(c)
        return value if k in ("bigint", "long") else value.try_cast("int")
    if k in ("double", "float"):
        return readings.number(c)
    if k.startswith("decimal"):
        return F.when(matches(F.trim(c), readings.NUMBER_SHAPE), F.trim(c).try_cast(k))
    if k == "date":
        return readings.moment(c).cast("date")
    if k == "timestamp":
        return readings.moment(c)
    if k == "boolean":
        return readings.truth(F.trim(c))
    if k == "string":
        return c
    raise ParamsInvalid(f"{kind} is not a type a text can be read as")


def coerce(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Pinned columns as their types; a cell that cannot be read becomes NULL and its row stays."""
    unknown = [c for c in types if c not in df.columns]
    if unknown:
        raise ParamsInvalid(f"no column is called {', '.join(unknown)}")
    return df.select(*[(typed(F.col(quoted(c)), types[c]) if c in types else F.col(quoted(c))).alias(c) for c in df.columns])


def coercion_counts(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """column, to_type, present, failed: cells each pin turns to NULL."""
    out = fused(df, list(types), {
        "present": lambda c: F.count(quoted(c)),
        "failed": lambda c: F.count_if(F.col(quoted(c)).isNotNull() & typed(F.col(quoted(c)), types[c]).isNull())})
    kinds = F.create_map(*[x for c, k in types.items() for x in (F.lit(c), F.lit(k))])
    return out.withColumn("to_type", kinds[F.col("column")])


def load(spark: SparkSession, path: str, *, names: list[str] | None = None, types: dict[str, str] | None = None,
         na_values=(), delimiter: str = ",", header: bool = True, encoding: str = "UTF-8", footer_rows: int = 0,
         on_error: str = "fail") -> DataFrame:
    """Text to table: footers cut, tokens to NULL, pins applied.

    `on_error='fail'` refuses a load that any pinned cell would fail; `'null'` keeps the row.
    """
    if on_error not in ("fail", "null"):
        raise ParamsInvalid("on_error is 'fail' or 'null'")
    df = read_text(spark, path, names, delimiter, header, encoding)
    if footer_rows:
        df = skip_footer(df, footer_rows)
    if na_values:
        df = tokens_to_null(df, na_values)
    if not types:
        return df
    if on_error == "fail":
        bad = [r for r in coercion_counts(df, types).collect() if r["failed"]]
        if bad:
            raise ParamsInvalid("; ".join(f"{r['failed']} value(s) of {r['column']} are not {r['to_type']}" for r in bad))
    return coerce(df, types)


def in_file_order(df: DataFrame) -> DataFrame:
    """Add the file, block and row a line was read from. Rows of one block have rising numbers."""
    return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
                     F.monotonically_increasing_id().alias("__row"))


def skip_footer(df: DataFrame, rows: int) -> DataFrame:
    """Drop the last `rows` rows of each file, found by file order.

    Only the last few rows of each file are gathered (a per-partition limit runs before the shuffle);
    they reach the filter as a small set of row numbers.
    """
    from pyspark.sql import Window
    placed = in_file_order(df)
    order = Window.partitionBy("__file").orderBy(F.col("__block").desc(), F.col("__row").desc())
    last = placed.select("__file", "__block", "__row").withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= rows)
    tail = last.select(F.col("__file").alias("f"), F.col("__row").alias("r"))
    same = (F.col("__file") == F.col("f")) & (F.col("__row") == F.col("r"))
    return placed.join(tail, same, "left_anti").drop("__file", "__block", "__row")


def two_digit_years(df: DataFrame) -> DataFrame:
    """column, rows: text columns whose dates have two-digit years; they stay text."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return fused(df, texts, {"rows": lambda c: count_where(matches(F.trim(F.col(quoted(c))), readings.TWO_DIGIT_YEAR))}).where("rows > 0")


def huge_integers(df: DataFrame) -> DataFrame:
    """column, rows: text columns of whole numbers some of which a double would round."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    digits = lambda c: matches(F.trim(F.col(quoted(c))), r"[+-]?\d{1,38}")
    return fused(df, texts, {
        "whole": lambda c: count_where(digits(c)), "present": lambda c: F.count(quoted(c)),
        "rows": lambda c: count_where(digits(c) & (F.abs(readings.number(F.col(quoted(c)))) >= EXACT_DOUBLE)),
    }).where("rows > 0 AND whole = present").select("column", "rows")


def exact_integers(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns as DECIMAL(38,0), which holds them exactly."""
    return df.select(*[(F.trim(F.col(quoted(c))).try_cast("decimal(38,0)") if c in columns else F.col(quoted(c))).alias(c) for c in df.columns])


def trailing_empty_columns(df: DataFrame) -> list[str]:
    """Unnamed columns at the end that hold nothing: what a trailing separator leaves behind."""
    unnamed = [c for c in df.columns if c.startswith(("_c", "column_", "unnamed"))]
    if not unnamed:
        return []
    held = df.agg(*[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(unnamed)]).first()
    empty = {c for i, c in enumerate(unnamed) if not held[i]}
    out = []
    for c in reversed(df.columns):
        if c not in empty:
            break
        out.append(c)
    return list(reversed(out))


def to_utc(df: DataFrame, columns: list[str]) -> DataFrame:
    """Texts with an offset, or zoned timestamps, as UTC timestamps without a zone."""
    def utc(c: str) -> Column:
        v = F.col(quoted(c))
        at = v if is_date(df.schema[c].dataType) else F.trim(v).try_cast("timestamp")
        return F.convert_timezone(F.expr("current_timezone()"), F.lit("UTC"), at.cast("timestamp_ntz"))
    return df.select(*[(utc(c) if c in columns else F.col(quoted(c))).alias(c) for c in df.columns])
