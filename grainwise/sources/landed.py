"""Where the data of landed files begins and ends, for a whole directory at once.

Files may be huge, so no file is ever gathered: the head of each ends where an aggregate finds its first line of data, and the foot
is found from the shapes of its lines, counted per block.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainwise.functions import readings
from grainwise.functions.exprs import matches
from grainwise.session import cut

# The sparse share, and a totals label.
SPARSE = 0.5
TOTALS_LABEL = r"(?i)^(grand\s+|sub-?)?totals?\b|^sum\b"
UNQUOTED = '(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _read(spark: SparkSession, path: str) -> DataFrame:
    """file, block, row, line: every line with its place. Row numbers are consecutive inside a block."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))


def _cells(read: DataFrame, delimiter: str) -> DataFrame:
    sep = re.escape(delimiter)
    cut_at = F.when(F.col("line").contains('"'), F.split("line", sep + UNQUOTED)).otherwise(F.split("line", sep))
    bare = F.transform(cut_at, lambda x: F.regexp_replace(F.trim(x), '^"|"$', ""))
    return read.withColumn("cells", bare)


def lines(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """file, block, row, line, cells: every line with its place and its trimmed fields."""
    return _cells(_read(spark, path), delimiter)


def _filled(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda x: x != ""))


def _texty(x: Column) -> Column:
    """A label rather than a measurement; a blank counts as one."""
    number = matches(F.regexp_replace(x, ",", ""), readings.NUMBER_SHAPE)
    day = matches(x, readings.DATE_SHAPE) | matches(x, r"\d{1,2}/\d{1,2}/\d{4}")
    return ~(number | day)


def _year(x: Column) -> Column:
    return matches(x, "(19|20)[0-9]{2}|2100")


def header_lines(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """file, header_lines, data_start, confidence: how each file begins.

    The first line with a non-text value starts the data; the header is the run of text lines right
    above it, up to a blank line. A line of labels over distinct years is a header too.
    """
    in_file, by_block, whole = (Window.partitionBy("file").orderBy("block", "row"), Window.partitionBy("file").orderBy("block"), Window.partitionBy("file"))
    c = F.col("cells")
    filled = F.filter(c, lambda x: x != "")
    numbers = F.filter(filled, lambda x: ~_texty(x))
    years = F.size(F.filter(numbers, _year))
    # By itself a line of labels over distinct years may be a header; any other line with a number is data for sure.
    yearly = ((F.size(numbers) >= 2) & (years == F.size(numbers)) & (F.size(F.array_distinct(numbers)) == F.size(numbers)) & (F.size(numbers) < F.size(filled)))

    def judged(cells: DataFrame) -> DataFrame:
        return cells.withColumns({"fill": F.size(filled), "numbers": F.size(numbers), "years": years, "yearly": yearly})

    # Lines are folded to one row a block where they are; nothing of them is sorted or moved but the head of each file.
    row = F.col("row")
    sure = (F.col("numbers") > 0) & ~F.col("yearly")
    blocks = cut(judged(lines(spark, path, delimiter)).groupBy("file", "block").agg(
        F.min(F.when(sure, row)).alias("sure"), F.max(F.when(F.col("yearly"), row)).alias("yearly"), F.min(F.when(F.col("fill") > 0, row)).alias("filled"),
        F.min(row).alias("opens"), F.max(row).alias("closes")))

    def place(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.struct("block", F.col(name).alias("row")))

    # A preamble ends with the first sure line; without one, with the last line that may be a header of years, or where the file opens.
    end = F.coalesce(F.min(place("sure")).over(whole), F.max(place("yearly")).over(whole), F.min(place("filled")).over(whole), F.min(place("opens")).over(whole))
    ended = blocks.select("*", end.alias("end"), F.lag(F.struct("block", F.col("closes").alias("row"))).over(by_block).alias("before"))
    # The head of a file, and the one line after it.
    upto = (F.when(F.col("block") < F.col("end.block"), F.col("closes")).when(F.col("block") == F.col("end.block"), F.least("closes", F.col("end.row") + 1))
            .when(F.col("before") == F.col("end"), F.col("opens")))
    heads = cut(ended.select(F.col("file").alias("of"), F.col("block").alias("in"), "end", upto.alias("upto")).where("upto IS NOT NULL"))
    near = _read(spark, path).join(heads, (F.col("file") == F.col("of")) & (F.col("block") == F.col("in"))).where(row <= F.col("upto"))
    head = judged(_cells(near, delimiter)).withColumn("within", F.struct("block", "row") <= F.col("end"))
    below = F.lead("years").over(in_file)
    pivot = F.col("yearly") & below.isNotNull() & (below < F.col("numbers"))
    marked = head.select("file", "block", "row", "fill", "within", (F.col("fill") == 0).alias("blank"), F.row_number().over(in_file).alias("n"),
                         ((F.col("fill") > 0) & ((F.col("numbers") == 0) | pivot)).alias("headerish")).where("within")
    is_data = ~F.col("blank") & ~F.col("headerish")
    start = marked.withColumn("data", F.min(F.when(is_data, F.col("n"))).over(whole))
    # The last line above the data that is no label line stops the walk upwards.
    above = F.col("n") < F.col("data")
    stop = F.coalesce(F.max(F.when(above & ~F.col("headerish"), F.col("n"))).over(whole), F.lit(0))
    block = start.withColumn("stop", stop).withColumn("in_block", above & (F.col("n") > F.col("stop")))
    widest = F.max(F.when(F.col("in_block"), F.col("fill")))
    top = F.min_by("fill", F.when(F.col("in_block"), F.col("n")))
    files = block.groupBy("file").agg(
        F.max("data").alias("data"), F.count_if("in_block").alias("lines"), F.min(F.when(F.col("in_block"), F.col("n"))).alias("first"),
        widest.alias("widest"), F.min(F.when(F.col("in_block"), F.struct("n", "fill"))).getField("fill").alias("top"),
        F.min(F.when(~F.col("blank"), F.col("n"))).alias("opening"))
    unsettled = (F.col("lines") > 1) & (F.col("top") < SPARSE * F.col("widest"))
    confidence = (F.when(F.col("data").isNull(), "low").when(F.col("lines") == 0, "medium")
                  .when(unsettled, "low").when(F.col("lines") > 1, "medium").otherwise("high"))
    header = (F.when(F.col("data").isNull(), F.array("opening"))
              .when(F.col("lines") == 0, F.array().cast("array<int>"))
              .otherwise(F.sequence("first", (F.col("data") - 1).cast("int"))))
    return files.select("file", header.alias("header_lines"),
                        F.coalesce("data", F.col("opening") + 1).alias("data_start"), confidence.alias("confidence"))


#: Columns whose being filled one word of bits holds.
WORD = 60


def _bits(cells: Column) -> Column:
    """Which cells hold something, as words of WORD bits."""
    def word(k: Column) -> Column:
        part = F.transform(F.slice(cells, k * WORD + 1, F.lit(WORD)), lambda x, i: F.when(x != "", F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(cells), F.lit(1)) - 1) / WORD).cast("int")), word)


def footer_lines(spark: SparkSession, path: str, delimiter: str = ",", width: int | None = None) -> DataFrame:
    """file, lines, footer_lines: notes and totals at the end of each file, judged by that file's own width and columns.

    A footer line is filled in under half its columns, or is labelled a total and leaves a column empty that every ordinary line
    of its file fills. Lines are folded per block to their shapes (cells, which are filled, labelled a total), of which there are
    few; all that follows reads the shapes.
    """
    c = F.col("cells")
    first = F.coalesce(F.get(F.filter(c, lambda x: x != ""), F.lit(0)), F.lit(""))
    shapes = lines(spark, path, delimiter).groupBy(
        "file", "block", F.size(c).alias("size"), _bits(c).alias("bits"), first.rlike(TOTALS_LABEL).alias("total")).agg(
        F.count(F.lit(1)).alias("n"), F.max("row").alias("last"))
    in_file = Window.partitionBy("file")
    wide = F.max("size").over(in_file) if width is None else F.lit(width)
    filled = F.aggregate("bits", F.lit(0), lambda a, x: a + F.bit_count(x))
    words = F.floor((F.greatest(F.col("width"), F.col("size"), F.lit(1)) - 1) / WORD).cast("int") + 1
    judged = cut(shapes.withColumn("width", wide).withColumn("sparse", filled < SPARSE * F.col("width"))
                 .withColumn("bits", F.concat("bits", F.array_repeat(F.lit(0).cast("long"), F.max(words).over(in_file) - F.size("bits")))))
    # A column that every ordinary line fills keeps its bit in the conjunction of them all.
    always = (judged.where("NOT sparse AND NOT total").select(F.col("file").alias("of"), F.posexplode("bits").alias("k", "word"))
              .groupBy("of", "k").agg(F.bit_and("word").alias("word")).groupBy("of")
              .agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]).alias("always")))
    met = judged.join(always, F.col("file") == F.col("of"), "left")
    none = F.coalesce(F.forall("always", lambda x: x == 0), F.lit(True))
    misses = none | F.exists(F.zip_with("bits", "always", lambda a, b: a.bitwiseAND(b) != b), lambda x: x)
    flagged = F.col("sparse") | (F.col("total") & misses)
    per_block = met.withColumn("flagged", flagged).groupBy("file", "block").agg(
        F.sum("n").alias("n"), F.max("last").alias("last"), F.max(F.when(~F.col("flagged"), F.col("last"))).alias("kept"))
    # Row numbers are consecutive inside a block, so the rows after its last ordinary line are a difference.
    tail = F.when(F.col("kept").isNull(), F.col("n")).otherwise(F.col("last") - F.col("kept"))
    blocks = per_block.withColumn("tail", tail)
    last_kept = F.max(F.when(F.col("kept").isNotNull(), F.col("block"))).over(in_file)
    return blocks.withColumn("at", F.coalesce(last_kept, F.lit(-1))).groupBy("file").agg(
        F.sum("n").alias("lines"), F.sum(F.when(F.col("block") >= F.col("at"), F.col("tail")).otherwise(0)).alias("footer_lines"))


def ragged_rows(spark: SparkSession, path: str, width: int, delimiter: str = ",") -> DataFrame:
    """rows, short, long: lines with fewer or more fields than the table has columns."""
    n = F.size("cells")
    kept = lines(spark, path, delimiter).where(F.trim("line") != "")
    return kept.agg(F.count(F.lit(1)).alias("rows"), F.count_if(n < width).alias("short"), F.count_if(n > width).alias("long"))
