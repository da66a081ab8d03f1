"""The report as rows, and results as series for a plot."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainwise.contract import is_number
from grainwise.errors import ParamsInvalid
from grainwise.functions.exprs import quoted
from grainwise.store.workspace import Workspace

# The sections of a report, in order.
SECTIONS = ("The question asked", "Dataset and grain", "Data quality", "Cleaning ledger", "Validation results",
            "Findings", "Method notes", "Caveats and exclusions", "Reproduction appendix")


def record_profile(space: Workspace, dataset: str, at: datetime | None = None) -> None:
    """Log that a dataset was profiled, with its shape then."""
    e = space._entry(dataset)
    width = len(space.read(dataset).columns)
    space.append("profiles", [{"dataset": dataset, "version": e["version"], "row_count": e["row_count"], "column_count": width,
                               "fingerprint": e["fingerprint"], "at": at or datetime.now()}])


def profile_drift(space: Workspace, dataset: str) -> DataFrame:
    """rows_was, rows_now, changed: the last profile against the dataset now."""
    e = space._entry(dataset)
    last = space.log("profiles").where(F.col("dataset") == dataset).orderBy(F.col("at").desc()).limit(1)
    return last.select(F.col("row_count").alias("rows_was"), F.lit(e["row_count"]).alias("rows_now"),
                       (F.col("fingerprint") != e["fingerprint"]).alias("changed"))


def report_sections(space: Workspace, dataset: str, question: str) -> DataFrame:
    """section, line_no, text: nine sections from the logs. An empty section says so."""
    spark = space.spark
    mine = lambda log: space.log(log).where(F.col("dataset") == dataset)
    contract = space.contract_history(dataset).where("is_current")
    text = lambda *parts: F.concat_ws(" ", *parts)
    runs = mine("analyses")
    latest = Window.partitionBy("call").orderBy(F.col("at").desc())
    findings = runs.withColumn("rn", F.row_number().over(latest)).where("rn = 1")
    last_run = mine("validations").where(F.col("at") == mine("validations").agg(F.max("at")).scalar())
    grain, caveats = (F.get_json_object("contract", p) for p in ("$.grain", "$.caveats"))
    bodies = {
        1: spark.range(1).select(F.lit(question).alias("text"), F.lit("0").alias("at")),
        2: contract.select(text(F.lit("version"), F.col("version").cast("string"), F.lit("-"), grain).alias("text"), F.col("valid_from").cast("string").alias("at")),
        3: mine("profiles").select(text(F.col("row_count").cast("string"), F.lit("rows,"), F.col("column_count").cast("string"), F.lit("columns")).alias("text"), F.col("at").cast("string").alias("at")),
        4: mine("ledger").select(text("action_id", "statement", F.col("rows_before").cast("string"), F.lit("->"), F.col("rows_after").cast("string")).alias("text"), F.col("applied_at").cast("string").alias("at")),
        5: last_run.select(text("check_id", "outcome", F.col("failed").cast("string"), F.lit("failed")).alias("text"), F.col("check_id").alias("at")),
        6: findings.select(F.col("finding").alias("text"), F.col("at").cast("string").alias("at")),
        7: runs.groupBy("rows_analysed", "contract_version").agg(F.count(F.lit(1)).alias("n")).select(
            text(F.col("rows_analysed").cast("string"), F.lit("rows analysed under contract version"), F.col("contract_version").cast("string")).alias("text"), F.lit("0").alias("at")),
        8: contract.where(F.length(caveats) > 2).select(caveats.alias("text"), F.lit("0").alias("at")),
        9: runs.select(F.col("call").alias("text"), F.col("at").cast("string").alias("at")),
    }
    out = None
    for i, body in bodies.items():
        one = body.select(F.lit(i).alias("section_no"), "text", "at")
        out = one if out is None else out.unionByName(one)
    order = Window.partitionBy("section_no").orderBy("at", "text")  # log lines of one dataset
    numbered = out.withColumn("line_no", F.row_number().over(order)).select("section_no", "line_no", "text")
    names = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(s).alias("section")) for i, s in enumerate(SECTIONS, 1)])).alias("s")).select("s.*")
    return names.join(numbered, F.col("no") == F.col("section_no"), "left").select(
        "section", F.coalesce("line_no", F.lit(0)).alias("line_no"), F.coalesce("text", F.lit("(nothing recorded)")).alias("text"))


def chart_series(result: DataFrame, x: str | None = None, y: list[str] | None = None, rollup: str | None = "is_all") -> DataFrame:
    """series, x, y: the plottable columns of a result in long form. Empty slots are kept.

    The roll-up row is left out beside the rows it totals, and the row count beside a measure.
    """
    x = x or result.columns[0]
    if x not in result.columns:
        raise ParamsInvalid(f"{x} is not a column of this result")
    kept = result.where(~F.col(rollup)) if rollup and rollup in result.columns else result
    numbers = [f.name for f in result.schema.fields if f.name != x and is_number(f.dataType)]
    wanted = y or ([c for c in numbers if c != "rows"] or numbers)
    missing = [c for c in wanted if c not in result.columns]
    if missing or not wanted:
        raise ParamsInvalid(f"no numbers to plot: {missing or result.columns}")
    cells = F.array(*[F.struct(F.lit(c).alias("series"), F.col(quoted(c)).cast("double").alias("y")) for c in wanted])
    return kept.select(F.col(quoted(x)).cast("string").alias("x"), F.explode(cells).alias("s")).select("s.series", "x", "s.y")


def series_facts(series: DataFrame) -> DataFrame:
    """series, points, empty, lowest, highest, first, last: what a caption would say."""
    at = F.when(F.col("y").isNotNull(), F.col("x"))
    return series.groupBy("series").agg(
        F.count("y").alias("points"), F.count_if(F.col("y").isNull()).alias("empty"), F.min("y").alias("lowest"), F.max("y").alias("highest"),
        F.min_by("y", at).alias("first"), F.max_by("y", at).alias("last"))
