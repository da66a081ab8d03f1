"""Work on text values: dealt by their number, and no more of it than the flags ask for."""

from pyspark.sql import functions as F

from grainwise import session
from grainwise.cleaning import actions, detect
from grainwise.profiling.table import TextCells


def test_values_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_VALUES", 100)
    i = F.col("id")
    df = spark.range(0, 8_000, 1, 2).select(i.cast("string").alias("own"), (i % 2_000).cast("string").alias("shared"))
    cells = TextCells(df, df.columns)
    tasks = {c: cells.values([c])._jdf.queryExecution().toRdd().getNumPartitions() for c in df.columns}
    assert cells.folded == ["shared"] and tasks["own"] == 80 and tasks["shared"] >= 15
    assert {r["column"]: (r["rows"], r["values"]) for r in cells.values().groupBy("column").agg(F.sum("n").alias("rows"), F.count("*").alias("values")).collect()} == {
        "own": (8_000, 8_000), "shared": (8_000, 2_000)}


def test_a_type_needs_only_its_own_flags(spark):
    df = spark.createDataFrame([(a, b, c) for a, b, c in zip(["1", "2.50", "x", None, "007"], ["2024-01-02", "2024-1-3 04:05", "1/2/24", "", "n/a"], ["true", "FALSE", "yes", "0", "1"])],
                               "a string, b string, c string")
    every = {r["column"]: r.asDict() for r in detect.text_counts(df, actions.DEFAULT_MISSING).collect()}
    some = {r["column"]: r.asDict() for r in detect.text_counts(df, actions.DEFAULT_MISSING, flags=detect.TYPE_FLAGS).collect()}
    assert some == {c: {k: n for k, n in counts.items() if k in ("column", *detect.TYPE_FLAGS)} for c, counts in every.items()}
    assert {c: detect.proposed_type(k) for c, k in some.items()} == {c: detect.proposed_type(k) for c, k in every.items()}
