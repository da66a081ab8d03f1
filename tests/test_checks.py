"""Checks: evidence with its withheld count, odd rows, and how often the table is read."""

import re

from pyspark.sql import functions as F

from grainwise.contract import DatasetContract, Domain, ForeignKey, Rule
from grainwise.plans.workflow import _LINE_CONTRACT
from grainwise.validation import checks

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return {r["check_id"]: r.asDict() for r in df.collect()}


def test_evidence_is_the_first_lines_and_the_rest_is_counted(spark):
    rows = [(i if i < 40 else 7, None if i % 10 == 3 else f"v{i % 13:02d}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, kind string, x double").repartition(6)
    contract = DatasetContract(dataset="t", grain="one row", key=("id",), domains=(Domain("kind", ("v00", "v01")),), expectations=(Rule("x < 30"),))
    got = rows_of(checks.validate(df, contract))
    assert list(got) == ["key.unique", "key.complete", "value.domain[kind]", "rule[x < 30]"]
    assert (got["key.unique"]["evidence"], got["key.unique"]["withheld"], got["key.unique"]["failed"]) == (["7 x21"], 0, 21)
    kinds = sorted({k for _, k, _ in rows if k not in (None, "v00", "v01")})
    told = got["value.domain[kind]"]
    assert [line.split(" x")[0] for line in told["evidence"]] == kinds[:10] and told["withheld"] == len(kinds) - 10
    assert told["passed"] + told["failed"] + told["not_checked"] == told["rows"] == 60 and told["not_checked"] == 6
    rule = got["rule[x < 30]"]
    assert rule["evidence"] == sorted(str(i) if i < 40 else "7" for i in range(30, 60))[:10] and rule["withheld"] == rule["failed"] - 10 == 20


def test_an_empty_table_passes_and_a_missing_parent_is_not_run(spark):
    df = spark.createDataFrame([], "id int, kind string, x double")
    contract = DatasetContract(dataset="t", grain="one row", key=("id",), domains=(Domain("kind", ("a",)),), expectations=(Rule("x < 3"),),
                               foreign_keys=(ForeignKey(("id",), "p", ("id",)), ForeignKey(("id",), "q", ("id",))))
    got = rows_of(checks.validate(df, contract, {"p": df.select("id")}))
    assert {c: (r["outcome"], r["rows"], r["failed"], r["withheld"], r["evidence"]) for c, r in got.items()} == {
        "key.unique": ("PASS", 0, 0, 0, []), "key.complete": ("PASS", 0, 0, 0, []), "value.domain[kind]": ("PASS", 0, 0, 0, []),
        "rule[x < 3]": ("PASS", 0, 0, 0, []), "reference.integrity[0]": ("PASS", 0, 0, 0, []), "reference.integrity[1]": ("NOT RUN", 0, 0, 0, [])}


def test_a_reference_that_nothing_matches_and_null_keys(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,)] + [(100 + i,) for i in range(12)], "k int")
    parent = spark.createDataFrame([(2,), (None,)], "k int")
    got = checks.reference(child, parent, ("k",), ("k",), 0, "p").first()
    assert (got["rows"], got["passed"], got["failed"], got["not_checked"], got["withheld"]) == (16, 1, 14, 1, 3)
    assert got["evidence"] == ["1 x2", *[f"{100 + i} x1" for i in range(9)]]


def test_a_table_is_read_once_for_counts_and_once_for_lines(spark):
    lines, orders = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("lineitem", "orders"))
    df = checks.validate(lines, _LINE_CONTRACT, {"orders": orders}, F.lit("2001-10-01").cast("date"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    # Counts, lines, values outside a domain, the key, and one reference; the missing parent's row count reads no column.
    assert len([s for s in scans if "l_" in s]) <= 5, plan
