"""Versions of two writers, and verdicts that are counted once."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from grainwise.contract import DatasetContract
from grainwise.errors import GateRefused
from grainwise.store import Workspace, gate


def test_two_writers_never_share_a_version(spark, tmp_path, monkeypatch):
    one, two = Workspace(spark, str(tmp_path)), Workspace(spark.newSession(), str(tmp_path))
    one.register("t", spark.range(3))
    # Both look at the log before either commits.
    monkeypatch.setattr(Workspace, "_last_version", lambda self, name: 1)
    versions = [one.register("t", spark.range(10)), two.register("t", two.spark.range(20))]
    assert versions == [2, 3]
    assert [one.read("t", v).count() for v in (1, 2, 3)] == [3, 10, 20] and two.read("t").count() == 20
    # A writer that was lost after its claim leaves a number unused.
    assert one.claim("datasets/t", 1) == 4
    assert two.register("t", two.spark.range(5)) == 5 and one.read("t").count() == 5


def test_a_limit_takes_the_same_rows_every_time(spark, tmp_path):
    space = Workspace(spark, str(tmp_path))
    source = spark.range(1_000).withColumn("m", F.create_map(F.lit("a"), F.col("id")))
    space.narrowed_load("t", source.repartition(7), where="id > 10", limit=50)
    space.narrowed_load("t", source.orderBy(F.desc("id")), where="id > 10", limit=50)
    rows = [{r["id"] for r in space.read("t", v).collect()} for v in (1, 2)]
    assert rows[0] == rows[1] and len(rows[0]) == 50 and space.subset_note("t").startswith("subset: 50 of 1000 rows")


def test_a_verdict_is_counted_once_for_a_version_and_a_contract(spark, tmp_path, monkeypatch):
    space = Workspace(spark, str(tmp_path))
    space.register("t", spark.range(10).withColumn("k", F.col("id") % 5))
    space.register("bare", spark.range(4))
    contract = DatasetContract(dataset="t", grain="one row", key=("id",))
    space.confirm(contract)
    judged = []
    count = gate._judge
    monkeypatch.setattr(gate, "_judge", lambda *a: (judged.append(a[1:]), count(*a)))
    first = gate.gate_status(space, "t").first()
    assert (first["drift"], first["key_holds"], first["repeats"], first["is_open"]) == ("IDENTICAL", True, 0, True)
    assert gate.gate_status(space, "t").first() == first and judged == [("t", 1, 1)]
    assert not [f for f in gate.gate_status(space, "t").inputFiles() if "/datasets/" in f]
    state = {r["dataset"]: (r["has_contract"], r["is_open"], r["next_step"]) for r in gate.workflow_state(space).collect()}
    assert state == {"t": (True, True, "analyse"), "bare": (False, False, "draft a contract")} and len(judged) == 1
    # A new contract, and a new version, are judged anew.
    space.confirm(replace(contract, key=("k",)))
    assert gate.gate_status(space, "t").first()["is_open"] is False and judged[-1] == ("t", 1, 2)
    space.register("t", spark.range(5).withColumn("k", F.col("id")))
    assert gate.gate_status(space, "t").first()["is_open"] is True and judged[-1] == ("t", 2, 2) and len(judged) == 3
    with pytest.raises(GateRefused):
        gate.gate_status(space, "nothing")
