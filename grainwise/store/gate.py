"""What stands between a dataset and an analysis. A version never changes, so its verdict under a contract is counted once and kept."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.errors import GateRefused
from grainwise.evidence import keys
from grainwise.evidence.claims import metrics
from grainwise.evidence.draft import schema_drift
from grainwise.registry import accounted
from grainwise.scope import ScopedFrame, scope_for
from grainwise.store.workspace import Workspace


def _is_open() -> Column:
    return F.coalesce((F.col("drift") != "DESTRUCTIVE") & F.coalesce("key_holds", F.lit(True)), F.lit(False))


def _in_force(space: Workspace) -> DataFrame:
    """dataset, version, row_count, contract_version (null without a contract), and the verdict kept for exactly these two, if any."""
    current = space.contract_history().where("is_current").select("dataset", F.col("version").alias("contract_version"))
    kept = space.log("gates").groupBy("dataset", "version", "contract_version").agg(
        F.max_by(F.struct("drift", "key_holds", "repeats", "copies"), "at").alias("verdict"))
    held = space.datasets().select(F.col("name").alias("dataset"), "version", "row_count")
    return (held.join(current, "dataset", "left").join(kept, ["dataset", "version", "contract_version"], "left")
            .select("dataset", "version", "row_count", "contract_version", F.col("verdict").isNotNull().alias("is_judged"), "verdict.*"))


def _judge(space: Workspace, dataset: str, version: int, contract_version: int) -> None:
    """Count a version against its contract and keep the verdict."""
    df, contract = space.read(dataset), space.contract(dataset)
    drift = schema_drift(contract, df).first()["drift"]
    holds = repeats = copies = None
    if drift != "DESTRUCTIVE":
        if contract.key:
            verdict = keys.verify(df, list(contract.key)).first()
            holds, repeats = verdict["holds"], verdict["duplicates"]
        else:
            copies = keys.exact_copies(df).first()["copies"]
    space.append("gates", [{"dataset": dataset, "version": version, "contract_version": contract_version, "drift": drift, "key_holds": holds,
                            "repeats": repeats, "copies": copies, "at": datetime.now()}])


def judge_new(space: Workspace, dataset: str | None = None) -> None:
    """Judge every version in force that no verdict is kept for: one count each, the first time it is asked for."""
    new = _in_force(space).where("contract_version IS NOT NULL AND NOT is_judged")
    for row in (new.where(F.col("dataset") == dataset) if dataset else new).collect():  # new versions alone
        _judge(space, row["dataset"], row["version"], row["contract_version"])


def gate_status(space: Workspace, dataset: str) -> DataFrame:
    """dataset, has_contract, drift, key_holds, repeats, copies, is_open. The second time no row of the dataset is read."""
    space._entry(dataset)  # refuses an unknown name
    judge_new(space, dataset)
    return _in_force(space).where(F.col("dataset") == dataset).select(
        "dataset", F.col("contract_version").isNotNull().alias("has_contract"), "drift", "key_holds", "repeats", "copies", _is_open().alias("is_open"))


def open_scope(space: Workspace, dataset: str) -> ScopedFrame:
    """The scope of a dataset whose gate is open, with its approved metrics beside the measures."""
    from dataclasses import replace

    from grainwise.contract import Measure
    status = gate_status(space, dataset).first()
    if not status["has_contract"]:
        raise GateRefused(f"{dataset} has no contract in force")
    if not status["is_open"]:
        raise GateRefused(f"{dataset} is blocked: drift {status['drift']}, {status['repeats']} repeated key row(s)")
    contract = space.contract(dataset)
    extra = tuple(Measure(m["name"], "mean", compare=(m["left_column"], m["op"], m["right_column"]))
                  for m in metrics(space).where(f"dataset = '{dataset}' AND status = 'approved'").collect())
    return scope_for(space.read(dataset), replace(contract, measures=(*contract.measures, *extra)))


def analyse(space: Workspace, dataset: str, name: str, at: datetime | None = None, **params) -> DataFrame:
    """Open the gate, run an analysis, write its result and log the exact call."""
    scope = open_scope(space, dataset)
    result, account = accounted(scope, name, **params)
    call = f"{name}({', '.join(f'{k}={v!r}' for k, v in sorted(params.items()))})"
    taken = space.claim(f"results/{dataset}", space.log("analyses").where(F.col("dataset") == dataset).count())
    path = f"{space.root}/results/{dataset}-{taken:06d}"
    result.write.mode("errorifexists").parquet(path)
    account.check()
    written = space.spark.read.parquet(path)
    counted = scope.counted()
    note = f"{counted['analysed']} of {counted['rows']} rows analysed"
    space.append("analyses", [{
        "dataset": dataset, "name": name, "call": call, "contract_version": space.current_contract(dataset)["version"],
        "rows_analysed": counted["analysed"], "result_path": path, "finding": f"{name}: {written.count()} row(s); {note}",
        "at": at or datetime.now()}])
    return written


def workflow_state(space: Workspace) -> DataFrame:
    """dataset, row_count, has_contract, drift, is_open, next_step of every registered dataset, from the logs by joins."""
    judge_new(space)
    step = (F.when(F.col("contract_version").isNull() | (F.col("drift") == "DESTRUCTIVE"), "draft a contract")
            .when(~_is_open(), "validate").otherwise("analyse"))
    return _in_force(space).select("dataset", "row_count", F.col("contract_version").isNotNull().alias("has_contract"), "drift", _is_open().alias("is_open"),
                                   step.alias("next_step"))
