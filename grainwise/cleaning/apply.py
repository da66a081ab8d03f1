"""Applying approved actions: all of them or none, with what was there before still readable."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from grainwise.cleaning import actions as act
from grainwise.cleaning.actions import Action, perform
from grainwise.cleaning.detect import Plan
from grainwise.errors import ParamsInvalid
from grainwise.store import Workspace


def conflicts(actions: list[Action]) -> list[str]:
    """A conversion claims its column: two readings of it, or a text action beside it, refuse."""
    claims: dict[str, str] = {}
    out = []
    for a in actions:
        if a.kind == act.CONVERT_TYPE:
            if a.column in claims:
                out.append(f"{claims[a.column]} and {a.action_id} are two readings of {a.column}")
            claims.setdefault(a.column, a.action_id)
    for a in actions:
        if a.kind != act.CONVERT_TYPE and a.column in claims:
            out.append(f"{a.action_id} was written for text, and {claims[a.column]} converts {a.column}; approve {a.action_id} first")
    return out


def safe_actions(plan: Plan) -> list[Action]:
    """Actions that lose nothing, agree with each other, and leave no normalisation behind."""
    waiting = {a.column for a in plan.actions if a.kind == act.NORMALISE_MISSING}
    read = [a.column for a in plan.actions if a.kind == act.CONVERT_TYPE]
    waiting |= {c for c in read if read.count(c) > 1}
    picked: list[Action] = []
    for a in plan.actions:
        lossy = a.values_lost or a.kind in (act.NORMALISE_CASE, act.NULL_NON_FINITE, act.DROP_DUPLICATE_ROWS, act.EXCLUDE_COLUMN)
        if lossy or (a.kind == act.CONVERT_TYPE and a.column in waiting) or conflicts([*picked, a]):
            continue
        picked.append(a)
    return picked


def chain(df: DataFrame, actions: list[Action]) -> DataFrame:
    """The table after every action in order: one plan, one pass."""
    if not actions:
        raise ParamsInvalid("nothing was approved")
    problems = conflicts(actions)
    if problems:
        raise ParamsInvalid("; ".join(problems))
    for a in actions:
        df = perform(df, a)
    return df


def apply(space: Workspace, plan: Plan, approved: list[str], plan_id: str = "plan", at: datetime | None = None) -> int:
    """Write the cleaned table as a new version, ledger each action, then let readers see it.

    The version before stays as it was. A plan made for another structure or another number of rows
    is refused, and so is an id the plan does not hold.
    """
    df = space.read(plan.dataset)
    stale = plan.staleness(df, df.count())
    if stale:
        raise ParamsInvalid(f"the plan is stale: {stale}")
    unknown = [i for i in approved if plan.action(i) is None]
    if unknown:
        raise ParamsInvalid(f"the plan has no action {', '.join(unknown)}")
    actions = [plan.action(i) for i in approved]
    cleaned = chain(df, actions)
    before = space._entry(plan.dataset)["version"]
    version = space.register(plan.dataset, cleaned, at=at)
    space.append("ledger", ledger_rows(df, actions, plan, plan_id, before, at or datetime.now(), space.read(plan.dataset).count()))
    return version


def ledger_rows(df: DataFrame, actions: list[Action], plan: Plan, plan_id: str, version: int, at: datetime, after: int) -> list[dict]:
    """One row per action. Only an action that drops rows, and is not the last to, costs a count."""
    dropping = [i for i, a in enumerate(actions) if a.kind in (act.DROP_DUPLICATE_ROWS, act.DROP_HEADER_ROWS)]
    rows, now, step = [], plan.row_count, df
    for i, a in enumerate(actions):
        step = perform(step, a)
        then = now
        if i in dropping:
            now = after if i == dropping[-1] else step.count()
        rows.append({"applied_at": at, "dataset": plan.dataset, "plan_id": plan_id, "action_id": a.action_id, "kind": a.kind,
                     "column": a.column, "rows_before": then, "rows_after": now, "history_version": version, "statement": a.statement})
    return rows
