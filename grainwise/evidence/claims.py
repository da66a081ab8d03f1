"""Typed claims checked against the table: counts in caveats, and proposed metrics."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.contract import COMPARISONS, Measure, is_number
from grainwise.errors import ParamsInvalid
from grainwise.functions.exprs import count_where, quoted
from grainwise.profiling.table import duplicate_rows
from grainwise.scope import comparison
from grainwise.store import Workspace

# The words that make a number a row count, and the words of each kind of claim.
COUNT_CLAIM = (r"(?i)(?<![\w.,-])(\d{1,3}(?:,\d{3})+|\d+)(?![\w.,]\d)"
               r"(?=(?:\s+[a-z_'-]+){0,3}?\s+(?:rows?|lines?|records?|values?|entries|cases)\b)")
QUOTED = r"""'([^']*)'|"([^"]*)"|‘([^’]*)’|“([^”]*)”"""
BLANK_WORDS = r"(?i)\b(blank|empty|missing|null|nulls)\b"
DUPLICATE_WORDS = r"(?i)\bduplicat"
OPERATORS = {"=": "=", "==": "=", "<": "<", ">": ">", "<=": "<=", ">=": ">=", "!=": "<>", "<>": "<>"}


@dataclass(frozen=True)
class Claim:
    caveat: str
    claimed: int | None
    shape: str          # duplicates, comparison, quoted, blank, or unchecked
    test: Column | None = None


def _tokens(columns: list[str], caveat: str) -> list[tuple[str, str]]:
    """(kind, text) of a caveat from left to right: quoted, column, sign, number or word. A quoted column is a column."""
    names = "|".join(re.escape(c) for c in sorted(columns, key=len, reverse=True))
    signs = "|".join(sorted(map(re.escape, OPERATORS), key=len, reverse=True))
    token = rf"{QUOTED}|(?<!\w)(?P<column>{names})(?!\w)|(?P<sign>{signs})|(?P<number>-?\d+(?:\.\d+)?)(?![\w.])|(?P<word>\w+)"
    read = ((m.lastgroup if m.lastgroup in m.groupdict() else "quoted", next((g for g in m.groups() if g), "")) for m in re.finditer(token, caveat))
    return [("column" if kind == "quoted" and text in columns else kind, text) for kind, text in read if text]


def _tests(df: DataFrame, name: str, tokens: list[tuple[str, str]]) -> dict[str, Column]:
    """Each shape the tokens can be read as, with what it counts, the most particular first."""
    c, found = F.col(quoted(name)), {}
    texts = [text for kind, text in tokens if kind == "quoted"]
    for (k1, _), (k2, sign), (k3, number) in zip(tokens, tokens[1:], tokens[2:]):  # noqa: B905
        if (k1, k2, k3) == ("column", "sign", "number") and is_number(df.schema[name].dataType):
            found["comparison"] = F.expr(f"{quoted(name)} {OPERATORS[sign]} {float(number)!r}D")
    if len(texts) == 1:
        found["quoted"] = c.cast("string") == texts[0]
    if not texts and any(kind == "word" and re.fullmatch(BLANK_WORDS, text) for kind, text in tokens):
        found["blank"] = c.isNull() | (F.trim(c.cast("string")) == "")
    return found


def read_claim(df: DataFrame, caveat: str) -> Claim:
    """What a caveat says, as a test that can be counted; unchecked when it is no such claim."""
    counts = re.findall(COUNT_CLAIM, caveat)
    claimed = int(counts[0].replace(",", "")) if len(counts) == 1 else None
    tokens = _tokens(df.columns, caveat)
    about = {text for kind, text in tokens if kind == "column"}
    if claimed is not None and re.search(DUPLICATE_WORDS, caveat):
        return Claim(caveat, claimed, "duplicates")
    readings = _tests(df, *about, tokens) if claimed is not None and len(about) == 1 else {}
    shape, test = next(iter(readings.items()), ("unchecked", None))
    return Claim(caveat, claimed, shape, test)


def check_caveats(df: DataFrame, caveats: list[str]) -> DataFrame:
    """caveat, status, claimed, measured. Every claim is counted in one aggregate."""
    claims = [read_claim(df, c) for c in caveats]
    tested = [(i, c) for i, c in enumerate(claims) if c.test is not None]
    counted = df.agg(*[count_where(c.test).alias(f"n{i}") for i, c in tested]).first().asDict() if tested else {}
    copies = duplicate_rows(df).first()["duplicates"] if any(c.shape == "duplicates" for c in claims) else None
    rows = []
    for i, c in enumerate(claims):
        measured = copies if c.shape == "duplicates" else counted.get(f"n{i}")
        # A quoted word that is nowhere may have been read as NULL on load: that is no difference.
        judged = measured is not None and not (c.shape == "quoted" and measured == 0)
        status = "unchecked" if not judged else "agrees" if measured == c.claimed else "differs"
        rows.append((c.caveat, c.shape, status, c.claimed, measured if judged else None))
    return df.sparkSession.createDataFrame(rows, "caveat string, shape string, status string, claimed bigint, measured bigint")


def propose_metric(space: Workspace, dataset: str, name: str, left: str, op: str, right: str,
                   definition: str, at: datetime | None = None) -> dict:
    """Count a proposed comparison and log it as pending."""
    df = space.read(dataset)
    if op not in COMPARISONS:
        raise ParamsInvalid(f"op must be one of {', '.join(COMPARISONS)}")
    if not definition.strip():
        raise ParamsInvalid("a metric needs a definition in words")
    if name in df.columns:
        raise ParamsInvalid(f"{name} is already a column of {dataset}")
    row = metric_counts(df, Measure(name, "mean", definition, compare=(left, op, right))).first()
    if not row["judged"]:
        raise ParamsInvalid(f"{left} {op} {right} cannot be judged on any row")
    entry = {"dataset": dataset, "name": name, "left_column": left, "op": op, "right_column": right, "judged": row["judged"],
             "true_rows": row["true_rows"], "status": "pending", "at": at or datetime.now()}
    space.append("metrics", [entry])
    return entry


def metric_counts(df: DataFrame, m: Measure) -> DataFrame:
    """rows, judged, true_rows, unjudged of a comparison."""
    v = comparison(df, m)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(v).alias("judged"), F.coalesce(F.sum(v), F.lit(0)).alias("true_rows")).withColumn(
        "unjudged", F.col("rows") - F.col("judged"))


def decide_metric(space: Workspace, dataset: str, name: str, approve: bool, at: datetime | None = None) -> None:
    """Approve or reject the pending metric of a name. An approval replaces an older one."""
    row = metrics(space).where((F.col("dataset") == dataset) & (F.col("name") == name)).first()
    if row is None or row["status"] != "pending":
        raise ParamsInvalid(f"no metric {name!r} of {dataset} is pending")
    space.append("metrics", [{**row.asDict(), "status": "approved" if approve else "rejected", "at": at or datetime.now()}])


def metrics(space: Workspace) -> DataFrame:
    """The latest standing of every metric, by dataset and name."""
    from pyspark.sql import Window
    latest = Window.partitionBy("dataset", "name").orderBy(F.col("at").desc(), F.col("status") == "pending")
    return space.log("metrics").withColumn("__rn", F.row_number().over(latest)).where("__rn = 1").drop("__rn")
