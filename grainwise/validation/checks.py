"""Every check as one row: check_id, subject, outcome, rows, passed, failed, not_checked, evidence, withheld."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainwise.contract import DatasetContract
from grainwise.errors import ContractError
from grainwise.functions.exprs import count_where, quoted
from grainwise.scope import rule_column
from grainwise.store import Workspace

#: Lines of evidence a failed check carries; how many more there are stands in `withheld`.
EVIDENCE = 10
_LINES = "array<string>"


@dataclass(frozen=True)
class RowCheck:
    """A question each row answers by itself: failed, not to be judged (`unknown`), or passed.

    `line` is what a failing row shows as evidence. `valued` checks show each failing value once, with its count. A check with
    `fixed` lines shows those, once it failed.
    """

    check: str
    subject: str
    failed: Column
    unknown: Column
    line: Column | None = None
    valued: bool = False
    fixed: tuple[tuple[str, Column], ...] = ()


def _shown(columns) -> Column:
    return F.concat_ws(", ", *[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("(null)")) for c in columns])


def _blank(columns) -> Column:
    blank = F.lit(False)
    for c in columns:
        blank = blank | F.col(quoted(c)).isNull()
    return blank


def _first_lines(lines: DataFrame) -> DataFrame:
    """(at, evidence): the first lines of each check. The rank is limited before the rows are shuffled."""
    order = Window.partitionBy("at").orderBy(F.col("line").asc_nulls_last())
    return (lines.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= EVIDENCE)
            .groupBy("at").agg(F.sort_array(F.collect_list("line")).alias("evidence")))


def _report(counts: DataFrame, lines: DataFrame | None) -> DataFrame:
    """Check rows from (at, check_id, subject, rows, failed, not_checked, lines, said) and the (at, line) of failing rows or values.

    `lines` counts all evidence there is; `said` is evidence that is already at hand.
    """
    shown = F.col("said")
    if lines is not None:
        counts = counts.join(_first_lines(lines), "at", "left")
        shown = F.coalesce("evidence", "said")
    counts = counts.withColumn("evidence", shown)
    outcome = F.when(F.col("failed") > 0, "FAIL").otherwise("PASS")
    long = lambda c: c.cast("long")
    return counts.select(
        "at", "check_id", "subject", outcome.alias("outcome"), long(F.col("rows")).alias("rows"),
        long(F.col("rows") - F.col("failed") - F.col("not_checked")).alias("passed"), long(F.col("failed")).alias("failed"),
        long(F.col("not_checked")).alias("not_checked"), "evidence", long(F.greatest(F.col("lines") - F.size("evidence"), F.lit(0))).alias("withheld"))


def _row_checks(df: DataFrame, asked: list[RowCheck], at: int, lost: tuple[str, int] | None = None) -> DataFrame:
    """All row checks of a table from one aggregate, and the lines of all that failed from one pass more; `at` is the place of the first.

    `lost` is a dataset's name and the rows it had: rows lost since fail.
    """
    counts = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(asked):
        counts += [count_where(c.failed).alias(f"f{i}"), count_where(c.unknown).alias(f"u{i}"),
                   *[count_where(test).alias(f"s{i}_{j}") for j, (_, test) in enumerate(c.fixed)]]
    none, zero = F.array().cast(_LINES), F.lit(0).cast("long")
    made = []
    for i, c in enumerate(asked):
        failed = F.col(f"f{i}")
        said = F.array(*[F.concat(F.lit(f"{word} "), F.col(f"s{i}_{j}").cast("string")) for j, (word, _) in enumerate(c.fixed)]).cast(_LINES)
        lines = F.lit(len(c.fixed)).cast("long") if c.fixed else failed if c.line is not None else zero
        made.append((at + i, c.check, c.subject, F.col("rows"), failed, F.col(f"u{i}"), lines, F.when(failed > 0, said).otherwise(none)))
    if lost:
        name, was = lost
        made.append((at + len(asked), "table.row_count", name, F.greatest(F.col("rows"), F.lit(was)), F.greatest(F.lit(was) - F.col("rows"), zero), zero, zero, none))
    names = ("at", "check_id", "subject", "rows", "failed", "not_checked", "lines", "said")
    told = F.array(*[F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(names, m, strict=True)]) for m in made])
    table = df.agg(*counts).select(F.explode(told).alias("c")).select("c.*")
    lines = _failing(df, [(at + i, c) for i, c in enumerate(asked) if c.line is not None and not c.valued])
    valued = [(at + i, c) for i, c in enumerate(asked) if c.valued]
    if valued:
        # Values are counted before they are shown, so a common one is one line.
        counted = _failing(df, valued).groupBy("at", "line").agg(F.count(F.lit(1)).alias("n"))
        # The test on n keeps it in both uses of the counts, so that their shuffle is one.
        different = counted.groupBy("at").agg(F.count_if(F.col("n") > 0).alias("__values"))
        table = (table.join(different, "at", "left").withColumn("lines", F.when(F.col("__values").isNotNull(), F.col("__values")).otherwise(F.col("lines")))
                 .drop("__values"))
        values = counted.select("at", F.concat("line", F.lit(" x"), F.col("n").cast("string")).alias("line"))
        lines = values if lines is None else lines.unionByName(values)
    out = _report(table, lines)
    # Rows gained are no failure, and rows lost leave every row there is as passed.
    return out.withColumn("rows", F.when(F.col("check_id") == "table.row_count", F.col("passed")).otherwise(F.col("rows"))) if lost else out


def _failing(df: DataFrame, asked: list[tuple[int, RowCheck]]) -> DataFrame | None:
    """(at, line) for every failing answer; a row is opened once, into the checks it failed."""
    if not asked:
        return None
    any_ = asked[0][1].failed
    for _, c in asked[1:]:
        any_ = any_ | c.failed
    opened = [F.when(c.failed, F.struct(F.lit(at).alias("at"), c.line.alias("line"))) for at, c in asked]
    return df.where(any_).select(F.explode(F.array_compact(F.array(*opened))).alias("x")).select("x.*")


def _grouped(groups: DataFrame, check: str, subject: str, at: int) -> DataFrame:
    """A check row from groups (n rows, failed, unknown, line); groups fail whole."""
    n = F.col("n")
    zero = F.lit(0)
    counts = groups.agg(F.coalesce(F.sum(n), zero).alias("rows"), F.coalesce(F.sum(F.when(F.col("failed"), n)), zero).alias("failed"),
                        F.coalesce(F.sum(F.when(F.col("unknown"), n)), zero).alias("not_checked"), F.count_if("failed").alias("lines"))
    named = counts.select(F.lit(at).alias("at"), F.lit(check).alias("check_id"), F.lit(subject).alias("subject"), "*", F.array().cast(_LINES).alias("said"))
    shown = groups.where("failed").select(F.lit(at).alias("at"), F.concat("line", F.lit(" x"), n.cast("string")).alias("line"))
    return _report(named, shown)


def _counted(df: DataFrame, columns, names: list[str]) -> DataFrame:
    """`names`, n, blank: rows per combination. `blank` is an aggregate, so a filter on it stays above the shuffle, which is then reused."""
    keys = [F.col(quoted(c)).alias(k) for c, k in zip(columns, names, strict=True)]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bool_or(_blank(columns)).alias("blank"))


def _key_unique(df: DataFrame, key: tuple[str, ...], at: int) -> DataFrame:
    names = [f"k{i}" for i in range(len(key))]
    groups = _counted(df, key, names)
    return _grouped(groups.select("n", (~F.col("blank") & (F.col("n") > 1)).alias("failed"), F.col("blank").alias("unknown"), _shown(names).alias("line")),
                    "key.unique", ", ".join(key), at)


def _reference(df: DataFrame, parent: DataFrame | None, columns, referenced, index: int, name: str, at: int) -> DataFrame:
    check, subject = f"reference.integrity[{index}]", f"{', '.join(columns)} -> {name}"
    if parent is None:
        whole = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(at).alias("at"), F.lit(check).alias("check_id"), F.lit(subject).alias("subject"), "rows", F.lit(0).alias("failed"),
            F.col("rows").alias("not_checked"), F.lit(0).alias("lines"), F.array().cast(_LINES).alias("said"))
        return _report(whole, None).withColumn("outcome", F.lit("NOT RUN"))
    names = [f"k{i}" for i in range(len(columns))]
    child = _counted(df, columns, names)
    known = parent.select(*[F.col(quoted(c)).alias(k) for c, k in zip(referenced, names, strict=True)]).distinct().withColumn("known", F.lit(True))
    judged = child.join(known, names, "left")
    return _grouped(judged.select("n", (~F.col("blank") & F.col("known").isNull()).alias("failed"), F.col("blank").alias("unknown"), _shown(names).alias("line")),
                    check, subject, at)


def _complete(key: tuple[str, ...]) -> RowCheck:
    return RowCheck("key.complete", ", ".join(key), _blank(key), F.lit(False), _shown(key))


def _dates(contract: DatasetContract, today: Column | None) -> list[RowCheck]:
    d, subject = F.col(quoted(contract.dated())), contract.date_column
    upto, undated = F.current_date() if today is None else today, d.isNull()
    out = [RowCheck("date.present", subject, undated, F.lit(False))]
    if contract.window:
        before, after = d < F.lit(contract.window.start), d >= F.date_add(F.lit(contract.window.end), 1)
        out.append(RowCheck("date.in_window", subject, before | after, undated, fixed=(("before", before), ("after", after))))
    return [*out, RowCheck("date.not_future", subject, d.cast("date") > upto, undated)]


def _domain(column: str, allowed) -> RowCheck:
    c = F.col(quoted(column))
    out = c.isNotNull() & ~c.isin(list(allowed))
    return RowCheck(f"value.domain[{column}]", column, out, c.isNull(), c.cast("string"), valued=True)


def _expectation(df: DataFrame, rule: str, key: tuple[str, ...]) -> RowCheck:
    test = rule_column(df, rule)
    return RowCheck(f"rule[{rule}]", rule, ~test, test.isNull(), _shown(key) if key else None)


def key_unique(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Every row of a repeated key fails; a row with a NULL in its key cannot be judged."""
    return _key_unique(df, key, 0).drop("at")


def key_complete(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return _row_checks(df, [_complete(key)], 0).drop("at")


def dates(df: DataFrame, contract: DatasetContract, today: Column | None = None) -> DataFrame:
    """date.present, date.in_window and date.not_future from one aggregate."""
    return _row_checks(df, _dates(contract, today), 0).drop("at")


def row_count(df: DataFrame, contract: DatasetContract) -> DataFrame:
    """Growth passes; rows lost since the contract was confirmed fail."""
    was = contract.binding.row_count if contract.binding else 0
    return _row_checks(df, [], 0, (contract.dataset, was)).drop("at")


def reference(df: DataFrame, parent: DataFrame | None, columns, referenced, index: int, name: str) -> DataFrame:
    """Rows whose parent is missing. NULL references cannot be judged; a missing parent is NOT RUN.

    References are counted before they meet the parent, so a hot reference is one row, and the parent's NULL keys match nothing.
    """
    return _reference(df, parent, columns, referenced, index, name, 0).drop("at")


def domain(df: DataFrame, column: str, allowed) -> DataFrame:
    """Values outside a declared set; NULL cannot be judged."""
    return _row_checks(df, [_domain(column, allowed)], 0).drop("at")


def expectation(df: DataFrame, rule: str, key: tuple[str, ...] = ()) -> DataFrame:
    """False fails, NULL cannot be judged; the failing keys are the evidence."""
    return _row_checks(df, [_expectation(df, rule, key)], 0).drop("at")


def validate(df: DataFrame, contract: DatasetContract, parents: dict[str, DataFrame] | None = None,
             today: Column | None = None) -> DataFrame:
    """Every check the contract calls for, in order: keys, dates, rows, domains, rules, references.

    One aggregate counts all row checks, one pass collects the lines of those that failed and one more the values outside a domain;
    the key, and each reference, is counted once.
    """
    parents = parents or {}
    asked: list[RowCheck] = []
    if contract.key:
        asked.append(_complete(contract.key))
    if contract.date_column:
        asked += _dates(contract, today)
    asked += [_domain(d.column, d.allowed) for d in contract.domains] + [_expectation(df, r.rule, contract.key) for r in contract.expectations]
    lost = (contract.dataset, contract.binding.row_count) if contract.binding else None
    parts = []
    if contract.key:
        parts.append(_key_unique(df, contract.key, 0))
    if asked or lost:
        parts.append(_row_checks(df, asked, 1, lost))
    at = len(asked) + 2
    parts += [_reference(df, parents.get(k.references), k.columns, k.referenced, i, k.references, at + i) for i, k in enumerate(contract.foreign_keys)]
    if not parts:
        raise ContractError(f"{contract.dataset} declares nothing to check")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("at").drop("at")


def headline(results: DataFrame) -> DataFrame:
    """passed, failed, not_run: how the checks came out."""
    return results.agg(*[F.count_if(F.col("outcome") == o).alias(a) for o, a in (("PASS", "passed"), ("FAIL", "failed"), ("NOT RUN", "not_run"))])


def record(space: Workspace, dataset: str, results: DataFrame, at: datetime | None = None) -> None:
    """Append a run to the log: one row per check."""
    version = space._entry(dataset)["version"]
    rows = results.select(F.lit(dataset).alias("dataset"), F.lit(version).cast("int").alias("version"), "check_id", "outcome", "rows", "passed",
                          "failed", "not_checked", F.lit(at or datetime.now()).alias("at"))
    space.append("validations", rows)


def run_drift(space: Workspace, dataset: str) -> DataFrame:
    """check_id, before, now: checks whose failures differ between the last two runs."""
    order = Window.partitionBy("check_id").orderBy(F.col("at").desc())
    runs = space.log("validations").where(F.col("dataset") == dataset).withColumns(
        {"rn": F.row_number().over(order), "before": F.lead("failed").over(order)})
    return runs.where((F.col("rn") == 1) & F.col("before").isNotNull() & (F.col("before") != F.col("failed"))).select(
        "check_id", "before", F.col("failed").alias("now"))
