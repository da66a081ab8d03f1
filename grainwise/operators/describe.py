"""Tier 1: what the analysed rows hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.contract import is_number, is_whole
from grainwise.errors import NotPossible, ParamsInvalid
from grainwise.functions.exprs import (
    count_where, declared, finite, finite_value, quoted, ranked, ratio, type_of)
from grainwise.functions.ranks import quantiles
from grainwise.operators.common import (
    cap_groups, combinable, mergeable, share_of, totals, valued)
from grainwise.registry import analysis
from grainwise.scope import ScopedFrame
from grainwise.session import cut

# The quantiles a distribution reports.
QUANTILES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)
MAX_BINS = 50


@analysis("summary_stats", 1, "Every declared measure over the analysed rows.")
def summary_stats(scope: ScopedFrame) -> DataFrame:
    """One row per measure. Measures of one grain share a scan; a per-unit measure has its own."""
    grains: dict[tuple, list] = {}
    for m in scope.contract.measures:
        grains.setdefault(m.per, []).append(m)
    out = None
    for per, measures in grains.items():
        unit = scope
        frame = scope.frame
        if per:
            for m in measures:
                unit = scope.per_unit(m, [], [])
                out = _append(out, _statistics(unit.frame, [m]))
            continue
        rows = scope.held(_statistics(scope.entering(frame), measures), F.max(F.col("n") + F.col("nulls")))
        out = _append(out, rows)
    return out


def _append(out: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if out is None else out.unionByName(more)


def _statistics(frame: DataFrame, measures) -> DataFrame:
    """Measures that read one column share its statistics, so each is aggregated and ranked once."""
    nothing = F.lit(None).cast("double")
    names = ("n", "min", "max", "mean", "stddev")
    aggregates, rows, shared, numbers = [F.count(F.lit(1)).alias("rows")], [], {}, {}
    for i, m in enumerate(measures):
        if m.is_ratio:
            parts = [F.col(quoted(f"{m.name}__n")), F.col(quoted(f"{m.name}__d"))]
            stats = [F.count(F.when(parts[0].isNotNull() & parts[1].isNotNull(), 1)), *[nothing] * 4]
            source = f"ratio {i}"
        else:
            source = m.name if m.compare else (m.column or m.name)
            number = is_number(type_of(frame, m.name)) and m.agg is not None
            v = finite_value(frame, m.name) if number else nothing
            stats = [F.count(F.col(quoted(m.name))), F.min(v), F.max(v), F.avg(v), F.stddev_samp(v)]
            if number:
                numbers.setdefault(source, m)
        if source not in shared:
            shared[source] = i
            aggregates += [s.cast("long" if k == "n" else "double").alias(f"{k}_{i}") for k, s in zip(names, stats)]
        at = shared[source]
        # A mean is already there and a median is ranked below; other totals are their own aggregate.
        ready = f"mean_{at}" if m.agg == "mean" else None
        if ready is None:
            bare = nothing if m.agg in (None, "none", "median") and not m.is_ratio else declared(frame, m)
            aggregates.append(bare.cast("double").alias(f"total_{i}"))
        rows.append(F.struct(
            F.lit(m.name).alias("measure"), F.lit("ratio" if m.is_ratio else m.agg).alias("agg"), F.col(f"n_{at}").alias("n"),
            (F.col("rows") - F.col(f"n_{at}")).alias("nulls"), F.col(ready or f"total_{i}").alias("total"),
            *[F.col(f"{k}_{at}").alias(k) for k in names[1:]], F.lit(source).alias("__source")))
    one = frame.agg(*aggregates)
    result = one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    return _with_medians(result, frame, numbers).select(
        "measure", "agg", "n", "nulls", "total", "min", "max", "mean", "median", "stddev")


def _with_medians(result: DataFrame, frame: DataFrame, numbers: dict) -> DataFrame:
    """`median` and the totals of medians. One ranked pass serves every source: the source is the group."""
    if not numbers:
        return result.withColumn("median", F.lit(None).cast("double"))
    cells = [F.when(finite(frame, m.name), F.struct(F.lit(source).alias("__source"), finite_value(frame, m.name).alias("v")))
             for source, m in numbers.items()]
    values = frame.select(F.explode(F.array_compact(F.array(*cells))).alias("s")).select("s.*")
    medians = quantiles(values, "v", [0.5], ("__source",)).select("__source", F.col("q")[0].alias("median"))
    total = F.when(F.col("agg") == "median", F.col("median")).otherwise(F.col("total"))
    return result.join(medians, "__source", "left").withColumn("total", total)


@analysis("frequency", 1, "Rows and share per value of a column.", selects=False)
def frequency(scope: ScopedFrame, column: str, limit: int = 20) -> DataFrame:
    """The commonest values, NULL among them, with the ties the cut leaves behind."""
    if limit < 1:
        raise ParamsInvalid(f"limit must be at least 1; got {limit}")
    named = set(scope.contract.dimensions) | {m.name for m in scope.contract.measures}
    if column not in named:
        raise NotPossible(f"{column} is neither a declared dimension nor a declared measure")
    # Written once: the share reads the groups again, not the table.
    counted = scope.entering(scope.frame).groupBy(F.col(quoted(column)).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    counted = cut(scope.held(counted, F.sum("rows")))
    whole = counted.agg(F.sum("rows").alias("n")).scalar()
    top = counted.orderBy(*ranked("rows", "value")).limit(limit)
    return top.withColumn("share", ratio(F.col("rows"), whole))


def frequency_rest(scope: ScopedFrame, column: str, limit: int = 20) -> DataFrame:
    """One row on what `frequency` does not show: values and rows shown and left, and the values tied with the last one shown."""
    counted = cut(scope.frame.groupBy(F.col(quoted(column)).alias("member")).agg(F.count(F.lit(1)).alias("rows")))
    top = counted.orderBy(*ranked("rows", "member")).limit(limit).agg(F.count(F.lit(1)).alias("shown"), F.coalesce(F.sum("rows"), F.lit(0)).alias("shown_rows"))
    whole = counted.agg(F.count(F.lit(1)).alias("values"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    shown, shown_rows = top.select("shown").scalar(), top.select("shown_rows").scalar()
    ties = tied_at_cut(counted, "rows", limit)
    return whole.select(shown.alias("shown"), shown_rows.alias("shown_rows"), (F.col("values") - shown).alias("values_left"), (F.col("rows") - shown_rows).alias("rows_left"),
                        ties.select("tied").scalar().alias("tied"), F.coalesce(ties.select("left_out").scalar(), F.lit(0)).alias("tied_left_out"))


def top_n_joint(scope: ScopedFrame, dimension: str, measure: str, n: int = 10) -> DataFrame:
    """One row: how many groups `top_n` shows, of how many, and what they hold together, where a share means anything."""
    grouped, m = ranked_groups(scope, dimension, measure)
    grouped = cut(grouped)
    top = grouped.orderBy(*ranked("value", "member")).limit(n).withColumn("share", share_of(grouped, "value", m))
    return top.agg(F.count(F.lit(1)).alias("shown"), F.sum("rows").alias("rows"), F.sum("share").alias("joint_share")).withColumn(
        "groups", grouped.agg(F.count(F.lit(1))).scalar())


def tied_at_cut(ranked_rows: DataFrame, value: str, n: int) -> DataFrame:
    """How many groups share the value at position n, and how many of them the cut leaves out."""
    top = ranked_rows.orderBy(*ranked(value, "member")).limit(n)
    edge = top.agg(F.min(value).alias("edge"), F.count(F.lit(1)).alias("shown"))
    bar = edge.select("edge").scalar()
    inside = top.where(F.col(value) == bar).agg(F.count(F.lit(1)).alias("n")).scalar()
    return (ranked_rows.where(F.col(value) == bar)
            .agg(F.count(F.lit(1)).alias("tied"), F.max(F.col(value).cast("double")).alias("at_value"))
            .withColumn("left_out", F.col("tied") - inside))


@analysis("top_n", 1, "The largest groups of a dimension by a measure.", narrows=True)
def top_n(scope: ScopedFrame, dimension: str, measure: str, n: int = 10) -> DataFrame:
    if n < 1:
        raise ParamsInvalid(f"n must be at least 1; got {n}")
    grouped, m = ranked_groups(scope, dimension, measure)
    grouped = cut(scope.held(grouped, F.sum("rows")))
    top = grouped.orderBy(*ranked("value", "member")).limit(n)
    shared = top.withColumn("share", share_of(grouped, "value", m))
    from pyspark.sql import Window
    place = F.row_number().over(Window.orderBy(*ranked("value", "member")))  # at most n rows
    return shared.select(F.col("member"), F.col("value").alias("total"), "rows", "share",
                         place.alias("rank"))


def top_n_ties(scope: ScopedFrame, dimension: str, measure: str, n: int = 10) -> DataFrame:
    """The ties at the cut of `top_n`."""
    grouped, _ = ranked_groups(scope, dimension, measure)
    return tied_at_cut(cut(grouped), "value", n)


def ranked_groups(scope: ScopedFrame, dimension: str, measure: str):
    """(member, value, rows) per group of a dimension, over units when the measure has one."""
    scope.contract.dimension(dimension)
    m = combinable(scope, measure)
    unit = scope.per_unit(m, [dimension])
    grouped = totals(unit.entering(unit.frame), m, [F.col(quoted(dimension))], ["member"])
    return grouped, m


@analysis("distribution", 1, "Equal-width bins of a measure, with shares.")
def distribution(scope: ScopedFrame, measure: str, bins: int = 10) -> DataFrame:
    """Edges come from one aggregate row; the counts from one more pass with literal edges."""
    if isinstance(bins, bool) or not isinstance(bins, int) or not 2 <= bins <= MAX_BINS:
        raise ParamsInvalid(f"bins must be a whole number from 2 to {MAX_BINS}; got {bins!r}")
    m = valued(scope, measure)
    unit = scope.per_unit(m, [])
    frame = unit.entering(unit.frame, ~finite(unit.frame, measure))
    kind = type_of(frame, measure)
    if not is_number(kind):
        raise NotPossible(f"{measure} is {kind.simpleString()}, so there is nothing to bin")
    whole = is_whole(kind)
    value = F.col(quoted(measure)) if whole else finite_value(frame, measure)
    row = frame.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    edges = bin_edges(row["lo"], row["hi"], bins, whole)
    held = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        upper = value <= F.lit(hi) if i == len(edges) - 2 else value < F.lit(hi)
        held.append(count_where((value >= F.lit(lo)) & upper).alias(f"b{i}"))
    if not held:
        held = [F.lit(0).alias("b0")]
        edges = [None, None]
    counted = frame.agg(*held)
    slots = [F.struct(F.lit(i + 1).alias("bin"), F.lit(edges[i]).cast("double").alias("lo"),
                      F.lit(edges[i + 1]).cast("double").alias("hi"), F.col(f"b{i}").alias("rows"))
             for i in range(len(held))]
    total = sum((F.col(f"b{i}") for i in range(len(held))), F.lit(0))
    running = [sum((F.col(f"b{j}") for j in range(i + 1)), F.lit(0)) for i in range(len(held))]
    counted = unit.held(counted, F.sum(total))
    opened = counted.select(F.explode(F.array(*[
        s.withField("share", ratio(F.col(f"b{i}"), total)).withField("cumulative", ratio(running[i], total))
        for i, s in enumerate(slots)])).alias("s"))
    return opened.select("s.*").where(F.col("lo").isNotNull())


def bin_edges(lo, hi, bins: int, whole: bool) -> list:
    """Edges of equal-width bins; whole numbers get whole widths and a narrower last bin."""
    if lo is None:
        return []
    if whole:
        lo, hi = int(lo), int(hi)
        width = -(-(hi - lo + 1) // bins)
        count = -(-(hi - lo + 1) // width)
        return [lo + i * width for i in range(count)] + [hi]
    return [lo] + [lo + (hi - lo) * i / bins for i in range(1, bins)] + [hi]


def distribution_quantiles(scope: ScopedFrame, measure: str) -> DataFrame:
    """The seven quantiles of a measure's finite values, as (prob, value) rows."""
    m = valued(scope, measure)
    unit = scope.per_unit(m, [])
    values = unit.frame.select(finite_value(unit.frame, measure).alias("v"))
    q = quantiles(values, "v", list(QUANTILES))
    points = F.array(*[F.struct(F.lit(p).alias("prob"), F.col("q")[i].alias("value"))
                       for i, p in enumerate(QUANTILES)])
    return q.select(F.explode(points).alias("s")).select("s.*")


@analysis("cross_tab", 1, "Counts or a measure for each pair of two dimensions, with margins.")
def cross_tab(scope: ScopedFrame, rows: str, columns: str, measure: str | None = None) -> DataFrame:
    """Long form. Margins come from rows, not from cells: mergeable parts are rolled up, and a
    measure that has none (a median, a distinct count) is aggregated again from its rows."""
    for d in (rows, columns):
        scope.contract.dimension(d)
    if rows == columns:
        raise ParamsInvalid("rows and columns are the same dimension")
    m = combinable(scope, measure) if measure else None
    unit = scope.per_unit(m, [rows, columns]) if m else scope
    frame = unit.entering(unit.frame).select("*", F.col(quoted(rows)).alias("row_member"),
                              F.col(quoted(columns)).alias("column_member"))
    parts = mergeable(frame, m) if m else ([], None)
    sets = [["row_member", "column_member"], ["row_member"], ["column_member"], []]
    both = ["row_member", "column_member"]
    counted = F.count(F.lit(1)).alias("__rows")
    if parts is not None:
        cells = frame.groupBy(*both).agg(counted, *parts[0])
        value = parts[1] if m else F.sum("__rows")
        rolled = cells.groupingSets(sets, *both).agg(
            value.alias("value"), F.sum("__rows").alias("rows"), *_margins())
    elif m.agg == "count_distinct":
        # Each value is kept once a cell before the sets are expanded.
        c = F.col(quoted(m.name))
        cells = frame.groupBy(*both, c.alias("__v")).agg(counted)
        rolled = cells.groupingSets(sets, *both).agg(
            F.count_distinct("__v").alias("value"), F.sum("__rows").alias("rows"), *_margins())
    elif m.agg == "median":
        rolled = _ranked_cells(frame, m, both)
    else:
        rolled = frame.groupingSets(sets, *both).agg(
            declared(frame, m).alias("value"), F.count(F.lit(1)).alias("rows"), *_margins())
    cell = ~F.col("is_row_total") & ~F.col("is_column_total")
    return unit.held(rolled, F.sum(F.when(cell, F.col("rows")))).select(*both, "value", "rows", "is_row_total", "is_column_total")


def cross_tab_wide(scope: ScopedFrame, rows: str, columns: str, measure: str | None = None) -> DataFrame:
    """A row per member of `rows` with a column per member of `columns`, named by it; refused beyond MAX_GROUPS columns.

    The members are counted before anything is aggregated; a cell no row falls in is NULL.
    """
    members = cap_groups(scope.frame.select(F.col(quoted(columns)).alias("m")).distinct(), columns)
    cells = cross_tab(scope, rows, columns, measure).where("NOT is_row_total AND NOT is_column_total")
    own = [F.max(F.when(F.col("column_member").eqNullSafe(F.lit(m)), F.col("value"))).alias("(none)" if m is None else str(m)) for m in members]
    return cells.groupBy("row_member").agg(*own)


def _ranked_cells(frame: DataFrame, m, both: list[str]) -> DataFrame:
    """Medians of cells and margins by ranked values. The values of the cells are counted and written once."""
    counts = cut(frame.groupBy(*both, finite_value(frame, m.name).alias("__v")).agg(F.count(F.lit(1)).alias("__rows")))
    out = None
    for by in (tuple(both), (both[0],), (both[1],), ()):
        q = quantiles(counts, "__v", [0.5], by, "__rows")
        n = counts.groupBy(*by).agg(F.sum("__rows").alias("rows"))
        same = F.lit(True)
        for b in by:
            same = same & n[b].eqNullSafe(q[b])
        kinds = {b: counts.schema[b].dataType for b in both}
        one = n.join(q, same, "left").select(
            *[(n[b] if b in by else F.lit(None).cast(kinds[b])).alias(b) for b in both], F.col("q")[0].alias("value"), "rows",
            F.lit(both[1] not in by).alias("is_row_total"), F.lit(both[0] not in by).alias("is_column_total"))
        out = one if out is None else out.unionByName(one)
    return out


def _margins():
    return [(F.grouping("column_member") == 1).alias("is_row_total"),
            (F.grouping("row_member") == 1).alias("is_column_total")]
