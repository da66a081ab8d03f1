"""Mixing sources to target weights by entropy balancing, as DataFrame operations.

Each document has a rate r: the expected number of its copies. Among all rates from 0 to `most` whose words per
source meet the targets, entropy balancing takes those nearest to 1 in relative entropy. Its convex dual has one
multiplier per source, and the rates are exponentially tilted: r = min(most, exp(multiplier * size / mean size)).
Newton steps over all sources at once solve it; a step that leaves the bracket found so far is halved into it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from grainwise.llm.common import ROW, F, Window, cut, row_of, whole_text, words_of

#: Relative error of a source's words at which its multiplier is settled, and the rounds tried at most.
SETTLED, ROUNDS = 1e-6, 60
#: Documents of one source and size numbered by one window.
PIECE_ROWS = 8192
#: Rounds in which one document of each source takes a copy more or less to close what rounding left open.
MENDS = 3


def word_sizes(df: DataFrame) -> DataFrame:
    """(doc_id, source, size): size is the number of words (null text: 0); with the rows' numbers where `numbered` gave them."""
    return df.select("doc_id", F.col("source").cast("string").alias("source"),
                     F.size(words_of(whole_text())).cast("long").alias("size"), *[c for c in df.columns if c == ROW])


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target, n): `share` of all sizes dealt by weight, at most `most` times a source's size.

    Sources by code point, null last, take the weights in turn. What a source cannot take is dealt again among
    the rest by weight. With the sources in order of most * size / weight, those that stop are the first ones, so
    running sums over the sources, a few rows of metadata, give the answer at once.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    per = per.withColumn("weight", F.get(F.lit([float(x) for x in weights]), (turn % len(weights)).cast("int")))
    level = (F.col("source_size") * most / F.col("weight"))
    upto = Window.orderBy("level", "source").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("level", "source").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    per = (per.withColumn("level", level)
           .withColumn("left", F.sum("source_size").over(every) * share
                       - most * F.coalesce(F.sum("source_size").over(upto), F.lit(0)))
           .withColumn("heavy", F.sum("weight").over(rest))
           .withColumn("stops", F.col("left") / F.col("heavy") >= F.col("level")))
    first = F.min(F.when(~F.col("stops"), F.struct("level", "source", (F.col("left") / F.col("heavy")).alias("rate")))).over(every)
    per = per.withColumn("rate", first.getField("rate"))
    full = F.col("source_size") * most
    return per.select("source", "source_size", "n",
                      F.when(F.col("rate").isNull() | (F.col("rate") * F.col("weight") >= full), full.cast("double"))
                      .otherwise(F.col("rate") * F.col("weight")).alias("target"))


def _rate(lam: Column, x: Column, most: float) -> Column:
    # Beyond this the rate is at its bound anyway, and exp stays finite.
    return F.least(F.lit(float(most)), F.exp(F.least(lam * x, F.lit(50.0))))


def solve(cells: DataFrame, goal: DataFrame, most: float) -> DataFrame:
    """(source, lam, unit): multipliers by safeguarded Newton steps; `cells` is (source, size, n).

    Rates depend on source and size alone, so every round sums over their counts, not over documents. A source
    whose target is its bound has every document at the bound.
    """
    full = F.col("target") >= F.col("source_size") * most * (1 - 1e-12)
    state = goal.select("source", "target", F.greatest(F.col("source_size") / F.col("n"), F.lit(1.0)).alias("unit"),
                        F.when(full, 1e9).otherwise(0.0).alias("lam"), F.when(full, 1e9).otherwise(-60.0).alias("low"),
                        F.when(full, 1e9).otherwise(60.0).alias("high"), F.lit(1.0).alias("off"))
    state = cut(state)
    x = F.col("size") / F.col("unit")
    r = _rate(F.col("lam"), x, most)
    free = F.when(r < most, F.col("n") * r * x * F.col("size")).otherwise(0.0)
    for _ in range(ROUNDS):
        sums = (cells.join(state, cells["source"].eqNullSafe(state["source"])).select(state["source"], "size", "n", "unit", "lam")
                .groupBy("source").agg(F.sum(F.col("n") * r * F.col("size")).alias("words"), F.sum(free).alias("slope")))
        near = state.join(sums.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        gap = F.col("words") - F.col("target")
        near = (near.withColumn("low", F.when(gap < 0, F.col("lam")).otherwise(F.col("low")))
                .withColumn("high", F.when(gap > 0, F.col("lam")).otherwise(F.col("high")))
                .withColumn("off", F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0)))
                .withColumn("newton", F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))))
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        step = F.when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        settled = (F.col("off") <= SETTLED) | (F.col("high") - F.col("low") < 1e-12)
        state = cut(near.select("source", "target", "unit", F.when(settled, F.col("lam")).otherwise(step).alias("lam"),
                                "low", "high", F.when(settled, 0.0).otherwise(F.col("off")).alias("off")))
        if (state.agg(F.max("off")).first()[0] or 0.0) == 0.0:
            break
    return state.select("source", "lam", "unit")


def copies(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), one row per row of `sizes`.

    Rates become whole copies by systematic rounding: a source's documents stand in order of size, and each
    takes the whole numbers its rate passes on the running sum. As neighbours are of near equal size, the words
    come near the target too; a few single documents then close the rest. Order within a size is by hash,
    so reruns agree. A document without words has rate 1. An empty table gives none.
    """
    rows = cut(sizes.select("doc_id", "source", "size", row_of(sizes).alias("row")))
    goal = cut(targets(rows, weights, share, most))
    cells = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    lam = solve(cells, goal, most)
    rate = _rate(F.col("lam"), F.col("size") / F.col("unit"), most)
    lam_of = lam.withColumnRenamed("source", "s")
    plan = cells.join(lam_of, F.col("source").eqNullSafe(F.col("s"))).withColumn("r", rate).drop("s", "lam", "unit")
    run = Window.partitionBy("source").orderBy("size")
    whole = F.floor("r")
    plan = (plan.withColumn("base", whole).withColumn("part", (F.col("r") - whole) * F.col("n"))
            .withColumn("upto", F.sum("part").over(run))
            .withColumn("more", F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - F.col("part") + 0.5))
            .withColumn("pieces", F.ceil(F.col("n") / PIECE_ROWS)).drop("part", "upto", "r"))
    plan = plan.withColumnRenamed("source", "s").withColumnRenamed("size", "z")
    mixed = F.xxhash64("doc_id", F.lit(7))
    laid = (rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
            .withColumn("piece", F.pmod(mixed, F.col("pieces"))))
    order = Window.partitionBy("source", "size", "piece").orderBy(mixed, "row")
    # A piece of a large group starts at its own offset, so that all pieces together make up `more`.
    i = F.row_number().over(order).cast("decimal(20,0)")
    start = F.pmod(F.xxhash64("piece"), F.col("n"))
    start = F.when(F.col("pieces") > 1, start).otherwise(F.lit(0)).cast("decimal(20,0)")
    hit = lambda k: F.floor((k * F.col("more") + start) / F.col("n"))
    laid = laid.withColumn("copies", (F.col("base") + hit(i) - hit(i - 1)).cast("int"))
    laid = cut(laid.select("doc_id", "source", "size", "row", "copies"))
    return _mended(laid, goal, most)


def _mended(laid: DataFrame, goal: DataFrame, most: int) -> DataFrame:
    """Copies with the rounding's rest closed: in each round a source's best fitting document takes one more or less."""
    goal_of = goal.withColumnRenamed("source", "s")
    same = F.col("source").eqNullSafe(F.col("s"))
    gap = cut(laid.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("words"))
              .join(goal_of, same).select("source", (F.col("target") - F.col("words")).alias("gap")))
    done = None
    for _ in range(MENDS):
        moves, wish = laid.where("size > 0"), gap.withColumnRenamed("source", "s")
        if done is not None:
            moves = moves.join(done.select("row"), "row", "left_anti")
        up = F.col("gap") > 0
        fits = (F.col("size") <= F.abs("gap")) & F.when(up, F.col("copies") < most).otherwise(F.col("copies") > 0)
        best = cut(moves.join(wish, same).where(fits).groupBy("source", "gap")
                   .agg(F.max(F.struct("size", F.xxhash64("doc_id").alias("h"), "row")).alias("x"))
                   .select("source", "x.row", "x.size", F.when(up, 1).otherwise(-1).alias("delta")))
        done = best if done is None else done.unionByName(best)
        gap = (gap.join(best.select(F.col("source").alias("s"), "size", "delta"), same, "left")
               .select("source", (F.col("gap") - F.coalesce(F.col("size") * F.col("delta"), F.lit(0))).alias("gap")))
    return (laid.join(done.select("row", "delta"), "row", "left").join(goal_of, same)
            .select("doc_id", "source", "size", "row", "source_size", "target",
                    (F.col("copies") + F.coalesce("delta", F.lit(0))).cast("int").alias("copies")))


def op10_entropy(df: DataFrame) -> DataFrame:
    return copies(word_sizes(df)).select("doc_id", "size", "source_size", "target",
                                         (F.col("copies") * F.col("size")).cast("long").alias("taken"))
