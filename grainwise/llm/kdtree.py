"""Sharding by a k-d tree: nodes are halved at weighted medians along their widest metadata dimension.

Built-in functions only. A node's cut is found by narrowing bins of one ordered key, all nodes of a level
together, so a level costs a few aggregates over the metadata whatever the size of the nodes.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import ceil

from pyspark.sql import Column, DataFrame

from grainwise.llm.common import F, Window, cut, whole_text

#: Bits of a row's place along the dimension, of its hash, and of its number within the written table.
DIM_BITS, HASH_BITS, ROW_BITS = 30, 18, 14
BIN_BITS = 12
#: Rows numbered by one window; larger shards are numbered in so many pieces more.
PIECE_ROWS = 20_000


def ordinal(text: Column) -> Column:
    """A string's first seven bytes as a number that sorts as they do; null sorts first."""
    return F.coalesce(F.conv(F.rpad(F.substring(F.hex(text.cast("string")), 1, 14), 14, "0"), 16, 10).cast("double"),
                      F.lit(-1.0))


def shards(df: DataFrame, dims: Mapping[str, Column], size: Column, keep: list[Column], identity: list[Column],
           count: int | None = None, target_bytes: int | None = None, tolerance: float = 0.0005) -> DataFrame:
    """The `keep` columns with size, shard (from 0) and slot (gapless from 0 within its shard).

    Either `count` shards or as many as hold `target_bytes` each. Shard sums of `size` differ from their mean
    by `tolerance` of it, or by about one row where rows are larger than that. `dims` are the metadata
    dimensions, cast to double (null: -1). Rows equal in every dimension are dealt by a hash of `identity`,
    repeated rows by their number, so a hot value or copy is split like anything else. An empty table gives none.
    """
    names = list(dims)
    rows = df.select(*keep, size.cast("long").alias("size"), F.xxhash64(*identity).alias("__h"),
                     F.monotonically_increasing_id().alias("__r"),
                     *[F.coalesce(dims[d].cast("double"), F.lit(-1.0)).alias(f"__d{i}") for i, d in enumerate(names)])
    rows = cut(rows)
    node = [F.min(f"__d{i}").alias(f"lo{i}") for i in range(len(names))] + [
        F.max(f"__d{i}").alias(f"hi{i}") for i in range(len(names))] + [F.sum("size").alias("w"), F.count("*").alias("n")]
    whole = rows.agg(*node).first()
    if count is None:
        count = max(1, ceil((whole["w"] or 0) / (target_bytes or 1)))
    at, width = rows.withColumn("__node", F.lit(0)), {0: count}
    while whole["n"] and any(c > 1 for c in width.values()):
        at, width = _level(at, width, node, whole, len(names), count, tolerance)
    return _numbered(at.withColumnRenamed("__node", "shard"), whole["n"], count)


def _level(at: DataFrame, width: dict[int, int], node: list[Column], whole, dims: int, count: int, tolerance: float):
    """Cut every node of more than one shard; nodes are named by their first shard. The driver holds one row a node."""
    stats = {r["__node"]: r for r in at.groupBy("__node").agg(*node).collect()}
    lo, scale, dim = [0.0] * count, [0.0] * count, [0] * count
    left, goal = [0] * count, {}
    for first, r in stats.items():
        spread = [(r[f"hi{i}"] - r[f"lo{i}"]) / max(whole[f"hi{i}"] - whole[f"lo{i}"], 1e-300) for i in range(dims)]
        dim[first] = spread.index(max(spread))
        lo[first] = r[f"lo{dim[first]}"]
        range_ = r[f"hi{dim[first]}"] - lo[first]
        scale[first] = ((1 << DIM_BITS) - 1) / range_ if range_ > 0 else 0.0
        if width[first] > 1:
            left[first] = width[first] // 2
            goal[first] = r["w"] * left[first] / width[first]
    here = F.col("__node")
    of = lambda values: F.get(F.lit(values), here)
    along = F.get(F.array(*[F.col(f"__d{i}") for i in range(dims)]), of(dim))
    spot = F.least(F.floor((along - of(lo)) * of(scale)), F.lit((1 << DIM_BITS) - 1)).cast("long")
    key = (F.shiftleft(spot, HASH_BITS + ROW_BITS)
           + F.shiftleft(F.col("__h").bitwiseAND((1 << HASH_BITS) - 1), ROW_BITS)
           + F.xxhash64("__r").bitwiseAND((1 << ROW_BITS) - 1))
    at = at.withColumn("__key", key)
    total = DIM_BITS + HASH_BITS + ROW_BITS
    prefix, below, ends = dict.fromkeys(goal, 0), dict.fromkeys(goal, 0.0), [(1 << 62)] * count
    shift, open_ = total, set(goal)
    while open_:
        step = min(BIN_BITS, shift)
        shift -= step
        wanted = F.get(F.lit([prefix.get(i, 0) if i in open_ else -1 for i in range(count)]), here)
        bins = (at.withColumn("__bin", F.when(F.shiftright("__key", shift + step) == wanted,
                                              F.shiftright("__key", shift).bitwiseAND((1 << step) - 1)))
                .groupBy("__node", "__bin").agg(F.sum("size").alias("w"), F.count("*").alias("n")).where("__bin is not null"))
        running = F.sum("w").over(Window.partitionBy("__node").orderBy("__bin"))
        short = F.get(F.lit([float(goal[i] - below[i]) if i in goal else 0.0 for i in range(count)]), here)
        hit = (bins.withColumn("upto", running).where(F.col("upto") >= short - 1e-6)
               .groupBy("__node").agg(F.min(F.struct("__bin", "w", "upto", "n")).alias("x")).select("__node", "x.*"))
        for r in hit.collect():
            i, before = r["__node"], below[r["__node"]] + r["upto"] - r["w"]
            prefix[i], below[i] = (prefix[i] << step) + r["__bin"], before
            if r["w"] <= goal[i] / left[i] * tolerance or r["n"] == 1 or shift == 0:
                nearer = goal[i] - before > before + r["w"] - goal[i]
                ends[i] = ((prefix[i] + (1 if nearer else 0)) << shift) - 1
                open_.discard(i)
    moved = F.when((of(left) > 0) & (F.col("__key") > of(ends)), here + of(left)).otherwise(here)
    new = {}
    for first, n in width.items():
        half = n // 2
        new |= {first: half, first + half: n - half} if n > 1 else {first: n}
    # Written, as a node's expression would hold those of all levels above many times over.
    return cut(at.withColumn("__node", moved).drop("__key")), new


def _numbered(at: DataFrame, rows: int, count: int) -> DataFrame:
    """slot: pieces of a shard are numbered side by side and lifted by the pieces before them."""
    pieces = max(1, ceil(rows / (count * PIECE_ROWS)))
    at = at.withColumn("__piece", F.pmod(F.col("__h"), F.lit(pieces)))
    ahead = Window.partitionBy("shard").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    lift = (at.groupBy("shard", "__piece").agg(F.count("*").alias("n"))
            .select("shard", "__piece", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__lift")))
    rank = F.row_number().over(Window.partitionBy("shard", "__piece").orderBy("__h", "__r"))
    out = at.withColumn("__rank", rank).join(lift, ["shard", "__piece"])
    own = [c for c in at.columns if not c.startswith("__")]
    return out.select(*own, (F.col("__lift") + F.col("__rank") - 1).cast("long").alias("slot"))


def document_shards(df: DataFrame, count: int | None, keep: list[Column], target_bytes: int | None = None) -> DataFrame:
    """Documents over `count` shards, or of `target_bytes`, of near equal bytes: UTF-8 bytes of the text (null: none) plus 8.

    Dimensions: id, size, source and language.
    """
    size = F.octet_length(whole_text()) + 8
    dims = {"id": F.col("doc_id"), "size": size, "source": ordinal(F.col("source")), "lang": ordinal(F.col("lang"))}
    return shards(df, dims, size, keep, [F.col("doc_id"), whole_text()], count, target_bytes)


def op2_kdtree(df: DataFrame, count: int = 24) -> DataFrame:
    crc = F.crc32(whole_text().cast("binary")).alias("text_crc32")
    out = document_shards(df, count, [F.col("doc_id"), crc])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
