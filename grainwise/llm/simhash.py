"""SimHash near duplicates by tiled exact comparison.

Texts are hashed where they are read; only 64-bit fingerprints move. Distinct fingerprints are laid out in tiles by
their number of set bits, and only tiles whose counts are within the radius meet. Inside a pair of tiles numpy
compares blocks by exclusive-or and bit counts, and skips blocks whose counts of upper and lower half rule a link
out. A pair of tiles hands on a spanning forest of its links, never all pairs, so large groups stay linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from grainwise.llm.common import F, components, cut, row_of, shuffle_width

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a tile, about; and of a block inside a pair of tiles.
TILE, BLOCK = 32_768, 1_024


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Majority of the XXH64 bits of all k-word shingles of the text with A-Z lowered; 0 where it has no words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(k, n)
    hash_of = xxhash.xxh64_intdigest
    spans = zip(starts[: n - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)
    hashes = np.array([hash_of(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, row, fp): one row per row of `df`; row as in row_of, fp is the fingerprint's 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, k) for t in b.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "row", "fp"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), row_of(df).alias("row"),
                     F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, fp long")


def _links(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in a and b of the pairs within the radius, block by block. Both are sorted by the count of the upper half."""
    def halves(x):
        return (x >> np.uint64(32)).astype(np.uint32), x.astype(np.uint32)

    (ah, al), (bh, bl) = halves(a), halves(b)
    counts = [np.bitwise_count(x).astype(np.int64) for x in (ah, al, bh, bl)]
    for i in range(0, len(a), BLOCK):
        s = slice(i, i + BLOCK)
        for j in range(0, len(b), BLOCK):
            t = slice(j, j + BLOCK)
            apart = 0
            for x, y in ((counts[0][s], counts[2][t]), (counts[1][s], counts[3][t])):
                apart += max(0, x.min() - y.max(), y.min() - x.max())
            if apart > radius:
                continue
            near = np.bitwise_count(ah[s, None] ^ bh[None, t]) <= radius
            p, q = np.divmod(np.flatnonzero(near), near.shape[1])
            ok = np.bitwise_count(a[s][p] ^ b[t][q]) <= radius
            if ok.any():
                yield p[ok] + i, q[ok] + j


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For n nodes in ascending order, the first node of each one's group."""
    top = np.arange(n)
    for p, q in pairs:
        while True:
            x, y = top[p], top[q]
            low, high = np.minimum(x, y), np.maximum(x, y)
            if (low == high).all():
                break
            np.minimum.at(top, high, low)
            while (top[top] != top).any():
                top = top[top]
    return top


def links(uniq: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): pairs of nodes that span every group of linked fingerprints; `uniq` is (fp, node), fp distinct.

    What reaches the driver is one count for each of the 65 numbers of set bits.
    """
    uniq = uniq.withColumn("pop", F.bit_count("fp"))
    counts = {r["pop"]: r["count"] for r in uniq.groupBy("pop").count().collect()}
    parts = [ceil(counts.get(p, 0) / tile) for p in range(65 + radius)]
    slot = F.pmod(F.xxhash64("fp"), F.greatest(F.get(F.lit(parts), F.col("pop")), F.lit(1))).cast("int")
    tiles = cut(uniq.withColumn("slot", slot).groupBy("pop", "slot")
                .agg(F.collect_list(F.struct(F.bit_count(F.shiftrightunsigned("fp", 32)).alias("up"), "fp", "node")).alias("rows"))
                .select("pop", "slot", F.sort_array("rows").alias("rows"))
                .select("pop", "slot", F.col("rows.fp").alias("fp"), F.col("rows.node").alias("node")))
    names = [(p, s) for p in range(65) for s in range(parts[p])]
    order = {name: i for i, name in enumerate(names)}
    number = F.get(F.lit([order.get((p, 0), 0) for p in range(65)]), F.col("pop")) + F.col("slot")
    # A tile meets itself, the later tiles of its count, and those of the next `radius` counts.
    last = [max([order[x] for x in names if x[0] <= p + radius], default=0) for p in range(65)]
    first = [min([order[x] for x in names if x[0] >= p - radius], default=0) for p in range(65)]
    tiles = tiles.withColumn("me", number)
    width = max(shuffle_width(uniq.sparkSession), min(len(names) * (radius + 1), 4 * shuffle_width(uniq.sparkSession)))
    left = tiles.select(F.col("me").alias("l"), F.explode(F.sequence("me", F.get(F.lit(last), F.col("pop")))).alias("r"),
                        F.col("fp").alias("fa"), F.col("node").alias("na")).repartition(width, "l", "r")
    right = tiles.select(F.explode(F.sequence(F.get(F.lit(first), F.col("pop")), F.col("me"))).alias("l"), F.col("me").alias("r"),
                         F.col("fp").alias("fb"), F.col("node").alias("nb")).repartition(width, "l", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                l, r, fa, na, fb, nb = (batch.column(c)[i] for c in range(6))
                fa, na, fb, nb = (x.values.to_numpy(zero_copy_only=False) for x in (fa, na, fb, nb))
                same = l.as_py() == r.as_py()
                nodes, back = np.unique(na if same else np.concatenate((na, nb)), return_inverse=True)
                at = back[: len(na)]
                bt = at if same else back[len(na):]
                found = ((at[p], bt[q]) for p, q in _links(fa.view(np.uint64), fb.view(np.uint64), radius))
                top = _forest(len(nodes), found)
                tied = np.flatnonzero(top != np.arange(len(nodes)))
                if len(tied):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[top[tied]])], ["a", "b"])

    met = left.join(right, ["l", "r"]).select("l", "r", "fa", "na", "fb", "nb")
    return met.mapInArrow(run, "a long, b long")


def near_groups(df: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(row, doc_id, fp, component_id), one row per row of `df`.

    Documents link when their fingerprints differ in at most `radius` bits; component_id is the smallest doc_id
    reachable. A null or empty text has fingerprint 0 and is linked like any other; a null doc_id joins a group
    but never names it (a group of null ids alone has a null component). An empty table gives none.
    """
    fps = cut(fingerprints(df, k))
    uniq = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    named = uniq.where("node is not null")
    found = components(links(named, radius))
    of_fp = (uniq.join(found, "node", "left")
             .select(F.col("fp"), F.coalesce("component", "node").alias("component_id")))
    return fps.join(of_fp, "fp").select("row", "doc_id", "fp", "component_id")


def op6_simhash(df: DataFrame) -> DataFrame:
    return near_groups(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
