"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Vectors are sorted by label and by their place on a Hilbert curve through their widest dimensions, and written as Parquet blocks of
BLOCK rows, each with the least and greatest value of every dimension (its zone map). Anchors lie in tiles of the same order. Interval
arithmetic over a zone map bounds every score an anchor can have in a block, so a tile goes only to the groups of blocks, and an
anchor reads only the blocks, in which its windows (or its nearest rows) can lie. A task loads one group of blocks and lets the
tiles stream past it; what leaves it are the first few rows per window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from grainwise.llm.common import F, Window, cut, shuffle_width

#: Rows of a block, anchors of a tile, and bytes of vectors in a group of blocks (what a task holds).
BLOCK, TILE, GROUP_BYTES = 1_024, 256, 32 << 20
#: Least rows of a group, so small tables are not dealt into crumbs.
LEAST_ROWS = 4_096
#: Dimensions of the curve and bits of each.
CURVE_DIMS, CURVE_BITS = 7, 9
#: Below this every sum of products is exact in double precision; above it, in the long double's 64 bits.
EXACT = float(1 << 53)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of the rows of `cells` (n x d, non-negative ints of `bits` bits), d * bits at most 63.

    From the top bit down, each bit plane of a row is its Gray-coded corner of the current cube, and the cube's own rotation and
    reflection are undone for the bits below (the transposed form of Skilling, 2004).
    """
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for bit in range(bits - 1, 0, -1):
        under = (1 << bit) - 1
        for i in range(d):
            turned = (x[i] >> bit & 1).astype(bool)
            swap = np.where(turned, 0, (x[0] ^ x[i]) & under)
            x[0] ^= np.where(turned, under, swap)
            if i:
                x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= flip
    place = np.zeros_like(flip)
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            place = place << 1 | (x[i] >> bit & 1)
    return place


@dataclass(frozen=True)
class Layout:
    """What one pass over the vectors says: rows, dimensions, the largest magnitude, and the curve's dimensions with their ranges."""

    rows: int
    dims: int
    largest: float
    axes: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]

    @property
    def kind(self) -> type:
        """Of scores: exact over the sums that can come up, to a long's range."""
        return np.float64 if self.largest ** 2 * max(self.dims, 1) < EXACT else np.longdouble

    @property
    def dtype(self) -> np.dtype:
        """Of stored components."""
        return np.dtype(np.int16 if self.largest < 1 << 15 else np.int32 if self.largest < 1 << 31 else np.float64)


def vectors(df: DataFrame, scale: float = 256.0) -> DataFrame:
    """(id, label, q): the rows that take part, components as floor(scale * x).

    Rows with a null id, label or vector, or with a null or non-finite component, take no part.
    """
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.floor(v * F.lit(scale)).cast("double"))
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    return (df.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(whole)
            .select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), x.alias("q")))


def _dense(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as a matrix; shorter vectors count as zero beyond their end."""
    at = column.offsets.to_numpy().astype(np.int64)
    flat, size = column.flatten().to_numpy(zero_copy_only=False), np.diff(at)
    if len(size) and (size == dims).all():
        return flat.reshape(len(size), dims)
    out = np.zeros((len(size), dims))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(at[:-1] - at[0], size)] = flat
    return out


def measure(rows: DataFrame) -> Layout:
    """Ranges of the dimensions, summed by batch where the rows are; one row a dimension reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, total, square = 0, np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0)
        for b in batches:
            if not b.num_rows:
                continue
            width = max(len(low), int(np.diff(b.column(0).offsets.to_numpy()).max()))
            more = width - len(low)
            low, high, total, square = (np.pad(a, (0, more)) for a in (low, high, total, square))
            m = _dense(b.column(0), width)
            n += len(m)
            if width:
                low, high = np.minimum(low, m.min(0)), np.maximum(high, m.max(0))
                total, square = total + m.sum(0), square + (m * m).sum(0)
        cells = [np.arange(-1, len(low)), np.concatenate(([n], np.full(len(low), n)))]
        cells += [np.concatenate(([0.0], a)) for a in (low, high, total, square)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["dim", "n", "low", "high", "total", "square"])

    parts = rows.select("q").mapInArrow(run, "dim long, n long, low double, high double, total double, square double")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
                                     F.sum("total").alias("total"), F.sum("square").alias("square")).orderBy("dim").collect()
    n, dims = found[0]["n"] if found else 0, found[1:]
    spread = {r["dim"]: r["square"] / max(n, 1) - (r["total"] / max(n, 1)) ** 2 for r in dims}
    axes = tuple(sorted(sorted(spread, key=lambda d: (-spread[d], d))[:CURVE_DIMS]))
    return Layout(n, len(dims), max((max(-r["low"], r["high"]) for r in dims), default=0.0), axes,
                  tuple(dims[a]["low"] for a in axes), tuple(dims[a]["high"] for a in axes))


def _placed(rows: DataFrame, layout: Layout) -> DataFrame:
    """`rows` with their place on the curve."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, cells = np.array(layout.low), np.array(layout.high), (1 << CURVE_BITS) - 1
        for b in batches:
            place = np.zeros(b.num_rows, dtype=np.int64)
            if layout.axes and b.num_rows:
                m = _dense(b.column(2), layout.dims)[:, list(layout.axes)]
                share = (m - low) / np.maximum(high - low, 1)
                place = hilbert(np.minimum(share * cells, cells), CURVE_BITS)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place)], ["id", "label", "q", "place"])

    return rows.mapInArrow(run, "id long, label long, q array<double>, place long")


_BLOCKS = "kind string, grp long, no long, n long, labels binary, ids binary, q binary, low binary, high binary, least long, most long"
_NAMES = [c.split()[0] for c in _BLOCKS.split(", ")]
_KINDS = [pa.string(), *[pa.int64()] * 3, *[pa.binary()] * 5, pa.int64(), pa.int64()]


def blocks(rows: DataFrame, layout: Layout, every: int) -> tuple[DataFrame, int]:
    """Parquet rows of three kinds, and the number of groups: `block` (candidates with their zone map), `tile` (anchors: ids divisible by
    `every`), and one `box` for each group, which spans the zone maps of its blocks. Groups are range partitions of (label, place, id)."""
    most = max(GROUP_BYTES // max(layout.dims * layout.dtype.itemsize, 1), BLOCK)
    groups = max(-(-layout.rows // most), min(shuffle_width(rows.sparkSession), -(-layout.rows // LEAST_ROWS)), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, size = TaskContext.get().partitionId(), {"block": BLOCK, "tile": TILE}
        held: dict[str, list] = {"block": [], "tile": []}
        made, zones = {"block": 0, "tile": 0}, []

        def pack(kind: str, least: int) -> list[tuple]:
            out = []
            while held[kind] and sum(len(x[0]) for x in held[kind]) >= least:
                rest = [np.concatenate([x[i] for x in held[kind]]) for i in range(3)]
                ids, labels, q = (x[: size[kind]] for x in rest)
                held[kind] = [tuple(x[size[kind]:] for x in rest)] if len(rest[0]) > size[kind] else []
                q = q.astype(layout.dtype)
                zone = (q.min(0), q.max(0), int(labels.min()), int(labels.max()))
                if kind == "block":
                    zones[:] = [_span([*zones, zone])]
                out.append((kind, grp, grp << 32 | made[kind], len(ids), labels.tobytes(), ids.tobytes(), q.tobytes(),
                            zone[0].tobytes(), zone[1].tobytes(), *zone[2:]))
                made[kind] += 1
            return out

        for b in batches:
            ids, labels = (b.column(i).to_numpy() for i in range(2))
            q, anchor = _dense(b.column(2), layout.dims), ids % every == 0
            if len(ids):
                held["block"].append((ids, labels, q))
            if anchor.any():
                held["tile"].append((ids[anchor], labels[anchor], q[anchor]))
            if out := pack("block", BLOCK) + pack("tile", TILE):
                yield _packed(out)
        out = pack("block", 1) + pack("tile", 1)
        for low, high, least, most in zones:
            out.append(("box", grp, grp, 0, b"", b"", b"", low.tobytes(), high.tobytes(), least, most))
        if out:
            yield _packed(out)

    ordered = rows.repartitionByRange(groups, "label", "place", "id").sortWithinPartitions("label", "place", "id")
    return cut(ordered.select("id", "label", "q").mapInArrow(run, _BLOCKS)), groups


def _span(zones: list[tuple]) -> tuple:
    low, high, least, most = zip(*zones, strict=True)
    return np.minimum.reduce(low), np.maximum.reduce(high), min(least), max(most)


def _packed(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], _NAMES)


def _product(a: np.ndarray, b: np.ndarray, layout: Layout) -> np.ndarray:
    """Integer inner products of the rows of a with those of b: exact up to the range of a long."""
    return a.astype(layout.kind) @ b.astype(layout.kind).T


def _bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each row of a with any vector between low and high, by interval arithmetic."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return (_product(up, low, layout) + _product(down, high, layout), _product(up, high, layout) + _product(down, low, layout))


class _Best:
    """The first k rows of each of n searches so far, highest score first, ties by smaller id."""

    def __init__(self, n: int, k: int, kind: type):
        self.k, self.bar = k, np.full(n, -np.inf, kind)
        self.of, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64)

    def add(self, of: np.ndarray, scores: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> None:
        """Row j of `scores` and `ok` belongs to search of[j]; `bar` is the score below which no row enters a search any more."""
        scores = np.where(ok, scores, -np.inf)
        least = self.bar[of]
        if len(ids) > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        j, i = np.nonzero(ok & (scores >= least[:, None]))
        if not len(j):
            return
        search, score, id_ = (np.concatenate(x) for x in ((self.of, of[j]), (self.score, scores[j, i]), (self.id, ids[i])))
        order = np.lexsort((id_, -score, search))
        search, score, id_ = search[order], score[order], id_[order]
        place = np.arange(len(search)) - np.searchsorted(search, search)
        keep = place < self.k
        full = place == self.k - 1
        self.bar[search[full]] = score[full]
        self.of, self.score, self.id = search[keep], score[keep], id_[keep]

    def whole(self) -> np.ndarray:
        """Scores as longs; beyond a long's range its ends."""
        return np.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in self.score], dtype=np.int64)


def _group_task(layout: Layout, search):
    """Rows sorted by group, blocks before tiles: holds the blocks of one group and lets `search` answer each tile against them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, held, zones = None, [], None
        for b in batches:
            for i in range(b.num_rows):
                row = {name: b.column(c)[i].as_py() for c, name in enumerate(b.schema.names)}
                if row["grp"] != grp:
                    grp, held, zones = row["grp"], [], None
                ids, labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
                q, low, high = (np.frombuffer(row[c], layout.dtype).reshape(-1, layout.dims) if layout.dims else np.zeros((n, 0))
                                for c, n in (("q", len(ids)), ("low", 1), ("high", 1)))
                if row["kind"] == "block":
                    held.append((ids, labels, q, low, high, row["least"], row["most"]))
                elif held:
                    if zones is None:
                        zones = (*(np.concatenate([h[c] for h in held]) for c in (3, 4)), *(np.array([h[c] for h in held]) for c in (5, 6)))
                    found = search(row, ids, labels, q, held, zones)
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["no", "anchor", "rank", "from", "score", "id"])
    return run


_FOUND = "no long, anchor long, rank long, from long, score long, id long"


def _nearest(layout: Layout, k: int):
    """For each anchor of a tile the first k other rows of its label, out of the blocks that can hold them."""
    def search(row, ids, labels, q, held, zones):
        low, high, least, most = zones
        _, top = _bounds(q, low, high, layout)
        top = np.where((labels[:, None] >= least) & (labels[:, None] <= most), top, -np.inf)
        best = _Best(len(ids), k, layout.kind)
        for b in np.argsort(-top.max(0), kind="stable"):
            who = np.flatnonzero((top[:, b] >= best.bar) & (top[:, b] > -np.inf))
            if len(who):
                own = (held[b][1] == labels[who, None]) & (held[b][0] != ids[who, None])
                best.add(who, _product(q[who], held[b][2], layout), held[b][0], own)
        n = len(best.of)
        return [np.full(n, row["no"]), best.of, np.zeros(n, np.int64), ids[best.of], best.whole(), best.id]
    return search


def _windowed(layout: Layout, k: int, low_pct: int, high_pct: int):
    """For each window of a tile's anchors the first k rows of other labels in it, out of the blocks whose bounds meet it."""
    def search(row, ids, labels, q, held, zones):
        low, high, _, _ = zones
        bottom, top = _bounds(q, low, high, layout)
        asked = sorted((w["anchor"], w["rank"], -(-low_pct * w["score"] // 100), high_pct * w["score"] // 100) for w in row["windows"] or ())
        cells = np.array([w for w in asked if w[2] <= w[3]], dtype=object).reshape(-1, 4)
        anchor, rank, least, most = (cells[:, c].astype(t) for c, t in enumerate((np.int64, np.int64, layout.kind, layout.kind)))
        best = _Best(len(anchor), k, layout.kind)
        for b in np.argsort(-top.max(0), kind="stable"):
            need = np.flatnonzero((top[anchor, b] >= np.maximum(least, best.bar)) & (bottom[anchor, b] <= most))
            if len(need):
                who, back = np.unique(anchor[need], return_inverse=True)
                scores = _product(q[who], held[b][2], layout)[back]
                ok = (held[b][1] != labels[anchor[need], None]) & (scores >= least[need, None]) & (scores <= most[need, None])
                best.add(need, scores, held[b][0], ok)
        n = len(best.of)
        return [np.full(n, row["no"]), anchor[best.of], rank[best.of], ids[anchor[best.of]], best.whole(), best.id]
    return search


def _met(laid: DataFrame, visits: DataFrame, layout: Layout, search, more: str = "") -> DataFrame:
    """What `search` finds for the tiles of `visits` (tile columns, with `to` for the group to visit), a task a group."""
    names = [*_NAMES, *([more] if more else [])]
    tiles = visits.drop("grp").withColumnRenamed("to", "grp").select(*names)
    held = laid.where("kind = 'block'")
    if more:
        held = held.withColumn(more, F.lit(None).cast(visits.schema[more].dataType))
    both = held.select(*names).union(tiles)
    width = max(shuffle_width(laid.sparkSession), 1)
    return both.repartition(width, "grp").sortWithinPartitions("grp", "kind", "no").mapInArrow(_group_task(layout, search), _FOUND)


def _boxes(laid: DataFrame, tiles: DataFrame, groups: int) -> DataFrame:
    """Every tile's number and zone map beside every group's box: the stated anchors against all rows, without their vectors."""
    box = laid.where("kind = 'box'").select(F.col("grp").alias("to"), *[F.col(c).alias(f"box_{c}") for c in ("low", "high", "least", "most")])
    return tiles.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>"))).join(box, "to")


def _reachable(layout: Layout):
    """Rows (no, to, floor, ceiling, zone map of a tile, box of a group): those where some score of the two can lie in between."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i in range(b.num_rows):
                a, z, p, r = (np.frombuffer(b.column(c)[i].as_py(), layout.dtype).astype(np.longdouble) for c in range(4, 8))
                ends = np.stack((a * p, a * r, z * p, z * r))
                keep.append(bool(ends.max(0).sum() >= b.column(2)[i].as_py() and ends.min(0).sum() <= b.column(3)[i].as_py()))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low_pct: int = 50, high_pct: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for `rows` as `vectors` gives them.

    Anchors are the rows whose id is divisible by `every`. An anchor's positives are the first `positives` other rows of its label; for
    each, the first `negatives` rows of other labels whose score is low_pct to high_pct per cent of the positive's. Rows go by score,
    highest first, then by smaller id; rows of an anchor's own id are none of its rows. A repeated row counts as often as it stands,
    as an anchor too. A shorter vector counts as zero beyond its end. Scores are exact within a long's range. A positive without
    such negatives, a negative positive_score among them, gives no row; an empty table gives none.
    """
    rows = cut(rows)
    layout = measure(rows)
    laid, groups = blocks(_placed(rows, layout), layout, every)
    tiles = laid.where("kind = 'tile'")
    close = (_boxes(laid, tiles, groups).where("least <= box_most AND most >= box_least")
             .drop("box_low", "box_high", "box_least", "box_most"))
    order = [F.desc("score"), "id"]
    first = F.row_number().over(Window.partitionBy("no", "anchor").orderBy(*order))
    found = _met(laid, close, layout, _nearest(layout, positives)).withColumn("rank", first).where(F.col("rank") <= positives)
    pos = cut(found.select("no", "anchor", F.col("rank").cast("long").alias("rank"), F.col("from").alias("anchor_id"),
                           F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    asked = pos.where("positive_score >= 0").groupBy("no").agg(
        F.collect_list(F.struct("anchor", "rank", F.col("positive_score").alias("score"))).alias("windows"),
        F.min("positive_score").alias("lowest"), F.max("positive_score").alias("highest"))
    # The division may round; the windows' exact ends are checked where rows are read.
    floor = F.col("lowest").cast("double") * (low_pct / 100 * (1 - 1e-9)) - 1
    ceiling = F.col("highest").cast("double") * (high_pct / 100 * (1 + 1e-9)) + 1
    limits = tiles.select("no", "low", "high").join(asked.select("no", floor.alias("floor"), ceiling.alias("ceiling")), "no")
    pairs = _boxes(laid, limits, groups).select("no", "to", "floor", "ceiling", "low", "high", "box_low", "box_high")
    visits = tiles.join(pairs.mapInArrow(_reachable(layout), "no long, to long"), "no").join(asked.select("no", "windows"), "no")
    rank = F.row_number().over(Window.partitionBy("no", "anchor", "of").orderBy(*order))
    neg = (_met(laid, visits, layout, _windowed(layout, negatives, low_pct, high_pct), "windows").withColumnRenamed("rank", "of")
           .withColumn("rank", rank).where(F.col("rank") <= negatives).drop("from"))
    return neg.join(pos.withColumnRenamed("rank", "of"), ["no", "anchor", "of"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))


def op13_negatives(df: DataFrame) -> DataFrame:
    """Hard negatives of the vectors of `df` (vec_id, embedding, label; other columns are ignored), where an id divisible by 7 moves
    its label to the next of ten. Nulls, ties, repeated rows and empty tables as in `vectors` and `hard_negatives`."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors(df.select("vec_id", "embedding", moved.alias("label"))))


OP13_SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id,
       p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""
