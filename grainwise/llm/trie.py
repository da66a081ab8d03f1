"""Conversation prefix trie by union-find over the common prefixes of sorted neighbours.

Equal conversations are counted first, then the distinct ones are range-partitioned and sorted by the digests of their turns, so that
the members of a node are neighbours. A task takes its conversations in runs of one Arrow batch. Within a run the common prefixes
of neighbours are edges; they are joined in descending depth, and every join of two components makes (or widens) a branching node.
What a run leaves open are the nodes on the paths of its first and its last conversation: the run is contracted to these two
paths, and neighbouring runs merge along the prefix they share. Tasks hand on their contracted runs, which merge in
rounds of FAN neighbours until one is left, so no task and no driver holds more than FAN pairs of paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from grainwise.llm.common import F, cut, shuffle_width

#: Contracted runs merged by one task in a round; ids of a digest's fragment; copies of the open nodes where their children meet them.
FAN, FRAGMENT, SALTS = 32, 4_096, 16
EMPTY = hashlib.sha256(b"").hexdigest()

_STATE = pa.schema([("part", pa.int64()), ("side", pa.int32()), ("depth", pa.int64()), ("key", pa.binary()), ("up", pa.binary()),
                    ("conv", pa.int64()), ("parent", pa.int64()), ("n", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()),
                    ("saved", pa.int64()), ("bytes", pa.int64()), ("ends", pa.string())])
_STATE_SQL = ("part long, side int, depth long, key binary, up binary, conv long, parent long, n long, kids long, leaves long, "
              "saved long, bytes long, ends string")
#: `side` of a row: a finished node, or an open one on the path of the first conversation, of the last, or of both.
DONE, FIRST, LAST, BOTH = 0, 1, 2, 3


def sequences(df: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of every conversation in order, each as a 128-bit digest of role and text and the text's bytes.

    Turns go by `turn`, null first, then by digest where turns tie; a null role or text counts as empty. Rows of a null conv_id
    belong to no conversation and are left out. One conversation's digests (24 bytes a turn) are held by one task; texts are not moved.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("h"),
                    F.xxhash64(F.lit(1), text, role).alias("g"), F.octet_length(text).cast("long").alias("bytes"))
    return (df.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
            .select("conv_id", F.transform("t", lambda t: F.struct(t["h"].alias("h"), t["g"].alias("g"), t["bytes"].alias("bytes"))).alias("turns")))


def branched(seqs: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """`seqs` with the first h turns of every conversation c taken from conversation c - c % family, as far as that has them;
    h is crc32(decimal c) % most."""
    seqs = cut(seqs)
    lead = seqs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("__lead"), F.col("turns").alias("__turns"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    ahead = F.when(F.col("__turns").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("__turns", 1, h))
    return (seqs.join(lead, F.col("conv_id") - F.col("conv_id") % family == F.col("__lead"), "left")
            .select("conv_id", F.concat(ahead, own).alias("turns")))


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (kh, kl, id) as (kh, kl, first id, ids joined by commas), up to FRAGMENT ids a row."""
    out, held, now = [], [], None
    for b in batches:
        for kh, kl, i in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
            if now != (kh, kl) or len(held) == FRAGMENT:
                if held:
                    out.append((*now, held[0], ",".join(map(str, held))))
                now, held = (kh, kl), []
            held.append(i)
        if len(out) >= 10_000:
            yield _columns(out, ("kh", "kl", "at", "ids"))
            out = []
    if held:
        out.append((*now, held[0], ",".join(map(str, held))))
    if out:
        yield _columns(out, ("kh", "kl", "at", "ids"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted fragments as one SHA-256 a key, fed fragment by fragment, so a key of any number of ids takes no memory."""
    out, now, sha = [], None, None
    for b in batches:
        for kh, kl, ids in zip(*(b.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
            if now == (kh, kl):
                sha.update(b",")
            else:
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (kh, kl), hashlib.sha256()
            sha.update(ids.encode())
        if len(out) >= 10_000:
            yield _columns(out, ("kh", "kl", "ends"))
            out = []
    if now is not None:
        out.append((*now, sha.hexdigest()))
    if out:
        yield _columns(out, ("kh", "kl", "ends"))


def _columns(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], list(names))


class _Node:
    """An open node: what its run holds of it. kids, leaves and saved are those of finished children alone; n and conv cover all members."""

    __slots__ = ("key", "conv", "n", "kids", "leaves", "saved", "bytes", "ends")

    def __init__(self, key, conv, n, kids, leaves, saved, size, ends):
        self.key, self.conv, self.n, self.kids, self.leaves, self.saved, self.bytes, self.ends = key, conv, n, kids, leaves, saved, size, ends

    def absorb(self, other: _Node) -> None:
        self.conv = min(self.conv, other.conv)
        self.n += other.n
        self.kids += other.kids
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends


#: A contracted run: the nodes on the path of its first conversation and of its last, from the root; shared ones are one object.
Run = tuple[list[_Node], list[_Node]]


def _finish(node: _Node, depth: int, above: _Node | None, out: list[tuple]) -> None:
    """Emit `node`, whose children are all finished, and hand its sums to the node above."""
    leaves, saved = node.leaves if node.kids else 1, node.saved + (node.n - 1) * node.bytes
    out.append((0, DONE, depth, node.key, above.key if above else None, node.conv, None, node.n, node.kids, leaves, saved, node.bytes, node.ends))
    if above:
        above.kids += 1
        above.leaves += leaves
        above.saved += saved


def _merge(a: Run, b: Run, out: list[tuple]) -> Run:
    """Two neighbouring runs as one; nodes that leave both outer paths are finished, deepest first."""
    (first, end), (start, last) = a, b
    low, high = 0, min(len(end), len(start))
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if end[mid].key == start[mid].key else (low, mid)
    meet = low  # depth of the longest common prefix of the neighbours
    for d in range(len(start) - 1, meet, -1):
        if d >= len(last) or last[d] is not start[d]:
            _finish(start[d], d, start[d - 1], out)
    for d in range(len(end) - 1, meet, -1):
        if d >= len(first) or first[d] is not end[d]:
            _finish(end[d], d, end[d - 1], out)
    for d in range(meet + 1):
        end[d].absorb(start[d])
        if d < len(last) and last[d] is start[d]:
            last[d] = end[d]
    for d in range(meet, 0, -1):
        outer = (d < len(first) and first[d] is end[d]) or (d < len(last) and last[d] is end[d])
        if not outer:
            _finish(end[d], d, end[d - 1], out)
    return first, last


def _common(h: np.ndarray, g: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of neighbouring sequences; sequence i is the `size[i]` values from `at[i]`."""
    least = np.minimum(size[:-1], size[1:])
    common, alive = np.zeros(len(least), dtype=np.int64), np.flatnonzero(least > 0)
    d = 0
    while len(alive):
        p, q = at[alive] + d, at[alive + 1] + d
        alive = alive[(h[p] == h[q]) & (g[p] == g[q])]
        d += 1
        common[alive] = d
        alive = alive[least[alive] > d]
    return common


def _run(h, g, width, at, size, convs, counts, ends, out: list[tuple]) -> Run:
    """The trie of sorted, distinct sequences: finished nodes go to `out`, the contracted run is returned."""
    n = len(size)
    depth, conv, many = size.tolist(), list(convs), list(counts)
    ids, low, high = list(range(n)), list(range(n)), list(range(n))  # compressed nodes; the first n end a sequence
    above: list[int] = [-1] * n
    team, top = list(range(n)), list(range(n))

    def find(of: list[int], i: int) -> int:
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    common = _common(h, g, at, size)
    for e in np.argsort(-common, kind="stable").tolist():
        d, x, y = int(common[e]), find(team, e), find(team, e + 1)
        left, right = top[x], top[y]
        if depth[left] == d:
            node = left
        elif depth[right] == d:
            node = right
        else:
            node = len(depth)
            depth.append(d)
            conv.append(None)
            many.append(0)
            low.append(n)
            high.append(-1)
            above.append(-1)
            ids.append(node)
        for side in (left, right):
            if side != node:
                if depth[side] == d:
                    ids[side] = node  # two nodes of one prefix
                else:
                    above[side] = node
        team[y] = x
        top[x] = node
    live = sorted((v for v in range(len(depth)) if ids[v] == v), key=lambda v: -depth[v])
    # A node that was joined to another of the same prefix hands over what it ends.
    finals: dict[int, int] = {}
    for v in range(len(depth)):
        w = find(ids, v)
        if v < n:
            finals[w] = v
            if w != v:
                many[w] += many[v]
                conv[w] = conv[v] if conv[w] is None else min(conv[w], conv[v])
                low[w], high[w] = min(low[w], v), max(high[w], v)
    m = len(depth)
    kids, done_kids, leaves, done_leaves, saved, done_saved, tall = ([0] * m for _ in range(7))
    outer = [False] * m
    for v in live:
        outer[v] = low[v] == 0 or high[v] == n - 1
        leaves[v] = leaves[v] or 1
        p = find(ids, above[v]) if above[v] >= 0 else -1
        from_ = depth[p] + 1 if p >= 0 else 0
        base = at[low[v]] - 1
        tall[v] = from_
        length = int(width[base + max(from_, 1): base + depth[v] + 1].sum()) if depth[v] >= from_ else 0
        sum_ = saved[v] + (many[v] - 1) * length
        if p >= 0:
            above[v] = p
            many[p] += many[v]
            conv[p] = conv[v] if conv[p] is None else min(conv[p], conv[v])
            low[p], high[p] = min(low[p], low[v]), max(high[p], high[v])
            kids[p] += 1
            leaves[p] += leaves[v]
            saved[p] += sum_
            if not outer[v]:
                done_kids[p] += 1
                done_leaves[p] += leaves[v]
                done_saved[p] += sum_
    first = _path(0, h, g, at, size)
    last = first if n == 1 else _path(n - 1, h, g, at, size)
    opened: Run = ([None] * len(first), [None] * len(last))
    for v in live:
        base, end = at[low[v]] - 1, ends[finals[v]] if v in finals else None
        if outer[v]:
            on_first, on_last = low[v] == 0, high[v] == n - 1
            keys = first if on_first else last
            for d in range(depth[v], tall[v] - 1, -1):
                bottom = d == depth[v]
                node = _Node(keys[d], conv[v], many[v], done_kids[v] if bottom else 0, done_leaves[v] if bottom else 0,
                             done_saved[v] if bottom else 0, int(width[base + d]) if d else 0, end if bottom else None)
                if on_first:
                    opened[0][d] = node
                if on_last:
                    opened[1][d] = node
            continue
        p = above[v]
        up = (first if low[p] == 0 else last)[depth[p]] if outer[p] else None
        sum_ = saved[v]
        for d in range(depth[v], tall[v] - 1, -1):
            bottom, size_ = d == depth[v], int(width[base + d])
            sum_ += (many[v] - 1) * size_
            at_top = d == tall[v]
            parent = conv[v] if not at_top else conv[p] if up is None else None
            out.append((0, DONE, d, None, up if at_top else None, conv[v], parent, many[v], kids[v] if bottom else 1, leaves[v], sum_, size_,
                        end if bottom else None))
    return opened


def _path(i: int, h, g, at, size) -> list[bytes]:
    """Keys of the prefixes of sequence i, from the root's on."""
    sha = hashlib.blake2b(digest_size=16)
    keys = [sha.digest()]
    turns = np.stack((h[at[i]: at[i] + size[i]], g[at[i]: at[i] + size[i]]), axis=1)
    for turn in turns:
        sha.update(turn.tobytes())
        keys.append(sha.digest())
    return keys


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _STATE, strict=True)], schema=_STATE)


def _open_rows(run: Run, part: int) -> list[tuple]:
    first, last = run
    rows = []
    for d in range(max(len(first), len(last))):
        a, b = first[d] if d < len(first) else None, last[d] if d < len(last) else None
        for node, side in ((a, BOTH),) if a is b else ((a, FIRST), (b, LAST)):
            if node is not None:
                rows.append((part, side, d, node.key, None, node.conv, None, node.n, node.kids, node.leaves, node.saved, node.bytes, node.ends))
    return rows


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (turns, conv, n, ends) as finished nodes and one contracted run."""
    run, part = None, TaskContext.get().partitionId()
    for b in batches:
        if not b.num_rows:
            continue
        turns, out = b.column(0), []
        flat = turns.flatten()
        h, g, width = (flat.field(c).to_numpy(zero_copy_only=False) for c in range(3))
        at = turns.offsets.to_numpy().astype(np.int64)
        at, size = at[:-1] - at[0], np.diff(at)
        grown = _run(h, g, width, at, size, *(b.column(c).to_pylist() for c in (1, 2, 3)), out)
        run = grown if run is None else _merge(run, grown, out)
        if out:
            yield _batch(out)
    if run is not None:
        yield _batch(_open_rows(run, part))


def _joiner(close: bool):
    """Merge the contracted runs of each group of FAN neighbours, sorted by part; `close` finishes what is left open."""
    def settle(run: Run, group: int, out: list[tuple]) -> None:
        if not close:
            out.extend(_open_rows(run, group))
            return
        first, last = run
        for path, other in ((last, first), (first, [])):
            for d in range(len(path) - 1, -1, -1):
                if d >= len(other) or other[d] is not path[d]:
                    _finish(path[d], d, path[d - 1] if d else None, out)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = part = run = None
        paths: Run = ([], [])
        out: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(len(_STATE))), strict=True):
                if row[0] != part:
                    if part is not None:
                        run = paths if run is None else _merge(run, paths, out)
                        if row[0] // FAN != group:
                            settle(run, group, out)
                            run = None
                    part, group, paths = row[0], row[0] // FAN, ([], [])
                node = _Node(row[3], row[5], *row[7:])
                for side in (FIRST, LAST):
                    if row[1] & side:
                        paths[side - 1].append(node)
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        if part is not None:
            settle(paths if run is None else _merge(run, paths, out), group, out)
        if out:
            yield _batch(out)
    return join


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """One row per node of the trie of `seqs` (conv_id, turns as `sequences` gives them): conv_id (its smallest member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of the first `depth` turns, its members are the conversations that start with it; n_leaves counts the
    childless nodes of its subtree, itself included; saved_tokens sums (n_convs - 1) times the bytes of the last text over the subtree;
    ends_sha256 is of the ids of the members of exactly `depth` turns, ascending, comma-joined. A conversation without turns is a
    member of the root alone. An empty table gives no node. Equal conversations are counted before they are sorted, so any
    number of copies is one row; the digest of their ids alone is fed in order by one task, without holding them.
    """
    spark = seqs.sparkSession
    width = shuffle_width(spark)
    runs = cut(seqs.select("conv_id", "turns", F.xxhash64("turns").alias("kh"), F.xxhash64(F.lit(1), "turns").alias("kl")))
    ids = runs.select("kh", "kl", "conv_id").repartitionByRange(width, "kh", "kl", "conv_id").sortWithinPartitions("kh", "kl", "conv_id")
    ends = (ids.mapInArrow(_fragments, "kh long, kl long, at long, ids string").repartition(width, "kh", "kl")
            .sortWithinPartitions("kh", "kl", "at").mapInArrow(_digests, "kh long, kl long, ends string"))
    same = runs.groupBy("kh", "kl").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n"), F.first("turns").alias("turns"))
    distinct = cut(same.join(ends, ["kh", "kl"]).select("turns", "conv", "n", "ends"))
    state = cut(distinct.repartitionByRange(width, "turns").sortWithinPartitions("turns").mapInArrow(_grow, _STATE_SQL))
    done, parts = [state.where(F.col("side") == DONE)], width
    while True:
        groups = -(-parts // FAN)
        state = cut(state.where(F.col("side") != DONE).repartition(min(width, groups), F.floor(F.col("part") / FAN))
                    .sortWithinPartitions("part", "depth").mapInArrow(_joiner(groups == 1), _STATE_SQL))
        done.append(state.where(F.col("side") == DONE))
        parts = groups
        if groups == 1:
            break
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.union(more)
    # The root may have a third of all nodes as children: open nodes are few, so each stands in SALTS copies and its children are dealt over them.
    salt = F.pmod(F.xxhash64("conv", "depth"), F.lit(SALTS)).cast("int")
    opened = (nodes.where("key is not null").select(F.col("key").alias("up"), F.col("conv").alias("__parent"),
                                                    F.explode(F.lit(list(range(SALTS)))).alias("__salt")))
    waiting = (nodes.where("up is not null").withColumn("__salt", salt).join(opened, ["up", "__salt"])
               .select(*nodes.columns, "__parent"))
    settled = nodes.where("up is null").withColumn("__parent", F.col("parent"))
    return waiting.union(settled).select(
        F.col("conv").alias("conv_id"), "depth", F.col("__parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))


def op12_trie(df: DataFrame) -> DataFrame:
    """The trie of the conversations of `df` (conv_id, turn, role, text; other columns are ignored), each started by its family's first turns.

    Nulls, ties and empty tables as in `sequences` and `prefix_trie`.
    """
    return prefix_trie(branched(sequences(df)))


OP12_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS lead, xor(4294967295, list_reduce(
          list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT))),
          lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
                                  lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 9 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
k AS (SELECT c.*, (SELECT count(*) FROM t WHERE t.conv_id = c.lead AND t.p <= c.h) AS k FROM c),
r AS (SELECT k.conv_id, p, role, text FROM k JOIN t ON t.conv_id = k.lead AND t.p <= k.h
      UNION ALL SELECT k.conv_id, k.k + p - k.h, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND t.p > k.h),
paths AS (SELECT conv_id, p AS depth, strlen(text) AS bytes,
                 sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY p)) AS node FROM r
          UNION ALL SELECT conv_id, 0, 0, '' FROM c),
up AS (SELECT *, lag(node) OVER w AS parent, lead(node) OVER w IS NULL AS ending FROM paths WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
n AS (SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
             (count(*) - 1) * any_value(bytes) AS saved, bool_and(ending) AS leaf,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ending), '')) AS ends FROM up GROUP BY node),
sub AS (SELECT a.node, sum(n.saved) AS saved, count(*) FILTER (WHERE n.leaf) AS leaves
        FROM n JOIN up a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.node)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, (SELECT count(*) FROM n AS x WHERE x.parent = n.node) AS n_children,
       sub.leaves AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN sub USING (node) LEFT JOIN n AS q ON q.node = n.parent
"""
