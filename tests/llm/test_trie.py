"""The conversation prefix trie against a trie of dictionaries, and its answers to odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from grainwise.llm import queries, trie

SMALL = "/root/testdata/sf0.001"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(convs):
    """Rows of the trie of {conv_id: [(role, text)]}, node by node."""
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        own = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * own + sum(saved[k] for k in kids[node])
    rows = []
    for node, ids in members.items():
        ends = ",".join(str(c) for c in ids if len(convs[c]) == len(node))
        rows.append((ids[0], len(node), members[node[:-1]][0] if node else None, len(ids), len(kids[node]), leaves[node], saved[node],
                     hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def rebuilt(convs):
    out = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + convs[c][h:]
    return out


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def frame(spark, convs, parts=3):
    rows = [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)


@pytest.fixture
def tiny_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("seed", range(4))
def test_trie_matches_brute_force_over_run_and_task_boundaries(spark, tiny_batches, seed):
    pick = random.Random(seed)
    convs = {}
    for c in range(60):
        turns = [(pick.choice("ua"), pick.choice(["x", "yy", "é", ""])) for _ in range(pick.randint(1, 7))]
        if c and pick.random() < .5:
            other = convs[pick.choice(list(convs))]
            turns = other[: pick.randint(0, len(other))] + (turns if pick.random() < .7 else turns[:1])
        if c and pick.random() < .2:
            turns = convs[pick.choice(list(convs))]
        convs[c] = turns
    df = frame(spark, convs)
    assert rows_of(trie.prefix_trie(trie.sequences(df))) == sorted(brute(convs), key=str)
    assert rows_of(trie.op12_trie(df)) == sorted(brute(rebuilt(convs)), key=str)


def test_many_parts_merge_in_rounds(spark, tiny_batches, monkeypatch):
    monkeypatch.setattr(trie, "FAN", 2)
    monkeypatch.setattr(trie, "FRAGMENT", 2)
    convs = {c: [("u", "hot"), ("a", str(c % 7)), ("u", str(c % 3))][: 1 + c % 4] for c in range(1, 90)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert rows_of(trie.prefix_trie(trie.sequences(frame(spark, convs)))) == sorted(brute(convs), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_deep_conversation_and_its_copies(spark):
    long = [("u", f"t{i}") for i in range(20_000)]
    convs = {5: long, 6: long[:15_000], 9: [*long[:10_000], ("a", "other")]}
    got = rows_of(trie.prefix_trie(trie.sequences(frame(spark, convs))))
    assert len(got) == 20_002
    rows = {(r[1], r[0]): r for r in got}
    assert rows[10_000, 5][3:6] == (3, 2, 2) and rows[15_000, 5][3] == 2 and rows[20_000, 5][3] == 1
    assert rows[10_001, 9][2] == 5 and rows[20_000, 5][7] == hashlib.sha256(b"5").hexdigest()


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, side string, __parent string, conv long"
    rows = [(1, None, None, None, "x", "y", 7), (1, 0, "u", "b", None, None, 7), (None, 0, "u", "lost", "x", "y", 7),
            (2, 0, "u", "b", "x", "y", 7), (2, 0, "u", "b", "x", "y", 7), (3, None, None, None, "x", "y", 7), (10, 0, "u", "z" * 300_000, "x", "y", 7)]
    df = spark.createDataFrame(rows, schema)
    convs = {1: [("", ""), ("u", "b")], 2: [("u", "b"), ("u", "b")], 3: [("", "")], 10: [("u", "z" * 300_000)]}
    assert rows_of(trie.prefix_trie(trie.sequences(df))) == sorted(brute(convs), key=str)
    # Of 1, 2 and 3 the lead, 0, is missing: what is left of them may be no turn at all.
    assert rows_of(trie.op12_trie(df)) == sorted(brute(rebuilt(convs)), key=str)
    assert trie.op12_trie(df.limit(0)).collect() == []
    tied = [(4, 1, "u", "a"), (4, 1, "u", "b"), (7, 1, "u", "b"), (7, 1, "u", "a")]
    got = trie.prefix_trie(trie.sequences(spark.createDataFrame(tied, "conv_id long, turn long, role string, text string")))
    assert sorted(r["n_convs"] for r in got.collect()) == [2, 2, 2]


def test_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    want = [tuple(r) for r in con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({trie.OP12_SQL})").fetchall()]
    assert rows_of(queries.QUERIES["op12_trie"](spark, SMALL)) == sorted(want, key=str)
