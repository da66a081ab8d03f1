"""Line deduplication against brute force, and its time on one very long text."""

import random
import time

from grainwise.llm import lines


def brute(texts):
    """Lines kept of each text, in order; texts are (doc_id, text) in order of doc_id."""
    first, out = {}, {}
    for doc, text in texts:
        held = text.split("\n") if text else []
        gone = set()
        for at in range(max(len(held) - 2, 1)) if held else ():
            window = tuple(held[at:at + 3])
            d0, a0 = first.setdefault(window, (doc, at))
            if (d0, a0) != (doc, at) and not (d0 == doc and at < a0 + 3):
                gone |= set(range(at, min(at + 3, len(held))))
        out[doc] = ("\n".join(x for i, x in enumerate(held) if i not in gone), sorted(gone))
    return out


def test_matches_brute_force(spark):
    pick = random.Random(2)
    texts = []
    for i in range(300):
        held = [pick.choice("abcde") for _ in range(pick.randint(0, 9))]
        if i and pick.random() < .6:
            other = pick.choice(texts)[1].split("\n")
            at = pick.randint(0, len(held))
            held[at:at] = other[: pick.randint(0, len(other))]
        texts.append((i, "\n".join(held)))
    texts += [(300, "P1\nP2\nP3"), (301, "a\nP1\nP2\nP3\nb"), (302, "a\nP1\nP2\nP3\nb"), (303, "z\n" * 8 + "z"), (304, "one\ntwo"), (305, "one\ntwo")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["text"], list(r["removed"])) for r in lines.dedup_lines(df).collect()}
    want = brute(texts)
    assert got == want
    # The whole passage goes at its second and third place, and with it all that repeats of its surroundings.
    assert want[301][1] == [1, 2, 3] and want[302][1] == [0, 1, 2, 3, 4] and want[303][1] == [3, 4, 5, 6, 7, 8] and want[305] == ("", [0, 1])


def test_one_text_of_many_lines_takes_linear_time(spark):
    long = "\n".join(f"line {i % 50_000}" for i in range(100_000))
    df = spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: (r["n_lines"], len(r["removed"])) for r in lines.dedup_lines(df).collect()}
    assert got == {1: (100_000, 50_000), 2: (100_000, 100_000)}
    assert time.perf_counter() - began < 60


def test_op8_removes_what_lies_beyond_a_window_that_overlaps_its_first(spark):
    """A line or a cycle of two lines said over and over keeps its first window, in the query as in its SQL."""
    import duckdb
    pick = random.Random(5)
    texts = [(1, "z\nz\nz\nz"), (2, "a\nb\na\nb\na"), (3, "x\nc\nc\nc\nc\nc\ny"), (4, "a\nb\na"), (5, "z\nz")]
    texts += [(i, "\n".join(pick.choice("stuvw") for _ in range(pick.randint(1, 9)))) for i in range(6, 150)]
    got = lines.op8_lines(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    rows = {r["doc_id"]: r["removed"] for r in got.collect()}
    assert [rows[i] for i in range(1, 6)] == ["3", "3,4", "4,5", "0,1,2", ""]
    first, want = {}, {}
    for doc, text in texts:
        held, gone = text.split("\n"), set()
        for at in range(max(len(held) - 2, 1)):
            d0, a0 = first.setdefault(tuple(held[at:at + 3]), (doc, at))
            if (d0, a0) != (doc, at):
                gone |= {p for p in range(at, min(at + 3, len(held))) if d0 != doc or p >= a0 + 3}
        want[doc] = ",".join(map(str, sorted(gone)))
    assert rows == want
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    stated = con.execute(lines.OP8_SQL).df()[got.columns].sort_values("doc_id").astype(str).values.tolist()
    assert got.toPandas().sort_values("doc_id").astype(str).values.tolist() == stated
