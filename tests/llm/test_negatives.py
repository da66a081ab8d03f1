"""Hard negatives against brute force, the curve, the bounds, and answers to odd rows."""

import itertools
import math
import random

import duckdb
import numpy as np
import pytest

from grainwise.llm import negatives, queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows):
    """Every anchor against every row, with Python's own integers."""
    held = []
    for i, x, label in rows:
        if i is None or x is None or label is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        held.append((i, [math.floor(v * 256) for v in x], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, q, label in held:
        if i % 50:
            continue
        near = sorted((-sum(a * b for a, b in zip(q, r)), j, other) for j, r, other in held if j != i)  # noqa: B905
        for s, j, _ in [x for x in near if x[2] == label][:5]:
            fit = [(-t, k) for t, k, other in near if other != label and -50 * s <= -100 * t <= -95 * s][:3]
            out += [(i, j, rank, k, -s, t) for rank, (t, k) in enumerate(fit, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize(("dims", "bits"), [(1, 6), (2, 5), (3, 3), (5, 2)])
def test_the_curve_visits_every_cell_step_by_step(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    place = negatives.hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_score():
    r = np.random.default_rng(1)
    a, b = r.integers(-300, 300, (20, 6)), r.integers(-300, 300, (50, 6))
    layout = negatives.Layout(50, 6, 300.0, (), (), ())
    low, high = negatives._bounds(a, b.min(0)[None], b.max(0)[None], layout)
    scores = a @ b.T
    assert (low <= scores).all() and (scores <= high).all()


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force_over_many_blocks(spark, seed, monkeypatch):
    for name, value in (("BLOCK", 8), ("TILE", 3), ("LEAST_ROWS", 40), ("CURVE_DIMS", 3)):
        monkeypatch.setattr(negatives, name, value)
    r = random.Random(seed)
    # Few values, so scores tie; every sixth row is the same vector.
    rows = [(i * (10 if i % 3 == 0 else 1), [0.5, -0.25, 0.125, 1.0] if i % 6 == 0 else [r.randint(-4, 9) / 16 for _ in range(4)], r.randint(0, 3))
            for i in range(1, 400)]
    rows = list({x[0]: x for x in rows}.values())
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(negatives.op13_negatives(df)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 1.0], 1), (2, [1.0], 1), (3, [0.5, 0.75], 2), (3, [0.5, 0.75], 2), (4, [], 2), (5, None, 2), (6, [1.0, None], 2),
            (8, [nan, 1.0], 2), (9, [1.0, inf], 2), (10, [0.5, 0.5], None), (None, [0.5, 0.5], 2), (50, [-1.0, 0.0], 2), (100, [0.0, 0.0], 1),
            (11, [0.25, 0.9], 3), (12, [1.0, 0.0, 3.0], 3)]
    wide = [(*x, "a", 1, 2) for x in rows]
    df = spark.createDataFrame(wide, SCHEMA + ", kind string, q int, rank int")
    padded = [(i, x and [*x, *[0.0] * (3 - len(x))] if x is not None else None, label) for i, x, label in rows]
    padded = [(i, [0.0] * 3 if x == [] else x, label) for i, x, label in padded]
    want = brute(padded)
    assert want and rows_of(negatives.op13_negatives(df)) == want
    assert rows_of(negatives.op13_negatives(df.limit(0))) == []
    assert rows_of(negatives.op13_negatives(df.where("vec_id = 5"))) == []


def test_windows_without_any_whole_score(spark):
    # The positive's score is 1: no whole number lies from 0.5 to 0.95.
    rows = [(50, [1 / 256], 1), (1, [1 / 256], 1), (2, [1 / 256], 2)]
    assert brute(rows) == rows_of(negatives.op13_negatives(spark.createDataFrame(rows, SCHEMA))) == []


@pytest.mark.parametrize("size", [2.0 ** 10, 2.0 ** 20, 2.0 ** 21])
def test_large_components_stay_exact(spark, size):
    r = random.Random(5)
    rows = [(i * 25, [r.random() * size, -r.random() * size / 3], i % 2) for i in range(30)]
    assert rows_of(negatives.op13_negatives(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({negatives.OP13_SQL})").fetchall()
    assert want and rows_of(queries.QUERIES["op13_negatives"](spark, SMALL)) == sorted(want)
