import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.llm import hard_negatives as hn
from panelweave.llm.hard_negatives import hard_negatives, strassen

SCHEMA = "id long, label int, vector array<float>, row string, score int, tile int"


def plain(rows, k=5, low=80, high=100):
    clean = {(i, l, tuple(v)) for i, l, v in rows if None not in (i, l, v) and all(x is not None and math.isfinite(x) for x in v)}
    clean = [(i, l, [math.floor(256 * float(np.float32(x))) for x in v]) for i, l, v in clean]
    out = []
    for a, label, v in clean:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, l) for i, l, w in clean if i != a)
        for p, i, _ in [s for s in scored if s[2] == label][:k]:
            near = [s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p][:k]
            out += [(a, i, r, j, -p, -s) for r, (s, j, _) in enumerate(near, 1)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, l, v, "x", 1, 2) for i, l, v in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives(df, F.col("id") % 100 == 0).collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (16, 5, 70), (33, 17, 65), (100, 64, 300), (257, 48, 129), (0, 5, 3)])
def test_strassen(shape):
    rng = np.random.default_rng(1)
    m, d, n = shape
    for size in (300, 1 << 27):
        a, b = rng.integers(-size, size, (m, d)), rng.integers(-size, size, (d, n))
        assert np.array_equal(strassen(a, b), a @ b)
    # Sums inside may leave 64 bits; the products are right all the same.
    a, b = np.full((40, 40), 1 << 61), np.eye(40, dtype=np.int64)
    assert np.array_equal(strassen(a, b), a)


def vectors(rng, n, dim=20, labels=3):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    return [(i, rng.randrange(labels), [c + rng.gauss(0, 0.4) for c in rng.choice(centres)]) for i in range(n)]


def test_against_all_products(spark, monkeypatch):
    rows = vectors(random.Random(3), 1200)
    want = plain(rows)
    assert len(want) > 100 and run(spark, rows) == want
    monkeypatch.setattr(hn, "TILE_BYTES", 20 * 8 * 100)
    monkeypatch.setattr(hn, "ANCHORS", 3)
    assert run(spark, rows) == want


def test_hot_label_ties_and_copies(spark):
    rng = random.Random(4)
    rows = [(i, 0 if i % 3 else i % 5, [float(x) for x in rng.choice([(1, 2, 0), (1, 2, 1), (2, 1, 0)])]) for i in range(700)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows + rows[:150]) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0, 3.0]), (2, 1, []), (3, 2, [1.0]), (4, 2, [1.0, 1.9]), (5, 2, [nan, 1.0]), (6, 2, [inf, 1.0]), (7, 2, [None, 1.0]), (8, 2, None), (9, None, [1.0, 2.0]),
            (None, 2, [1.0, 2.0]), (100, 2, [1.0, 2.0]), (100, 2, [1.0, 2.0]), (100, 2, [0.5, 2.0]), (200, 3, [1.0, 1.0]), (10, 1, [-1.0, -2.0]), (11, 2, [3e38, 1.0])]
    got = run(spark, [r for r in rows if r[0] != 11])
    assert got == plain([r for r in rows if r[0] != 11]) and got
    assert run(spark, rows)  # a value beyond 64 bits does not stop the others
    assert run(spark, [(None, None, None)]) == []
    assert hard_negatives(spark.createDataFrame([], SCHEMA), F.col("id") % 100 == 0).count() == 0
