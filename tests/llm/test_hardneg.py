"""Hard negatives against brute force."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from longleaf.llm import hardneg


def brute(rows: list[tuple], positives: int = 5, negatives: int = 3) -> list[tuple]:
    """Every anchor against every row, in Python's whole numbers."""
    kept = []
    for i, v, label in rows:
        if label is None or not v or len(v) != 6 or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    last = lambda i: (i is None, i or 0)
    for n, (i, v, label) in enumerate(kept):
        if i is None or i % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), last(j), j, other) for m, (j, w, other) in enumerate(kept) if m != n), key=lambda s: s[:2])
        for p, _, j, _ in [s for s in scored if s[3] == label][:positives]:
            inside = [s for s in scored if s[3] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out += [(i, j, r, s[2], -p, -s[0]) for r, s in enumerate(inside, 1)]
    return sorted(out, key=str)


def mined(df, **ways):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hardneg.mine(df, F.col("vec_id") % 50 == 0, label, **ways)
    return sorted(((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got.collect()), key=str)


def frame(spark, rows):
    rows = [(i, v if v is None else [None if x is None else float(x) for x in v], label) for i, v, label in rows]
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, row int, block int")


def test_equals_brute_force_over_many_blocks(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 6))
    rows = [(i, (centres[i % 12] + 0.2 * rng.standard_normal(6)).tolist(), int(rng.integers(0, 3)) if i % 12 else 5) for i in range(3000)]
    rows += [(3000 + i, centres[3].tolist(), i % 3) for i in range(1500)]  # a third of all rows is one vector
    rows += [(9000, None, 1), (9050, [0.0] * 6, 1), (9051, [float("nan")] * 6, 1), (9052, [1.0], 1), (9053, [None] * 6, 1), (9054, rows[0][1], None), (9055, [], 2), (50, rows[50][1], 2), (50, rows[50][1], 2), (None, rows[50][1], 1)]
    want = brute(rows)
    assert len(want) > 900
    assert mined(frame(spark, rows), block=600, leaf=32, sample=400) == want


def test_small_tables_and_ties(spark):
    rows = [(0, [1.0, 0, 0, 0, 0, 0], 1), (1, [1.0, 0, 0, 0, 0, 0], 2), (2, [1.0, 0, 0, 0, 0, 0], 2), (3, [0.5, 0, 0, 0, 0, 0], 3), (4, [0.5, 0, 0, 0, 0, 0], 4), (5, [0.94, 0, 0, 0, 0, 0], 5), (6, [-1.0, 0, 0, 0, 0, 0], 2)]
    assert mined(frame(spark, rows)) == brute(rows)  # row 0 has label 2: its positives are 1, 2 and 6
    assert mined(frame(spark, rows[:1])) == [] and mined(frame(spark, rows[1:])) == []
    assert mined(frame(spark, rows).limit(0)) == []
    assert mined(frame(spark, [(0, None, 1), (50, [1.0] * 6, None)])) == []


def test_a_search_enters_few_leaves_where_rows_lie_apart():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3200, 3))
    x = np.floor(2560 * x / np.sqrt((x * x).sum(axis=1))[:, None])
    most = float((x * x).sum(axis=1).max())
    tree = hardneg.Tree(x, most).grow(50)
    assert sorted(tree.order.tolist()) == list(range(3200))
    q = x[5]
    scores = tree.x @ q
    ids = np.arange(3200)[tree.order]

    class Counted:
        def __init__(self, a):
            self.a, self.seen = a, 0

        def __getitem__(self, at):
            self.seen += at.stop - at.start
            return self.a[at]

    low, high = np.sort(scores)[-60], np.sort(scores)[-20]
    tree.x = Counted(tree.x)
    got = list(tree.nearest(q, float(q @ q), tree.distances(q[None])[0], low, high, np.ones(3200, bool), ids, 3200))
    inside = np.flatnonzero((scores >= low) & (scores <= high))
    want = inside[np.lexsort((ids[inside], -scores[inside]))]
    assert [r for _, r in got] == want.tolist() and tree.x.seen <= 800


def test_bounds_of_leaves_hold():
    rng = np.random.default_rng(7)
    x, q = np.floor(256 * rng.standard_normal((4000, 8))), np.floor(256 * rng.standard_normal((50, 8)))
    most = float((x * x).sum(axis=1).max())
    top = hardneg.Tree(x[:500], most).grow(20)
    leaf = top.deal(x)
    least, best = top.reach(top.distances(q), (q * q).sum(axis=1))
    scores = q @ x.T
    assert (scores <= best[:, leaf]).all() and (scores >= least[:, leaf]).all()
