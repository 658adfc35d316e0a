"""Hard negatives against all pairs, in whole numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import hard_negatives
from tickloom.llm.hard_negatives import Table, mine

SHAPE = "vec_id long, embedding array<double>, label int"


def brute(rows, every, positives=5, negatives=10, low=30, high=90):
    good = {}
    for i, x, label in rows:
        if i is None or label is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = [math.floor(256 * c) for c in x]
        if sum(c * c for c in v) < 2**60 and (i not in good or (label, v) < good[i]):
            good[i] = (label, v)
    sizes = [len(v) for _, v in good.values()]
    size = min(sizes, key=lambda n: (-sizes.count(n), n), default=0)
    good = {i: (label, v) for i, (label, v) in good.items() if len(v) == size}
    out = set()
    for a in (i for i in good if i % every == 0):
        label, v = good[a]
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, (_, w) in good.items() if i != a)
        for s, p in [(-s, i) for s, i in scores if good[i][0] == label][:positives]:
            far = [(-t, n) for t, n in scores if good[n][0] != label and low * s <= -100 * t <= high * s][:negatives]
            out |= {(a, p, k, n, s, t) for k, (t, n) in enumerate(far, 1)}
    return out


def clustered(seed, n, dims=6, scale=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, dims)) * 2 * scale
    return [(k, (centres[r.integers(5)] + r.normal(size=dims) * scale).tolist(), int(r.integers(4))) for k in range(n)]


ODD = [(7000, None, 1), (7005, [1.0] * 6, None), (7010, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (7015, [1.0, math.nan, 1.0, 1.0, 1.0, 1.0], 1), (7020, [math.inf] * 6, 1), (7025, [1.0] * 5, 1), (7030, [], 1), (None, [9.0] * 6, 1), (7035, [0.0] * 6, 1), (7040, [1e9] * 6, 1), (10, [0.5] * 6, 9), (10, [0.5] * 6, 0)]


@pytest.mark.parametrize(("rows", "every"), [(clustered(1, 400) + ODD, 5), (clustered(2, 60, scale=3e5), 3), ([(k, [1.0, 2.0], k % 3) for k in range(90)], 4), (clustered(3, 6), 1), (ODD, 5)])
def test_like_all_pairs(spark, monkeypatch, rows, every):
    monkeypatch.setattr(hard_negatives, "LEAST", 16)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 64)
    frame = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 AS block", "'x' AS d", "2 AS v").repartition(3)
    got = [tuple(r) for r in mine(frame, F.col("vec_id") % every == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, every)


def test_relabelled(spark):
    rows = clustered(4, 150)
    got = {tuple(r) for r in mine(spark.createDataFrame(rows, SHAPE), F.col("vec_id") % 10 == 0, 3, 4, (10, 95), F.col("label") + F.col("vec_id") % 2).collect()}
    assert got == brute([(i, x, label + i % 2) for i, x, label in rows], 10, 3, 4, 10, 95) and got


def test_brackets_hold():
    v = np.floor(256 * np.array([x for _, x, _ in clustered(5, 500)])).astype(np.int64)
    table = Table(v, np.arange(500), np.zeros(500, np.int64), int((v**2).sum(axis=1).max()))
    own, asked = table.distances(v), table.distances(v, anchors=True)
    cut = 0
    for k in range(40):
        lower, upper = table.bracket(v[k], np.abs(own - asked[k]).max(axis=1), (own + asked[k]).min(axis=1))
        exact = v @ v[k]
        assert (lower <= exact).all() and (exact <= upper).all()
        cut += (upper < np.sort(exact)[-6]).sum()
    assert cut > 0.2 * 40 * len(v)  # of clusters the table rules many out


def test_empty(spark):
    assert mine(spark.createDataFrame([], SHAPE), F.col("vec_id") % 2 == 0).count() == 0
