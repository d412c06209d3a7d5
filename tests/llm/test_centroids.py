"""Centroid clustering against brute force in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k=16, rounds=3, dim=64, scale=64):
    good = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    z = [[math.floor(scale * x) if math.isfinite(scale * x) else math.floor(x) * scale for x in v] for _, v in good]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    order = sorted(range(len(good)), key=lambda j: (name(good[j][0]), good[j][1]))
    c = [list(z[j]) for j in order[:k]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c)) for x in z]
    for _ in range(rounds):
        to = assign()
        for j in range(len(c)):
            own = [x for x, t in zip(z, to) if t[1] == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    to, sums = assign(), {}
    for d, j in to:
        sums[j] = sums.get(j, 0) + d
    long = lambda x: x if x < 1 << 63 else None
    own = {j: (None if any(d >= 1 << 63 for d, t in to if t == j) else s) for j, s in sums.items()}
    all_ = None if None in own.values() else long(sum(own.values()))
    return sorted(
        ((i, j, long(d), None if own[j] is None else long(own[j]), all_, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(good, to)),
        key=str,
    )


def told(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_centroids(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    assert told(centroids.cluster(df)) == want
    assert told(centroids.cluster(df.repartition(7).withColumns({"id": F.lit(1), "v": F.lit(2), "cluster": F.lit(3)}))) == want


def small(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("size", [3, 1e3, 2.0**24, 2.0**40, 1e18, 1e30, 1e300])
def test_centroids_of_any_size(spark, size):
    """Small and huge components, ties, copies of one vector, and centroids that lie close together far from zero."""
    rnd = random.Random(size)
    rows = [(i, [rnd.uniform(-size, size) for _ in range(5)]) for i in range(60)]
    base = rows[0][1]
    rows += [(100 + i, [x + rnd.choice((0, 0, 1 / 64, -1 / 64)) for x in base]) for i in range(60)]
    rows += [(200 + i, list(base)) for i in range(20)] + [(300 + i, [float(rnd.choice((-1, 1))) for _ in range(5)]) for i in range(40)]
    got = told(centroids.cluster(small(spark, rows), k=9, dim=5))
    assert got == brute(rows, k=9, dim=5)


def test_centroids_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [1.0, -inf, 1.0]), (7, [0.5, -0.01, -0.0]), (None, [1.0, 1.0, 1.0]), (8, [1.0, 1.0, 1.0]), (8, [1.0, 1.0, 1.0]), (9, [2.0, 2.0, 2.0])]
    got = told(centroids.cluster(small(spark, rows), dim=3))
    assert got == brute(rows, dim=3) and len(got) == 5 and None in [r[0] for r in got]
    none = centroids.cluster(small(spark, rows).limit(0))
    assert none.columns[0] == "vec_id" and none.count() == 0
    assert centroids.cluster(small(spark, rows[:6]), dim=3).count() == 0


@pytest.mark.parametrize("size", [10, 1 << 12, 1 << 20, 1 << 26, 1 << 45, 1 << 60])
def test_intervals_hold_the_exact_value(size):
    rnd = np.random.default_rng(size)
    rows = [[int(x) for x in rnd.integers(-size, size + 1, 64)] for _ in range(12)]
    rows[1] = [x + 1 for x in rows[0]]
    c = centroids.Centroids(rows)
    z = rnd.integers(-size, size + 1, (40, 64)).astype(np.float64)
    low, high = c.intervals(z)
    for a in range(len(z)):
        x = [int(v) for v in z[a]]
        for b, y in enumerate(rows):
            true = sum(v * v for v in y) - 2 * sum(v * w for v, w in zip(x, y))
            assert int(math.floor(low[a, b])) <= true <= int(math.ceil(high[a, b]))


def test_screen_decides_most_and_overlaps_are_computed_again():
    rnd = np.random.default_rng(1)
    z = np.floor(rnd.normal(0, 20, (500, 64)))
    apart = centroids.Centroids([[int(x) for x in np.floor(rnd.normal(0, 20, 64))] for _ in range(16)])
    best, d, again = apart.nearest(z)
    assert again < 50
    full = [[sum((int(a) - b) ** 2 for a, b in zip(x, y)) for y in apart.rows] for x in z]
    assert best.tolist() == [f.index(min(f)) for f in full] and d.tolist() == [min(f) for f in full]
    twins = centroids.Centroids([apart.rows[0], apart.rows[0], apart.rows[1]])
    best, _, again = twins.nearest(z)
    assert 1 not in best and again >= 2 * (best == 0).sum()


def test_limbs():
    for n in (0, 1, -1, 2**39 - 1, 2**39, -(2**39), -(2**39) - 1, 3**80, -(3**80), 2**1100):
        parts = list(centroids._limbs(n))
        assert sum(v << (40 * k) for k, v in parts) == n and all(-(2**39) <= v < 2**40 for _, v in parts)
