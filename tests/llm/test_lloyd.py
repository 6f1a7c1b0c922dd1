"""Delta Lloyd against plain rounds of Lloyd's algorithm in whole numbers of any size."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lloyd


def plain(rows, k=8, rounds=10, dims=64, seed=3):
    """[(id, cluster, distance)], centroids; rows of (id, components)."""
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(whole, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()))
    centroids = [v for _, v in order[:k]]
    gap = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (gap(v, centroids[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in whole]
        for c in range(len(centroids)):
            mine = [v for (_, v), o in zip(whole, own, strict=True) if o == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, nearest(v), gap(v, centroids[nearest(v)])) for i, v in whole], centroids


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for name in ("id", "row", "v", "x", "owner", "near", "cluster", "part", "size", "total", "h"):
        df = df.withColumn(name, F.lit("x"))
    return df


def check(spark, rows, **more):
    found, centroids = lloyd.lloyd(vectors(spark, rows), **more)
    want, final = plain(rows, **more)
    assert centroids == final
    got = [(r.id, r.cluster, r.distance) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(((i, c, d if d < 1 << 63 else None) for i, c, d in want), key=repr)


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e30], ids=["floats", "longs", "whole"])
def test_any_size(spark, scale):
    """Each of the three kinds of numbers in which distances are exact."""
    rng = np.random.default_rng(7)
    rows = [(i, (rng.standard_normal(5) * scale).tolist()) for i in range(120)]
    kind = lloyd.arithmetic(5, max(abs(x) for _, v in rows for x in v) * 1024)
    assert kind == {1.0: lloyd.FLOATS, 1e5: lloyd.LONGS, 1e30: lloyd.WHOLE}[scale]
    check(spark, rows, k=4, rounds=6, dims=5)


def test_odd_rows(spark):
    good = [(i, [float(i % 3), 0.5 * (i % 5)]) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0]), (103, [1.0, 2.0, 3.0]), (104, [None, 1.0]), (105, [float("nan"), 1.0]), (106, [float("inf"), 0.0]), (None, [0.25, 0.25]), (7, [1.0, 1.0]), (7, [1.0, 1.0])]
    check(spark, good + odd, k=3, rounds=5, dims=2)


def test_few_and_equal_vectors(spark):
    check(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])], k=8, dims=2)  # as many clusters as vectors, ties to the first
    found, centroids = lloyd.lloyd(vectors(spark, [(1, [0.0])]), dims=2)
    assert found.collect() == [] and centroids == []


def test_only_what_changed_is_compared(monkeypatch):
    """A vector whose owner stayed meets the changed centroids only, and keeps its distance."""
    seen = []
    full = lloyd.distances
    monkeypatch.setattr(lloyd, "distances", lambda v, c: seen.append((len(v), len(c))) or full(v, c))
    v, c = np.array([[0.0], [10.0], [21.0]]), np.array([[0.0], [9.0], [20.0]])
    owner, near = lloyd.reassigned(v, np.array([0, 1, 2]), np.array([0.0, 4.0, 1.0]), c, np.array([False, True, False]))
    assert seen == [(1, 3), (2, 1)] and owner.tolist() == [0, 1, 2] and near.tolist() == [0.0, 1.0, 1.0]
    owner, near = lloyd.reassigned(np.array([[5.0]]), np.array([1]), np.array([25.0]), np.array([[0.0], [10.0]]), np.array([True, False]))
    assert (owner.tolist(), near.tolist()) == ([0], [25.0])  # a tie goes to the smaller number


def test_limbs():
    for n in (0, 1, -1, 1 << 40, -(1 << 40) - 1, 3**90, -(3**90)):
        parts = lloyd.limbs(n)
        assert sum(p << lloyd.LIMB * i for i, p in enumerate(parts)) == n and all(abs(p) <= 1 << lloyd.LIMB for p in parts)
