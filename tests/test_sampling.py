"""Farthest points over many tasks: the order of the plain sequential search, ties included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointfield.operators import sampling


def sequential(rows, n):
    rows = sorted(r for r in rows if None not in r)
    if len(rows) <= n:
        return [r[0] for r in rows]
    p = np.array([r[1:] for r in rows])
    order, d = [0], np.full(len(p), np.inf)
    while len(order) < n:
        d = np.minimum(d, ((p - p[order[-1]]) ** 2).sum(1))
        order.append(int(d.argmax()))
    return [rows[k][0] for k in order]


def grid():
    """A grid: very many ties."""
    return [((i * 81 + j * 9 + k) * 37 % 1009, float(i), float(j), float(k)) for i in range(9) for j in range(9) for k in range(9)]


def random(m=3000):
    return [(int(i), *map(float, v)) for i, v in enumerate(np.random.default_rng(3).normal(size=(m, 3)))]


def same_place():
    return [(i, 1.0, 2.0, 3.0) for i in range(50)] + [(99, 5.0, 5.0, 5.0)]


@pytest.mark.parametrize("rows, n", [(grid(), 60), (random(), 150), (same_place(), 10), (random(5), 9), (random(5), 0), ([], 3)])
@pytest.mark.parametrize("candidates, points", [(1 << 16, 1 << 18), (256, 100)])
def test_order_equals_the_sequential_one(spark, monkeypatch, rows, n, candidates, points):
    monkeypatch.setattr(sampling, "CANDIDATES", candidates)
    monkeypatch.setattr(sampling, "TASK_POINTS", points)
    odd = [(None, 0.0, 0.0, 0.0), (10**7, None, 0.0, 0.0)]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows + odd], "pid bigint, x double, y double, z double, d int, rank_ string").repartition(3)
    got = sampling.farthest_points(df, n).orderBy("rank").collect()
    want = sequential(rows, n) if n else []
    assert [r.pid for r in got] == want and [r["rank"] for r in got] == list(range(1, len(want) + 1))


@pytest.mark.parametrize("n", [0, 1, 499, 500, 3000])
def test_first_in_order_equals_a_sort(spark, n):
    df = spark.range(500).withColumnRenamed("id", "k").repartition(5)
    got = {r.k for r in sampling.first_in_order(df, "k", n, 9).where("_first").collect()}
    want = df.orderBy(F.xxhash64(F.lit(9), "k"), "k").limit(n).collect()
    assert got == {r.k for r in want}
    assert sampling.first_in_order(df, "k", n, 9).count() == 500


def test_surface_draws_across_ranges_of_ids(spark, monkeypatch):
    """Areas 1 : 2 : 3 : .. over many ranges give draws in that proportion, and as many as are asked for."""
    monkeypatch.setattr(sampling, "DEALT", 3)
    rows = [(i, 0.0, 0.0, float(i), 2.0 * (i + 1), 0.0, float(i), 0.0, 1.0, float(i)) for i in range(10)]
    tri = spark.createDataFrame(rows, "fid bigint, ax double, ay double, az double, bx double, by_ double, bz double, cx double, cy double, cz double")
    got = sampling.on_surface(tri, 11_000, 3).collect()
    assert sorted(r.pid for r in got) == list(range(11_000)) and all(round(r.z, 9) == r.fid for r in got)
    counts = np.bincount([r.fid for r in got], minlength=10)
    assert abs(counts - 200 * np.arange(1, 11)).max() < 6 * np.sqrt(2000)
