"""Level sets: closed, turned outwards, on the field's zero; holes only where values are missing."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointfield.operators import isosurface, meshes


def nodes(spark, f, n=8, low=-1.5, high=1.5):
    g = isosurface.grid(spark, (low,) * 3, (high,) * 3, n)
    return g.withColumn("v", F.expr(f)).withColumns({"p": F.lit("clash"), "m": F.lit(1)})


def mesh(spark, f, n=8, level=0.0):
    v, t = isosurface.extract(nodes(spark, f, n), n, level)
    at = {r.vid: np.array([r.x, r.y, r.z]) for r in v.collect()}
    return at, [(r.v0, r.v1, r.v2) for r in t.collect()]


def test_tables_by_volume_of_every_case():
    """For each case the triangles close the part of the tetrahedron below: all of them face away from every corner below."""
    for odd in (False, True):
        p = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], float)
        if odd:
            p[:, 0] *= -1
        for below, triangles in enumerate(isosurface._triangles(odd)):
            inside = [c for c in range(4) if below >> c & 1]
            assert len(triangles) == {0: 0, 1: 1, 2: 2, 3: 1, 4: 0}[len(inside)]
            for t in triangles:
                a, b, c = ((p[e[0]] + p[e[1]]) / 2 for e in t)
                normal = np.cross(b - a, c - a)
                assert all((p[k] - a) @ normal < 1e-12 for k in inside) and all((p[k] - a) @ normal > -1e-12 for k in range(4) if k not in inside)
    assert sum(len({*t["corners"]}) == 4 for t in isosurface._tetrahedra()) == 6


@pytest.mark.parametrize("f, euler, order", [("sqrt(x*x + y*y + z*z) - 1.1e0", 2, 2), ("sqrt(pow(sqrt(x*x + y*y) - 1e0, 2) + z*z) - 0.35e0", 0, 2), ("abs(x) + abs(y) + abs(z) - 1.2e0", 2, 1)])
def test_closed_and_outward(spark, f, euler, order):
    """Vertices are off by the square of the step where the field is smooth, by a part of the step at its kinks."""
    n = 14
    v, t = isosurface.extract(nodes(spark, f, n), n)
    got = meshes.quality(v, t).first()
    assert got.watertight and got.consistent and got.outward
    assert got.n_vertices - got.n_faces / 2 == euler
    worst = v.selectExpr(f"max(abs({f})) AS e").first().e
    assert worst < (3 / (n - 1)) ** order


def test_volume_of_a_ball(spark):
    at, t = mesh(spark, "sqrt(x*x + y*y + z*z) - 1e0", 16)
    volume = sum(at[a] @ np.cross(at[b], at[c]) for a, b, c in t) / 6
    assert volume == pytest.approx(4 / 3 * math.pi, rel=0.03)


def test_zero_at_nodes_missing_values_and_no_change_of_sign(spark):
    at, t = mesh(spark, "x", 4)  # no node at 0; a sheet that ends at the border: eight triangles across each of nine cubes
    assert {round(p[0], 9) for p in at.values()} == {0.0} and len(t) == 3 * 3 * 8
    at, t = mesh(spark, "x - 0.5e0", 4)  # a layer of nodes lies on the level and counts as above
    assert all(p[0] == pytest.approx(0.5) for p in at.values()) and t
    assert mesh(spark, "1e0 + x*x", 4) == ({}, [])
    whole = set(mesh(spark, "sqrt(x*x + y*y + z*z) - 1e0", 6)[1])
    holed = set(mesh(spark, "CASE WHEN i = 2 AND j = 2 AND k = 1 THEN NULL ELSE sqrt(x*x + y*y + z*z) - 1e0 END", 6)[1])
    assert holed < whole


def test_neighbouring_cubes_agree_on_random_values(spark):
    """Random signs: every edge inside the grid has two faces, turned against each other."""
    n = 6
    v, t = isosurface.extract(nodes(spark, "(pmod(xxhash64(i, j, k), 1000) - 499.5e0) / 500e0", n), n)
    faces = [(r.v0, r.v1, r.v2) for r in t.collect()]
    edges = [e for f in faces for e in zip(f, f[1:] + f[:1], strict=True)]
    assert len(edges) == len(set(edges))
    at = {r.vid: (r.x, r.y, r.z) for r in v.collect()}
    border = lambda e: any(all(abs(abs(at[q][a]) - 1.5) < 1e-9 and at[q][a] * at[e[0]][a] > 0 for q in e) for a in range(3))
    assert all((b, a) in set(edges) or border((a, b)) for a, b in itertools.islice(edges, 4000))


def test_noise_is_seeded_smooth_and_zero_on_the_lattice(spark):
    rows = spark.range(4000).selectExpr("id AS qid", "-5e0 + id * 0.0025e0 AS x", "0.3e0 AS y", "0.7e0 AS z")
    values = lambda df, **how: np.array([r.f for r in isosurface.with_noise(df, "f", **how).orderBy("qid").select("f").collect()])
    f = values(rows, seed=1)
    assert (f == values(rows.repartition(7), seed=1)).all() and not np.allclose(f, values(rows, seed=2), atol=0.05)
    assert abs(f).max() <= 1 and abs(f.mean()) < 0.2 and f.std() > 0.1
    assert abs(np.diff(f)).max() < 0.03  # no jumps at the lattice
    lattice = spark.range(27).selectExpr("id AS qid", "CAST(id % 3 AS DOUBLE) AS x", "CAST(id DIV 3 % 3 AS DOUBLE) AS y", "CAST(id DIV 9 AS DOUBLE) AS z")
    assert abs(values(lattice, octaves=1)).max() == 0
    assert isosurface.with_noise(spark.sql("SELECT CAST(NULL AS DOUBLE) AS x, 0e0 AS y, 0e0 AS z"), "f").first().f is None


def test_blobs_are_closed_and_differ_by_seed(spark):
    n = 12
    nodes_ = isosurface.grid(spark, (-2.0,) * 3, (2.0,) * 3, n)
    seen = set()
    for seed in (1, 2):
        v, t = isosurface.blob(nodes_, n, alpha=0.5, seed=seed)
        got = meshes.quality(v, t).first()
        assert got.watertight and got.consistent and got.outward
        seen.add(round(got.volume, 6))
        again = isosurface.blob(nodes_.repartition(5), n, alpha=0.5, seed=seed)
        assert meshes.quality(*again).first().n_faces == got.n_faces
    assert len(seen) == 2
