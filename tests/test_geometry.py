"""Closed forms, invariants and brute force."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from pointfield.functions import shapes
from pointfield.functions.expr import Program, col
from pointfield.operators import fields, meshes, neighbours, predictor, sampling
from pointfield.operators.fields import Evaluation
from pointfield.plans.fixtures import frame

from .conftest import SF


def test_sphere_patches_give_the_sphere(spark):
    cloud = fields.tori(frame(spark, SF, "cloud_sphere"), frame(spark, SF, "coeffs_sphere"))
    q = frame(spark, SF, "queries")
    for how in (Evaluation(k=32), Evaluation(k=32, isovalue=0.25), Evaluation(radius=0.7)):
        got = fields.evaluate(q, cloud, how, gradient=True).join(q, "qid").collect()
        assert len(got) == q.count()
        for r in got:
            length = math.sqrt(r.x**2 + r.y**2 + r.z**2)
            assert abs(r.distance - (length - 1 - how.isovalue)) < 1e-9
            assert max(abs(r.gx - r.x / length), abs(r.gy - r.y / length), abs(r.gz - r.z / length)) < 1e-6


def test_field_gradient_is_the_difference_quotient(spark):
    cloud = fields.tori(frame(spark, SF, "cloud_sphere"), frame(spark, SF, "coeffs_generic"))
    q = frame(spark, SF, "queries_few")
    h, how = 1e-6, Evaluation()
    g = {r.qid: r for r in fields.evaluate(q, cloud, how, gradient=True).collect()}
    up, down = ({r.qid: r.distance for r in fields.evaluate(q.withColumn("x", F.col("x") + s * h), cloud, how).collect()} for s in (1, -1))
    # the shift moves with the query, and with it lambda; the gradient holds it fixed, so agreement is close, not exact
    assert np.median([abs((up[k] - down[k]) / (2 * h) - g[k].gx) for k in g]) < 0.05


def test_many_neighbours_equal_all_pairs(spark):
    cloud = fields.tori(frame(spark, SF, "cloud_sphere"), frame(spark, SF, "coeffs_generic"))
    q, n = frame(spark, SF, "queries_few"), cloud.count()
    every = {r.qid: r.distance for r in fields.evaluate(q, cloud, Evaluation()).collect()}
    for how in (Evaluation(k=n), Evaluation(k=n + 50), Evaluation(radius=50.0)):
        assert all(abs(r.distance - every[r.qid]) < 1e-9 for r in fields.evaluate(q, cloud, how).collect())


def test_query_on_a_point(spark):
    cloud = fields.tori(frame(spark, SF, "cloud_sphere"), frame(spark, SF, "coeffs_sphere"))
    q = frame(spark, SF, "cloud_sphere").where("pid = 5").selectExpr("pid AS qid", "x", "y", "z")
    (r,) = fields.evaluate(q, cloud, Evaluation(k=8), gradient=True).collect()
    assert abs(r.distance) < 1e-9 and r.gx is None
    (r,) = fields.evaluate(q, cloud, Evaluation(k=1), gradient=True).collect()
    assert r.distance is None


@pytest.mark.parametrize("kind", ["volume", "clusters", "duplicates", "line", "one"])
def test_knn_equals_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    p = {
        "volume": rng.uniform(-1, 1, (700, 3)),
        "clusters": np.concatenate([rng.normal(c, 0.01, (200, 3)) for c in (0, 5, -40)]),
        "duplicates": np.repeat(rng.integers(-2, 3, (60, 3)).astype(float), 6, 0),
        "line": np.stack([np.linspace(0, 1, 300), np.zeros(300), np.zeros(300)], 1),
        "one": np.array([[1.0, 2.0, 3.0]]),
    }[kind]
    q = np.concatenate([p[:20], rng.uniform(-60, 60, (30, 3))])
    cloud = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "pid bigint, x double, y double, z double")
    asked = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(q)], "qid bigint, x double, y double, z double")
    for k in (1, 7):
        got = {}
        for r in neighbours.knn(asked, cloud, k).collect():
            got.setdefault(r.qid, {})[r.rank] = r.pid
        for i, x in enumerate(q):
            d = p - x
            d = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
            assert [got[i][j] for j in sorted(got[i])] == sorted(range(len(p)), key=lambda j: (d[j], j))[:k]
    assert neighbours.within(asked, cloud, 0.5).count() == sum(int((np.linalg.norm(p - x, axis=1) <= 0.5).sum()) for x in q)
    with pytest.raises(ValueError):
        neighbours.knn(asked, cloud, 0)


def test_empty_clouds(spark):
    none = spark.createDataFrame([], "pid bigint, x double, y double, z double")
    asked = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "qid bigint, x double, y double, z double")
    assert neighbours.knn(asked, none, 3).count() == 0
    assert neighbours.knn(asked.limit(0), none.union(asked.selectExpr("qid", "x", "y", "z")), 3).count() == 0


@pytest.mark.parametrize("name", sorted(shapes.SHAPES))
def test_shape_gradients(spark, name):
    h = 1e-6
    value, (gx, gy) = shapes.value_and_gradient(name, (col("x"), col("y")))
    at = lambda dx, dy: shapes.value(name, (col("x") + dx, col("y") + dy))
    program = Program(v=value, gx=gx, gy=gy, dx=(at(h, 0) - at(-h, 0)) / (2 * h), dy=(at(0, h) - at(0, -h)) / (2 * h), fx=(at(h, 0) - value) / h)
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.uniform(-1.3, 1.3), rng.uniform(-1.3, 1.3)) for i in range(500)], "i int, x double, y double")
    rows = program.on(df).collect()
    smooth = [r for r in rows if abs(r.dx - r.fx) < 1e-3]
    assert len(smooth) > 450
    assert sum(abs(r.gx - r.dx) < 1e-3 and abs(r.gy - r.dy) < 1e-3 for r in smooth) > 0.98 * len(smooth)
    assert sum(abs(math.hypot(r.gx, r.gy) - 1) < 1e-6 for r in smooth) > 0.97 * len(smooth)
    assert any(r.v < 0 for r in rows) and any(r.v > 0 for r in rows)


def test_cube_mesh_is_the_box(spark):
    q = frame(spark, SF, "queries")
    got = meshes.signed_distance(q, frame(spark, SF, "mesh_cube")).join(q, "qid").collect()
    for r in got:
        w = [abs(c) - 0.5 for c in (r.x, r.y, r.z)]
        want = math.sqrt(sum(max(c, 0) ** 2 for c in w)) + min(max(w), 0)
        assert abs(r.distance - want) < 1e-9


def test_samples_follow_areas(spark):
    got = sampling.on_surface(frame(spark, SF, "mesh_cube"), 6000, 9)
    per = {r.fid: r["count"] for r in got.groupBy("fid").count().collect()}
    assert got.count() == 6000 and len(per) == 12 and all(380 < n < 620 for n in per.values())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sampling.on_surface(frame(spark, SF, "mesh_cube").repartition(5), 6000, 9).collect()))


def test_farthest_points(spark):
    cloud = frame(spark, SF, "cloud_sphere").select("pid", "x", "y", "z")
    p = np.array([(r.x, r.y, r.z) for r in cloud.orderBy("pid").collect()])
    order, d = [0], np.full(len(p), np.inf)
    for _ in range(19):
        d = np.minimum(d, ((p - p[order[-1]]) ** 2).sum(1))
        order.append(int(d.argmax()))
    assert [r.pid for r in sampling.farthest_points(cloud, 20).orderBy("rank").collect()] == order


def test_areas_add_up_to_the_sphere(spark):
    cloud = frame(spark, SF, "cloud_sphere")
    total = predictor.areas(cloud.select("pid", "x", "y", "z", "nx", "ny", "nz"), 20).agg(F.sum("area")).first()[0]
    assert abs(total / (4 * math.pi) - 1) < 0.08


def test_least_squares_patch_of_the_sphere(spark):
    cloud = frame(spark, SF, "cloud_sphere").select("pid", "x", "y", "z", "nx", "ny", "nz")
    got = predictor.coefficients(cloud, predictor.least_squares, 12).collect()
    assert len(got) == cloud.count() and np.median([abs(r.a20 + 0.5) + abs(r.a02 + 0.5) for r in got]) < 0.1


def crowd(seed, n):
    """Points that crowd on two scales far from one another, some in one place, and lone ones far off."""
    r = np.random.default_rng(seed)
    near = r.normal(size=(n, 3)) * 1e-3
    nearer = r.normal(size=(n, 3)) * 1e-7 + 0.5
    return np.vstack([near, nearer, np.repeat([[0.25, 0.25, 0.25]], n // 2, axis=0), [[1e6, 0, 0], [0, -1e9, 1]]])


def test_crowded_cells_are_split(spark):
    p = crowd(1, 1500)
    cloud = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "pid bigint, x double, y double, z double")
    index = neighbours.tree(cloud)
    cells, n = index.levels[-1]
    assert cells.count() == n and cells.agg({"m": "sum"}).first()[0] == len(p) == index.points.count()
    wide = cells.where("hx > lx or hy > ly or hz > lz").agg({"m": "max"}).first()[0]
    assert wide <= neighbours.FULL
    q = np.vstack([p[::400] + 1e-8, [[5e5, 1, 1]]])
    asked = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(q)], "qid bigint, x double, y double, z double")
    want = {}
    for i, x in enumerate(q):
        d = np.sqrt(((x - p) ** 2).sum(axis=1))
        want[i] = sorted(zip(d.tolist(), range(len(p)), strict=True))[:5]
    got = {}
    for r in neighbours.knn(asked, index, 5).collect():
        got.setdefault(r.qid, {})[r["rank"]] = (r.d, r.pid)
    for i, w in want.items():
        assert [got[i][k + 1][0] for k in range(5)] == pytest.approx([d for d, _ in w], rel=1e-12, abs=1e-300)


def test_plan_grows_with_the_depth_alone(spark):
    cloud = spark.range(50).selectExpr("id as pid", "cast(id as double) as x", "0.0d as y", "0.0d as z")
    asked = cloud.withColumnRenamed("pid", "qid")
    index = neighbours.tree(cloud)
    cells = index.levels[0][0]
    sizes = {}
    for depth in (4, 8, 16):
        deep = neighbours.Tree(index.points, [(cells, 1 << 20)] * depth, index.n)
        plan = neighbours.knn(asked, deep, 3)._jdf.queryExecution().optimizedPlan().toString()
        sizes[depth] = sum(len(line.lstrip(" :+-")) for line in plan.splitlines())  # without the indents
    assert sizes[16] - sizes[8] < 2.2 * (sizes[8] - sizes[4]) and sizes[16] < 60_000


def test_radius_of_nothing(spark):
    cloud = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, -0.0, 0.0, 1.0), (3, None, 0.0, 1.0)], "pid bigint, x double, y double, z double")
    asked = cloud.withColumnRenamed("pid", "qid")
    assert sorted((r.qid, r.pid, r.d) for r in neighbours.within(asked, cloud, 0.0).collect()) == [(1, 1, 0.0), (1, 2, 0.0), (2, 1, 0.0), (2, 2, 0.0)]
    assert neighbours.within(asked, cloud, -1.0).count() == 0
    assert sorted((r.qid, r.pid) for r in neighbours.knn(asked, cloud, 5).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_curvatures_against_the_shape_operator(spark):
    """Eigenvalues and directions by numpy, from the two forms; the polynomial's table gives the same; fits lie on the surface."""
    from pointfield.functions import torus
    from pointfield.functions.expr import Program, vec

    rng = np.random.default_rng(11)
    rows = []
    for i in range(60):
        n = rng.normal(size=3)
        n /= np.linalg.norm(n)
        rows.append((i, *map(float, rng.normal(size=3)), *map(float, n), *map(float, rng.uniform(-1, 1, 6))))
    df = spark.createDataFrame(rows, "pid bigint, x double, y double, z double, nx double, ny double, nz double, " + ", ".join(f"{c} double" for c in torus.NAMES))
    named = df.withColumnsRenamed({c: f"c{c[1]}{c[2]}" for c in torus.NAMES})
    outputs = lambda c: dict(zip(("lo", "hi", "vx", "vy", "vz"), (*(k := torus.curvatures(vec("n"), c))[:2], *k[2]), strict=True))
    got = {r.pid: r for r in Program(**outputs(torus.coefficients())).on(df, "pid").collect()}
    assert got == {r.pid: r for r in Program(**outputs(torus.polynomial())).on(named, "pid").collect()}
    for r in df.collect():
        n = np.array([r.nx, r.ny, r.nz])
        u = np.array([0, 1, 0] if abs(n[0]) > 0.9 else [1, 0, 0])
        s = np.cross(n, u)
        s /= np.linalg.norm(s)
        t = np.cross(n, s)
        ru, rv = s + r.a10 * n, t + r.a01 * n
        first = np.array([[ru @ ru, ru @ rv], [ru @ rv, rv @ rv]])
        second = np.array([[2 * r.a20, r.a11], [r.a11, 2 * r.a02]]) / np.linalg.norm(np.cross(ru, rv))
        k, e = np.linalg.eig(np.linalg.solve(first, second))
        at = int(np.argmin(abs(k)))
        assert (got[r.pid].lo, got[r.pid].hi) == pytest.approx((k[at], k[1 - at]), rel=1e-7)
        v, w = e[0, at] * ru + e[1, at] * rv, np.array([got[r.pid].vx, got[r.pid].vy, got[r.pid].vz])
        assert abs(v @ w) == pytest.approx(np.linalg.norm(v) * np.linalg.norm(w), rel=1e-9)


def test_regular_polygons(spark):
    """Sides, corners and centre of the hexagon and the pentagon of inradius 0.6."""
    six, five = 0.6 / math.cos(math.pi / 6), 0.6 / math.cos(math.pi / 5)
    rows = [(0.0, 0.0, -0.6, -0.6), (0.0, 1.0, 0.4, 1 - five), (0.0, -1.0, 0.4, 0.4), (1.0, 0.0, 1 - six, None), (2.0, 0.0, 2 - six, None), (0.0, 2.0, 1.4, 2 - five), (0.1, 0.5, -0.1, None)]
    df = spark.createDataFrame(rows, "x double, y double, six double, five double")
    for r in Program(a=shapes.value("hexagon", (col("x"), col("y"))), b=shapes.value("pentagon", (col("x"), col("y")))).on(df).collect():
        assert r.a == pytest.approx(r.six)
        assert r.five is None or r.b == pytest.approx(r.five)
