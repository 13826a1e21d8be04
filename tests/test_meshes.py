"""Searches over triangles and far fields against plain NumPy over all pairs."""

import math

import numpy as np
import pytest

from pointfield.operators import farfield, fields, meshes, neighbours, tiles
from pointfield.plans import catalog  # noqa: F401
from pointfield.plans.fixtures import frame

from .conftest import SF

TRIANGLE = "fid bigint, ax double, ay double, az double, bx double, by_ double, bz double, cx double, cy double, cz double, x double, t int"


def soup(n, seed):
    """Triangles of all sizes, many about one place, some without area, with columns whose names are used inside."""
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(n, 1, 3)) * rng.choice([0.01, 1.0, 3.0], size=(n, 1, 1))
    size = 10.0 ** rng.uniform(-3, 0.3, size=(n, 1, 1))
    t = at + rng.normal(size=(n, 3, 3)) * size
    t[::17, 2] = t[::17, 1]  # lines
    t[::29] = t[::29, :1]  # points
    t[5] = t[4]
    return t


def table(spark, t):
    rows = [(i, *map(float, x.reshape(-1)), 0.0, 1) for i, x in enumerate(t)]
    rows.append((10**6, None, *map(float, t[0].reshape(-1)[1:]), 0.0, 1))
    return spark.createDataFrame(rows, TRIANGLE).repartition(4)


def places(spark, q):
    rows = [(i, *map(float, x), "k") for i, x in enumerate(q)] + [(999, None, 0.0, 0.0, "k")]
    return spark.createDataFrame(rows, "qid bigint, x double, y double, z double, cell string")


def to_triangle(p, t):
    """Distance by projection on the plane, else by the three edges."""
    a, b, c = t
    if not np.cross(b - a, c - a).any():
        return np.linalg.norm(p - a)  # without area: its first corner
    best = min(_to_segment(p, u, v) for u, v in ((a, b), (b, c), (c, a)))
    n = np.cross(b - a, c - a)
    if n @ n > 0:
        foot = p - n * ((p - a) @ n) / (n @ n)
        if all(np.cross(v - u, foot - u) @ n >= 0 for u, v in ((a, b), (b, c), (c, a))):
            best = min(best, np.linalg.norm(p - foot))
    return best


def _to_segment(p, a, b):
    e = b - a
    k = np.clip((p - a) @ e / (e @ e), 0, 1) if e @ e else 0.0
    return np.linalg.norm(p - a - k * e)


@pytest.mark.parametrize("n", [1, 40, 1500])
def test_nearest_triangle(spark, n):
    t, rng = soup(max(n, 6), 3)[:n], np.random.default_rng(4)
    q = np.concatenate([rng.normal(size=(20, 3)) * 2, t[:3, 0]])
    got = {r.qid: r for r in meshes.nearest(places(spark, q), table(spark, t)).collect()}
    assert got[999].d is None and len(got) == len(q) + 1
    for i, p in enumerate(q):
        want = min(to_triangle(p, x) for x in t)
        assert got[i].d == pytest.approx(want, abs=1e-9)
        assert to_triangle(np.array([got[i].px, got[i].py, got[i].pz]), t[got[i].fid]) < 1e-9


def test_votes_of_the_nearest_triangles(spark):
    t, rng = soup(400, 13), np.random.default_rng(14)
    q = rng.normal(size=(12, 3)) * 2
    got = {r.qid: r.distance for r in meshes.voted_distance(places(spark, q), table(spark, t), 5).collect()}
    assert got[999] is None
    for i, p in enumerate(q):
        d = np.array([to_triangle(p, x) for x in t])
        near = np.argsort(d, kind="stable")[:5]
        votes = sum(np.sign(np.cross(t[j][1] - t[j][0], t[j][2] - t[j][0]) @ (p - t[j].mean(0))) for j in near)
        assert abs(got[i]) == pytest.approx(d.min(), abs=1e-9) and (got[i] > 0) == (votes > 0)


def test_no_triangles(spark):
    none, q = table(spark, soup(6, 1)).limit(0), places(spark, np.zeros((2, 3)))
    assert {r.d for r in meshes.nearest(q, none).collect()} == {None}
    assert {r.inside for r in farfield.inside(q, farfield.of_triangles(none), "solid_angle").collect()} == {None}
    rays = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "rid bigint, ox double, oy double, oz double, dx double, dy double, dz double")
    assert meshes.crossings(rays, none).count() == 0 and not meshes.first_hits(rays, none).first().hit
    assert {r.distance for r in meshes.voted_distance(q, none).collect()} == {None}
    assert meshes.in_boxes(q.selectExpr("qid", *[f"{c} AS b{n}{c}" for n in "lh" for c in "xyz"]), none).count() == 0


def moller(o, d, t):
    a, b, c = t
    m = np.stack([-d, b - a, c - a], 1)
    if abs(np.linalg.det(m)) <= 1e-8:
        return None
    k, u, v = np.linalg.solve(m, o - a)
    return k if k > 1e-8 and u >= 0 and v >= 0 and u + v <= 1 else None


def test_rays(spark, monkeypatch):
    monkeypatch.setattr(meshes, "AHEAD", 2)
    t, rng = soup(900, 8), np.random.default_rng(9)
    o, d = rng.normal(size=(60, 3)) * 3, rng.normal(size=(60, 3))
    d[:40] = -o[:40] + rng.normal(size=(40, 3)) * 0.3
    d[-6:] = np.repeat(np.eye(3), 2, 0)  # along the axes
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    rows = [(i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(o, d, strict=True))] + [(999, None, 0.0, 0.0, 1.0, 0.0, 0.0), (998, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    rays = spark.createDataFrame(rows, "rid bigint, ox double, oy double, oz double, dx double, dy double, dz double")
    index = farfield.of_triangles(table(spark, t))
    every = {(i, j): k for i in range(60) for j, x in enumerate(t) if (k := moller(o[i], d[i], x)) is not None}
    got = {(r.rid, r.fid): r.t for r in meshes.crossings(rays, index).collect()}
    assert got.keys() == every.keys() and all(got[k] == pytest.approx(v, abs=1e-7) for k, v in every.items())
    for low, high in ((0.0, math.inf), (1.0, 3.0)):
        first = {r.rid: r for r in meshes.first_hits(rays, index, low, high).collect()}
        assert len(first) == 62
        for i in range(60):
            want = min(((k, j) for (r, j), k in every.items() if r == i and low <= k < high), default=None)
            assert first[i].hit == (want is not None)
            if want:
                assert first[i].t == pytest.approx(want[0], abs=1e-7)
        assert not first[998].hit and not first[999].hit
    assert sum(first[i].hit for i in range(60)) > 5


def test_boxes(spark):
    t = soup(300, 11)
    q = np.random.default_rng(12).normal(size=(15, 3))
    boxes = places(spark, q).selectExpr("qid", *[f"{c} - 0.5e0 AS bl{c}" for c in "xyz"], *[f"{c} + 0.5e0 AS bh{c}" for c in "xyz"])
    got = {(r.qid, r.fid) for r in meshes.in_boxes(boxes, table(spark, t)).collect()}
    assert got == {(i, j) for i, p in enumerate(q) for j, x in enumerate(t) if (x.min(0) <= p + 0.5).all() and (x.max(0) >= p - 0.5).all()}


def test_many_objects_about_one_place_end_the_tree(spark):
    """Boxes that differ about one common centre can't be told apart by place; the tree must still be made."""
    k = np.arange(1, 700)
    t = np.stack([np.stack([[s, s, 0], [-s, s, 0], [0, -2 * s, 0]]) for s in k * 1e-3])
    got = meshes.nearest(places(spark, [[5.0, 5.0, 0.0]]), table(spark, t)).where("qid = 0").first()
    assert got.fid == 698


# Far fields.


def exact(q, p, n, a):
    r = q[:, None] - p[None]
    d = np.linalg.norm(r, axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nansum(np.where(d > 0, a * (r * n).sum(2) / d**3, 0.0), 1) / (4 * math.pi)


def cloud(spark, n, seed, shift=0.0):
    rng = np.random.default_rng(seed)
    p = rng.normal(size=(n, 3)) * rng.choice([0.02, 1.0], size=(n, 1)) + shift
    v = rng.normal(size=(n, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    a = rng.uniform(0, 2 / n, size=n)
    a[::7] *= -1
    a[::11] = 0
    rows = [(i, *map(float, (*p[i], *v[i], a[i]))) for i in range(n)] + [(10**6, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, None)]
    return p, v, a, spark.createDataFrame(rows, "pid bigint, x double, y double, z double, nx double, ny double, nz double, area double").repartition(3)


@pytest.mark.parametrize("n, shift, opening", [(1, 0.0, 2.0), (3000, 0.0, 1.2), (3000, 1000.0, 3.0), (3000, 0.0, math.inf)])
def test_bounds_hold(spark, n, shift, opening):
    p, v, a, df = cloud(spark, n, 21, shift)
    q = np.concatenate([np.random.default_rng(22).normal(size=(30, 3)) * 2 + shift, p[:2]])
    got = {r.qid: r for r in farfield.winding(places(spark, q), farfield.of_points(df), tolerance=None, opening=opening).collect()}
    want = exact(q, p, v, a)
    assert got[999].field is None
    assert all(abs((got[i].field or 0.0) - want[i]) <= got[i].bound + 1e-9 * (1 + abs(want[i])) for i in range(len(q)))
    if opening == math.inf:
        assert max(r.bound for r in got.values()) == 0


def test_tolerance_is_kept(spark):
    p, v, a, df = cloud(spark, 3000, 23)
    q = np.random.default_rng(24).normal(size=(30, 3)) * 2
    index = farfield.of_points(df)
    want = exact(q, p, v, a)
    for tolerance in (0.1, 1e-4):
        got = {r.qid: r for r in farfield.winding(places(spark, q), index, tolerance=tolerance).collect()}
        assert all(abs(got[i].field - want[i]) <= got[i].bound + 1e-9 <= tolerance + 2e-9 for i in range(30))


def test_deep_levels_are_joined_not_broadcast(spark, monkeypatch):
    for module in (farfield, neighbours, meshes):
        monkeypatch.setattr(module, "BROADCAST_CELLS", 8)
    p, v, a, df = cloud(spark, 2000, 25)
    q = np.random.default_rng(26).normal(size=(20, 3)) * 2
    got = {r.qid: r for r in farfield.winding(places(spark, q), farfield.of_points(df), tolerance=None).collect()}
    want = exact(q, p, v, a)
    assert all(abs(got[i].field - want[i]) <= got[i].bound + 1e-9 for i in range(20))


def test_regularised_field_and_the_fixture(spark):
    c, q = frame(spark, SF, "cloud_sphere"), frame(spark, SF, "queries")
    index = farfield.of_points(c)
    for name in ("winding", "regularised_winding"):
        got = {r.qid: r for r in farfield.winding(q, index, name, tolerance=None).collect()}
        want = {r.qid: r.field for r in fields.compare(name, q, c).collect()}
        assert all(abs(got[k].field - w) <= got[k].bound + 1e-9 for k, w in want.items())


@pytest.mark.parametrize("n, shift, opening", [(1, 0.0, 2.0), (3000, 0.0, 1.2), (3000, 1000.0, 3.0), (3000, 0.0, math.inf)])
def test_bounds_hold_by_tiles(spark, monkeypatch, n, shift, opening):
    monkeypatch.setattr(tiles, "TILE", 256)
    p, v, a, df = cloud(spark, n, 21, shift)
    q = np.concatenate([np.random.default_rng(22).normal(size=(30, 3)) * 2 + shift, p[:2]])
    got = {r.qid: r for r in farfield.winding(places(spark, q), farfield.tiled(df), tolerance=None, opening=opening).collect()}
    want = exact(q, p, v, a)
    assert got[999].field is None
    assert all(abs((got[i].field or 0.0) - want[i]) <= got[i].bound + 1e-9 * (1 + abs(want[i])) for i in range(len(q)))
    assert opening == 3.0 and n > 1 or opening < math.inf or max(r.bound for r in got.values()) == 0
    assert farfield.inside(places(spark, q), farfield.tiled(df.limit(0))).where("inside IS NOT NULL").isEmpty()


def test_both_kernels_by_tiles_on_the_fixture(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 32)
    c, q = frame(spark, SF, "cloud_sphere"), frame(spark, SF, "queries")
    for name in ("winding", "regularised_winding"):
        got = {r.qid: r for r in farfield.winding(q, farfield.tiled(c), name, tolerance=1e-3).collect()}
        want = {r.qid: r.field for r in fields.compare(name, q, c).collect()}
        assert all(abs(got[k].field - w) <= got[k].bound + 1e-9 <= 1e-3 + 1e-8 for k, w in want.items())


def test_no_product_in_the_plan(spark):
    """Queries meet cells and sources by equi-joins; the one join without keys is with the root's cells, 8 at most."""
    q = places(spark, np.zeros((3, 3)))
    plans = [
        farfield._descend(q, farfield.of_points(cloud(spark, 500, 1)[3]), "winding", 3.0, 0.1),
        neighbours.candidates(q, meshes.tree(table(spark, soup(500, 2))), 1),
        meshes.nearest(q, table(spark, soup(500, 2))),
    ]
    for plan in plans:
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in text and text.count("NestedLoop") <= 1


def test_odd_boxes_over_many_tiles(spark, monkeypatch):
    """Over many tiles, boxes that touch, are points, turned round, without end, or lack a side; no join runs over the pairs."""
    from pointfield.operators import tiles

    for name, value in (("TILE", 16), ("SAMPLED", 200), ("ASKED", 7)):
        monkeypatch.setattr(tiles, name, value)
    t = np.round(soup(200, 13) * 8) / 8
    low, high = np.round(np.random.default_rng(14).normal(size=(2, 12, 3)) * 8) / 8
    low[0], high[0] = t[0].max(0), t[0].max(0)
    high[1], low[2] = np.inf, -np.inf
    names = [f"b{n}{c}" for n in "lh" for c in "xyz"]
    rows = [(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(low, high, strict=True))] + [(99, None, 0.0, 0.0, 1.0, 1.0, 1.0)]
    boxes = spark.createDataFrame(rows, "qid bigint, " + ", ".join(f"{n} double" for n in names))
    got = meshes.in_boxes(boxes, table(spark, t))
    assert sorted((r.qid, r.fid) for r in got.collect()) == [(i, j) for i in range(12) for j, x in enumerate(t) if (x.min(0) <= high[i]).all() and (x.max(0) >= low[i]).all()]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange") and "Join" not in plan[: plan.index("Exchange")]


def test_smoothed_far_fields_within_the_smoothing(spark, monkeypatch):
    """Cells nearer than 6.5 epsilon stand for their sources too, within the bounds; the factors and the table of bounds against differences."""
    soft = farfield.smoothed(0.1)
    t, h = np.linspace(0.3, 6.0, 400), 1e-5
    (k, slope), (more, _), (less, _) = (soft.factors(x) for x in (t, t + h, t - h))
    assert np.allclose(slope / t, (more - less) / (2 * h), atol=1e-6)
    rng, at = np.random.default_rng(5), lambda v: (v * (soft.factors(r := np.linalg.norm(v, axis=1))[0] / r**3)[:, None])
    v, u, d = rng.normal(size=(300, 3)), rng.normal(size=(300, 3)), 1e-3
    u /= np.linalg.norm(u, axis=1)[:, None]
    curve = ((at(v + d * u) - 2 * at(v) + at(v - d * u)) * u).sum(1) / d**2
    assert (np.abs(curve) <= soft.third(0.1 * (np.linalg.norm(v, axis=1) - d)) * 0.1**4 + 1e-5).all()
    met, every = [], farfield.Cells.met

    monkeypatch.setattr(tiles, "TILE", 64)
    p, n, a, df = cloud(spark, 3000, 31)
    q = np.concatenate([rng.normal(size=(60, 3)), p[:2] + 0.01])
    c = farfield.tiled(df).cells
    open_, _, _ = every(c, q, 1.5, soft)
    near = np.linalg.norm(q[:, None] - c.centre[None], axis=2) < 6.5 * 0.1
    assert (near & ~open_).any()
    qs = places(spark, q)
    want = {r.qid: r.field for r in fields.compare("regularised_winding", qs, df).collect()}
    for opening in (1.5, 3.0):
        got = {r.qid: r for r in farfield.winding(qs, farfield.tiled(df), "regularised_winding", tolerance=None, opening=opening).collect()}
        assert all(abs(got[i].field - want[i]) <= got[i].bound + 1e-9 for i in range(len(q)))
        met.append(max(r.bound for r in got.values() if r.field is not None))
    assert 0 < met[1] < met[0]


def test_solid_angles_by_tiles(spark, monkeypatch):
    """Triangles dealt into tiles against the exact sum, on both sides and at corners; without triangles nothing is inside."""
    monkeypatch.setattr(tiles, "TILE", 64)
    t = soup(1500, 41)
    q = np.concatenate([np.random.default_rng(42).normal(size=(40, 3)) * 2, t[:2].mean(1) + 0.05])
    tri, qs = table(spark, t), places(spark, q)
    want = {r.qid: r.winding for r in meshes.distances(qs.drop("cell"), tri.select("fid", *meshes.TRIANGLE)).collect()}
    for opening in (1.5, 3.0, math.inf):
        got = {r.qid: r for r in farfield.winding(qs, farfield.tiled_triangles(tri), "solid_angle", tolerance=None, opening=opening).collect()}
        assert all(abs(got[i].field - want[i]) <= got[i].bound + 1e-8 for i in range(len(q)))
    near = {r.qid: r.d for r in meshes.nearest(qs, farfield.tiled_triangles(tri)).collect()}
    assert near == {r.qid: r.d for r in meshes.nearest(qs, meshes.tree(tri)).collect()}
    assert farfield.inside(qs, farfield.tiled_triangles(tri.limit(0)), "solid_angle").where("inside IS NOT NULL").isEmpty()
