"""Rays are marched to their ends and cross all they meet."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from pointfield.functions import shapes, torus
from pointfield.functions.expr import Program, over_arrays, vec
from pointfield.operators import fields, marching
from pointfield.operators.fields import Evaluation
from pointfield.plans.fixtures import frame

from .conftest import SF

COLUMNS = "rid bigint, ox double, oy double, oz double, dx double, dy double, dz double"


def grazing(spark):
    """Parallel lines that pass the unit sphere's centre at these distances; the last ones need hundreds of steps."""
    rows = [(i, -2.5, h, 0.0, 1.0, 0.0, 0.0) for i, h in enumerate((0.0, 0.5, 0.9, 0.99, 0.999, 0.9999, 1.001, 1.01, 1.5))]
    return spark.createDataFrame(rows, COLUMNS), {r[0]: r[2] for r in rows}


def test_no_ray_of_the_field_is_left_unfinished(spark):
    rays, height = grazing(spark)
    cloud = fields.tori(frame(spark, SF, "cloud_sphere"), frame(spark, SF, "coeffs_sphere"))
    got = {r.rid: r for r in marching.field_crossings(rays, cloud, Evaluation(k=8)).collect()}
    first = {r.rid: r for r in marching.trace_field(rays, cloud, Evaluation(k=8)).collect()}
    assert sorted(got) == sorted(height)
    for i, h in height.items():
        assert got[i].state == marching.ENDED and first[i].hit == (h < 1)
        want = [2.5 - math.sqrt(1 - h * h), 2.5 + math.sqrt(1 - h * h)] if h < 1 else []
        if h < 0.99:  # beyond, both crossings lie within the tolerance's reach
            assert np.allclose(got[i].found, want, atol=1e-3)
            assert first[i].t == (got[i].found[0] if want else got[i].t)


def test_rounds_of_many_steps_equal_brute_force(spark):
    rays = frame(spark, SF, "rays").where("rid <= 6")
    cloud = fields.finite(fields.tori(frame(spark, SF, "cloud_sphere"), frame(spark, SF, "coeffs_generic")))
    c = cloud.orderBy("pid").toPandas()
    assert len(c) > 8 * marching.NEARBY
    g, places = marching._made(over_arrays(torus.distance(vec(""), torus.columns()))), c[["x", "y", "z"]].to_numpy()

    def phi(at):
        d = np.sqrt(((places - at) ** 2).sum(1))
        near = np.argsort(d, kind="stable")[:8]
        here = {n: c[n].to_numpy()[near] for n in torus.columns()} | dict(zip("xyz", at, strict=True))
        shift = d[near].max() / 2
        w = np.where(c.outlier.to_numpy()[near], 0, np.exp(-64 / shift * (d[near] - shift)))
        return abs((w * g(here)).sum() / w.sum())

    got = {r.rid: r.found for r in marching.field_crossings(rays, cloud, Evaluation(k=8), 4.5).collect()}
    assert len(got) == rays.count() and any(got.values())
    for r in rays.collect():
        o, d, t, want = np.array([r.ox, r.oy, r.oz]), np.array([r.dx, r.dy, r.dz]), 0.0, []
        while t < 4.5:  # the reference's loop
            f = phi(o + t * d)
            if f < 1e-4:
                want.append(t)
                while f < 1e-4:
                    t += max(f, 1e-4)
                    f = phi(o + t * d)
            t += f
        assert np.allclose(got[r.rid], want, atol=1e-6)


def test_lifted_shape_is_crossed_on_all_sides(spark):
    """A ring's section has four crossings; a ray along a face takes thousands of steps."""
    rays = spark.createDataFrame([(0, -2.0, 0.0, 0.0, 1.0, 0.0, 0.0), (1, -2.0, 0.3, 0.0, 1.0, 0.0, 0.0)], COLUMNS)
    got = {r.rid: r.found for r in marching.shape_crossings(rays, "circle", "revolved", 0.6, r=0.2).collect()}
    assert np.allclose(got[0], [1.2, 1.6, 2.4, 2.8], atol=1e-3) and got[1] == []
    along = spark.createDataFrame([(0, -2.0, 0.0, 0.25005, 1.0, 0.0, 0.0), (1, -2.0, 0.0, 0.2502, 1.0, 0.0, 0.0)], COLUMNS)
    got = {r.rid: r for r in marching.trace_shape(along, "box", "extruded", 0.25).collect()}
    assert got[0].hit and got[1].hit is False and got[1].t >= 6


def test_formulas_over_arrays_equal_sql(spark):
    rng = np.random.default_rng(4)
    p = rng.uniform(-1.5, 1.5, (200, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "i int, x double, y double, z double")
    for name in shapes.SHAPES:
        for lift in (shapes.revolved, shapes.extruded):
            e = lift(name, vec(""), 0.3)
            want = [r.v for r in Program(v=e).on(df, "i").orderBy("i").collect()]
            assert np.allclose(marching._made(over_arrays(e))(dict(zip("xyz", p.T, strict=True))), want, atol=1e-12), name


def test_a_ray_without_a_field_is_no_miss(spark):
    rays, _ = grazing(spark)
    cloud = fields.tori(frame(spark, SF, "cloud_sphere"), frame(spark, SF, "coeffs_sphere")).where(F.lit(False))
    got = marching.trace_field(rays, cloud, Evaluation(k=8)).collect()
    assert len(got) == rays.count() and all(r.hit is None for r in got)


def test_training_gradient_is_the_difference_quotient_at_fixed_weights(spark):
    """Against central differences of the masked sum with lambda and shift held, in NumPy; padding and tori that aren't finite count for nothing."""
    cloud = fields.tori(frame(spark, SF, "cloud_sphere"), frame(spark, SF, "coeffs_generic")).withColumn("mask", F.expr("pid % 3 > 0"))
    cloud = cloud.withColumn("major_r", F.when(F.col("pid") == 1, float("inf")).otherwise(F.col("major_r")))
    queries = frame(spark, SF, "queries")
    got = {r.qid: r for r in marching.training_field(queries, cloud, 64, gradient=True).collect()}
    rows = [r for r in cloud.collect() if r["mask"] and r.pid != 1]
    columns = {c: np.array([r[c] for r in rows]) for c in ("cx", "cy", "cz", "theta", "phi", "major_r", "minor_r")}
    at = np.array([[r.x, r.y, r.z] for r in rows])
    space = {}
    exec(over_arrays(torus.distance(vec(""), torus.columns())), space)  # noqa: S102

    def field(q, lam, shift):
        w = np.exp(-lam * (np.linalg.norm(q - at, axis=1) - shift))
        g = space["f"](columns | {c: np.full(len(at), v) for c, v in zip("xyz", q, strict=True)})
        return (w * g).sum() / max(w.sum(), marching.LEAST), w.sum()

    smooth = 0
    for r in queries.collect():
        q = np.array([r.x, r.y, r.z])
        shift = np.sort(np.linalg.norm(q - at, axis=1))[63] / 2
        lam, h = 64 / shift, 1e-5
        value, total = field(q, lam, shift)
        assert got[r.qid].distance == pytest.approx(value, abs=1e-9)
        if total < 10 * marching.LEAST:  # there the denominator is held, and the slope is no derivative
            continue
        smooth += 1
        want = [(field(q + h * e, lam, shift)[0] - field(q - h * e, lam, shift)[0]) / (2 * h) for e in np.eye(3)]
        assert [got[r.qid].gx, got[r.qid].gy, got[r.qid].gz] == pytest.approx(want, rel=1e-4, abs=1e-4)
    assert smooth > 20


def test_training_field_meets_every_point_only_where_it_must(spark, monkeypatch):
    """Queries near the cloud are settled by their lists, to the same values as sums over all pairs; with no error allowed every one meets all points."""
    from pointfield.operators import neighbours

    cloud = fields.tori(frame(spark, SF, "cloud_sphere"), frame(spark, SF, "coeffs_generic"))
    queries = frame(spark, SF, "queries")
    met, every = [], neighbours.all_pairs
    monkeypatch.setattr(neighbours, "all_pairs", lambda q, c, n: met.append(q.count()) or every(q, c, n))
    monkeypatch.setattr(marching, "CLOSE", -1.0)
    want = {r.qid: r for r in marching.training_field(queries, cloud, gradient=True).collect()}
    assert met == [queries.count()]
    monkeypatch.undo()
    monkeypatch.setattr(neighbours, "all_pairs", lambda q, c, n: met.append(q.count()) or every(q, c, n))
    got = {r.qid: r for r in marching.training_field(queries, cloud, gradient=True).collect()}
    assert sum(met[1:]) < queries.count() / 2 and got.keys() == want.keys()
    for i, r in want.items():
        assert [*got[i]][1:] == pytest.approx([*r][1:], rel=1e-9, abs=1e-9)


def test_passing_by_within_the_tolerance_is_no_crossing(spark):
    """Lines at 1 + 1e-5 of the unit sphere's centre, within the march's tolerance, miss; those at 1 - 1e-5 hit."""
    rows = [(0, -2.5, 1 + 1e-5, 0.0, 1.0, 0.0, 0.0), (1, -2.5, 1 - 1e-5, 0.0, 1.0, 0.0, 0.0), (2, -2.5, 0.5, 0.0, 1.0, 0.0, 0.0)]
    rays = spark.createDataFrame(rows, COLUMNS)
    at = np.array([[-2.5, 0.0, 1.0 + 1e-5]])
    state = marching._march(lambda live, p: (np.sqrt((p**2).sum(1)) - 1, np.full(len(p), True)), at, np.array([[1.0, 0.0, 0.0]]), t := np.zeros(1), np.zeros(1, bool), np.zeros(1), found := [[]], 6.0, 1e-4)
    assert state[0] == marching.ENDED and t[0] >= 6 and found == [[]]
    cloud = fields.tori(frame(spark, SF, "cloud_sphere"), frame(spark, SF, "coeffs_sphere"))
    got = {r.rid: r.hit for r in marching.trace_field(rays, cloud, Evaluation(k=8)).collect()}
    assert got == {0: False, 1: True, 2: True}


def test_grazing_no_deeper_than_asked_is_no_crossing(spark):
    """As k06's SQL has it: lines whose half chord is below 1e-2 miss, whether the march knows the nearest points or all; a deeper one hits."""
    from pointfield.plans.other_queries import GRAZE

    half = (5e-3, 9e-3, 9.9e-3, 1.01e-2, 1.2e-2, 0.5)
    rays = spark.createDataFrame([(i, -2.5, math.sqrt(1 - c * c), 0.0, 1.0, 0.0, 0.0) for i, c in enumerate(half)], COLUMNS)
    cloud = fields.tori(frame(spark, SF, "cloud_sphere"), frame(spark, SF, "coeffs_sphere"))
    got = {r.rid: r.hit for r in marching.trace_field(rays, cloud, Evaluation(k=8), depth=GRAZE).collect()}
    assert got == {i: c > 1e-2 for i, c in enumerate(half)}
    assert all(r.hit for r in marching.trace_field(rays, cloud, Evaluation(k=8)).collect())
    # One step under any evaluation: at the bottom of a chord, within the tolerance and on the other side.
    rows = [(i, -2.5, math.sqrt(1 - c * c), 0.0, 1.0, 0.0, 0.0, 2.5, True, [2.49], marching.LIVE, 1.0) for i, c in enumerate((9e-3, 1.2e-2))]
    live = spark.createDataFrame(rows, COLUMNS + ", t double, inside boolean, found array<double>, state int, side double")
    step = {r.rid: r.side for r in marching._one_step(live, fields.finite(cloud), Evaluation(k=8), 6.0, 1e-4, GRAZE).collect()}
    assert step == {0: 1.0, 1: 0.0}
