"""Samplers by random lines give as many points as asked for, on all sides."""

import pytest

from pointfield.operators import fields, scans
from pointfield.operators.fields import Evaluation
from pointfield.plans.fixtures import frame

from .conftest import SF


def numbered(rows, n):
    return sorted(r.pid for r in rows) == list(range(n))


def test_lines_until_there_are_n(spark):
    cube = frame(spark, SF, "mesh_cube")
    rows = scans.by_random_lines(cube, 700).collect()
    assert numbered(rows, 700) and all(abs(max(abs(r.x), abs(r.y), abs(r.z)) - 0.5) < 1e-9 for r in rows)
    assert scans.by_random_lines(cube, 0).count() == 0
    with pytest.raises(ValueError):
        scans.by_random_lines(cube.limit(0), 5)


def test_lifted_samples_are_n_and_on_inner_sides_too(spark):
    rows = scans.lifted_samples(spark, "circle", "revolved", 0.6, 600, r=0.2).collect()
    assert numbered(rows, 600)
    reach = [(r.x**2 + r.z**2) ** 0.5 for r in rows]
    assert all(abs(((a - 0.6) ** 2 + r.y**2) ** 0.5 - 0.2) < 1e-3 for a, r in zip(reach, rows, strict=True))
    assert sum(a < 0.6 for a in reach) / len(reach) > 0.3  # 0.39 of the torus's area; first hits have fewer


def test_isosurface_samples_are_n(spark):
    cloud = fields.tori(frame(spark, SF, "cloud_sphere"), frame(spark, SF, "coeffs_sphere"))
    rows = scans.isosurface_samples(cloud, 20, Evaluation(k=8)).collect()
    assert numbered(rows, 20) and all(abs((r.x**2 + r.y**2 + r.z**2) ** 0.5 - 1) < 1e-3 for r in rows)
