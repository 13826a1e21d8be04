"""Boxes of shapes and lifts: they hold every point of the set, and each side touches it."""

import numpy as np
import pytest

from pointfield.functions import shapes
from pointfield.functions.expr import over_arrays, vec
from pointfield.operators import sampling

STEP = 1 / 256


def made(e):
    space = {}
    exec(over_arrays(e), space)  # noqa: S102
    return space["f"]


OTHERS = [("pie", {"r": 0.7, "t": 2.3}), ("arc", {"angle": 2.2, "ra": 0.6, "rb": 0.1}), ("moon", {"d": 0.3, "ra": 0.5, "rb": 0.7}), ("moon", {"d": 0.9, "ra": 0.5, "rb": 0.2}), ("isosceles", {"q": (0.4, 0.8)}), ("pill", {"a": (-0.2, 0.7), "b": (0.1, -0.6), "r": 0.2})]


@pytest.mark.parametrize("name, params", [(n, {}) for n in shapes.SHAPES] + OTHERS)
@pytest.mark.parametrize("isovalue", [0.0, 0.15])
def test_plane_boxes(name, params, isovalue):
    side = np.arange(-1.5, 1.5, STEP)
    x, y = (c.ravel() for c in np.meshgrid(side, side))
    inside = made(shapes.value(name, vec("", "xy"), isovalue, **params))({"x": x, "y": y}) <= 0
    low, high = shapes.extent(name, isovalue, **params)
    for c, a, b in zip((x[inside], y[inside]), low, high, strict=True):
        assert a - 1e-9 <= c.min() <= a + 4 * STEP and b - 4 * STEP <= c.max() <= b + 1e-9


@pytest.mark.parametrize("name", ["circle", "box", "heart", "pentagon", "moon"])
def test_lifted_boxes(name):
    side = np.arange(-1.6, 1.6, 1 / 24)
    x, y, z = (c.ravel() for c in np.meshgrid(side, side, side))
    at = {"x": x, "y": y, "z": z}
    for e, (low, high) in ((shapes.revolved(name, vec(""), 0.3), shapes.revolved_extent(name, 0.3)), (shapes.extruded(name, vec(""), 0.25, 0.1), shapes.extruded_extent(name, 0.25, 0.1))):
        inside = made(e)(at) <= 0
        for c, a, b in zip((x[inside], y[inside], z[inside]), low, high, strict=True):
            assert a - 1e-9 <= c.min() <= a + 0.15 and b - 0.15 <= c.max() <= b + 1e-9


def test_one_rotation_keeps_lengths_and_angles(spark):
    before = sampling.fibonacci_sphere(spark, 200).orderBy("pid").collect()
    after = sampling.fibonacci_sphere(spark, 200, seed=5).orderBy("pid").collect()
    a, b = (np.array([[r.x, r.y, r.z] for r in rows]) for rows in (before, after))
    assert np.allclose(a @ a.T, b @ b.T, atol=1e-12) and not np.allclose(a, b, atol=0.1)
    assert np.allclose(np.linalg.det(np.linalg.lstsq(a, b, rcond=None)[0]), 1)
    again = sampling.fibonacci_sphere(spark, 200, seed=5).repartition(7).orderBy("pid").collect()
    assert again == after
