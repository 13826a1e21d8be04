"""Queries of the plane shapes and their lifts."""

from __future__ import annotations

from ..functions import shapes
from ..functions.expr import Program, col, vec
from .catalog import register
from .field_queries import projection
from .fixtures import frame, sql

P2, P3 = (col("x"), col("y")), vec("")

for number, shape in enumerate(shapes.SHAPES, 1):
    value, (gx, gy) = shapes.value_and_gradient(shape, P2)
    projection(f"a{number:02d}_{shape}", "grid2d", ("qid",), distance=shapes.value(shape, P2))
    projection(f"a{number:02d}_{shape}_gradient", "grid2d", ("qid",), distance=value, gx=gx, gy=gy)
projection("a17_circle_laplacian", "grid2d", ("qid",), laplacian=shapes.laplacian("circle", P2, r=0.7))
projection("a17_isovalue", "grid2d", ("qid",), distance=shapes.value("box", P2, isovalue=0.1))
for shape in ("circle", "box", "heart"):
    projection(f"a18_revolved_{shape}", "grid2d", ("qid",), distance=shapes.revolved(shape, P3, 0.3))
    projection(f"a19_extruded_{shape}", "grid2d", ("qid",), distance=shapes.extruded(shape, P3, 0.25))
for key, lift, amount in (("revolved", shapes.revolved, 0.3), ("extruded", shapes.extruded, 0.25)):
    value, g = shapes.lifted_gradient(lift, "box", P3, amount)
    projection(f"a20_{key}_gradient", "grid2d", ("qid",), distance=value, gx=g[0], gy=g[1], gz=g[2])

# Boxes: of the points that aren't outside a shape, how many there are and how many its box misses.
VALUES = Program(**{f"v_{shape}": shapes.value(shape, P2) for shape in shapes.SHAPES})


def _boxes() -> list[str]:
    out = []
    for shape in shapes.SHAPES:
        (x0, y0), (x1, y1) = shapes.extent(shape)
        beyond = f"(x < {x0 - 1e-9!r} OR y < {y0 - 1e-9!r} OR x > {x1 + 1e-9!r} OR y > {y1 + 1e-9!r})"
        out += [f"count(CASE WHEN v_{shape} <= 0e0 THEN 1 END) AS {shape}_inside", f"count(CASE WHEN v_{shape} <= 0e0 AND {beyond} THEN 1 END) AS {shape}_missed"]
    return out


COUNTED = ", ".join(f"count(CASE WHEN v_{shape} <= 0e0 THEN 1 END) AS {shape}_inside, CAST(0 AS BIGINT) AS {shape}_missed" for shape in shapes.SHAPES)
register("a21_bounding_boxes", lambda s, d: VALUES.on(frame(s, d, "grid2d"), "qid", "x", "y").selectExpr(*_boxes()), f"SELECT {COUNTED} FROM {VALUES.sql(sql('grid2d'), 'qid')}")
