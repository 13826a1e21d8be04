"""Triangulated level sets of fields on a grid of nodes.

Every cube between eight nodes is cut into six tetrahedra along its main diagonal, one for each order of the axes; neighbouring cubes cut
their common face alike. A tetrahedron whose corners lie on both sides gives one or two triangles across its edges. An edge is known by its
lower node and its direction, so the triangles around it share a vertex, at the very same place, and the mesh is closed
wherever the grid goes on. All of it is JVM expressions over one aggregation of the nodes by cube.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import materialize
from . import fields, neighbours
from .fields import Evaluation


def _odd(order) -> bool:
    return sum(a > b for i, a in enumerate(order) for b in order[i + 1 :]) % 2 == 1


def _tetrahedra() -> list[dict]:
    """Corners of each as bits of the axes, from (0, 0, 0) to (1, 1, 1), and whether it is a mirror image."""
    out = []
    for order in permutations(range(3)):
        at, corners = 0, [0]
        for axis in order:
            at |= 1 << axis
            corners.append(at)
        out.append({"corners": corners, "odd": _odd(order)})
    return out


def _triangles(odd: bool) -> list[list[list[list[int]]]]:
    """For each set of corners below the level, as bits: triangles of edges (lower corner, upper corner), turned to the side above. A corner that
    is alone is cut off by its three edges; two and two are parted by a quadrangle."""
    out = []
    for below in range(16):
        inside = [c for c in range(4) if below >> c & 1]
        outside = [c for c in range(4) if not below >> c & 1]
        flipped = odd ^ _odd(inside + outside)
        if len(inside) in (1, 3):
            alone, rest = (inside, outside) if len(inside) == 1 else (outside, inside)
            found = [[(alone[0], c) for c in rest]]
        elif len(inside) == 2:
            (i, j), (k, m) = inside, outside
            found = [[(i, k), (i, m), (j, m)], [(i, k), (j, m), (j, k)]]
        else:
            found = []
        if len(inside) == 3:  # here the side above is the corner that is cut off
            flipped = odd ^ _odd(outside + inside) ^ True
        out.append([[sorted(e) for e in (t[::-1] if flipped else t)] for t in found])
    return out


def extract(nodes: DataFrame, n: int, level: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y, z) and faces (fid, v0, v1, v2) of the set where ``v`` is ``level``, turned to where it is greater, from the nodes
    (i, j, k, x, y, z, v), each index from 0 to n - 1.

    A value at the level counts as above. Cubes with a missing node or value are left out, and the mesh is open there and at the
    border of the grid; without a change of sign there are no faces. Nodes must not repeat. Other columns are ignored.
    """
    bits = F.explode(F.sequence(F.lit(0), F.lit(7)))
    at = {c: F.col(c) - F.shiftright("m", a).bitwiseAND(1) for a, c in enumerate("ijk")}
    dealt = nodes.where("v IS NOT NULL").select("i", "j", "k", F.struct("x", "y", "z", "v").alias("p"), bits.alias("m"))
    dealt = dealt.select(*[c.cast("long").alias(k) for k, c in at.items()], "m", "p").where(" AND ".join(f"{c} BETWEEN 0 AND {n - 2}" for c in "ijk"))
    below = F.sum((F.col("p.v") < level).cast("int"))
    cubes = dealt.groupBy("i", "j", "k").agg(F.map_from_entries(F.collect_list(F.struct("m", "p"))).alias("p"), F.count("*").alias("_n"), below.alias("_below"))
    cubes = cubes.where("_n = 8 AND _below BETWEEN 1 AND 7")
    tetrahedra = F.from_json(F.lit(json.dumps(_tetrahedra())), "array<struct<corners: array<int>, odd: boolean>>")
    cases = F.from_json(F.lit(json.dumps([_triangles(False), _triangles(True)])), "array<array<array<array<array<int>>>>>")
    one = cubes.select("i", "j", "k", "p", F.posexplode(tetrahedra).alias("_t", "t"))
    under = sum((F.when(F.element_at("p", F.get("t.corners", F.lit(c)))["v"] < level, 1 << c).otherwise(0) for c in range(4)), F.lit(0))
    one = one.select("*", F.posexplode(F.get(F.get(cases, F.col("t.odd").cast("int")), under)).alias("_f", "edges"))

    def vertex(edge):
        low, high = (F.get("t.corners", F.get(edge, F.lit(e))) for e in (0, 1))
        a, b = F.element_at("p", low), F.element_at("p", high)
        share = (F.lit(level) - a["v"]) / (b["v"] - a["v"])
        node = sum(((F.col(c) + F.shiftright(low, k).bitwiseAND(1)) * n ** (2 - k) for k, c in enumerate("ijk")), F.lit(0).cast("long"))
        return F.struct((node * 8 + high - low).alias("vid"), *[(a[c] + share * (b[c] - a[c])).alias(c) for c in "xyz"])

    cube = (F.col("i") * n + F.col("j")) * n + F.col("k")
    found = one.select((cube * 12 + F.col("_t") * 2 + F.col("_f")).alias("fid"), F.transform("edges", vertex).alias("v"))
    vertices = found.select(F.explode("v").alias("v")).select("v.*").groupBy("vid").agg(*[F.min(c).alias(c) for c in "xyz"])
    return vertices, found.select("fid", *[F.get("v", F.lit(e))["vid"].alias(f"v{e}") for e in range(3)])


def grid(spark: SparkSession, low: tuple, high: tuple, n: int) -> DataFrame:
    """(qid, i, j, k, x, y, z): n nodes a side of a box, both ends included."""
    rows = spark.range(n**3).select(F.col("id").alias("qid"), *[(F.floor(F.col("id") / n ** (2 - a)) % n).alias(c) for a, c in enumerate("ijk")])
    return rows.select("*", *[(F.lit(float(a)) + F.col(i) * ((b - a) / (n - 1))).alias(c) for c, i, a, b in zip("xyz", "ijk", low, high, strict=True)])


def of_field(cloud: DataFrame | neighbours.Tree, low: tuple, high: tuple, n: int, how: Evaluation = Evaluation(k=32)) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Vertices and faces of the zero set of the blended torus field of a cloud, or its tree, in a box."""
    points = cloud.points if isinstance(cloud, neighbours.Tree) else cloud
    nodes = grid(points.sparkSession, low, high, n)
    values = fields.evaluate(nodes.select("qid", "x", "y", "z"), cloud, how).withColumnRenamed("distance", "v")
    return extract(materialize(nodes.join(values, "qid"), "grid"), n)


def _noise(seed: int, octave: int, at: list) -> Column:
    """Gradient noise of one octave: at every lattice point a hash picks one of the twelve directions to the middles of a cube's edges; between them the
    slopes are blended by a quintic whose first and second derivatives vanish at the lattice."""
    low = [F.floor(c) for c in at]
    off = [c - f for c, f in zip(at, low, strict=True)]
    blend = [t * t * t * (t * (t * 6 - 15) + 10) for t in off]

    def slope(corner: tuple) -> Column:
        h = F.xxhash64(F.lit(seed), F.lit(octave), *[(f + b).cast("long") for f, b in zip(low, corner, strict=True)])
        d = [t - float(b) for t, b in zip(off, corner, strict=True)]
        axis = F.pmod(h, F.lit(3))  # the one that the direction has no part of
        sign = lambda bit, v: F.when(F.shiftright(h, bit).bitwiseAND(1) == 1, v).otherwise(-v)
        return sign(20, F.when(axis == 0, d[1]).otherwise(d[0])) + sign(21, F.when(axis == 2, d[1]).otherwise(d[2]))

    def between(k: int, corner: tuple) -> Column:
        if k == 3:
            return slope(corner)
        a, b = between(k + 1, (*corner, 0)), between(k + 1, (*corner, 1))
        return a * (1 - blend[k]) + b * blend[k]

    return between(0, ())


def with_noise(points: DataFrame, name: str, scale: float = 1.0, octaves: int = 4, persistence: float = 0.5, lacunarity: float = 2.0, seed: int = 0) -> DataFrame:
    """``points`` (x, y, z) with a column of seeded noise, about -1 to 1, 0 on average: octaves of ever finer and fainter gradient noise. It depends on
    place and seed alone. A point without a place has NULL."""
    parts = [f"_{name}{k}" for k in range(octaves)]
    for k, part in enumerate(parts):
        points = points.withColumn(part, _noise(seed, k, [F.col(c) * (scale * lacunarity**k) for c in "xyz"]))
    total = sum(persistence**k for k in range(octaves))
    return points.withColumn(name, sum((F.col(part) * persistence**k for k, part in enumerate(parts)), F.lit(0.0)) / total).drop(*parts)


def blob(nodes: DataFrame, n: int, alpha: float = 0.3, radius: float = 1.0, **noise) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of a sphere whose radius is changed by ``alpha`` times noise, over grid nodes (i, j, k, x, y, z); closed if it lies within the
    grid."""
    bent = materialize(with_noise(nodes.select("i", "j", "k", "x", "y", "z"), "noise", **noise), "noise")  # else filters would carry its formulas along
    far = F.lit(radius) + F.col("noise") * alpha
    return extract(bent.withColumn("v", F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z") - far * far), n)
