"""Distances, winding, rays and measures over triangle tables.

A mesh is a table (fid, ax..cz), or its tree as ``farfield.of_triangles`` makes it, which can be made once and searched often. The nearest triangle
is found by tiles, the hits of rays by descent over the boxes of the tree's cells; signs come from winding numbers whose error is
bounded. Sums over every triangle meet them block by block in an equi-join, as clouds do.

Triangles without all corners are not there; without triangles there are no distances and no hits. Queries without a place and rays
without an origin or direction have NULL distances and no hit. Ties go to the lower fid; ids are unique.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mesh
from ..functions.expr import Program, add, col, cross, dot, mul, norm, over_arrays, sgn, sub, vec, where
from ..plans.session import materialize
from . import farfield, neighbours, tiles
from .neighbours import BROADCAST_CELLS, Tree

BLOCK = 2_000
TRIANGLE = ("ax", "ay", "az", "bx", "by_", "bz", "cx", "cy", "cz")


def triangles(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(fid, ax .. cz) from (vid, x, y, z) and (fid, v0, v1, v2)."""
    out = faces
    for v, p in (("v0", ("ax", "ay", "az")), ("v1", ("bx", "by_", "bz")), ("v2", ("cx", "cy", "cz"))):
        out = out.join(vertices.select(F.col("vid").alias(v), *[F.col(c).alias(n) for c, n in zip("xyz", p, strict=True)]), v)
    return out.select("fid", *TRIANGLE)


def with_triangles(rows: DataFrame, tri: DataFrame) -> DataFrame:
    """Each row with each triangle."""
    blocks = max(1, -(-tri.count() // BLOCK))
    dealt = tri.withColumn("_block", F.pmod(F.xxhash64("fid"), F.lit(blocks)))
    return rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(dealt, "_block").drop("_block")


POINT = mesh.closest_on_triangle(vec(""), *mesh.corners())
PER_PAIR = {"px": POINT[0], "py": POINT[1], "pz": POINT[2], "d": norm(sub(vec(""), POINT)), "angle": mesh.solid_angle(vec(""), *mesh.corners())}


def tree(tri: DataFrame | Tree) -> Tree:
    return tri if isinstance(tri, Tree) else farfield.of_triangles(tri)


def distances(queries: DataFrame, tri: DataFrame) -> DataFrame:
    """(qid, x, y, z, winding, fid, px, py, pz, d): the nearest point of the mesh, ties to the lower fid, and the exact sum of solid angles,
    in one aggregation over all triangles."""
    pairs = Program(**PER_PAIR).on(with_triangles(queries, tri), "qid", "x", "y", "z", "fid")
    near = F.min(F.struct("d", "fid", "px", "py", "pz")).alias("near")
    return pairs.groupBy("qid", "x", "y", "z").agg(near, F.sum("angle").alias("winding")).select("qid", "x", "y", "z", "winding", "near.*")


NEAREST = {c: e for c, e in PER_PAIR.items() if c != "angle"}


def _nearest_lists(queries: DataFrame, tri: DataFrame | Tree | farfield.Tiled, k: int) -> DataFrame:
    """(qid, x, y, z, near array<struct<d, fid, ax .. cz>>) of each query's k nearest triangles, ties to the lower fid. Distances are compared where a
    query meets a tile of triangles, so pairs are not shuffled."""
    if isinstance(tri, farfield.Tiled):
        index = tri.tiles
    else:
        rows = tri.points if isinstance(tri, Tree) else farfield.rows_of_triangles(tri)
        index = tiles.index(rows.select("fid", "x", "y", "z", *neighbours.BOX, *TRIANGLE), extents=True)
    return tiles.nearest(queries.select("qid", "x", "y", "z"), index, k, TRIANGLE, "fid", (over_arrays(NEAREST["d"]), TRIANGLE))


def nearest(queries: DataFrame, tri: DataFrame | Tree | farfield.Tiled) -> DataFrame:
    """(qid, x, y, z, fid, px, py, pz, d): the nearest point of the mesh."""
    found = _nearest_lists(queries, tri, 1).select("qid", "x", "y", "z", F.inline("near")).drop("d")
    return queries.select("qid", "x", "y", "z").join(Program(**NEAREST).on(found, "qid", "fid"), "qid", "left").select("qid", "x", "y", "z", "fid", "px", "py", "pz", "d")


def in_boxes(boxes: DataFrame, tri: DataFrame | Tree) -> DataFrame:
    """(qid, fid) of the triangles whose own box meets a box (qid, blx .. bhz), borders included. Boxes with a NULL side meet nothing. Pairs are
    found tile by tile and handed on at once."""
    rows = tri.points if isinstance(tri, Tree) else farfield.rows_of_triangles(tri)
    index = tiles.index(rows.select("fid", "x", "y", "z", *neighbours.BOX), extents=True)
    low, high = ([f"b{n}{c}" for c in "xyz"] for n in "lh")
    asked = boxes.withColumns({c: F.when(F.isnan(c), float("inf")).otherwise(F.col(c)) for c in high})  # NaN is the largest number
    return tiles.meeting(asked, index, None, {"qid": "qid"}, {"fid": "fid"}, (low, high))


INSIDE = where(col("winding") > 2 * math.pi, -1.0, 1.0)
SIGNED = {"distance": INSIDE * col("d")}
SIGNED_GRADIENT = SIGNED | {f"g{c}": INSIDE * g for c, g in zip("xyz", mul(sub(vec(""), vec("p")), 1 / col("d")), strict=True)}


def signed_distance(queries: DataFrame, tri: DataFrame | Tree | farfield.Tiled, gradient: bool = False) -> DataFrame:
    """Negative inside a closed outward mesh; the gradient is NULL on the surface. Nearest triangles and signs share their tiles."""
    index = tri if isinstance(tri, Tree | farfield.Tiled) else farfield.tiled_triangles(tri)
    within = farfield.inside(queries, index, "solid_angle").select("qid", F.when(F.col("inside"), 4 * math.pi).otherwise(0.0).alias("winding"))
    return Program(**(SIGNED_GRADIENT if gradient else SIGNED)).on(nearest(queries, index).join(within, "qid"), "qid")


def _vote() -> dict:
    a, b, c = mesh.corners()
    return NEAREST | {"vote": sgn(dot(cross(sub(b, a), sub(c, a)), sub(vec(""), mul(add(add(a, b), c), 1 / 3))))}


#: Of a query and a triangle: its nearest point, and whether the query is on its outer side.
VOTE = _vote()


def voted_distance(queries: DataFrame, tri: DataFrame | Tree, k: int = 8) -> DataFrame:
    """(qid, distance): the distance to the mesh, positive where the query lies on the outer side of more of its k nearest triangles than not. Cheaper than
    a winding number and good for open meshes, but wrong where near triangles disagree. A triangle without area has no side."""
    near = Program(**VOTE).on(_nearest_lists(queries, tri, k).select("qid", "x", "y", "z", F.inline("near")).drop("d"), "qid", "fid")
    found = near.groupBy("qid").agg(F.min("d").alias("d"), F.sum("vote").alias("votes"))
    return queries.select("qid").join(found, "qid", "left").select("qid", (F.when(F.col("votes") > 0, 1.0).otherwise(-1.0) * F.col("d")).alias("distance"))


ORIGIN, DIRECTION = tuple(col(c) for c in ("ox", "oy", "oz")), tuple(col(c) for c in ("dx", "dy", "dz"))
RAY = ("ox", "oy", "oz", "dx", "dy", "dz")
CROSSING = mesh.ray_triangle(ORIGIN, DIRECTION, *mesh.corners())
#: Cells that a ray tries first; of the others only those that it enters before its first hit there.
AHEAD = 4
#: Boxes are wider by so much of the mesh's extent: a flat one has no inside that rounding could not miss.
PAD = 1e-9


def _ahead(rays: DataFrame, index: Tree, t_min: float, t_max: float) -> DataFrame:
    """(rid, ray, _up, entry): the finest cells that a ray passes between t_min and t_max, and where it enters them."""
    box = index.levels[0][0].agg(*[F.greatest(F.max(F.abs(f"h{c}")), F.max(F.abs(f"l{c}"))).alias(c) for c in "xyz"]).first()
    pad = PAD * max(box)
    entry, exit_ = mesh.ray_box(ORIGIN, DIRECTION, [col(f"l{c}") - pad for c in "xyz"], [col(f"h{c}") + pad for c in "xyz"])
    program = Program(entry=entry, exit=exit_)
    found = rays.select("rid", *RAY).withColumn("_up", F.lit(0).cast("long"))
    for cells, n in index.levels:
        cells = cells.select(F.col("up").alias("_up"), "cell", *neighbours.BOX)
        met = program.on(found.join(F.broadcast(cells) if n <= BROADCAST_CELLS else cells, "_up"), "rid", *RAY, "cell")
        met = met.where((F.col("entry") <= F.col("exit")) & (F.col("exit") >= t_min) & (F.col("entry") < t_max))
        found = met.select("rid", *RAY, F.col("cell").alias("_up"), "entry")
    return found


def _crossed(ahead: DataFrame, index: Tree) -> DataFrame:
    """(rid, fid, t, u, v) of the rays and the triangles of the cells ahead."""
    corners = index.points.select(F.col("cell").alias("_up"), "fid", *TRIANGLE)
    return Program(**CROSSING).on(ahead.join(corners, "_up"), "rid", "fid").where("t IS NOT NULL")


def crossings(rays: DataFrame, tri: DataFrame | Tree) -> DataFrame:
    """(rid, fid, t, u, v) of every crossing in front of a ray's origin."""
    index = tree(tri)
    if not index.n:
        return rays.select("rid", *[F.lit(None).cast(k).alias(c) for c, k in (("fid", "bigint"), ("t", "double"), ("u", "double"), ("v", "double"))]).limit(0)
    return _crossed(_ahead(rays, index, 0.0, math.inf), index)


def first_hits(rays: DataFrame, tri: DataFrame | Tree, t_min: float = 0.0, t_max: float = math.inf) -> DataFrame:
    """(rid, hit, t, fid, u, v): the nearest crossing with t in [t_min, t_max), ties to the lower fid. A ray meets the triangles of
    its first cells; those of later cells only where these begin before the hit that it has by then."""
    index = tree(tri)
    if not index.n:
        none = crossings(rays, index)
        return rays.select("rid").join(none, "rid", "left").select("rid", F.lit(False).alias("hit"), "t", "fid", "u", "v")
    order = Window.partitionBy("rid").orderBy("entry", "_up")
    ahead = materialize(_ahead(rays, index, t_min, t_max).withColumn("_rank", F.row_number().over(order)), "ray-cells")

    def best(cells: DataFrame) -> DataFrame:
        ok = _crossed(cells.select("rid", *RAY, "_up"), index).where((F.col("t") >= t_min) & (F.col("t") < t_max))
        return ok.groupBy("rid").agg(F.min(F.struct("t", "fid", "u", "v")).alias("f"))

    near = materialize(best(ahead.where(F.col("_rank") <= AHEAD)), "ray-hits")
    later = ahead.where(F.col("_rank") > AHEAD).join(near, "rid", "left").where(F.col("f").isNull() | (F.col("entry") <= F.col("f.t")))
    got = near.unionByName(best(later)).groupBy("rid").agg(F.min("f").alias("f"))
    return rays.select("rid").join(got, "rid", "left").select("rid", F.col("f").isNotNull().alias("hit"), "f.t", "f.fid", "f.u", "f.v")


def hit_points(rays: DataFrame, tri: DataFrame | Tree) -> DataFrame:
    """(rid, x, y, z, nx, ny, nz) of rays that hit, the normal turned against the ray."""
    index = tree(tri)
    hits = first_hits(rays, index).where("hit").join(rays, "rid").join(index.points.select("fid", *TRIANGLE), "fid")
    return Program(**HIT).on(hits, "rid")


def _hit() -> dict:
    from ..functions.expr import side, unit

    a, b, c = mesh.corners()
    n = unit(cross(sub(b, a), sub(c, a)))
    facing = -side(dot(n, DIRECTION))
    at = [o + col("t") * d for o, d in zip(ORIGIN, DIRECTION, strict=True)]
    return dict(zip(("x", "y", "z", "nx", "ny", "nz"), (*at, *mul(n, facing)), strict=True))


HIT = _hit()


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(vid, nx, ny, nz): normalised sums of the unnormalised normals of a vertex's faces."""
    from ..functions.expr import unit

    a, b, c = mesh.corners()
    n = cross(sub(b, a), sub(c, a))
    f = Program(**dict(zip(("fx", "fy", "fz"), n, strict=True))).on(triangles(vertices, faces), "fid")
    at = faces.select("fid", F.explode(F.array("v0", "v1", "v2")).alias("vid")).join(f, "fid")
    sums = at.groupBy("vid").agg(*[F.sum(f"f{k}").alias(f"s{k}") for k in "xyz"])
    return Program(**dict(zip(("nx", "ny", "nz"), unit(vec("s")), strict=True))).on(sums, "vid")


def quality(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row: faces, vertices, watertight (each undirected edge twice), consistent (each directed edge once), outward (volume > 0)."""
    edges = faces.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])).alias("e")).select("e.*")
    directed = edges.groupBy("u", "v").count().agg(F.max("count").alias("_d"))
    both = edges.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).count().agg(F.min("count").alias("_l"), F.max("count").alias("_h"))
    a, b, c = mesh.corners()
    volume = Program(v=dot(a, cross(b, c)) / 6).on(triangles(vertices, faces), "fid").agg(F.sum("v").alias("volume"), F.count("*").alias("n_faces"))
    return volume.join(directed).join(both).join(vertices.agg(F.count("*").alias("n_vertices"))).select("n_faces", "n_vertices", "volume", ((F.col("_l") == 2) & (F.col("_h") == 2)).alias("watertight"), (F.col("_d") == 1).alias("consistent"), (F.col("volume") > 0).alias("outward"))


def proper_faces(vertices: DataFrame, faces: DataFrame, least: float = 1e-10) -> DataFrame:
    """Faces without a repeated corner and with some area."""
    a, b, c = mesh.corners()
    area = Program(area=norm(cross(sub(b, a), sub(c, a))) * 0.5).on(triangles(vertices, faces), "fid")
    return faces.where("v0 <> v1 AND v1 <> v2 AND v2 <> v0").join(area.where(F.col("area") >= least), "fid")
