"""Queries over meshes and rays, samplers, grids and error measures."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import mesh
from ..functions.expr import Program, col, norm, num, unit, vec, where
from ..operators import farfield, fields, isosurface, meshes, sampling
from ..operators.fields import Evaluation
from .catalog import register
from .field_queries import SELF, SPHERE, field_sql, pairs_sql, projection, rounded_frame, rounded_sql, sphere_points, tori, tori_sql
from .fixtures import frame, sql

CUBE = sql("mesh_cube")
XYZ = ("x", "y", "z")

# Distances and winding; the oracle aggregates the full product.
PRODUCT = f"(SELECT q.*, f.* FROM {sql('queries')} q CROSS JOIN {CUBE} f)"
NEAREST = f"""(SELECT *, sum(angle) OVER (PARTITION BY qid) AS winding FROM {Program(**meshes.PER_PAIR).sql(PRODUCT, 'qid', 'x', 'y', 'z', 'fid')}
              QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, fid) = 1)"""
cube = lambda s, d: frame(s, d, "mesh_cube")
asked = lambda s, d: frame(s, d, "queries")

projection("m01_closest_point_on_triangle", "mesh_cube", ("fid",), **dict(zip(XYZ, mesh.closest_on_triangle((num(0.3), num(0.9), num(-0.2)), *mesh.corners()), strict=True)))
register("m02_unsigned_distance", lambda s, d: rounded_frame(meshes.nearest(asked(s, d), cube(s, d)).select("qid", "d")), rounded_sql(NEAREST, ("qid",), ("d",)))
register("m03_signed_distance", lambda s, d: rounded_frame(meshes.signed_distance(asked(s, d), cube(s, d))), rounded_sql(Program(**meshes.SIGNED).sql(NEAREST, "qid"), ("qid",), ("distance",)))
register(
    "m05_winding_solid_angle",
    lambda s, d: rounded_frame(meshes.distances(asked(s, d), cube(s, d)).select("qid", "winding")),
    rounded_sql(NEAREST, ("qid",), ("winding",)),
)
register(
    "m06_winding_normalised",
    lambda s, d: rounded_frame(meshes.distances(asked(s, d), cube(s, d)).selectExpr("qid", f"winding / {4 * math.pi!r}e0 AS winding")),
    rounded_sql(f"(SELECT qid, winding / {4 * math.pi!r}e0 AS winding FROM {NEAREST})", ("qid",), ("winding",)),
)
register(
    "m07_signed_distance_and_gradient",
    lambda s, d: rounded_frame(meshes.signed_distance(asked(s, d), cube(s, d), gradient=True)),
    rounded_sql(Program(**meshes.SIGNED_GRADIENT).sql(NEAREST, "qid"), ("qid",), ("distance", "gx", "gy", "gz")),
)
register(
    "j14_nearest_triangle",
    lambda s, d: rounded_frame(meshes.nearest(asked(s, d), cube(s, d)).select("qid", "px", "py", "pz", "d")),
    rounded_sql(NEAREST, ("qid",), ("px", "py", "pz", "d")),
)

# Rays.
RAYS = sql("rays")
entry, exit_ = mesh.ray_box(meshes.ORIGIN, meshes.DIRECTION, [num(-0.5)] * 3, [num(0.5)] * 3)
MISS = (entry > exit_) | (exit_ < 0)
projection("k01_ray_box", "rays", ("rid",), entry=where(MISS, -1.0, entry), exit=where(MISS, -1.0, exit_))
projection("k02_ray_sphere", "rays", ("rid",), t=mesh.ray_sphere(meshes.ORIGIN, meshes.DIRECTION, (num(0.1), num(0), num(-0.1)), 0.7))
RAY_PRODUCT = f"(SELECT r.*, f.* FROM {RAYS} r CROSS JOIN {CUBE} f)"
CROSSED = Program(**meshes.CROSSING).sql(RAY_PRODUCT, "rid", "fid")
FIRST = f"(SELECT * FROM {CROSSED} WHERE t >= 0e0 QUALIFY row_number() OVER (PARTITION BY rid ORDER BY t, fid) = 1)"
rays = lambda s, d: frame(s, d, "rays")
register(
    "k03_ray_triangle",
    lambda s, d: rounded_frame(meshes.crossings(rays(s, d), cube(s, d))),
    rounded_sql(f"(SELECT * FROM {CROSSED} WHERE t IS NOT NULL)", ("rid", "fid"), ("t", "u", "v")),
)
register(
    "k04_first_hit",
    lambda s, d: rounded_frame(meshes.first_hits(rays(s, d), cube(s, d)).selectExpr("rid", "hit", "coalesce(t, -1e0) AS t", "coalesce(fid, -1) AS fid")),
    rounded_sql(f"(SELECT r.rid, f.t IS NOT NULL AS hit, coalesce(f.t, -1e0) AS t, coalesce(f.fid, -1) AS fid FROM {RAYS} r LEFT JOIN {FIRST} f ON f.rid = r.rid)", ("rid", "hit", "fid"), ("t",)),
)
HITS = f"(SELECT r.*, h.t, f.* FROM {FIRST} h JOIN {RAYS} r ON r.rid = h.rid JOIN {CUBE} f ON f.fid = h.fid)"
register("k05_ray_hit_points", lambda s, d: rounded_frame(meshes.hit_points(rays(s, d), cube(s, d))), rounded_sql(Program(**meshes.HIT).sql(HITS, "rid"), ("rid",), (*XYZ, "nx", "ny", "nz")))

# The same searches over a mesh of two triangles a part.
TORUS_MESH = sql("mesh_torus")
torus_mesh = lambda s, d: frame(s, d, "mesh_torus")
TORUS_NEAREST = NEAREST.replace(CUBE, TORUS_MESH)
register(
    "m07_torus_mesh_distance_and_gradient",
    lambda s, d: rounded_frame(meshes.signed_distance(asked(s, d), torus_mesh(s, d), gradient=True)),
    rounded_sql(Program(**meshes.SIGNED_GRADIENT).sql(TORUS_NEAREST, "qid"), ("qid",), ("distance", "gx", "gy", "gz")),
)
register(
    "j14_nearest_triangle_of_torus_mesh",
    lambda s, d: rounded_frame(meshes.nearest(asked(s, d), torus_mesh(s, d)).select("qid", "px", "py", "pz", "d")),
    rounded_sql(TORUS_NEAREST, ("qid",), ("px", "py", "pz", "d")),
)
register(
    "m06_inside_by_fast_winding",
    lambda s, d: farfield.inside(asked(s, d), farfield.tiled_triangles(torus_mesh(s, d)), "solid_angle"),
    f"SELECT qid, sum(angle) > {2 * math.pi!r}e0 AS inside FROM {Program(angle=meshes.PER_PAIR['angle']).sql(PRODUCT.replace(CUBE, TORUS_MESH), 'qid')} GROUP BY qid",
)
VOTES = Program(**meshes.VOTE).sql(PRODUCT.replace(CUBE, TORUS_MESH), "qid", "fid")
register(
    "m08_distance_by_nearest_triangles_votes",
    lambda s, d: rounded_frame(meshes.voted_distance(asked(s, d), torus_mesh(s, d), 8)),
    f"""SELECT qid, (round(CASE WHEN sum(vote) > 0e0 THEN min(d) ELSE -min(d) END, 6) + 0e0) AS distance
        FROM (SELECT * FROM {VOTES} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, fid) <= 8) GROUP BY qid""",
)
TORUS_CROSSED = CROSSED.replace(CUBE, TORUS_MESH)
TORUS_FIRST = f"(SELECT * FROM {TORUS_CROSSED} WHERE t >= 0e0 QUALIFY row_number() OVER (PARTITION BY rid ORDER BY t, fid) = 1)"
register(
    "k03_torus_mesh_crossings",
    lambda s, d: rounded_frame(meshes.crossings(rays(s, d), torus_mesh(s, d))),
    rounded_sql(f"(SELECT * FROM {TORUS_CROSSED} WHERE t IS NOT NULL)", ("rid", "fid"), ("t", "u", "v")),
)
register(
    "k04_torus_mesh_first_hit",
    lambda s, d: rounded_frame(meshes.first_hits(rays(s, d), torus_mesh(s, d)).selectExpr("rid", "hit", "coalesce(t, -1e0) AS t", "coalesce(fid, -1) AS fid")),
    rounded_sql(f"(SELECT r.rid, f.t IS NOT NULL AS hit, coalesce(f.t, -1e0) AS t, coalesce(f.fid, -1) AS fid FROM {RAYS} r LEFT JOIN {TORUS_FIRST} f ON f.rid = r.rid)", ("rid", "hit", "fid"), ("t",)),
)
BALLS = f"(SELECT qid, x - 0.1e0 AS blx, x + 0.1e0 AS bhx, y - 0.1e0 AS bly, y + 0.1e0 AS bhy, z - 0.1e0 AS blz, z + 0.1e0 AS bhz FROM {sql('queries')})"
MEETS = " AND ".join(f"least(a{c}, {'by_' if c == 'y' else 'b' + c}, c{c}) <= bh{c} AND greatest(a{c}, {'by_' if c == 'y' else 'b' + c}, c{c}) >= bl{c}" for c in XYZ)
register(
    "j13_triangles_whose_boxes_meet_a_box",
    lambda s, d: meshes.in_boxes(asked(s, d).selectExpr("qid", *[f"{c} - 0.1e0 AS bl{c}" for c in XYZ], *[f"{c} + 0.1e0 AS bh{c}" for c in XYZ]), torus_mesh(s, d)),
    f"SELECT qid, fid FROM {BALLS} q JOIN {TORUS_MESH} f ON {MEETS}",
)
register(
    "c08_inside_by_fast_winding",
    lambda s, d: farfield.inside(asked(s, d), farfield.tiled(frame(s, d, "cloud_sphere"))),
    f"SELECT qid, sum(a) < -0.5e0 AS inside FROM {Program(**fields.winding()[0]).sql(pairs_sql(sql('queries'), sql('cloud_sphere')), 'qid')} GROUP BY qid",
)
register(
    "c08_inside_by_fast_regularised_winding",
    lambda s, d: farfield.inside(asked(s, d), farfield.tiled(frame(s, d, "cloud_sphere")), "regularised_winding"),
    f"SELECT qid, sum(a) > 0.5e0 AS inside FROM {Program(**fields.regularised_winding()[0]).sql(pairs_sql(sql('queries'), sql('cloud_sphere')), 'qid')} GROUP BY qid",
)

# Mesh measures, over the vertex and face tables of the torus.
VERTICES, FACES = sql("torus_vertices"), sql("torus_faces")
vertices, faces = (lambda s, d: frame(s, d, "torus_vertices")), (lambda s, d: frame(s, d, "torus_faces"))
FACE_NORMALS = f"(SELECT fid, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS fx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS fy, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS fz FROM {TORUS_MESH})"
SUMS = f"""(SELECT vid, sum(fx) AS sx, sum(fy) AS sy, sum(fz) AS sz FROM (SELECT fid, unnest([v0, v1, v2]) AS vid FROM {FACES}) e JOIN {FACE_NORMALS} n ON n.fid = e.fid GROUP BY vid)"""
register(
    "r16_vertex_normals",
    lambda s, d: rounded_frame(meshes.vertex_normals(vertices(s, d), faces(s, d))),
    rounded_sql(Program(**dict(zip(("nx", "ny", "nz"), unit(vec("s")), strict=True))).sql(SUMS, "vid"), ("vid",), ("nx", "ny", "nz")),
)
VOLUME = f"(SELECT sum(ax*(by_*cz - bz*cy) + ay*(bz*cx - bx*cz) + az*(bx*cy - by_*cx)) / 6e0 AS volume FROM {TORUS_MESH})"
register(
    "f08_mesh_quality",
    lambda s, d: rounded_frame(meshes.quality(vertices(s, d), faces(s, d))),
    f"""WITH e AS MATERIALIZED (SELECT unnest([v0, v1, v2]) AS u, unnest([v1, v2, v0]) AS v FROM {FACES}),
        d AS (SELECT count(*) AS n FROM e GROUP BY u, v), b AS (SELECT count(*) AS n FROM e GROUP BY least(u, v), greatest(u, v))
        SELECT (SELECT count(*) FROM {FACES}) AS n_faces, (SELECT count(*) FROM {VERTICES}) AS n_vertices, (round(volume, 6) + 0e0) AS volume,
               (SELECT min(n) = 2 AND max(n) = 2 FROM b) AS watertight, (SELECT max(n) = 1 FROM d) AS consistent, volume > 0 AS outward FROM {VOLUME}""",
)
# Every fiftieth face repeats a corner.
BAD = "fid, v0, CASE WHEN fid % 50 = 7 THEN v0 ELSE v1 END AS v1, v2"
register(
    "f07_degenerate_faces",
    lambda s, d: meshes.proper_faces(vertices(s, d), faces(s, d).selectExpr(*BAD.split(", "))).select("fid", "v0", "v1", "v2"),
    f"SELECT fid, v0, v1, v2 FROM (SELECT {BAD} FROM {FACES}) WHERE v0 <> v1 AND v1 <> v2 AND v2 <> v0",
)

# Boxes, scaling, samplers.
BOX = ", ".join(f"(round({n}({c}), 6) + 0e0) AS {n}_{c}" for c in XYZ for n in ("min", "max"))
register("r13_bounding_box", lambda s, d: rounded_frame(sampling.bounding_box(frame(s, d, "cloud_torus"))), f"SELECT {BOX} FROM {sql('cloud_torus')}")
MEANS = ", ".join(f"avg({c}) OVER () AS m{c}" for c in XYZ)
register(
    "r14_center_and_scale_cloud",
    lambda s, d: rounded_frame(sampling.center_and_scale(frame(s, d, "cloud_torus").select("pid", *XYZ)).select("pid", *XYZ)),
    "SELECT pid, " + ", ".join(f"(round(({c} - m{c}) / s, 6) + 0e0) AS {c}" for c in XYZ) + f" FROM (SELECT *, {MEANS}, greatest(max(x) OVER () - min(x) OVER (), max(y) OVER () - min(y) OVER (), max(z) OVER () - min(z) OVER ()) AS s FROM {sql('cloud_torus')})",
)
register(
    "r15_center_and_scale_mesh",
    lambda s, d: rounded_frame(sampling.center_and_scale_vertices(frame(s, d, "queries").select("qid", *XYZ)).select("qid", *XYZ)),
    "SELECT qid, " + ", ".join(f"(round(({c} - m{c}) / max(greatest(abs(x - mx), abs(y - my), abs(z - mz))) OVER (), 6) + 0e0) AS {c}" for c in XYZ) + f" FROM (SELECT *, {MEANS} FROM {sql('queries')})",
)
number = lambda s, d, table: s.read.parquet(f"{d}/{table}.parquet").count()
TURN = "(range*0.6180339887498949e0 - floor(range*0.6180339887498949e0))"
register(
    "r09_fibonacci_sphere",
    lambda s, d: rounded_frame(sampling.fibonacci_sphere(s, number(s, d, "part"))),
    f"""SELECT range AS pid, (round(r*cos(2e0*pi()*t), 6) + 0e0) AS x, (round(r*sin(2e0*pi()*t), 6) + 0e0) AS y, (round(z, 6) + 0e0) AS z
        FROM (SELECT *, sqrt(1e0 - z*z) AS r FROM (SELECT range, {TURN} AS t, 1e0 - 2e0*(range + 0.5e0)/n AS z FROM (SELECT unnest(range(count(*))) AS range, count(*) AS n FROM part)))""",
)
ENTRIES = [f"m{i}{j}" for i in range(3) for j in range(3)]
ORTHONORMAL = " AND ".join(f"abs({' + '.join(f'm{i}{k}*m{j}{k}' for k in range(3))} - {float(i == j)}e0) < 1e-12" for i in range(3) for j in range(i, 3))
TURNS_RIGHT = "m00*(m11*m22 - m12*m21) - m01*(m10*m22 - m12*m20) + m02*(m10*m21 - m11*m20) > 0.999e0"
register(
    "r09_random_rotations",
    lambda s, d: s.read.parquet(f"{d}/part.parquet").select(*[e.alias(f"m{i}{j}") for i, row in enumerate(sampling.rotation(7, "p_partkey")) for j, e in enumerate(row)]).selectExpr(
        "count(*) AS n", f"bool_and({ORTHONORMAL} AND {TURNS_RIGHT}) AS rotations", "(" + " AND ".join(f"abs(avg({e})) < 3e0/sqrt(count(*)) AND abs(avg({e}*{e}) - 1e0/3e0) < 2e0/sqrt(count(*))" for e in ENTRIES) + ") AS uniform"
    ),
    "SELECT count(*) AS n, true AS rotations, true AS uniform FROM part",
)
register(
    "v07_random_basis",
    lambda s, d: sampling.random_basis(frame(s, d, "cloud_sphere").drop("area"), 3, "pid").selectExpr(
        "count(*) AS n",
        "bool_and(abs(sx*sx + sy*sy + sz*sz - 1e0) < 1e-12 AND abs(tx*tx + ty*ty + tz*tz - 1e0) < 1e-12 AND abs(sx*tx + sy*ty + sz*tz) < 1e-12 AND abs(sx*nx + sy*ny + sz*nz) < 1e-12 AND abs(tx*nx + ty*ny + tz*nz) < 1e-12) AS orthonormal",
        "bool_and(nx*(sy*tz - sz*ty) + ny*(sz*tx - sx*tz) + nz*(sx*ty - sy*tx) > 0e0) AS right_handed",
    ),
    "SELECT count(*) AS n, true AS orthonormal, true AS right_handed FROM part",
)
on_cube = lambda s, d: sampling.on_surface(frame(s, d, "mesh_fine_cube"), number(s, d, "part"), 1)
check = "max(abs(greatest(abs(x), abs(y), abs(z)) - 0.5e0)) < 1e-9"
register(
    "r01_surface_sample",
    lambda s, d: on_cube(s, d).agg(F.count("*").alias("n"), F.countDistinct(F.round("nx"), F.round("ny"), F.round("nz")).alias("sides"), F.expr(f"{check} AS on_surface"), F.expr("max(abs(nx*nx + ny*ny + nz*nz - 1e0)) < 1e-9 AS unit_normals")),
    "SELECT count(*) AS n, CAST(6 AS BIGINT) AS sides, true AS on_surface, true AS unit_normals FROM part",
)
register(
    "r03_narrow_band",
    lambda s, d: sampling.narrow_band(on_cube(s, d), 0.1, 2).agg(F.count("*").alias("n"), F.expr("max(abs(greatest(abs(x), abs(y), abs(z)) - 0.5e0)) <= 0.1e0 AS within")),
    "SELECT count(*) AS n, true AS within FROM part",
)
register(
    "r04_noise_and_flips",
    lambda s, d: sampling.noisy(frame(s, d, "cloud_sphere"), 0.01, 0.01, 0.1, 3).selectExpr("abs(nx*nx + ny*ny + nz*nz - 1e0) < 1e-9 AS u", "(x*nx + y*ny + z*nz) < 0e0 AS f").agg(F.count("*").alias("n"), F.expr("bool_and(u) AS unit_normals"), F.expr("avg(CASE WHEN f THEN 1e0 ELSE 0e0 END) BETWEEN 0.07e0 AND 0.13e0 AS about_a_tenth")),
    "SELECT count(*) AS n, true AS unit_normals, true AS about_a_tenth FROM part",
)
register(
    "r18_uniform_in_box",
    lambda s, d: sampling.uniform_in_box(s, number(s, d, "customer"), (-1.0, -2.0, 0.0), (1.0, 2.0, 0.5), 4).agg(F.count("*").alias("n"), F.expr("bool_and(x BETWEEN -1e0 AND 1e0 AND y BETWEEN -2e0 AND 2e0 AND z BETWEEN 0e0 AND 0.5e0) AS inside"), F.expr("abs(avg(y)) < 5e0/sqrt(count(*)) AS centred")),
    "SELECT count(*) AS n, true AS inside, true AS centred FROM customer",
)
register("r08_farthest_points", lambda s, d: sampling.farthest_points(frame(s, d, "cloud_sphere").select("pid", *XYZ), 64).select("rank", "pid"))
register(
    "j03_knn_and_farthest_subsample",
    lambda s, d: sampling.farthest_points(fields.neighbours.self_knn(sphere_points(s, d), 16).select("i", "pid").join(sphere_points(s, d).select("pid", *XYZ), "pid"), 4, "i").select("i", "pid", "rank"),
)
register(
    "s19_train_test_split",
    lambda s, d: sampling.split(frame(s, d, "queries").select("qid"), "qid", 0.8, 5).agg(F.count("*").alias("n"), F.sum(F.col("train").cast("long")).alias("n_train")),
    "SELECT count(*) AS n, CAST(floor(0.8e0 * count(*)) AS BIGINT) AS n_train FROM customer",
)

# Neighbourhood boxes, as the shape features use them.
register(
    "r19_neighbourhood_boxes",
    lambda s, d: rounded_frame(fields.neighbours.self_knn(sphere_points(s, d), 16).select("i", "pid").join(sphere_points(s, d), "pid").groupBy("i").agg(*[f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("min", F.min), ("max", F.max))])),
    rounded_sql(f"(SELECT i, {', '.join(f'{n}(p{c}) AS {n}_{c}' for c in XYZ for n in ('min', 'max'))} FROM {pairs_sql(SELF, SPHERE, 16, q='i')} GROUP BY i)", ("i",), tuple(f"{n}_{c}" for c in XYZ for n in ("min", "max"))),
)

# Grids and planes.
GRID = "SELECT CAST(id AS BIGINT) AS qid, -1.5e0 + 3e0*CAST(floor(id/1e2) AS DOUBLE)/9e0 AS x, -1.5e0 + 3e0*CAST(floor(id/1e1) % 10 AS DOUBLE)/9e0 AS y, -1.5e0 + 3e0*CAST(id % 10 AS DOUBLE)/9e0 AS z FROM {source}"
HOW = Evaluation(k=32)
register(
    "w01_field_on_grid",
    lambda s, d: rounded_frame(fields.evaluate(s.sql(GRID.format(source="range(1000)")), tori(s, d), HOW).select("qid", "distance")),
    field_sql(HOW, tori_sql(), "(" + GRID.format(source="(SELECT range AS id FROM range(1000))") + ")", fields.terms(HOW), fields.results(HOW), ("distance",)),
)
s_, t_ = (0.6, 0.8, 0.0), (-0.48, 0.36, 0.8)
PLANE = "SELECT CAST(id AS BIGINT) AS qid, " + ", ".join(f"{c!r}e0 + {u!r}e0*(CAST(floor(id/2e1) AS DOUBLE)/9.5e0 - 1e0) + {v!r}e0*(CAST(id % 20 AS DOUBLE)/9.5e0 - 1e0) AS {n}" for n, c, u, v in zip(XYZ, (0.0, 0.1, 0.0), s_, t_, strict=True)) + " FROM {source}"
register(
    "w04_field_on_cut_plane",
    lambda s, d: rounded_frame(fields.evaluate(s.sql(PLANE.format(source="range(400)")), tori(s, d), HOW).select("qid", "distance")),
    field_sql(HOW, tori_sql(), "(" + PLANE.format(source="(SELECT range AS id FROM range(400))") + ")", fields.terms(HOW), fields.results(HOW), ("distance",)),
)

# Level sets. The oracle counts changes of sign: a vertex an edge, one or two faces a tetrahedron.
NODES = sql("grid_nodes")
STEPS = "(VALUES " + ", ".join(f"({m >> 0 & 1}, {m >> 1 & 1}, {m >> 2 & 1})" for m in range(1, 8)) + ") e(a, b, c)"
ORDERS = "(VALUES " + ", ".join(f"({1 << a}, {(1 << a) | (1 << b)})" for a in range(3) for b in range(3) if a != b) + ") o(first, second)"
CORNER = lambda m: f"(SELECT i - (({m}) & 1) AS i, j - ((({m}) >> 1) & 1) AS j, k - ((({m}) >> 2) & 1) AS k, v FROM nodes)"


def grid_surface(s, d):
    nodes = frame(s, d, "grid_nodes")
    return isosurface.extract(nodes, nodes.agg(F.max("n")).first()[0])


register(
    "w02_isosurface",
    lambda s, d: meshes.quality(*grid_surface(s, d)).select("n_faces", "n_vertices", "watertight", "consistent", "outward"),
    f"""WITH nodes AS MATERIALIZED (SELECT i, j, k, v FROM {NODES}),
        c AS MATERIALIZED (SELECT n0.i, n0.j, n0.k, n0.v, n1.v AS v1, n2.v AS v2, n3.v AS v3, n4.v AS v4, n5.v AS v5, n6.v AS v6, n7.v AS v7 FROM nodes n0
             {' '.join(f'JOIN {CORNER(m)} n{m} USING (i, j, k)' for m in range(1, 8))}),
        t AS (SELECT (v < 0e0)::int + ([v1, v2, v3, v4, v5, v6, v7][first] < 0e0)::int + ([v1, v2, v3, v4, v5, v6, v7][second] < 0e0)::int + (v7 < 0e0)::int AS inside FROM c, {ORDERS}),
        e AS (SELECT n.v, m.v AS w FROM nodes n, {STEPS} JOIN nodes m ON m.i = n.i + e.a AND m.j = n.j + e.b AND m.k = n.k + e.c)
        SELECT (SELECT CAST(sum(CASE WHEN inside = 2 THEN 2 WHEN inside IN (1, 3) THEN 1 ELSE 0 END) AS BIGINT) FROM t) AS n_faces,
               (SELECT count(*) FROM e WHERE (v < 0e0) <> (w < 0e0)) AS n_vertices, true AS watertight, true AS consistent, true AS outward""",
)
register(
    "w02_isosurface_vertices",
    lambda s, d: rounded_frame(grid_surface(s, d)[0].select("vid", *XYZ)),
    f"""WITH nodes AS MATERIALIZED (SELECT * FROM {NODES})
        SELECT 8*n.pid + e.a + 2*e.b + 4*e.c AS vid, {', '.join(f'(round(n.{c} + (0e0 - n.v) / (m.v - n.v) * (m.{c} - n.{c}), 6) + 0e0) AS {c}' for c in XYZ)}
        FROM nodes n, {STEPS} JOIN nodes m ON m.i = n.i + e.a AND m.j = n.j + e.b AND m.k = n.k + e.c WHERE (n.v < 0e0) <> (m.v < 0e0)""",
)
register(
    "w02_isosurface_of_torus_field",
    lambda s, d: (lambda m: meshes.quality(*m).join(m[0].selectExpr("max(abs(sqrt(x*x + y*y + z*z) - 1e0)) < 5.6e-2 AS on_sphere")).selectExpr("watertight", "consistent", "outward", "n_vertices - n_faces/2 AS euler", "on_sphere"))(
        isosurface.of_field(tori(s, d, "coeffs_sphere"), (-1.3, -1.3, -1.3), (1.3, 1.3, 1.3), 12, Evaluation(k=8))
    ),
    "SELECT true AS watertight, true AS consistent, true AS outward, 2e0 AS euler, true AS on_sphere",
)


def blob(s, d):
    nodes = frame(s, d, "grid_nodes")
    return isosurface.blob(nodes, nodes.agg(F.max("n")).first()[0], seed=11, octaves=2)


register(
    "r17_blob",
    lambda s, d: (lambda m: meshes.quality(*m).join(m[0].selectExpr("min(sqrt(x*x + y*y + z*z)) BETWEEN 0.5e0 AND 1e0 AND max(sqrt(x*x + y*y + z*z)) BETWEEN 1e0 AND 1.5e0 AS bent")).select("watertight", "consistent", "outward", "bent"))(blob(s, d)),
    "SELECT true AS watertight, true AS consistent, true AS outward, true AS bent",
)

# Error measures against the sphere's true distance.


def errors(s, d):
    got = fields.evaluate(frame(s, d, "queries_few"), tori(s, d), HOW, gradient=True)
    truth = Program(truth=norm(vec("")) - 1).on(frame(s, d, "queries_few"), "qid")
    return Program(e=col("distance") - col("truth"), k=1 - norm(vec("g"))).on(got.join(truth, "qid"), "qid")


ERRORS = Program(e=col("distance") - col("truth"), k=1 - norm(vec("g"))).sql(
    f"""(SELECT a.*, b.truth FROM ({field_sql(HOW, tori_sql(), sql('queries_few'), fields.terms(HOW, True), fields.results(HOW, True), ('distance', 'gx', 'gy', 'gz')).replace('round(', '(').replace(', 6)', ')')}) a
         JOIN {Program(truth=norm(vec('')) - 1).sql(sql('queries_few'), 'qid')} b ON a.qid = b.qid)""",
    "qid",
)
register("w06_error_probe", lambda s, d: rounded_frame(errors(s, d).selectExpr("qid", "e AS error")), rounded_sql(f"(SELECT qid, e AS error FROM {ERRORS})", ("qid",), ("error",)))
register(
    "x01_sdf_loss",
    lambda s, d: rounded_frame(errors(s, d).agg((F.avg(F.abs("e")) + F.avg(F.abs("k"))).alias("loss"))),
    f"SELECT (round(avg(abs(e)) + avg(abs(k)), 6) + 0e0) AS loss FROM {ERRORS}",
)
register(
    "x02_validation_loss",
    lambda s, d: rounded_frame(errors(s, d).agg(F.avg(F.abs("e")).alias("distance_loss"), F.avg(F.abs("k")).alias("eikonal_loss"))),
    f"SELECT (round(avg(abs(e)), 6) + 0e0) AS distance_loss, (round(avg(abs(k)), 6) + 0e0) AS eikonal_loss FROM {ERRORS}",
)
