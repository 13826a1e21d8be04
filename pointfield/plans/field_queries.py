"""Queries over clouds: vectors, fits, neighbours, fields."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import torus
from ..functions.expr import Program, add, basis, clamp, col, cross, dot, erf, from_spherical, high, low, mul, norm, num, rounded, sgn, side, sub, to_spherical, unit, vabs, vec, where
from ..operators import fields, neighbours, tiles
from ..operators.fields import Evaluation
from .catalog import register
from .fixtures import frame, sql

CLOUD = ("pid", "x", "y", "z", "nx", "ny", "nz", "area", "outlier")
TORUS = ("cx", "cy", "cz", "theta", "phi", "major_r", "minor_r")


def rounded_frame(df, *keys):
    """Doubles to six decimals, in the same words as the oracle's."""
    kinds = dict(df.dtypes)
    return df.selectExpr(*[f"(round({c}, 6) + 0e0) AS {c}" if kinds[c] == "double" else c for c in df.columns])


def rounded_sql(source: str, ids: tuple, values: tuple) -> str:
    return f"SELECT {', '.join(ids)}, {', '.join(f'(round({v}, 6) + 0e0) AS {v}' for v in values)} FROM {source}"


def projection(name: str, fixture: str, ids: tuple, **outputs) -> None:
    """A query of scalar formulas over a fixture."""
    program = Program(**{k: rounded(v) for k, v in outputs.items()})
    register(name, lambda s, d: program.on(frame(s, d, fixture), *ids), "SELECT * FROM " + program.sql(sql(fixture), *ids))


P, N = vec(""), vec("n")
C = (col("x") * 0.5 + 0.1, col("y") - 0.2, col("z") * 2)

# Vector and scalar primitives.
projection("v01_sign_three_valued", "queries", ("qid",), s=sgn(col("x") - col("y")), z=sgn(num(0) * col("x")))
projection("v02_sign_two_valued", "queries", ("qid",), s=side(col("x") - col("y")), z=side(num(0) * col("x") + 0))
projection("v03_clamp_min_max", "queries", ("qid",), a=clamp(col("x"), -0.5, 0.75), b=high(col("x"), col("y")), c=low(col("x"), col("y")), e=vabs(col("z")), f=col("x") * C[1] - col("y") * C[0])
projection("v04_branching_min_max", "queries", ("qid",), a=where(col("x") < col("y"), col("x"), col("y")), b=where(col("x") > col("y"), col("x"), col("y")), c=where(col("z") >= 0, col("z"), -col("z")))
for i, (key, n) in enumerate((("v05_orthonormal_basis", N), ("v06_orthonormal_basis_unnormalised", mul(N, 3.0)))):
    s_, t_ = basis(n)
    projection(key, "cloud_sphere", ("pid",), **dict(zip(("sx", "sy", "sz", "tx", "ty", "tz"), s_ + t_, strict=True)))
projection("v08_spherical_to_cartesian", "queries", ("qid",), **dict(zip("abc", from_spherical(col("x"), col("y")), strict=True)))
projection("v09_cartesian_to_spherical", "queries", ("qid",), **dict(zip(("theta", "phi"), to_spherical(unit(P)), strict=True)))
projection("v10_sharpness_of_shift", "queries", ("qid",), lam=num(fields.SHARP) / vabs(col("x")))
projection("v12_erf", "queries", ("qid",), e=erf(col("x")))
projection("v13_point_box_distance", "queries", ("qid",), d2=dot(*[[high(vabs(c) - b, 0) for c, b in zip(P, (0.5, 0.7, 0.9), strict=True)]] * 2))
A_, B_, C_ = (tuple(col(k) for k in ks) for ks in (("ax", "ay", "az"), ("bx", "by_", "bz"), ("cx", "cy", "cz")))
face = cross(sub(B_, A_), sub(C_, A_))
projection("v14_triangle_properties", "mesh_torus", ("fid",), area=norm(face) * 0.5, **dict(zip(("ux", "uy", "uz"), unit(face), strict=True)), **dict(zip(("mx", "my", "mz"), mul(add(add(A_, B_), C_), 1 / 3), strict=True)))
box = [vabs(a - b) for a, b in zip(P, C, strict=True)]
projection("v15_box_surface", "queries", ("qid",), s=2 * (box[0] * box[1] + box[1] * box[2] + box[2] * box[0]))


# Patches and tori.
def patched(s, d, coeffs="coeffs_generic", cloud="cloud_sphere"):
    return frame(s, d, cloud).join(frame(s, d, coeffs), "pid")


def patched_sql(coeffs="coeffs_generic", cloud="cloud_sphere") -> str:
    return f"(SELECT c.*, k.* EXCLUDE (pid) FROM {sql(cloud)} c JOIN {sql(coeffs)} k ON c.pid = k.pid)"


def over_patches(name: str, coeffs: str = "coeffs_generic", **outputs) -> None:
    program = Program(**{k: rounded(v) for k, v in outputs.items()})
    register(name, lambda s, d: program.on(patched(s, d, coeffs), "pid"), "SELECT * FROM " + program.sql(patched_sql(coeffs), "pid"))


COEFFS = torus.coefficients()
for key, guarded in (("t01_curvatures_plain", False), ("t03_curvatures_guarded", True)):
    k_min, k_max, v_min, v_max, normal = torus.curvatures(N, COEFFS, guarded)
    over_patches(key, k_min=k_min, k_max=k_max, **dict(zip(("hx", "hy", "hz"), normal, strict=True)))
k_min, k_max, v_min, v_max, normal = torus.curvatures(N, COEFFS, False)
over_patches("t02_principal_directions", **dict(zip(("lx", "ly", "lz", "mx", "my", "mz"), v_min + v_max, strict=True)))
# The same from a table of nine: the six as before, and three of higher degree that don't bend the origin.
TABLE = {f"c{n[1]}{n[2]}": col(n) for n in torus.NAMES} | {"c12": col("a11") * 3, "c21": col("a20") + 1, "c22": num(7)}
k_low, k_high, v_low, _, up = torus.curvatures(N, {n: TABLE[e.form] for n, e in torus.polynomial().items()}, False)
over_patches("t04_curvatures_of_polynomial", k_min=k_low, k_max=k_high, **dict(zip(("vx", "vy", "vz", "hx", "hy", "hz"), v_low + up, strict=True)))
over_patches("t09_principal_curvatures", k_min=k_min, k_max=k_max)
over_patches("t05_fit_torus", **torus.fit(P, N, COEFFS))
over_patches("t07_fit_torus_sphere_patch", "coeffs_sphere", minor_r=torus.fit(P, N, COEFFS)["minor_r"], major_r=torus.fit(P, N, COEFFS)["major_r"], cz=torus.fit(P, N, COEFFS)["cz"])
over_patches("t08_fit_torus_floored", **torus.fit(P, N, COEFFS, True))
FIT = torus.fit(P, N, COEFFS)
NEAR = add(P, (num(0.3), num(-0.2), num(0.25)))
over_patches("t12_torus_distance", d=torus.distance(NEAR, FIT))
over_patches("t13_torus_gradient", d=torus.distance(NEAR, FIT), **dict(zip(("gx", "gy", "gz"), torus.gradient(NEAR, FIT), strict=True)))


def tori_sql(coeffs: str = "coeffs_generic", cloud: str = "cloud_sphere") -> str:
    return Program(**FIT).sql(patched_sql(coeffs, cloud), *CLOUD)


def tori(s, d, coeffs="coeffs_generic"):
    return fields.tori(frame(s, d, "cloud_sphere"), frame(s, d, coeffs))


register("t06_fit_all", lambda s, d: rounded_frame(tori(s, d).select("pid", *TORUS)), rounded_sql(tori_sql(), ("pid",), TORUS))
FINITE = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < 1e308" for c in TORUS)
register("f03_finite_tori", lambda s, d: rounded_frame(fields.finite(tori(s, d, "coeffs_sphere")).select("pid", *TORUS)), rounded_sql(f"(SELECT * FROM {tori_sql('coeffs_sphere')} WHERE {FINITE})", ("pid",), TORUS))
register(
    "f04_degenerate_tori",
    lambda s, d: tori(s, d, "coeffs_sphere").where("abs(minor_r) < 1e-10 OR abs(major_r) < 1e-10").groupBy().agg(F.count("*").alias("n")),
    f"SELECT count(*) AS n FROM {tori_sql('coeffs_sphere')} WHERE abs(minor_r) < 1e-10 OR abs(major_r) < 1e-10",
)


# Neighbours; the oracle ranks all pairs.
def pairs_sql(queries: str, cloud: str, k: int = -1, radius: float = -1.0, q: str = "qid", extra: str = "") -> str:
    body = f"""SELECT q.*, c.* EXCLUDE (x, y, z), c.x AS px, c.y AS py, c.z AS pz, sqrt((q.x-c.x)*(q.x-c.x) + (q.y-c.y)*(q.y-c.y) + (q.z-c.z)*(q.z-c.z)) AS d
              FROM {queries} q CROSS JOIN {cloud} c"""
    if k > 0:
        body = f"SELECT *, row_number() OVER (PARTITION BY {q} ORDER BY d, pid) AS rank FROM ({body}) QUALIFY rank <= {k}"
    if radius > 0:
        body = f"SELECT * FROM ({body}) WHERE d <= {radius!r}"
    return f"({body})"


TORUS_CLOUD = sql("cloud_torus")
NEAREST = lambda s, d, k: neighbours.knn(frame(s, d, "queries"), frame(s, d, "cloud_torus").select("pid", "x", "y", "z"), k)
XYZ = f"(SELECT pid, x, y, z FROM {TORUS_CLOUD})"
SPHERE = f"(SELECT pid, x, y, z FROM {sql('cloud_sphere')})"
SELF = f"(SELECT pid AS i, x, y, z FROM {sql('cloud_sphere')})"
sphere_points = lambda s, d: frame(s, d, "cloud_sphere").select("pid", "x", "y", "z", "outlier")

register("j01_knn_self", lambda s, d: rounded_frame(neighbours.self_knn(sphere_points(s, d), 8)), rounded_sql(pairs_sql(SELF, SPHERE, 8, q="i"), ("i", "pid", "rank"), ("d",)))
register(
    "j02_knn_of_points",
    lambda s, d: rounded_frame(neighbours.knn(sphere_points(s, d).where("pid % 10 = 3").select(F.col("pid").alias("i"), "x", "y", "z"), sphere_points(s, d).drop("outlier"), 5, "i").select("i", "pid", "rank", "d")),
    rounded_sql(pairs_sql(f"(SELECT * FROM {SELF} WHERE i % 10 = 3)", SPHERE, 5, q="i"), ("i", "pid", "rank"), ("d",)),
)
register("j05_knn_batch", lambda s, d: rounded_frame(NEAREST(s, d, 32).select("qid", "pid", "rank", "d")), rounded_sql(pairs_sql(sql("queries"), XYZ, 32), ("qid", "pid", "rank"), ("d",)))
register(
    "j06_all_pairs",
    lambda s, d: rounded_frame((lambda c: neighbours.all_pairs(frame(s, d, "queries_few"), c, c.count()))(frame(s, d, "cloud_sphere").select("pid", "x", "y", "z")).groupBy("qid").agg(F.count("*").alias("n"), F.sum("d").alias("total"), F.min("d").alias("least"), F.max("d").alias("most"))),
    rounded_sql(f"(SELECT qid, count(*) AS n, sum(d) AS total, min(d) AS least, max(d) AS most FROM {pairs_sql(sql('queries_few'), SPHERE)} GROUP BY qid)", ("qid", "n"), ("total", "least", "most")),
)
BALL = lambda s, d, r=0.2: neighbours.within(frame(s, d, "queries"), frame(s, d, "cloud_torus").select("pid", "x", "y", "z"), r, only=("qid", "pid", "d"))
register("j08_radius", lambda s, d: rounded_frame(BALL(s, d)), rounded_sql(pairs_sql(sql("queries"), XYZ, radius=0.2), ("qid", "pid"), ("d",)))
FALLBACK = f"""(WITH ball AS MATERIALIZED (SELECT * FROM {pairs_sql(sql('queries'), XYZ, radius=0.2)})
  SELECT qid, pid, d FROM ball UNION ALL SELECT qid, pid, d FROM {pairs_sql(f"(SELECT * FROM {sql('queries')} WHERE qid NOT IN (SELECT qid FROM ball))", XYZ, 10)})"""
register(
    "j09_radius_or_nearest",
    lambda s, d: rounded_frame(neighbours.within_or_nearest(frame(s, d, "queries"), frame(s, d, "cloud_torus").select("pid", "x", "y", "z"), 0.2, only=("qid", "pid", "d"))),
    rounded_sql(FALLBACK, ("qid", "pid"), ("d",)),
)
register("j10_closest_point", lambda s, d: rounded_frame(NEAREST(s, d, 1).select("qid", "pid", "d")), rounded_sql(pairs_sql(sql("queries"), XYZ, 1), ("qid", "pid"), ("d",)))
register("j11_k_nearest", lambda s, d: rounded_frame(NEAREST(s, d, 5).select("qid", "pid", "rank", "d")), rounded_sql(pairs_sql(sql("queries"), XYZ, 5), ("qid", "pid", "rank"), ("d",)))
register(
    "j12_points_in_radius",
    lambda s, d: rounded_frame(BALL(s, d, 0.1).groupBy("qid").agg(F.count("*").alias("n"), F.min("d").alias("least"))),
    rounded_sql(f"(SELECT qid, count(*) AS n, min(d) AS least FROM {pairs_sql(sql('queries'), XYZ, radius=0.1)} GROUP BY qid)", ("qid", "n"), ("least",)),
)
register(
    "j15_average_neighbour_distance",
    lambda s, d: rounded_frame(neighbours.self_knn(sphere_points(s, d), 16).agg(F.avg("d").alias("mean"))),
    f"SELECT (round(avg(d), 6) + 0e0) AS mean FROM {pairs_sql(SELF, SPHERE, 16, q='i')}",
)
register(
    "j16_optimal_radius",
    lambda s, d: rounded_frame(neighbours.self_knn(sphere_points(s, d), 64).agg((F.avg("d") * 128 / 1000).alias("radius"))),
    f"SELECT (round(avg(d) * 128e0 / 1000e0, 6) + 0e0) AS radius FROM {pairs_sql(SELF, SPHERE, 64, q='i')}",
)
register(
    "j18_farthest_point",
    lambda s, d: rounded_frame(tiles.farthest(frame(s, d, "queries_few"), tiles.index(frame(s, d, "cloud_sphere").select("pid", "x", "y", "z"))).select("qid", "pid", "d")),
    rounded_sql(f"(SELECT qid, pid, d FROM {pairs_sql(sql('queries_few'), SPHERE)} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d DESC, pid) = 1)", ("qid", "pid"), ("d",)),
)
register(
    "f02_outliers_removed_before_knn",
    lambda s, d: rounded_frame(neighbours.self_knn(sphere_points(s, d), 4, drop_outliers=True)),
    f"""WITH c AS (SELECT * FROM {sql('cloud_sphere')}), ok AS (SELECT pid, x, y, z FROM c WHERE NOT outlier)
        {rounded_sql(pairs_sql('(SELECT pid AS i, x, y, z FROM ok)', 'ok', 4, q='i'), ('i', 'pid', 'rank'), ('d',))}
        UNION ALL SELECT pid, -1, 1, -1e0 FROM c WHERE outlier""",
)
register("f05_inside_box", lambda s, d: frame(s, d, "queries").where("x BETWEEN -1e0 AND 0.5e0 AND y BETWEEN -0.7e0 AND 1e0 AND z BETWEEN 0e0 AND 1.5e0").select("qid"), f"SELECT qid FROM {sql('queries')} WHERE x BETWEEN -1e0 AND 0.5e0 AND y BETWEEN -0.7e0 AND 1e0 AND z BETWEEN 0e0 AND 1.5e0")


# Fields; the oracle blends all ranked pairs.
def field_sql(how: Evaluation, cloud: str, queries: str, per_pair: dict, per_query: dict, values: tuple) -> str:
    factor = f"{how.radius / math.sqrt(3)!r}" if how.radius > 0 else "1e0"
    got = pairs_sql(queries, cloud, how.k if how.radius <= 0 else -1)
    if how.radius > 0:
        got = f"""(WITH every AS MATERIALIZED (SELECT * FROM {pairs_sql(queries, cloud)}), ball AS (SELECT * FROM every WHERE d <= {how.radius!r}),
             alone AS (SELECT * FROM every WHERE qid NOT IN (SELECT qid FROM ball) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, pid) <= {how.k if how.k > 0 else 10})
             SELECT * FROM ball UNION ALL SELECT * FROM alone)"""
    got = f"(SELECT *, max(d) OVER (PARTITION BY qid) * 0.5e0 AS shift FROM {got})"
    got = f"(SELECT *, {fields.SHARP * how.lambda_scale!r}e0 / nullif(shift, 0e0) * {factor} AS lam FROM {got})"
    got = Program(**per_pair).sql(got, "qid", "lam", "shift")
    got = f"(SELECT qid, max(lam) AS lam, max(shift) AS shift, {', '.join(f'sum({c}) AS s_{c}' for c in per_pair)} FROM {got} GROUP BY qid)"
    return rounded_sql(Program(**per_query).sql(got, "qid"), ("qid",), values)


def blended(name: str, how: Evaluation, coeffs: str = "coeffs_generic", queries: str = "queries_few", gradient=False, laplacian=False, only: tuple = (), recipe=None) -> None:
    outputs = fields.results(how, gradient, laplacian)
    values = only or tuple(outputs)
    register(
        name,
        lambda s, d: rounded_frame(fields.evaluate(frame(s, d, queries), tori(s, d, coeffs), how, gradient, laplacian).select("qid", *values)),
        field_sql(how, tori_sql(coeffs), sql(queries), fields.terms(how, gradient, laplacian), outputs, values),
    )


def first_shift(how: Evaluation):
    return lambda s, d: rounded_frame(fields.pairs(frame(s, d, "queries_few"), tori(s, d), how).groupBy("qid").agg(F.max("shift").alias("shift")))


register("e01_shift", first_shift(Evaluation(k=32)), rounded_sql(f"(SELECT qid, max(d) * 0.5e0 AS shift FROM {pairs_sql(sql('queries_few'), SPHERE, 32)} GROUP BY qid)", ("qid",), ("shift",)))
blended("e02_distance_all_pairs", Evaluation())
blended("e03_distance_k32", Evaluation(k=32), "coeffs_sphere", "queries")
blended("e03_distance_generic_k32", Evaluation(k=32), queries="queries")
blended("e04_gradient", Evaluation(k=32), gradient=True, only=("gx", "gy", "gz"))
blended("e05_laplacian_placeholder", Evaluation(k=16), gradient=True, laplacian=True, only=("laplacian",))
blended("e06_distance_gradient_laplacian", Evaluation(k=16), gradient=True, laplacian=True)
blended("e07_signed_distance_accelerated", Evaluation(k=32, isovalue=0.05), queries="queries")
blended("e07_signed_distance_and_gradient_exact", Evaluation(), gradient=True)
blended("e12_lambda_scale", Evaluation(k=24, lambda_scale=0.5))
blended("e12_use_areas", Evaluation(k=24, use_areas=True))
blended("f01_outliers_in_shift_only", Evaluation(k=8))
blended("e09_radius_or_nearest", Evaluation(radius=0.6, k=10))
SLOPE_TERMS, per_query = fields.terms(Evaluation(k=32), True), fields.results(Evaluation(k=32), True)
SLOPE = norm(tuple(per_query[c] for c in ("gx", "gy", "gz")))
register(
    "e11_eikonality",
    lambda s, d: rounded_frame(fields.summed(fields.pairs(frame(s, d, "queries_few"), fields.finite(tori(s, d)), Evaluation(k=32)), SLOPE_TERMS, {"eikonality": 1 - SLOPE})),
    field_sql(Evaluation(k=32), tori_sql(), sql("queries_few"), SLOPE_TERMS, {"eikonality": 1 - SLOPE}, ("eikonality",)),
)
COLOURED = f"(SELECT *, 0.5e0 + 0.5e0*nx AS red, 0.5e0 + 0.5e0*ny AS green, 0.5e0 + 0.5e0*nz AS blue FROM {tori_sql()})"
coloured = lambda s, d: tori(s, d).withColumns({c: F.expr(f"0.5e0 + 0.5e0*{n}") for c, n in (("red", "nx"), ("green", "ny"), ("blue", "nz"))})
register(
    "e10_blended_colour",
    lambda s, d: rounded_frame(fields.evaluate(frame(s, d, "queries_few"), coloured(s, d), Evaluation(k=32), colour=True).select("qid", "red", "green", "blue")),
    field_sql(Evaluation(k=32), COLOURED, sql("queries_few"), fields.terms(Evaluation(k=32), colour=True), fields.results(Evaluation(k=32), colour=True), ("red", "green", "blue")),
)
for number, key in enumerate(("unsigned_lse", "signed_lse", "signed_lse_gradient", "planar", "planar_gradient", "winding", "regularised_winding"), 1):
    build, k = fields.COMPARISONS[key]
    per_pair, per_query = build()
    register(
        f"c{number:02d}_{key}",
        lambda s, d, key=key: rounded_frame(fields.compare(key, frame(s, d, "queries_few"), frame(s, d, "cloud_sphere"))),
        field_sql(Evaluation(k=k), sql("cloud_sphere"), sql("queries_few"), per_pair, per_query, tuple(per_query)),
    )
