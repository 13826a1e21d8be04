"""Blended torus fields and the comparison fields: pairs of query and point, one aggregation per query."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import torus
from ..functions.expr import PI, Ex, Program, add, col, dot, erf, exp, mul, num, sub, vec, where
from ..plans.session import materialize
from . import neighbours, tiles

#: lambda * shift.
SHARP = 64.0


@dataclass(frozen=True)
class Evaluation:
    """How a field is evaluated; a value, never session state."""

    k: int = -1
    radius: float = -1.0
    lambda_scale: float = 1.0
    use_areas: bool = False
    isovalue: float = 0.0
    rescale_in_radius: bool = True


def tori(cloud: DataFrame, coefficients: DataFrame, floored: bool = False) -> DataFrame:
    """The cloud with its fitted tori; points without coefficients drop out. The table is written: a filter on a fitted parameter would
    otherwise be pushed below the fit and carry all of its formulas along."""
    program = Program(**torus.fit(vec(""), vec("n"), torus.coefficients(), floored))
    return materialize(program.on(cloud.join(coefficients, "pid"), *cloud.columns), "tori")


def finite(cloud: DataFrame) -> DataFrame:
    """Points whose torus has only finite parameters."""
    ok = None
    for c in ("cx", "cy", "cz", "theta", "phi", "major_r", "minor_r"):
        this = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
        ok = this if ok is None else ok & this
    return cloud.where(ok)


def pairs(queries: DataFrame, cloud: DataFrame | neighbours.Tree | tiles.Tiles, how: Evaluation) -> DataFrame:
    """The pairs that a field sums over, with d, and per query shift = half the largest distance and lam. ``Tiles`` or a ``Tree`` stand for
    their cloud where only nearest points are asked for.

    The shift is found before the pairs are made, so these are never shuffled for it and the sums over them combine first."""
    lam = F.lit(SHARP * how.lambda_scale) / F.expr("nullif(shift, 0e0)")
    if how.radius > 0:
        return _in_balls(queries, cloud, how, lam)
    if how.k <= 0:
        far = tiles.farthest(queries, tiles.index(cloud.select("pid", "x", "y", "z")))
        asked = materialize(far.select(*queries.columns, (F.col("d") * 0.5).alias("shift")).withColumn("lam", lam), "shifts")
        return neighbours.all_pairs(asked, cloud.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL"), cloud.count())
    if isinstance(cloud, neighbours.Tree):
        got = neighbours.knn(queries, cloud, how.k)
        return got.withColumn("shift", F.max("d").over(Window.partitionBy("qid")) * 0.5).withColumn("lam", lam)
    index = neighbours.indexed(cloud)[0]
    return neighbours.looked_up(_shifted(queries, index, how.k).withColumn("lam", lam), index)


def _shifted(queries: DataFrame, index: tiles.Tiles, k: int) -> DataFrame:
    return neighbours.nearest_lists(queries, index, k).withColumn("shift", F.element_at("near", -1)["d"] * 0.5)


def _in_balls(queries: DataFrame, cloud: DataFrame, how: Evaluation, lam) -> DataFrame:
    """Pairs within the radius; of queries whose ball is empty, those with their nearest points."""
    cloud, n = materialize(cloud, "balls"), cloud.count()
    if how.rescale_in_radius:
        lam = lam * F.when(F.col("_m") < F.lit(n), F.lit(how.radius / math.sqrt(3))).otherwise(F.lit(1.0))
    ball = neighbours.within(queries.select("qid", "x", "y", "z"), cloud.select("pid", "x", "y", "z"), how.radius)
    balls = materialize(ball.groupBy("qid").agg((F.max("d") * 0.5).alias("shift"), F.count("*").alias("_m")), "shifts")
    near = neighbours.within(queries.join(balls, "qid").withColumn("lam", lam).drop("_m"), cloud, how.radius)
    index = tiles.index(cloud)
    alone = _shifted(queries.join(balls, "qid", "left_anti"), index, how.k if how.k > 0 else 10)
    alone = neighbours.looked_up(alone.withColumn("_m", F.size("near")).withColumn("lam", lam).drop("_m"), index)
    return near.unionByName(alone.select(*near.columns))


D, LAM, SHIFT = col("d"), col("lam"), col("shift")


def terms(how: Evaluation, gradient: bool = False, laplacian: bool = False, colour: bool = False) -> dict:
    """Per-pair terms of the torus field."""
    q, r = vec(""), sub(vec(""), vec("p"))
    t = torus.columns()
    w = exp(-LAM * (D - SHIFT))
    if how.use_areas:
        w = w * col("area")
    live = where(col("outlier"), num(0), w)
    g = torus.distance(q, t)
    out = {"w": live, "wg": live * g}
    if gradient:
        grad, hat = torus.gradient(q, t), mul(r, 1 / D)
        inner = sub(grad, mul(hat, LAM * g))
        out["touch"] = where(col("outlier") | (D > 0), num(0), num(1))
        out |= {f"wa{c}": live * v for c, v in zip("xyz", inner, strict=True)} | {f"wr{c}": live * v for c, v in zip("xyz", hat, strict=True)}
        if laplacian:
            s = torus.side(col("minor_r"))
            far = sub(q, (t["cx"], t["cy"], t["cz"]))
            # The torus's own Laplacian stands in as that of a sphere about its centre, as the reference has it.
            one = s * 2 / torus.norm(far) - 2 * LAM * dot(hat, grad) + LAM * g * (LAM - 2 / D)
            out |= {"wl": live * one, "wm": live * (2 / D - LAM)}
    if colour:
        out |= {f"w{c}": live * col(c) for c in ("red", "green", "blue")}
    return out


def results(how: Evaluation, gradient: bool = False, laplacian: bool = False, colour: bool = False) -> dict:
    """Per-query outputs from the sums s_*; lam is the query's."""
    w = col("s_w")
    phi = col("s_wg") / w
    out = {"distance": phi - how.isovalue}
    if gradient:
        a = tuple(col(f"s_wa{c}") / w for c in "xyz")
        b = tuple(LAM * col(f"s_wr{c}") / w for c in "xyz")
        known = col("s_touch") < 1  # no point of the sum lies at the query
        g = tuple(where(known, v, Ex("CAST(NULL AS DOUBLE)")) for v in add(a, mul(b, phi)))
        out |= dict(zip(("gx", "gy", "gz"), g, strict=True))
        if laplacian:
            out["laplacian"] = col("s_wl") / w + dot(a, b) + dot(g, b) + phi * (LAM * col("s_wm") / w + dot(b, b))
    if colour:
        out |= {c: col(f"s_w{c}") / w for c in ("red", "green", "blue")}
    return out


def summed(pairs_: DataFrame, per_pair: dict, per_query: dict, also: dict | None = None, keep=("qid", "lam", "shift")) -> DataFrame:
    """Project the terms, add them up per query, project the outputs."""
    got = Program(**per_pair).on(pairs_, *keep)
    got = got.groupBy("qid").agg(*[F.max(c).alias(c) for c in keep if c != "qid"], *[F.sum(c).alias(f"s_{c}") for c in per_pair], *[f.alias(c) for c, f in (also or {}).items()])
    return Program(**per_query).on(got, "qid")


def evaluate(queries: DataFrame, cloud: DataFrame, how: Evaluation = Evaluation(k=32), gradient: bool = False, laplacian: bool = False, colour: bool = False) -> DataFrame:  # noqa: B008
    """(qid, distance[, gx, gy, gz][, laplacian][, red, green, blue]) of the blended torus field.

    Outliers count among the neighbours and for the shift but not in the sums. A query on a point has a distance but no gradient; one
    on which all its neighbours lie has neither (NULL)."""
    cloud = cloud if isinstance(cloud, neighbours.Tree | tiles.Tiles) else finite(cloud)
    return summed(pairs(queries, cloud, how), terms(how, gradient, laplacian, colour), results(how, gradient, laplacian, colour))


# Comparison fields. Each is (terms per pair, outputs per query); ``area`` is a column of the cloud.

R = sub(vec(""), vec("p"))
N = vec("n")
W = exp(-LAM * (D - SHIFT))
AREA = col("area")


def _dipole():
    return (LAM * D + 1) * dot(R, N) / (2 * PI * D * D * D)


def planar() -> tuple[dict, dict]:
    """Self-normalised signed field: weighted mean of distances to tangent planes."""
    return {"a": AREA * dot(R, N) * W, "b": AREA * W}, {"field": col("s_a") / col("s_b")}


def planar_gradient() -> tuple[dict, dict]:
    h, hat = dot(R, N), mul(R, 1 / D)
    per = {f"a{c}": AREA * (n - LAM * h * u) * W for c, n, u in zip("xyz", N, hat, strict=True)}
    per |= {f"u{c}": AREA * u * W for c, u in zip("xyz", hat, strict=True)} | {"c": AREA * h * W, "e": AREA * W}
    e = col("s_e")
    return per, {f"g{c}": col(f"s_a{c}") / e + LAM * col(f"s_u{c}") * col("s_c") / (e * e) for c in "xyz"}


def signed_lse() -> tuple[dict, dict]:
    from ..functions.expr import log, sgn, vabs

    s = col("s_a")
    return {"a": AREA * _dipole() * W}, {"field": sgn(s) * (SHIFT - log(vabs(s)) / LAM)}


def signed_lse_gradient() -> tuple[dict, dict]:
    rn, cube = dot(R, N), D * D * D
    hat = mul(R, 1 / D)
    grad = [((LAM * D + 1) * n + LAM * u * rn) / (2 * PI * cube) - 3 * (LAM * D + 1) * rn * r / (2 * PI * cube * D * D) for n, u, r in zip(N, hat, R, strict=True)]
    per = {f"a{c}": AREA * g * W for c, g in zip("xyz", grad, strict=True)}
    per |= {f"u{c}": AREA * LAM * u * _dipole() * W for c, u in zip("xyz", hat, strict=True)} | {"c": AREA * W * _dipole()}
    return per, {f"g{c}": -(col(f"s_a{c}") - col(f"s_u{c}")) / (col("s_c") * LAM) for c in "xyz"}


def unsigned_lse(lam: float = 10.0) -> tuple[dict, dict]:
    """Over all points, with a fixed lambda."""
    from ..functions.expr import log

    shift = SHARP / lam
    return {"a": exp(-lam * (D - shift))}, {"field": shift - log(col("s_a")) / lam}


def winding() -> tuple[dict, dict]:
    """Negative inside for outward normals: the sum runs over q - p."""
    return {"a": AREA * dot(N, R) / (4 * PI * D * D * D)}, {"field": col("s_a")}


def smoothing(t):
    """What the smoothed kernel has of the plain one at t epsilons."""
    return erf(t) - 2 * t * exp(-t * t) / math.sqrt(PI)


def regularised_winding(epsilon: float = 0.1) -> tuple[dict, dict]:
    """Positive inside: the sum runs over p - q, with the kernel smoothed within about epsilon."""
    k = smoothing(D / epsilon)
    return {"a": -AREA * dot(N, R) * k / (4 * PI * D * D * D)}, {"field": col("s_a")}


COMPARISONS = {
    "signed_lse": (signed_lse, 32),
    "signed_lse_gradient": (signed_lse_gradient, 32),
    "planar": (planar, 32),
    "planar_gradient": (planar_gradient, 32),
    "unsigned_lse": (unsigned_lse, -1),
    "winding": (winding, -1),
    "regularised_winding": (regularised_winding, -1),
}


def compare(name: str, queries: DataFrame, cloud: DataFrame, k: int | None = None) -> DataFrame:
    """One of the comparison fields; points without ``area`` don't count."""
    build, default = COMPARISONS[name]
    per_pair, per_query = build()
    return summed(pairs(queries, cloud, Evaluation(k=k if k is not None else default)), per_pair, per_query)


