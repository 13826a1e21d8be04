"""Clouds from rays: simulated scanners, random lines, and points of an isosurface."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import Program, add, basis, col, mul, num, vec
from ..plans.session import materialize
from . import marching, meshes, sampling
from .fields import Evaluation

RAY = ("ox", "oy", "oz", "dx", "dy", "dz")


def scanner_rays(spark, cameras: int, spacing: float, half: float = 1.0, seed: int = 0, uneven: bool = False) -> DataFrame:
    """(rid, origin, direction): from each camera of a Fibonacci sphere of radius sqrt(3) a square grid of parallel rays to the
    centre, ``spacing`` apart; uneven scans draw each camera's spacing between one and two times that."""
    steps = max(1, round(half / spacing))
    at = sampling.fibonacci_sphere(spark, cameras)
    at = at.withColumn("gap", F.lit(spacing) * ((1 + sampling.uniform(seed, 1, "pid")) if uneven else F.lit(1.0)))
    grid = at.withColumn("i", F.explode(F.sequence(F.lit(-steps), F.lit(steps)))).withColumn("j", F.explode(F.sequence(F.lit(-steps), F.lit(steps))))
    c = vec("")
    s, t = basis(c)
    i, j = col("CAST(i AS DOUBLE)") * col("gap"), col("CAST(j AS DOUBLE)") * col("gap")
    origin = add(add(mul(c, math.sqrt(3)), mul(s, i)), mul(t, j))
    out = Program(**dict(zip(RAY, (*origin, *mul(c, num(-1))), strict=True))).on(grid, "pid", "i", "j")
    side = 2 * steps + 1
    return out.selectExpr(f"(pid * {side} + i + {steps}) * {side} + j + {steps} AS rid", *RAY)


def scan(tri: DataFrame, cameras: int = 12, spacing: float = 0.1, points: int | None = None, uneven: bool = False, seed: int = 0) -> DataFrame:
    """(pid, x, y, z, nx, ny, nz) of the surfaces that the cameras see; even scans are thinned to ``points`` by farthest points, uneven
    ones by seeded order."""
    hits = meshes.hit_points(scanner_rays(tri.sparkSession, cameras, spacing, seed=seed, uneven=uneven), tri).withColumnRenamed("rid", "pid")
    if points is None:
        return hits
    if uneven:
        return sampling.first_in_order(hits, "pid", points, seed).where("_first").drop("_first")
    return sampling.farthest_points(hits, points).drop("rank")


def random_lines(spark, n: int, radius: float, seed: int = 0, first: int = 0) -> DataFrame:
    """(rid, origin, direction) of lines through a ball, from number ``first`` on: between two uniform points of its sphere."""

    def on_sphere(draw: int):
        z = 2 * sampling.uniform(seed, draw, "id") - 1
        a = 2 * math.pi * sampling.uniform(seed, draw + 1, "id")
        r = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
        return r * F.cos(a) * radius, r * F.sin(a) * radius, z * radius

    rows = spark.range(first, first + n).select(F.col("id").alias("rid"), *[v.alias(c) for v, c in zip((*on_sphere(0), *on_sphere(2)), ("ox", "oy", "oz", "tx", "ty", "tz"), strict=True)])
    rows = rows.withColumn("l", F.expr("sqrt((tx-ox)*(tx-ox) + (ty-oy)*(ty-oy) + (tz-oz)*(tz-oz))"))
    return rows.select("rid", "ox", "oy", "oz", *[F.expr(f"(t{c} - o{c}) / nullif(l, 0e0)").alias(f"d{c}") for c in "xyz"])


#: Lines whose points are numbered together.
DEALT = 4096


def _until(spark, n: int, radius: float, seed: int, cast: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Exactly the first n of the rows (rid, k, ..) that ``cast`` gives for seeded random lines, by line and k; rid and k become pid, from 0.
    Rounds of lines go on until there are enough. An error if no line of 10 n, 1,000 at least, meets anything."""
    got, cast_lines, found = None, 0, 0
    while found < n or got is None:
        if not found and cast_lines >= max(10 * n, 1000):
            raise ValueError(f"none of {cast_lines} lines meets the surface")
        more = n if got is None else math.ceil(1.1 * (n - found) * cast_lines / found) + 16 if found else max(10 * n, 1000) - cast_lines
        now = materialize(cast(random_lines(spark, more, radius, seed, cast_lines)), "lines")
        got, cast_lines, found = now if got is None else got.union(now), cast_lines + more, found + now.count()
        if n <= 0:
            break
    got = got.withColumn("_deal", F.floor(F.col("rid") / DEALT))
    before = got.groupBy("_deal").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    turn = F.row_number().over(Window.partitionBy("_deal").orderBy("rid", "k"))
    numbered = got.withColumn("_turn", turn).join(F.broadcast(before), "_deal").withColumn("pid", F.col("_before") + F.col("_turn") - 1)
    return numbered.where(F.col("pid") < n).select("pid", *[c for c in now.columns if c not in ("rid", "k")])


def _crossed(rays: DataFrame, found: DataFrame) -> DataFrame:
    """(rid, k, x, y, z) of all crossings."""
    at = found.select("rid", F.posexplode("found").alias("k", "s")).join(rays, "rid")
    return at.select("rid", "k", *[F.expr(f"o{c} + s * d{c}").alias(c) for c in "xyz"])


def by_random_lines(tri: DataFrame, n: int, radius: float = 1.0, seed: int = 0) -> DataFrame:
    """(pid, x, y, z, nx, ny, nz): n first hits of random lines, as the reference has them."""
    index = meshes.tree(tri)
    return _until(tri.sparkSession, n, radius, seed, lambda rays: meshes.hit_points(rays, index).withColumn("k", F.lit(0)))


def lifted_samples(spark, name: str, lift: str, amount: float, n: int, radius: float = 1.5, seed: int = 0, **params) -> DataFrame:
    """(pid, x, y, z): n crossings of random lines with a lifted shape, all of a line's."""
    return _until(spark, n, radius, seed, lambda rays: _crossed(rays, marching.shape_crossings(rays, name, lift, amount, 2 * radius, **params)))


def isosurface_samples(cloud: DataFrame, n: int, how: Evaluation, radius: float = 1.5, seed: int = 0) -> DataFrame:
    """(pid, x, y, z): n crossings of random lines with the zero set of a torus field, all of a line's."""
    return _until(cloud.sparkSession, n, radius, seed, lambda rays: _crossed(rays, marching.field_crossings(rays, cloud, how, 2 * radius)))
