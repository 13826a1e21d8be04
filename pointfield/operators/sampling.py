"""Samplers and measures of clouds. Draws are hashes of (seed, row, draw): the same whatever the partitioning."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import mesh
from ..functions.expr import Program, add, col, cross, mul, norm, num, sqrt, sub, unit
from ..plans.session import drop, materialize
from . import neighbours


def uniform(seed: int, draw: int, *keys: str) -> Column:
    """In [0, 1): the top 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(draw), *keys), 11).cast("double") / float(1 << 53)


def normal(seed: int, draw: int, *keys: str) -> Column:
    u, v = uniform(seed, 2 * draw, *keys), uniform(seed, 2 * draw + 1, *keys)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * 3.141592653589793 * v)


def rotation(seed: int, *keys: str) -> list[list[Column]]:
    """A rotation, uniform over all, drawn for each value of the keys (one for all rows without): the matrix of the quaternion of three draws."""
    u, v, w = (uniform(seed, 30 + i, *keys) for i in range(3))
    a, b = F.sqrt(1 - u), F.sqrt(u)
    tau = 2 * 3.141592653589793
    x, y, z, r = a * F.sin(tau * v), a * F.cos(tau * v), b * F.sin(tau * w), b * F.cos(tau * w)
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * r), 2 * (x * z + y * r)],
        [2 * (x * y + z * r), 1 - 2 * (x * x + z * z), 2 * (y * z - x * r)],
        [2 * (x * z - y * r), 2 * (y * z + x * r), 1 - 2 * (x * x + y * y)],
    ]


def rotated(df: DataFrame, seed: int = 0, *keys: str, prefix: str = "") -> DataFrame:
    """``df`` with its vectors ``prefix`` x, y, z turned by one seeded rotation, or by one for each value of the keys. NULL stays NULL."""
    m = rotation(seed, *keys)
    return df.withColumns({f"{prefix}{c}": sum((m[i][j] * F.col(f"{prefix}{d}") for j, d in enumerate("xyz")), F.lit(0.0)) for i, c in enumerate("xyz")})


def random_basis(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """``df`` with sx .. sz and tx .. tz: unit vectors that make an orthonormal basis with its normal nx .. nz, at a random angle around it. A zero or
    NULL normal has a NULL basis."""
    drawn = df.withColumns({f"_g{c}": normal(seed, 40 + i, *keys) for i, c in enumerate("xyz")})
    n = unit(tuple(col(f"n{c}") for c in "xyz"))
    g = tuple(col(f"_g{c}") for c in "xyz")
    along = g[0] * n[0] + g[1] * n[1] + g[2] * n[2]
    s = unit(sub(g, mul(n, along)))
    out = Program(**dict(zip(("sx", "sy", "sz", "tx", "ty", "tz"), (*s, *cross(n, s)), strict=True)))
    return out.on(drawn, *df.columns)


def bounding_box(df: DataFrame) -> DataFrame:
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def center_and_scale(cloud: DataFrame) -> DataFrame:
    """Minus the mean, over the largest range of an axis."""
    one = cloud.agg(*[F.avg(c).alias(f"_m{c}") for c in "xyz"], F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]).alias("_s"))
    return cloud.join(F.broadcast(one)).withColumns({c: F.expr(f"({c} - _m{c}) / nullif(_s, 0e0)") for c in "xyz"}).drop("_mx", "_my", "_mz", "_s")


def center_and_scale_vertices(vertices: DataFrame) -> DataFrame:
    """Minus the mean, over the largest absolute coordinate; unscaled where that is tiny."""
    mean = vertices.agg(*[F.avg(c).alias(f"_m{c}") for c in "xyz"])
    moved = vertices.join(F.broadcast(mean)).withColumns({c: F.col(c) - F.col(f"_m{c}") for c in "xyz"}).drop("_mx", "_my", "_mz")
    most = moved.agg(F.max(F.greatest(*[F.abs(c) for c in "xyz"])).alias("_s"))
    return moved.join(F.broadcast(most)).withColumns({c: F.when(F.col("_s") > 1e-10, F.expr(f"{c} / nullif(_s, 0e0)")).otherwise(F.col(c)) for c in "xyz"}).drop("_s")


#: Faces whose areas are added up in one window.
DEALT = 4096


def on_surface(tri: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(pid, fid, x, y, z, nx, ny, nz): n points, faces drawn in proportion to their areas.

    Draws and faces meet on cells of the cumulative area, so each draw compares with the few faces of its cell. Areas are added up by
    ranges of ids, then the ranges' sums."""
    a, b, c = mesh.corners()
    area = Program(area=norm(cross(sub(b, a), sub(c, a))) * 0.5).on(tri)
    total = area.agg(F.sum("area")).first()[0] or 1.0
    faces = area.count()
    area = area.withColumn("_deal", F.floor(F.col("fid") / DEALT))
    deals = area.groupBy("_deal").agg(F.sum("area").alias("_sum"))
    deals = deals.select("_deal", F.coalesce(F.sum("_sum").over(Window.orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    upto = F.col("_before") + F.sum("area").over(Window.partitionBy("_deal").orderBy("fid"))
    band = area.join(deals, "_deal").withColumn("_to", upto / total).withColumn("_from", F.col("_to") - F.col("area") / total)
    cells = max(1, faces)
    cell = lambda c: F.least(F.floor(c * cells), F.lit(cells - 1)).cast("long")
    band = band.withColumn("_cell", F.explode(F.sequence(cell(F.greatest(F.col("_from"), F.lit(0.0))), cell(F.col("_to")))))
    draws = tri.sparkSession.range(n).select(F.col("id").alias("pid"), uniform(seed, 0, "id").alias("_w"), uniform(seed, 1, "id").alias("_u"), uniform(seed, 2, "id").alias("_v")).withColumn("_cell", cell(F.col("_w")))
    got = draws.join(band, "_cell").withColumn("_turn", F.row_number().over(Window.partitionBy("pid").orderBy(F.when((F.col("_w") >= F.col("_from")) & (F.col("_w") < F.col("_to")), 0).otherwise(1), "fid"))).where("_turn = 1")
    s = sqrt(col("_u"))
    p = add(add(mul(a, 1 - s), mul(b, s * (1 - col("_v")))), mul(c, s * col("_v")))
    out = dict(zip(("x", "y", "z", "nx", "ny", "nz"), (*p, *unit(cross(sub(b, a), sub(c, a)))), strict=True))
    return Program(**out).on(got, "pid", "fid")


def narrow_band(cloud: DataFrame, offset: float = 0.1, seed: int = 0) -> DataFrame:
    """Points moved along their normals by up to ``offset`` either way."""
    k = (uniform(seed, 7, "pid") * 2 - 1) * offset
    return cloud.withColumn("_k", k).withColumns({c: F.col(c) + F.col("_k") * F.col(f"n{c}") for c in "xyz"}).drop("_k")


def noisy(cloud: DataFrame, points: float = 0.01, normals: float = 0.01, flips: float = 0.1, seed: int = 0) -> DataFrame:
    """Gaussian noise on points and (renormalised) normals; of the points in seeded order the first share has its normals flipped."""
    out = cloud.withColumns({c: F.col(c) + points * normal(seed, i, "pid") for i, c in enumerate("xyz")})
    out = out.withColumns({f"n{c}": F.col(f"n{c}") + normals * normal(seed, 3 + i, "pid") for i, c in enumerate("xyz")})
    out = Program(**{f"n{c}": v for c, v in zip("xyz", unit(tuple(col(f"n{c}") for c in "xyz")), strict=True)}).on(out)
    if flips > 0:
        out = out.withColumns({f"n{c}": F.when(uniform(seed, 20, "pid") < flips, -F.col(f"n{c}")).otherwise(F.col(f"n{c}")) for c in "xyz"})
    return out


def uniform_in_box(spark: SparkSession, n: int, low, high, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("qid"), *[(F.lit(a) + uniform(seed, i, "id") * (b - a)).alias(c) for i, (a, b, c) in enumerate(zip(low, high, "xyz", strict=True))])


def fibonacci_sphere(spark: SparkSession, n: int, seed: int | None = None) -> DataFrame:
    """(pid, x, y, z) of n even points; with a seed turned by a random rotation."""
    if seed is not None:
        return rotated(fibonacci_sphere(spark, n), seed)
    return Program(**dict(zip("xyz", mesh.fibonacci(col("CAST(pid AS DOUBLE)"), num(n)), strict=True))).on(spark.range(n).withColumnRenamed("id", "pid"), "pid")


#: Candidates for the farthest point that the driver holds at a time, and points of a task.
CANDIDATES, TASK_POINTS = 1 << 16, 1 << 18


def farthest_points(cloud: DataFrame, n: int, group: str | None = None) -> DataFrame:
    """The cloud's rows of a farthest-point order of n, from the least pid on, with their ``rank``; ties to the lower pid; all rows, by pid, of a cloud of n
    or fewer. Points without a place or id are left out; ids are unique. With ``group`` each group's own order, a group in a task."""
    cloud = cloud.where("pid IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    if group is not None:
        return _farthest_of_groups(cloud, n, group)
    cloud = materialize(cloud, "farthest-cloud")  # it is read again and again
    picked = _farthest(cloud, n)
    ranks = cloud.sparkSession.createDataFrame(list(zip(picked, range(1, len(picked) + 1), strict=True)), "pid bigint, rank int")
    return cloud.join(F.broadcast(ranks), "pid").select(*cloud.columns, "rank")


def _squared_to(p, q):
    d = p - q
    return d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]


def _farthest(cloud: DataFrame, n: int) -> list[int]:
    """Ids in order. Points lie in ranges of cells of space, a task each, with their distance to what is picked. A round brings each task's farthest
    candidates to the driver, and how far its other points are at most. The farthest candidate is the next point as long as no other
    point may be farther; its pick changes candidates at once, and all points in the next round, which a task whose points are
    nearer than all candidates need not take part in with more than its bound."""
    import numpy as np

    spark = cloud.sparkSession
    box = neighbours.bounds(cloud)
    start = cloud.agg(F.min_by(F.struct("pid", "x", "y", "z"), "pid").alias("f")).first().f
    if box.n <= n or n < 1:
        return sorted(r.pid for r in cloud.select("pid").collect()) if n > 0 else []  # n or fewer
    tasks = max(4, min(CANDIDATES // 64, -(-box.n // TASK_POINTS)))
    each = CANDIDATES // tasks
    low = [F.lit(v) for v in (box.min_x, box.min_y, box.min_z)]
    side = F.lit(max(box.max_x - box.min_x, box.max_y - box.min_y, box.max_z - box.min_z) or 1.0)
    kinds = "pid bigint, x double, y double, z double, d double"
    state = cloud.select("pid", *[F.col(c).cast("double") for c in "xyz"], F.lit(float("inf")).alias("d"))
    state = state.repartitionByRange(tasks, neighbours._key(6, low, side), "pid")

    def nearer(new):
        def work(batches):
            for b in batches:
                p, d = np.stack([b.column(c).to_numpy() for c in "xyz"], 1), b.column("d").to_numpy()
                for q in new:
                    d = np.minimum(d, _squared_to(p, q))
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(d)], names=["pid", "x", "y", "z", "d"])

        return work

    def farthest(batches):
        """The task's candidates, farthest first, and one row without an id: a bound on its other points."""
        held, bound = None, -1.0
        for b in batches:
            rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            rows = rows.sort_by([("d", "descending"), ("pid", "ascending")])
            if len(rows) > each:
                bound = max(bound, rows.column("d")[each].as_py())
            held = rows.slice(0, each).combine_chunks()
        if held is not None:
            yield from held.to_batches()
            yield pa.RecordBatch.from_pylist([{"pid": None, "x": 0.0, "y": 0.0, "z": 0.0, "d": bound}], held.schema)

    picked, new = [start.pid], [np.array([start.x, start.y, start.z])]
    while len(picked) < n:
        before, state = state, materialize(state.mapInArrow(nearer(new), kinds), "farthest")
        drop(before)
        got = state.mapInArrow(farthest, kinds).toArrow()
        known = got.column("pid").is_valid().to_numpy()
        bound = got.column("d").to_numpy()[~known].max()
        ids = got.column("pid").filter(pa.array(known)).to_numpy()
        order = np.argsort(ids)
        ids, d = ids[order], got.column("d").to_numpy()[known][order]
        p = np.stack([got.column(c).to_numpy()[known][order] for c in "xyz"], 1)
        new = []
        while len(picked) < n:
            k = int(d.argmax())  # of equals the lowest id
            if new and d[k] <= bound:
                break
            picked.append(int(ids[k]))
            new.append(p[k])
            d = np.minimum(d, _squared_to(p, p[k]))
    drop(state)
    return picked


def _farthest_of_groups(cloud: DataFrame, n: int, group: str) -> DataFrame:
    keep = cloud.withColumn("_g", F.col(group))
    schema = keep.withColumn("rank", F.lit(1)).schema

    def pick(t: pa.Table) -> pa.Table:
        import numpy as np

        t = t.sort_by("pid")
        p = np.stack([t.column(c).to_numpy() for c in "xyz"], 1)
        m = min(n, len(p))
        if len(p) <= n:
            order = np.arange(len(p))
        else:
            order, d = [0], np.full(len(p), np.inf)
            for _ in range(m - 1):
                d = np.minimum(d, _squared_to(p, p[order[-1]]))
                order.append(int(d.argmax()))
        return t.take(pa.array(order)).append_column("rank", pa.array(np.arange(1, m + 1), pa.int32()))

    return keep.groupBy("_g").applyInArrow(pick, schema).drop("_g")


def first_in_order(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``df`` with ``_first``: whether a row is among the first n by a seeded hash of its key, then by the key; exactly n rows are, or all. Keys are unique.

    Rows are counted by the top bits of the hash. Whole bins are in or out, but for the one at the border, a 65,536th of
    the rows, which alone is put in order."""
    mixed = materialize(df.withColumn("_hash", F.xxhash64(F.lit(seed), key)).withColumn("_bin", F.shiftright("_hash", 48)), "seeded-order")
    border, left = None, n
    for b in sorted(mixed.groupBy("_bin").count().collect()):
        if left < b["count"]:
            border = b["_bin"]
            break
        left -= b["count"]
    if border is None:
        return mixed.drop("_hash", "_bin").withColumn("_first", F.lit(True))
    turn = F.row_number().over(Window.orderBy("_hash", key))
    there = mixed.where(F.col("_bin") == border).withColumn("_first", turn <= left)
    rest = mixed.where(F.col("_bin") != border).withColumn("_first", F.col("_bin") < border)
    return rest.unionByName(there).drop("_hash", "_bin")


def split(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """``df`` with ``train``: exactly floor(share * n) rows, the first in seeded order."""
    return first_in_order(df, key, int(share * df.count()), seed).withColumnRenamed("_first", "train")
