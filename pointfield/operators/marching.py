"""Sphere tracing, torus meshes, and the field that training uses."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shapes, torus
from ..functions.expr import PI, Program, add, col, cos, exp, high, mul, over_arrays, sin, sub, vabs, vec
from ..plans.session import materialize
from . import fields, neighbours, tiles
from .fields import Evaluation

TOLERANCE = 1e-4
#: A round of ``field_crossings`` knows so many times the neighbours that one evaluation takes, of at most so many rays at a time.
NEARBY, RAYS = 8, 2_000
#: Of a ray: still under way, marched to its end, stopped where the field is NULL.
LIVE, ENDED, UNDEFINED = 0, 1, 2
RAY = ("ox", "oy", "oz", "dx", "dy", "dz")


def _made(source: str):
    """The function that ``over_arrays`` wrote."""
    space: dict = {}
    exec(source, space)  # noqa: S102  (our own formula)
    return space["f"]


def _march(field, o, d, t, inside, side, found: list, t_max: float, tolerance: float, touches: bool = False, depth: float = 0.0):
    """March rays by |phi|, at least ``tolerance``, until t_max. Where |phi| first falls below the tolerance is a crossing; the ray goes on
    and can cross again once it was beyond the tolerance. A ray that leaves the tolerance on the side it came from, and was on no other in between, has
    only passed by: that is no crossing, unless ``touches`` count. On the other side it was where it went beyond the surface by more than ``depth``, which the tolerance bounds. ``field(rays, points)`` gives phi and whether it is known; a ray stops where it
    is not. Changes t, inside, side (the last sign beyond the tolerance, 0: none, or crossed since) and found, the crossings per ray; gives states."""
    import numpy as np

    state = np.full(len(t), LIVE, np.int32)
    live = np.arange(len(t))
    while True:
        over = t[live] >= t_max
        state[live[over]] = ENDED
        live = live[~over]
        if not len(live):
            return state
        phi, known = field(live, o[live] + t[live, None] * d[live])
        live, phi = live[known], phi[known]
        lost = np.isnan(phi)
        state[live[lost]] = UNDEFINED
        live, phi = live[~lost], phi[~lost]
        sign, phi = np.sign(phi), np.abs(phi)
        near = phi < tolerance
        back = side[live] * sign
        for i in live[near & ~inside[live]]:
            found[i].append(float(t[i]))
        for i in live[~near & inside[live] & (back > 0)] if not touches else ():
            found[i].pop()
        inside[live] = near
        side[live] = np.where(near, np.where((back < 0) & (phi > depth), 0.0, side[live]), sign)
        t[live] += np.maximum(phi, tolerance)


def _columns(batch, names):
    import numpy as np

    return np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in names], 1)


def _state(rays: DataFrame) -> DataFrame:
    return rays.select("rid", *[F.col(c).cast("double").alias(c) for c in RAY], F.lit(0.0).alias("t"), F.lit(False).alias("inside"), F.array().cast("array<double>").alias("found"), F.lit(LIVE).alias("state"), F.lit(0.0).alias("side"))


def _first(ended: DataFrame) -> DataFrame:
    """(rid, t, hit): a ray's first crossing; without one where it ended, and hit is NULL if that was for want of a field."""
    hit = F.when(F.size("found") > 0, True).when(F.col("state") == ENDED, False)
    return ended.select("rid", F.coalesce(F.get("found", F.lit(0)), "t").alias("t"), hit.alias("hit"))


def shape_crossings(rays: DataFrame, name: str, lift: str, amount: float, t_max: float = 6.0, tolerance: float = TOLERANCE, **params) -> DataFrame:
    """(rid, t, found, state) of rays against a lifted shape: all crossings in order, touches within the tolerance among them, marched to t_max however
    many steps that takes."""
    source = over_arrays({"revolved": shapes.revolved, "extruded": shapes.extruded}[lift](name, vec(""), amount, **params))
    rows = _state(rays)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        phi = _made(source)
        for b in batches:
            at, t = _columns(b, RAY), np.zeros(b.num_rows)
            known = lambda live, p: (np.broadcast_to(phi(dict(zip("xyz", p.T, strict=True))), len(p)), np.full(len(p), True))
            found: list = [[] for _ in t]
            state = _march(known, at[:, :3], at[:, 3:], t, np.zeros(len(t), bool), np.zeros(len(t)), found, t_max, tolerance, touches=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t), pa.array(found, pa.list_(pa.float64())), pa.array(state)], names=["rid", "t", "found", "state"])

    return rows.mapInArrow(work, f"rid {rows.schema['rid'].dataType.simpleString()}, t double, found array<double>, state int")


def trace_shape(rays: DataFrame, name: str, lift: str, amount: float, t_max: float = 6.0, tolerance: float = TOLERANCE, **params) -> DataFrame:
    """(rid, t, hit) of rays against a lifted shape."""
    return _first(shape_crossings(rays, name, lift, amount, t_max, tolerance, **params))


def _near_step(live: DataFrame, cloud: neighbours.Tree, how: Evaluation, t_max: float, tolerance: float, depth: float) -> DataFrame:
    """March each ray as far as the nearest NEARBY * k points of its place tell the field: a place is known where its k-th nearest of
    them is nearer than any other point can be. That holds where the round begins, so each round makes a step at least."""
    held = ("px", "py", "pz", *torus.columns(), "outlier", *(["area"] if how.use_areas else []))
    here = live.select(F.col("rid").alias("qid"), *[F.expr(f"o{c} + t * d{c}").alias(c) for c in "xyz"])
    near = neighbours.knn(here, cloud, min(cloud.n, NEARBY * how.k))
    near = near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pid", *[F.col(c).cast("double").alias(c) for c in held]))).alias("near"))
    rows = live.join(near.withColumnRenamed("qid", "rid"), "rid", "left")
    source, whole, n = over_arrays(torus.distance(vec(""), torus.columns())), cloud.n <= NEARBY * how.k, min(cloud.n, NEARBY * how.k)
    k, isovalue, sharp, areas = min(how.k, cloud.n), how.isovalue, fields.SHARP * how.lambda_scale, how.use_areas

    def work(batches):
        import numpy as np
        import pyarrow as pa

        g = _made(source)
        for large in batches:
            for b in (large.slice(i, RAYS) for i in range(0, large.num_rows, RAYS)):
                at, t = _columns(b, RAY), _columns(b, ["t"])[:, 0]
                o, d = at[:, :3], at[:, 3:]
                inside = b.column(8).to_numpy(zero_copy_only=False).astype(bool)
                side, found = b.column(11).to_numpy(zero_copy_only=False).astype(float), b.column(9).to_pylist()
                column = b.column(12)
                has = column.is_valid().to_numpy(zero_copy_only=False)
                parts = column.flatten()
                c = {x: np.full((len(t), n), np.nan) for x in held}
                for x in held:
                    c[x][has] = parts.field(x).to_numpy(zero_copy_only=False).reshape(-1, n)
                cloud_at, start = np.stack([c.pop(x) for x in ("px", "py", "pz")], 2), o + t[:, None] * d
                began = t.copy()

                def spread(live, p):
                    r = p[:, None] - cloud_at[live]
                    return np.sqrt(r[..., 0] * r[..., 0] + r[..., 1] * r[..., 1] + r[..., 2] * r[..., 2])

                reach = spread(np.arange(len(t)), start).max(1)

                def phi(live, p):
                    dist = spread(live, p)
                    order = np.argsort(dist, axis=1, kind="stable")[:, :k]  # ties by pid, the order of the candidates
                    dist = np.take_along_axis(dist, order, 1)
                    moved = np.sqrt(((p - start[live]) ** 2).sum(1))
                    known = whole | (t[live] == began[live]) | ~has[live] | (dist[:, -1] + moved < reach[live] * (1 - 1e-9))
                    here = {x: np.take_along_axis(v[live], order, 1) for x, v in c.items()} | dict(zip("xyz", p.T[:, :, None], strict=True))
                    with np.errstate(all="ignore"):
                        shift = dist[:, -1:] * 0.5
                        w = np.exp(-(sharp / np.where(shift == 0, np.nan, shift)) * (dist - shift)) * (here["area"] if areas else 1.0)
                        w = np.where(here["outlier"] == 1, 0.0, w)
                        return (w * g(here)).sum(1) / w.sum(1) - isovalue, known

                state = _march(phi, o, d, t, inside, side, found, t_max, tolerance, depth=depth)
                yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(t), pa.array(inside), pa.array(found, pa.list_(pa.float64())), pa.array(state), pa.array(side)], names=b.schema.names[:12])

    return rows.mapInArrow(work, live.schema)


def _one_step(live: DataFrame, cloud: DataFrame, how: Evaluation, t_max: float, tolerance: float, depth: float) -> DataFrame:
    """One step of each ray under any evaluation."""
    here = live.select(F.col("rid").alias("qid"), *[F.expr(f"o{c} + t * d{c}").alias(c) for c in "xyz"])
    phi = fields.evaluate(here, cloud, how).select(F.col("qid").alias("rid"), F.col("distance").alias("phi"))
    now = live.join(phi, "rid", "left").withColumn("phi", F.expr("CASE WHEN NOT isnan(phi) THEN phi END"))
    near, step = F.coalesce(F.abs("phi") < tolerance, F.lit(False)), F.col("t") + F.greatest(F.abs("phi"), F.lit(tolerance))
    back = F.col("side") * F.signum("phi")
    found = F.when(near & ~F.col("inside"), F.concat("found", F.array("t"))).when(~near & F.col("inside") & (back > 0), F.slice("found", 1, F.size("found") - 1)).otherwise(F.col("found"))
    side = F.when(~near, F.coalesce(F.signum("phi"), F.col("side"))).when((back < 0) & (F.abs("phi") > depth), 0.0).otherwise(F.col("side"))
    state = F.when(F.col("phi").isNull(), UNDEFINED).when(step >= t_max, ENDED).otherwise(LIVE)
    return now.select("rid", *RAY, F.when(F.col("phi").isNull(), F.col("t")).otherwise(step).alias("t"), near.alias("inside"), found.alias("found"), state.alias("state"), side.alias("side"))


def field_crossings(rays: DataFrame, cloud: DataFrame, how: Evaluation, t_max: float = 6.0, tolerance: float = TOLERANCE, depth: float = 0.0) -> DataFrame:
    """(rid, t, found, state) of rays against a torus field: all crossings in order; to pass by within the tolerance is none, nor is to graze the surface no
    deeper than ``depth``, at most the tolerance. Rounds go on until no ray is under way; each moves on
    all that are, by many steps at a time where the field is one of nearest points."""
    live = materialize(_state(rays), "trace")
    cloud = materialize(fields.finite(cloud), "tori")
    step = _one_step
    if how.k > 0 >= how.radius:
        cloud, step = neighbours.tree(cloud), _near_step
        if not cloud.n:
            return live.select("rid", "t", "found", F.lit(UNDEFINED).alias("state"))
    done = live.limit(0)
    while not live.isEmpty():
        now = materialize(step(live, cloud, how, t_max, tolerance, depth), "trace")
        done, live = done.union(now.where(F.col("state") != LIVE)), now.where(F.col("state") == LIVE)
    return done.select("rid", "t", "found", "state")


def trace_field(rays: DataFrame, cloud: DataFrame, how: Evaluation, t_max: float = 6.0, tolerance: float = TOLERANCE, depth: float = 0.0) -> DataFrame:
    """(rid, t, hit) of rays against a torus field."""
    return _first(field_crossings(rays, cloud, how, t_max, tolerance, depth))


def _torus_grid(tori: DataFrame) -> DataFrame:
    """A row (.., nu, nv, iu, iv) for each corner of each torus's grid of quads. A few tori make many rows, so they are dealt to all tasks first: a table
    of tori is too small to be read by many."""
    count = lambda r: f"CAST(greatest(16, least(128, floor(abs({r}) / 0.1e0))) AS INT)"
    tori = tori.repartition(tiles._tasks(tori, 1 << 30), "pid")
    rows = tori.where("abs(minor_r) >= 1e-10 AND abs(major_r) >= 1e-10").selectExpr("*", f"{count('major_r')} AS nu", f"{count('minor_r')} AS nv")
    return rows.selectExpr("*", "explode(sequence(0, nu - 1)) AS iu").selectExpr("*", "explode(sequence(0, nv - 1)) AS iv")


def torus_vertices(tori: DataFrame) -> DataFrame:
    """(pid, vid, x, y, z) of each torus as a grid of quads: 16 to 128 steps around either circle, by radius. Tori with a radius of nearly
    nothing have none."""
    t = torus.columns()
    axis = torus.from_spherical(t["theta"], t["phi"])
    e1, e2 = torus.basis(axis)
    u, v = 2 * PI * col("CAST(iu AS DOUBLE)") / col("CAST(nu AS DOUBLE)"), 2 * PI * col("CAST(iv AS DOUBLE)") / col("CAST(nv AS DOUBLE)")
    r = torus.vabs(t["minor_r"])
    ring = t["major_r"] + r * cos(v)
    p = add(add((t["cx"], t["cy"], t["cz"]), mul(add(mul(e1, cos(u)), mul(e2, sin(u))), ring)), mul(axis, r * sin(v)))
    return Program(**dict(zip("xyz", p, strict=True))).on(_torus_grid(tori).selectExpr("*", "iu * nv + iv AS vid"), "pid", "vid")


def torus_faces(tori: DataFrame) -> DataFrame:
    """(pid, fid, v0, v1, v2, v3): the quads of ``torus_vertices``, one a vertex, with the next vertices around both circles; their outer sides are
    those away from the tube's core where the major radius is the larger."""
    at = lambda i, j: f"(iu + {i}) % nu * nv + (iv + {j}) % nv"
    return _torus_grid(tori).selectExpr("pid", "iu * nv + iv AS fid", *[f"{at(i, j)} AS v{k}" for k, (i, j) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])


#: What keeps denominators off zero.
LEAST = 1e-10


def training_terms(gradient: bool = False) -> dict:
    """Per-pair terms of the training field; lam and shift are the query's."""
    q, t = vec(""), torus.columns()
    w, g = exp(-fields.LAM * (fields.D - fields.SHIFT)), torus.distance(vec(""), t)
    out = {"w": w, "wg": w * g}
    if gradient:
        hat = mul(sub(q, vec("p")), 1 / high(fields.D, LEAST))
        inner = sub(torus.gradient(q, t), mul(hat, fields.LAM * g))
        out |= {f"wa{c}": w * v for c, v in zip("xyz", inner, strict=True)} | {f"wr{c}": w * v for c, v in zip("xyz", hat, strict=True)}
    return out


def training_results(gradient: bool = False) -> dict:
    """Per-query outputs from the sums s_*."""
    n = high(col("s_w"), LEAST)
    phi = col("s_wg") / n
    out = {"distance": phi}
    if gradient:
        out |= {f"g{c}": col(f"s_wa{c}") / n + phi * fields.LAM * col(f"s_wr{c}") / n for c in "xyz"}
    return out


#: How far a training field may be from its sums over all points, at most; what isn't proven to be that near is summed in full.
CLOSE = 1e-9


def _tails(lists: DataFrame, index: tiles.Tiles) -> DataFrame:
    """``lists`` (x, y, z, lam, shift, last ..) with bounds on what points no nearer than ``last`` add to the sums of w and of w |g|: ``tail``, ``tail_g``.
    A tile's points weigh no more than one at its box's nearest place, and a torus's distance changes by no more than the way from its
    own point."""
    at = Program(g=vabs(torus.distance(vec(""), torus.columns()))).on(index.points, "_tile")
    held = np.zeros((len(index.boxes), 2))
    for r in at.groupBy("_tile").agg(F.count("*"), F.max("g")).collect():
        held[r[0]] = r[1], math.inf if r[2] is None else r[2]
    boxes, near_and_far, step = index.boxes, (tiles._near, tiles._far), max(1, tiles.NUMBERS // len(index.boxes))

    @F.pandas_udf("struct<w:double,g:double>")
    def tail(x, y, z, lam, shift, last):
        import pandas as pd

        p, out = np.stack([x, y, z], 1).astype(float), np.zeros((len(x), 2))
        lam, shift, last = (c.to_numpy(float)[:, None] for c in (lam, shift, last))
        for i in (slice(s, s + step) for s in range(0, len(p), step)):
            near, far = (np.sqrt(f(p[i], boxes[:, :3], boxes[:, 3:])) for f in near_and_far)
            w = np.exp(-lam[i] * (np.maximum(near, last[i]) * (1 - 1e-9) - shift[i])) * held[:, 0]
            out[i] = np.stack([w.sum(1), (w * (held[:, 1] + far)).sum(1)], 1)
        return pd.DataFrame(out, columns=["w", "g"])

    found = lists.withColumn("_tail", tail(*[F.col(c).cast("double") for c in (*"xyz", "lam", "shift", "last")]))
    return found.withColumns({"tail": F.col("_tail.w"), "tail_g": F.col("_tail.g")}).drop("_tail", "last")


def _error(gradient: bool):
    """How much the sums that are left out may change any of ``training_results``."""
    n, tail, tail_g = high(col("s_w"), LEAST), col("tail"), col("tail_g")
    phi = vabs(col("s_wg")) / n
    out = distance = (tail_g + phi * tail) / n
    if gradient:
        slope = vabs(col("s_wax")) + vabs(col("s_way")) + vabs(col("s_waz"))
        out = distance + (tail + fields.LAM * tail_g + slope / n * tail) / n + fields.LAM * (distance + phi * 2 * tail / n)
    return out * 2  # products of two errors


def training_field(queries: DataFrame, cloud: DataFrame, k: int = 64, gradient: bool = False) -> DataFrame:
    """(qid, distance[, gx, gy, gz]) as training blends it: the shift from the k nearest points, the sums over all; denominators kept off zero,
    and lambda and shift held fixed in the gradient.

    Beyond the k nearest a weight is below exp(-64), so a query sums half as many more and bounds all others, tile by tile; one that may be
    farther than CLOSE from the sums over all meets every point.

    Where the cloud has a column ``mask``, points without it set are padding: neither near nor summed, as are those whose torus isn't finite. Without
    any point, or for a query without a place, there is no row. A query on a torus's axis has no slope from that torus.
    """
    sound = fields.finite(cloud.where("mask") if "mask" in cloud.columns else cloud).select("pid", *"xyz", *torus.columns())
    index = tiles.index(sound)
    lists = neighbours.nearest_lists(queries.select("qid", *"xyz"), index, k + k // 2)
    shift = F.element_at("near", F.least(F.lit(k), F.size("near")))["d"] * 0.5
    lists = lists.withColumn("shift", shift).withColumn("lam", F.lit(fields.SHARP) / F.greatest("shift", F.lit(LEAST)))
    terms, results = training_terms(gradient), training_results(gradient)
    if index.n <= k + k // 2:
        return fields.summed(neighbours.looked_up(lists, index), terms, results)
    lists = materialize(_tails(lists.withColumn("last", F.element_at("near", -1)["d"]), index), "training")
    got = fields.summed(neighbours.looked_up(lists, index), terms, results | {"error": _error(gradient)}, keep=("qid", "lam", "shift", "tail", "tail_g"))
    got = materialize(got, "training")
    sure = F.coalesce((F.col("error") <= CLOSE) & ~F.isnan("error"), F.lit(False))
    near = got.where(sure).drop("error")
    left = got.where(~sure).select("qid")
    if left.isEmpty():
        return near
    asked = materialize(lists.drop("near", "tail", "tail_g").join(left, "qid", "left_semi"), "training")
    return near.unionByName(fields.summed(neighbours.all_pairs(asked, index.points.drop("_tile", "_row"), index.n), terms, results))
