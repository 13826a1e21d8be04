"""Winding fields without meeting every source: distant cells stand for their sources.

The sources, points with areas and normals or triangles, are summarised in the cells of a tree by additive moments. A query descends
level by level in an equi-join on the parent cell. A cell far enough away gives its expansion about the centre c of its areas,

    sum_i a_i n_i . g(x - y_i)  ~  D . g(x) - Q : J(x),     g(v) = v / |v|^3,  J its derivative,  x = q - c,  y_i = p_i - c,

with D = sum a n and Q = sum a n y^T; others are opened, the finest ones into their sources. Derivatives of 1 / |v| of order m have norms of
at most m! / |v|^(m+1), so what a cell leaves out is at most 3 S / (r - R)^4, where S = sum a |y|^2, R is the distance from c to the farthest
corner of its box, and r = |x|. These bounds are added up along with the field: every result carries a proven bound on its
error. Queries whose bound doesn't do descend again with a stricter criterion, in the end to the sources themselves.

Rows that are done pass through the joins of later levels unmatched; levels that are broadcast need no shuffle.

The smoothed kernel is k(|v| / e) g(v); over ``Tiled`` sources its expansion is about the same centre, and the bound takes the greatest norm that its second derivatives have
from the cell's nearest place on, so cells need not lie beyond its smoothing.

Clouds and triangles that are ``tiled`` go another way, for many queries: a query meets the moments of all tiles where it is read, and only the tiles that are near it by a shuffle; within a
tile, a task tells far leaves from near ones over arrays. What is shuffled and written are points, queries and a row per query and near tile,
never the cells that were met.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mesh
from ..functions.expr import Dual, Program, add, col, cross, dot, high, mul, norm, num, over_arrays, sub, vabs, vec
from ..plans.session import materialize
from . import fields, neighbours, tiles
from .neighbours import BOX, BROADCAST_CELLS, Tree
from .tiles import LEAF, NUMBERS, _leaves, _matrix

#: A cell is far if it lies beyond so many of its radii; a stricter round doubles it.
OPENING = 3.0
#: The last round but that of all sources.
STRICTEST = 50.0
AXES = "xyz"
CORNERS, NORMALS = tuple(x.form for corner in mesh.corners() for x in corner), tuple(f"w_d{c}" for c in AXES)
MOMENTS = ("w_a", "w_s", *(f"w_p{c}" for c in AXES), *(f"w_d{c}" for c in AXES), *(f"w_q{a}{b}" for a in AXES for b in AXES))


def _moments(rows: DataFrame) -> Tree:
    """The tree of rows (x, y, z, lx .. hz, w_a, w_own, w_dx, w_dy, w_dz): places, boxes, areas, second moments about the own place, and areas
    times normals."""
    box = neighbours.bounds(rows)
    middle = [num((getattr(box, f"min_{c}") + getattr(box, f"max_{c}")) / 2 if box.n else 0.0) for c in AXES]  # smaller numbers, finer sums
    at = sub(vec(""), middle)
    first = {"w_s": col("w_own") + col("w_a") * dot(at, at)} | {f"w_p{c}": col("w_a") * v for c, v in zip(AXES, at, strict=True)}
    first |= {f"w_q{a}{b}": col(f"w_d{a}") * v for a in AXES for b, v in zip(AXES, at, strict=True)}
    return replace(neighbours.tree(Program(**first).on(rows), extents=True, sums=MOMENTS), middle=tuple(middle))


def of_points(cloud: DataFrame) -> Tree:
    """A searchable tree of (pid, x, y, z, nx, ny, nz, area). Points without a place, normal or area, or with area 0, are no sources."""
    whole = cloud.where(" AND ".join(f"{c} IS NOT NULL" for c in ("x", "y", "z", "nx", "ny", "nz", "area")) + " AND area <> 0e0")
    own = {f"{n}{c}": col(c) for n in "lh" for c in AXES} | {"w_a": vabs(col("area")) * norm(vec("n")), "w_own": num(0)} | {f"w_d{c}": col("area") * col(f"n{c}") for c in AXES}
    return _moments(Program(**own).on(whole))


#: Epsilons beyond which the smoothed kernel is the plain one to the last bit, and within which its cells are never far; step of the table of bounds.
SMOOTH, CLOSE, STEP = 6.5, 0.1, 1e-3


@dataclass(frozen=True)
class Soft:
    """The smoothed kernel: Python sources of k and of its slope over arrays ``t``, and, for an epsilon of 1, the greatest norms of the third derivatives of its potential
    at CLOSE / 5 + i STEP or beyond."""

    epsilon: float
    factor: str
    slope: str
    steep: np.ndarray

    def factors(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """k and t k'."""
        factor: dict = {}
        slope: dict = {}
        exec(self.factor, factor), exec(self.slope, slope)  # noqa: S102  (our own formulas)
        return factor["f"]({"t": t}), t * slope["f"]({"t": t})

    def third(self, gap: np.ndarray) -> np.ndarray:
        t = gap / self.epsilon
        i = np.clip((t - CLOSE / 5) / STEP - 1, 0, len(self.steep) - 1).astype(np.int64)
        return np.where(t >= SMOOTH, 6 / (gap * gap * gap * gap), self.steep[i] / self.epsilon**4)


def smoothed(epsilon: float) -> Soft:
    k = fields.smoothing(Dual(col("t"), (num(1),)))
    factor, slope, space = over_arrays(k.v), over_arrays(k.d[0]), {}
    exec(factor, space)  # noqa: S102  (our own formula)
    t = np.arange(CLOSE / 5, SMOOTH + 2 * STEP, STEP)
    h = space["f"]({"t": t}) / t**3
    h1 = np.gradient(h, STEP, edge_order=2)
    h2 = np.gradient(h1, STEP, edge_order=2)
    norms = np.full(len(t), 6 / SMOOTH**4)
    for c in np.linspace(0, 1, 101):  # along a direction at this cosine to the way to the query
        norms = np.maximum(norms, np.abs((2 * h1 + h2 * t) * c**3 + 3 * h1 * c * (1 - c * c)))
    return Soft(epsilon, factor, slope, 1.02 * np.maximum.accumulate(norms[::-1])[::-1])  # a little more, for what lies between the steps


@dataclass(frozen=True)
class Cells:
    """Centres of areas (cells, 3), their distances to the farthest corner, areas, second moments about the centre, and areas times normals, alone (cells, 3) and times
    places about the centre (cells, 3, 3)."""

    centre: np.ndarray
    big: np.ndarray
    area: np.ndarray
    spread: np.ndarray
    d: np.ndarray
    q: np.ndarray

    @staticmethod
    def of(sums: np.ndarray, low: np.ndarray, high: np.ndarray, middle: np.ndarray) -> Cells:
        """``sums``: a row of MOMENTS about ``middle`` for each cell."""
        a, s, p, d, q = sums[:, 0], sums[:, 1], sums[:, 2:5], sums[:, 5:8], sums[:, 8:].reshape(-1, 3, 3)
        with np.errstate(all="ignore"):
            shift = p / a[:, None]
            spread = np.maximum(s - a * (shift * shift).sum(1), 0) + 1e-14 * s
        centre = middle + shift
        big = np.linalg.norm(np.maximum(np.abs(low - centre), np.abs(high - centre)), axis=1)
        return Cells(centre, big, a, spread, d, q - d[:, :, None] * shift[:, None, :])

    def met(self, p: np.ndarray, opening: float, soft: Soft | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, cells) whether a cell is near, and for each query the terms and bounds of the others added up."""
        with np.errstate(all="ignore"):
            x, y, z = (p[:, None, i] - self.centre[None, :, i] for i in range(3))
            square = x * x + y * y + z * z
            r = np.sqrt(square)
            gap = r - self.big
            far = (r > opening * self.big) & (r > (CLOSE * soft.epsilon if soft else 0.0)) | (self.area <= 0)
            d, q = self.d, self.q
            turned = x * (q[:, 0, 0] * x + (q[:, 0, 1] + q[:, 1, 0]) * y) + y * (q[:, 1, 1] * y + (q[:, 1, 2] + q[:, 2, 1]) * z) + z * (q[:, 2, 2] * z + (q[:, 0, 2] + q[:, 2, 0]) * x)
            first, turned = d[:, 0] * x + d[:, 1] * y + d[:, 2] * z - np.trace(q, axis1=1, axis2=2), turned / square
            term = (first + 3 * turned) / (square * r)
            if soft:
                here = far & (r < SMOOTH * soft.epsilon)
                k, more = soft.factors(r[here] / soft.epsilon)
                term[here] = (k * first[here] + (3 * k - more) * turned[here]) / (square[here] * r[here])
                bound = self.spread * soft.third(gap) / 2
            else:
                gap *= gap
                bound = 3 * self.spread / (gap * gap)
        some = far & (self.area > 0)
        return ~far, np.where(some, term, 0.0).sum(1), np.where(some, bound, 0.0).sum(1)


@dataclass(frozen=True)
class Tiled:
    """The tiles of a cloud or, with extents, of triangles, and their moments."""

    tiles: tiles.Tiles
    cells: Cells | None

    @property
    def n(self) -> int:
        return self.tiles.n


def _sums(a: np.ndarray, d: np.ndarray, at: np.ndarray, own: np.ndarray | float = 0.0) -> np.ndarray:
    """MOMENTS of sources, one row each."""
    q = d[:, :, None] * at[:, None, :]
    return np.concatenate([a[:, None], (own + a * (at * at).sum(1))[:, None], a[:, None] * at, d, q.reshape(-1, 9)], axis=1)


def tiled(cloud: DataFrame) -> Tiled:
    """(pid, x, y, z, nx, ny, nz, area) dealt into tiles, for many queries at once. Sources are those of ``of_points``. One row per tile comes to the driver."""
    whole = cloud.where(" AND ".join(f"{c} IS NOT NULL" for c in ("x", "y", "z", "nx", "ny", "nz", "area")) + " AND area <> 0e0")
    index = tiles.index(whole.select("pid", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "nx", "ny", "nz", "area")]))
    own = {"w_own": num(0), "w_a": vabs(col("area")) * norm(vec("n"))} | {f"w_d{c}": col("area") * col(f"n{c}") for c in AXES}
    return _of_tiles(index, own)


def tiled_triangles(tri: DataFrame) -> Tiled:
    """(fid, ax .. cz) dealt into tiles, for many queries at once; as ``tiled``. Sources are those of ``of_triangles``."""
    rows = rows_of_triangles(tri).select("fid", *AXES, *BOX, *CORNERS, "w_own", "w_a", *NORMALS)
    return _of_tiles(tiles.index(rows, extents=True), {c: col(c) for c in ("w_own", "w_a", *NORMALS)})


def _of_tiles(index: tiles.Tiles, own: dict) -> Tiled:
    """``own``: each source's area, second moment about its own place, and area times normal."""
    if not index.n:
        return Tiled(index, None)
    middle = (index.boxes[:, :3].min(0) + index.boxes[:, 3:].max(0)) / 2
    at = [col(c) - num(float(m)) for c, m in zip(AXES, middle, strict=True)]
    own = own | {"w_s": own["w_own"] + own["w_a"] * dot(at, at)} | {f"w_p{c}": own["w_a"] * v for c, v in zip(AXES, at, strict=True)}
    own |= {f"w_q{a}{b}": own[f"w_d{a}"] * v for a in AXES for b, v in zip(AXES, at, strict=True)}
    own.pop("w_own")
    found = Program(**own).on(index.points, "_tile").groupBy("_tile").agg(*[F.sum(c).alias(c) for c in MOMENTS]).collect()
    sums = np.zeros((len(index.boxes), len(MOMENTS)))
    for r in found:
        sums[r[0]] = r[1:]
    return Tiled(index, Cells.of(sums, index.boxes[:, :3], index.boxes[:, 3:], middle))


def _by_tiles(queries: DataFrame, index: Tiled, kernel: str, opening: float, epsilon: float) -> DataFrame:
    """As ``_descend``."""
    scale, near, _ = _kernels(epsilon)[kernel]
    source, cells, soft = over_arrays(near), index.cells, smoothed(epsilon) if kernel == "regularised_winding" else None
    flat = index.tiles.extents
    held = (*AXES, *BOX, "w_a", "w_own", *NORMALS, *CORNERS) if flat else (*AXES, "nx", "ny", "nz", "area")
    kind = queries.schema["qid"].dataType.simpleString()

    def start(batches):
        step = max(1, NUMBERS // len(cells.area))
        for b in batches:
            p = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2, 3)], 1)
            for s in range(0, len(p), step):
                open_, term, bound = cells.met(p[s : s + step], opening, soft)
                ends = np.concatenate([[0], np.cumsum(open_.sum(1))]).astype(np.int32)
                more = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(open_)[1]))
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(s, step) for i in range(4)), pa.array(term * scale), pa.array(bound * abs(scale)), more], names=["qid", *AXES, "_sum", "_bound", "_more"])

    def go_on(asked: pa.Table, points: pa.Table) -> pa.Table:
        q, p = _matrix(asked, AXES), _matrix(points, AXES)
        c, space = {c: points.column(c).to_numpy() for c in held[3:]}, {}
        exec(source, space)  # noqa: S102  (our own formula)
        leaves, low, high = _leaves(*(_matrix(points, side) for side in (BOX[:3], BOX[3:]))) if flat else _leaves(p, p)
        middle = (low.min(0) + high.max(0)) / 2
        if flat:
            a, d, own = c["w_a"], _matrix(points, NORMALS), c["w_own"]
        else:
            n = _matrix(points, ("nx", "ny", "nz"))
            a, d, own = np.abs(c["area"]) * np.linalg.norm(n, axis=1), c["area"][:, None] * n, 0.0
        rows = np.concatenate([_sums(a, d, p - middle, own), np.zeros((1, len(MOMENTS)))])
        inner = Cells.of(rows[leaves].sum(1), low, high, middle)
        total, left = np.zeros(len(q)), np.zeros(len(q))
        step = max(1, NUMBERS // len(leaves))
        for s in range(0, len(q), step):
            open_, term, bound = inner.met(q[s : s + step], opening, soft)
            total[s : s + step], left[s : s + step] = term * scale, bound * abs(scale)
            who, leaf = np.nonzero(open_)
            for t in range(0, len(who), NUMBERS // LEAF):
                a, o = np.repeat(s + who[t : t + NUMBERS // LEAF], LEAF), leaves[leaf[t : t + NUMBERS // LEAF]].ravel()
                a, o = a[o >= 0], o[o >= 0]
                v = q[a] - p[o]
                far = np.sqrt((v * v).sum(1))
                columns = dict(zip((*AXES, "px", "py", "pz"), (*q[a].T, *p[o].T), strict=True)) | {k: c[k][o] for k in (CORNERS if flat else held[3:])} | {"d": far}
                with np.errstate(all="ignore"):
                    got = space["f"](columns) if flat else np.where(far == 0, 0.0, space["f"](columns))
                total += np.bincount(a, got, len(q))
        return pa.table([asked.column("_q"), pa.array(total), pa.array(left)], names=["qid", "_sum", "_bound"])

    asked = queries.select("qid", *[F.col(c).cast("double").alias(c) for c in AXES])
    asked = asked.repartition(4 * max(asked.sparkSession.sparkContext.defaultParallelism, int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    begun = materialize(asked.mapInArrow(start, f"qid {kind}, x double, y double, z double, _sum double, _bound double, _more array<bigint>"), "far-tiles")
    near_ = begun.select(F.col("qid").alias("_q"), *AXES, F.explode("_more").alias("_tile"))
    points = index.tiles.points.select("_tile", *held)
    met = tiles.met(near_, points, go_on, f"qid {kind}, _sum double, _bound double")
    rows = begun.select("qid", "_sum", "_bound").unionByName(met)
    return rows.groupBy("qid").agg(F.sum("_sum").alias("field"), F.sum("_bound").alias("bound"))


def rows_of_triangles(tri: DataFrame) -> DataFrame:
    """Triangles (fid, ax .. cz) with their centroids, boxes, areas and moments. Those without all corners are none; those without area have
    no moments."""
    a, b, c = mesh.corners()
    whole = tri.where(" AND ".join(f"{n} IS NOT NULL" for corner in (a, b, c) for n in (x.form for x in corner)))
    n = mul(cross(sub(b, a), sub(c, a)), 0.5)
    g = mul(add(add(a, b), c), 1 / 3)
    own = dict(zip(AXES, g, strict=True)) | {"w_own": norm(n) / 12 * sum((dot(sub(k, g), sub(k, g)) for k in (a, b, c)), num(0))}
    for k, f in zip(AXES, zip(a, b, c, strict=True), strict=True):
        own |= {f"l{k}": -high(high(-f[0], -f[1]), -f[2]), f"h{k}": high(high(f[0], f[1]), f[2])}
    own |= {"w_a": norm(n)} | dict(zip([f"w_d{k}" for k in AXES], n, strict=True))
    return Program(**own).on(whole)


def of_triangles(tri: DataFrame) -> Tree:
    """A searchable tree of (fid, ax .. cz)."""
    return _moments(rows_of_triangles(tri))


def _expansion(middle) -> dict:
    """Of a query and a cell: w_r, w_big, w_term, w_bound."""
    area = col("w_a")
    shift = tuple(col(f"w_p{c}") / area for c in AXES)
    x = sub(sub(vec(""), middle), shift)
    r = norm(x)
    # About c; rounding is allowed for.
    spread = high(col("w_s") - area * dot(shift, shift), 0) + 1e-14 * col("w_s")
    far = [high(vabs(col(f"l{c}") - m - s), vabs(col(f"h{c}") - m - s)) for c, m, s in zip(AXES, middle, shift, strict=True)]
    big = norm(far)
    d = tuple(col(f"w_d{c}") for c in AXES)
    q = [[col(f"w_q{a}{b}") - d[i] * shift[j] for j, b in enumerate(AXES)] for i, a in enumerate(AXES)]
    cube = r * r * r
    turned = dot(x, tuple(dot(row, x) for row in q))
    term = (dot(d, x) - (q[0][0] + q[1][1] + q[2][2])) / cube + 3 * turned / (cube * r * r)
    gap = r - big
    return {"w_r": r, "w_big": big, "w_term": term, "w_bound": 3 * spread / (gap * gap * gap * gap)}


#: name: (what a sum of a n . g(q - p) is multiplied by, exact terms per pair, how far from its sources a cell must be at least).
def _kernels(epsilon: float) -> dict:
    return {
        "winding": (1 / (4 * math.pi), fields.winding()[0]["a"], 0.0),
        "regularised_winding": (-1 / (4 * math.pi), fields.regularised_winding(epsilon)[0]["a"], SMOOTH * epsilon),
        "solid_angle": (-1.0, mesh.solid_angle(vec(""), *mesh.corners()), 0.0),
    }


def _folded(found: DataFrame) -> DataFrame:
    """What is done of a query added up to one row, combined before the shuffle; written, as it is read twice."""
    return materialize(found.groupBy("qid", *AXES, "_up").agg(F.sum("_sum").alias("_sum"), F.sum("_bound").alias("_bound")), "far-cells")


def _descend(queries: DataFrame, index: Tree, kernel: str, opening: float, epsilon: float) -> DataFrame:
    """(qid, field, bound) of each query, by cells that lie beyond ``opening`` radii and the sources of the others."""
    scale, near, reach = _kernels(epsilon)[kernel]
    kept = ["qid", "x", "y", "z", "_up", "_sum", "_bound"]
    nothing = F.lit(0.0)
    found = queries.select("qid", *AXES).withColumns({"_up": F.lit(0).cast("long"), "_sum": nothing, "_bound": nothing})
    program = Program(**_expansion(index.middle))
    done = []
    for cells, n in index.levels if opening < math.inf else [(index.levels[-1][0].withColumn("up", F.lit(0).cast("long")), index.levels[-1][1])]:
        if n > BROADCAST_CELLS:  # a shuffle would send all rows that are done, which have no key, to one task
            found = _folded(found)
            done.append(found.where("_up IS NULL").select("qid", "_sum", "_bound"))
            found = found.where("_up IS NOT NULL")
        cells = cells.select(F.col("up").alias("_up"), "cell", *BOX, *MOMENTS)
        met = program.on(found.join(F.broadcast(cells) if n <= BROADCAST_CELLS else cells, "_up", "left"), *kept, "cell", "w_a")
        far = (F.col("w_r") > opening * F.col("w_big")) & (F.col("w_r") - F.col("w_big") > reach) | (F.col("w_a") <= 0)
        here = F.coalesce(far, F.lit(False)) & F.col("cell").isNotNull()
        found = met.select(
            "qid",
            *AXES,
            F.when(~here, F.col("cell")).alias("_up"),
            F.when(here & (F.col("w_a") > 0), F.col("w_term") * scale).otherwise(F.col("_sum")).alias("_sum"),
            F.when(here & (F.col("w_a") > 0), F.col("w_bound") * abs(scale)).otherwise(F.col("_bound")).alias("_bound"),
        )
    found = _folded(found)
    done.append(found.where("_up IS NULL").select("qid", "_sum", "_bound"))
    points = index.points.drop(*MOMENTS, "w_own", *BOX).withColumnsRenamed({c: f"p{c}" for c in AXES}).withColumnRenamed("cell", "_up")
    pairs = found.where("_up IS NOT NULL").select("qid", *AXES, "_up").join(points, "_up")
    pairs = pairs.withColumn("d", F.sqrt(sum((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in AXES)))
    rows = Program(_sum=near).on(pairs, "qid").withColumn("_bound", nothing)
    for part in done:
        rows = rows.unionByName(part)
    return rows.groupBy("qid").agg(F.sum("_sum").alias("field"), F.sum("_bound").alias("bound"))


def winding(queries: DataFrame, index: Tree | Tiled, kernel: str = "winding", tolerance: float | None = 1e-2, level: float | None = None, epsilon: float = 0.1, opening: float = OPENING) -> DataFrame:
    """(qid, field, bound) of each query (qid, x, y, z): the winding field of the tree's sources and a proven bound on how far it may be
    from the exact sum, rounding apart.

    ``kernel`` is winding (as ``fields.winding``), regularised_winding, or solid_angle for a tree of triangles. Queries whose bound exceeds ``tolerance``
    descend again until it doesn't; with ``level`` instead, until the bound is less than the distance of their field to that level, so that
    on which side of it they lie is certain. A query without a place, or a tree without sources, gives a NULL field. A query on a point has the
    sum over the others.
    """
    if not index.n:
        return queries.select("qid", F.lit(None).cast("double").alias("field"), F.lit(0.0).alias("bound"))
    asked = queries.where(" AND ".join(f"{c} IS NOT NULL" for c in AXES))
    parts = []
    while True:
        got = materialize((_by_tiles if isinstance(index, Tiled) else _descend)(asked, index, kernel, opening, epsilon), "far-field")
        enough = F.lit(True) if opening == math.inf else F.col("bound") < F.abs(F.col("field") - level) if level is not None else F.col("bound") <= tolerance if tolerance is not None else F.lit(True)
        parts.append(got.where(enough))
        left = got.where(~enough)
        if opening == math.inf or left.isEmpty():
            break
        asked = asked.join(left.select("qid"), "qid", "left_semi")
        opening = opening * 2 if opening < STRICTEST else math.inf
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return queries.select("qid").join(out, "qid", "left").select("qid", "field", F.coalesce("bound", F.lit(0.0)).alias("bound"))


def inside(queries: DataFrame, index: Tree | Tiled, kernel: str = "winding") -> DataFrame:
    """(qid, inside): whether the winding number is nearer to that within than to that outside of a closed cloud, as the exact sum has it."""
    level, below = {"winding": (-0.5, True), "regularised_winding": (0.5, False), "solid_angle": (2 * math.pi, False)}[kernel]
    found = winding(queries, index, kernel, None, level)
    said: Column = F.col("field") < level if below else F.col("field") > level
    return found.select("qid", said.alias("inside"))
