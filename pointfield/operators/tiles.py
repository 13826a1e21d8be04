"""Nearest points and triangles, and those within a radius or a box, by tiles of space.

A cloud is dealt into tiles of neighbouring rows by cuts along its axes, each with its tight box. A query meets the tile that begins
nearest to it; the k-th distance there bounds the rest, so it meets only those other tiles that begin within that distance. Tiles
and their queries come together by a shuffle on the tile's number; what is shuffled and written are points, queries and the k nearest of
each, never the pairs that were tried. The cuts come from a sample and decide where a row is worked on, as the borders of a range partition
do, not what is found: answers are exact whatever the cuts.

A tile that holds many points for want of places to cut at is dealt out by row, and a tile with many queries meets them in parts, so
no task holds more than so many of either.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import materialize

#: Rows of a tile at least, tiles at most but for crowded places, rows of the sample that gives the cuts, queries that meet a tile at a time.
TILE, TILES, SAMPLED, ASKED = 8_192, 2_048, 65_536, 16_384
#: Objects of a leaf within a task's tile; numbers in one array there.
LEAF, NUMBERS = 32, 1 << 18
AXES = "xyz"


@dataclass(frozen=True)
class Tiles:
    """A cloud's rows with ``_tile`` and ``_row``, written, and the tiles' boxes (tiles, 6), low corners first."""

    points: DataFrame
    boxes: np.ndarray
    n: int
    extents: bool = False


def _cuts(p: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Axis (-1: none), place and first child (or a leaf's number) of the cuts that leave at most ``share`` of the points on a side."""
    axis, place, child, leaves = [0], [0.0], [0], 0
    todo = [(0, p)]
    while todo:
        at, here = todo.pop()
        spans = np.ptp(here, axis=0) if len(here) else np.zeros(3)
        along = int(np.argmax(spans))
        if len(here) <= share or spans[along] <= 0:
            axis[at], child[at], leaves = -1, leaves, leaves + 1
            continue
        values = here[:, along]
        cut = np.median(values)
        if cut <= values.min():
            cut = values[values > values.min()].min()
        axis[at], place[at], child[at] = along, cut, len(axis)
        for side in (values < cut, values >= cut):
            todo.append((len(axis), here[side]))
            axis.append(0), place.append(0.0), child.append(0)
    return np.array(axis), np.array(place), np.array(child)


def _tile_of(p: np.ndarray, axis: np.ndarray, place: np.ndarray, child: np.ndarray) -> np.ndarray:
    at = np.zeros(len(p), np.int64)
    live = np.arange(len(p))
    while len(live := live[axis[at[live]] >= 0]):
        here = at[live]
        at[live] = child[here] + (p[live, axis[here]] >= place[here])
    return child[at]


def _sound(names) -> str:
    return " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in names)


def _numbered(spark, rows: list, columns: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, columns))


def _tasks(df: DataFrame, groups: int) -> int:
    spark = df.sparkSession
    return max(1, min(groups, 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def index(cloud: DataFrame, extents: bool = False) -> Tiles:
    """Rows without all three coordinates are in no tile and never found. With ``extents`` they are objects about (x, y, z) with boxes
    of their own, lx .. hz."""
    cloud = cloud.where(_sound(AXES))
    n = cloud.count()
    if not n:
        return Tiles(cloud.withColumns({"_tile": F.lit(0).cast("long"), "_row": F.lit(0).cast("long")}), np.zeros((0, 6)), 0, extents)
    size = max(TILE, -(-n // TILES))
    places = cloud.select(*[F.col(c).cast("double").alias(c) for c in AXES])
    if n > size:
        sampled = places.sample(min(1.0, SAMPLED / n), 1).toPandas().to_numpy(float)
        cuts = _cuts(sampled, max(1, int(size * len(sampled) / n)))

        @F.pandas_udf("long")
        def tile(x, y, z):
            import pandas as pd

            return pd.Series(_tile_of(np.stack([x, y, z], 1), *cuts))

        number = tile(*[F.col(c).cast("double") for c in AXES])
    else:
        number = F.lit(0).cast("long")
    points = materialize(cloud.withColumn("_tile", number).withColumn("_row", F.monotonically_increasing_id()), "tiles")
    box = [f(f"{side}{c}" if extents else c).cast("double").alias(f"{side}{c}") for f, side in ((F.min, "l"), (F.max, "h")) for c in AXES]
    boxes, first, parts = [], [], []
    for r in points.groupBy("_tile").agg(F.count("*").alias("m"), *box).orderBy("_tile").collect():
        first.append((r[0], len(boxes), max(1, r.m // (4 * size))))
        boxes += [r[2:]] * first[-1][2]
    if len(boxes) != len(first) or any(a != b for a, b, _ in first):  # tiles without rows, or crowded ones
        dealt = _numbered(cloud.sparkSession, first, "_tile long, _first long, _parts long")
        points = points.join(dealt, "_tile").withColumn("_tile", F.col("_first") + F.pmod(F.xxhash64("_row"), F.col("_parts"))).drop("_first", "_parts")
    return Tiles(points, np.array(boxes, float), n, extents)


def _between(a_low: np.ndarray, a_high: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(boxes, boxes): squared distances; 0 where two meet."""
    out = 0.0
    for i in range(3):
        gap = np.maximum(low[None, :, i] - a_high[:, None, i], a_low[:, None, i] - high[None, :, i])
        np.maximum(gap, 0.0, out=gap)
        gap *= gap
        out = out + gap
    return out


def _near(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(queries, boxes): squared distances."""
    return _between(p, p, low, high)


def _leaves(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Objects dealt into leaves of neighbours: (leaves, LEAF) their numbers, -1 for none, and the leaves' boxes."""
    middle, todo, rows = (low + high) / 2, [np.arange(len(low))], []
    while todo:
        i = todo.pop()
        if len(i) <= LEAF:
            rows.append(i)
            continue
        p = middle[i]
        i = i[np.argpartition(p[:, int(np.argmax(np.ptp(p, axis=0)))], len(i) // 2)]
        todo += [i[: len(i) // 2], i[len(i) // 2 :]]
    out = np.full((len(rows), LEAF), -1)
    for k, i in enumerate(rows):
        out[k, : len(i)] = i
    return out, np.array([low[i].min(0) for i in rows]), np.array([high[i].max(0) for i in rows])


def _within(r: np.ndarray) -> np.ndarray:
    """The square of a distance, rounding allowed for."""
    return r * r * (1 + 1e-9) + 1e-300


def _search(q: np.ndarray, reach: np.ndarray, k: int, low: np.ndarray, high: np.ndarray, ids: np.ndarray, distance, boxed: bool):
    """(query, object, d) of each query's k nearest objects that lie no farther than its reach, by query and rank; ties by id."""
    leaves, leaf_low, leaf_high = _leaves(low, high)
    first = min(len(leaves), -(-2 * k // LEAF) + 1)
    step = max(1, NUMBERS // max(len(leaves), first * LEAF))
    found = []
    for s in range(0, len(q), step):
        p, r = q[s : s + step], reach[s : s + step].copy()
        near = _near(p, leaf_low, leaf_high)
        fresh = np.nonzero(np.isinf(r))[0]
        if len(fresh) and first * LEAF >= k:
            some = np.argpartition(near[fresh], first - 1, axis=1)[:, :first] if first < len(leaves) else np.broadcast_to(np.arange(first), (len(fresh), first))
            some = leaves[some].reshape(len(fresh), -1)
            d = distance(s + np.repeat(fresh, some.shape[1]), np.maximum(some, 0).ravel()).reshape(some.shape)
            r[fresh] = np.partition(np.where((some < 0) | np.isnan(d), np.inf, d), k - 1, axis=1)[:, k - 1]
        who, leaf = np.nonzero(near <= _within(r)[:, None])
        parts = []
        for t in range(0, len(who), NUMBERS // LEAF):
            a, o = np.repeat(who[t : t + NUMBERS // LEAF], LEAF), leaves[leaf[t : t + NUMBERS // LEAF]].ravel()
            a, o = a[o >= 0], o[o >= 0]
            if boxed:
                gap = np.maximum(np.maximum(low[o] - p[a], p[a] - high[o]), 0.0)
                ok = (gap * gap).sum(1) <= _within(r)[a]
                a, o = a[ok], o[ok]
            d = distance(s + a, o)
            ok = d <= r[a]
            parts.append((a[ok], o[ok], d[ok]))
        if parts:
            a, o, d = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((ids[o], d, a))
            a, o, d = a[order], o[order], d[order]
            ok = np.arange(len(a)) - np.searchsorted(a, a) < k
            found.append((s + a[ok], o[ok], d[ok]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _matrix(t: pa.Table, names) -> np.ndarray:
    return np.stack([t.column(c).to_numpy().astype(float) for c in names], 1) if t.num_rows else np.zeros((0, len(names)))


def _euclid(q: np.ndarray, p: np.ndarray):
    def distance(a, o):
        v = p[o] - q[a]
        v *= v
        return np.sqrt(v[:, 0] + v[:, 1] + v[:, 2])

    return distance


def _formula(source: str, t: pa.Table, names, q: np.ndarray):
    """The distance of a formula of a query's x, y, z and an object's columns."""
    space: dict = {}
    exec(source, space)  # noqa: S102  (our own formula)
    columns = {c: t.column(c).to_numpy() for c in names}

    def distance(a, o):
        with np.errstate(all="ignore"):
            return space["f"]({c: v[o] for c, v in columns.items()} | dict(zip(AXES, q[a].T, strict=True)))

    return distance


def met(asked: DataFrame, points: DataFrame, work, schema: str, asked_at_once: int = ASKED) -> DataFrame:
    """``work(queries, points)`` on Arrow tables of each tile's rows and of the queries, dealt by _tile, that meet it: no more than about
    so many at once."""
    spark = asked.sparkSession
    parts = [(r[0], -(-r[1] // asked_at_once)) for r in asked.groupBy("_tile").count().collect()]
    if not parts:
        return asked.limit(0).mapInArrow(lambda batches: iter(()), schema)
    every = _numbered(spark, parts, "_tile long, _parts long")
    n = _tasks(asked, sum(m for _, m in parts))
    asked = asked.join(every, "_tile").withColumn("_part", F.pmod(F.xxhash64("_q"), F.col("_parts"))).drop("_parts")
    points = points.join(every, "_tile").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    asked, points = (x.repartition(n, "_tile", "_part") for x in (asked, points))
    return asked.groupBy("_tile", "_part").cogroup(points.groupBy("_tile", "_part")).applyInArrow(work, schema)


def routed(queries: DataFrame, tiles: Tiles) -> DataFrame:
    """The queries that have a place, with a number ``_q`` and the tile that begins nearest; written."""
    boxes = tiles.boxes

    @F.pandas_udf("long")
    def nearest_tile(x, y, z):
        import pandas as pd

        p, out = np.stack([x, y, z], 1).astype(float), np.zeros(len(x), np.int64)
        step = max(1, NUMBERS // len(boxes))
        for s in range(0, len(p), step):
            out[s : s + step] = np.argmin(_near(p[s : s + step], boxes[:, :3], boxes[:, 3:]), axis=1)
        return pd.Series(out)

    if len(boxes) > 1:
        queries = queries.repartition(_tasks(queries, len(boxes)))  # a short file would leave the work below to a few tasks
    asked = queries.where(_sound(AXES)).withColumn("_q", F.monotonically_increasing_id())
    number = nearest_tile(*[F.col(c).cast("double") for c in AXES]) if len(boxes) > 1 else F.lit(0).cast("long")
    return materialize(asked.withColumn("_tile", number), "asked")


def nearest(queries: DataFrame, tiles: Tiles, k: int, carry: tuple[str, ...], id_: str = "pid", formula: tuple[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The queries' columns and ``near``: array<struct<d, id, carry ..>> of each one's k nearest rows, nearest first, ties by id. Queries without a
    place have no row. ``formula``, Python source and the columns it reads besides the place, is the distance of objects with boxes."""
    kinds = {f.name: f.dataType.simpleString() for f in tiles.points.schema}
    near = f"array<struct<d:double,`{id_}`:{kinds[id_]},{','.join(f'`{c}`:{kinds[c]}' for c in carry)}>>".replace(",>", ">")
    if not tiles.n:
        return queries.withColumn("near", F.lit(None).cast(near)).limit(0)
    boxes, extents, beside = tiles.boxes, tiles.extents, queries.columns
    names = (id_, *carry)
    sides = ([f"l{c}" for c in AXES], [f"h{c}" for c in AXES]) if extents else (list(AXES), list(AXES))

    def find(asked: pa.Table, points: pa.Table, reach: np.ndarray):
        q = _matrix(asked, AXES)
        low, high = (_matrix(points, s) for s in sides)
        ids = points.column(id_).to_numpy()
        if ids.dtype == object:
            ids = np.unique(ids.astype(str), return_inverse=True)[1]
        distance = _formula(formula[0], points, formula[1], q) if formula else _euclid(q, low)
        a, o, d = _search(q, reach, k, low, high, ids, distance, extents)
        offsets = np.searchsorted(a, np.arange(len(q) + 1)).astype(np.int32)
        o = pa.array(o)
        values = pa.StructArray.from_arrays([pa.array(d), *(points.column(c).combine_chunks().take(o) for c in names)], names=["d", *names])
        counts = np.diff(offsets)
        last = np.where(counts >= k, d[np.maximum(offsets[1:] - 1, 0)] if len(d) else np.inf, np.inf)
        return q, pa.ListArray.from_arrays(pa.array(offsets), values), last

    def start(asked: pa.Table, points: pa.Table) -> pa.Table:
        q, found, last = find(asked, points, np.full(asked.num_rows, np.inf))
        own, others, sizes = asked.column("_tile").to_numpy(), [], []
        step = max(1, NUMBERS // len(boxes))
        for s in range(0, len(q), step):
            hit = _near(q[s : s + step], boxes[:, :3], boxes[:, 3:]) <= _within(last[s : s + step])[:, None]
            hit[np.arange(len(hit)), own[s : s + step]] = False
            others.append(np.nonzero(hit)[1])
            sizes.append(hit.sum(1))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
        more = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(others) if others else np.zeros(0, np.int64), pa.int64()))
        return pa.table([*(asked.column(c) for c in (*beside, "_q")), pa.array(last), more, found], names=[*beside, "_q", "_reach", "_more", "near"])

    def go_on(asked: pa.Table, points: pa.Table) -> pa.Table:
        _, found, _ = find(asked, points, asked.column("_reach").to_numpy())
        return pa.table([asked.column("_q"), found], names=["_q", "_found"])

    points = tiles.points.select("_tile", *dict.fromkeys((id_, *sides[0], *sides[1], *carry, *(formula[1] if formula else ()))))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    begun = met(routed(queries, tiles), points, start, f"{schema}, _q long, _reach double, _more array<bigint>, near {near}")
    if len(boxes) == 1:
        return begun.select(*beside, "near")
    begun = materialize(begun, "near")
    asked = begun.select("_q", *AXES, "_reach", F.explode("_more").alias("_tile"))
    found = met(asked, points, go_on, f"_q long, _found {near}").where(F.size("_found") > 0)
    found = found.groupBy("_q").agg(F.flatten(F.collect_list("_found")).alias("_found"))
    open_ = begun.where(F.size("_more") > 0).join(found, "_q", "left")
    merged = open_.withColumn("near", F.when(F.col("_found").isNull(), F.col("near")).otherwise(F.slice(F.array_sort(F.concat("near", "_found")), 1, k)))
    return begun.where(F.size("_more") == 0).select(*beside, "near").unionByName(merged.select(*beside, "near"))


def _in_ball(radius: float):
    def meets(q_low, q_high, low, high):
        x, y, z = (a - b for a, b in zip(low, q_low, strict=True))
        d = np.sqrt(x * x + y * y + z * z)
        return d <= radius, d

    return meets


def _in_box(q_low, q_high, low, high):
    ok = None
    for a, b, c, d in zip(q_low, q_high, low, high, strict=True):
        this = (c <= b) & (d >= a)
        ok = this if ok is None else ok & this
    return ok, None


def meeting(queries: DataFrame, tiles: Tiles, radius: float | None, beside: dict[str, str], carry: dict[str, str], sides: tuple | None = None) -> DataFrame:
    """Pairs of queries and of the tiles' rows that are no farther apart than ``radius``, with d; without a radius, those whose boxes meet, the
    queries' sides (their low and high columns) given. ``beside`` and ``carry`` name the columns of both that a pair keeps, by their names in the result.

    A query goes to the tiles that begin within its reach. A task takes in one tile's rows, then its queries as they come, and hands pairs on in
    batches of bounded size: pairs are not shuffled, written or held, however many they are."""
    low, high = sides or (list(AXES), list(AXES))
    own = ([f"l{c}" for c in AXES], [f"h{c}" for c in AXES]) if tiles.extents else (list(AXES), list(AXES))
    kinds, theirs = ({f.name: f.dataType.simpleString() for f in df.schema} for df in (queries, tiles.points))
    fields = [f"`{n}` {kinds[c]}" for c, n in beside.items()] + [f"`{n}` {theirs[c]}" for c, n in carry.items()]
    schema = ", ".join(fields + ([] if radius is None else ["d double"]))
    names = [*beside.values(), *carry.values(), *([] if radius is None else ["d"])]
    boxes, reach = tiles.boxes, _within(radius or 0.0)

    @F.pandas_udf("array<long>")
    def reached(a, b, c, d, e, f):
        import pandas as pd

        q, out = np.stack([a, b, c, d, e, f], 1).astype(float), []
        step = max(1, NUMBERS // max(1, len(boxes)))
        for s in range(0, len(q), step):
            near = _between(q[s : s + step, :3], q[s : s + step, 3:], boxes[:, :3], boxes[:, 3:])
            out += [np.nonzero(row <= reach)[0].tolist() for row in near]
        return pd.Series(out)

    asked = queries.where(_sound(dict.fromkeys((*low, *high))))
    place = lambda names: [F.col(c).cast("double") for c in names]
    if not tiles.n:
        return asked.limit(0).mapInArrow(lambda batches: iter(()), schema)
    asked = asked.select(F.struct(*[F.col(c).alias(f"b{i}") for i, c in enumerate(beside)], *[c.alias(f"q{i}") for i, c in enumerate(place((*low, *high)))]).alias("_asked"), *dict.fromkeys((*low, *high)))
    asked = asked.repartition(_tasks(asked, len(boxes))).select("_asked", reached(*place((*low, *high))).alias("_tiles")).where(F.size("_tiles") > 0)
    asked = materialize(asked.withColumn("_q", F.monotonically_increasing_id()), "asked").select("_q", "_asked", F.explode("_tiles").alias("_tile"))
    parts = [(r[0], -(-r[1] // ASKED)) for r in asked.groupBy("_tile").count().collect()]
    if not parts:
        return asked.limit(0).mapInArrow(lambda batches: iter(()), schema)
    every = _numbered(asked.sparkSession, parts, "_tile long, _parts long")
    asked = asked.join(every, "_tile").withColumn("_part", F.pmod(F.xxhash64("_q"), F.col("_parts")))
    points = tiles.points.join(every, "_tile").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], *[c.alias(f"p{i}") for i, c in enumerate(place((*own[0], *own[1])))])
    # Rows of a tile come before its queries.
    points = points.select("_tile", "_part", F.lit(0).alias("_side"), row.alias("_row"), F.lit(None).cast(asked.schema["_asked"].dataType).alias("_asked"))
    both = points.unionByName(asked.select("_tile", "_part", F.lit(1).alias("_side"), F.lit(None).cast(points.schema["_row"].dataType).alias("_row"), "_asked"))
    both = both.repartition(_tasks(both, sum(m for _, m in parts)), "_tile", "_part").sortWithinPartitions("_tile", "_part", "_side")
    exact, kept = _in_box if radius is None else _in_ball(radius), len(carry)

    def taken(held: list) -> tuple:
        columns = [pa.concat_arrays(c) for c in zip(*held, strict=True)]
        p = np.stack([c.to_numpy(zero_copy_only=False) for c in columns[kept:]], 1)
        leaves, leaf_low, leaf_high = _leaves(p[:, :3], p[:, 3:])
        ends = [np.where(leaves < 0, np.nan, p[leaves, i]) for i in range(6)]
        return columns[:kept], leaves, leaf_low, leaf_high, ends

    def pairs(tile: tuple, columns: list):
        carried, leaves, leaf_low, leaf_high, ends = tile
        q = np.stack([c.to_numpy(zero_copy_only=False) for c in columns[len(beside) :]], 1)
        step = max(1, NUMBERS // len(leaves))
        for s in range(0, len(q), step):
            who, leaf = np.nonzero(_between(q[s : s + step, :3], q[s : s + step, 3:], leaf_low, leaf_high) <= reach)
            who += s
            for t in range(0, len(who), NUMBERS // LEAF):
                a, o = who[t : t + NUMBERS // LEAF], leaf[t : t + NUMBERS // LEAF]
                at = [q[a, i, None] for i in range(6)]
                ok, d = exact(at[:3], at[3:], *([e[o] for e in side] for side in (ends[:3], ends[3:])))
                a, o = np.repeat(a, ok.sum(1)), leaves[o][ok]
                if len(a):
                    a, o = pa.array(a), pa.array(o)
                    yield pa.RecordBatch.from_arrays([*(c.take(a) for c in columns[: len(beside)]), *(c.take(o) for c in carried), *([] if d is None else [pa.array(d[ok])])], names=names)

    def work(batches):
        at, held, tile = None, [], None
        for b in batches:
            key = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1)
            starts = np.concatenate([[0], np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1, [len(key)]]) if len(key) else []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if at != (now := tuple(key[s, :2])):
                    at, held, tile = now, [], None
                if key[s, 2] == 0:
                    held.append(b.column(3).slice(s, e - s).flatten())
                elif held or tile:
                    if tile is None:
                        tile, held = taken(held), []
                    yield from pairs(tile, b.column(4).slice(s, e - s).flatten())

    return both.mapInArrow(work, schema)


def _far(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(queries, boxes): squared distances of their farthest corners."""
    out = 0.0
    for i in range(3):
        gap = np.maximum(np.abs(p[:, None, i] - low[None, :, i]), np.abs(p[:, None, i] - high[None, :, i]))
        gap *= gap
        out = out + gap
    return out


def farthest(queries: DataFrame, tiles: Tiles) -> DataFrame:
    """The queries' columns, pid and d of each one's farthest point, ties to the lower pid. The tile that reaches farthest bounds the others."""
    kind = tiles.points.schema["pid"].dataType.simpleString()
    if not tiles.n:
        return queries.withColumns({"pid": F.lit(None).cast(kind), "d": F.lit(None).cast("double")}).limit(0)
    boxes, beside = tiles.boxes, queries.columns

    @F.pandas_udf("array<long>")
    def reached(x, y, z, least):
        import pandas as pd

        p, out = np.stack([x, y, z], 1).astype(float), []
        for s in range(0, len(p), max(1, NUMBERS // len(boxes))):
            far = _far(p[s : s + max(1, NUMBERS // len(boxes))], boxes[:, :3], boxes[:, 3:])
            d = least.to_numpy()[s : s + len(far)]
            out += [[int(np.argmax(f))] if e < 0 else np.nonzero(f >= e * e * (1 - 1e-9))[0].tolist() for f, e in zip(far, d, strict=True)]
        return pd.Series(out)

    def best(asked: pa.Table, points: pa.Table) -> pa.Table:
        q, p, ids = _matrix(asked, AXES), _matrix(points, AXES), points.column("pid")
        order = ids.to_numpy()
        if order.dtype == object:
            order = np.unique(order.astype(str), return_inverse=True)[1]
        leaves, low, high = _leaves(p, p)
        who, d = np.zeros(len(q), np.int64), np.zeros(len(q))
        distance = _euclid(q, p)
        for s in range(0, len(q), max(1, NUMBERS // max(len(leaves), LEAF))):
            far = _far(q[s : s + max(1, NUMBERS // max(len(leaves), LEAF))], low, high)
            first = leaves[far.argmax(1)]
            some = np.where(first < 0, -np.inf, distance(s + np.repeat(np.arange(len(far)), LEAF), np.maximum(first, 0).ravel()).reshape(first.shape)).max(1)
            a, leaf = np.nonzero(far >= (some * some * (1 - 1e-9))[:, None])
            a, o = s + np.repeat(a, LEAF), leaves[leaf].ravel()
            a, o = a[o >= 0], o[o >= 0]
            e = distance(a, o)
            ok = e >= some[a - s]
            a, o, e = a[ok], o[ok], e[ok]
            i = np.lexsort((order[o], -e, a))
            i = i[np.unique(a[i], return_index=True)[1]]
            who[a[i]], d[a[i]] = o[i], e[i]
        return pa.table([asked.column("_q"), ids.combine_chunks().take(pa.array(who)), pa.array(d)], names=["_q", "pid", "d"])

    places = [F.col(c).cast("double") for c in AXES]
    asked = materialize(queries.where(_sound(AXES)).withColumn("_q", F.monotonically_increasing_id()), "asked")
    points = tiles.points.select("_tile", "pid", *AXES)
    schema = f"_q long, pid {kind}, d double"
    to = lambda least: F.explode(reached(*places, least)).alias("_tile")
    begun = materialize(met(materialize(asked.select("_q", *AXES, to(F.lit(-1.0))), "asked"), points, best, schema), "far")
    again = materialize(asked.join(begun.select("_q", "d"), "_q").select("_q", *AXES, to(F.col("d"))), "asked")
    found = met(again, points, best, schema).groupBy("_q").agg(F.max("d").alias("_most"), F.collect_list(F.struct("pid", "d")).alias("_all"))
    found = found.select("_q", F.array_min(F.transform(F.filter("_all", lambda s: s["d"] == F.col("_most")), lambda s: s["pid"])).alias("pid"), F.col("_most").alias("d"))
    return asked.join(found, "_q").select(*beside, "pid", "d")
