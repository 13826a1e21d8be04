"""Neighbour search over tiles and as joins on cells.

k nearest neighbours of a table are found by ``tiles``, those in a ``Tree`` by descent. The cloud is summarised at every level of an octree of cells by the tight box and the
number of the points in each; the queries' candidate cells are refined level by level. At each level a query's k-th distance is
bounded by its candidates alone (the least farthest corner within which k points must lie), and cells that begin beyond it are
dropped, so the answer is exact whatever the cloud. Every step is an equi-join on the parent cell and a window over one query's
few candidates; nothing pairs all queries with all points. All levels are written when the tree is made, so a search's plan has
one join and one window a level. A finest cell that holds many points gets a grid of its own over its tight box, again and again:
points that crowd far from a few others are told apart like any.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import materialize
from . import tiles

#: Points that a cell of the finest level holds on average, on a surface; a cell with more than FULL is split.
LEAF, FULL = 12, 512
#: Levels of up to so many cells are broadcast: 9 columns each.
BROADCAST_CELLS = 4096
#: Levels of one grid.
DEEPEST = 16
BOX = [f"{n}{c}" for n in "lh" for c in "xyz"]


def bounds(cloud: DataFrame):
    """(minima, maxima, number) of a cloud, one row."""
    return cloud.agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"], F.count("*").alias("n")).first()


def _key(level: int, low, side):
    """Cell number at a level: the levels' bits of the three coordinates side by side. ``low`` and ``side`` are columns."""
    at = [F.least(F.lit(2**level - 1), F.greatest(F.lit(0), F.floor((F.col(c) - m) * 2**level / side))).cast("long") for c, m in zip("xyz", low, strict=True)]
    return at[0] * 2 ** (2 * level) + at[1] * 2**level + at[2]


def _above(key, depth: int, level: int):
    """The cell of ``level`` that holds a cell of ``depth``."""
    x, y, z = F.shiftright(key, 2 * depth), F.shiftright(key, depth).bitwiseAND(2**depth - 1), key.bitwiseAND(2**depth - 1)
    x, y, z = (F.shiftright(c, depth - level) for c in (x, y, z))
    return x * 2 ** (2 * level) + y * 2**level + z


def _squared(parts):
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def _depth(n: int) -> int:
    return max(1, min(DEEPEST, round(math.log(max(1, n / LEAF), 4))))


@dataclass(frozen=True)
class Tree:
    """A cloud's cells at every level, ready for any number of searches. Points carry the finest cell; a level is (cells, their number),
    its cells (up, cell, box, m) with the cell of the level above."""

    points: DataFrame
    levels: list
    n: int
    #: What the places that totals are taken of were moved by; see ``farfield``.
    middle: tuple = ()


def _grid(points: DataFrame, depth: int, name, extents: bool = False, sums: tuple = ()) -> list:
    """Levels 1 to ``depth`` of points with (_root, _key); ``name`` gives the id of a cell from (root, its key, level). One aggregation."""
    tight = [f(f"{n}{c}" if extents else c).alias(f"{n}{c}") for n, f in (("l", F.min), ("h", F.max)) for c in "xyz"]
    finest = points.groupBy("_root", "_key").agg(*tight, F.count("*").alias("m"), *[F.sum(c).alias(c) for c in sums])
    chain = F.array(*[F.struct(F.lit(k).alias("level"), name(F.col("_root"), _above(F.col("_key"), depth, k - 1), k - 1).alias("up"), name(F.col("_root"), _above(F.col("_key"), depth, k), k).alias("cell")) for k in range(1, depth + 1)])
    every = finest.withColumn("_at", F.explode(chain)).select("_at.*", *BOX, "m", *sums)
    again = [f(f"{n}{c}").alias(f"{n}{c}") for n, f in (("l", F.min), ("h", F.max)) for c in "xyz"]
    every = every.groupBy("level", "up", "cell").agg(*again, F.sum("m").alias("m"), *[F.sum(c).alias(c) for c in sums])
    read = materialize(every, "cells", "level")
    counts = {r.level: r["count"] for r in read.groupBy("level").count().collect()}
    return [(read.where(F.col("level") == k).drop("level"), counts[k]) for k in range(1, depth + 1)]


def tree(cloud: DataFrame, extents: bool = False, sums: tuple = ()) -> Tree:
    """Points without all three coordinates are in no cell and never found. With ``extents`` the rows are objects about (x, y, z) with
    boxes of their own, lx .. hz, which the cells' boxes enclose. Cells also have the totals of the columns ``sums``."""
    cloud = cloud.where("x is not null and y is not null and z is not null")
    box = bounds(cloud)
    if not box.n:
        return Tree(cloud, [], 0)
    low = [F.lit(m) for m in (box.min_x, box.min_y, box.min_z)]
    side = F.lit(max(box.max_x - box.min_x, box.max_y - box.min_y, box.max_z - box.min_z) or 1.0)
    depth = _depth(box.n)
    points = cloud.withColumn("cell", _key(depth, low, side))
    levels = _grid(points.withColumns({"_root": F.lit(0).cast("long"), "_key": F.col("cell")}), depth, lambda root, key, level: key, extents, sums)
    while True:  # a round splits what is full at an eighth of its box or finer, so boxes shrink until they hold few points or one place
        leaves, n = levels[-1]
        wide = F.greatest(*[F.col(f"h{c}") - F.col(f"l{c}") for c in "xyz"])
        full = leaves.where(F.col("m") > FULL)
        if extents:  # objects are dealt out by their places, which may be one place for all
            places = [f(c).alias(f"{n}{c}") for n, f in (("l", F.min), ("h", F.max)) for c in "xyz"]
            full = full.select("cell", "m").join(points.groupBy("cell").agg(*places), "cell")
        full = full.where(wide > 0)
        most = full.agg(F.max("m"), F.count("*")).first()
        if not most[1]:
            return Tree(points, levels, box.n)
        depth = max(3, min(10, _depth(most[0])))
        full = full.select(F.col("cell").alias("_root"), *[F.col(f"l{c}").alias(f"_l{c}") for c in "xyz"], wide.alias("_side"))
        inside = points.withColumnRenamed("cell", "_root").join(F.broadcast(full) if most[1] <= BROADCAST_CELLS else full, "_root", "left")
        inside = inside.withColumn("_key", F.when(F.col("_side").isNotNull(), _key(depth, [F.col(f"_l{c}") for c in "xyz"], F.col("_side"))))
        name = lambda root, key, level: F.xxhash64(root, F.lit(level), key) if level else root
        inside = materialize(inside.withColumn("cell", F.coalesce(F.when(F.col("_key").isNotNull(), name(F.col("_root"), F.col("_key"), depth)), F.col("_root"))).drop("_side", *[f"_l{c}" for c in "xyz"]), "cell-points")
        split = _grid(inside.where("_key is not null"), depth, name, extents, sums)
        rest = leaves.join(full.select(F.col("_root").alias("cell")), "cell", "left_anti").select(F.col("cell").alias("up"), "cell", *BOX, "m", *sums)
        rest = materialize(rest, "cells")
        levels = levels + [(cells.unionByName(rest), k + n - most[1]) for cells, k in split]
        points = inside.drop("_root", "_key")


#: Columns of a cloud up to so many come along with the neighbours; more are looked up by row.
CARRIED = 4


def indexed(cloud: DataFrame | tiles.Tiles) -> tuple[tiles.Tiles, tuple[str, ...], bool]:
    """A cloud's tiles, its columns besides id and place, and whether these come along with the neighbours."""
    index = cloud if isinstance(cloud, tiles.Tiles) else tiles.index(cloud)
    others = tuple(c for c in index.points.columns if c not in ("pid", "x", "y", "z", "_tile", "_row"))
    return index, others, len(others) <= CARRIED


def nearest_lists(queries: DataFrame, cloud: DataFrame | tiles.Tiles, k: int, carry: tuple[str, ...] | None = None) -> DataFrame:
    """The queries' columns and ``near``: array<struct<d, pid, carry ..>> of each one's k nearest points, nearest first, ties by pid. By default
    what ``looked_up`` needs."""
    if k < 1:
        raise ValueError("k must be positive")
    index, others, carried = indexed(cloud)
    return tiles.nearest(queries, index, k, carry if carry is not None else ("x", "y", "z", *others) if carried else ("_row",))


def looked_up(lists: DataFrame, cloud: tiles.Tiles) -> DataFrame:
    """A row (.., d, pid, rank, px, py, pz, other columns ..) for each neighbour of ``nearest_lists``."""
    index, others, carried = indexed(cloud)
    rows = lists.select(*[c for c in lists.columns if c != "near"], F.posexplode("near").alias("_at", "_near"))
    at = [(F.col(f"_near.{c}") if carried else F.col(c)).alias(f"p{c}") for c in "xyz"]
    rest = [F.col(f"_near.{c}") for c in others] if carried else []
    rows = rows.select(*rows.columns[:-2], "_near.d", "_near.pid", (F.col("_at") + 1).alias("rank"), *(at + rest if carried else ["_near._row"]))
    return rows if carried else rows.join(index.points.select("_row", *at, *others), "_row").drop("_row")


def knn(queries: DataFrame, cloud: DataFrame | Tree | tiles.Tiles, k: int, id_col: str = "qid") -> DataFrame:
    """(query columns, pid, px, py, pz, other cloud columns, d, rank) of each query's k nearest points, ties by pid; all points where
    the cloud has k or fewer. Cloud columns x, y, z come as px, py, pz; both sides' other columns must differ in name. Queries and
    points without all three coordinates have no neighbours. A ``Tree`` is searched by descent, anything else by tiles."""
    if k < 1:
        raise ValueError("k must be positive")
    if isinstance(cloud, Tree):
        return _by_descent(queries, cloud, k, id_col)
    index = indexed(cloud)[0]
    return looked_up(nearest_lists(queries, index, k), index)


def _by_descent(queries: DataFrame, index: Tree, k: int, id_col: str) -> DataFrame:
    if not index.n:
        return queries.join(index.points.limit(0).withColumnsRenamed({c: f"p{c}" for c in "xyz"}).withColumns({"d": F.lit(0.0), "rank": F.lit(1)}))
    points = index.points.withColumnsRenamed({c: f"p{c}" for c in "xyz"}).withColumnRenamed("cell", "_up")
    pairs = candidates(queries, index, k, id_col).join(points, "_up").drop("_up")
    pairs = pairs.withColumn("d", F.sqrt(_squared([F.col(c) - F.col(f"p{c}") for c in "xyz"])))
    order = Window.partitionBy(id_col).orderBy("d", "pid")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    rest = [c for c in queries.columns if c not in (id_col, "x", "y", "z")]
    return pairs.join(queries.select(id_col, *rest), id_col) if rest else pairs


def candidates(queries: DataFrame, index: Tree, k: int, id_col: str = "qid") -> DataFrame:
    """(id, x, y, z, _up): the finest cells that may hold one of a query's k nearest points, or objects."""
    asked = queries.select(id_col, "x", "y", "z")
    found = asked.withColumn("_up", F.lit(0).cast("long"))
    for cells, n in index.levels:
        cells = cells.withColumnRenamed("up", "_up")
        found = found.join(F.broadcast(cells) if n <= BROADCAST_CELLS else cells, "_up")
        near = _squared([F.greatest(F.col(f"l{c}") - F.col(c), F.col(c) - F.col(f"h{c}"), F.lit(0.0)) for c in "xyz"])
        far = _squared([F.greatest(F.abs(F.col(c) - F.col(f"l{c}")), F.abs(F.col(c) - F.col(f"h{c}"))) for c in "xyz"])
        found = found.select(id_col, "x", "y", "z", F.col("cell").alias("_up"), "m", near.alias("_near"), far.alias("_far"))
        inside = Window.partitionBy(id_col).orderBy("_far", "_up").rowsBetween(Window.unboundedPreceding, 0)
        found = found.withColumn("_sum", F.sum("m").over(inside))
        reach = F.min(F.when(F.col("_sum") >= min(k, index.n), F.col("_far"))).over(Window.partitionBy(id_col))
        found = found.withColumn("_reach", reach).where(F.col("_near") <= F.col("_reach") * (1 + 1e-9) + 1e-300).select(id_col, "x", "y", "z", "_up")
    return found


def within(queries: DataFrame, cloud: DataFrame | tiles.Tiles, radius: float, id_col: str = "qid", only: tuple[str, ...] | None = None) -> DataFrame:
    """Pairs no farther apart than ``radius`` (closed), with the queries' columns, the cloud's, places as px, py, pz, and d; or with ``only`` some of
    these. Pairs are found tile by tile and handed on at once. At radius 0 the pairs of one place, below it none."""
    named = {c: f"p{c}" if c in ("x", "y", "z") else c for c in (cloud.points if isinstance(cloud, tiles.Tiles) else cloud).columns if c not in ("_tile", "_row")}
    every = (*queries.columns, *named.values(), "d")
    if radius <= 0:
        points = (cloud.points.drop("_tile", "_row") if isinstance(cloud, tiles.Tiles) else cloud).withColumnsRenamed({c: f"p{c}" for c in "xyz"})
        same = [F.col(c) + 0.0 == F.col(f"p{c}") + 0.0 for c in "xyz"]
        return queries.join(points, same[0] & same[1] & same[2]).withColumn("d", F.lit(0.0)).where(F.lit(radius == 0)).select(*only or every)
    carry = {c: n for c, n in named.items() if not only or n in only}
    index = cloud if isinstance(cloud, tiles.Tiles) else tiles.index(cloud.select(*dict.fromkeys((*carry, "x", "y", "z"))))
    return tiles.meeting(queries, index, radius, {c: c for c in queries.columns if not only or c in only}, carry).select(*only or every)


def within_or_nearest(queries: DataFrame, cloud: DataFrame, radius: float, k: int | None = None, id_col: str = "qid", only: tuple[str, ...] | None = None) -> DataFrame:
    """``within``; queries whose ball is empty get their k nearest points (10 by default) instead. These tell whether a ball is empty, so its pairs
    are made once."""
    index = indexed(cloud)[0]
    ball = within(queries, index, radius, id_col, only)
    beside = [c for c in ball.columns if c in queries.columns]
    named = {c: f"p{c}" if c in ("x", "y", "z") else c for c in index.points.columns if c not in ("pid", "_tile", "_row")}
    carry = {c: n for c, n in named.items() if n in ball.columns}
    near = nearest_lists(queries, index, k or 10, tuple(carry))
    alone = near.where(F.element_at("near", 1)["d"] > radius).select(*beside, F.explode("near").alias("_near"))
    alone = alone.select(*beside, *[F.col(f"_near.{c}").alias(n) for c, n in ({"pid": "pid", "d": "d"} | carry).items()])
    return ball.unionByName(alone.select(*ball.columns))


#: Points of a block of ``all_pairs``.
BLOCK = 16_384


def all_pairs(queries: DataFrame, cloud: DataFrame, n: int) -> DataFrame:
    """Every query with every one of the cloud's ``n`` points, for sums over the whole cloud. The cloud is dealt into blocks, the queries into
    shares, and each block meets each share in an equi-join on both numbers, which holds one block at a time; a query is sent once a block.
    The sums that follow combine before they are shuffled."""
    blocks = max(1, -(-n // BLOCK))
    spark = cloud.sparkSession
    tasks = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = max(1, -(-tasks // blocks))
    to = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    points = cloud.withColumnsRenamed({c: f"p{c}" for c in "xyz"}).withColumn("_block", F.pmod(F.xxhash64("pid"), F.lit(blocks))).withColumn("_share", to(shares))
    asked = queries.withColumn("_share", F.pmod(F.xxhash64("qid"), F.lit(shares))).withColumn("_block", to(blocks))
    # The queries look small before they are sent to every block, so the join must not be left to their size.
    points, asked = (x.repartition(min(tasks, blocks * shares), "_block", "_share") for x in (points, asked))
    pairs = asked.hint("merge").join(points, ["_block", "_share"]).drop("_block", "_share")
    return pairs.withColumn("d", F.sqrt(_squared([F.col(c) - F.col(f"p{c}") for c in "xyz"])))


def self_knn(cloud: DataFrame, k: int, drop_outliers: bool = False) -> DataFrame:
    """(i, pid, d, rank): each point's nearest points, itself included at distance 0. With ``drop_outliers`` points marked so are
    neither asked about nor found; they keep one row with neighbour and distance -1."""
    base = cloud.where(~F.col("outlier")) if drop_outliers else cloud
    got = knn(base.select(F.col("pid").alias("i"), "x", "y", "z"), base.select("pid", "x", "y", "z"), k, "i").select("i", "pid", "d", "rank")
    if drop_outliers:
        gone = cloud.where("outlier").select(F.col("pid").alias("i"), F.lit(-1).cast("bigint").alias("pid"), F.lit(-1.0).alias("d"), F.lit(1).alias("rank"))
        got = got.unionByName(gone)
    return got
