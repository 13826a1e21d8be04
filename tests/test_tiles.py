"""Nearest and farthest points by tiles against brute force, over many tiles, and what is shuffled for them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointfield.operators import fields, neighbours, tiles
from pointfield.operators.fields import Evaluation


def places(spark, p, key):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], f"{key} bigint, x double, y double, z double")


@pytest.fixture
def small(monkeypatch):
    """So small that a few hundred points make many tiles, of which crowded ones are dealt out and busy ones meet their queries in parts."""
    for name, value in (("TILE", 16), ("SAMPLED", 200), ("ASKED", 7)):
        monkeypatch.setattr(tiles, name, value)


@pytest.mark.parametrize("kind", ["volume", "crowd", "place"])
def test_over_many_tiles(spark, small, kind):
    rng = np.random.default_rng(5)
    p = {
        "volume": rng.uniform(-1, 1, (400, 3)),
        "crowd": np.concatenate([rng.normal(0, 1e-6, (200, 3)), np.repeat([[1.0, 2.0, 3.0]], 150, 0), [[1e6, 0, 0]]]),
        "place": np.repeat([[1.0, 2.0, 3.0]], 300, 0),
    }[kind]
    q = np.concatenate([p[::40], rng.uniform(-3, 3, (25, 3))])
    index = tiles.index(places(spark, p, "pid"))
    assert len(index.boxes) > 3 and index.points.groupBy("_tile").count().agg(F.max("count")).first()[0] <= 8 * tiles.TILE
    d = np.sqrt(((p[None] - q[:, None]) ** 2).sum(2))
    for k in (1, 9, 1000):
        got = {}
        for r in neighbours.knn(places(spark, q, "qid"), index, k).collect():
            got.setdefault(r.qid, {})[r["rank"]] = r.pid
        for i in range(len(q)):
            want = sorted(range(len(p)), key=lambda j: (d[i, j], j))[:k]
            assert [d[i, got[i][j]] for j in sorted(got[i])] == pytest.approx([d[i, j] for j in want])
            assert kind == "volume" or k == 1000 or [got[i][j] for j in sorted(got[i])] == sorted([got[i][j] for j in got[i]], key=lambda j: (d[i, j].round(12), j))
    far = {r.qid: (r.pid, r.d) for r in tiles.farthest(places(spark, q, "qid"), index).collect()}
    assert len(far) == len(q) and all(far[i][1] == pytest.approx(d[i].max()) for i in range(len(q)))
    if kind == "place":
        assert {pid for pid, _ in far.values()} == {0}


def test_missing_places(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, None, 0.0, 1.0), (3, float("nan"), 0.0, 1.0)], "pid bigint, x double, y double, z double")
    asked = rows.withColumnRenamed("pid", "qid")
    assert [(r.qid, r.pid) for r in neighbours.knn(asked, rows, 5).collect()] == [(1, 1)]
    assert [(r.qid, r.pid) for r in tiles.farthest(asked, tiles.index(rows)).collect()] == [(1, 1)]
    assert tiles.farthest(asked, tiles.index(rows.limit(0))).count() == 0


def test_pairs_are_not_shuffled(spark):
    """Neither a window over the pairs nor a broadcast of queries sent to every block."""
    cloud = spark.range(300).selectExpr("id AS pid", "cos(id) AS x", "sin(id) AS y", "id / 300e0 AS z", "id / 1e3 AS area")
    asked = cloud.selectExpr("pid AS qid", "x", "y + 0.1e0 AS y", "z")
    for how in (Evaluation(k=8), Evaluation(), Evaluation(radius=0.3, k=4)):
        plan = fields.pairs(asked, cloud, how)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan
    plan = neighbours.all_pairs(asked, cloud, 300)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_nearest_triangles_over_many_tiles(spark, small):
    """Large and small triangles: a tile's box reaches far beyond the centroids by which it was cut."""
    from pointfield.operators import meshes

    rng = np.random.default_rng(8)
    t = rng.uniform(-1, 1, (200, 1, 3)) + rng.normal(size=(200, 3, 3)) * np.where(np.arange(200) % 9, 0.02, 1.0)[:, None, None]
    tri = spark.createDataFrame([(i, *map(float, x.ravel())) for i, x in enumerate(t)], "fid bigint, " + ", ".join(f"{c} double" for c in meshes.TRIANGLE))
    asked = places(spark, rng.uniform(-2, 2, (40, 3)), "qid")
    got = meshes.nearest(asked, tri)
    want = {r.qid: (r.fid, r.d) for r in meshes.distances(asked, tri).collect()}
    assert {r.qid: (r.fid, pytest.approx(r.d)) for r in got.collect()} == want
    assert meshes.nearest(asked, tri.limit(0)).where("d IS NULL AND fid IS NULL").count() == 40
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["volume", "crowd", "place"])
def test_balls_over_many_tiles(spark, small, kind):
    """Queries in and between tiles, on points, at the radius and without a place; pairs come from the tasks themselves, so no join runs over them."""
    rng = np.random.default_rng(6)
    p = {"volume": rng.integers(-8, 9, (400, 3)) / 8, "crowd": np.concatenate([rng.normal(0, 1e-6, (200, 3)), [[0.5, 0, 0], [1e6, 0, 0]]]), "place": np.repeat([[0.25, 0.5, 0.0]], 150, 0)}[kind]
    q = np.concatenate([p[::20], rng.uniform(-2, 2, (30, 3))])
    cloud, asked = places(spark, p, "pid").withColumn("tag", F.concat(F.lit("p"), "pid")), places(spark, q, "qid")
    odd = spark.createDataFrame([(900, None, 0.0, 0.0), (901, float("nan"), 0.0, 0.0)], asked.schema)
    d = np.sqrt(((p[None] - q[:, None]) ** 2).sum(2))
    got = neighbours.within(asked.union(odd), cloud, 0.5)
    assert got.columns == ["qid", "x", "y", "z", "pid", "px", "py", "pz", "tag", "d"]
    rows = got.collect()
    assert sorted((r.qid, r.pid) for r in rows) == [(i, j) for i in range(len(q)) for j in range(len(p)) if d[i, j] <= 0.5]
    assert all(r.tag == f"p{r.pid}" and (r.x, r.y, r.z) == tuple(q[r.qid]) and (r.px, r.py, r.pz) == tuple(p[r.pid]) and r.d == d[r.qid, r.pid] for r in rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange") and (kind == "place" or "Join" not in plan[: plan.index("Exchange")])
    assert neighbours.within(asked, cloud.limit(0), 0.5).count() == neighbours.within(asked.limit(0), cloud, 0.5).count() == 0


def test_balls_are_handed_on_in_batches(spark, small, monkeypatch):
    """However many the pairs of a tile, a batch has no more than so many; before, a task's cells met in a join that AQE gave to few tasks."""
    monkeypatch.setattr(tiles, "NUMBERS", 64)
    cloud = places(spark, np.random.default_rng(7).uniform(0, 0.1, (300, 3)), "pid")
    sizes = neighbours.within(cloud.withColumnRenamed("pid", "qid"), cloud, 1.0, only=("qid", "pid", "d")).mapInArrow(lambda batches: batches, "qid long, pid long, d double")
    assert sizes.count() == 300 * 300 and sizes.rdd.getNumPartitions() > 8


def test_empty_balls_get_their_nearest_points(spark, small):
    """The pairs of balls are made once: before, once more to tell which balls are empty."""
    rng = np.random.default_rng(9)
    p, q = rng.uniform(-1, 1, (200, 3)), rng.uniform(-2, 2, (40, 3))
    d = np.sqrt(((p[None] - q[:, None]) ** 2).sum(2))
    want = [(i, j) for i in range(40) for j in (np.nonzero(d[i] <= 0.3)[0] if d[i].min() <= 0.3 else np.argsort(d[i])[:4])]
    for only in (None, ("qid", "pid", "d")):
        got = neighbours.within_or_nearest(places(spark, q, "qid"), places(spark, p, "pid"), 0.3, 4, only=only)
        assert got.columns == list(only or ("qid", "x", "y", "z", "pid", "px", "py", "pz", "d"))
        rows = got.collect()
        assert sorted((r.qid, r.pid) for r in rows) == sorted(want) and all(r.d == d[r.qid, r.pid] for r in rows)
        assert only or all((r.x, r.px) == (q[r.qid, 0], p[r.pid, 0]) for r in rows)
    assert len({j for i, j in want if d[i].min() > 0.3}) > 4 and "Aggregate" not in got._jdf.queryExecution().optimizedPlan().children().apply(0).toString()


def test_only_boxes_that_overlap_are_handed_on(spark, monkeypatch):
    """f06 hands on each overlapping pair from both sides and each box with itself, no pairs within a ball around the boxes."""
    from pointfield.plans import other_queries

    folder = "/root/testdata/sf0.01"  # on smaller tables no boxes overlap
    met, every = [], tiles.meeting
    monkeypatch.setattr(tiles, "meeting", lambda *a, **b: met.append(every(*a, **b)) or met[0])
    found = other_queries.overlapping(spark, folder).count()
    assert found and met[0].count() == 2 * found + spark.read.parquet(f"{folder}/customer.parquet").count()
