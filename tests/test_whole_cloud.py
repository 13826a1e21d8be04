"""Queries ask for all points of the cloud."""

import math

from pyspark.sql import functions as F

from pointfield.operators import marching, meshes
from pointfield.plans import catalog
from pointfield.plans.fixtures import frame

from .conftest import SF


def test_subsample_in_every_neighbourhood(spark):
    got = catalog.QUERIES["j03_knn_and_farthest_subsample"](spark, SF).groupBy("i").agg(F.count("*").alias("n"), F.min("rank").alias("a"), F.max("rank").alias("b")).collect()
    assert sorted(r.i for r in got) == sorted(r.pid for r in frame(spark, SF, "cloud_sphere").select("pid").collect())
    assert all((r.n, r.a, r.b) == (4, 1, 4) for r in got)


def test_every_torus_has_a_mesh(spark):
    rows = catalog.QUERIES["t14_torus_mesh"](spark, SF).groupBy("pid").agg(F.count("*").alias("n"), F.countDistinct("vid").alias("v")).collect()
    proper = catalog.QUERIES["t06_fit_all"](spark, SF).where("abs(minor_r) >= 1e-10 AND abs(major_r) >= 1e-10").select("pid").collect()
    assert sorted(r.pid for r in rows) == sorted(r.pid for r in proper) and len(rows) > 10
    assert all(r.n == r.v >= 256 for r in rows)


def test_the_faces_of_a_torus_close_around_it(spark):
    rows = [(1, 0.1, 0.2, 0.3, 0.4, 0.5, 1.0, 0.3), (2, 0.0, 0.0, 0.0, 1.0, 2.0, 2.5, -0.4), (3, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)]
    tori = spark.createDataFrame(rows, "pid bigint, cx double, cy double, cz double, theta double, phi double, major_r double, minor_r double")
    for pid, volume in ((1, 2 * math.pi**2 * 0.09), (2, 2 * math.pi**2 * 2.5 * 0.16)):
        vertices = marching.torus_vertices(tori).where(f"pid = {pid}").selectExpr("CAST(vid AS BIGINT) AS vid", "x", "y", "z")
        quads = marching.torus_faces(tori).where(f"pid = {pid}")
        faces = quads.selectExpr("2L*fid AS fid", "v0", "v1", "v2").union(quads.selectExpr("2L*fid + 1 AS fid", "v0", "v2", "v3"))
        got = meshes.quality(vertices, faces).first()
        assert got.watertight and got.consistent and got.outward and got.n_faces == 2 * got.n_vertices
        assert abs(got.volume - volume) < 0.1 * volume
    assert marching.torus_faces(tori).where("pid = 3").count() == 0


def test_a_small_table_of_tori_is_meshed_by_many_tasks(spark):
    """One file of tori is read by one task, whose rows the grids multiply."""
    tori = spark.range(40).coalesce(1).selectExpr("id AS pid", "0e0 AS cx", "0e0 AS cy", "0e0 AS cz", "0.4e0 AS theta", "0.5e0 AS phi", "1e0 AS major_r", "0.3e0 AS minor_r")
    rows = marching.torus_vertices(tori).groupBy(F.spark_partition_id()).agg(F.countDistinct("pid").alias("n")).collect()
    assert len(rows) > 4 and sum(r.n for r in rows) == 40
