"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, passing


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours; partial minima leave the hub of a star before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of integer nodes -> (node, root) for every node that has a link; root is the least node reachable.

    Large-star and small-star steps in turn until neither changes the edges; each step is written, so lost executors
    cost one step, and dropped when the next is there. Nodes of many links only ever meet their minimum: both joins are plain
    equi-joins that AQE can split. Self-links and repeated links count for nothing; an empty table gives no rows.
    """
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    spark = edges.sparkSession
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    held = mark(now)
    while held[0]:
        with passing(spark) as keep:
            both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = materialize(_least(both), "least").withColumn("m", F.least("u", "m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            large = materialize(large, "large-star")
            low = materialize(_least(large), "least")
            small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
            small = keep(materialize(small, "small-star"))
            found = mark(small)
        drop(now)
        now, same, held = small, found == held, found
        if same:
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out._scratch_path = now._scratch_path
    return out
