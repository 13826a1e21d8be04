"""Job 1: make a scanned cloud fit for queries.

    python -m jobs.clean_cloud --cloud TABLE --out FOLDER [--config FILE]

Reads a table of points, derives id, position and normal by the config's expressions, and gives every point one verdict:

incomplete   id, position or normal is missing or not a number
duplicate    a point with a smaller id has the same position
outlier      its mean distance to its nearest points is over mean + spread * deviation of the cloud's
turned       too few of its nearest points have a normal of the same side; its own is turned round
kept         none of these

Points are written as Parquet by verdict and slab of height, counts of both as JSON. Each run replaces both, so it may be run again
after a failure or on a grown table. Rows that repeat in full are equally complete, so a repeated id is kept twice unless its position repeats
under a smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, derived, log
from pointfield.operators import neighbours
from pointfield.plans.session import materialize, passing

PLACE, NORMAL = ["x", "y", "z"], ["nx", "ny", "nz"]


def _sound(names: list[str]):
    ok = F.lit(True)
    for c in names:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return ok


def verdicts(cloud: DataFrame, config: dict) -> DataFrame:
    """(pid, x .. nz, spacing, same_side, verdict) of every row of (pid, x .. nz)."""
    whole = cloud.withColumn("_ok", F.col("pid").isNotNull() & _sound(PLACE + NORMAL))
    first = whole.where("_ok").groupBy(*PLACE).agg(F.min("pid").alias("pid")).withColumn("_first", F.lit(True))
    # By position and id: however many points share a place, they don't meet in one task.
    points = materialize(whole.where("_ok").join(first, ["pid", *PLACE], "left"), "clean-points")
    alone = materialize(points.where("_first").dropDuplicates(["pid", *PLACE]).select("pid", *PLACE, *NORMAL), "clean-alone")
    near = neighbours.knn(alone.select(F.col("pid").alias("i"), *PLACE, *[F.col(c).alias(f"i{c}") for c in NORMAL]), alone, config["neighbours"] + 1, "i").where("i <> pid")
    facing = F.col("inx") * F.col("nx") + F.col("iny") * F.col("ny") + F.col("inz") * F.col("nz")
    hood = materialize(near.groupBy(F.col("i").alias("pid")).agg(F.avg("d").alias("spacing"), F.avg((facing > 0).cast("double")).alias("same_side")), "clean-hoods")
    limit = hood.agg(F.avg("spacing") + config["spread"] * F.stddev_pop("spacing")).first()[0]
    judged = points.join(hood, "pid", "left").withColumn(
        "verdict",
        F.when(F.col("_first").isNull(), "duplicate")
        .when(F.col("spacing") > F.lit(limit), "outlier")
        .when(F.col("same_side") < config["same_side"], "turned")
        .otherwise("kept"),
    )
    measured = lambda c: F.when(F.col("verdict") != "duplicate", F.col(c)).alias(c)
    turned = lambda c: F.when(F.col("verdict") == "turned", -F.col(c)).otherwise(F.col(c)).alias(c)
    out = judged.select("pid", *PLACE, *[turned(c) for c in NORMAL], measured("spacing"), measured("same_side"), "verdict")
    none = F.lit(None).cast("double")
    rest = whole.where("NOT _ok").select("pid", *PLACE, *NORMAL, none.alias("spacing"), none.alias("same_side"), F.lit("incomplete").alias("verdict"))
    return out.unionByName(rest)


def run(spark: SparkSession, cloud: str, out: str, config: dict) -> DataFrame:
    """Clean the table at ``cloud`` into ``out``/points and ``out``/counts, and return the points as they are read back. An empty table
    gives empty ones."""
    with passing(spark):
        given = derived(spark.read.parquet(cloud), config["derive"]).select("pid", *[F.col(c).cast("double") for c in PLACE + NORMAL])
        judged = verdicts(given, config).withColumn("slab", F.coalesce(F.floor(F.col("z") / config["slab"]).cast("int"), F.lit(0)))
        schema = judged.schema
        judged.hint("rebalance", "verdict", "slab").write.mode("overwrite").partitionBy("verdict", "slab").parquet(f"{out}/points")
    points = spark.read.schema(schema).parquet(f"{out}/points")
    counts = points.groupBy("verdict", "slab").agg(F.count("*").alias("points"), F.avg("spacing").alias("spacing"))
    counts.coalesce(1).write.mode("overwrite").partitionBy("verdict").json(f"{out}/counts")  # a row a slab and verdict
    totals = {r.verdict: r.points for r in points.groupBy("verdict").agg(F.count("*").alias("points")).collect()}
    log.info("read %s: %d points; wrote %s: %s", cloud, sum(totals.values()), out, dict(sorted(totals.items())))
    return points


if __name__ == "__main__":
    command(__doc__.splitlines()[0], run, "clean_cloud.json", "cloud", "out")
