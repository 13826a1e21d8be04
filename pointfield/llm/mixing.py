"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Every source wants its weight's share of the mix. A source whose share exceeds its maximum of epochs is
clamped there and what it can't give is dealt to the others by weight, until none exceeds its maximum. The
fixed point is found without iteration: with the sources ordered by cap/weight, the clamped ones are a prefix,
and the water level of the rest is (total - caps of the prefix) / (weights of the rest).

Sampling is seeded and exact. Within a source the documents stand in the order of a seeded digest. Each is
taken a whole number of times, and the remaining words of the target are taken from the front of that order;
the document at the border is taken in part. The border is found from sums: first per digest bucket, then, inside the one bucket
per source that holds it, per digest and size. A row is decided by comparing it with its source's border; only rows that are equal
to it in digest and size, as rows of one id can be, are ever numbered, so no task gets a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, passing

#: Weights dealt to the sources in code point order, again and again.
WEIGHTS = (5, 2, 1)
#: Words of the mix for each word of the input; most repetitions of a source.
MIX_RATIO, MAX_EPOCHS = 1.5, 2
SEED = 17
#: The table of sources (about 100 bytes a row) is broadcast up to so many rows; beyond, a sort-merge join that AQE may split.
BROADCAST_SOURCES = 50_000
#: Hex digits of the digest that make a bucket.
BUCKET_DIGITS = 4


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, ratio: float = MIX_RATIO, epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with its weight and target. One row per source; null is a source, the last."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * epochs
    level = Window.orderBy("_fill", F.col("source").asc_nulls_last())
    before, every = level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    out = (
        sizes.withColumn("weight", w)
        .withColumn("_cap", cap.cast("double"))
        .withColumn("_fill", F.col("_cap") / F.col("weight"))
        .withColumn("_left", F.lit(float(ratio)) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_level", F.col("_left") / F.col("_open"))
    )
    first = F.min(F.when(F.col("_level") <= F.col("_fill"), F.struct("_fill", F.col("source").isNull(), "source", "_level"))).over(every)
    water = F.coalesce(first["_level"], F.lit(float("inf")))
    return out.withColumn("target", F.least("_cap", water * F.col("weight"))).select("source", "source_size", "weight", "target")


def _rank(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))


def _plan(sizes: DataFrame, weights, ratio: float, epochs: float) -> DataFrame:
    """One row per source: _of, _source_size, _target, _whole, _rest and the border (_edge_rank, _edge_size, _ahead, _equal) where the rest
    ends, or none. ``sizes``: (source, _size, _rank), a row per document."""
    sized = sizes.withColumn("_bucket", F.substring("_rank", 1, BUCKET_DIGITS))
    buckets = materialize(sized.groupBy("source", "_bucket").agg(F.sum("_size").alias("_n")), "mix-buckets")
    plan = targets(buckets.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, ratio, epochs)
    plan = plan.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    plan = plan.withColumn("_rest", F.floor(F.col("target") + 0.5) - F.col("_whole") * F.col("source_size"))
    plan = materialize(plan.select(F.col("source").alias("_of"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_whole", "_rest"), "mix-targets")
    order = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = buckets.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    border = sums.join(plan, F.col("source").eqNullSafe(F.col("_of"))).where((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_n")))
    border = materialize(border.select("_of", "_rest", F.col("_bucket").alias("_at"), "_before"), "mix-borders")
    inside = sized.join(_maybe_broadcast(border), F.col("source").eqNullSafe(F.col("_of")) & (F.col("_bucket") == F.col("_at")))
    inside = inside.groupBy("_of", "_rank", "_size").agg(F.count("*").alias("_equal"), F.first("_rest").alias("_rest"), F.first("_before").alias("_before"))
    run = Window.partitionBy("_of").orderBy("_rank", "_size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_ahead", F.col("_before") + F.coalesce(F.sum(F.col("_equal") * F.col("_size")).over(run), F.lit(0)))
    inside = inside.where((F.col("_ahead") <= F.col("_rest")) & (F.col("_rest") < F.col("_ahead") + F.col("_equal") * F.col("_size")))
    edges = inside.select(F.col("_of").alias("_edge_of"), F.col("_rank").alias("_edge_rank"), F.col("_size").alias("_edge_size"), "_ahead", "_equal")
    return materialize(plan.join(edges, F.col("_of").eqNullSafe(F.col("_edge_of")), "left").drop("_edge_of"), "mix-plan")


def _maybe_broadcast(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def _taken(rows: DataFrame, plan: DataFrame, tie: Column) -> DataFrame:
    """``rows`` (with source, _size, _rank) with the plan's columns and _taken. ``tie`` orders rows of one digest and size."""
    found = rows.join(_maybe_broadcast(plan), F.col("source").eqNullSafe(F.col("_of")))
    row, edge = F.struct("_rank", "_size"), F.struct(F.col("_edge_rank").alias("_rank"), F.col("_edge_size").alias("_size"))
    alone = F.when(F.col("_edge_rank").isNull() & (F.col("_rest") > 0), F.col("_size")).when(row < edge, F.col("_size")).when(row == edge, F.least("_size", F.col("_rest") - F.col("_ahead"))).otherwise(F.lit(0))
    whole = F.col("_whole") * F.col("_size")
    many = F.coalesce((row == edge) & (F.col("_equal") > 1), F.lit(False))
    out = found.where(~many).withColumn("_taken", whole + alone)
    if not plan.where("_equal > 1").isEmpty():
        turn = F.row_number().over(Window.partitionBy("source").orderBy("_tie")) - 1
        shared = found.where(many).withColumn("_tie", tie)
        part = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - F.col("_ahead") - turn * F.col("_size")))
        out = out.unionByName(shared.withColumn("_taken", whole + part).drop("_tie"))
    return out


def mix(docs: DataFrame, weights=WEIGHTS, ratio: float = MIX_RATIO, epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """One row per document: (id, source, size, source_size, target, taken).

    taken counts words, repetitions included; the taken words of a source sum to its target, rounded. Documents
    without words or text have size 0 and are taken 0 times. Repeated rows count each on its own; a null id is an
    id like any other, a null source is a source of its own. Other columns are ignored, whatever their names. An empty input gives no rows.
    """
    with passing(docs.sparkSession) as keep:
        base = docs.select(F.col(id_col).alias("_key"), F.col("source").alias("source"), words(F.col("text")).alias("_size"), _rank(F.col(id_col), seed).alias("_rank"))
        base = keep(materialize(base, "mix-sizes"))
        out = _taken(base, keep(_plan(base, weights, ratio, epochs)), F.lit(0))
    return out.select(F.col("_key").alias(id_col), "source", *[F.col(f"_{c}").alias(c) for c in ("size", "source_size", "target", "taken")])


def mixed(docs: DataFrame, weights=WEIGHTS, ratio: float = MIX_RATIO, epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; of the one document per source that is taken in part a whole copy
    is given if at least half of it is taken. Documents without words or text are in no mix. The texts are not shuffled, and read twice.

    Null ids and sources are ids and a source like others; repeated rows count each on its own, and rows of one id and size stand in the
    order of a hash of the whole row, so reruns agree. All columns of ``docs`` come back as they are, whatever their names. An empty input
    gives no rows."""
    facts = [F.col("source").alias("source"), words(F.col("text")).alias("_size"), _rank(F.col(id_col), seed).alias("_rank")]
    with passing(docs.sparkSession) as keep:
        sizes = materialize(docs.select(*facts), "mix-sizes")
        plan = keep(_plan(sizes, weights, ratio, epochs))
    out = _taken(docs.select(F.struct("*").alias("_row"), *facts), plan, F.xxhash64("_row")).where("_size > 0")
    times = F.floor(F.col("_taken") / F.col("_size") + 0.5).cast("int")
    return out.select("_row", F.explode(F.array_repeat(F.lit(0), times))).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
                  md5('17:' || coalesce(cast(doc_id as varchar), 'null')) as rnk from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, (array[5, 2, 1])[((row_number() over (order by source nulls last) - 1) % 3) + 1] as weight,
             cast(source_size * 2 as double) as cap from s),
f as (select *, cap / weight as fill from w),
g as (select *, (1.5e0 * cast(sum(source_size) over () as double)
                   - coalesce(cast(sum(cap) over (order by fill, source nulls last rows between unbounded preceding and 1 preceding) as double), 0e0))
                / cast(sum(weight) over () - coalesce(sum(weight) over (order by fill, source nulls last rows between unbounded preceding and 1 preceding), 0) as double) as lev,
             row_number() over (order by fill, source nulls last) as rn from f),
v as (select lev as water from g where lev <= fill order by rn limit 1),
t as (select source, source_size, least(cap, coalesce((select water from v), 'infinity'::double) * weight) as target from g),
p as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from t),
q as (select *, cast(floor(target + 0.5e0) as bigint) - whole * source_size as rest from p),
r as (select d.*, q.source_size, q.target, q.whole, q.rest,
             coalesce(sum(d.size) over (partition by d.source order by d.rnk, d.size rows between unbounded preceding and 1 preceding), 0) as ahead
      from d join q on d.source is not distinct from q.source)
select doc_id, size, source_size, target, cast(whole * size + greatest(0, least(size, rest - ahead)) as bigint) as taken from r
"""
