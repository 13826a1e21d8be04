"""Exact dedup: a persistent digest index, bucketed and sorted by digest.

New rows are reduced to (digest, id) without moving their texts, grouped per digest with map-side
partial aggregation, anti-joined against the index on the bucket column, and the digests that are
new are appended. Only DataFrame functions run.

Every addition is a batch with a name, and the index says which batch brought a digest. What a batch itself brought is not known to
it: a batch that is added again, say because the driver was lost after the append and before its result was written, gets
the same result and appends nothing twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, passing


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, 32 bytes; null counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class DigestIndex:
    """A catalog table (digest, keep_id, rows, batch), bucketed and sorted by digest.

    ``buckets`` is fixed when the table is made; it defaults to the session's shuffle partitions, so
    that the aggregation that feeds the table is already dealt out in its buckets. ``id_type`` is that of the ids; ``add`` refuses ids
    of another type.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.table, self.schema = spark, table, f"digest binary, keep_id {id_type}, rows bigint, batch string"
        if not spark.catalog.tableExists(table) and spark.catalog.tableExists(f"{table}_before"):
            spark.sql(f"alter table {table}_before rename to {table}")  # a compaction was cut off
        if not spark.catalog.tableExists(table):
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self._write(spark.createDataFrame([], self.schema), table)
        else:
            found = [r.data_type for r in spark.sql(f"describe extended {table}").collect() if r.col_name == "Num Buckets"]
            self.buckets = int(found[0])

    def _write(self, new: DataFrame, table: str) -> None:
        new.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Deduplicate ``df`` against the index and itself, append its new digests, and return one row per input row:
        (id, keep_id, group_size, kept, text_sha256).

        A digest that another batch has brought already drops every row with it; keep_id is then the indexed id. Otherwise the
        row with the largest id stays. Of repeated rows with that same id exactly one stays. A null id is the
        smallest. A null text equals the empty text. An empty input gives no rows and leaves the index as it is.
        group_size counts the rows of the input and those the index has counted before, in other batches. Other columns are ignored,
        whatever their names. Without a name the batch gets one of its own. A batch that is added again must hold the same rows.
        """
        if (have := df.schema[id_col].dataType) != (want := self.read().schema["keep_id"].dataType):
            raise TypeError(f"ids are {have.simpleString()}, the index holds {want.simpleString()}")
        batch = batch or uuid.uuid4().hex
        with passing(self.spark) as keep:
            rows = df.select(F.col(id_col).alias("_id"), digest(F.col(text_col)).alias("digest"))
            rows = keep(materialize(rows.withColumn("_uid", F.monotonically_increasing_id()), "digests"))
            groups = materialize(rows.groupBy("digest").agg(F.max(F.struct("_id", "_uid")).alias("_best"), F.count("*").alias("_n")), "digest-groups")
            others, own = self.read().where(F.col("batch") != batch), self.read().where(F.col("batch") == batch)
            fresh = materialize(groups.join(others.select("digest").hint("merge"), "digest", "left_anti"), "digest-fresh")
            known = groups.join(others.groupBy("digest").agg(F.max("keep_id").alias("_known_id"), F.sum("rows").alias("_known_n")).hint("merge"), "digest")
            decided = known.select("digest", F.col("_known_id").alias("_keep"), F.lit(None).cast("long").alias("_one"), (F.col("_n") + F.col("_known_n")).alias("_size"))
            decided = keep(materialize(decided.union(fresh.select("digest", "_best._id", "_best._uid", "_n")), "digest-decisions"))
            new = fresh.join(own.select("digest").hint("merge"), "digest", "left_anti")
            self._write(new.select("digest", F.col("_best._id").alias("keep_id"), F.col("_n").alias("rows"), F.lit(batch).alias("batch")), self.table)
        return rows.join(decided, "digest").select(
            F.col("_id").alias(id_col),
            F.col("_keep").alias("keep_id"),
            F.col("_size").alias("group_size"),
            F.coalesce(F.col("_uid") == F.col("_one"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )

    def compact(self) -> None:
        """One sorted file a bucket again, for after many additions. Readers of before must be done. The old table stays under another
        name until the new one has its own, and is taken back if that fails."""
        now, before = f"{self.table}_after", f"{self.table}_before"
        self.spark.sql(f"drop table if exists {now}")
        with passing(self.spark):  # read as a plain table: of a bucketed one the optimizer takes the shuffle to be done
            self._write(materialize(self.read(), "digest-index").repartition(self.buckets, "digest"), now)
        self.spark.sql(f"alter table {self.table} rename to {before}")
        self.spark.sql(f"alter table {now} rename to {self.table}")
        self.spark.sql(f"drop table {before}")

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.table}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    try:
        return index.add(documents(spark, sf_dir))
    finally:
        index.drop()  # the result reads its own tables


SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256
from d
"""
