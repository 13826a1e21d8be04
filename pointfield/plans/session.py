"""Session factory and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "pointfield", cpus: int | None = None, **conf) -> SparkSession:
    """A local session with the settings the plans are written for (AQE on, UTC, Arrow on)."""
    cpus = cpus or os.cpu_count() or 4
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local master may go without: it gets a folder of this machine."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pointfield-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: Paths of scratch tables that the blocks around have written, innermost last.
_WRITTEN: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


def materialize(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder, partitioned ``by`` columns, and read it back: lineage ends there and lost
    executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _WRITTEN.get():
        _WRITTEN.get()[-1].append(path)
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more; frames of any other kind are left alone."""
    for df in tables:
        if path := getattr(df, "_scratch_path", None):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def passing(spark: SparkSession):
    """A block whose scratch tables are deleted at its end, failed or not, but for those given to the function that it yields: they
    pass to the block around."""
    mine, kept = [], []
    token = _WRITTEN.set((*_WRITTEN.get(), mine))

    def keep(*tables: DataFrame):
        kept.extend(p for t in tables if (p := getattr(t, "_scratch_path", None)))
        return tables[0] if len(tables) == 1 else tables

    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        _WRITTEN.reset(token)
        for path in mine:
            if path not in kept:
                _delete(spark, path)
        if _WRITTEN.get():
            _WRITTEN.get()[-1].extend(kept)
