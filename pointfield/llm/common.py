"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pointfield.plans.session import drop, materialize, passing, scratch_dir  # noqa: F401

#: Bytes of text that one Python batch works on at a time.
BATCH_BYTES = 4 << 20
#: Rows that an Arrow batch holds at most.
BATCH_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def short_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few enough rows that batches of long texts stay small on both sides of the pipe."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds at most ``limit`` bytes of text, or a single row."""
    col = batch.column(batch.schema.get_field_index(column))
    start = held = 0
    for i in range(len(col)):
        size = len(col[i].as_buffer()) if col[i].is_valid else 0
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(col):
        yield batch.slice(start)


def per_worker(key: tuple, make: Callable):
    """What ``make`` gives, kept in this Python process for the tasks to come; the last key's alone, so that an idle worker
    does not hold what earlier stages needed."""
    kept = sys.modules.setdefault("_pointfield_worker", types.ModuleType("_pointfield_worker")).__dict__
    if kept.get("key") != key:
        kept["made"] = None
        tidy()
        kept["key"], kept["made"] = key, make()
    return kept["made"]


def tidy() -> None:
    """Give freed memory back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def tidied(work: Callable) -> Callable:
    """A partition function that tidies up when it has ended."""

    def run(batches):
        yield from work(batches)
        tidy()

    return run
