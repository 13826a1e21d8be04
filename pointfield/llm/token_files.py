"""Token-ID output in the Arrow file format: fixed-size-list batches of equal-length sequences and their masks.

Documents are encoded where they are read; what is shuffled are their ids, of two bytes each under a vocabulary of up to 65,536 pieces. They
are dealt by ranges of their document id and sorted, so that the shards, taken in order, hold the stream in ascending order. Each
task writes its shard as it reads: the stream of ids is cut into sequences of equal length, the last one padded and masked, and a
second file lists where the shard's documents lie. Any sequence is reached by its number without copying. A task that is run again
writes files of another name; only those that the manifest names count.
"""

from __future__ import annotations

import re
import uuid
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, per_worker, scratch_dir, short_batches, text_slices, tidied

SEQUENCE, ROWS = 1024, 256
END_ID = 2
#: Pre-tokens that a worker remembers at most, and the characters of the longest of them.
CACHE, LONG = 500_000, 48

# The pre-token pattern of the byte-level vocabulary, in the form that agrees with it on the characters of _PLAIN.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NOT_PLAIN = "[^\t\n\r -~¡-±´-¸º»¿-ɏ]"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder(dict):
    """Text to the bytes of its ids, as the library's encode without added special tokens gives them. The library encodes each
    distinct short pre-token once; texts with characters on which the pattern might differ, or with a string that the vocabulary
    treats as one token whatever stands around it, are encoded by the library as a whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        whole = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([_NOT_PLAIN, *whole]))

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __missing__(self, piece: str) -> bytes:
        out = self._ids(piece)
        if len(piece) <= LONG:
            self[piece] = out
        return out

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.whole.search(text):
            return self._ids(text)
        if len(self) > CACHE:
            self.clear()
        return b"".join(map(self.__getitem__, _SPLIT.findall(text)))


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


class _Shard:
    """Writes a stream of ids as sequences; holds at most one batch of them."""

    def __init__(self, out, dtype: np.dtype, length: int):
        self.dtype, self.length, self.n = dtype, length, 0
        self.schema = _schema(dtype, length)
        self.file = pa.ipc.new_file(out, self.schema)
        self.held: list[bytes] = []
        self.size = 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.n += len(ids) // self.dtype.itemsize
        if self.size >= self.length * ROWS * self.dtype.itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        whole = len(ids) // self.length * self.length if not last else len(ids)
        step = self.length * ROWS
        for at in range(0, whole if last else whole // step * step, step):
            part = ids[at : at + step]
            mask = np.ones(-(-len(part) // self.length) * self.length, bool)
            mask[len(part) :] = False
            full = np.zeros(len(mask), self.dtype)
            full[: len(part)] = part
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((full, mask), self.schema, strict=True)]
            self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        rest = b"" if last else ids[whole // step * step :].tobytes()
        self.held, self.size = [rest], len(rest)

    def close(self) -> None:
        self._flush(True)
        self.file.close()


def _runs(ids: pa.Array, texts: pa.Array, fold: bool) -> np.ndarray:
    """Where runs of equal rows begin; without ``fold`` every row is one."""
    n = len(ids)
    if not fold or not n:
        return np.arange(n)
    same = pc.and_(pc.equal(texts.slice(1), texts.slice(0, n - 1)), pc.fill_null(pc.equal(ids.slice(1), ids.slice(0, n - 1)), False))
    return np.flatnonzero(np.concatenate([[True], ~same.to_numpy(zero_copy_only=False).astype(bool)]))


def _edges(rows: DataFrame, n: int) -> list[tuple]:
    """The greatest (id is there, id, tie) of each of n ranges with about as many rows; one row per range comes to the driver."""
    dealt = rows.select("_id", "_tie").repartitionByRange(n, "_id", "_tie")
    last = dealt.groupBy(F.spark_partition_id()).agg(F.max(F.struct("_id", "_tie")).alias("e")).select("e.*").collect()
    return sorted((r[0] is not None, r[0], r[1]) for r in last)[:-1]


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, length: int = SEQUENCE, shards: int | None = None, fold: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` below ``folder`` and return the manifest: (shard, path, docs_path, n_docs, n_tokens, start).

    ``folder`` is a URI that executors reach (file of a shared mount, or any store that Arrow's file systems know).
    Null texts count as empty and give the end id alone. Null ids come first; rows with one id follow each other by a hash of
    their texts, so that even one id on very many rows is dealt to several shards. An empty input gives an empty manifest. Other
    columns are ignored, whatever their names. ``fold`` sends repeated rows that stand together, as a mix makes them, through the
    encoder and the shuffle once; the files are the same.
    """
    spark = docs.sparkSession
    short_batches(spark)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_tie", F.xxhash64("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    edges = _edges(rows, n)
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    id_type = pa.int64() if kind in ("bigint", "int", "smallint", "tinyint") else pa.string()

    def encode(batches):
        encoder = per_worker(("encoder", vocabulary), lambda: Encoder(vocabulary))
        end = np.array([end_id], encoder.dtype).tobytes()
        for whole in batches:
            for b in text_slices(whole, "_text"):
                at = _runs(b.column(0), b.column(1), fold)
                copies = np.diff(np.append(at, b.num_rows))
                b = b.take(pa.array(at))
                shard = [bisect_left(edges, (i is not None, i, t)) for i, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
                ids = [encoder(t) + end for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), b.column(0), b.column(2), pa.array(ids, pa.binary()), pa.array(copies, pa.int64())], names=["_shard", "_id", "_tie", "_ids", "_copies"])

    dealt = rows.select("_id", "_text", "_tie").mapInArrow(tidied(encode), f"_shard int, _id {kind}, _tie bigint, _ids binary, _copies bigint")
    dealt = dealt.repartitionById(n, F.col("_shard")).sortWithinPartitions("_id", "_tie", "_ids").select("_id", "_ids", "_copies")

    def work(batches):
        shard = docs_file = None
        n_docs = 0
        ctx = TaskContext.get()
        name = f"{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        outs = None
        for whole in batches:
            for b in text_slices(whole, "_ids"):
                if shard is None:
                    where, base = pafs.FileSystem.from_uri(folder)
                    dtype = per_worker(("encoder", vocabulary), lambda: Encoder(vocabulary)).dtype
                    outs = [where.open_output_stream(f"{base}/{kind}-{name}.arrow") for kind in ("tokens", "docs")]
                    shard = _Shard(outs[0], dtype, length)
                    docs_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                    docs_file = pa.ipc.new_file(outs[1], docs_schema)
                starts, sizes, copies = [], [], b.column(2).to_pylist()
                for ids, times in zip(b.column(1).to_pylist(), copies, strict=True):
                    for _ in range(times):
                        before = shard.n
                        shard.add(ids)
                        starts.append(before)
                        sizes.append(shard.n - before)
                n_docs += len(starts)
                named = b.column(0).take(pa.array(np.repeat(np.arange(len(copies)), copies)))
                docs_file.write_batch(pa.RecordBatch.from_arrays([named.cast(id_type), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=docs_schema))
        if shard is not None:
            shard.close()
            docs_file.close()
            for o in outs:
                o.close()
            yield pa.RecordBatch.from_pylist([{"shard": ctx.partitionId(), "path": f"tokens-{name}.arrow", "docs_path": f"docs-{name}.arrow", "n_docs": n_docs, "n_tokens": shard.n}])

    manifest = materialize(dealt.mapInArrow(tidied(work), "shard bigint, path string, docs_path string, n_docs bigint, n_tokens bigint"), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""

    def work(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for row in b.to_pylist():
                with fs.open_input_file(f"{root}/{row['path']}") as f, fs.open_input_file(f"{root}/{row['docs_path']}") as g:
                    tokens, listed = pa.ipc.open_file(f), pa.ipc.open_file(g)
                    ids, have, k = np.empty(0, np.uint32), 0, 0
                    for i in range(listed.num_record_batches):
                        part = listed.get_batch(i)
                        crcs = []
                        for size in part.column("n_tokens").to_pylist():
                            crc = 0
                            while size:
                                if have == len(ids):
                                    t = tokens.get_batch(k)
                                    k += 1
                                    mask = t.column("mask").flatten().to_numpy(zero_copy_only=False)
                                    ids, have = t.column("input_ids").flatten().to_numpy()[mask].astype("<u4"), 0
                                take = min(size, len(ids) - have)
                                crc = zlib.crc32(ids[have : have + take], crc)
                                have, size = have + take, size - take
                            crcs.append(crc)
                        starts = np.asarray(part.column("start")) + row["start"]
                        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(starts, pa.int64()), part.column("n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n).mapInArrow(tidied(work), f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_and_read(docs: DataFrame, vocabulary: str | None = None, folder: str | None = None, **options) -> DataFrame:
    folder = folder or f"{scratch_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read(write(docs, folder, vocabulary or default_vocabulary(), **options), folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(documents(spark, sf_dir))
