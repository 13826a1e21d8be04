import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pointfield.llm import token_files as tf

LIB = Tokenizer.from_file(tf.default_vocabulary())
ENC = tf.Encoder(tf.default_vocabulary())


def ids(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("aB é ñßÿ½²_'stlve19 \n\t.,!-“東\x1c ")), max_size=40))
def test_encoder_equals_the_library(text):
    assert np.frombuffer(ENC(text), ENC.dtype).tolist() == ids(text)


def test_special_strings_as_the_library_takes_them():
    assert ids("x <|endoftext|> y") == [87, 220, 50256, 331]
    for text in ("x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext|", "<|startoftext|>"):
        assert np.frombuffer(ENC(text), ENC.dtype).tolist() == ids(text)


def brute(docs):
    at, out = 0, []
    for d in sorted(docs, key=lambda d: (d.doc_id is not None, d.doc_id or 0, d.text or "")):
        x = np.array([*ids(d.text), tf.END_ID], "<u4")
        out.append((d.doc_id, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    return out


def key(r):
    return (r[0] is not None, *(x or 0 for x in r))


def test_round_trip(spark, sf, odd, none):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        got = [tuple(r) for r in tf.write_and_read(docs, length=64).collect()]
        assert sorted(got, key=key) == sorted(brute(docs.collect()), key=key)
    assert tf.write_and_read(none).count() == 0


def test_random_access(spark, sf, tmp_path):
    import pyarrow as pa

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = tf.write(docs, f"file://{tmp_path}/t", tf.default_vocabulary(), length=128, shards=3).orderBy("shard").collect()
    stream = [i for d in sorted(docs.collect(), key=lambda d: d.doc_id) for i in [*ids(d.text), tf.END_ID]]
    for r in rows:
        with pa.memory_map(f"{tmp_path}/t/{r.path}") as m:
            f = pa.ipc.open_file(m)
            b = f.get_batch(0)
            assert b.column("input_ids")[1].as_py() == stream[r.start + 128 : r.start + 256]
            assert sum(sum(x.as_py()) for i in range(f.num_record_batches) for x in f.get_batch(i).column("mask")) == r.n_tokens


def test_one_id_on_all_rows(spark):
    rows = [(None, f"text {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    manifest = tf.write(docs, f"{tf.scratch_dir(spark)}/tokens-one-id", tf.default_vocabulary(), shards=4)
    assert sorted(r.n_docs for r in manifest.collect()) == [10] * 4
    got = tf.read(manifest, f"{tf.scratch_dir(spark)}/tokens-one-id").collect()
    crc = lambda t: zlib.crc32(np.array([*ids(t), tf.END_ID], "<u4").tobytes())
    assert sorted(r.ids_crc32 for r in got) == sorted(crc(t) for _, t in rows) and {r.doc_id for r in got} == {None}


def test_folding_changes_nothing(spark, odd):
    docs = odd.union(odd).union(odd.limit(3)).select("doc_id", "text").coalesce(1).sortWithinPartitions("text")
    got = [tuple(r) for r in tf.write_and_read(docs, length=64, fold=True).collect()]
    assert sorted(got, key=key) == sorted(brute(docs.collect()), key=key)
