"""Exact dedup and mixing against plain Python, on odd rows too."""

import hashlib
import uuid
from collections import defaultdict

import pytest

from pointfield.llm import exact_dedup, mixing


def test_dedup_rows(spark, odd, none):
    index = exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}")
    got = index.add(odd).collect()
    groups = defaultdict(list)
    for r in odd.collect():
        groups[hashlib.sha256((r.text or "").encode()).hexdigest()].append(r.doc_id)
    assert len(got) == odd.count()
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    assert index.add(none).count() == 0


def test_dedup_is_persistent(spark):
    name = f"t_{uuid.uuid4().hex}"
    df = lambda *r: spark.createDataFrame(list(r), "doc_id bigint, text string")
    exact_dedup.DigestIndex(spark, name).add(df((1, "a"), (2, "a"), (3, "b"))).collect()
    index = exact_dedup.DigestIndex(spark, name)
    got = {r.doc_id: r for r in index.add(df((9, "a"), (8, "c"), (7, "c"))).collect()}
    assert not got[9].kept and got[9].keep_id == 2 and got[9].group_size == 3
    assert got[8].kept and not got[7].kept and index.read().count() == 3


def test_dedup_batch_can_be_added_again(spark, odd):
    index = exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}")
    key = lambda r: repr(tuple(r))
    first = sorted(index.add(odd, batch="one").collect(), key=key)
    held = index.read().count()
    assert sorted(index.add(odd, batch="one").collect(), key=key) == first and index.read().count() == held
    assert not any(r.kept for r in index.add(odd, batch="two").collect()) and index.read().count() == held
    assert sorted(index.add(odd, batch="one").collect(), key=key) == first


def test_dedup_compaction(spark):
    name = f"t_{uuid.uuid4().hex}"
    index = exact_dedup.DigestIndex(spark, name, buckets=2)
    for i in range(3):
        index.add(spark.createDataFrame([(k, f"text {k}") for k in range(10 * i, 10 * i + 15)], "doc_id bigint, text string"))
    before = sorted(map(tuple, index.read().collect()))
    index.compact()
    assert sorted(map(tuple, index.read().collect())) == before and len(before) == 35
    assert len(index.read().inputFiles()) <= 2
    spark.sql(f"alter table {name} rename to {name}_before")  # as if the driver had been lost between the two renamings
    assert exact_dedup.DigestIndex(spark, name).read().count() == 35
    again = exact_dedup.DigestIndex(spark, name).add(spark.createDataFrame([(1, "text 3")], "doc_id bigint, text string")).collect()
    assert [(r.keep_id, r.kept) for r in again] == [(3, False)]
    index.drop()
    assert not spark.catalog.tableExists(name)


def test_dedup_refuses_other_ids(spark):
    index = exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}")
    with pytest.raises(TypeError):
        index.add(spark.createDataFrame([("x", "a")], "doc_id string, text string"))
    named = exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", id_type="string")
    assert named.add(spark.createDataFrame([("x", "a"), ("y", "a")], "doc_id string, text string")).where("kept").first().doc_id == "y"


def test_query_leaves_no_table(spark, sf):
    before = {t.name for t in spark.catalog.listTables()}
    assert exact_dedup.query(spark, sf).count() and {t.name for t in spark.catalog.listTables()} == before


def brute_targets(sizes, weights=(5, 2, 1), ratio=1.5, epochs=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = ratio * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > epochs * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in open_}
            break
        for s in over:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark, sf, odd, none):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        got = mixing.mix(docs).collect()
        again = mixing.mix(docs.repartition(7)).collect()
        key = lambda r: tuple((x is not None, x or 0) for x in r if not isinstance(x, str)) + (r.source or "",)
        assert sorted(got, key=key) == sorted(again, key=key)
        sizes, taken = defaultdict(int), defaultdict(int)
        for r in got:
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            assert 0 <= r.taken <= 2 * r.size
        want = brute_targets(sizes)
        for r in got:
            assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and abs(taken[r.source] - r.target) <= 0.5
        assert len(got) == docs.count()
    assert mixing.mix(none).count() == 0


def test_rows_of_one_id_and_size(spark):
    """The border falls among rows that only a hash of the row tells apart; one id holds most rows."""
    rows = [(None, f"w{i} w{i} w{i}", "a", i) for i in range(40)] + [(None, "same same", "a", 0)] * 9 + [(i, f"x{i} y", "b", i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _size int")
    got = mixing.mix(docs).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = brute_targets({"a": 40 * 3 + 18, "b": 600})
    assert len(got) == len(rows) and all(abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 0.5 for s in want)
    once = sorted(map(tuple, mixing.mixed(docs).collect()), key=repr)
    assert once == sorted(map(tuple, mixing.mixed(docs.repartition(5)).collect()), key=repr)
    words = defaultdict(int)
    for r in once:
        words[r[2]] += len(r[1].split())
    assert all(abs(words[s] - want[s]) <= 3 for s in want)


def test_mixed_keeps_columns_of_any_name(spark):
    names = ("_size", "_rank", "_bucket", "_copy", "_taken", "_row", "_of", "col", "target", "a.b")
    docs = spark.createDataFrame([(i, f"some words {i}", "s", *range(90, 100)) for i in range(20)], "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    got = mixing.mixed(docs)
    assert got.columns == docs.columns and {tuple(r)[3:] for r in got.collect()} == {tuple(range(90, 100))}
    assert mixing.mixed(docs.limit(0)).count() == 0
