import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import Row

from pointfield.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    windows = {}
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add("null" if item is None else str(item))
    sizes = {len(k) for k in windows}
    for d in docs:
        w, hit, found = words(d.text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if items := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= items
        yield d.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def shaped(df):
    return [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in df.collect()]


def key(r):
    return (r[0] is not None, *(x or 0 for x in r))


@pytest.fixture()
def tables(spark, sf, odd):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    more = spark.createDataFrame([(900, "beta GAMMA"), (901, "long"), (902, None), (903, ""), (904, "..."), (None, "Señor ¿qué 東京"), (900, "beta GAMMA"), (905, "long long long long long long")], "item_id bigint, text string")
    return spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd, allowMissingColumns=True), bench.union(more)


def test_equals_brute_force(tables):
    docs, bench = tables
    want = sorted(brute(docs.collect(), [tuple(r) for r in bench.collect()]), key=key)
    assert sorted(shaped(dc.find(docs, bench)), key=key) == want and sum(r[2] > 0 for r in want) > 3


def test_blocks_and_groups_change_nothing(tables, monkeypatch):
    docs, bench = tables
    docs = docs.limit(60)
    docs = docs.sparkSession.createDataFrame(docs.collect(), docs.schema)
    want = sorted(brute(docs.collect(), [tuple(r) for r in bench.collect()]), key=key)
    monkeypatch.setattr(dc, "COMPARED", 7)
    monkeypatch.setattr(dc, "GROUP_WORDS", 1500)
    assert sorted(shaped(dc.find(docs, bench)), key=key) == want


def test_hot_windows(spark):
    """Items that repeat a window, many items with one passage, and hashes that agree."""
    items = [(i, "one two three four five six seven eight nine ten " + f"tail{i % 7}") for i in range(200)] + [(300, "a b " * 500), (301, "a a a")]
    docs = [(1, "x one two three four five six seven eight nine ten y"), (2, "a b " * 300), (3, "a a"), (4, "b a a a b"), (5, "nine ten")]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(shaped(dc.find(d, b)), key=key) == sorted(brute(d.collect(), items), key=key)


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(dc, "_mixed", lambda x: x & np.uint64(3))
    rng = random.Random(1)
    items = [(str(i), " ".join(rng.choices("abcd", k=rng.randint(1, 30)))) for i in range(30)]
    texts = [" ".join(rng.choices("abcde", k=200)) for _ in range(5)]
    sizes, spans, found = dc._matches(texts, dc.Index(items, 10))
    want = list(brute([Row(doc_id=0, text=t) for t in texts], items))
    assert [(0, n, sum(s["end"] - s["start"] for s in x), len(f)) for n, x, f in zip(sizes, spans, found, strict=True)] == [w[:4] for w in want]


def test_empty(odd, none, spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert {r[2] for r in shaped(dc.find(odd, bench))} == {0} and dc.find(none, bench).count() == 0
