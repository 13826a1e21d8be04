"""Each stage of the pipeline against brute force on its own input."""

import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from pointfield.llm import mixing
from pointfield.llm.common import materialize

from .test_decontamination import brute as brute_hits
from .test_language_id import Brute
from .test_ngram_join import brute as brute_groups
from .test_token_files import brute as brute_tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, f in cp.STAGES:
        docs.append(materialize(f(spark, docs[-1], SF), name))
    return docs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_columns(stages):
    for df in stages[:-1]:
        assert df.dtypes == stages[0].dtypes


def test_language(stages):
    brute = Brute([(d.lang, d.text) for d in stages[0].collect() if d.lang is not None and zlib.crc32(str(d.doc_id).encode()) % 3 != 1])
    want = [r for r in rows(stages[0]) if (p := brute.predict(r[1])) and p[0] != "und" and p[1] >= cp.MIN_SCORE]
    assert rows(stages[1]) == want


def test_near_copies(stages):
    got = rows(stages[1])
    groups = brute_groups([(r[0], r[1]) for r in got], 5, 80, 100)
    assert rows(stages[2]) == [r for r, (d, n, least) in zip(got, groups, strict=True) if d == least]
    assert len(rows(stages[2])) < len(got)


def test_decontamination(stages, spark):
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {d for d, _, n, _, _ in brute_hits(stages[2].collect(), bench) if n}
    assert hit and rows(stages[3]) == [r for r in rows(stages[2]) if r[0] not in hit]


def test_mixing(stages):
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix(stages[3]).collect()}
    want = []
    for r in rows(stages[3]):
        size, n = taken[r[0]]
        want += [r] * (int(n / size + 0.5) if size else 0)
    assert rows(stages[4]) == want
    words, target = Counter(), {}
    for r in mixing.mix(stages[3]).collect():
        target[r.source] = r.target
    for r in stages[4].collect():
        words[r.source] += len([w for w in r.text.split() if w])
    longest = defaultdict(int)
    for r in stages[3].collect():
        longest[r.source] = max(longest[r.source], len(r.text.split()))
    assert all(abs(words[s] - t) <= longest[s] for s, t in target.items())


def test_tokens(stages):
    key = lambda r: tuple(x or 0 for x in r)
    assert sorted(map(tuple, stages[5].collect()), key=key) == sorted(brute_tokens(stages[4].collect()), key=key)


def test_stages_on_odd_rows(spark, odd, none):
    frame = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, f in cp.STAGES:
        assert f(spark, frame, SF).count() >= 0 and f(spark, none.select(*frame.columns), SF).count() == 0
    one = cp.deduplicated(spark, frame, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in one) == sorted([(False, 1), (False, 3), (False, 4), (True, 0), (False, 5), (False, 6), (False, 7)])


def test_entry_has_it():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and [n for n in names if n.startswith("op")] and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_columns_of_any_name(spark, odd):
    names = ("lang_pred", "score", "n_words", "spans", "items", "_size", "_h", "c1", "a.b")
    docs = spark.createDataFrame([(*r[:4], *range(9)) for r in odd.collect() if r.doc_id is not None], "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in names))
    for _, f in cp.STAGES[:-1]:
        got = f(spark, docs, SF)
        assert got.columns == docs.columns and {tuple(r)[4:] for r in got.collect()} <= {tuple(range(9))}
