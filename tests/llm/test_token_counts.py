import math
from collections import Counter

import pytest

from pointfield.llm import token_counts as tc


def viterbi(word, table, byte):
    """Best (score, -tokens) over all cuts, by memo over suffix positions: no trie, no sharing."""
    best = {0: (0.0, 0)}
    longest = max(map(len, table))
    for d in range(1, len(word) + 1):
        options = [(best[s][0] + table[word[s:d]], best[s][1] - 1) for s in range(max(0, d - longest), d) if word[s:d] in table]
        if word[d - 1] not in table:
            n = len(word[d - 1].encode())
            options.append((best[d - 1][0] + n * byte, best[d - 1][1] - n))
        best[d] = max(options)
    return -best[len(word)][1]


def cuts(word, table, byte):
    """(pieces, log probability) of every cut."""
    if not word:
        yield [], 0.0
    for d in range(1, len(word) + 1):
        if word[:d] in table:
            for rest, p in cuts(word[d:], table, byte):
                yield [word[:d], *rest], table[word[:d]] + p
        elif d == 1:
            for rest, p in cuts(word[1:], table, byte):
                yield rest, p + byte * len(word[0].encode())


@pytest.fixture(scope="module")
def table(spark):
    return tc.fitted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_expected_counts_against_all_cuts():
    t = {"▁": -1.0, "a": -1.5, "b": -2.0, "ab": -1.7, "▁a": -1.2, "aba": -2.5}
    for word in ("▁ab", "▁abab", "▁aéba", "é", "▁" + "ab" * 5):
        every = list(cuts(word, t, -20.0))
        total = sum(math.exp(p) for _, p in every)
        want = Counter()
        for some, p in every:
            for x in some:
                want[x] += 3 * math.exp(p) / total
        got: dict = {}
        tc.expected(word, t, 3, -20.0, 3, got)
        assert {k: v for k, v in got.items() if v > 1e-12} == pytest.approx({k: v for k, v in want.items() if v > 1e-12})


def test_fitting(spark, sf, table, none):
    some = tc.pieces(tc.default_vocabulary())
    assert list(table) == some and math.isclose(sum(map(math.exp, table.values())), 1, rel_tol=1e-6)
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    def likelihood(t):
        byte, longest = min(t.values()) - tc.PENALTY, max(map(len, t))
        out = 0.0
        for r in words:
            front = [0.0]
            for d in range(1, len(r.word) + 1):
                v = [front[s] + t[r.word[s:d]] for s in range(max(0, d - longest), d) if r.word[s:d] in t]
                if r.word[d - 1] not in t:
                    v.append(front[-1] + byte * len(r.word[d - 1].encode()))
                front.append(max(v) + math.log(sum(math.exp(x - max(v)) for x in v)))
            out += r.n * front[-1]
        return out

    words = tc.sample(docs).collect()
    pre = Counter(w for d in docs.select("text").distinct().collect() if d.text for w in tc._PRE.findall(d.text))
    assert {r.word: r.n for r in words} == {"▁" + w: n for w, n in pre.items()}
    one, two = (tc.fitted(docs, rounds=k) for k in (1, 2))
    assert likelihood(tc.zipf(some)) < likelihood(one) < likelihood(two) < likelihood(table)
    assert tc.fitted(docs) == table and tc.fitted(none) == tc.zipf(some)
    hot = docs.limit(3).select("text").unionAll(spark.createDataFrame([("again",)] * 4000, "text string"))
    assert tc.sample(hot, 4003).where("word = '▁again'").first().n == 1


def test_counts(spark, sf, odd, none, table):
    byte = min(table.values()) - tc.PENALTY
    memo = {}

    def brute(text):
        got = [memo.setdefault(w, viterbi(tc.MARK + w, table, byte)) if w not in memo else memo[w] for w in tc._PRE.findall(text or "")]
        return len(got), sum(got)

    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        rows = docs.collect()
        got = tc.count(docs, table).collect()
        key = lambda r: (r[0] is not None, *(x or 0 for x in r))
        assert sorted(map(tuple, got), key=key) == sorted(((d.doc_id, *brute(d.text)) for d in rows), key=key)
    assert tc.count(none, table).count() == 0


def test_store_is_bounded(monkeypatch):
    monkeypatch.setattr(tc, "CACHE", 3)
    monkeypatch.setattr(tc, "LONG", 8)
    m = tc.Unigram({"▁": -1.0, "a": -1.0, "b": -2.0, "ab": -1.5, "▁a": -1.2, "abab": -2.0})
    for text in ("a b ab ba", "aab abab ab", "a é b", "ab", "ababab" * 30 + " a", "abababa abababab " + "é" * 9 + " ab"):
        assert m.count([text])[1] == [sum(viterbi("▁" + w, m.table, m.byte) for w in text.split())]
        assert all(len(w) < 8 for w in m.counts)


def test_many_words_at_once_expect_what_one_does(table):
    words = ["▁", "▁ab", "▁the", "▁thethe", "é", "▁é中😀zq" * 4, "▁" + "中" * 47, "x" * 60, "", "▁a\ud800b", *("▁" + "ab" * k for k in range(1, 30))]
    times = [1 + i % 5 for i in range(len(words))]
    for some in (table, {"a": -1.0, "ab": -3.0, "▁": -2.0}, {}):
        cuts = tc.Cuts(some)
        got, want = [0.0] * len(some), {}
        got = tc.np.array(got)
        cuts.add(words, times, got)
        for w, n in zip(words, times, strict=True):
            if w:
                tc.expected(w, some, max(map(len, some), default=0), cuts.byte, n, want)
        assert got.tolist() == pytest.approx([want.get(k, 0.0) for k in some], rel=1e-9, abs=1e-12)


def test_the_fit_reads_every_distinct_text(spark):
    """More distinct texts than the 2,000 that it was once fitted on."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('w', id, ' same') AS text")
    words = {r.word: r.n for r in tc.sample(docs.unionAll(docs.limit(50))).collect()}
    assert words == {f"▁w{i}": 1 for i in range(3000)} | {"▁same": 3000}


def test_many_words_at_once_are_cut_as_one_is(table):
    """Ties go to fewer tokens; characters without a piece take their bytes."""
    words = ["▁", "▁ab", "▁the", "▁thethe", "é", "▁é中😀zq" * 4, "▁" + "中" * 47, *("▁" + "ab" * k for k in range(1, 24))]
    for some in (table, {"a": -1.0, "b": -1.0, "ab": -2.0, "abab": -4.0, "▁": -2.0}):
        cuts = tc.Cuts(some)
        assert cuts.best(words).tolist() == [viterbi(w, some, cuts.byte) for w in words]
