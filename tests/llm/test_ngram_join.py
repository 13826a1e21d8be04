import random

import numpy as np
import pytest

from pointfield.llm import graph
from pointfield.llm import ngram_join as nj


def brute(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ")
        w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)]


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def check(df, k, num, den):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = [tuple(r)[:3] for r in nj.join(df, k, num, den).collect()]
    want = brute(rows, k, num, den)
    assert sorted(got, key=key) == sorted(want, key=key)
    return want


@pytest.fixture()
def near(spark):
    """Chains and groups of near copies around both thresholds, short texts, and phrases that most texts share."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    common = [rng.choices(vocabulary, k=4) for _ in range(6)]
    rows = []
    for g in range(40):
        base = rng.choices(vocabulary, k=rng.choice([3, 4, 5, 8, 9, 10, 11, 12, 30, 60, 150, 400]))
        for _ in range(rng.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(w) + 1)
                w[at:at] = rng.choice(common) if len(w) > 20 else []
            if rng.random() < 0.3:
                w = w[: -rng.randint(1, 3)] or w
            rows.append((len(rows) * 7 % 1009, " ".join(w).upper() if rng.random() < 0.2 else "\n".join(w)))
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize("k, num, den", [(3, 90, 100), (5, 80, 100), (1, 80, 100), (2, 50, 100)])
def test_equals_brute_force(near, k, num, den, monkeypatch):
    want = check(near, k, num, den)
    assert len({r[2] for r in want}) < len(want)


@pytest.mark.parametrize("keys", [0, 50_000])
def test_frequent_shingles_and_blocks(near, monkeypatch, keys):
    monkeypatch.setattr(nj, "OPEN_KEYS", keys)
    monkeypatch.setattr(nj, "FREQUENT", 2)
    monkeypatch.setattr(nj, "BLOCK_DOCS", 4)
    monkeypatch.setattr(nj, "BLOCK_SHINGLES", 300)
    check(near, 3, 90, 100)
    check(near, 5, 80, 100)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Copies of 20 words that differ in the first or the last one, and a second group that shares most shingles but is no copy."""
    monkeypatch.setattr(nj, "BLOCK_DOCS", 300)
    base = [f"word{i}" for i in range(19)]
    rows = [(i, " ".join([*base, f"x{i}"] if i % 2 else [f"y{i}", *base])) for i in range(3000)]
    rows += [(5000 + i, " ".join([f"u{i}", *base[:12], f"v{i}", f"w{i}", *base[12:]])) for i in range(900)]
    got = nj.join(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 80, 100).collect()
    assert {r.component_id for r in got if r.doc_id < 3000} == {0}
    assert all(r.component_id == r.doc_id for r in got if r.doc_id >= 5000)


@pytest.mark.parametrize("sides", [False, True])
def test_spanning_forest(sides):
    """Against all pairs: sets of many sizes, some parts joined beforehand."""
    rng = np.random.default_rng(7)
    rule = nj.Rule(80, 100)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 63, int(rng.integers(3, 400)), dtype=np.uint64)
        for _ in range(rng.integers(1, 8)):
            keep = base[rng.random(len(base)) > 0.06]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, 4)), dtype=np.uint64)])))
    sets.sort(key=len)
    sets = [x for x in sets if len(x)]
    n = np.array([len(x) for x in sets])
    part, side = rng.integers(0, len(sets) * 2, len(sets)), rng.integers(0, 2, len(sets)) if sides else None
    linked = lambda i, j: rule.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))

    def parts(pairs):
        f = nj._Forest(len(sets))
        for i, j in [*pairs, *((i, j) for i in range(len(sets)) for j in range(i) if part[i] == part[j])]:
            f.join(i, j)
        return [f.root(i) for i in range(len(sets))]

    pairs = list(nj._spanning(n, [nj.bitmap(x, nj.LOCAL_BITS) for x in sets], rule, linked, part, side))
    want = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if linked(i, j) and (side is None or side[i] != side[j])]
    assert parts(pairs) == parts(want) and len(pairs) < len(sets) and all(linked(i, j) for i, j in pairs)
    assert parts(nj._spanning(n, [nj.bitmap(x) for x in sets], rule, linked, part, side)) == parts(want)


def test_columns_of_any_name(spark):
    names = ("_h", "_row", "_key", "_stay", "kept", "a.b")
    rows = [(i, t, *range(6)) for i, t in ((1, "one two three four five six"), (2, "one two three four five six"), (2, "one two three four five six"), (3, ""), (None, None), (None, None))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{c}` int" for c in names))
    got = nj.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(((r[0], r[1]) for r in got.collect()), key=repr) == sorted([(1, "one two three four five six"), (3, ""), (None, None), (None, None)], key=repr)
    assert {tuple(r)[2:] for r in got.collect()} == {tuple(range(6))} and nj.one_of_each(docs.limit(0)).count() == 0


def test_odd_rows(odd, none, spark):
    check(odd, 3, 90, 100)
    extra = spark.createDataFrame([(None, "same words here"), (None, "same words here"), (5, "x"), (5, "x"), (5, "Y"), (9, "y")], "doc_id bigint, text string")
    check(extra, 3, 90, 100)
    assert nj.join(none).count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (139, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in [*range(100, 140), 200]}
