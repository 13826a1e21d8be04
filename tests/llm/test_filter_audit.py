import math
import os
import re
from collections import defaultdict
from fractions import Fraction
from itertools import permutations

import duckdb
import pytest

from pointfield.llm import filter_audit as fa

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """Every order walked document by document."""
    good, toxic = ({r.doc_id for r in labels if r[m] == 1} - {None} for m in ("quality", "toxic"))
    first = {}
    for d in docs:
        if d.doc_id is not None:
            first[d.text or ""] = min(d.doc_id, first.get(d.text or "", d.doc_id))
    parts = defaultdict(list)
    for d in docs:
        t = d.text or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": d.doc_id is not None and first[t] < d.doc_id,
        }
        parts[d.lang or ""].append((fails, d.doc_id in good, d.doc_id in toxic))
    out = set()
    for part, rows in parts.items():
        steps, total = [], defaultdict(int)
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order):
                gone = [r for r in left if r[0][f]]
                failing = sum(r[0][f] for r in rows)
                left = [r for r in left if not r[0][f]]
                only = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                steps.append((part, "".join(order), step + 1, len(left), len(gone), failing - len(gone), only, sum(r[1] for r in gone), sum(r[2] for r in gone)))
                total[f] += len(gone)
        out |= {(*s, total[s[1][s[2] - 1]]) for s in steps}
    return out


def run(docs, labels):
    return fa.audit(fa.mask_counts(fa.masks(docs, labels)), "ABCDE")


def test_equals_every_order_walked(spark, sf, odd, none):
    given = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    said = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, None), (None, 1, 1), (5, None, None), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    for docs, labels in (given, (odd, said), (odd, said.limit(0))):
        got = run(docs, labels).select(*fa.COLUMNS).collect()
        assert len(got) == len(set(got))
        assert set(map(tuple, got)) == brute(docs.collect(), labels.collect())
    assert run(none, said).count() == 0


def test_filters_that_always_or_never_fail(spark):
    loud = "A# " * 120
    calm = " ".join(f"w{i}" for i in range(120))
    rows = [(i, t, "x") for i, t in enumerate([loud, loud, calm, calm + " z", "", " \t"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert set(map(tuple, run(docs, labels).select(*fa.COLUMNS).collect())) == brute(docs.collect(), [])


@pytest.mark.parametrize("k", [1, 3, 6])
def test_values_are_exact_fractions(spark, k):
    names = "PQRSTU"[:k]
    counts = [(p, m, (m * 7919 + 13 * s) % 101, m % 3, m % 2) for s, p in enumerate(("a", "b")) for m in range(1 << k) if (m * 31 + s) % 5]
    got = fa.audit(spark.createDataFrame(counts, "part string, mask int, n bigint, good bigint, toxic bigint"), names).collect()
    for r in got:
        i = names.index(r.filter_order[r.step - 1])
        want = sum(Fraction(n, bin(m).count("1")) for p, m, n, _, _ in counts if p == r.part and m >> i & 1)
        assert Fraction(r.shapley_numerator, r.shapley_denominator) == want
        assert r.shapley == want * math.factorial(k)
    assert len(got) == 2 * math.factorial(k) * k
    # Shares add up to what all filters together remove.
    for p in ("a", "b"):
        some = [r for r in got if r.part == p and r.filter_order == names]
        assert sum(Fraction(r.shapley_numerator, r.shapley_denominator) for r in some) == sum(r.removed for r in some)


def test_copies_do_not_meet_in_one_task(spark):
    """A hundred thousand copies of one text are told apart by their ids."""
    docs = spark.range(100_000).selectExpr("id as doc_id", "'same' as text", "'en' as lang")
    found = fa.masks(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert {(r.mask, r["count"]) for r in found.groupBy("mask").count().collect()} == {(1, 1), (17, 99_999)}


def test_sql(spark, sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{sf}/{t}')")
    want = c.execute(fa.SQL)
    names = [d[0] for d in want.description]
    assert set(map(tuple, fa.query(spark, sf).select(*names).collect())) == set(want.fetchall())
