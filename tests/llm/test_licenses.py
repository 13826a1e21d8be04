import re
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointfield.llm import licenses as li

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def classifier(spark):
    return li.fitted(spark.read.parquet(f"{SF}/documents.parquet"))


class Brute:
    """The scan without a gate: every word of every paragraph is compared with the templates' trigrams, and passages are scored from
    the fitted numbers alone."""

    def __init__(self, classifier):
        self.c = classifier
        self.weights = classifier.model.coefficientMatrix.toArray()
        self.bias = classifier.model.interceptVector.toArray()
        self.sets = {}
        for family, text in li.TEMPLATES:
            self.sets.setdefault(family, []).append(set(self.grams(self.words(text), 3)))
        self.all = {g for some in self.sets.values() for t in some for g in t}

    words = staticmethod(lambda t: [x for x in re.split("[^a-z0-9]+", t.lower()) if x])

    @staticmethod
    def grams(w, n):
        return [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]

    def passages(self, paragraph):
        words, line = [], []
        for n, text in enumerate(re.split("[\r\n]+", paragraph)):
            for w in self.words(text):
                words.append(w)
                line.append(n)
        hits = [i for i in range(len(words) - 2) if " ".join(words[i : i + 3]) in self.all]
        while hits:
            run = [hits.pop(0)]
            while hits and hits[0] - run[-1] <= li.GAP + 3:
                run.append(hits.pop(0))
            a, b = run[0], min(run[-1] + 2, len(words) - 1)
            first = max(a - li.WIDE, line.index(line[a]))
            last = min(b + li.WIDE, max(i for i, n in enumerate(line) if n == line[b]))
            yield words[first : last + 1]

    def verdict(self, w):
        grams = list(dict.fromkeys(w)) + list(dict.fromkeys(self.grams(w, 2)))
        x = {self.c.hash.indexOf(g) for g in grams}
        z = (self.weights[:, sorted(x)].sum(axis=1) + self.bias) / self.c.scale
        p = np.exp(z - z.max())
        p /= p.sum()
        family = self.c.families[int(p.argmax())]
        if family == li.UNKNOWN or p.max() < self.c.least:
            return None
        own = set(self.grams(w, 3))
        only = {g for g in own if any(g in t for t in self.sets[family]) and not any(g in t for f, some in self.sets.items() if f != family for t in some)}
        like = any(len(own & t) >= li.CONFIRM * min(len(own), len(t)) for t in self.sets[family])
        return family if only and like else li.UNKNOWN

    def scan(self, text):
        out, n = [], 0
        for paragraph in re.split(r"\n[ \t\r\f]*\n", text or ""):
            if not paragraph.strip():
                continue
            n += 1
            out += [(n, k, v) for k, w in enumerate(self.passages(paragraph), 1) if (v := self.verdict(w))]
        return n, out


WRAPPED = "\n".join(textwrap.wrap(next(t for f, t in li.TEMPLATES if f == "MIT" and t.startswith("Permission")), 40))
TEXTS = [
    WRAPPED,
    "Some prose stands here.\nAnd here.\n" + WRAPPED + "\nAnd goes on.",
    "Two notices.\n\nReleased under the MIT License.\n \t\nLicensed under the Apache License, Version 2.0.\n\n\n",
    "Released under\nthe MIT\nLicense.",
    "A long line of prose without an end, in which, as an aside, it is said: this work is licensed under the GNU General Public License, version 3. The line goes on and on with words that have nothing to do with it, as lines do in prose, " * 2,
    "Licensed under the Foo Bar License, version 9.",
    "Released under CC0 1.0 Universal.\r\n\r\nAll rights reserved.",
    "ALL RIGHTS\t reserved -- all rights reserved. " * 30,
    "",
    None,
    "\n\n\n",
    *li.OTHERWISE,
]


def test_against_brute_force(spark, classifier):
    brute = Brute(classifier)
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()] + list(enumerate(TEXTS, 1 << 40))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_paragraphs, [(f.paragraph, f.passage, f.family) for f in r.findings]) for r in li.scan(df, classifier).collect()}
    assert got == {i: brute.scan(t) for i, t in docs}


def test_fixture_lines(spark, classifier):
    """Every line of the fixture that is one of the notices is found, and nothing else."""
    known = {t: f for f, t in li.TEMPLATES}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in li.scan(docs, classifier).collect()}
    found = 0
    for d in docs.collect():
        want = [known[x] for x in (d.text or "").split("\n") if x in known]
        assert [f.family for f in got[d.doc_id].findings if f.family != "unknown"] == want
        found += len(want)
    assert found > 40


def test_families(spark, classifier):
    new = [
        ("MIT", "This package is released under the MIT License"),
        ("GPL", "licensed under the GNU General Public License version 3 or later"),
        ("Apache-2.0", "Code is licensed under the Apache License, Version 2.0, see the file"),
        ("unknown", "This work is licensed under the Foo Public License, version 3."),
        ("unknown", "His driving licence was issued under the old rules."),
        ("unknown", "Permission to land was granted to the pilot"),
        ("unknown", "licence"),
    ]
    rows = new + [(f, t) for f, t in li.TEMPLATES] + [("unknown", t) for t in li.OTHERWISE]
    df = spark.createDataFrame(rows, "want string, t string").withColumn("w", li.tokens(F.col("t")))
    bad = [(r.want, r.family, r.probability, r.t) for r in classifier.classify(df, "w").collect() if r.want != r.family]
    assert not bad


def test_wrapped_licences_are_one_passage(spark, classifier):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = {r.doc_id: [(f.paragraph, f.passage, f.family) for f in r.findings] for r in li.scan(df, classifier).collect()}
    assert got[0] == got[1] == got[3] == [(1, 1, "MIT")]
    assert got[2] == [(2, 1, "MIT"), (3, 1, "Apache-2.0")]
    assert {f for _, _, f in got[4]} == {"GPL"} and got[6] == [(1, 1, "CC0"), (2, 1, "proprietary")]
    assert all(f == "unknown" for _, _, f in got[5])
    assert not any(got[i] for i in range(8, len(TEXTS)))


def test_calibration_is_on_unseen_templates(classifier):
    assert 0.2 <= classifier.least <= 0.9 and classifier.scale > 0


def test_a_frequent_text_counts_once(spark):
    docs = spark.createDataFrame([("the same text again",)] * 5000 + [(f"other text {i}",) for i in range(3000)] + [(None,)], "text string")
    assert li.background(docs, 10_000).count() == 3001
    assert 500 <= li.background(docs, 2000).count() <= 1000
    assert li.background(docs.limit(0)).count() == 0
    assert li.UNKNOWN in li.fitted(docs.limit(0)).families


def test_odd_rows(odd, none, classifier):
    got = li.scan(odd, classifier).collect()
    assert len(got) == odd.count() and all(not r.findings for r in got)
    assert sorted(r.n_paragraphs for r in got) == [0, 0, 0, 1, 1, 1, 1, 1, 1]
    assert li.scan(none, classifier).count() == 0


def test_plan_has_no_python(odd, classifier):
    plan = li.scan(odd, classifier)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_notices_without_a_cue(spark, classifier):
    """A word like 'licence' is no condition: notices are told by the classifier."""
    lines = ["Released under CC0 1.0 Universal.", "Released under Apache 2.0.", "Distributed under the GNU GPL v3.", "It was said that it will be useful in the hope of rain.", "Nothing here."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id bigint, text string")
    got = {r.doc_id: [f.family for f in r.findings] for r in li.scan(df, classifier).collect()}
    assert got[0] == ["CC0"] and got[3] == got[4] == []


def test_gate_passes_all_that_templates_can_confirm(spark):
    """The pattern against the n-grams that confirmation compares, over odd separators and cases."""
    texts = [t for _, t in li.TEMPLATES] + li.OTHERWISE
    rows = [w for t in texts for w in (t, t.upper(), t.replace(" ", " -é\t"), "x" + t[3:40], t[10:35], t[:20].replace(" ", ""), "İ" + t[5:])]
    df = spark.createDataFrame([(t,) for t in rows], "t string").select("t", li.ngrams(li.tokens(F.col("t")), 3).alias("g"), F.lower("t").rlike(li.SHARED).alias("passes"))
    for r in df.collect():
        assert r.passes == (not set(li._ALL).isdisjoint(r.g)), r.t


def test_words_without_a_template_trigram_are_classified_too(spark, classifier):
    """Every word outside the passages, scored from the fitted numbers line by line; licence words that no template has are told as unconfirmed."""
    brute = Brute(classifier)
    odd = [
        "Nothing here.\nLicense terms: permission granted under the license of the software, copyright notice.\nOr here.",
        "Apache License 2.0\n\nReleased under the MIT License.\nsoftware license copyright notice warranty",
        "Released under the MIT License. " + "It was a long day and nobody came to the house by the sea " * 2 + "software license copyright notice warranty permission granted free of charge",
        *TEXTS,
    ]
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 1000").limit(12).collect()] + list(enumerate(odd, 1 << 40))

    def rest(paragraph):
        lines = [w for text in re.split("[\r\n]+", paragraph) if (w := brute.words(text))]
        words, number = [w for line in lines for w in line], [n for n, line in enumerate(lines) for _ in line]
        taken, at = set(), 0
        for w in brute.passages(paragraph):
            while words[at : at + len(w)] != w:
                at += 1
            taken |= set(range(at, at + len(w)))
            at += 1
        run = []
        for i, w in enumerate(words):
            if run and (i in taken or number[i] != number[run[-1]]):
                yield [words[k] for k in run]
                run = []
            if i not in taken:
                run.append(i)
        if run:
            yield [words[k] for k in run]

    want = {}
    for i, text in docs:
        paragraphs = [p for p in re.split(r"\n[ \t\r\f]*\n", text or "") if p.strip()]
        want[i] = [(n, k) for n, p in enumerate(paragraphs, 1) for k, w in enumerate(rest(p), 1) if brute.verdict(w)]
    got = {r.doc_id: [(x.paragraph, x.line) for x in r.unconfirmed] for r in li.scan(spark.createDataFrame(docs, "doc_id bigint, text string"), classifier).collect()}
    assert got == want and any(want.values())
