import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from pointfield.llm import language_id as li


def brute_words(text):
    """Runs of letters and the marks after them, character by character."""
    out, held = [], ""
    for c in (text or "").lower():
        kind = unicodedata.category(c)[0]
        if kind == "L" or (held and kind == "M"):
            held += c
        elif held:
            out.append(held)
            held = ""
    return [*out, held] if held else out


class Brute:
    """The model with dictionaries of strings, word by word."""

    def __init__(self, rows):
        counts = Counter()
        for lang, text in rows:
            for w in brute_words(text):
                counts[0, lang, w] += 1
                for n in range(1, li.MAX_N + 1):
                    for i in range(len(w) + 3 - n):
                        counts[n, lang, f"<{w}>"[i : i + n]] += 1
        self.languages = sorted({k[1] for k in counts})
        self.counts, self.kinds = counts, {n: {k[2] for k in counts if k[0] == n} for n in range(li.MAX_N + 1)}
        self.sums = {(n, lang): sum(c for k, c in counts.items() if k[:2] == (n, lang)) + li.SMOOTH * len(self.kinds[n]) for n in self.kinds for lang in self.languages}

    def logs(self, n, item):
        return [math.log(self.counts[n, lang, item] + li.SMOOTH) - math.log(self.sums[n, lang]) for lang in self.languages]

    def word(self, w):
        if w in self.kinds[0]:
            v = self.logs(0, w)
        else:
            v = [0.0] * len(self.languages)
            for n in range(li.MAX_N, 0, -1):
                known = [g for i in range(len(w) + 3 - n) if (g := f"<{w}>"[i : i + n]) in self.kinds[n]]
                if known:
                    v = np.sum([self.logs(n, g) for g in known], axis=0).tolist()
                    break
        e = [math.exp(x - max(v)) for x in v]
        return [x / sum(e) for x in e]

    def predict(self, text):
        got = brute_words(text)
        if not got or not self.languages:
            return "und", 0.0
        mean = np.mean([self.word(w) for w in got], axis=0)
        return self.languages[int(mean.argmax())], float(mean.max())


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    learned = [d for d in docs if d.lang is not None and zlib.crc32(str(d.doc_id).encode()) % 3 != 1]
    brute = Brute([(d.lang, d.text) for d in learned])
    got = {r.doc_id: r for r in li.query(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        lang, score = brute.predict(d.text)
        r = got[d.doc_id]
        assert (r.held_out, r.lang_pred) == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1, lang)
        assert r.score == pytest.approx(score, abs=1e-5)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = li.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert len(got) == docs.count() and len(out) > 250
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("text", ["½ ²", "Ⅷ ①", "12 !", "", None, "́", "_ __", "٣٤", "¼¾³¹"])
def test_no_letters(text):
    m = li.Model(["x"], {k: li._Table(np.empty(0, np.uint64), np.empty((0, 1), np.float32)) for k in range(li.MAX_N + 1)})
    assert m.predict([text]) == [("und", 0.0)] and li.words(text) == brute_words(text) == []


def test_words():
    for text in ("Größe naïve café", "हिन्दी में", "x² a½b cº ªd", "İstanbul", "éa ́x", "a_b don't", "東京Ⅷ塔", "ǅ ʰ ͅ ᾳ", "".join(map(chr, range(1, 0x250)))):
        assert li.words(text) == brute_words(text)


def model(words, grams):
    rows = [(0, lang, li._word_keys([w])[0], n) for w, by in words.items() for lang, n in by.items()]
    for size, some in grams.items():
        for g, by in some.items():
            keys, word = li._gram_keys([g], size)  # the gram stands in the middle of <g>
            at = [i for i in range(len(g) + 3 - size) if f"<{g}>"[i : i + size] == g][0]
            rows += [(size, lang, keys[at], n) for lang, n in by.items()]
    size, lang, keys, n = (np.array(x) for x in zip(*rows, strict=True))
    return li.Model.counted(["x", "y"], size, np.array(["xy".index(v) for v in lang]), keys.astype(np.uint64), n)


def test_backoff_order():
    m = model({"known": {"x": 9, "y": 1}, "other": {"y": 9}}, {1: {"q": {"y": 5}, "z": {"x": 5}}, 2: {"qu": {"x": 5}}})
    one = lambda t: m.predict([t])[0]
    assert one("known")[0] == "x" and one("qu")[0] == "x" and one("qo")[0] == "y"
    assert one("東")[1] == 0.5 and one("known known qo")[0] == "x"
    assert one(None) == one("12 !") == one("") == ("und", 0.0)


def test_rare_languages_stay(spark):
    rows = [(i, f"common words number {'abcdefgh'[i % 8]}", "en") for i in range(2000)] + [(5000 + i, f"raro lenguaje {'abc'[i]}", "es") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = li.sample(df, 40).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got}["es"] == 3 and 5 <= {r.lang: r["count"] for r in got}["en"] <= 40
    assert li.train(df, 40).languages == ["en", "es"]
    hot = spark.createDataFrame([(1, "one text", "en")] * 3000 + rows[-3:], df.schema)
    assert li.sample(hot, 6000).count() == 4


def test_memory_is_given_back():
    m = model({"known": {"x": 9, "y": 1}}, {1: {"q": {"y": 5}}})
    m.numbers.characters = li.CACHE_CHARACTERS + 1
    before = m.predict(["known q"])
    assert m.numbers.characters == 6 and len(m.rows) == 2 and before == m.predict(["known q"])


def test_odd_rows(odd, none, spark):
    m = li.trained(odd)
    got = li.predict(odd, m).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got if r.text in (None, "", "  \t\n ")} == {"und"}
    assert li.predict(none, m).count() == 0 and li.predict(odd, li.trained(none)).where("lang_pred <> 'und'").count() == 0
