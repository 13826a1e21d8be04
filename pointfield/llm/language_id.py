"""Language ID with word-first backoff.

A model holds, per language, the log frequency of words, and of character n-grams of each length up to MAX_N over
words with their ends marked. A known word is scored by its own frequencies. An unseen word falls back to its
longest n-grams of which any is known, then to shorter ones; one without any known n-gram says nothing. Every
word gives a distribution over the languages; a text's is their mean, and its language the most probable.

The model is fitted on a bounded sample of labelled rows, MAX_ROWS over all languages and as many of each, and keeps every word and
n-gram of them, as sorted 64-bit hashes beside one array of frequencies (two of a million keys agree with odds of one in 10^7).
Prediction is a map over all rows without a shuffle; a worker looks the new words of a slice of texts up together.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, materialize, per_worker, short_batches, text_slices, tidied

MAX_ROWS, MAX_N = 20_000, 4
UNKNOWN = "und"
#: Words and characters of words that a worker remembers at most, beyond one slice of texts.
CACHE, CACHE_CHARACTERS = 200_000, 4_000_000
SMOOTH = 0.5
#: The table of languages (a name and two numbers a row) is broadcast up to so many rows; beyond, the optimizer chooses.
BROADCAST_LANGUAGES = 10_000

# A word is a run of letters and of the marks that combine with them. On the characters up to U+024F other than the numbers among
# them the first pattern says the same and is faster.
_LATIN = re.compile(r"[^\W\d_]+")
_NOT_LATIN = re.compile("[^\x00-±´-¸º»¿-ɏ]")
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")

_U = np.uint64


def words(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    return (_LETTERS if _NOT_LATIN.search(low) else _LATIN).findall(low)


def _word_keys(some: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in some], np.uint64)


def _gram_keys(some: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of the word) of every n-gram of the words with their ends marked."""
    sizes = np.array([len(w) + 2 for w in some], np.int64)
    points = np.frombuffer("".join(f"<{w}>" for w in some).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(points) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(len(points) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = (h ^ (points[j : j + len(h)] + _U(1))) * _U(0x9E3779B97F4A7C15)
            h ^= h >> _U(29)
        h = h * _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(32)
    word = np.repeat(np.arange(len(some)), sizes)
    left = np.cumsum(sizes)[word] - np.arange(len(points))  # characters from here to the word's end
    at = np.flatnonzero(left[: len(h)] >= n)
    return h[at], word[at]


class _Table:
    """Sorted keys and their log frequencies by language."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        self.keys, self.logs = keys, logs

    @classmethod
    def counted(cls, keys: np.ndarray, language: np.ndarray, n: np.ndarray, languages: int) -> _Table:
        known, at = np.unique(keys, return_inverse=True)
        table = np.full((len(known), languages), SMOOTH)
        np.add.at(table, (at, language), n)
        logs = np.log(table) - np.log(table.sum(axis=0, keepdims=True)) if len(table) else table
        return cls(known, logs.astype(np.float32))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the keys are known, their places)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return known, at[known]


class _Numbers(dict):
    """Words by number; new ones are listed until they are scored."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.characters = 0

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        self.characters += len(word)
        return at


class Model:
    def __init__(self, languages: list[str], tables: dict[int, _Table]):
        """``tables``: of words at 0, of n-grams at their length."""
        self.languages, self.tables = languages, tables
        self.forget()

    @classmethod
    def counted(cls, languages: list[str], size: np.ndarray, language: np.ndarray, keys: np.ndarray, n: np.ndarray) -> Model:
        """From counts by length (0 for words), number of the language and key."""
        return cls(languages, {k: _Table.counted(keys[m], language[m], n[m], len(languages)) for k in range(MAX_N + 1) for m in [size == k]})

    def state(self) -> tuple:
        """All that a worker needs, in types that any worker can unpickle."""
        return self.languages, {k: (t.keys, t.logs) for k, t in self.tables.items()}

    @classmethod
    def of(cls, state: tuple) -> Model:
        return cls(state[0], {k: _Table(*t) for k, t in state[1].items()})

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.rows = np.empty((0, len(self.languages)), np.float32)

    def score(self, some: list[str]) -> np.ndarray:
        """The distribution over languages that each word speaks for."""
        total = np.zeros((len(some), len(self.languages)))
        known, at = self.tables[0].find(_word_keys(some))
        total[known] = self.tables[0].logs[at]
        left = np.flatnonzero(~known)
        for n in range(MAX_N, 0, -1):
            if not len(left):
                break
            keys, word = _gram_keys([some[i] for i in left.tolist()], n)
            known, at = self.tables[n].find(keys)
            word, logs = word[known], self.tables[n].logs[at]
            have = np.bincount(word, minlength=len(left)) > 0
            for k in range(len(self.languages)):
                total[left, k] = np.bincount(word, weights=logs[:, k], minlength=len(left))
            left = left[~have]
        e = np.exp(total - total.max(axis=1, keepdims=True))
        return (e / e.sum(axis=1, keepdims=True)).astype(np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self.numbers) > CACHE or self.numbers.characters > CACHE_CHARACTERS:
            self.forget()
        get = self.numbers.__getitem__
        at = [np.array(list(map(get, words(t))), np.int64) for t in texts]
        new = self.numbers.new
        for i in range(0, len(new), 50_000):
            self.rows = np.concatenate([self.rows, self.score(new[i : i + 50_000])])
        new.clear()
        out = []
        for a in at:
            if not len(a):
                out.append((UNKNOWN, 0.0))
                continue
            which, times = np.unique(a, return_counts=True) if len(a) > 10_000 else (a, np.ones(len(a), np.int64))
            mean = times @ self.rows[which].astype(np.float64) / len(a)
            k = int(mean.argmax())
            out.append((self.languages[k], min(1.0, float(mean[k]))))
        return out


def _count(batches, top: int = 200_000):
    held: Counter = Counter()

    def out():
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([held[k] for k in keys], pa.int64())], names=["lang", "item", "n"])

    for whole in batches:
        for b in text_slices(whole, "text"):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.update((lang, w) for w in words(text))
            if len(held) > top:
                yield out()
                held.clear()
    if held:
        yield out()


def _keyed(batches):
    """Counts of words to counts of their keys and of those of their n-grams."""
    for b in batches:
        lang = np.array(b.column(0).to_pylist(), object)
        for one in sorted(set(lang.tolist())):
            at = np.flatnonzero(lang == one)
            some, n = b.column(1).take(pa.array(at)).to_pylist(), np.asarray(b.column(2).take(pa.array(at)))
            for size in range(MAX_N + 1):
                keys, word = (_word_keys(some), np.arange(len(some))) if size == 0 else _gram_keys(some, size)
                known, back = np.unique(keys, return_inverse=True)
                sums = np.zeros(len(known), np.int64)
                np.add.at(sums, back, n[word])
                k = len(known)
                yield pa.RecordBatch.from_arrays([pa.array([one] * k, pa.string()), pa.array(np.full(k, size, np.int32)), pa.array(known.view(np.int64)), pa.array(sums)], names=["lang", "len", "key", "n"])


def sample(labelled: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(lang, text) of about ``max_rows`` distinct rows (doc_id, text, lang), or of all: the same number for every language, chosen by a hash
    of the row; a language with fewer gives all of them."""
    sizes = materialize(labelled.groupBy("lang").agg(F.count("*").alias("_n")), "lang-sizes")
    languages = sizes.count()
    sizes = sizes.withColumn("_share", F.lit(max_rows / max(1, languages)) / F.col("_n"))
    hashed = labelled.withColumn("_h", F.xxhash64("doc_id", "text", F.lit(3)))
    some = hashed.join(F.broadcast(sizes) if languages <= BROADCAST_LANGUAGES else sizes, "lang").where(F.pmod("_h", F.lit(1_000_003)) < F.col("_share") * 1_000_003)
    return some.groupBy("lang", "doc_id", "_h").agg(F.first("text").alias("text")).select("lang", F.coalesce("text", F.lit("")).alias("text"))


def train(labelled: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on rows (doc_id, text, lang) without null languages: all of them, or a sample of about ``max_rows``. Rows that repeat id,
    text and language count once. An empty input gives a model of no language. What comes to the driver are the counts of the
    sample's words and n-grams."""
    short_batches(labelled.sparkSession)
    rows = sample(labelled, max_rows)
    counts = materialize(rows.mapInArrow(tidied(_count), "lang string, item string, n bigint").groupBy("lang", "item").agg(F.sum("n").alias("n")), "lang-words")
    keyed = counts.mapInArrow(tidied(_keyed), "lang string, len int, key bigint, n bigint").groupBy("lang", "len", "key").agg(F.sum("n").alias("n"))
    got = keyed.toArrow()
    lang = got.column("lang").combine_chunks().dictionary_encode()
    languages = sorted(lang.dictionary.to_pylist())
    place = np.array([languages.index(x) for x in lang.dictionary.to_pylist()], np.int64)
    return Model.counted(languages, got.column("len").to_numpy(), place[np.asarray(lang.indices)] if len(lang) else np.empty(0, np.int64), got.column("key").to_numpy().view(np.uint64), got.column("n").to_numpy())


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (mean probability of that language over the words, 0 to 1).

    A null text, an empty one and one without letters is ``und`` with score 0, as is every text under a model of no
    language. Texts are scored whole. Repeated rows and null ids pass through; columns of those two names are replaced.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    schema = T.StructType(list(rows.schema)).add("lang_pred", T.StringType()).add("score", T.DoubleType())
    sent, name = docs.sparkSession.sparkContext.broadcast(model.state()), uuid.uuid4().hex

    def work(batches):
        m = per_worker(("language-model", name), lambda: Model.of(sent.value))
        for whole in batches:
            for b in text_slices(whole, text_col):
                got = m.predict(b.column(b.schema.get_field_index(text_col)).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(tidied(work), schema)


def held_out():
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame) -> Model:
    return train(docs.where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), trained(docs)).drop("text")
