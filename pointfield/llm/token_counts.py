"""Token counts under a unigram model, by dynamic programming over many pre-tokens at once.

A pre-token is a run of non-space with the word mark in front. The distinct new pre-tokens of a slice of documents are laid end to end and
cut together, end by end, over arrays of the pieces that begin at each place. Each one's token count is stored in the
worker (CACHE short ones at most) and the documents add up their pre-tokens' counts. Pre-tokens of more
than LONG characters are scored alone, holding only the states that the next character can reach.

The pieces are those of a public vocabulary's file. Their probabilities are fitted here, by ROUNDS of expectation and
maximisation over the pre-tokens of all distinct texts, beginning with Zipf's by rank in the file. A
character that no piece covers takes one token per UTF-8 byte, at the score of a piece PENALTY below the least. Of equal
scores the cut with fewer tokens counts.

Documents are scored where they are read: no shuffle of texts but of those that the fit meets again, memory bounded by the slice and the store.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, per_worker, short_batches, text_slices, tidied

MARK = "▁"
PENALTY = 10.0
#: Pre-tokens that a worker remembers at most, and the characters of the longest of them.
CACHE, LONG = 1_000_000, 48
#: Characters of words that are cut at once.
AT_ONCE = 1 << 17
#: Rounds of the fit; the count that every piece has besides the expected one.
ROUNDS, PRIOR = 3, 0.01

_PRE = re.compile(r"[^\x20\x09-\x0D]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str) -> list[str]:
    """The pieces by rank, without those that stand for no text."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def zipf(some: list[str]) -> dict[str, float]:
    total = math.log(sum(1 / r for r in range(1, len(some) + 1)))
    return {p: -math.log(r) - total for r, p in enumerate(some, 1)}


def expected(word: str, table: dict[str, float], longest: int, byte: float, times: float, into: dict[str, float]) -> None:
    """Add how often each piece is expected in ``times`` of a word, over all its cuts."""

    def total(values: list[float]) -> float:
        top = max(values)
        return top + math.log(sum(math.exp(v - top) for v in values))

    n = len(word)
    edges: list[list[tuple[int, str | None, float]]] = []  # by end: start, piece, log probability
    front = [0.0]
    for d in range(1, n + 1):
        here = [(s, w, p) for s in range(max(0, d - longest), d) if (p := table.get(w := word[s:d])) is not None]
        if word[d - 1] not in table:
            here.append((d - 1, None, byte * len(word[d - 1].encode("utf-8", "surrogatepass"))))
        edges.append(here)
        front.append(total([front[s] + p for s, _, p in here]))
    back: list[list[float]] = [[] for _ in range(n)] + [[0.0]]
    for d in range(n, 0, -1):
        behind = total(back[d])
        back[d] = [behind]
        for s, w, p in edges[d - 1]:
            back[s].append(p + behind)
            if w is not None:
                into[w] = into.get(w, 0.0) + times * math.exp(front[s] + p + behind - front[n])


def _by(key: np.ndarray) -> list[np.ndarray]:
    """Rows by ascending key, 0 to LONG, in their order."""
    order = np.argsort(key.astype(np.uint8), kind="stable")
    return np.split(order, np.nonzero(np.diff(key[order]))[0] + 1)


class Cuts:
    """Expected counts, or best cuts, of many words at once. What pieces begin at a place is found length by length by hashes of substrings; places that no
    piece goes on from drop out. Forward and backward sums are probabilities, LIFT more for each character so that they stay in range; words that leave
    it go one by one."""

    LIFT, SPREAD, BITS = 10.0, 0x9E3779B97F4A7C15, 22

    def __init__(self, table: dict[str, float]):
        self.table, self.names = table, list(table)
        self.longest, self.byte = max(map(len, table), default=0), min(table.values(), default=0.0) - PENALTY
        self.logs = np.array([table[w] for w in self.names])
        found: list[dict[int, int]] = [{} for _ in range(self.longest + 1)]
        self.goes_on = np.zeros(1 << self.BITS, bool)
        for number, w in enumerate(self.names):
            h = 0
            for ch in w:
                h = (h * self.SPREAD + ord(ch) + 1) % (1 << 64)
                self.goes_on[h * self.SPREAD % (1 << 64) >> 64 - self.BITS] = True
            found[len(w)][h] = number
        self.keys = []
        for by in found:
            order = sorted(by)
            self.keys.append((np.array(order, np.uint64), np.array([by[h] for h in order], np.int64)))

    def edges(self, code: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, piece) of every piece in words laid end to end; ``left``: characters from a place to its word's end. A character without
        a piece of its own has piece -1."""
        at, h, out = np.arange(len(code)), np.zeros(len(code), np.uint64), []
        for n in range(1, self.longest + 1):
            ok = left[at] >= n
            at, h = at[ok], h[ok]
            h = h * np.uint64(self.SPREAD) + code[at + n - 1] + np.uint64(1)
            ok = self.goes_on[h * np.uint64(self.SPREAD) >> np.uint64(64 - self.BITS)]
            keys, numbers = self.keys[n]
            if n == 1:
                piece = np.full(len(at), -1)
                if len(keys):
                    i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    piece = np.where(keys[i] == h, numbers[i], -1)
                out.append((at, np.ones(len(at), np.int64), piece))
            at, h = at[ok], h[ok]
            if n > 1 and len(keys):
                i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[i] == h
                out.append((at[hit], np.full(int(hit.sum()), n), numbers[i[hit]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def best(self, words: list[str]) -> np.ndarray:
        """Tokens of the best cut of each word of 1 to LONG characters, of equal scores that with fewer tokens. A word of n characters has n + 1 states."""
        n = np.array([len(w) for w in words])
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        word, ends = np.repeat(np.arange(len(n)), n), np.cumsum(n)
        place, length, piece = self.edges(code, ends[word] - np.arange(len(code)))
        width = 1 + (code > 0x7F).astype(int) + (code > 0x7FF) + (code > 0xFFFF)
        tokens = np.where(piece >= 0, 1, width[place])
        p = np.where(piece >= 0, self.logs[piece], self.byte * tokens) if self.names else self.byte * tokens
        a = place + word[place]
        b, score, less = a + length, np.full(len(code) + len(n), -np.inf), np.full(len(code) + len(n), np.iinfo(np.int64).min)
        first, last = ends - n + np.arange(len(n)), ends + np.arange(len(n))
        score[first], less[first] = 0.0, 0
        for i in _by(place - (ends - n)[word[place]] + length):
            to, by = b[i], a[i]
            at = score[by] + p[i]
            np.maximum.at(score, to, at)
            ok = at == score[to]
            np.maximum.at(less, to[ok], (less[by] - tokens[i])[ok])
        return -less[last]

    def add(self, words: list[str], times: list[int], into: np.ndarray) -> None:
        """Add the expected counts of the words, so many times each, to ``into``, one number a piece."""
        size = np.array([len(w) for w in words])
        short = (size <= LONG) & (size > 0) if self.longest else np.zeros(len(words), bool)
        alone = [i for i in np.nonzero(~short)[0] if words[i]]
        kept = np.nonzero(short)[0]
        if len(kept):
            n = size[kept]
            code = np.frombuffer("".join([words[i] for i in kept]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            word, ends = np.repeat(np.arange(len(kept)), n), np.cumsum(n)
            place, length, piece = self.edges(code, ends[word] - np.arange(len(code)))
            width = 1 + (code > 0x7F).astype(int) + (code > 0x7FF) + (code > 0xFFFF)
            p = np.exp(np.where(piece >= 0, self.logs[piece], self.byte * width[place]) + self.LIFT * length)
            # A word of n characters has n + 1 states.
            a = place + word[place]
            b, front, back = a + length, np.zeros(len(code) + len(kept)), np.zeros(len(code) + len(kept))
            first, last = ends - n + np.arange(len(kept)), ends + np.arange(len(kept))
            front[first], back[last] = 1.0, 1.0
            start = place - (ends - n)[word[place]]
            for key, to, by, sums in ((start + length, b, a, front), (LONG - start, a, b, back)):
                for i in _by(key):
                    np.add.at(sums, to[i], sums[by[i]] * p[i])
            fine = np.minimum(front, back) > 1e-280
            fine = np.logical_and.reduceat(fine & (np.maximum(front, back) < 1e280), first)
            alone += kept[~fine].tolist()
            ok = fine[word[place]] & (piece >= 0)
            w = word[place[ok]]
            share = front[a[ok]] / front[last[w]] * p[ok] * back[b[ok]] * np.array(times, float)[kept][w]
            into += np.bincount(piece[ok], share, len(into))
        if alone:
            one: dict[str, float] = {}
            for i in alone:
                expected(words[i], self.table, self.longest, self.byte, times[i], one)
            for k, w in enumerate(self.names if one else ()):
                into[k] += one.get(w, 0.0)


def sample(docs: DataFrame, rows: int | None = None, text_col: str = "text") -> DataFrame:
    """(word, n) of the pre-tokens, mark in front, of all distinct texts, or of about ``rows`` of them at most, chosen by a hash of the text. Only
    texts that come again are shuffled, to be counted once; the others are counted where they are read."""
    hashed = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col, F.lit(7)).alias("_h"), F.col(text_col).alias("_text"))
    if rows is not None:
        hashed = hashed.where(F.pmod("_h", F.lit(1_000_003)) < F.lit(min(1.0, rows / max(1, docs.count())) * 1_000_003))
    again = materialize(hashed.groupBy("_h").count().where("count > 1").select("_h", F.lit(True).alias("_again")), "token-copies")
    dealt = hashed.join(again, "_h", "left")
    once, copies = dealt.where("_again IS NULL").select("_text"), dealt.where("_again").groupBy("_h").agg(F.first("_text").alias("_text")).select("_text")

    def counted(batches):
        for whole in batches:
            for b in text_slices(whole, "_text"):
                held = Counter(w for t in b.column(0).to_pylist() for w in _PRE.findall(t))
                yield pa.RecordBatch.from_arrays([pa.array([MARK + w for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    counts = [some.mapInArrow(tidied(counted), "word string, n bigint") for some in (once, copies)]
    return materialize(counts[0].unionAll(counts[1]).groupBy("word").agg(F.sum("n").alias("n")), "token-words")


def fitted(docs: DataFrame, vocabulary: str | None = None, rows: int | None = None, rounds: int = ROUNDS, text_col: str = "text") -> dict[str, float]:
    """Log probabilities by piece, fitted on all distinct texts unless ``rows`` says otherwise. What comes to the driver in a round is one number per piece of the vocabulary. Null texts say
    nothing; without any text the scores are Zipf's."""
    spark = docs.sparkSession
    short_batches(spark)
    table = zipf(pieces(vocabulary or default_vocabulary()))
    words = sample(docs, rows, text_col)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(table)

        def work(batches, sent=sent):
            cuts = Cuts(sent.value)
            into = np.zeros(len(cuts.names))
            some, times = [], []
            for b in batches:
                some += b.column(0).to_pylist()
                times += b.column(1).to_pylist()
                if sum(map(len, some)) >= AT_ONCE:
                    cuts.add(some, times, into)
                    some, times = [], []
            cuts.add(some, times, into)
            some = np.nonzero(into)[0]
            yield pa.RecordBatch.from_arrays([pa.array([cuts.names[i] for i in some], pa.string()), pa.array(into[some])], names=["piece", "n"])

        got = words.mapInArrow(tidied(work), "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        seen = dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
        sent.unpersist()
        if not seen:
            break
        total = math.log(sum(seen.values()) + PRIOR * len(table))
        # Twelve digits: sums over shuffled rows differ in their last bits.
        table = {p: round(math.log(seen.get(p, 0.0) + PRIOR) - total, 12) for p in table}
    return table


class Unigram:
    def __init__(self, table: dict[str, float]):
        self.table = table
        self.longest = max(map(len, table), default=0)
        self.byte = min(table.values(), default=0.0) - PENALTY
        self.cuts = Cuts(table)
        self.counts: dict[str, int] = {}

    def _next(self, word: str, d: int, best, first: int) -> tuple[float, int]:
        """The forward state after d characters of ``word``, (score, -tokens) of the best cut; ``best[s - first]`` is that after s."""
        get, top = self.table.get, None
        for s in range(max(0, d - self.longest), d):
            if (p := get(word[s:d])) is not None:
                at = (best[s - first][0] + p, best[s - first][1] - 1)
                if top is None or at > top:
                    top = at
        if get(word[d - 1]) is None:
            n = len(word[d - 1].encode("utf-8", "surrogatepass"))
            at = (best[d - 1 - first][0] + n * self.byte, best[d - 1 - first][1] - n)
            if top is None or at > top:
                top = at
        return top

    def _alone(self, word: str) -> int:
        best = [(0.0, 0)]
        for d in range(1, len(word) + 1):
            first = d - len(best)
            best.append(self._next(word, d, best, first))
            if len(best) > self.longest + 1:
                del best[0]
        return -best[-1][1]

    def learn(self, words: Iterable[str], into: dict[str, int]) -> None:
        """Token counts of pre-tokens, many at once."""
        held: list[str] = []
        size = 0
        for w in words:
            if len(w) >= LONG or not self.longest:
                into[w] = self._alone(MARK + w)
                continue
            held.append(w)
            size += len(w) + 1
            if size >= AT_ONCE:
                into.update(zip(held, self.cuts.best([MARK + w for w in held]).tolist(), strict=True))
                held, size = [], 0
        if held:
            into.update(zip(held, self.cuts.best([MARK + w for w in held]).tolist(), strict=True))

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        split = [_PRE.findall(t) if t else [] for t in texts]
        words: set[str] = set()
        for s in split:
            words.update(s)
        if len(self.counts) > CACHE:
            self.counts.clear()
        long = {w for w in words if len(w) >= LONG}
        self.learn({w for w in words - long if w not in self.counts}, self.counts)
        once: dict[str, int] = {}
        self.learn(long, once)
        get = self.counts.__getitem__ if not long else lambda w: once[w] if w in once else self.counts[w]
        return [len(s) for s in split], [sum(map(get, s)) for s in split]


def count(docs: DataFrame, table: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pretokens, n_tokens), one row per input row, under the log probabilities of ``table``. Null and empty texts have none.
    Null and repeated ids pass through; other columns are ignored, whatever their names. An empty input gives no rows."""
    spark = docs.sparkSession
    short_batches(spark)
    sent, name = spark.sparkContext.broadcast(table), uuid.uuid4().hex
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def work(batches):
        model = per_worker(("unigram", name), lambda: Unigram(sent.value))
        for whole in batches:
            for b in text_slices(whole, "_text"):
                pre, tokens = model.count(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(pre, np.int64)), pa.array(np.array(tokens, np.int64))], names=["_id", "n_pretokens", "n_tokens"])

    return rows.mapInArrow(tidied(work), f"_id {kind}, n_pretokens bigint, n_tokens bigint").withColumnRenamed("_id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return count(docs, fitted(docs))
