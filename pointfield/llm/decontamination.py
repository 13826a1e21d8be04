"""Benchmark decontamination by winnowing.

Benchmark items are cut into windows of WINDOW words. Of every W consecutive k-gram hashes of a text the minimum
is kept as a fingerprint; with k + W - 1 = WINDOW, any shared window has a fingerprint in common with the
benchmark. Document fingerprints are joined on each executor with those of the benchmark (a map-side join: an index of bounded size
that a worker builds once), and each hit is extended to the windows around it, which must be equal word
for word. Items shorter than WINDOW are one window each and get their own k and W.

The documents are never shuffled. A benchmark of more than GROUP_WORDS is worked off in several passes, each written before the next
begins; an item is never cut, so one that is longer makes a larger pass.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, drop, materialize, per_worker, short_batches, text_slices, tidied

WINDOW, K = 10, 5
#: Words of benchmark that are broadcast and indexed at once: some 30 bytes of a worker's memory each, and 100 a distinct word.
GROUP_WORDS = 4_000_000
#: Candidate windows that are compared at a time.
COMPARED = 100_000

# Word bytes are digits, lower-case letters and all of non-ASCII; A-Z become lower case, everything else a space.
_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _kgrams(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of word numbers."""
    h = np.zeros(len(ids) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + len(h)].astype(np.uint64) + np.uint64(1)
        return _mixed(h)


def _slid(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick over every w consecutive values, in log w steps."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = pick(x[: len(x) - step], x[step:])
        have += step
    return x


def winnow(ids: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints: the k-grams that are the minimum of a window of w."""
    if len(ids) < k + w - 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _kgrams(ids, k)
    low = _slid(h, w, np.minimum)
    low = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(_slid(low, w, np.maximum) == h)
    return at, h[at]


class _Level:
    """The windows of one length: their places in the sequence of all words, by hash, and their fingerprints."""

    def __init__(self, size: int, starts: np.ndarray, item: np.ndarray, prints: np.ndarray, flat: np.ndarray):
        self.size, self.k = size, min(K, size)
        self.w = size - self.k + 1
        h = np.concatenate([_hashed(flat, starts[i : i + COMPARED], size) for i in range(0, len(starts), COMPARED)])
        order = np.lexsort((item, h))
        h, starts, item = h[order], starts[order], item[order]
        again = (h[1:] == h[:-1]) & (item[1:] == item[:-1])  # a window that an item repeats counts once
        for j in range(size):
            again &= flat[starts[1:] + j] == flat[starts[:-1] + j]
        keep = np.concatenate([[True], ~again])
        self.hashes, self.starts, self.item = h[keep], starts[keep], item[keep]
        self.prints = np.unique(prints)


def _hashed(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows that begin there."""
    h = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[starts + j].astype(np.uint64) + np.uint64(1)
        return _mixed(h)


class Index:
    """A part of the benchmark: its vocabulary, all its words in sequence, and its windows by length."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        parts: list[np.ndarray] = []
        by_size: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        at = 0
        for name, text in items:
            got = words(text)
            if not got:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in got], np.int32)
            size = min(window, len(ids))
            k = min(K, size)
            by_size.setdefault(size, []).append((at, len(self.names), len(ids) - size + 1, winnow(ids, k, size - k + 1)[1]))
            self.names.append(name)
            parts.append(ids)
            at += len(ids)
        self.flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.levels = []
        for size, some in by_size.items():
            starts = np.concatenate([np.arange(a, a + n, dtype=np.int32) for a, _, n, _ in some])
            item = np.concatenate([np.full(n, i, np.int32) for _, i, n, _ in some])
            self.levels.append(_Level(size, starts, item, np.concatenate([p for *_, p in some]), self.flat))

    def search(self, ids: np.ndarray):
        """(starts, size, items) of the occurrences of windows, a row per window and item that has it."""
        for level in self.levels:
            size = level.size
            at, h = winnow(ids, level.k, level.w)
            near = np.minimum(np.searchsorted(level.prints, h), len(level.prints) - 1)
            at = at[level.prints[near] == h]
            if not len(at):
                continue
            around = (at[:, None] + np.arange(level.k - size, 1)).ravel()  # every window that holds the hit
            around = np.unique(around[(around >= 0) & (around + size <= len(ids))])
            for i in range(0, len(around), COMPARED):
                starts = around[i : i + COMPARED]
                h = _hashed(ids, starts, size)
                low, high = np.searchsorted(level.hashes, h, "left"), np.searchsorted(level.hashes, h, "right")
                n = high - low
                starts, low, n = starts[n > 0], low[n > 0], n[n > 0]
                for part in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(np.cumsum(n) // COMPARED)) + 1):
                    m = n[part]
                    mine = np.repeat(starts[part], m)
                    theirs = np.repeat(low[part], m) + np.arange(len(mine)) - np.repeat(np.cumsum(m) - m, m)
                    same = np.ones(len(mine), bool)
                    for k in range(size):
                        same &= ids[mine + k] == self.flat[level.starts[theirs] + k]
                    if same.any():
                        yield mine[same], size, level.item[theirs[same]]


def _matches(texts: list, index: Index) -> tuple[list, list, list]:
    """Per text: number of words, hit stretches [start, end), items. The texts are searched as one sequence of words;
    between two of them stands a gap of a number that no benchmark word has."""
    split = [words(t) for t in texts]
    sizes = [len(w) for w in split]
    starts = np.cumsum([0] + [n + 1 for n in sizes])
    total = int(starts[-1])
    items: list[set[str]] = [set() for _ in texts]
    change = np.zeros(total + 1, np.int64)  # +1 where a window begins, -1 where it ends
    get = index.vocabulary.get
    ids = np.zeros(total, np.int32)
    for at, got in zip(starts.tolist(), split, strict=False):
        ids[at : at + len(got)] = [get(w, 0) for w in got]
    for begin, size, item in index.search(ids):
        np.add.at(change, begin, 1)
        np.add.at(change, begin + size, -1)
        doc = np.searchsorted(starts, begin, "right") - 1
        for d, i in np.unique(np.stack([doc, item], 1), axis=0).tolist():
            items[d].add(index.names[i])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8), [0]])))
    spans: list[list[dict]] = [[] for _ in texts]
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        d = int(np.searchsorted(starts, a, "right")) - 1
        spans[d].append({"start": a - int(starts[d]), "end": b - int(starts[d])})
    return sizes, spans, items


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns n_words, spans (hit stretches of words, end exclusive) and items (item ids as strings, sorted).

    Null or empty texts have no words and no hits; benchmark items without words have no windows. A null item id is the
    string "null". Repeated rows each get their own result; items that repeat count once. An empty benchmark hits
    nothing. Columns of ``docs`` of those names are replaced.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(*[c for c in docs.columns if c not in ("n_words", "spans", "items")])
    bench = benchmark.where(F.length("text") > 0).select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").distinct()
    volume = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = volume // (2 * GROUP_WORDS) + 1  # a word takes two characters at least
    stretch = T.StructType().add("start", T.LongType()).add("end", T.LongType())
    schema = T.StructType(list(rows.schema)).add("n_words", T.LongType()).add("spans", T.ArrayType(stretch)).add("items", T.ArrayType(T.StringType()))
    base = len(rows.columns)
    for g in range(groups):
        part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g) if groups > 1 else bench
        sent, name = spark.sparkContext.broadcast([(r.item, r.text) for r in part.collect()]), uuid.uuid4().hex

        def work(batches, sent=sent, name=name):
            index = None
            for whole in batches:
                for b in text_slices(whole, text_col):
                    if index is None:
                        index = per_worker(("benchmark", name), lambda: Index(sent.value, window))
                    sizes, spans, items = _matches(b.column(b.schema.get_field_index(text_col)).to_pylist(), index)
                    if b.num_columns > base:  # found in the passes before
                        spans = [_merged(x + y) for x, y in zip(spans, b.column(base + 1).to_pylist(), strict=True)]
                        items = [x | set(y) for x, y in zip(items, b.column(base + 2).to_pylist(), strict=True)]
                    new = [pa.array(sizes, pa.int64()), pa.array(spans, _SPANS), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*b.columns[:base], *new], names=schema.names)

        before, rows = rows, rows.mapInArrow(tidied(work), schema)
        if groups > 1:
            rows = materialize(rows, "decontamination")
            drop(before)
    return rows


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') as w from documents),
b as (select coalesce(cast(item_id as varchar), 'null') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') as w from benchmark),
bw as (select distinct item, least(len(w), 10) as n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') as g
       from (select item, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) as s from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select r, n, s, array_to_string(w[s:s + n - 1], ' ') as g
       from (select r, w, n, unnest(generate_series(1, len(w) - n + 1)) as s from d, sizes where len(w) >= n)),
m as (select dw.r, dw.n, dw.s, bw.item from dw join bw on dw.n = bw.n and dw.g = bw.g),
h as (select r, count(*) as n_hit from (select distinct r, unnest(generate_series(s, s + n - 1)) as p from m) group by r),
i as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from m) group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items,
       sha256(coalesce(i.items, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from d left join h on h.r = d.r left join i on i.r = d.r
"""
