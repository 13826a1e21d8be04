"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its word shingles, hashed to 64 bits; equal sets are one class. The shingles stand in the
order of their hashes. Of n shingles a pair at or over the threshold misses at most tau, so shared shingles must show
in short prefixes. Those that few documents have in their prefixes (rare) are indexed alone. The frequent ones are
dealt into parts by hash, and pairs of one part are indexed: a part with x of them in the prefix accounts for x - 1
misses, so the prefix is extended until rare ones and parts account for tau + 1. The number of parts grows with the size
of a document; it is fixed per band of sizes, and a document is indexed under each band that a smaller partner can be in.
Common shingles so never lead to one another's documents unless two of them meet.

Documents under one index key are compared by size and by a parity bitmap of their sets: the bits in which two bitmaps
differ are no more than the shingles in which the sets differ, so nothing over the threshold is lost. Of those that pass,
each key gives a spanning forest, never all pairs. The forests' components hold every link. Inside each component
the sets themselves are compared, again giving a spanning forest, now of true links, whose components are the result.

A key or component of many documents is dealt out, and nothing is capped. First its documents are dealt into blocks (those of a component
each with the same few of them besides); groups of near copies become one there. Where that leaves several parts, the largest
stays in its blocks and the others meet each of them, and one another by pairs of blocks; documents of one part are not compared again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, drop, materialize, passing, per_worker, short_batches, text_slices, tidied
from .graph import components

#: Shingles in more prefixes than this are indexed in pairs.
FREQUENT = 16
#: Documents of a block of an index key or of a component; shingles of a block of a component; documents that all first blocks have.
BLOCK_DOCS, BLOCK_SHINGLES, PIVOTS = 2_000, 1_000_000, 16
#: Signatures whose documents stay in several parts are sent to workers up to so many, some 500 bytes each; beyond, they are joined.
OPEN_KEYS = 50_000
#: Rows of a cell from which on a document is compared with all others of it at once.
WIDE_CELL = 48
#: Bits of a bitmap for each shingle: of those that are shuffled, and of those made where the sets are at hand.
SHUFFLED_BITS, LOCAL_BITS = 0.5, 4
#: Word hashes that a worker remembers at most.
CACHE = 100_000
#: Sizes from one band to the next.
BAND = 1.5

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; of fewer words the whole sequence is one."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    memo = per_worker(("shingle-words",), _Words)
    if len(memo) > CACHE:
        memo.clear()
    h = np.array([memo[w] for w in words], np.uint64)
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + h[j : j + len(out)])
    return np.unique(out)


class Rule:
    """The arithmetic of a threshold of num/den; integers throughout."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)

    def sizes(self, a, b):
        return (a * self.den >= b * self.num) & (b * self.den >= a * self.num)

    def tau(self, n: int) -> int:
        """Shingles of n that a partner may lack, at most."""
        return n - -(-self.num * n // self.den)

    def misses(self, a: int, b: int) -> int:
        """Shingles that only one of two sets has, at most."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def alone(self, n: int) -> bool:
        """Whether no set but an equal one can be linked with one of n."""
        return n * self.den // self.num == n and -(-n * self.num // self.den) == n and not self.linked(n - 1, n, n)

    def band(self, n: int) -> int:
        k, edge = 0, 1.0
        while edge * BAND <= n:
            edge *= BAND
            k += 1
        return k

    def parts(self, band: int) -> int:
        return max(1, self.tau(int(BAND**band)) // 3)

    def bands(self, n: int) -> range:
        return range(self.band(-(-self.num * n // self.den)), self.band(n) + 1)

    def reach(self, n: int) -> int:
        """Length of prefix that is always enough."""
        return min(n, self.tau(n) + 1 + self.parts(self.band(n)))


def bitmap(s: np.ndarray, per_shingle: float = SHUFFLED_BITS) -> bytes:
    """Parity of the set's hashes by bit; a power of two of bits, and never more for fewer shingles."""
    bits = 64
    while bits < int(len(s) * per_shingle):
        bits *= 2
    odd = np.bincount((s >> _U(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(x: int, bits: int, to: int) -> int:
    while bits > to:
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return x


def _signatures(n: int, tokens: list[tuple[int, int, int]], rule: Rule):
    """(key, least upper bound of the documents under it) of a set of n, given (position, hash, documents) of those prefix
    shingles that other prefixes have too."""
    known = {p: (h, c) for p, h, c in tokens}
    for band in rule.bands(n):
        parts, met, left = rule.parts(band), {}, rule.tau(n) + 1
        for p in range(rule.reach(n)):
            h, c = known.get(p, (0, 0))
            if c <= FREQUENT:
                if c:
                    yield h, c
                left -= 1
            else:
                mine = met.setdefault((h >> 17) % parts, [])
                for g, d in mine:
                    yield int.from_bytes(hashlib.blake2b(f"{band}:{g}:{h}".encode(), digest_size=8).digest(), "big"), min(c, d)
                left -= bool(mine)
                mine.append((h, c))
            if not left:
                break


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


class _Bitmaps:
    """Bitmaps of rows in ascending order of size, so that those of one width stand together."""

    def __init__(self, maps: list[bytes], n: np.ndarray, rule: Rule):
        self.n, self.rule = n, rule
        self.words = np.array([len(m) // 8 for m in maps])
        edges = [0, *(np.flatnonzero(np.diff(self.words)) + 1).tolist(), len(maps)]
        self.parts = [(a, b, int(self.words[a]), np.frombuffer(b"".join(maps[a:b]), "<u8").reshape(b - a, -1)) for a, b in zip(edges, edges[1:], strict=False) if b > a]
        self.folded: dict[tuple[int, int], np.ndarray] = {}

    def _at_width(self, k: int, words: int) -> np.ndarray:
        a, _, own, m = self.parts[k]
        if own == words:
            return m
        if (k, words) not in self.folded:
            while m.shape[1] > words:
                half = m.shape[1] // 2
                m = m[:, :half] ^ m[:, half:]
            self.folded[k, words] = m
        return self.folded[k, words]

    def near(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Those of the ascending ``rows``, all after i, whose sets may differ from row i's in no more than a link allows."""
        words = int(self.words[i])
        own = next(k for k, p in enumerate(self.parts) if p[0] <= i < p[1])
        mine = self.parts[own][3][i - self.parts[own][0]]
        out = []
        for k in range(own, len(self.parts)):
            a, b, _, _ = self.parts[k]
            at = rows[np.searchsorted(rows, a) : np.searchsorted(rows, b)]
            if len(at):
                differ = np.bitwise_count(self._at_width(k, words)[at - a] ^ mine).sum(axis=1, dtype=np.int64)
                out.append(at[differ <= self.rule.misses(int(self.n[i]), self.n[at])])
        return np.concatenate(out) if out else rows[:0]


def _spanning(n: np.ndarray, maps: list[bytes], rule: Rule, linked=None, part=None, side=None):
    """Pairs of rows (ascending in size n) that span what passes sizes, bitmaps and ``linked``. Rows of one ``part`` count as joined
    already; with ``side`` only rows of different sides are compared."""
    label = np.unique(part, return_inverse=True)[1] if part is not None else np.arange(len(n))
    left = len(np.unique(label))
    bits = _Bitmaps(maps, n, rule)
    for i in range(len(n) - 1):
        if left == 1:
            return
        stop = int(np.searchsorted(n * rule.num, n[i] * rule.den, "right"))
        rows = np.flatnonzero(label[i + 1 : stop] != label[i]) + i + 1
        if side is not None:
            rows = rows[side[rows] != side[i]]
        if not len(rows):
            continue
        for j in bits.near(i, rows).tolist():
            if label[j] != label[i] and (linked is None or linked(i, j)):
                yield i, j
                label[label == label[j]] = label[i]
                left -= 1


def _runs(batches, key: str):
    """Record batches in which every run of ``key`` is whole, from batches that come sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy()
        edge = np.flatnonzero(k[1:] != k[:-1])
        cut = int(edge[-1]) + 1 if len(edge) else 0
        if cut or (held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != k[0]):
            yield pa.Table.from_batches([*held, b.slice(0, cut)] if cut else held).combine_chunks()
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _pairs(node: np.ndarray, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    i, j = np.array(pairs).T
    return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])


def _optional(t: pa.Table, name: str) -> np.ndarray | None:
    return t.column(name).to_numpy() if name in t.column_names else None


def _forest_by_bitmap(batches, rule: Rule):
    """Spanning forests of the pairs under one cell that pass sizes and bitmaps."""
    for t in _runs(batches, "cell"):
        cell, node, n = (t.column(c).to_numpy() for c in ("cell", "node", "n"))
        part, side, maps = _optional(t, "part"), _optional(t, "side"), t.column("bits")
        edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        small = np.ones(len(cell), bool)
        out = []
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a >= WIDE_CELL or (part is not None and b - a > 1):
                small[a:b] = False
                order = a + np.argsort(n[a:b], kind="stable")
                got = _spanning(n[order], [maps[k].as_py() for k in order.tolist()], rule, None, part if part is None else part[order], side if side is None else side[order])
                out += [(order[i], order[j]) for i, j in got]
        out += _small_forests(cell, node, n, maps, np.flatnonzero(small), rule)
        if out:
            yield _pairs(node, out)


def _small_forests(cell, node, n, maps, at: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """The same for many cells of few rows: all pairs of rows that stand d apart at a time."""
    cell, node, n = cell[at], node[at], n[at]
    ints: dict[int, tuple[int, int]] = {}

    def bits(i: int) -> tuple[int, int]:
        if (x := ints.get(i)) is None:
            raw = maps[int(at[i])].as_py()
            x = ints[i] = (int.from_bytes(raw, "little"), 8 * len(raw))
        return x

    forest, out, d = _Forest(len(cell)), [], 1
    while d < len(cell):
        same = cell[d:] == cell[:-d]
        if not same.any():
            break
        for i in np.flatnonzero(same & (node[d:] != node[:-d]) & rule.sizes(n[d:], n[:-d])).tolist():
            j = i + d
            if forest.root(i) == forest.root(j):
                continue
            (x, p), (y, q) = bits(i), bits(j)
            if p != q:
                x, y = _fold(x, p, q), _fold(y, q, p)
            if (x ^ y).bit_count() <= rule.misses(int(n[i]), int(n[j])):
                forest.join(i, j)
                out.append((int(at[i]), int(at[j])))
        d += 1
    return out


def _forest_by_set(batches, rule: Rule):
    """Spanning forests of the true links in one cell."""
    for t in _runs(batches, "cell"):
        cell, node = t.column("cell").to_numpy(), t.column("node").to_numpy()
        part, side, sets = _optional(t, "part"), _optional(t, "side"), t.column("shingles")
        out = []
        for whole in np.split(np.arange(len(cell)), np.flatnonzero(cell[1:] != cell[:-1]) + 1):
            if len(whole) < 2:
                continue
            got = [sets[int(i)].values.to_numpy().view(np.uint64) for i in whole]
            n = np.array([len(x) for x in got])
            order = np.argsort(n, kind="stable")
            got, n, whole = [got[k] for k in order.tolist()], n[order], whole[order]

            def linked(i: int, j: int, got=got) -> bool:
                a, b = got[i], got[j]
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                return rule.linked(int((b[at] == a).sum()), len(a), len(b))

            pairs = _spanning(n, [bitmap(x, LOCAL_BITS) for x in got], rule, linked, part if part is None else part[whole], side if side is None else side[whole])
            out += [(whole[i], whole[j]) for i, j in pairs]
        if out:
            yield _pairs(node, out)


def _dealt(df: DataFrame, blocks: str, by: str, *keys) -> DataFrame:
    """Rows to the cells of pairs of blocks that their block is in: one cell for one block, else ``blocks`` of them."""
    block = F.pmod(F.xxhash64(by, F.lit(5)), F.col(blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    out = df.withColumn("_block", block).withColumn("_other", other)
    cell = F.when(F.col(blocks) == 1, F.xxhash64(*keys)).otherwise(F.xxhash64(*keys, F.least("_block", "_other"), F.greatest("_block", "_other")))
    return out.withColumn("cell", cell).drop("_block", "_other")


def _links(cells: DataFrame, work, payload: str, *more: str) -> DataFrame:
    """The links (a, b) that ``work`` makes of cells."""
    spark = cells.sparkSession
    cells = cells.select("cell", "node", "n", payload, *more).repartition(_parts(spark), "cell").sortWithinPartitions("cell", "node")
    return cells.mapInArrow(tidied(work), "a bigint, b bigint")


def _large(rows: DataFrame, work, payload: str, rule: Rule) -> DataFrame:
    """The links (a, b) that span those of every group of ``rows``, a written table (key, blocks, docs, node, n, payload) of groups that
    are too large for a cell; docs is the number of a group's rows, blocks how many blocks they need."""
    block = F.pmod(F.xxhash64("node", "key"), F.col("blocks"))
    pivot = F.pmod(F.xxhash64("node", "key", F.lit(7)), F.greatest(F.lit(1), F.floor(F.col("docs") / PIVOTS))) == 0
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    first = rows.withColumn("_block", F.explode(F.when(pivot, every).otherwise(F.array(block)))).withColumn("cell", F.xxhash64("key", "_block"))
    found = materialize(_links(first, work, payload), "join-block-links")
    parts = components(found).withColumnRenamed("root", "part")
    rows = rows.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    apart = _apart(rows)
    return found if apart.isEmpty() else found.union(_across(_open(rows.drop("docs"), apart, rule), work, payload))


def _apart(rows: DataFrame) -> DataFrame:
    """Of the groups of ``rows`` (key, node, n, part) those in several parts: (key, docs, _most, _low, _high), with the number of rows, size
    and name of the largest part, and the least and greatest n in the others. Of groups with the same documents, told by their
    number and 128 bits of hashes, one stands for all."""
    marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"_x{i}") for i in (1, 2)]
    sizes = materialize(rows.groupBy("key", "part").agg(F.count("*").alias("_n"), F.min("n").alias("_low"), F.max("n").alias("_high"), *marks), "join-parts")
    again = [F.bit_xor(f"_x{i}").alias(f"_x{i}") for i in (1, 2)]
    groups = sizes.groupBy("key").agg(F.sum("_n").alias("docs"), F.max(F.struct("_n", "part")).alias("_most"), F.count("*").alias("_parts"), *again).where("_parts > 1")
    groups = groups.groupBy("docs", "_x1", "_x2").agg(F.min(F.struct("key", "_most")).alias("_g")).select("_g.*", "docs")
    rest = sizes.join(groups, "key").where("part <> _most.part").groupBy("key").agg(F.first("docs").alias("docs"), F.first("_most").alias("_most"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    return materialize(rest, "join-apart")


def _open(rows: DataFrame, apart: DataFrame, rule: Rule) -> DataFrame:
    """The ``rows`` of groups in several parts, with docs and _most; of a largest part only those whose size allows a link with the others."""
    apart = apart.withColumnRenamed("key", "_k")
    fits = (F.col("n") * rule.den >= F.col("_low") * rule.num) & (F.col("_high") * rule.den >= F.col("n") * rule.num)
    rows = rows.join(apart, (F.col("key") == F.col("_k")) & (fits | (F.col("part") != F.col("_most.part"))))
    return materialize(rows.drop("_k", "_low", "_high"), "join-open-rows")


def _across(rows: DataFrame, work, payload: str) -> DataFrame:
    """The links between the parts of groups, ``rows`` as in ``_large`` with the part that each row is in and the group's largest, _most.
    That stays in its blocks and the others meet each of them, and one another by pairs of blocks."""
    share = lambda n: F.greatest(F.lit(1), F.ceil(F.col("blocks") * n / F.col("docs"))).cast("long")
    rows = rows.withColumn("_main", share(F.col("_most._n"))).withColumn("_rest", share(F.col("docs") - F.col("_most._n")))
    main, rest = rows.where(F.col("part") == F.col("_most.part")), rows.where(F.col("part") != F.col("_most.part"))
    columns = ("cell", "node", "n", payload, "part", "side")
    here = main.withColumn("cell", F.xxhash64("key", F.lit("main"), F.pmod(F.xxhash64("node", F.lit(5)), F.col("_main")))).withColumn("side", F.lit(0))
    there = rest.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_main") - 1))).withColumn("cell", F.xxhash64("key", F.lit("main"), "_b")).withColumn("side", F.lit(1))
    across = _links(here.select(*columns).union(there.select(*columns)), work, payload, "part", "side")
    among = _links(_dealt(rest, "_rest", "node", "key", F.lit("rest")), work, payload, "part")
    return across.union(among)


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join(docs: DataFrame, shingle: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_shingles, component_id, text_hash, kept), where two documents are linked when
    den * |A and B| >= num * |A or B|, and component_id is the least id reachable over links. text_hash is xxhash64 of the
    text; kept marks one row of each component, one with the least id, and every row without shingles.

    Null and empty texts and those without words have no shingles and are linked with nothing. Rows with one text, or
    one set, are linked whatever their ids; null ids are never a component's least, and a component of nothing but
    null ids has a null id. Other columns are ignored. An empty input gives no rows.
    """
    spark, rule = docs.sparkSession, Rule(num, den)
    short_batches(spark)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("hash"))
    id_type = rows.schema["_id"].dataType

    def sets(batches):
        for whole in batches:
            for b in text_slices(whole, "_text"):
                n, key, low, maps = [], [], [], []
                for t in b.column(1).to_pylist():
                    s = shingles(t, shingle)
                    n.append(len(s))
                    key.append(xxhash.xxh3_128_digest(s.tobytes()))
                    low.append(s[: rule.reach(len(s))].view(np.int64) if len(s) and not rule.alone(len(s)) else [])
                    maps.append(bitmap(s))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(low, pa.list_(pa.int64())), pa.array(maps, pa.binary())], names=["_id", "hash", "n", "key", "low", "bits"])

    out = T.StructType().add("_id", id_type).add("hash", T.LongType()).add("n", T.LongType()).add("key", T.BinaryType()).add("low", T.ArrayType(T.LongType())).add("bits", T.BinaryType())
    with passing(spark) as keep:
        every = keep(materialize(rows.mapInArrow(tidied(sets), out).withColumn("uid", F.monotonically_increasing_id()), "join-sets"))
        classes = every.where("n > 0").groupBy("key").agg(F.min("uid").alias("node"), F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "uid")).alias("best"), F.first("n").alias("n"), F.first("low").alias("low"), F.first("bits").alias("bits"))
        classes = materialize(classes, "join-classes")
        close = _candidates(classes, rule)
        found = _verified(rows.select("_id", "_text"), classes, close, shingle, rule)
        members = found.join(classes.select("node", "best"), "node")
        least = members.groupBy("root").agg(F.min("best").alias("first"))
        named = members.join(least, "root").select("node", "first")
        ids = classes.select("key", "node", "best").join(named, "node", "left")
        ids = keep(materialize(ids.select("key", F.coalesce("first", "best").alias("best")), "join-class-ids"))
    plain = every.select("_id", "hash", "uid", "n", "key")
    linked = plain.where("n > 0").join(ids, "key").select("_id", "n", "best._id", "hash", F.col("uid") == F.col("best.uid"))
    empty = plain.where("n = 0").select("_id", "n", F.col("_id"), "hash", F.lit(True))
    return linked.union(empty).toDF(id_col, "n_shingles", "component_id", "text_hash", "kept")


def _block(key: int, node: int, blocks: int) -> int:
    """The cell of a document under a signature that ``blocks`` blocks may be needed for."""
    at = (((node ^ key) * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> 32) % blocks
    return int.from_bytes(hashlib.blake2b(f"{key}:{at}".encode(), digest_size=8).digest(), "big")


def _candidates(classes: DataFrame, rule: Rule) -> DataFrame:
    """(node, root) of the components of pairs that meet under a signature and pass sizes and bitmaps.

    Documents under a signature that more than a block may have are dealt into blocks by a hash that differs from signature to
    signature, each to one, so that what is alike soon hangs together. Then the signatures whose documents still are in several
    parts are looked up, and those parts are compared."""
    tokens = classes.select("node", F.posexplode("low").alias("pos", "token"))
    counts = materialize(tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "join-counts")
    shared = tokens.join(counts, "token").groupBy("node").agg(F.collect_list(F.struct("pos", "token", "c")).alias("tokens"))
    indexed = materialize(shared.join(classes.select("node", "n", "bits"), "node").select("node", "n", "bits", "tokens"), "join-index")
    work = lambda b: _forest_by_bitmap(b, rule)

    def signed(row_n, got):
        return dict(_signatures(row_n, [(x["pos"], x["token"] & (2**64 - 1), x["c"]) for x in got], rule))

    def dealt(batches):
        for b in batches:
            keys, at = [], []
            for i, (node, n, got) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
                mine = [_signed(k if most <= BLOCK_DOCS else _block(k, node, -(-most // BLOCK_DOCS))) for k, most in signed(n, got).items()]
                keys += mine
                at += [i] * len(mine)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(b.column(k).take(at) for k in range(3))], names=["cell", "node", "n", "bits"])

    def large(batches, wanted=None):
        for b in batches:
            keys, at, more = [], [], []
            rows = zip(*(b.column(c).to_pylist() for c in (1, 3, 4)), strict=True)
            for i, (n, got, part) in enumerate(rows):
                mine = [_signed(k) for k, most in signed(n, got).items() if most > BLOCK_DOCS]
                if wanted is not None:
                    kept = [(k, x) for k in mine if (x := wanted.get(k)) and (part != x[1]["part"] or (n * rule.den >= x[2] * rule.num and x[3] * rule.den >= n * rule.num))]
                    mine = [k for k, _ in kept]
                    more += [x for _, x in kept]
                keys += mine
                at += [i] * len(mine)
            at = pa.array(at, pa.int64())
            columns = [pa.array(keys, pa.int64()), *(b.column(k).take(at) for k in (0, 1, 2, 4))]
            names = ["key", "node", "n", "bits", "part"]
            if wanted is not None:
                most = pa.array([x[1] for x in more], pa.struct([("_n", pa.int64()), ("part", pa.int64())]))
                columns, names = [*columns, pa.array([x[0] for x in more], pa.int64()), most], [*names, "docs", "_most"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    close = components(_links(indexed.mapInArrow(tidied(dealt), "cell bigint, node bigint, n bigint, bits binary"), work, "bits"))
    some = indexed.where(F.exists("tokens", lambda t: t["c"] > BLOCK_DOCS))
    if some.isEmpty():
        return close
    some = some.join(close, "node", "left").select("node", "n", "bits", "tokens", F.coalesce("root", "node").alias("part"))
    some = materialize(some, "join-frequent")
    rows = some.mapInArrow(tidied(large), "key bigint, node bigint, n bigint, bits binary, part bigint")
    apart = _apart(rows)
    if apart.isEmpty():
        return close
    if apart.count() <= OPEN_KEYS:  # sent to the workers, so that only rows of these signatures are made
        sent = apart.sparkSession.sparkContext.broadcast({r.key: (r.docs, {"_n": r._most._n, "part": r._most.part}, r._low, r._high) for r in apart.collect()})
        rows = some.mapInArrow(tidied(lambda b: large(b, sent.value)), "key bigint, node bigint, n bigint, bits binary, part bigint, docs bigint, _most struct<_n: bigint, part: bigint>")
        rows = materialize(rows, "join-open-rows")
    else:
        rows = _open(rows, apart, rule)
    rows = rows.withColumn("blocks", F.ceil(F.col("docs") / BLOCK_DOCS))
    links = _links(rows.where("blocks = 1").withColumnRenamed("key", "cell"), work, "bits", "part")
    if not rows.where("blocks > 1").isEmpty():
        links = links.union(_across(rows.where("blocks > 1"), work, "bits"))
    return components(links.union(close.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _verified(rows: DataFrame, classes: DataFrame, close: DataFrame, shingle: int, rule: Rule) -> DataFrame:
    """(node, root) of the components of true links inside those of candidates. The sets are made again from the texts."""
    work = lambda b: _forest_by_set(b, rule)
    volume = materialize(close.join(classes.select("node", "n", "key", "best._id"), "node"), "join-candidate-sets")
    drop(close)
    blocks = volume.groupBy("root").agg(F.count("*").alias("docs"), F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_DOCS)).alias("blocks"))
    blocks = materialize(blocks, "join-candidate-blocks")
    wanted = volume.select(F.col("_id").alias("_want")).distinct()
    read = rows.join(wanted, F.col("_id").eqNullSafe(F.col("_want")), "left_semi")

    def again(batches):
        for whole in batches:
            for b in text_slices(whole, "_text"):
                got = [shingles(t, shingle) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in got], pa.binary()), pa.array([s.view(np.int64) for s in got], pa.list_(pa.int64()))], names=["key", "shingles"])

    named = volume.join(blocks, "root").select("key", "node", "n", F.col("root").alias("group"), "docs", "blocks")
    read = read.select("_text").mapInArrow(tidied(again), "key binary, shingles array<bigint>").join(named, "key")
    read = read.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "group", "docs", "blocks", "shingles")])
    many = not blocks.where("blocks > 1").isEmpty()
    if many:
        read = materialize(read, "join-verified-sets")
    links = _links(read.where("blocks = 1").withColumn("cell", F.xxhash64("group")), work, "shingles")
    if many:
        large = materialize(read.where("blocks > 1").withColumnRenamed("group", "key"), "join-verified-large")
        links = links.union(_large(large, work, "shingles", rule))
    return components(links)


def one_of_each(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``join`` keeps: one of each component, and every row without shingles. Only keys of what goes are
    joined with the texts; rows that repeat an id and its text and of which one stays are thinned apart, by a hash of the whole row.
    Null ids are ids; all columns come back as they are, whatever their names. An empty input gives no rows."""
    with passing(docs.sparkSession) as keep:
        marked = join(docs, shingle, num, den, id_col, text_col).groupBy(id_col, "text_hash").agg(F.sum(F.col("kept").cast("long")).alias("_stay"), F.count("*").alias("_rows"))
        marked = keep(materialize(marked.where("_stay < _rows").withColumnsRenamed({id_col: "_key", "text_hash": "_hash"}), "join-marks"))
    named = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_i"), F.xxhash64(text_col).alias("_h"))
    same = F.col("_i").eqNullSafe(F.col("_key")) & (F.col("_h") == F.col("_hash"))
    kept = named.join(marked.select("_key", "_hash"), same, "left_anti").select("_row")
    some = marked.where("_stay > 0")
    if not some.isEmpty():
        turn = Window.partitionBy("_key", "_hash").orderBy(F.xxhash64("_row"))
        again = named.join(some, same).withColumn("_turn", F.row_number().over(turn)).where("_turn <= _stay")
        kept = kept.unionByName(again.select("_row"))
    return kept.select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select distinct doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') as g
      from (select doc_id, w, unnest(generate_series(1, len(w) - least(len(w), 3) + 1)) as i from d where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
e as materialized (select a, b from l union select b, a from l),
r(root, node) as (select doc_id, doc_id from n union select r.root, e.b from r join e on e.a = r.node where e.b > r.root)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.component_id, d.doc_id) as component_id
from d left join n using (doc_id) left join (select node, min(root) as component_id from r group by node) m on m.node = d.doc_id
"""
