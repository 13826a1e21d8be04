"""WARC archives: a writer with revisit records, and a reader that salvages what damaged archives still hold.

Writing. Payloads are told apart by digests. The rows of one digest name their response, the one with the greatest id, in an aggregation
that combines before its shuffle; groups that hold over 1 / HOT of all rows, fewer than HOT by that, come back to
their rows by broadcast, the others by a join. Only rows that become a response carry their payload through a shuffle. Each record is a gzip
member of its own, and Spark's text writer writes and commits the files: of a task that is lost or run twice, one attempt's file stays.

Reading. A record counts if all its checks hold: the member's checksum, version line, named fields, length, the two line ends after the
block, and the digests that it states. After a check that fails the reader looks for the next member or version line whose record
passes all checks, goes on from there, and lists the bytes between as a gap with the first check that failed. Files are read in
pieces; a task holds one record's payload at most.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, materialize, passing, scratch_dir, short_batches, text_slices, tidied

#: A group of more than 1 / HOT of all rows comes by broadcast: fewer than HOT groups can be so large.
HOT = 10_000
#: Bytes read at a time, and of a record's named fields at most.
PIECE, MOST_FIELDS = 1 << 20, 1 << 20
#: Bytes at a time of a member that is broken somewhere.
SMALL = 1 << 9
#: Repetitions of one row that a task writes at a time.
REPEATED = 1000
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_LONGEST_START = 10
END = b"\r\n\r\n"


# Writing.


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr(parts))}>"


def _uri(url: str) -> str:
    """The URL with everything that can't stand in a field's line percent-encoded."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~")


def record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """A record up to and with the two line ends that close it. Fields without a value are left out."""
    named = {"WARC-Type": kind, **fields, "WARC-Block-Digest": f"sha1:{_base32(hashlib.sha1(block).digest())}", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in named.items() if v is not None)
    return VERSION + lines.encode() + b"\r\n" + block + END


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member that ends in a zero byte: the last of its length, or, from 16 MB on, that of an empty member after it."""
    gzip = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = gzip.compress(data) + gzip.flush()
    return out if out.endswith(b"\0") else out + member(b"")


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _records(row: dict, date: str) -> Iterator[bytes]:
    """The records of a planned row: as many as its repetitions from ``start`` to before ``stop``."""
    url, best = row["url"], row["best_url"]
    to = {}
    if row["kind"] == "revisit":
        to = {
            "WARC-Profile": IDENTICAL,
            "WARC-Refers-To": _record_id(row["digest"], row["best_id"], best, 0),
            "WARC-Refers-To-Target-URI": None if best is None else _uri(best),
            "WARC-Refers-To-Date": date,
            "WARC-Truncated": "length",
            "Refers-To-Source-ID": None if row["best_id"] is None else quote(row["best_id"], safe=""),
        }
    block = _http(row["size"]) + (row["payload"] or "").encode()
    for n in range(row["start"], row["stop"]):
        named = {
            "WARC-Record-ID": _record_id(row["digest"], row["id"], url, n),
            "WARC-Date": date,
            "WARC-Target-URI": None if url is None else _uri(url),
            "WARC-Payload-Digest": f"sha1:{_base32(bytes.fromhex(row['sha1']))}",
            "Content-Type": "application/http; msgtype=response",
            "Source-ID": None if row["id"] is None else quote(row["id"], safe=""),
        }
        yield record(row["kind"], named | to, block)


def _plan(rows: DataFrame, least: int) -> DataFrame:
    """(key, id, url, digest, sha1, size, best_id, best_url, kind, start, stop): what records the distinct rows give, repetitions in
    ranges of at most REPEATED."""
    every = materialize(rows.groupBy("key", "rank", "id", "url", "digest", "sha1", "size").agg(F.count("*").alias("copies")), "warc-rows")
    best = every.where(F.col("size") >= least).groupBy("digest").agg(F.max(F.struct("rank", "url", "id")).alias("best"), F.sum("copies").alias("n"))
    best = materialize(best, "warc-digests")
    total = every.agg(F.sum("copies")).first()[0] or 0
    hot = best.where(F.col("n") * HOT > total)
    of_hot = every.join(F.broadcast(hot), "digest")
    of_cold = every.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(best.where(F.col("n") * HOT <= total), "digest", "left")
    mine = F.col("best").eqNullSafe(F.struct("rank", "url", "id"))
    first = F.when(F.col("size") < least, F.col("copies")).when(mine, F.lit(1)).otherwise(0)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), a.cast("long").alias("start"), b.alias("end")) for k, a, b in (("response", F.lit(0), first), ("revisit", first, F.col("copies")))])
    parts = of_hot.unionByName(of_cold).withColumn("_k", F.explode(F.filter(kinds, lambda k: k["start"] < k["end"])))
    parts = parts.withColumn("start", F.explode(F.sequence("_k.start", F.col("_k.end") - 1, F.lit(REPEATED).cast("long"))))
    return materialize(
        parts.select("key", "id", "url", "digest", "sha1", "size", F.col("best.id").alias("best_id"), F.col("best.url").alias("best_url"), "_k.kind", "start", F.least(F.col("start") + REPEATED, F.col("_k.end")).alias("stop")),
        "warc-plan",
    )


def write(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE, compress: bool = True) -> None:
    """Write a record for every row of ``pages`` below ``folder``, a path of any store that Spark writes to.

    Of rows with equal payloads of at least ``least`` bytes the one with the greatest id is a response (with the greatest url if ids
    repeat; of rows equal in all three, one), the others are revisits of it; rows with smaller payloads are all responses. A null payload is
    the empty one, a null id the smallest; null ids and urls are left out of the record. Line ends and other
    characters that can't stand in a field are percent-encoded in urls and ids. Other columns are ignored, whatever their names. An
    empty table makes no record. Files hold gzip members, or with ``compress`` off plain records.
    """
    spark = pages.sparkSession
    short_batches(spark)
    given = pages.select(F.col(id_col).alias("rank"), F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    named = given.withColumns({"digest": F.sha2("payload", 256), "sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    named = named.withColumn("key", F.unhex(F.sha2(F.to_json(F.struct("digest", "id", "url")), 256)))

    def work(batches):
        for whole in batches:
            for b in text_slices(whole, "payload"):
                out, size = [], 0
                for row in b.to_pylist():
                    for r in _records(row, date):
                        out.append(member(r)[:-1] if compress else r[: -len(END)])
                        size += len(out[-1])
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                            out, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    with passing(spark):
        plan = _plan(named.drop("payload"), least)
        payloads = named.groupBy("key").agg(F.first("payload").alias("payload"))  # repeated rows fold before the shuffle
        rows = plan.where("kind = 'response'").join(payloads, "key")
        rows = rows.unionByName(plan.where("kind = 'revisit'").repartition("key", "start").withColumn("payload", F.lit(None).cast("string")))
        records = rows.drop("key").mapInArrow(tidied(work), "value binary").select(F.col("value").cast("string"))
        # What ends a member or a plain record is what the text writer puts after each value.
        records.write.option("lineSep", "\0" if compress else END.decode()).text(folder)


# Reading.


class Damaged(Exception):
    """A check that failed; ``end`` is where the damaged member ends, if that is known."""

    end: int | None = None


class Source:
    """A file's bytes by offset, with one piece held."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.held = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at`` on, fewer at the file's end."""
        n = max(0, min(n, self.size - at))
        if not self.base <= at or at + n > self.base + len(self.held):
            self.file.seek(at)
            self.base, self.held = at, self.file.read(max(n, min(PIECE, self.size - at)))
        return self.held[at - self.base : at - self.base + n]

    def start_after(self, at: int) -> int:
        """Where the next member or version line may begin, from ``at`` on; the file's end if nowhere."""
        while at < self.size:
            part = self.get(at, PIECE)
            if found := _START.search(part):
                return at + found.start()
            if at + len(part) >= self.size:
                break
            at += len(part) - _LONGEST_START
        return self.size


def _inflated(src: Source, at: int, step: int = PIECE) -> Iterator[bytes]:
    """The member at ``at`` in pieces of at most ``step`` bytes; returns where it ends. What zlib made of a damaged step is lost."""
    gzip = zlib.decompressobj(31)
    while not gzip.eof:
        part = src.get(at, step)
        if not part:
            raise Damaged("member is cut off")
        try:
            out = gzip.decompress(part, step)
        except zlib.error as e:
            raise Damaged(f"member: {e}") from None
        at += len(part) - len(gzip.unused_data if gzip.eof else gzip.unconsumed_tail)
        if out:
            yield out
    return at


class _Stream:
    """Bytes of an iterator of pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.end = pieces, b"", False

    def _more(self) -> bool:
        try:
            self.held += next(self.pieces)
        except StopIteration:
            self.end = True
            return False
        return True

    def ended(self) -> bool:
        return not self.held and (self.end or not self._more())

    def head(self) -> bytes:
        """Up to the empty line that closes the named fields, without it."""
        while (found := self.held.find(END)) < 0:
            if len(self.held) > MOST_FIELDS:
                raise Damaged("named fields do not end")
            if not self._more():
                raise Damaged("record is cut off" if self.held else "record is empty")
        out, self.held = self.held[:found], self.held[found + len(END) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self._more():
                raise Damaged("block is cut off")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out


def _plain(src: Source, at: int) -> Iterator[bytes]:
    while part := src.get(at, PIECE):
        yield part
        at += len(part)
    return at


def fields(head: bytes) -> dict[str, str]:
    """The named fields below a version line, by lower-case name; a line that begins with white space goes on the one before."""
    if not (version := _VERSION.match(head + b"\r\n")):
        raise Damaged("no version line")
    out, last = {}, None
    for line in head[version.end() :].split(b"\r\n"):
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon or not name.strip():
            raise Damaged("named field without a colon")
        last = name.strip().lower()
        out[last] = value.strip()
    for name in ("warc-type", "warc-record-id", "content-length"):
        if not out.get(name):
            raise Damaged(f"no {name}")
    if not re.fullmatch("[0-9]{1,18}", out["content-length"]):
        raise Damaged("length is no number")
    return out


class _Digest:
    """Holds bytes against a stated digest; one of an unknown algorithm holds always."""

    def __init__(self, stated: str | None):
        name, _, self.stated = (stated or "").partition(":")
        self.hash = hashlib.new(name.lower().replace("-", "")) if self.stated and name.lower().replace("-", "") in ("md5", "sha1", "sha256", "sha512") else None

    def update(self, data: bytes) -> None:
        if self.hash:
            self.hash.update(data)

    def holds(self) -> bool:
        if not self.hash:
            return True
        got = self.hash.digest()
        return self.stated.upper().rstrip("=") == _base32(got).rstrip("=") or self.stated.lower() == got.hex()


def _read(stream: _Stream, keep: bool, fits=lambda length: None) -> dict:
    """The next record of a stream, all its checks made. ``fits`` raises if the length can't be right."""
    named = fields(stream.head())
    kind, length = named["warc-type"].lower(), int(named["content-length"])
    fits(length)
    block = _Digest(named.get("warc-block-digest"))
    whole = kind != "revisit" and named.get("warc-segment-number", "1") == "1" and "warc-segment-total-length" not in named
    payload = _Digest(named.get("warc-payload-digest") if whole else None)
    bare = not named.get("content-type", "").lower().startswith("application/http")
    http, held, size = b"", bytearray(), 0
    for part in stream.take(length):
        block.update(part)
        if not bare:  # up to the empty line: the headers of the exchange
            http += part
            if (found := http.find(END)) < 0:
                if len(http) > MOST_FIELDS:
                    raise Damaged("headers of the exchange do not end")
                continue
            http, part, bare = http[:found], http[found + len(END) :], True
        payload.update(part)
        size += len(part)
        if keep:
            held += part
    if b"".join(stream.take(len(END))) != END:
        raise Damaged("no line ends after the block")
    if not block.holds():
        raise Damaged("block digest differs")
    if not payload.holds():
        raise Damaged("payload digest differs")
    if kind == "revisit":
        told = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]{1,18})[ \t]*(?:\r|$)", http)
        size = int(told[1]) if told else None
    return {
        "record_type": kind,
        "record_id": named["warc-record-id"],
        "target_uri": named.get("warc-target-uri"),
        "date": named.get("warc-date"),
        "refers_to": named.get("warc-refers-to"),
        "payload_digest": named.get("warc-payload-digest"),
        "payload_bytes": size,
        "payload": bytes(held) if keep and kind != "revisit" else None,
        "fields": list(named.items()),
    }


def _member_at(src: Source, at: int, keep: bool) -> Iterator[dict]:
    """The records of the member at ``at``; returns where it ends. The checksum comes first; a member of over a piece is inflated again
    for its records, not held. Where the checksum fails, those records before the damage count that state a digest of their block."""
    held, size, broken, end = [], 0, None, None
    pieces = _inflated(src, at)
    while True:
        try:
            part = next(pieces)
        except StopIteration as e:
            end = e.value
            break
        except Damaged as e:
            broken = e
            break
        size += len(part)
        held = [*held, part] if size <= PIECE else []
    stream = _Stream(_inflated(src, at, SMALL) if broken else iter(held) if size <= PIECE else _inflated(src, at))
    try:
        while not stream.ended():
            found = _read(stream, keep)
            if not broken or any(n == "warc-block-digest" for n, _ in found["fields"]):
                yield found
    except Damaged as e:
        e.end = end
        raise broken or e from None
    return end


def _records_at(src: Source, at: int, keep: bool) -> Iterator[dict]:
    """The records of the member, or the plain record, at ``at``; returns where it ends."""
    if src.get(at, 2) == b"\x1f\x8b":
        return (yield from _member_at(src, at, keep))
    if not src.get(at, 5) == b"WARC/":
        raise Damaged("neither a member nor a version line")
    stream = _Stream(_plain(src, at))

    def fits(length: int) -> None:
        end = at + head_length(src, at) + length
        if src.get(end, len(END)) != END:
            raise Damaged("no line ends after the block")

    out = _read(stream, keep, fits)
    yield out
    return at + head_length(src, at) + int(dict(out["fields"])["content-length"]) + len(END)


def head_length(src: Source, at: int) -> int:
    return src.get(at, MOST_FIELDS + PIECE).find(END) + len(END)


def salvage(src: Source, keep: bool = True) -> Iterator[dict]:
    """Records of a file with the offset of their member, in its order, and the gaps between them: {start, end, reason}."""
    at, gap, reason = 0, None, None
    while at < src.size:
        steps = _records_at(src, at, keep)
        try:
            while True:
                try:
                    found = next(steps)
                except StopIteration as e:
                    end = e.value
                    break
                if gap is not None:
                    yield {"start": gap, "end": at, "reason": reason}
                    gap = None
                yield found | {"start": at}
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            at = e.end or src.start_after(at + 1)
            continue
        if gap is not None:  # a sound member without a record
            yield {"start": gap, "end": at, "reason": reason}
            gap = None
        at = end
    if gap is not None:
        yield {"start": gap, "end": src.size, "reason": reason}


ROW = pa.schema(
    [
        ("path", pa.string()),
        ("start", pa.int64()),
        ("end", pa.int64()),
        ("reason", pa.string()),
        *[(c, pa.string()) for c in ("record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest")],
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
        ("fields", pa.map_(pa.string(), pa.string())),
    ]
)
SCHEMA = "path string, start bigint, end bigint, reason string, record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes bigint, payload binary, fields map<string,string>"
ROWS = 256


def read(spark: SparkSession, folder: str, payloads: bool = True, glob: str = "part-*") -> DataFrame:
    """Every record and gap of the archives below ``folder`` whose names match ``glob``, compressed or not.

    A record has its type, id, target, date, what it refers to, stated payload digest, and named fields; its start is that of its
    member. payload_bytes counts the payload; for a revisit it is the length that the exchange's headers state, null if none. With
    ``payloads`` off payloads are checked but not returned. A gap has (start, end, reason) and nothing else: bytes in which no sound
    record begins, with the first check that failed. An empty file has neither. Spark lists the files; tasks read them through
    Arrow's file systems.
    """
    short_batches(spark)

    def work(batches):
        for b in batches:
            for path, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, name = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                held, weight = [], 0
                with fs.open_input_file(name) as f:
                    for found in salvage(Source(f, size), payloads):
                        held.append({"path": path} | found)
                        weight += len(found.get("payload") or b"")
                        if len(held) >= ROWS or weight >= PIECE:
                            yield pa.RecordBatch.from_pylist(held, ROW)
                            held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, ROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length")
    return files.mapInArrow(tidied(work), SCHEMA)


def _source_id(name: str, kind: str) -> Column:
    return F.url_decode(F.get(F.map_values(F.map_filter("fields", lambda k, _: k == name)), F.lit(0))).cast(kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    return read(spark, folder, payloads=False).where("reason IS NULL").select(
        _source_id("source-id", pages.schema["page_id"].dataType.simpleString()).alias("page_id"),
        "payload_bytes",
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type",
        _source_id("refers-to-source-id", pages.schema["page_id"].dataType.simpleString()).alias("refers_to"),
    )


# Five hex digits are four of base 32.
SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select *, upper(sha1(h)) as hex from p)
select page_id, octet_length(encode(h))::bigint as payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int + 1, 1) for i in range(32)], '') as payload_digest,
       case when row_number() over w = 1 then 'response' else 'revisit' end as record_type,
       case when row_number() over w > 1 then max(page_id) over (partition by h) end as refers_to
from d
window w as (partition by h order by page_id desc nulls last)
"""
