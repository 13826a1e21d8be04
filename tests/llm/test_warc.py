import base64
import gzip
import hashlib
import io
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointfield.llm import warc


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(pages, least):
    """(id, bytes, digest, type, refers to) of every page, from groups of whole payloads."""
    groups = defaultdict(list)
    for p in pages:
        groups[(p.html or "").encode()].append(p)
    out = Counter()
    for data, rows in groups.items():
        rows.sort(key=lambda p: (p.page_id is not None, p.page_id or 0, p.url is not None, p.url or ""))
        for k, p in enumerate(rows):
            first = k == len(rows) - 1 or len(data) < least
            out[(p.page_id, len(data), digest(data), "response" if first else "revisit", None if first else rows[-1].page_id)] += 1
    return out


def back(spark, folder, **how):
    got = warc.read(spark, folder, **how)
    return got.withColumns({"id": warc._source_id("source-id", "bigint"), "to": warc._source_id("refers-to-source-id", "bigint")}).collect()


PAGES = [
    (1, "http://a/", "<p>one</p>"),
    (2, "http://a/", "<p>one</p>"),
    (3, "http://b/?q=a b\r\nWARC-Type: request", "<p>one</p>"),
    (3, "http://b/", "<p>one</p>"),
    (3, "http://b/", "<p>one</p>"),
    (4, None, None),
    (5, "http://ü/東京#x", ""),
    (None, "http://c/", ""),
    (None, None, None),
    (None, None, None),
    (6, "http://d/", "tail \r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nquoted"),
    (-7, "http://e/", "Grüße 東京 𝒳 \x00 end\r\n\r\n"),
    (8, "http://f/", "0123456789" * 300_000),
    (9, "http://g/", "x"),
    (10, "http://h/", "x"),
    (10, "http://h/", "x"),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, h, "clash", b"", 1) for i, u, h in PAGES]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, id string, key binary, size int")


@pytest.mark.parametrize("least, compress", [(0, True), (2, True), (0, False), (5, False)])
def test_round_trip(spark, pages, tmp_path, least, compress):
    folder = f"file://{tmp_path}/w"
    warc.write(pages, folder, least, compress=compress)
    got = back(spark, folder)
    assert [(r.reason, r.start, r.end) for r in got if r.reason] == []
    assert Counter((r.id, r.payload_bytes, r.payload_digest.split(":")[1], r.record_type, r.to) for r in got) == brute(pages.collect(), least)
    ids = {r.record_id: r for r in got}
    assert len(ids) == len(got)
    for r in got:
        if r.record_type == "revisit":
            assert r.payload is None and ids[r.refers_to].id == r.to and ids[r.refers_to].payload_digest == r.payload_digest
        else:
            assert digest(bytes(r.payload)) == r.payload_digest.split(":")[1]
        assert "\r" not in (r.target_uri or "") and " " not in (r.target_uri or "")


def test_empty_table_and_given_pages(spark, pages, sf, tmp_path):
    warc.write(pages.limit(0), f"file://{tmp_path}/none")
    assert back(spark, f"file://{tmp_path}/none") == []
    given_ = spark.read.parquet(f"{sf}/pages.parquet")
    got = Counter(map(tuple, warc.query(spark, sf).collect()))
    assert got == brute(given_.collect(), 0)
    c = duckdb.connect()
    c.execute(f"create view pages as select * from read_parquet('{sf}/pages.parquet')")
    want = c.execute(warc.SQL)
    names = [d[0] for d in want.description]
    assert Counter(map(tuple, warc.query(spark, sf).select(*names).collect())) == Counter(want.fetchall())


def test_files_open_in_other_readers(spark, pages, tmp_path):
    """Every file is a sequence of whole gzip members, one a record."""
    warc.write(pages, f"file://{tmp_path}/w")
    n = 0
    for name in os.listdir(tmp_path / "w"):
        if name.startswith("part-"):
            data = (tmp_path / "w" / name).read_bytes()
            plain = gzip.decompress(data)
            while data:
                d = zlib.decompressobj(31)
                one = d.decompress(data)
                assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n") and plain.startswith(one)
                plain, data, n = plain[len(one) :], d.unused_data, n + 1
            assert not plain
    assert n == len(PAGES)


def test_a_hot_payload_comes_by_broadcast_and_by_join_alike(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 0)
    none_hot = Counter(map(tuple, _planned(pages)))
    monkeypatch.setattr(warc, "HOT", 10**9)
    assert none_hot == Counter(map(tuple, _planned(pages)))


def _planned(pages):
    from pyspark.sql import functions as F

    rows = pages.selectExpr("page_id as rank", "cast(page_id as string) as id", "url", "sha2(coalesce(html, ''), 256) as digest", "'' as sha1", "cast(octet_length(coalesce(html, '')) as long) as size")
    return warc._plan(rows.withColumn("key", F.to_json(F.struct("digest", "id", "url"))), 1).collect()


# The reader alone.


def archive(rng, n, compress):
    """Records and where each member or plain record lies."""
    parts, at = [], 0
    for i in range(n):
        body = bytes(rng.choices(b"ab<>\r\n\x1f\x8bWARC/1.", k=rng.randrange(0, 400)))
        block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body
        data = warc.record("response", {"WARC-Record-ID": f"<urn:{i}>", "WARC-Date": warc.DATE, "Content-Type": "application/http", "WARC-Payload-Digest": f"sha1:{digest(body)}"}, block)
        data = warc.member(data) if compress else data
        parts.append((at, at + len(data), f"<urn:{i}>", data))
        at += len(data)
    return parts


def salvaged(data, keep=True):
    return list(warc.salvage(warc.Source(io.BytesIO(data), len(data)), keep))


def covers(found, size):
    """Records and gaps lie side by side: each byte belongs to one of them."""
    gaps = [(f["start"], f["end"]) for f in found if "reason" in f]
    assert all(a < b for a, b in gaps) and all(a[1] <= b[0] for a, b in zip(gaps, gaps[1:], strict=False))
    starts = sorted({f["start"] for f in found})
    assert not starts or starts[0] == 0
    assert all(b in starts or b == size for _, b in gaps)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9), st.booleans(), st.lists(st.tuples(st.sampled_from(["flip", "cut", "insert", "zero"]), st.floats(0, 0.999), st.integers(1, 60)), max_size=4))
def test_all_records_without_damage_come_back(seed, compress, harm):
    rng = random.Random(seed)
    parts = archive(rng, 12, compress)
    data = bytearray(b"".join(p[3] for p in parts))
    hit = set()
    for kind, where, n in sorted(harm, key=lambda h: -h[1]):  # from behind, so that offsets before stay
        at = int(where * len(data))
        of = {i for i, p in enumerate(parts) if p[0] < at + (0 if kind == "insert" else n) and at < p[1]}
        hit |= of
        if kind == "flip":
            data[at] ^= 1 << n % 8
        elif kind == "cut":
            del data[at : at + n]
        elif kind == "insert":
            data[at:at] = bytes(rng.choices(range(256), k=n))
        else:
            data[at : at + n] = bytes(min(n, len(data) - at))
    found = salvaged(bytes(data))
    got = [f["record_id"] for f in found if "reason" not in f]
    sound = [p[2] for i, p in enumerate(parts) if i not in hit]
    assert len(got) == len(set(got)) and set(sound) <= set(got)
    covers(found, len(data))
    by_id = {p[2]: p[3] for p in parts}
    for f in found:  # whatever comes back is what was written
        if "reason" not in f and compress:
            assert f["payload"] == gzip.decompress(by_id[f["record_id"]]).split(b"\r\n\r\n", 2)[2][:-4]


@pytest.mark.parametrize("compress", [True, False])
def test_gaps_and_their_reasons(compress):
    parts = archive(random.Random(5), 5, compress)
    blobs = [p[3] for p in parts]
    sound = lambda x: [f["record_id"] for f in salvaged(x) if "reason" not in f]
    gaps = lambda x: [(f["start"], f["end"]) for f in salvaged(x) if "reason" in f]
    junk = b"no record here" * 3
    assert gaps(b"".join(blobs)) == []
    assert salvaged(b"") == []
    assert gaps(junk) == [(0, len(junk))]
    x = blobs[0] + junk + blobs[1]
    assert sound(x) == ["<urn:0>", "<urn:1>"] and gaps(x) == [(len(blobs[0]), len(blobs[0] + junk))]
    x = blobs[0] + blobs[1][:-20]
    assert sound(x) == ["<urn:0>"] and gaps(x) == [(len(blobs[0]), len(x))]
    x = blobs[0] + blobs[1][:-20] + blobs[2]  # a record that runs into the next
    assert sound(x) == ["<urn:0>", "<urn:2>"] and gaps(x) == [(len(blobs[0]), len(x) - len(blobs[2]))]


def test_a_length_that_swallows_later_records():
    parts = archive(random.Random(6), 6, False)
    blobs = [p[3] for p in parts]
    length = int(blobs[1].split(b"Content-Length: ")[1].split(b"\r\n")[0])
    longer = length + len(blobs[2]) + len(blobs[3])  # ends where a record ends
    x = blobs[0] + blobs[1].replace(b"Content-Length: %d" % length, b"Content-Length: %d" % longer) + b"".join(blobs[2:])
    found = salvaged(x)
    assert [f["record_id"] for f in found if "reason" not in f] == ["<urn:0>", *(f"<urn:{i}>" for i in range(2, 6))]


def test_wrong_digest_in_a_sound_member_costs_that_member_alone():
    parts = archive(random.Random(7), 3, True)
    bad = gzip.decompress(parts[1][3]).replace(b"sha1:", b"sha1:A", 1)
    x = parts[0][3] + warc.member(bad) + parts[2][3]
    found = salvaged(x)
    assert [f.get("record_id") for f in found] == ["<urn:0>", None, "<urn:2>"]
    assert "digest" in found[1]["reason"] and found[1]["end"] == len(x) - len(parts[2][3])


def test_members_of_many_records_and_large_ones():
    parts = archive(random.Random(8), 4, False)
    assert [f["record_id"] for f in salvaged(gzip.compress(b"".join(p[3] for p in parts)))] == [p[2] for p in parts]
    rng = random.Random(9)
    big = warc.record("resource", {"WARC-Record-ID": "<urn:big>"}, rng.randbytes(1 << 10) * (17 << 10))
    x = warc.member(big) + parts[0][3]
    assert warc.member(big).endswith(b"\0") and gzip.decompress(warc.member(big)) == big
    assert [(f["record_id"], f["payload_bytes"]) for f in salvaged(x, keep=False)][0] == ("<urn:big>", 17 << 20)
    assert len(salvaged(x)) == 2


def test_a_broken_member_of_many_records_gives_those_before_the_damage():
    parts = archive(random.Random(10), 400, False)
    x = bytearray(gzip.compress(b"".join(p[3] for p in parts)))
    x[len(x) // 2] ^= 255
    found = salvaged(bytes(x))
    got = [f["record_id"] for f in found if "reason" not in f]
    assert 50 < len(got) < 350 and got == [p[2] for p in parts[: len(got)]]
    assert [(f["start"], f["end"]) for f in found if "reason" in f] == [(0, len(x))]


def test_foreign_records():
    head = b"WARC/1.0\r\nwarc-type: Metadata\r\nWARC-Record-ID: <urn:m>\r\nX-Long: a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (one,) = salvaged(head)
    assert one["record_type"] == "metadata" and one["payload"] == b"abc" and dict(one["fields"])["x-long"] == "a b"
    for bad in (head.replace(b": 3", b": x3"), head.replace(b": 3", b": 4"), head.replace(b": 3", b": 99999999999999999"), head.replace(b"1.0", b"2.0"), head.replace(b"WARC-Record-ID: <urn:m>\r\n", b"")):
        assert [f["start"] for f in salvaged(bad)] == [0] and salvaged(bad)[0]["reason"]


def test_salvage_through_spark(spark, sf, tmp_path):
    """Damage in one file leaves the records of the others and most of its own."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    warc.write(pages, f"file://{tmp_path}/w")
    name = max((tmp_path / "w").glob("part-*"), key=lambda p: p.stat().st_size)
    data = bytearray(name.read_bytes())
    data[len(data) // 2] ^= 255
    (tmp_path / "w" / f".{name.name}.crc").unlink(missing_ok=True)
    name.write_bytes(data)
    rows = warc.read(spark, f"file://{tmp_path}/w").collect()
    gaps = [r for r in rows if r.reason]
    assert len(gaps) == 1 and gaps[0].start <= len(data) // 2 < gaps[0].end and gaps[0].path.endswith(name.name)
    assert len(rows) == pages.count()
