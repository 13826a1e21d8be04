"""Secret scans with structural confirmation.

Pattern hits (assignments, access ids, long hex runs) are found first. On top of them, base64 and hex
candidates, URL-safe ones too, are decoded and parsed: private keys in DER must have nested lengths that add up and an inner key
that parses in turn or is encrypted by a named scheme, OpenSSH keys
their length-prefixed fields, PEM blocks a body that decodes to either, and signed tokens a JSON header that
names an algorithm and a JSON payload. Only what parses is reported. Every search moves forward alone: time is linear in the text.

A row is scanned on its own inside its Arrow batch: no shuffle, and memory of one batch slice.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, short_batches, text_slices, tidied

#: Kinds in the order in which spans with one start are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "pem", "openssh", "der", "jwt")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_BODY = re.compile(r"[A-Za-z0-9+/=\s:,-]*")
_B64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
_URL64 = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{40,}={0,2}")
_ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]+)\.(ey[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER element at ``at``; None if its length doesn't fit before ``end``."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    found = []
    while at < end:
        if (x := _tlv(data, at, end)) is None:
            return None
        found.append(x)
        at = x[2]
    return found


# The arcs of object identifiers under which password-based encryption schemes stand (PKCS#5 and PKCS#12).
_ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def is_der_private_key(data: bytes, inner: bool = False) -> bool:
    """PKCS#1, SEC1 and, unless ``inner``, PKCS#8 or encrypted PKCS#8: one outer sequence that fills the data, a small version, then the
    fields of that form."""
    top = _tlv(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data):
        return False
    kids = _children(data, top[1], top[2])
    if not kids or len(kids) < 2:
        return False
    if kids[0][0] == 0x30 and not inner:  # encrypted PKCS#8: the scheme, then the ciphertext
        scheme = _children(data, kids[0][1], kids[0][2])
        named = scheme and scheme[0][0] == 0x06 and data[scheme[0][1] : scheme[0][2]].startswith(_ENCRYPTION)
        return bool(named) and len(kids) == 2 and kids[1][0] == 0x04 and kids[1][2] - kids[1][1] >= 16
    if kids[0][0] != 0x02 or kids[0][2] - kids[0][1] != 1 or data[kids[0][1]] > 1:
        return False
    tags = [k[0] for k in kids]
    if len(kids) >= 9 and all(t == 0x02 for t in tags[:9]):  # PKCS#1
        return kids[1][2] - kids[1][1] >= 32
    if tags[1] == 0x04:  # SEC1
        return kids[1][2] - kids[1][1] >= 16
    if tags[1] == 0x30 and len(kids) >= 3 and tags[2] == 0x04 and not inner:  # PKCS#8
        oid = _children(data, kids[1][1], kids[1][2])
        return bool(oid) and oid[0][0] == 0x06 and _is_inner_key(data[kids[2][1] : kids[2][2]])
    return False


def _is_inner_key(data: bytes) -> bool:
    """What PKCS#8 wraps: a key of the other two forms, or one octet string or number that fills it."""
    top = _tlv(data, 0, len(data))
    if not top or top[2] != len(data):
        return False
    return top[0] in (0x04, 0x02) and top[2] - top[1] >= 16 or top[0] == 0x30 and is_der_private_key(data, inner=True)


def is_openssh_private_key(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at + 4 <= len(data)


def _b64(text: str, altchars: bytes | None = None) -> bytes | None:
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=altchars, validate=True)
    except (binascii.Error, ValueError):
        return None


def _json(part: str) -> dict | None:
    raw = _b64(part, b"-_")
    try:
        got = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def _pem_blocks(text: str):
    """(start, end, body) of the blocks: from a heading to its own ending, without another heading between."""
    m = _BEGIN.search(text)
    while m:
        after = _BEGIN.search(text, m.end())
        stop = after.start() if after else len(text)
        ending = f"-----END {m[1]}-----"
        end = text.find(ending, m.end(), stop)
        if end >= 0 and _BODY.match(text, m.end(), end).end() == end:
            yield m.start(), end + len(ending), text[m.end() : end]
        m = after


def confirmed(text: str) -> list[tuple[str, int, int]]:
    found = []
    if "-----BEGIN" in text:
        for start, end, body in _pem_blocks(text):
            body = "".join(x for x in body.splitlines() if ":" not in x)
            raw = _b64(re.sub(r"\s", "", body).rstrip("="))
            if raw and (is_der_private_key(raw) or is_openssh_private_key(raw)):
                found.append(("pem", start, end))
    for pattern, altchars in ((_B64, None), (_URL64, b"-_")):
        for m in pattern.finditer(text):
            if altchars and "-" not in m[0] and "_" not in m[0]:
                continue  # the plain alphabet's
            raw = _b64(m[0].rstrip("="), altchars)
            if raw and is_openssh_private_key(raw):
                found.append(("openssh", m.start(), m.end()))
            elif raw and is_der_private_key(raw):
                found.append(("der", m.start(), m.end()))
    for m in _ANY_HEX.finditer(text):
        if is_der_private_key(bytes.fromhex(m[0])):
            found.append(("der", m.start(), m.end()))
    if "ey" in text and "." in text:
        for m in _JWT.finditer(text):
            head = _json(m[1])
            if head and isinstance(head.get("alg"), str) and _json(m[2]) is not None and (m[3] or head["alg"].lower() == "none"):
                found.append(("jwt", m.start(), m.end()))
    return found


def spans(text: str) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of a text by start, then kind; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    found += confirmed(text)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches):
    for whole in batches:
        for b in text_slices(whole, "_text"):
            got = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t or "")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, _SPANS)], names=["_id", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>), one row per input row in any order.

    A null or empty text has no spans. Null and repeated ids pass through; other columns are ignored, whatever
    their names. An empty input gives no rows.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(tidied(_scan), f"_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("_id", id_col)


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scan(documents(spark, sf_dir)).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
