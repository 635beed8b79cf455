"""Web archives: ARC files of both versions, and their conversion to WARC.

ARC is read as its version says: the first record (``filedesc://``) names the
version and the fields of the header lines, and each record's body has the
declared length, so payloads may hold anything. The converter gives every
record what WARC asks for and ARC lacks: an identifier made from the record's
key, an ISO date, a type, and block and payload digests. Of records with equal
payloads of at least LEAST_REVISIT bytes, the one with the largest key stays a
response and the others become revisits that refer to it.

Archives are files in the shared folder, gzipped. They are written by Spark's
text writer (one row is a slab of whole records, the line separator is the
records' own last line end), so a lost task leaves nothing behind.
SLABS slabs make one file, which bounds what a reader holds.

Rows: null html is an empty payload; null url is ``about:blank``; a record
without page_id is read back without one, and never referred to; of equal
records with the same page_id each is a response; other columns are ignored. A
payload of any length is one record of one slab.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, balanced, steps, table

LEAST_REVISIT = 1000
SLAB_BYTES, SLABS = 1 << 20, 16
#: Repeated payloads up to this number (28 bytes each) are broadcast; more are joined by shuffle.
MOST_BROADCAST = 200_000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

# The fields of ARC header lines by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}

_SAFE = "".join(chr(c) for c in range(0x21, 0x7F))


def _field(text: str | None, missing: str) -> str:
    """A value without blanks or control characters."""
    return urllib.parse.quote(text, safe=_SAFE) if text else missing


# ---------------------------------------------------------------- ARC


def arc_opening(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 waymill\n{ARC_FIELDS[version]}\n".encode()
    about = ["filedesc://" + name, "0.0.0.0", date, "text/plain", *(["200", "-", "-", "0", name] if version == 2 else []), str(len(body))]
    return " ".join(about).encode() + b"\n" + body + b"\n"


def arc_record(version: int, name: str, url: str | None, ip: str, date: str, mime: str, block: bytes) -> bytes:
    more = ["200", hashlib.md5(block, usedforsecurity=False).hexdigest(), "-", "0", name] if version == 2 else []
    return " ".join([_field(url, "about:blank"), ip, date, mime, *more, str(len(block))]).encode() + b"\n" + block + b"\n"


def http_block(key: int | None, payload: bytes) -> bytes:
    own = "" if key is None else f"X-Archive-Key: {key}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file: its header line's fields by name, and block."""
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").split(" ")
        size = int(line[-1])
        block = data[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError("ARC record ends before its declared length")
        at = end + 1 + size
        if names is None:
            if not line[0].startswith("filedesc://"):
                raise ValueError("ARC file without version block")
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            names = ARC_FIELDS[version].split(" ")
            continue
        if len(line) != len(names):
            raise ValueError("ARC header line does not fit its version")
        yield dict(zip(names, line)) | {"block": block}


def split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Lower-cased HTTP headers, the head with its blank line, and the payload."""
    head, sep, payload = block.partition(b"\r\n\r\n")
    pairs = (x.split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x)
    return {k.decode("latin-1").strip().lower(): v.decode("latin-1").strip() for k, v in pairs}, head + sep, payload


# ---------------------------------------------------------------- WARC


def record_id(key: int | None, url: str, digest: bytes) -> str:
    """A version 8 UUID whose low bits are the key; without a key, of url and digest."""
    seed = hashlib.sha1(b"waymill" if key is not None else url.encode() + digest, usedforsecurity=False).digest()
    low = int.from_bytes(seed[6:14], "big") if key is None else key & ((1 << 64) - 1)
    value = int.from_bytes(seed[:6], "big") << 80 | 8 << 76 | (low >> 62) << 64 | 2 << 62 | low & ((1 << 62) - 1)
    if key is None:
        value |= 1 << 75  # marks an identifier that holds no key
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def key_of(identifier: str) -> int | None:
    value = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 75 & 1:
        return None
    low = (value >> 64 & 3) << 62 | value & ((1 << 62) - 1)
    return low - (1 << 64) if low >> 63 else low


def _sha1(data: bytes) -> bytes:
    return hashlib.sha1(data, usedforsecurity=False).digest()


def _label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def iso(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def converted(arc: dict, target: int | None) -> bytes:
    """The WARC record of an ARC record: a revisit of ``target``, else a response."""
    http, head, payload = split_http(arc["block"])
    key = int(http["x-archive-key"]) if "x-archive-key" in http else None
    digest = _sha1(payload)
    revisit = target is not None and key != target
    block = head if revisit else arc["block"]
    headers = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(key, arc["URL"], digest), "WARC-Date": iso(arc["Archive-date"]), "WARC-Target-URI": arc["URL"], "WARC-IP-Address": arc["IP-address"]}
    headers |= {"WARC-Payload-Digest": _label(digest), "WARC-Block-Digest": _label(_sha1(block)), "Content-Type": "application/http; msgtype=response"}
    if revisit:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(target, "", b"")}
    return warc_record(headers, block)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError("WARC record ends before its declared length")
        at = end + 4 + size + 4
        yield headers, block


# ---------------------------------------------------------------- files


def _write(records: DataFrame, path: str, separator: str) -> None:
    """Writes a column ``slab`` of binary slabs as gzipped files."""
    records.select(F.col("slab").cast("string").alias("slab")).write.option("lineSep", separator).option("compression", "gzip").option("maxRecordsPerFile", SLABS).text(path)


def _slabs(records: Iterator[bytes], opening) -> Iterator[bytes]:
    """Packs records into slabs; each SLABS-th begins with ``opening(number)``.
    A slab's last line end is left to the writer."""
    n, held, size = 0, [], 0
    for r in records:
        if not held:
            held = [opening(n // SLABS)] if n % SLABS == 0 else []
            size = 0
        held.append(r)
        size += len(r)
        if size >= SLAB_BYTES:
            yield b"".join(held)
            n, held = n + 1, []
    if held:
        yield b"".join(held)


def _unzipped(content: bytes) -> bytes:
    out = []
    while content:
        d = zlib.decompressobj(31)
        out.append(d.decompress(content))
        content = d.unused_data
    return b"".join(out)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").schema("path string, modificationTime timestamp, length long, content binary").load(path).select("content")


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000", versions: tuple[int, ...] = (1, 2)) -> None:
    """Archives (page_id, url, html) rows; files take the versions in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [versions[0], ""]

        def opening(k: int) -> bytes:
            state[:] = [versions[k % len(versions)], f"{uuid.uuid4().hex}.arc"]
            return arc_opening(state[0], state[1], date)

        def records() -> Iterator[tuple]:
            for b in steps(batches, "html"):
                yield from zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist())

        # the version of a record is its file's, so it is made once its slab is known
        n, held, size = 0, [], 0
        for key, url, html in records():
            if not held and n % SLABS == 0:
                held = [opening(n // SLABS)]
            held.append(arc_record(state[0], state[1], url, "0.0.0.0", date, "text/html", http_block(key, (html or "").encode())))
            size += len(held[-1])
            if size >= SLAB_BYTES:
                yield _one(held, 1)
                n, held, size = n + 1, [], 0
        if held:
            yield _one(held, 1)

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    _write(balanced(slim).mapInArrow(run, "slab binary"), path, "\n")


def _one(held: list[bytes], cut: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-cut]], pa.binary())], names=["slab"])


def read_arc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """(key, size, digest[, head fields and block]) of every ARC record under ``path``;
    size and SHA-1 digest are the payload's."""
    schema = "key long, size long, digest binary" + (", url string, ip string, date string, block binary" if blocks else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for r in parse_arc(_unzipped(content.as_py())):
                    http, _, payload = split_http(r["block"])
                    key = int(http["x-archive-key"]) if "x-archive-key" in http else None
                    rows.append((key, len(payload), _sha1(payload), *((r["URL"], r["IP-address"], r["Archive-date"], r["block"]) if blocks else ())))
                    size += len(r["block"]) if blocks else 60
                    if size >= 4 * SLAB_BYTES:
                        yield _rows(rows, blocks)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows, blocks)

    return _files(spark, path).mapInArrow(run, schema)


def _rows(rows: list[tuple], blocks: bool) -> pa.RecordBatch:
    kinds = [("key", pa.int64()), ("size", pa.int64()), ("digest", pa.binary())]
    kinds += [("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("block", pa.binary())] if blocks else []
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


def arc_to_warc(spark: SparkSession, arc: str, warc: str) -> None:
    """Converts all ARC files under ``arc`` to WARC files under ``warc``."""
    slim = read_arc(spark, arc, blocks=False).where(F.col("size") >= LEAST_REVISIT)
    again = slim.groupBy("digest").agg(F.max("key").alias("target"), F.count("*").alias("n")).where("n > 1 and target is not null").select("digest", "target")
    scratch = Scratch(spark)
    again = scratch.keep(again, "repeated")
    few = again.count() <= MOST_BROADCAST
    records = read_arc(spark, arc)
    # small payloads have no target; keys of their own (8 bytes, no digest) keep them off one join key
    records = records.withColumn("digest", F.when(F.col("size") >= LEAST_REVISIT, F.col("digest")).otherwise(F.unhex(F.lpad(F.hex(F.xxhash64("key", "url")), 16, "0"))))
    joined = records.join(F.broadcast(again) if few else again, ["digest"], "left").select("url", "ip", "date", "block", "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": iso("20240101"), "Content-Type": "application/warc-fields"}, b"software: waymill\r\nformat: WARC File Format 1.0\r\n")

        def records() -> Iterator[bytes]:
            for b in steps(batches, "block"):
                for url, ip, date, block, target in zip(*(b.column(c).to_pylist() for c in ("url", "ip", "date", "block", "target"))):
                    yield converted({"URL": url, "IP-address": ip, "Archive-date": date, "block": block}, target)

        for slab in _slabs(records(), lambda _: info):
            yield _one([slab], 2)

    _write(joined.mapInArrow(run, "slab binary"), warc, "\r\n")
    scratch.drop(again)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the
    response and revisit records under ``path``. A response's digests are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for headers, block in parse_warc(_unzipped(content.as_py())):
                    if headers["warc-type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = split_http(block)
                    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:"))
                    if _label(_sha1(block)) != headers["warc-block-digest"] or headers["warc-type"] == "response" and _sha1(payload) != digest:
                        raise ValueError("a record does not match its digest")
                    to = headers.get("warc-refers-to")
                    rows.append((key_of(headers["warc-record-id"]), int(http["content-length"]), digest.hex(), headers["warc-type"], key_of(to) if to else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _files(spark, path).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    arc, warc = scratch.path("arc"), scratch.path("warc")
    write_arc(table(spark, sf_dir, "pages"), arc)
    arc_to_warc(spark, arc, warc)
    return read_warc(spark, warc)


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS target FROM p WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY 1 HAVING count(*) > 1)
SELECT p.page_id, payload_bytes, p.payload_digest, CASE WHEN g.target IS DISTINCT FROM p.page_id AND g.target IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.target IS DISTINCT FROM p.page_id THEN g.target END AS refers_to
FROM p LEFT JOIN g ON g.payload_digest = p.payload_digest AND payload_bytes >= {LEAST_REVISIT}
"""
