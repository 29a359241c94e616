"""WARC writing and a salvage reader.

Writing: one gzip member per record, through Spark's text sink into the shared
folder, so a lost executor's files are written again by the commit protocol.
The sink ends each row with one zero byte, which gzip readers skip as padding.
Of equal payloads of at least ``MIN_REVISIT`` bytes the largest page_id is the
response, the others revisit it.

Reading: ``salvage`` walks an archive (gzip members or plain records).  After a
failed check it searches for the next valid member or version line, recovers
the later records, and reports the skipped bytes as a gap.

Null or empty html: a response with an empty payload.  Null url or page_id: an
empty header, read back as null.  A repeated page_id: each row has its record.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.common import salt
from trawl.session import scratch_path

MIN_REVISIT = 1000
RECORDS_PER_FILE = 1000
SALTS = 32
VERSION = b"WARC/1.1\r\n"
MEMBER = b"\x1f\x8b\x08"


def typed(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, size, refers_to)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                     F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    large = (p.where((F.col("size") >= MIN_REVISIT) & F.col("page_id").isNotNull()).groupBy("digest")
             .agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
             .select("digest", "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    out = p.withColumn("salt", salt("page_id", SALTS)).join(large, ["digest", "salt"], "left")
    return out.withColumn("refers_to", F.when((F.col("top") != F.col("page_id")) & (F.col("size") >= MIN_REVISIT),
                                              F.col("top"))).drop("salt", "top")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    clean = re.sub(r"[\r\n]+", " ", url or "")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}",
            f"WARC-Payload-Length: {len(payload)}", f"Content-Length: {len(body)}"]
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, path: str) -> None:
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = batch.slice(k, 64).to_pylist()
                yield pa.RecordBatch.from_pydict({"value": [member(record(
                    r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"])) for r in rows]},
                    schema=pa.schema([("value", pa.binary())]))

    out = typed(pages).select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "value binary")
    (out.select(F.col("value").cast("string")).write.mode("overwrite").option("lineSep", "\x00")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def _parse(data: bytes, at: int) -> tuple[dict, bytes, int] | None:
    """The record at ``at`` (headers, body, end), or None if a check fails."""
    if not data.startswith(b"WARC/1.", at):
        return None
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return None
    head = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = head.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        return None
    body = data[stop + 4:stop + 4 + int(size)]
    end = stop + 4 + int(size)
    if len(body) < int(size) or data[end:end + 4] != b"\r\n\r\n":
        return None
    if head.get("warc-type") == "response" and \
            head.get("warc-payload-digest") != "sha1:" + hashlib.sha1(body).hexdigest():
        return None
    return head, body, end + 4


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", start, end, headers, body) and ("gap", start, end, None, None)
    in order; together they cover the archive but for zero padding."""
    at, bad = 0, None
    while at < len(data):
        if data[at] == 0 and bad is None:
            at += 1
            continue
        got = end = None
        if data.startswith(MEMBER, at):
            z = zlib.decompressobj(31)
            try:
                plain = z.decompress(data[at:] if len(data) - at < 1 << 20 else memoryview(data)[at:])
                if z.eof:
                    end = len(data) - len(z.unused_data)
                    got, pos = [], 0
                    while pos < len(plain):
                        one = _parse(plain, pos)
                        if one is None:
                            got = None
                            break
                        got.append(one)
                        pos = one[2]
            except zlib.error:
                pass
        elif data.startswith(b"WARC/1.", at):
            one = _parse(data, at)
            if one:
                got, end = [one], one[2]
        if got:
            if bad is not None:
                yield "gap", bad, at, None, None
                bad = None
            for head, body, _ in got:
                yield "record", at, end, head, body
            at = end
            continue
        bad = at if bad is None else bad
        nexts = [i for i in (data.find(MEMBER, at + 1), data.find(b"WARC/1.", at + 1)) if i >= 0]
        at = min(nexts, default=len(data))
    if bad is not None:
        yield "gap", bad, len(data), None, None


def read(spark: SparkSession, path: str, glob: str = "part-*") -> DataFrame:
    """(kind, file, start, end, page_id, url, record_type, payload_digest,
    payload_bytes, refers_to, payload): records and quarantined gaps."""
    arrow = pa.schema([("kind", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                       ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                       ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                       ("refers_to", pa.int64()), ("payload", pa.binary())])

    def number(text):
        found = re.search(r"-?\d+", text or "")
        return int(found.group()) if found else None

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r, rows, held = batch.slice(i, 1).to_pylist()[0], [], 0
                for kind, start, end, h, body in salvage(r["content"]):
                    h = h or {}
                    rows.append((kind, r["path"], start, end, number(h.get("warc-record-id")),
                                 h.get("warc-target-uri") or None, h.get("warc-type"),
                                 (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                                 number(h.get("warc-payload-length") or h.get("content-length")),
                                 number(h.get("warc-refers-to")), body))
                    held += len(body or b"")
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, x)) for x in rows], schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, x)) for x in rows], schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInArrow(run, "kind string, file string, start long, end long, page_id long, url string, "
                                 "record_type string, payload_digest string, payload_bytes long, refers_to long, "
                                 "payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page, read the archives back: one row per page."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path).where("kind = 'record'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
