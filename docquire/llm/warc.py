"""Web archives: a writer with revisit records and a reader that salvages damaged files.

Each record is written as a gzip member of its own. The reader takes members of one or more records and plain records, in any order. It checks a
member (its CRC), the version line, the headers, the block length and, where they are given, the payload's digest and length. After a
failed check it searches for the next member or version line that
holds a valid record, goes on there, and logs the bytes between as a quarantined gap. Records of all types come through; those without HTTP are their own payload.

Archives are rows of a Parquet table (``archive``, ``blob``), which Spark commits atomically in any
store; ``blob`` is the file, byte for byte.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small, table

ARCHIVE_BYTES = 8 << 20
LEVEL = 4
GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'page:{page_id}')}>"


def _line(value: str | None) -> str:
    """A value that fits a header line."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value or "").strip()


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisits: int | None = None, is_revisit: bool = False) -> bytes:
    """One record, not yet compressed. A revisit keeps the HTTP headers and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    heads = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        heads.append(f"X-Page-ID: {page_id}")
    if is_revisit:
        heads += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(revisits)}"]
        if revisits is not None:
            heads.append(f"X-Refers-To-Page-ID: {revisits}")
    return "\r\n".join(heads).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = LEVEL) -> bytes:
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(record) + press.flush()


class Damaged(ValueError):
    pass


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in filter(None, raw.decode("utf-8", "replace").split("\r\n")):
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("a header line without a colon")
        out[name.strip().lower()] = value.strip()
    return out


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` and the offset after it; ``Damaged`` if a check fails."""
    if not (m := VERSION.match(data, at)):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        raise Damaged("headers without an end")
    heads = _headers(data[m.end() : end])
    if not heads.get("content-length", "").isdigit():
        raise Damaged("no block length")
    start, size = end + 4, int(heads["content-length"])
    if data[start + size : start + size + 4] != b"\r\n\r\n":
        raise Damaged("the block doesn't end where it should")
    payload, kind, digest, said = data[start : start + size], heads.get("warc-type"), heads.get("warc-payload-digest"), None
    if not kind:
        raise Damaged("no record type")
    if heads.get("content-type", "").startswith("application/http"):
        http, gap, payload = payload.partition(b"\r\n\r\n")
        if not gap:
            raise Damaged("HTTP headers without an end")
        said = _headers(http.partition(b"\r\n")[2]).get("content-length")
    whole = kind != "revisit" and "warc-truncated" not in heads
    if whole and said is not None and said != str(len(payload)):
        raise Damaged("the payload has another length")
    if whole and digest is not None and digest[:5] == "sha1:" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest[5:]:
        raise Damaged("the payload differs from its digest")
    number = lambda name: int(heads[name]) if name in heads else None
    out = {"page_id": number("x-page-id"), "url": heads.get("warc-target-uri"), "record_type": kind, "payload_bytes": len(payload) if whole or not (said or "").isdigit() else int(said)}
    out |= {"payload_digest": digest and digest.removeprefix("sha1:"), "refers_to": number("x-refers-to-page-id"), "payload": payload if kind != "revisit" else None}
    return out, start + size + 4


def _member(blob: bytes, at: int) -> tuple[list[dict], str, int]:
    """The records in the gzip member at ``at``, why some of it is lost if it is, and the offset after the member."""
    opened = zlib.decompressobj(31)
    try:
        data = opened.decompress(memoryview(blob)[at:])
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from None
    if not opened.eof:
        raise Damaged("gzip: the member has no end")
    found = list(salvage(data, members=False))
    lost = [x["reason"] for kind, x in found if kind == "gap"]
    return [x for kind, x in found if kind == "record"], lost[0] if lost else "", len(blob) - len(opened.unused_data)


def salvage(blob: bytes, members: bool = True) -> Iterator[tuple[str, dict]]:
    """("record", fields) and ("gap", start / end / reason) in the order of the file. A member that is sound but holds damaged records is a gap after its others."""
    at, lost, why, plain = 0, None, "", -1
    while at < len(blob):
        zipped = members and blob[at : at + 3] == GZIP
        try:
            if zipped:
                records, inside, end = _member(blob, at)
                if not records:
                    raise Damaged(inside or "an empty member")
            else:
                (record, end), inside = parse_record(blob, at), ""
                records = [record]
        except (Damaged, ValueError) as e:
            if lost is None:
                lost, why = at, str(e)
            # the next of both: a member, or a version line
            if plain <= at:
                plain = m.start() if (m := VERSION.search(blob, at + 1)) else len(blob)
            member = blob.find(GZIP, at + 1, plain) if members else -1
            at = member if member >= 0 else plain
            continue
        if lost is not None:
            yield "gap", {"start": lost, "end": at, "reason": why}
            lost = None
        for record in records:
            yield "record", record
        if inside:
            yield "gap", {"start": at, "end": end, "reason": inside}
        at = end
    if lost is not None:
        yield "gap", {"start": lost, "end": len(blob), "reason": why}


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages; the settled table of archives (``archive``, ``blob``)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    # only digests seen twice need a look-up; one group per digest is summed up before the shuffle
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"))
    again = rows.filter(F.length("payload") >= min_revisit_bytes).groupBy("sha1").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    again = settle(again.filter(F.col("n") > 1).select("sha1", "first"), "copies")
    rows = rows.join(small(again), "sha1", "left")
    rows = rows.withColumn("revisit", F.coalesce(F.col("first.none") != F.col("page_id").isNull(), F.lit(False)) | F.coalesce(F.col("first.id") != F.col("page_id"), F.lit(False)))
    rows = rows.select("page_id", "url", "sha1", "revisit", F.col("first.id").alias("refers_to"), "payload")

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, k = TaskContext.get().partitionId(), [], 0, 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{part:06d}-{k:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], names=["archive", "blob"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.columns[5], strict=True):
                page, url, sha1, revisit, first, payload = row
                held.append(member(write_record(page, url, payload.as_py(), base32(sha1), first if revisit else None, revisit)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    held, size, k = [], 0, k + 1
        if held:
            yield archive()

    return settle(rows.mapInArrow(archived, "archive string, blob binary"), "warc")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Records and gaps of archives.

    Records have ``gap`` false and ``archive, page_id, url, payload_bytes, payload_digest, record_type, refers_to``
    (and ``html`` if ``payloads``); gaps have ``gap`` true and ``archive, start, end, reason``.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    fields += [("payload", pa.binary())] * payloads
    more = [("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string())]
    schema = pa.schema([("archive", pa.string()), ("gap", pa.bool_()), *fields, *more])
    ddl = ", ".join(f"`{f.name}` " + {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean"}[f.type] for f in schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column("archive").to_pylist(), batch.column("blob"), strict=True):
                held: list[dict] = []
                for kind, x in salvage(blob.as_py()):
                    held.append({"archive": name, "gap": kind == "gap"} | ({k: v for k, v in x.items() if payloads or k != "payload"}))
                    if len(held) >= 500:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return archives.select("archive", "blob").mapInArrow(read, ddl)


def archived_pages(pages: DataFrame, **how) -> DataFrame:
    """Write ``pages`` as archives and read them back.

    One row per page: ``page_id, payload_bytes, payload_digest, record_type, refers_to``. A null html is the empty
    payload, which is a payload like any other; a null id ranks last and is never referred to by id. Rows that
    repeat the smallest id of a payload are responses as well. A page is processed whole, in some four times its bytes of memory. Only the named columns are read. An empty table gives no rows.
    """
    rows = settle(read_archives(write_archives(pages, **how)).filter(~F.col("gap")), "pages")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
