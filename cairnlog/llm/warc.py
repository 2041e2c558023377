"""WARC archives written and read index first.

write_archives() stores records in one archive file per partition and yields an index row for each
(file, offset, length, URL, digest). read_archives() takes selected index rows, sorts them by place,
merges neighbouring byte ranges and reads each merged range once."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, read_table, saved

INDEX = "page_id long, url string, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 64 << 20  # of archives that one task reads


#: Names that Hadoop's file systems go by, and those of the same stores in Arrow.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "viewfs": None}


def _arrow_uri(uri: str) -> str:
    """The folder's address as Arrow names it. Folders that only Hadoop can open are refused by name."""
    scheme, sep, rest = uri.partition("://")
    named = SCHEMES.get(scheme, scheme) if sep else scheme
    if named is None:
        raise ValueError(f"archives cannot be written to {scheme}://: name the store itself in spark.checkpoint.dir")
    return named + sep + rest


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(_arrow_uri(uri))


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, url: str | None) -> str:
    """A record's id: rows that repeat a page_id with another payload or URL have ids of their own."""
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}:{zlib.crc32((url or '').encode()):08x}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None, date: str = "1970-01-01T00:00:00Z", members: bool = False) -> bytes:
    """One WARC/1.1 record, whose block is an HTTP response. A revisit has only the response's head;
    its headers name the record with the same payload. Line breaks in the URL would end the header,
    so they are escaped. With members=True the record is a gzip member of its own."""
    revisit = refers_to is not None
    clean = lambda u: (u or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if u and ("\r" in u or "\n" in u) else u or ""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest, url)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest, refers_url)}", f"WARC-Refers-To-Target-URI: {clean(refers_url)}", f"WARC-Refers-To-Date: {date}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, mtime=0) if members else raw


def _headers(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode().split("\r\n")
    return first, dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)


def parse_record(raw: bytes) -> dict:
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, fields = _headers(head)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    ident = lambda x: int(x.split(":")[2]) if x and x.split(":")[2] else None
    return {
        "page_id": ident(fields["WARC-Record-ID"]),
        "payload_bytes": int(_headers(http)[1]["Content-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"],
        "refers_to": ident(fields.get("WARC-Refers-To")),
        "payload": payload,
    }


def with_digests(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload (UTF-8 bytes; null html is empty), hex SHA-1 and size, in the JVM."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn(
        "sha", F.sha1("payload")
    )


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha, refers_to, refers_url): the pages and payloads that equal the payload of a
    larger page_id, which is the response (of several rows with that page_id and payload, all are).
    Payloads under min_bytes never take part. Copies are found in a partial aggregate by digest; a
    digest that most pages share meets its response in a join that AQE can split."""
    ids = saved(pages.where(F.octet_length("payload") >= min_bytes).select("page_id", "url", F.unhex("sha").alias("raw_sha")), "warc-ids")
    last = F.max(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url")))
    top = saved(ids.groupBy("raw_sha").agg(last.alias("top"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-top")
    found = ids.join(top, "raw_sha").where(F.col("page_id") < F.col("top.page_id"))
    return found.select("page_id", F.lower(F.hex("raw_sha")).alias("sha"), F.col("top.page_id").alias("refers_to"), F.col("top.url").alias("refers_url")).distinct()


def write_archives(records: DataFrame, folder: str, target_bytes: int = 256 << 20, date: str | None = None, members: bool = False) -> DataFrame:
    """Write one record per row (page_id, url, payload, refers_to, refers_url) and return the index,
    itself written as a table. Each task attempt writes files under names of its own and only the
    attempts that Spark accepts leave index rows, so repeated or lost attempts do no harm. `date` is
    the records' WARC-Date, by default the time of this call; members=True writes gzip members."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    ending = "warc.gz" if members else "warc"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _filesystem(folder)
        store.create_dir(base, recursive=True)
        part, out, name, at = TaskContext.get().partitionId(), None, "", 0
        for pdf in batches:
            rows = []
            for page_id, url, payload, refers_to, refers_url in zip(pdf.page_id, pdf.url, pdf.payload, pdf.refers_to, pdf.refers_url, strict=True):
                if out is None or at >= target_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"part-{part:05d}-{uuid.uuid4().hex}.{ending}", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                page = None if pd.isna(page_id) else int(page_id)
                to = None if pd.isna(refers_to) else int(refers_to)
                payload = bytes(payload)
                digest = _digest(payload)
                raw = record_bytes(page, url, payload, digest, to, refers_url, date, members)
                out.write(raw)
                rows.append((page, url, digest, "response" if to is None else "revisit", to, name, at, len(raw)))
                at += len(raw)
            frame = pd.DataFrame(rows, columns=[x.split()[0] for x in INDEX.split(", ")])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})
        if out is not None:
            out.close()

    return saved(records.select("page_id", "url", "payload", "refers_to", "refers_url").mapInPandas(write, INDEX), "warc-index")


def coalesced(rows: list[tuple[int, int]], gap: int, most: int) -> Iterator[tuple[int, int, list[int]]]:
    """Merge sorted (offset, length) ranges that lie within `gap` bytes, up to `most` bytes each;
    yields start, end and the positions of the merged ranges."""
    start = end = None
    members: list[int] = []
    for k, (offset, length) in enumerate(rows):
        if start is not None and (offset > end + gap or max(end, offset + length) - start > most):
            yield start, end, members
            start, members = None, []
        if start is None:
            start, end = offset, offset + length
        end = max(end, offset + length)
        members.append(k)
    if start is not None:
        yield start, end, members


def read_archives(index: DataFrame, folder: str, gap: int = 64 << 10, most: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """Read the records that the index rows select. Rows are dealt out by ranges of (file, offset),
    as many as the records' own bytes ask for (an index row says little of the record's size);
    within a task sorted places are merged into few reads. Every record's own bytes are checked
    against its digest header. With payloads=False the payload column is null."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _filesystem(folder)
        for pdf in batches:
            for name, part in pdf.groupby("file", sort=False):
                part = part.sort_values("offset")
                places = list(zip(part.offset.tolist(), part.length.tolist(), strict=True))
                with store.open_input_file(f"{base}/{name}") as f:  # random access: never decompressed as a whole
                    for start, end, members in coalesced(places, gap, most):
                        raw, rows = f.read_at(end - start, start), []
                        for k in members:
                            offset, length = places[k]
                            record = parse_record(raw[offset - start : offset - start + length])
                            if record["record_type"] == "response" and _digest(record["payload"]) != record["payload_digest"]:
                                raise ValueError(f"{name}: the record at {offset} does not match its digest")
                            if not payloads:
                                record["payload"] = None
                            rows.append(record)
                        yield pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})

    placed = index.select("file", "offset", "length")
    ranges = -(-(placed.agg(F.sum("length").alias("n")).first().n or 0) // READ_BYTES)
    return placed.repartitionByRange(max(ranges, 1), "file", "offset").sortWithinPartitions("file", "offset").mapInPandas(read, RECORDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages -> page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; null URLs are written empty; of equal payloads (0 bytes and up)
    the largest page_id is the response. A row with a null page_id is written and read like any
    other and is never a revisit. Repeated page_ids each keep their record: which of them revisit is
    decided by page_id and payload together. Payloads of any length are one record. An empty table
    writes no archive and gives no rows."""
    pages = with_digests(read_table(spark, sf_dir, "pages"))
    links = saved(revisits(pages), "warc-revisits")
    folder = new_path(spark, "warc-archives")
    index = write_archives(pages.join(links, ["page_id", "sha"], "left"), folder)
    return read_archives(index, folder, payloads=False).drop("payload")


QUERIES = {"op6_warc": op6_warc}

#: The same rows from the pages themselves; base32 of the digest, five bits at a time.
_BITS = "concat(" + ", ".join(
    f"lpad(bin(('0x' || sha1[{10 * k + 1}:{10 * k + 10}])::BIGINT), 40, '0')" for k in range(4)
) + ")"
_BASE32 = "concat(" + ", ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ('0b' || bits[{5 * k + 1}:{5 * k + 5}])::INTEGER + 1, 1)" for k in range(32)
) + ")"
ORACLE_SQL = {
    "op6_warc": f"""
with a as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha1 from pages),
b as (select *, {_BITS} as bits, max(page_id) over (partition by sha1) as top from a)
select page_id, cast(strlen(html) as bigint) as payload_bytes, {_BASE32} as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id = top then null else top end as refers_to
from b"""
}
