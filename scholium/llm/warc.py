"""WARC archives as a chunked record table.

Writing: each page becomes a response record, in a gzip member of its own; a payload over ``SEGMENT`` bytes becomes several,
a first one and continuations. Pages with the same payload as a page of larger id are written as revisits. Reading: archives
stream through as rows of record id and chunk number, each with the running SHA-1 and length; nothing larger than a chunk is
held. A record's last chunk carries the digest of the whole payload.

Null html: empty payload. Null url: no target URI. A null id is written and read back as null. Repeated rows with the largest
id of equal payloads are responses all; other repeats are revisits. Control characters in URLs are percent-encoded. Empty
tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import new_path, written
from .common import partitions, utf8
from .files import Rolled, reading_stream, slices

#: Payloads below this are never revisits; bytes of a chunk, of a segment and (about) of an archive.
REVISIT_FROM, CHUNK, SEGMENT, ARCHIVE = 1000, 1 << 16, 1 << 20, 1 << 28
ENDS = re.compile(r"[\x00-\x20\x7f]")


def _record(kind: str, page: object, headers: list[tuple[str, object]], block: list[bytes]) -> Iterator[bytes]:
    """A gzip member with one record."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {sum(map(len, block))}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    yield z.compress(("\r\n".join(lines) + "\r\n\r\n").encode())
    for part in block:
        yield z.compress(part)
    yield z.compress(b"\r\n\r\n") + z.flush()


def records(page: int | None, url: object, payload: bytes, revisits: int | None) -> Iterator[bytes]:
    name = "null" if page is None else str(page)
    digest = hashlib.sha1(payload).digest()
    head = [("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if isinstance(url, str) and url:
        head.append(("WARC-Target-URI", ENDS.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()))
    if revisits is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield from _record("revisit", page, [*head, ("WARC-Profile", profile), ("WARC-Refers-To", f"<urn:page:{revisits}>"), ("WARC-Payload-Length", len(payload))], [])
        return
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head.append(("Content-Type", "application/http; msgtype=response"))
    parts = list(slices(payload, SEGMENT))
    for k, part in enumerate(parts):
        more = [] if len(parts) == 1 else [("WARC-Segment-Number", k + 1)]
        if k:
            more = [("WARC-Record-ID", f"<urn:page:{name}:segment:{k + 1}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", f"<urn:page:{name}>"), *more]
            if k == len(parts) - 1:
                more.append(("WARC-Segment-Total-Length", len(http) + len(payload)))
            yield from _record("continuation", page, more, [part])
        else:
            yield from _record("response", page, [*head, *more], [http, part])


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives; rows ``(path, n_records)``, one for each archive, are returned once, as a table."""
    payload = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = payload.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    many = keyed.where(F.col("size") >= REVISIT_FROM).groupBy("sha", "size").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("copies"))
    many = written(many.where("copies > 1").drop("copies"), "payloads")
    marked = keyed.join(many, ["sha", "size"], "left").select("page_id", "url", "html", F.when(F.col("page_id") < F.col("target"), F.col("target")).alias("revisits"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = Rolled(folder, ".warc.gz", ARCHIVE)
        made: dict[str, int] = {}
        for pdf in batches:
            for page, url, html, revisits in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["revisits"]):
                out.room()
                for part in records(None if pd.isna(page) else int(page), url, utf8(html), None if pd.isna(revisits) else int(revisits)):
                    out.write(part)
                made[out.uri] = made.get(out.uri, 0) + 1
        out.close()
        if made:
            yield pd.DataFrame({"path": list(made), "n_records": list(made.values())})

    return written(marked.mapInPandas(run, "path string, n_records long"), "archives")


def parsed(stream, with_data: bool) -> Iterator[tuple]:
    """Chunk rows of one archive: page, kind, refers_to, chunk, n_bytes, total, sha1, last[, data]."""
    page = kind = None
    sha, total, number, expected = hashlib.sha1(), 0, 0, 0
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while (line := stream.readline().strip()):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        left = int(head["content-length"])
        name = (head.get("warc-segment-origin-id") or head["warc-record-id"]).removeprefix("<urn:page:").removesuffix(">")
        if head["warc-type"] == "revisit":
            digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
            size = int(head["warc-payload-length"])
            refers = int(head["warc-refers-to"].removeprefix("<urn:page:").removesuffix(">"))
            yield (None if name == "null" else int(name), "revisit", refers, 0, 0, size, digest, True, *([b""] if with_data else []))
            continue
        if head["warc-type"] == "response":
            page, kind = None if name == "null" else int(name), "response"
            sha, total, number, expected = hashlib.sha1(), 0, 0, 0
            while (line := stream.readline()).strip():
                left -= len(line)
                if line.lower().startswith(b"content-length:"):
                    expected = int(line.split(b":")[1])
            left -= len(line)
        while left > 0 or (total == expected == 0 and number == 0):
            data = stream.read(min(left, CHUNK))
            if left > 0 and not data:
                raise EOFError("an archive ends within a record")
            sha.update(data)
            left, total = left - len(data), total + len(data)
            yield (page, kind, None, number, len(data), total, sha.copy().hexdigest(), total == expected, *([data] if with_data else []))
            number += 1


CHUNKS = "page_id long, record_type string, refers_to long, chunk_no int, chunk_bytes long, payload_bytes long, payload_digest string, last boolean"


def read(archives: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table of archives given by ``path``. An archive is one task's work; its size is bounded at writing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNKS.split(", ")] + ["data"] * with_data
        for pdf in batches:
            for path in pdf["path"]:
                with reading_stream(path) as raw:
                    rows, size = [], 0
                    for row in parsed(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18), with_data):
                        rows.append(row)
                        size += 200 + row[4] * with_data
                        if size > 1 << 23:
                            yield _frame(rows, names)
                            rows, size = [], 0
                    if rows:
                        yield _frame(rows, names)

    many = archives.select("path").repartition(partitions(archives.sparkSession))
    return many.mapInPandas(run, CHUNKS + ", data binary" * with_data)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.assign(page_id=out["page_id"].astype("Int64"), refers_to=out["refers_to"].astype("Int64"))


def query(pages: DataFrame) -> DataFrame:
    """The contract's columns, from archives written to the shared folder and read back."""
    folder = new_path(pages.sparkSession, "warc")
    chunks = read(write(pages, folder), with_data=False)
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as payload_digest from p),
m as (select payload_digest, payload_bytes, max(page_id) as target, count(*) as n from d where payload_bytes >= {REVISIT_FROM} group by all)
select d.page_id, d.payload_bytes, d.payload_digest, case when d.page_id < m.target then 'revisit' else 'response' end as record_type,
       case when d.page_id < m.target then m.target end as refers_to
from d left join m using (payload_digest, payload_bytes)
"""
