"""Media columns: content-addressed payloads in tar shards.

A payload is stored losslessly as an 8-bit grey PNG, 64 samples wide, as a member of a tar shard named by its SHA-256. Rows
carry digest, shard, offset and length. A task stores equal content once; the index points every row to one copy of its
content, the first by shard and offset. Width and height are filled from the first 33 bytes of a member; features from the
payload read back, whose length must agree with them.

Null texts are empty; an empty text is one row of zero samples. Equal texts have equal values; repeated rows and rows without
an id get a row each. Very long texts are compressed and decompressed a megabyte at a time. Empty tables give empty results;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import new_path, written
from .common import partitions, utf8
from .files import Rolled, reading

WIDTH, SHARD, STEP = 64, 1 << 28, 1 << 14
#: Bytes of a shard whose members one task reads.
STRETCH = 1 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = len(SIGNATURE) + 25
#: Digests that a task remembers to store equal content once; older ones are forgotten, and such content may be stored again.
REMEMBERED = 200_000


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def stored(payload: bytes) -> bytes:
    """A PNG of the payload, whose length is a multiple of ``WIDTH``."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    z, parts = zlib.compressobj(6), []
    for at in range(0, len(rows), STEP):
        some = rows[at : at + STEP]
        lines = np.zeros((len(some), WIDTH + 1), np.uint8)
        lines[:, 1:] = some
        parts.append(z.compress(lines.tobytes()))
    parts.append(z.flush())
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", p) for p in parts if p) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int]:
    """Width and height from the first ``HEADER`` bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">II", data[16:24])


def payload_of(png: bytes) -> Iterator[bytes]:
    """The samples, some rows at a time."""
    width, _ = header(png[:HEADER])
    z, at, rest = zlib.decompressobj(), len(SIGNATURE), b""
    while at < len(png):
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        if kind == b"IDAT":
            data = png[at + 8 : at + 8 + size]
            while data:
                rest += z.decompress(data, 1 << 20)
                data = z.unconsumed_tail
                whole = len(rest) // (width + 1) * (width + 1)
                lines = np.frombuffer(rest[:whole], np.uint8).reshape(-1, width + 1)
                if lines[:, 0].any():
                    raise ValueError("a filtered line")
                yield lines[:, 1:].tobytes()
                rest = rest[whole:]
        at += 12 + size


def measured(png: bytes) -> tuple:
    """payload_bytes from the header, then payload digest, CRC of the last 64 bytes, media digest, features."""
    width, height = header(png[:HEADER])
    sha, tail, counts, n = hashlib.sha256(), b"", np.zeros(256, np.int64), 0
    for part in payload_of(png):
        sha.update(part)
        tail = (tail + part)[-WIDTH:]
        counts += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        n += len(part)
    if n != width * height:
        raise ValueError("the header and the samples disagree")
    values, share = np.arange(256), counts / n
    mean = float(values @ share)
    spread = float(((values - mean) ** 2) @ share) ** 0.5
    some = share[share > 0]
    feature = f"mean={mean:.4f};std={spread:.4f};entropy={abs(float(-(some * np.log2(some)).sum())):.4f};distinct={len(some)}"
    return n, sha.hexdigest(), zlib.crc32(tail), hashlib.sha256(png).hexdigest(), feature


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Write shards; one index row ``(doc_id, n_bytes, digest, shard, offset, length)`` for each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = Rolled(folder, ".tar", SHARD)
        seen: OrderedDict[bytes, tuple] = OrderedDict()
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                raw = utf8(text)
                key = hashlib.sha256(raw).digest()
                if (at := seen.get(key)) is None:
                    png = stored(raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH)))
                    digest = hashlib.sha256(png).hexdigest()
                    if out.out is not None and out.at >= out.most:
                        out.write(bytes(1024))
                    out.room()
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(png)
                    out.write(info.tobuf(tarfile.USTAR_FORMAT))
                    at = seen[key] = (digest, out.uri, out.at, len(png))
                    out.write(png + bytes(-len(png) % 512))
                    if len(seen) > REMEMBERED:
                        seen.popitem(last=False)
                rows.append((len(raw), *at))
            yield pd.DataFrame(rows, columns=["n_bytes", "digest", "shard", "offset", "length"]).assign(doc_id=pdf["doc_id"].astype("Int64").array)
        if out.out is not None:
            out.write(bytes(1024))
        out.close()

    index = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "n_bytes long, digest string, shard string, offset long, length long, doc_id long")
    return written(index, "media")


def addressed(index: DataFrame) -> DataFrame:
    """The index with every row pointing to the first copy of its content, and ``copies``, the number of its rows."""
    first = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"), F.count(F.lit(1)).alias("copies"))
    # Written, so that the rows of a digest need not meet in one task: the join alone can be split.
    return index.select("doc_id", "n_bytes", "digest").join(written(first, "firsts"), "digest").select("doc_id", "n_bytes", "digest", "at.*", "copies")


class Shards:
    """A few open shards, and the member read last."""

    def __init__(self, most: int = 4):
        self.open, self.most = OrderedDict(), most

    def get(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self.open:
            if len(self.open) >= self.most:
                self.open.popitem(last=False)[1].close()
            self.open[uri] = reading(uri)
        f = self.open[uri]
        f.seek(offset)
        return f.read(length)


def metadata(index: DataFrame) -> DataFrame:
    """``index`` with ``width``, ``height`` by range reads of headers only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards, last, size = Shards(), None, (0, 0)
        for pdf in batches:
            got = []
            for at in zip(pdf["shard"], pdf["offset"]):
                if at != last:
                    last, size = at, header(shards.get(*at, HEADER))
                got.append(size)
            yield pdf.assign(doc_id=pdf["doc_id"].astype("Int64"), width=[w for w, _ in got], height=[h for _, h in got])

    return index.mapInPandas(run, index.schema.simpleString()[7:-1].replace(":", " ") + ", width int, height int")


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns, from shards written to the shared folder and read back; then the row's address and metadata."""
    spark = docs.sparkSession
    index = addressed(store(docs, new_path(spark, "shards")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards, last, values = Shards(), None, ()
        for pdf in batches:
            rows = []
            for shard, offset, length, digest, samples in zip(pdf["shard"], pdf["offset"], pdf["length"], pdf["digest"], pdf["width"] * pdf["height"]):
                if last != (shard, offset):
                    values = measured(shards.get(shard, offset, length))
                    if values[3] != digest or values[0] != samples:
                        raise ValueError(f"{shard} at {offset} is not {digest}")
                    last = (shard, offset)
                rows.append((values[0], values[1], values[2], length, values[3], values[4]))
            got = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            yield got.assign(doc_id=pdf["doc_id"].astype("Int64").array, **{c: pdf[c].array for c in ("n_bytes", "digest", "shard", "offset", "length", "width", "height")})

    # Members of a stretch of a shard are read by one task; the rows of much copied content are spread by their ids.
    salt = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("copies") / 256))
    near = index.repartition(partitions(spark), "shard", F.floor(F.col("offset") / STRETCH), salt).sortWithinPartitions("shard", "offset").drop("copies")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return metadata(near).mapInPandas(run, schema + ", digest string, shard string, offset long, length long, width int, height int")
