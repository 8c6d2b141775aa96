"""WARC archives: writing records and reading them back in sequence.

A record is one gzip member. The reader feeds compressed bytes to zlib in small pieces, starts anew at each member's end,
frames the block by Content-Length, and checks payload and block digests. Archives are rows of at most about
``archive_bytes`` compressed bytes in a table of the shared folder (any store that Spark writes to); ``write_file`` and
``read_file`` do the same with files.

Of records with equal payloads of at least ``min_revisit_bytes``, that of the smallest page id is a ``response``; the others
are ``revisit`` records without payload that name it.

Edge cases: a null page counts as empty; a null url leaves the target out; rows that repeat the smallest id with the same
payload are responses too; a null id is the response only if no row with an id has the payload; extra columns are ignored; a
damaged member, a wrong length or a wrong digest raises ``WarcError``.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm import flat
from corpusgraph.session import discard, materialise

#: Largest table of duplicate digests that is broadcast (rows of a digest and an id).
BROADCAST_ROWS = 1_000_000
DATE = "2024-01-01T00:00:00Z"
_STATUS = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


class WarcError(ValueError):
    pass


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(key: str, url: str | None, payload: bytes, payload_digest: str | None = None, refers_to: str | None = None, length: int | None = None) -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit of a payload of ``length`` bytes."""
    revisit = refers_to is not None
    block = _STATUS % (length if revisit else len(payload)) + (b"" if revisit else payload)
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, key)}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + (payload_digest or digest(payload))),
        ("WARC-Block-Digest", "sha1:" + digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-Key", key),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.insert(3, ("WARC-Target-URI", "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in url)))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Key", refers_to), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, refers_to)}>")]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("".join([f"{k}: {v}\r\n" for k, v in (("WARC/1.1\r\n" + head[0][0], head[0][1]), *head[1:])]).encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def members(source: BinaryIO, piece: int = 1 << 16) -> Iterator[bytes]:
    """The decompressed bytes of each gzip member, read in pieces."""
    data = b""
    while True:
        data = data or source.read(piece)
        if not data:
            return
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if not data and not (data := source.read(piece)):
                raise WarcError("the archive ends within a member")
            try:
                out.append(unpack.decompress(data))
            except zlib.error as e:
                raise WarcError(f"damaged member: {e}") from e
            data = unpack.unused_data if unpack.eof else b""
        yield b"".join(out)


def read(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record in sequence, framed and verified."""
    for member in members(source):
        end = member.find(b"\r\n\r\n")
        lines = member[: max(end, 0)].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise WarcError("no record header")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        block = member[end + 4 : end + 4 + size]
        if len(block) != size or member[end + 4 + size :] != b"\r\n\r\n":
            raise WarcError("the block isn't as long as Content-Length says")
        if head.get("WARC-Block-Digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
            raise WarcError("wrong block digest")
        http, _, payload = block.partition(b"\r\n\r\n")
        if head["WARC-Type"] == "response" and "WARC-Payload-Digest" in head and head["WARC-Payload-Digest"] != "sha1:" + digest(payload):
            raise WarcError("wrong payload digest")
        head["X-Payload-Length"] = next((x.split(b":")[1].strip().decode() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), str(len(payload)))
        yield head, payload


def write_file(path: str, records: Iterator[bytes]) -> None:
    """An archive file from records."""
    with open(path, "wb") as f:
        f.writelines(records)


def read_file(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive file."""
    with open(path, "rb") as f:
        yield from read(f)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, archive_bytes: int = 4 << 20) -> DataFrame:
    """Archives (content binary) with a record for each page, in a table of the shared folder.

    Payload digests are worked out first and only they are grouped (summed on the map side). The groups of two or more are
    broadcast where their counted number allows it, so that no payload is shuffled; elsewhere the pages are joined to them by
    digest, where Spark can split a group that holds many pages.
    """
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"sha": F.sha1("payload"), "length": F.length("payload").cast("long")})
    groups = rows.where(F.col("length") >= min_revisit_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("sha", "first")
    groups = materialise(groups, "groups")
    placed = rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups, "sha", "left").withColumn("refers", F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string")))
    placed = placed.select(F.col("id").cast("string").alias("key"), "url", F.when(F.col("refers").isNull(), F.col("payload")).alias("payload"), "sha", "length", "refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in flat.tidy(batches):
            for k in range(batch.num_rows):
                key, url, payload, sha, length, refers = (batch.column(c)[k].as_py() for c in range(6))
                held.append(record(key or "", url, payload or b"", base64.b32encode(bytes.fromhex(sha)).decode(), refers, length))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["content"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["content"])

    out = materialise(placed.mapInArrow(run, "content binary"), "warc")
    discard(groups)
    return out


def read_archives(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """(key, url, record_type, payload_bytes, payload_digest, refers_to, payload) of each record of archives in a binary column.

    ``spark.read.format("binaryFile")`` gives such a column for archive files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        names = ["key", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in flat.tidy(batches):
            for content in batch.column(0):
                rows, size = [], 0
                for head, payload in read(io.BytesIO(content.as_py() or b"")):
                    revisit = head["WARC-Type"] == "revisit"
                    length = int(head["X-Payload-Length"]) if revisit else len(payload)
                    rows.append((head.get("X-Page-Key") or None, head.get("WARC-Target-URI"), head["WARC-Type"], length, head.get("WARC-Payload-Digest", "sha1:" + digest(payload)).removeprefix("sha1:"), head.get("X-Refers-To-Key"), None if revisit else payload))
                    size += len(payload)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return archives.select(content_col).mapInArrow(run, "key string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary")


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archive files under a path of any store."""
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path))
