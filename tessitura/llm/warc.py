"""WARC archives of a page table, and the chunked record table that reads them back.

No payload is ever held whole: the JVM cuts it into numbered chunks, the writer appends chunk after chunk, and the
reader yields (record, chunk number) rows whose ``digest`` is the SHA-256 of the payload up to that chunk.
"""
from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import work_folder, written
from .common import flushed, need, shared_file

#: The record date (the page table has none) and the crlf of the format.
DATE, CRLF = "1970-01-01T00:00:00Z", b"\r\n"
CHUNK_BYTES, LEAST_REVISIT_BYTES, LEVEL = 1 << 18, 100, 3

MANIFEST = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
CHUNKS = pa.schema([
    ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
    ("payload_bytes", pa.int64()), ("chunk_no", pa.int64()), ("n_bytes", pa.int64()), ("upto_bytes", pa.int64()),
    ("digest", pa.string()), ("last", pa.bool_()), ("data", pa.binary())])


def record_rows(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """One row per page with its payload, digest and record type.

    Of equal payloads of at least 100 bytes the smallest key is the response, others are revisits. A null payload is
    empty. Rows that repeat the smallest key are all responses; a null key is a revisit as soon as its payload has a
    page with a key, else a response.
    """
    need(pages, key, payload, url)
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    base = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    small = written(base.select("page_id", "digest", F.octet_length("payload").alias("n")), "warc-digests")
    first = small.filter(F.col("n") >= LEAST_REVISIT_BYTES).groupBy("digest").agg(
        F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 AND refers_to IS NOT NULL")
    revisits = small.join(first, "digest").filter("page_id IS NULL OR page_id > refers_to").groupBy("page_id", "digest").agg(
        F.min("refers_to").alias("refers_to"))
    revisits = revisits.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    joined = base.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select("page_id", "url", "payload", "digest", "refers_to")


def chunk_rows(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(page, chunk number) rows in payload order; an empty or omitted payload has one empty chunk."""
    n = F.octet_length("payload").cast("bigint")
    carried = F.when(F.col("refers_to").isNull(), n).otherwise(F.lit(0))
    chunks = F.greatest(F.lit(1), F.ceil(carried / chunk_bytes))
    numbered = records.select("*", n.alias("payload_bytes"), carried.alias("_carried"),
                              F.explode(F.sequence(F.lit(0).cast("bigint"), (chunks - 1).cast("bigint"))).alias("chunk_no"))
    piece = F.when(F.col("_carried") > 0, F.substring("payload", (F.col("chunk_no") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes)))
    return numbered.select("page_id", "url", "digest", "refers_to", "payload_bytes", "chunk_no",
                           F.coalesce(piece, F.lit(b"")).alias("data"))


def _name(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _head(page, url, digest, refers_to, payload_bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = len(http) + (payload_bytes if refers_to is None else 0)
    safe = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page)}",
             f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {block}"]
    if url is not None:
        lines.insert(3, f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        lines[-2:-2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    return "\r\n".join(lines).encode() + CRLF * 2 + http


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Appends the chunks of each task to an archive of its own; returns the committed files (file, records, bytes).

    Each record is a gzip member, compressed chunk by chunk, as archives usually are.

    A lost task leaves a file that no manifest row names. The chunks of a record must follow each other.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = system = path = name = member = None
        records = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to", "payload_bytes", "chunk_no")]
            data = batch.column("data")
            for i, (page, url, digest, refers, size, chunk) in enumerate(zip(*columns)):
                if out is None:
                    system, path, name = shared_file(folder, "warc.gz")
                    out = system.open_output_stream(path, compression=None)
                if chunk == 0:
                    if member is not None:
                        out.write(member.compress(CRLF * 2) + member.flush())
                    member = zlib.compressobj(LEVEL, zlib.DEFLATED, zlib.MAX_WBITS | 16)
                    out.write(member.compress(_head(page, url, digest, refers, size)))
                    records += 1
                out.write(member.compress(data[i].as_buffer()))
        if out is not None:
            out.write(member.compress(CRLF * 2) + member.flush())
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "records": records, "bytes": size}], schema=MANIFEST)

    return written(chunks.mapInArrow(run, "file string, records bigint, bytes bigint"), "warc-manifest")


def _headers(stream) -> dict[str, str] | None:
    """The header lines up to the blank one; None at the end of the archive."""
    first = stream.readline()
    if not first:
        return None
    found = {"": first.decode().strip()}
    while (line := stream.readline()).strip():
        key, _, value = line.decode().partition(":")
        found[key.strip().lower()] = value.strip()
    if not line:
        raise ValueError("an archive ends inside a header")
    return found


def _page(name: str) -> int | None:
    page = name.removeprefix("<urn:page:").removesuffix(">")
    return None if page == "null" else int(page)


def record_chunks(stream, chunk_bytes: int, with_data: bool) -> Iterator[tuple]:
    """Chunk rows of one archive, never holding more than a chunk; a wrong length or digest is an error."""
    while (head := _headers(stream)) is not None:
        if not head[""].startswith("WARC/"):
            raise ValueError(f"no record begins with {head['']!r}")
        start, http = int(head["content-length"]), 0
        size = None
        while True:
            line = stream.readline()
            http += len(line)
            if line in (CRLF, b""):
                break
            key, _, value = line.partition(b":")
            if key.lower() == b"content-length":
                size = int(value)
        left, digest, done, number = start - http, hashlib.sha256(), 0, 0
        kind, stated = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
        fixed = (_page(head["warc-record-id"]), kind, _page(head["warc-refers-to"]) if "warc-refers-to" in head else None,
                 head.get("warc-target-uri"), size)
        while True:
            data = stream.read(min(chunk_bytes, left))
            if len(data) < min(chunk_bytes, left):
                raise ValueError(f"record {head['warc-record-id']} is cut short")
            left -= len(data)
            done += len(data)
            digest.update(data)
            shown = stated if kind == "revisit" else digest.hexdigest()
            if not left and shown != stated:
                raise ValueError(f"record {head['warc-record-id']} has another digest than stated")
            yield (*fixed, number, len(data), done, shown, not left, data if with_data else None)
            number += 1
            if not left:
                break
        if stream.read(4) != CRLF * 2:
            raise ValueError(f"record {head['warc-record-id']} has no end")


def read_archives(manifest: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table: one row per record and chunk, with the digest of the payload up to it.

    A revisit has one empty chunk; its digest and length are those its headers state, its payload is ``refers_to``'s.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with system.open_input_stream(f"{root}/{name}", compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) as stream:
                    yield from flushed(CHUNKS, record_chunks(stream, chunk_bytes, with_data), 16 if with_data else 4096)

    files = max(1, manifest.count())
    schema = ("page_id bigint, record_type string, refers_to bigint, url string, payload_bytes bigint, chunk_no bigint, "
              "n_bytes bigint, upto_bytes bigint, digest string, last boolean, data binary")
    return manifest.select("file").repartition(files).mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """Writes all pages as WARC and returns the chunk rows read back from the files."""
    folder = work_folder(pages.sparkSession, "warc")
    manifest = write_archives(chunk_rows(record_rows(pages), chunk_bytes), folder)
    return read_archives(manifest, folder, chunk_bytes, with_data)
