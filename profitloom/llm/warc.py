"""WARC archives: a writer with revisit records and a sequential, verifying reader.

Each record is a gzip member of its own. The reader decompresses step by step, takes a record's
header up to the empty line, frames its block by Content-Length and checks the block's and the
payload's digest; a broken frame, a digest that differs or a cut archive raises an error.

Of records with equal payloads of ``least`` bytes or more, the one with the smallest page id is a
response and the others revisit it; rows that share that id are all responses, and payloads whose
rows have no id at all aren't revisited. A null payload is empty, a null url is left out of the
header, a null id comes back null. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profitloom import storage
from profitloom.llm.common import batches, record_batch, ship, stored

VERSION = b"WARC/1.1"
_BYTES = 8 << 20
_CHUNK = 1 << 18
_ARCHIVE = 256 << 20
#: Bytes of repeated payloads' digests up to which they are broadcast; beyond it they are joined.
BROADCAST_BYTES = 32 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_MANIFEST = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = [VERSION, f"WARC-Type: {kind}".encode()]
    lines += [f"{name}: {value}".encode() for name, value in fields]
    lines.append(f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}".encode())
    lines.append(f"Content-Length: {len(block)}".encode())
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The response or revisit record of a page."""
    revisit = refers_to is not None
    fields = [("WARC-Record-ID", record_id(page_id, digest))]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("X-Refers-To-Page-Id", str(refers_to)),
        ]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    return record("revisit" if revisit else "response", fields, _HTTP + (b"" if revisit else payload))


def members(stream) -> Iterator[bytes]:
    """Decompressed bytes of a gzip file piece by piece; ``None`` after each member."""
    inflate, held, fresh = zlib.decompressobj(31), b"", True
    while True:
        if not held:
            held = stream.read(_CHUNK)
            if not held:
                break
        fresh = False
        out = inflate.decompress(held, _CHUNK)
        held = inflate.unconsumed_tail
        if out:
            yield out
        if inflate.eof:
            held = inflate.unused_data
            inflate, fresh = zlib.decompressobj(31), True
            yield None
    if not fresh:
        raise ValueError("the archive ends inside a record")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-cased names) and block of each record, verified."""
    held, header, end = bytearray(), None, 0
    for piece in members(stream):
        if piece is not None:
            held += piece
            if header is None and (at := held.find(b"\r\n\r\n")) >= 0:
                lines = bytes(held[:at]).split(b"\r\n")
                if lines[0] != VERSION:
                    raise ValueError(f"no record begins with {lines[0][:20]!r}")
                header = {n.strip().lower().decode(): v.strip().decode() for n, _, v in (x.partition(b":") for x in lines[1:])}
                del held[: at + 4]
                end = int(header["content-length"])
            continue
        if header is None or len(held) != end + 4 or bytes(held[end:]) != b"\r\n\r\n":
            raise ValueError("a record's length differs from its Content-Length")
        block = bytes(held[:end])
        verify(header, block)
        yield header, block
        held, header = bytearray(), None


def verify(header: dict[str, str], block: bytes) -> None:
    """Check the digests of a record."""
    checks = [("warc-block-digest", block)]
    if header["warc-type"] == "response":
        checks.append(("warc-payload-digest", block.partition(b"\r\n\r\n")[2]))
    for name, content in checks:
        kind, _, value = header[name].partition(":")
        if hashlib.new(kind, content).hexdigest() != value:
            raise ValueError(f"{name} of {header['warc-record-id']} differs from its content")


# Spellings of Spark's file systems, and how Arrow names or mounts the same place.
_PLACES = {"s3a://": "s3://", "s3n://": "s3://", "dbfs:/": "/dbfs/"}


def arrow_path(path: str) -> str:
    """A path as Spark's readers take it, as Arrow's file systems do."""
    for spelling, other in _PLACES.items():
        if path.startswith(spelling):
            rest = path[len(spelling) :]
            return other + (rest.lstrip("/") if other.startswith("/") else rest)
    return path


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system that holds a path, and the path within it."""
    return pyarrow.fs.FileSystem.from_uri(arrow_path(path))


def write_archives(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write a record for each page; returns the archives' paths, record counts and sizes."""
    spark = pages.sparkSession
    ship(spark)
    payload = F.coalesce(F.col("html"), F.lit(""))
    # Names of their own: other columns may be called anything.
    rows = pages.select("page_id", "url", "html").withColumns(
        {"_digest": F.sha2(payload.cast("binary"), 256), "_bytes": F.octet_length(payload)}
    )
    repeated = stored(
        spark,
        rows.where(F.col("_bytes") >= least)
        .groupBy("_digest")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 and _first is not null")
        .select("_digest", "_first"),
        "warc-repeated",
    )
    small = repeated.count() * 100 <= BROADCAST_BYTES
    known = rows.join(F.broadcast(repeated) if small else repeated, "_digest", "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("_first")), None).otherwise(F.col("_first"))
    folder = storage.new_folder(spark, "warc")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        out, path, done = None, "", []

        def close():
            done.append((path, n, size))
            out.close()

        n = size = 0
        for batch in batches(source, _BYTES):
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{path.rsplit('/', 1)[1]}", compression=None)
                data = page_record(page_id, url, (html or "").encode(), digest, refers_to)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= _ARCHIVE:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield record_batch(_MANIFEST, [list(c) for c in zip(*done)])

    manifest = known.select("page_id", "url", "html", "_digest", refers.alias("_refers_to")).mapInArrow(
        run, "path string, n_records long, n_bytes long"
    )
    # Only what is listed here was written by a task that ended well; a lost task's file is not read.
    return stored(spark, manifest, "warc-manifest")


_RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("target_uri", pa.string()),
        ("payload", pa.binary()),
    ]
)
_COLUMNS = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "target_uri string, payload binary"
)


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the listed archives; ``payload`` is null for revisits or if not asked for."""
    ship(spark)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, name = file_system(path)
                rows, size, n = [], 0, 0
                with store.open_input_stream(name, compression=None) as stream:
                    for header, block in records(stream):
                        whole = header["warc-type"] == "response"
                        payload = block.partition(b"\r\n\r\n")[2] if whole else None
                        if whole and len(payload) != int(header["x-payload-length"]):
                            raise ValueError("a payload's length differs from its header")
                        page, refers = header.get("x-page-id"), header.get("x-refers-to-page-id")
                        rows.append(
                            (
                                page and int(page),
                                int(header["x-payload-length"]),
                                header["warc-payload-digest"].partition(":")[2],
                                header["warc-type"],
                                refers and int(refers),
                                header.get("warc-target-uri"),
                                payload if payloads else None,
                            )
                        )
                        n += 1
                        size += len(block)
                        if len(rows) >= 5000 or payloads and size >= _BYTES:
                            yield record_batch(_RECORD, [list(c) for c in zip(*rows)])
                            rows, size = [], 0
                if n != expected:
                    raise ValueError(f"{path} holds {n} records, not {expected}")
                if rows:
                    yield record_batch(_RECORD, [list(c) for c in zip(*rows)])

    files = max(1, manifest.count())
    return manifest.select("path", "n_records").repartition(files, "path").mapInArrow(run, _COLUMNS)
