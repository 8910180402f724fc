"""WARC archives: writing, normalising whole-file gzip, and random access.

* `write_warc` writes one record a page into archives that are each one gzip stream
  over the whole file, as many producers make them;
* `normalise_warc` inflates such a stream once, with bounded memory, rewrites every
  record as a gzip member of its own and writes a sidecar index of offsets;
* `read_warc` reaches every record through the index and inflates it alone.

Of records with equal payloads of at least `LEAST` bytes the one with the smallest
page_id is a response and the others revisit it; shorter ones are all responses.

A record's identifier is made of its page_id and its row's place in the input, so no two are alike and
the record that a revisit refers to exists.

Files get a name of the task's attempt and count only once they are in the manifest
that the driver reads (a row a file), so repeated or lost tasks leave no trace in
results.

Defined cases: null html is an empty payload; a null page_id is written without
its header and comes back as null, and revisits a response if another row of the
group has an id (else the group's rows are all responses); a null url has no target
header; rows that repeat page_id and payload are responses alike; control characters
in a url are percent-encoded; other columns are ignored; an empty table writes nothing.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise, small_batches, with_row_id

LEAST = 100
CHUNK = 1 << 20
MANIFEST = "path string, records bigint, bytes bigint"
INDEX = pa.schema([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("type", pa.string())])
_CRLF = b"\r\n"


def _safe(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _name(page_id: int | None, row: str) -> str:
    """Identifier of a page's record; the row tells pages of one id apart."""
    return f"<urn:page:{'none' if page_id is None else page_id}:{row}>"


def record(page_id: int | None, row: str, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_row: str | None) -> bytes:
    """One WARC/1.1 record, without compression, of a page in a row; a revisit names the record of its response.

    A revisit's block is the HTTP header alone, which states the payload's length.
    """
    kind = "response" if refers_to is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id, row)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_name(refers_to, refers_row)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + _CRLF + _CRLF


def parse_headers(head: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]) if k}


class RecordCutter:
    """Cuts a stream of bytes into WARC records; holds one record besides the last chunk."""

    def __init__(self) -> None:
        self.buffer = bytearray()

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.buffer += data
        at = 0
        while (end := self.buffer.find(b"\r\n\r\n", at)) >= 0:
            headers = parse_headers(bytes(self.buffer[at:end]))
            stop = end + 4 + int(headers["content-length"]) + 4
            if stop > len(self.buffer):
                break
            yield headers, bytes(self.buffer[at:stop])
            at = stop
        del self.buffer[:at]

    def close(self) -> None:
        if self.buffer:
            raise ValueError(f"{len(self.buffer)} bytes after the last whole record")


def inflated(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """Bytes of a gzip file of one or more members, chunk by chunk."""
    unzip, most = zlib.decompressobj(31), 8 * CHUNK
    while data := read(CHUNK):
        while True:
            out = unzip.decompress(data, most)
            if out:
                yield out
            data = unzip.unconsumed_tail
            if unzip.eof:
                data, unzip = unzip.unused_data, zlib.decompressobj(31)
                if not data:
                    break
            elif not data and len(out) < most:
                break


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    return system, root


_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def _write(folder: str, level: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for page_id, row, url, payload, digest, refers_to, refers_row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "row", "url", "payload", "digest", "refers_to", "refers_row")), strict=True):
                if out is None:
                    system, root = _open(folder)
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, packer, count, size = system.open_output_stream(path, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0, 0
                data = packer.compress(record(page_id, row, url, payload, digest, refers_to, refers_row))
                size += len(data)
                count += 1
                out.write(data)
        if out is not None:
            data = packer.flush()
            out.write(data)
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": count, "bytes": size + len(data)}], schema=_MANIFEST)

    return run


def write_warc(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write `pages` (page_id, url, html) into whole-file gzip archives below `folder`; the manifest."""
    small_batches(pages.sparkSession, 512)
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = with_row_id(pages, "pages").withColumn("digest", F.sha2("payload", 256)).withColumn("row", F.substring(F.sha2("row_id", 256), 1, 32)).drop("row_id")
    # one narrow row for each repeated payload; sums are taken before the shuffle
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row")))
    repeated = rows.where(F.octet_length("payload") >= LEAST).groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id"))
    refers = [F.when(~is_first & (F.octet_length("payload") >= LEAST), F.col(f"first.{c}")).alias(f"refers_{x}") for c, x in (("page_id", "to"), ("row", "row"))]
    joined = rows.join(repeated, "digest", "left").select("page_id", "row", "url", "payload", "digest", *refers)
    return materialise(joined.mapInArrow(_write(folder, level), MANIFEST), "warc-written")


def _normalise(folder: str, level: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("path").to_pylist():
                system, root = _open(folder)
                path, at, index, cutter = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, [], RecordCutter()
                with system.open_input_stream(source, compression=None) as read, system.open_output_stream(path, compression=None) as out:
                    for data in inflated(read.read):
                        for headers, whole in cutter.feed(data):
                            member = gzip.compress(whole, level, mtime=0)
                            out.write(member)
                            index.append((at, len(member), headers["warc-record-id"], headers["warc-type"]))
                            at += len(member)
                cutter.close()
                with system.open_output_stream(f"{path}.index") as out, pa.ipc.new_file(out, INDEX) as writer:
                    writer.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index, strict=True), INDEX, strict=True)], schema=INDEX))
                yield pa.RecordBatch.from_pylist([{"path": path, "records": len(index), "bytes": at}], schema=_MANIFEST)

    return run


def _one_file_a_task(manifest: DataFrame) -> DataFrame:
    return manifest.select("path").repartition(max(1, manifest.count()), "path")


def normalise_warc(manifest: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Rewrite the archives of `manifest` below `folder`, a gzip member a record and a sidecar index each; the new manifest."""
    return materialise(_one_file_a_task(manifest).mapInArrow(_normalise(folder, level), MANIFEST), "warc-normalised")


RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary, path string, offset bigint, length bigint"


def parse_record(whole: bytes) -> tuple:
    """(page_id, url, type, refers_to, digest, payload bytes, payload or None) of an inflated record; a wrong digest is an error."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    headers = parse_headers(head)
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, kind = headers["warc-payload-digest"].partition(":")[2], headers["warc-type"]
    size = int(parse_headers(http)["content-length"])
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {headers['warc-record-id']}")
    number, refers = headers.get("warc-page-id"), headers.get("warc-refers-to")
    return number and int(number), headers.get("warc-target-uri"), kind, refers and int(refers.split(":")[2]), digest, size, payload if kind == "response" else None


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    for batch in batches:
        for folder, path in zip(batch.column("folder").to_pylist(), batch.column("path").to_pylist(), strict=True):
            system, _ = fs.FileSystem.from_uri(folder)
            with system.open_input_file(f"{path}.index") as file:
                index = pa.ipc.open_file(file).read_all()
            with system.open_input_file(path) as file:
                out = []
                for offset, length in zip(index.column("offset").to_pylist(), index.column("length").to_pylist(), strict=True):
                    file.seek(offset)
                    out.append((*parse_record(gzip.decompress(file.read(length))), path, offset, length))
                    if len(out) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the normalised archives of `manifest` (columns RECORDS); a revisit's payload is null."""
    return _one_file_a_task(manifest).select(F.lit(folder).alias("folder"), "path").mapInArrow(_read, RECORDS)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
