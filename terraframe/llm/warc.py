"""WARC archives: write with an index first, read back by coalesced byte ranges.

Every task writes archive files of its own, one gzip member per record, into a folder of the shared
storage, and returns an index row per record: file, offset, length, URL, digest. The index is written as a
table when the archives are; files of failed or repeated tasks aren't in it and so are never read. Reading
takes any selection of index rows, deals them out by file and block, sorts them by offset, and merges
ranges whose gap is small into one read.

Records with equal payloads of at least ``min_revisit`` bytes are stored once: the one with the smallest id is a
response, the others are revisit records that name it. Rows that share the smallest id are all responses.

Extra columns are ignored, whatever their names; ids are whole numbers. Nulls: a null payload is empty, a null URL is written as an empty target URI, a null id stays null and is never the
smallest. Very long payloads are one record each; an empty table makes no file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .common import arrow_batches, attach, fresh, leave, materialise

#: A file is closed when it holds this many bytes; a range block and a merged read are as large.
FILE_BYTES = 32 << 20
BLOCK_BYTES = 4 << 20
GAP_BYTES = 64 << 10
LEVEL = 4
INDEX = "id long, file string, offset long, length long, url string, payload_digest string, payload_bytes long, record_type string"
RECORD = "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def record(id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """An uncompressed WARC/1.1 record; a revisit carries no payload but its digest and length."""
    target = (url or "").encode("utf-8", "surrogatepass").replace(b"\r", b"%0D").replace(b"\n", b"%0A")
    kind, body = (b"response", payload) if refers_to is None else (b"revisit", b"")
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + kind,
        b"WARC-Record-ID: <urn:row:%s>" % (b"none" if id is None else b"%d" % id),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + target,
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"X-Payload-Length: %d" % len(payload),
        b"Content-Type: text/html; charset=utf-8",
        b"Content-Length: %d" % len(body),
    ]
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:row:%d>" % refers_to]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The fields of RECORD from one uncompressed record; a response's digest is taken anew from its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    h = {k: v for k, _, v in (x.partition(b": ") for x in lines[1:])}
    body = rest[: int(h[b"Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    number = lambda x: None if x is None or x == b"<urn:row:none>" else int(x[len(b"<urn:row:") : -1])
    kind, told = h[b"WARC-Type"].decode(), h[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(body).hexdigest() != told:
        raise ValueError("a payload differs from its digest")
    return number(h[b"WARC-Record-ID"]), h[b"WARC-Target-URI"].decode("utf-8", "replace"), kind, int(h[b"X-Payload-Length"]), told, number(h.get(b"WARC-Refers-To")), body if kind == "response" else None


def write(pages: DataFrame, folder: str, *, min_revisit: int = 100, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record per row of ``pages`` under ``folder`` and return the index (columns INDEX)."""
    arrow_batches(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = F.when(F.octet_length("payload") >= min_revisit, F.col("digest"))
    rows = rows.withColumn("group", long)
    groups = rows.filter("group IS NOT NULL").groupBy("group").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    rows = attach(rows, groups, "group", "n", ["first"], F.xxhash64("id", "url"))
    rows = rows.withColumn("refers_to", F.when(F.col("id").isNull() | (F.col("id") != F.col("first")), F.col("first")))

    def written(batches: Iterator) -> Iterator:
        import uuid
        import zlib

        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, None, 0
        for b in batches:
            index = []
            for id, url, payload, digest, refers_to in zip(*(b.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "refers_to"))):
                if out is None:
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = z.compress(record(id, url, payload, digest, refers_to)) + z.flush()
                out.write(member)
                index.append((id, name, at, len(member), url, digest, len(payload), "response" if refers_to is None else "revisit"))
                at += len(member)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            if index:
                schema = pa.schema([("id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string())])
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*index), schema)], schema=schema)
        if out is not None:
            out.close()

    index = rows.select("id", "url", "payload", "digest", "refers_to").mapInArrow(written, INDEX)
    return materialise(index, "warc-index", path=f"{folder}/index")


def read(index: DataFrame, folder: str, *, payloads: bool = True) -> DataFrame:
    """The records (columns RECORD) of the selected rows of an index; ``payloads`` false leaves that column null."""
    block = F.expr(f"offset div {BLOCK_BYTES}")
    # as many partitions as the records that are pointed to need, not the slim rows that point to them
    parts = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // BLOCK_BYTES))
    asked = index.select("file", block.alias("block"), "offset", "length").repartition(parts, F.col("file"), F.col("block")).sortWithinPartitions("file", "offset")

    def spans(rows: list[tuple]) -> Iterator[list[tuple]]:
        span: list[tuple] = []
        for r in rows:
            if span and (r[0] != span[-1][0] or r[1] - span[-1][1] - span[-1][2] > GAP_BYTES or r[1] + r[2] - span[0][1] > BLOCK_BYTES):
                yield span
                span = []
            span.append(r)
        if span:
            yield span

    def fetched(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        name, source = None, None
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))))
            for span in spans(rows):
                if span[0][0] != name:
                    if source is not None:
                        source.close()
                    name, source = span[0][0], store.open_input_file(f"{base}/{span[0][0]}")
                first, last = span[0][1], span[-1][1] + span[-1][2]
                data = source.read_at(last - first, first)
                found = [parse(zlib.decompress(data[at - first : at - first + n], 31)) for _, at, n in span]
                if not payloads:
                    found = [x[:-1] + (None,) for x in found]
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*found), schema)], schema=schema)
        if source is not None:
            source.close()

    return asked.select("file", "offset", "length").mapInArrow(fetched, RECORD)


def archive(pages: DataFrame, **columns: str) -> DataFrame:
    """Write ``pages`` as WARC in the shared folder and read every record back by the index (columns RECORD without payload)."""
    folder = fresh(pages.sparkSession, "warc")
    leave(pages.sparkSession, folder)
    return read(write(pages, folder, **columns), folder, payloads=False).drop("payload")
