"""WARC archives: writing, normalising a monolithic gzip stream, and reading by an offset index.

Archives are first written as one gzip stream for the whole file, as crawlers without record-wise compression leave
them. The normaliser inflates such a stream once, from front to back, and rewrites each record as a gzip member of its
own; a sidecar index names offset and length of each member, so that a record can be read without the rest.
"""

from __future__ import annotations

import base64
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, attach, dealt, materialise, operator, shared_dir

#: Bytes of records in an archive before the next is begun; bytes read or inflated at once.
ARCHIVE, CHUNK = 256 << 20, 1 << 20
#: Date of records whose table has none.
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "path string, records long"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    tail = name.rstrip(">").rpartition(":")[2]
    return None if tail == "null" else int(tail)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with the payload, or a revisit (refers_to is not null) with its HTTP header only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body + b"\r\n\r\n"


def headers(block: bytes) -> dict[str, str]:
    """The named fields of a header block, in lower case; its first line is left out."""
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:] if line)}


def inflated(file, chunk: int = CHUNK) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, read and inflated once, at most chunk at a time; a file that ends
    within a member is an error."""
    engine, fresh = zlib.decompressobj(31), True
    data = file.read(chunk)
    while data:
        yield engine.decompress(data, chunk)
        data, fresh = engine.unconsumed_tail, False
        if engine.eof:
            data, engine, fresh = engine.unused_data, zlib.decompressobj(31), True
        data = data or file.read(chunk)
    if not fresh:
        yield engine.flush()
        if not engine.eof:
            raise ValueError("the archive ends within a gzip member")


def records(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream; memory is that of one record."""
    chunks, held = iter(chunks), bytearray()

    def need(done) -> bool:
        while not done():
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while need(lambda: b"\r\n\r\n" in held):
        head = held.index(b"\r\n\r\n") + 4
        size = head + int(headers(bytes(held[:head]))["content-length"]) + 4
        if not need(lambda size=size: len(held) >= size):
            raise ValueError("the archive ends within a record")
        yield bytes(held[:size])
        del held[:size]


def normalise(source: str, target: str) -> int:
    """Rewrite source to target, a member for each record, and target.idx with a JSON line for each; their number."""
    (fs, old), (out_fs, new), at, n = pafs.FileSystem.from_uri(source), pafs.FileSystem.from_uri(target), 0, 0
    with fs.open_input_stream(old, compression=None) as file, out_fs.open_output_stream(new, compression=None) as out, out_fs.open_output_stream(f"{new}.idx") as index:
        for r in records(inflated(file)):
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = pack.compress(r) + pack.flush()
            h = headers(r[: r.index(b"\r\n\r\n")])
            index.write((json.dumps({"offset": at, "length": len(member), "id": h["warc-record-id"], "type": h["warc-type"], "uri": h.get("warc-target-uri")}) + "\n").encode())
            out.write(member)
            at, n = at + len(member), n + 1
    return n


def read_member(file, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of the record at an offset."""
    file.seek(offset)
    head, _, body = zlib.decompress(file.read(length), 31).partition(b"\r\n\r\n")
    http, _, payload = body[:-4].partition(b"\r\n\r\n")
    return headers(head), headers(http), payload


def duplicates(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, refers_to of the pages whose payload (of at least so many bytes) another page with a larger page_id has."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = materialise(pages.select("page_id", F.octet_length(payload).alias("size"), F.unhex(F.sha1(payload)).alias("digest")).where(F.col("size") >= least))
    groups = materialise(rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"))
    met = attach(rows.select("page_id", "digest"), groups, "digest", "n", rows.count())
    return materialise(met.where("page_id < refers_to").select(F.col("page_id").alias("own_id"), "refers_to").distinct())


@operator
def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """One record per row of pages, in archives that are one gzip stream each; returns path and number of records.

    Of pages with equal payloads of at least `least` bytes the one with the largest page_id is the response, others are
    revisits of it. Null html is an empty payload; a null page_id is always a response, and so is a row that repeats
    the largest page_id. Tasks write to names of their own; only what committed tasks report is read later.
    """
    twice = duplicates(pages, least)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.join(F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice, F.col("page_id") == F.col("own_id"), "left").drop("own_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        fs, base = pafs.FileSystem.from_uri(folder)
        done, out = [], None

        def finish():
            out.write(pack.flush())
            out.close()
            done.append((f"{folder}/{name}", n))

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is not None and size >= ARCHIVE:
                    finish()
                    out = None
                if out is None:
                    fs.create_dir(base)
                    name, pack, size, n = f"{uuid.uuid4().hex}.warc.gz", zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                payload = html.encode("utf-8", "surrogatepass")
                r = record(page_id, url, payload, base64.b32encode(hashlib.sha1(payload).digest()).decode(), refers_to)
                out.write(pack.compress(r))
                size, n = size + len(r), n + 1
        if out is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["path", "records"]), preserve_index=False)

    return materialise(rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, _MANIFEST))


@operator
def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Each archive rewritten with a member per record and a sidecar index; path and number of records of the new ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs.create_dir(base)
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"path": [target], "records": [normalise(path, target)]}), preserve_index=False)

    return materialise(dealt(archives.select("path")).mapInArrow(run, _MANIFEST))


@operator
def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records, each read by its index entry.

    The digest of a response is taken from its payload and must be the one its header gives, and an archive must hold as many
    records as the table of archives says.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                out, n = [], 0
                with fs.open_input_file(name) as file, fs.open_input_stream(f"{name}.idx") as index:
                    for line in io.TextIOWrapper(io.BufferedReader(index), "utf-8"):
                        entry, n = json.loads(line), n + 1
                        warc, http, payload = read_member(file, entry["offset"], entry["length"])
                        digest, size = warc["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                        if warc["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"damaged record {entry['id']} in {path}")
                        refers_to = warc.get("warc-refers-to")
                        out.append((page_of(warc["warc-record-id"]), size, digest, warc["warc-type"], page_of(refers_to) if refers_to else None))
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                if n != expected:
                    raise ValueError(f"{n} of {expected} records in {path}")
                if out:
                    yield _rows(out)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return dealt(archives.select("path", "records")).mapInArrow(run, schema)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


@operator
def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write, normalise, and read back: the rows of read_archives."""
    spark = pages.sparkSession
    return read_archives(normalise_archives(write_archives(pages, shared_dir(spark, scratch=True), least), shared_dir(spark)))
