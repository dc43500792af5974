"""WARC archives: write with an index first, then read chosen records by coalesced byte ranges.

Writing. The payload's digest is taken by Spark; the smallest page_id of each digest that occurs more than
once is joined back (broadcast while these are few, so that no page is shuffled), so a row knows whether it is a response or a revisit. Each task appends records, one gzip
member each, to archives of its own in the shared folder (through pyarrow's file systems, by the folder's
scheme) and returns an index row per record: file, offset, length, URL, digest. The index is written as a
table; a task that runs again writes files under a new name, and the index knows only those of the run that
ended.

Reading. The chosen index rows are sorted by file and offset; neighbours closer than GAP bytes are read in one
range of at most RANGE bytes, each record is unpacked alone and its block's digest is checked.

Defined results: a null html is an empty payload; a null URL is left out of the record; rows that repeat the
smallest page_id of their payload are responses too; a null page_id is never the smallest unless all are null,
then all are responses; payloads under MIN_SHARED bytes are always responses; other columns are left out; an
empty table gives an empty index and result.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm.runtime import Scratch, batches, column, small

MIN_SHARED = 100
#: Bytes at which a task begins its next archive.
ARCHIVE_BYTES = 512 << 20
GAP, RANGE = 64 << 10, 8 << 20
LEVEL = 3
#: Payloads that repeat up to which their digests are broadcast (about 120 bytes each).
BROADCAST_FIRSTS = 200_000

INDEX = "page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_END = b"\r\n\r\n"


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:") else "file://" + folder[5:])


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def pack(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{digest}:{url}")
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if revisit else b"Content-Length: %d\r\n" % len(payload)) + b"\r\n"
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    head.append(f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}")
    head.append(f"X-Payload-Length: {len(payload)}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page: {refers_to}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + _END, LEVEL, mtime=0)


def unpack(member: bytes) -> dict:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(_END)
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    kind, number = fields["WARC-Type"], lambda k: int(fields[k]) if k in fields else None
    payload = block.partition(_END)[2] if kind == "response" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    return {
        "page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": number("X-Refers-To-Page"),
        "payload_bytes": number("X-Payload-Length"), "payload_digest": digest, "payload": payload,
    }


def with_roles(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, html, digest and refers_to (null for responses)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    shared: Column = F.octet_length("html") >= MIN_SHARED
    firsts = (
        rows.where(shared)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select(F.col("digest").alias("d"), "first")
    )
    firsts = scratch.table(firsts, "firsts")  # a row for each payload that repeats; pages stay where they are while these are few
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(small(firsts, BROADCAST_FIRSTS), F.col("digest") == F.col("d"), "left").select(
        "page_id", "url", "html", "digest", F.when(later & shared, F.col("first")).alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row under ``folder``, which all executors share; returns the index."""

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = out = None
        file, at = "", 0
        try:
            for batch in parts:
                rows = []
                for page_id, url, html, digest, refers_to in zip(*(column(batch, c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        store, base = _open(folder)
                        store.create_dir(base, recursive=True)
                        file, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(file, compression=None)
                    payload = html.encode()
                    member = pack(page_id, url, payload, digest, refers_to)
                    out.write(member)
                    kind = "response" if refers_to is None else "revisit"
                    rows.append((page_id, url, digest, len(payload), kind, refers_to, file.rpartition("/")[2], at, len(member)))
                    at += len(member)
                columns = list(zip(*rows, strict=True)) or [()] * 9
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return batches(with_roles(pages, Scratch(pages.sparkSession)), step, INDEX)


def _ranges(rows: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, stop, members) for (offset, length) in order."""
    start = stop = 0
    members: list[tuple[int, int]] = []
    for offset, length in rows:
        if members and (offset - stop > GAP or offset + length - start > RANGE):
            yield start, stop, members
            members = []
        if not members:
            start = offset
        members.append((offset, length))
        stop = offset + length
    if members:
        yield start, stop, members


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index rows name: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits)."""

    names = [x.split()[0] for x in _RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        opened, source = None, None
        for batch in parts:
            chosen = list(zip(*(column(batch, c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            at = 0
            while at < len(chosen):
                file, stop = chosen[at][0], at
                while stop < len(chosen) and chosen[stop][0] == file:
                    stop += 1
                if file != opened:
                    source, opened = store.open_input_file(f"{base}/{file}"), file
                for low, high, members in _ranges([c[1:] for c in chosen[at:stop]]):
                    data = source.read_at(high - low, low)
                    got = [unpack(data[o - low : o - low + n]) for o, n in members]
                    yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], t) for c, t in zip(names, types, strict=True)], names)
                at = stop

    # a range sort keeps a file's neighbours together and splits a large file over tasks
    return batches(index.select("file", "offset", "length").orderBy("file", "offset"), step, _RECORD)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    folder = scratch.path("archives")
    index = scratch.table(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), "index")
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= {MIN_SHARED} GROUP BY digest)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first IS NULL OR p.page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR p.page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""
