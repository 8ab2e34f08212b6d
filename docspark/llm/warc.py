"""WARC archives: written with an index first, read by coalesced byte ranges.

Archives are `.warc.gz` files of one gzip member per record, in the shared
folder. Each task writes a file of its own (a new one every `FILE_BYTES`) and
returns one index row per record: file, offset, length, URL, digest. A retried
task writes other files; only files named in the committed index count, so a
lost executor leaves nothing double. Readers never scan an archive: they take
selected index rows, sort them by file and offset, merge ranges that lie close
together into one read, and cut the members out of what was read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators.scale import join_to_groups
from docspark.session import scratch_path, stored

FILE_BYTES = 64 << 20
#: Ranges at most this far apart become one read of at most `READ_BYTES`.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Smaller payloads are stored again rather than referred to.
LEAST_SHARED = 1000
DATE = "2000-01-01T00:00:00Z"

INDEX = ("file string, offset long, length long, page_id long, url string, record_type string, "
         "refers_to long, payload_digest string, payload_bytes long")
RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, html string")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _sha1(digest_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{hashlib.md5(f'page {page_id}'.encode()).hexdigest()}>"


def record_bytes(url: str | None, page_id: int | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, gzip-compressed as a member of its own.

    A revisit holds the HTTP head only; its Content-Length is the length of
    the payload it refers to.
    """
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = head + payload if kind == "response" else head
    fields = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: {_sha1(digest)}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}"]
    if url is not None:
        clean = url.replace("\r", "%0D").replace("\n", "%0A")
        fields.append(f"WARC-Target-URI: {clean}")
    if page_id is not None:
        fields.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                   f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    raw = "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = rest[:int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        stream, path, at = None, "", 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode("utf-8")
                raw = record_bytes(row["url"], row["page_id"], payload, row["payload_digest"], row["record_type"], row["refers_to"])
                if stream is None or at + len(raw) > FILE_BYTES and at:
                    if stream is not None:
                        stream.close()
                    store, base = _open(folder)
                    store.create_dir(base, recursive=True)
                    path, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    stream = store.open_output_stream(_open(path)[1], compression=None)
                stream.write(raw)
                rows.append((path, at, len(raw), row["page_id"], row["url"], row["record_type"], row["refers_to"],
                             row["payload_digest"], row["payload_bytes"]))
                at += len(raw)
            names = [c.split()[0] for c in INDEX.split(", ")]
            kinds = [pa.string() if c.split()[1] == "string" else pa.int64() for c in INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)
        if stream is not None:
            stream.close()

    return run


def record_plan(pages: DataFrame) -> DataFrame:
    """(page_id, payload_digest, payload_bytes, record_type, refers_to).

    Of rows with equal payloads of at least `LEAST_SHARED` bytes, those with
    the largest page_id are responses and the others revisit it. The largest
    id per digest is a plain maximum; only digests of several rows are joined
    back, hot ones salted.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    facts = stored(pages.select(
        "page_id", F.sha1(F.encode(payload, "UTF-8")).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes")), "payloads")
    shared = stored(facts.filter(F.col("payload_bytes") >= LEAST_SHARED).groupBy("payload_digest").agg(
        F.max("page_id").alias("largest"), F.count("*").alias("held")).filter("held > 1"), "shared-payloads")
    return join_to_groups(facts, shared, ["payload_digest"], "held", "page_id", "left").select(
        "page_id", "payload_digest", "payload_bytes",
        F.expr("CASE WHEN largest IS NULL OR page_id <=> largest THEN 'response' ELSE 'revisit' END").alias("record_type"),
        F.expr("CASE WHEN largest IS NOT NULL AND NOT (page_id <=> largest) THEN largest END").alias("refers_to"))


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write one record per row of `pages` (page_id, url, html); returns the
    committed index. Null html has an empty payload; null URLs have no target
    field; rows that share a page_id and payload are records of their own."""
    plan = record_plan(pages).distinct()
    payload = F.coalesce(F.col("html"), F.lit(""))
    # Rows meet their plan by id and payload, so repeated ids keep their own.
    rows = pages.select("page_id", "url", "html", F.sha1(F.encode(payload, "UTF-8")).alias("d")).join(
        plan.withColumnRenamed("page_id", "p"),
        F.expr("page_id <=> p AND d = payload_digest")).drop("p", "d")
    return stored(rows.select(
        "page_id", "url", "html", "payload_digest", "payload_bytes", "record_type", "refers_to").mapInArrow(
        _writer(folder), INDEX), "warc-index")


def merged_ranges(offsets: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Index ranges [a, b) of sorted records to be fetched by one read each."""
    out, a = [], 0
    for b in range(1, len(offsets) + 1):
        if b == len(offsets) or offsets[b] - (offsets[b - 1] + lengths[b - 1]) > GAP_BYTES or (
                offsets[b] + lengths[b] - offsets[a] > READ_BYTES):
            out.append((a, b))
            a = b
    return out


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.string() if c.split()[1] == "string" else pa.int64() for c in RECORDS.split(", ")]
    for batch in batches:
        files = batch.column("file").to_pylist()
        offsets, lengths = (batch.column(c).to_numpy() for c in ("offset", "length"))
        edges = [i for i in range(len(files) + 1) if i in (0, len(files)) or files[i] != files[i - 1]]
        for low, high in zip(edges, edges[1:]):
            store, path = _open(files[low])
            with store.open_input_file(path) as source:
                for a, b in merged_ranges(offsets[low:high], lengths[low:high]):
                    a, b = a + low, b + low
                    begin, end = int(offsets[a]), int(offsets[b - 1] + lengths[b - 1])
                    raw = source.read_at(end - begin, begin)
                    rows = [_row(raw[offsets[i] - begin:offsets[i] - begin + lengths[i]]) for i in range(a, b)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)


def _row(member: bytes) -> tuple:
    fields, http, payload = parse_record(zlib.decompress(member, 31))
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return (number("x-page-id"), fields.get("warc-target-uri"), int(http["content-length"]), digest,
            fields["warc-type"], number("x-refers-to-page-id"),
            payload.decode("utf-8") if fields["warc-type"] == "response" else None)


def read_warc(index: DataFrame) -> DataFrame:
    """The records of selected index rows.

    Rows are dealt by file and stretch of it, so a task reads neighbouring
    records in order and a large file is read by several tasks.
    """
    stretch = F.floor(F.col("offset") / F.lit(READ_BYTES))
    return index.select("file", "offset", "length").repartition("file", stretch).sortWithinPartitions(
        "file", "offset").mapInArrow(_reader, RECORDS)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """The contract's columns: write every page, read every record back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_warc(write_warc(pages.select("page_id", "url", "html"), folder)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
f AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS largest FROM f)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN largest IS NULL OR page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM g
"""
