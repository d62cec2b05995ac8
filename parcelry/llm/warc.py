"""Web archives with revisit records: written, resolved and read back.

Only headers are shuffled by payload digest: (page_id, url, digest, length), never payloads. The
smallest page_id of a digest is the original; every other record of that digest becomes a revisit that
names it. Each task then writes one archive of its rows, record by record, and commits it by a move. Reading streams one record at a time and joins revisits to their originals by record id.

Results by case: a null payload is an empty one, and empty payloads are equal; payloads shorter than
``min_bytes`` are always responses; rows that repeat the smallest page_id of a digest are all responses;
a row with a null page_id is always a response, as no revisit could name it and its own place is unknown;
a null url is written as ``urn:none`` and read back as null.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelry.llm.common import small, stage
from parcelry.llm.shared_files import committed, file_system
from parcelry.session import scratch_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_URL = "urn:none"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
FLUSH_BYTES = 1 << 22
PAGE_ID = "X-Page-ID"
LEVEL = 5
#: Tasks that read archives, at most; each then reads several, one after the other.
MOST_TASKS = 20_000


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_sha1): a page's header without its payload."""
    payload = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_sha1"))


def resolved(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(revisit_id, revisit_sha1, first_id, first_url) of the records that revisit another: joined by digest and length."""
    can = rows.where(F.col("payload_bytes") >= min_bytes).where("page_id IS NOT NULL")
    first = can.groupBy("payload_sha1", "payload_bytes").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("copies"))
    return (
        can.join(first.where("copies > 1"), ["payload_sha1", "payload_bytes"])
        .where("page_id > first.page_id")
        .select(F.col("page_id").alias("revisit_id"), F.col("payload_sha1").alias("revisit_sha1"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
        .distinct()
    )


def record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None, first_url: str | None, date: str) -> bytes:
    """One WARC 1.1 record; a revisit holds HTTP headers only, and names the original."""
    digest = digest_of(payload)
    block = HTTP_HEAD + f"Content-Length: {len(payload)}\r\n\r\n".encode() + (payload if first_id is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first_id is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_one_line(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
    ]
    if page_id is not None:
        lines.append(f"{PAGE_ID}: {page_id}")
    if first_id is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first_id, digest)}", f"WARC-Refers-To-Target-URI: {_one_line(first_url)}", f"WARC-Refers-To-Date: {date}"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _one_line(url: str | None) -> str:
    return NO_URL if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-31T00:00:00Z") -> DataFrame:
    """Writes every row of ``pages`` (page_id, url, html) as a gzip member, one archive for each task, and
    returns (file, records, bytes). A payload that several records share is written once. Payloads are not
    shuffled while the table of revisits is small enough to broadcast; beyond that one join shuffles them."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    revisits = small(stage(resolved(stage(headers(pages), "warc-headers"), min_bytes), "warc-revisits"))
    same = (pages["page_id"] == revisits["revisit_id"]) & (F.sha1(F.coalesce(pages["html"], F.lit(""))) == revisits["revisit_sha1"])
    joined = pages.join(revisits, same, "left").select("page_id", "url", "html", "first_id", "first_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows, size = f"part-{TaskContext.get().partitionId():05d}.warc.gz", 0, 0
        with committed(folder, name) as out:
            for batch in batches:
                for page_id, url, html, first_id, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    member = gzip.compress(record(page_id, url, (html or "").encode(), first_id, first_url, date), LEVEL, mtime=0)
                    out.write(member)
                    rows, size = rows + 1, size + len(member)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])

    return stage(joined.mapInArrow(run, "file string, records long, bytes long"), "warc-files")


def parsed(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an unpacked archive, one at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            fields[name] = value
        size = int(fields["Content-Length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends within a record")
        yield fields, block


def read_records(files: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives named in ``files`` (file): ids, type, url, digest and, of responses, the payload.

    A payload that doesn't have its header's digest is an error. ``payloads=False`` leaves html null.
    """
    schema = "page_id long, record_id string, record_type string, refers_to_id string, url string, payload_digest string, payload_bytes long, html string"
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as unpacked:
                    for fields, block in parsed(io.BufferedReader(unpacked, 1 << 16)):
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if payload is not None and digest_of(payload) != digest:
                            raise ValueError(f"{fields['WARC-Record-ID']} doesn't have the payload of its digest")
                        url = fields["WARC-Target-URI"]
                        page = fields.get(PAGE_ID)
                        rows.append((
                            None if page is None else int(page), fields["WARC-Record-ID"], kind, fields.get("WARC-Refers-To"), None if url == NO_URL else url,
                            digest, None if payload is None else len(payload), payload.decode() if payloads and payload is not None else None,
                        ))
                        held += len(block) if payloads else 0
                        if len(rows) >= 10_000 or held >= FLUSH_BYTES:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    tasks = max(1, min(files.count(), MOST_TASKS))
    return files.select("file").repartition(tasks).mapInArrow(run, schema)


def with_originals(records: DataFrame) -> DataFrame:
    """Revisits joined to their original responses: adds refers_to, and a revisit's full length and payload."""
    originals = records.where("record_type = 'response'").select(
        F.col("record_id").alias("original_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("original_bytes"), F.col("html").alias("original_html")
    ).dropDuplicates(["original_id"])
    responses = records.where("record_type = 'response'").select("page_id", "url", "record_type", "payload_digest", "payload_bytes", "html", F.lit(None).cast("long").alias("refers_to"))
    revisits = records.where("record_type = 'revisit'")
    return responses.unionByName(
        revisits.join(originals, revisits["refers_to_id"] == originals["original_id"], "left").select(
            "page_id", "url", "record_type", "payload_digest", F.col("original_bytes").alias("payload_bytes"), F.col("original_html").alias("html"), "refers_to"
        )
    )


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages as archives, reads those back, and resolves revisits; payloads stay in the archives."""
    folder = scratch_path(pages.sparkSession, "warc")
    files = write_archives(pages, folder, min_bytes)
    return with_originals(stage(read_records(files, folder, payloads=False), "warc-records"))
