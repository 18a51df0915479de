"""WARC archives compressed record by record with a dictionary of their own, and their reader.

A task writes its rows into archives of about ARCHIVE_BYTES: a skippable frame with a
Zstandard dictionary trained on the archive's first records, then one frame for each record.
The trainer needs several records that have something in common; where it finds too little, the
records' own last bytes are the dictionary. Equal payloads are archived once: the
record of the smallest page id is a response, the others are revisits that refer to it.

Null html is an empty payload. Rows with a null page id are never referred to; where no row of a
payload has an id, all are responses. Rows that share the smallest id are all responses. Urls may
be null (no target URI) or hold any character (blanks and controls are percent-encoded).
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import files
from cairn.llm.texts import slices
from cairn.session import materialise, scratch

#: Marks the skippable frame that holds a dictionary.
DICTIONARY = 0x184D2A5D
ARCHIVE_BYTES = 64 << 20
#: Bytes of records that a dictionary is trained on, and of the dictionary.
SAMPLE_BYTES, DICT_BYTES = 1 << 20, 1 << 16
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTROL = re.compile(r"[\x00-\x20\x7f]+")


def page_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, first: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{page_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + CONTROL.sub(lambda m: quote(m[0]), url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from the first records of an archive."""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(256, sum(map(len, samples)) // 8)), samples, k=200, d=8)
    except zstandard.ZstdError:  # so the trainer says that there is too little to train on
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICT_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """One archive file; records wait until there are enough to train on."""

    def __init__(self, folder: str, stem: str) -> None:
        self.uri, self.out = files.create(folder, stem, ".warc.zst")
        self.waiting: list[bytes] | None = []
        self.size = self.records = 0

    def add(self, data: bytes) -> None:
        self.size += len(data)
        self.records += 1
        if self.waiting is None:
            self.out.write(self.packer.compress(data))
            return
        self.waiting.append(data)
        if self.size >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        own = train(self.waiting)
        raw = own.as_bytes()
        self.out.write(struct.pack("<II", DICTIONARY, len(raw)) + raw)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=True)
        for data in self.waiting:
            self.out.write(self.packer.compress(data))
        self.waiting = None

    def close(self) -> tuple[str, int]:
        if self.waiting is not None:
            self._begin()
        self.out.close()
        return self.uri, self.records


def records(data: bytes) -> Iterator[bytes]:
    """The decompressed records of an archive."""
    at, own = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        own = zstandard.ZstdCompressionDict(data[8:at])
    unpacker, view = zstandard.ZstdDecompressor(dict_data=own), memoryview(data)
    while at < len(data):
        one, parts = unpacker.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            parts.append(one.decompress(view[at : at + (1 << 16)]))
            at = min(at + (1 << 16), len(data)) - len(one.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """page id, payload bytes, digest, type, the page referred to, payload (None of a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (size != len(payload) or digest != page_digest(payload)):
        raise ValueError("a payload doesn't match its record's digest")
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    return number(fields["WARC-Record-ID"]), size, digest, kind, number(fields.get("WARC-Refers-To")), payload if kind == "response" else None


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, first): first is the smallest id of a payload that recurs, else null."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    again = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # written down, so that both sides are dealt anew and a payload of many pages can be split
    return rows.join(materialise(again.select("digest", "first"), "warc-repeated"), "digest", "left").select("page_id", "url", "payload", "first")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, **columns: str) -> DataFrame:
    """Write all pages; the manifest (uri, n_records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, archive, stem = [], None, f"pages-{TaskContext.get().partitionId():06d}"
        for part in slices(batches, "payload"):
            for page, url, payload, first in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "first"))):
                archive = archive or Archive(folder, stem)
                archive.add(record(page, url, payload, first is not None and page != first, first))
                if archive.size >= archive_bytes:
                    made.append(archive.close())
                    archive = None
        if archive:
            made.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["uri", "n_records"])

    return materialise(mark_revisits(pages, **columns).mapInArrow(run, "uri string, n_records long"), "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                rows, held = [], 0
                for data in records(files.read(uri)):
                    rows.append(parse(data)[: len(names)])
                    held += len(data) * with_payload
                    if len(rows) >= 5_000 or held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    tasks = manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.select("uri").repartition(tasks, "uri").mapInArrow(run, schema)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """The contract's query: every page written to an archive and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages, scratch(spark, "op3")), with_payload=False)


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first, count(*) OVER (PARTITION BY hex) AS n FROM h),
g AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, 5 * i + 1, 5))::BIGINT) AS five FROM f)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((five[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM g
"""
