"""WARC archives in Zstandard: one frame per record, and the dictionary in a skippable frame in front.

An archive is the bytes of one file: a skippable frame that holds the
dictionary, then a frame for each record. The reader loads the dictionary,
decodes frame by frame and checks each record's header and length.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the formats: first bytes of the skippable frame with a dictionary, of any skippable frame, of a
#: dictionary that is itself compressed.
DICTIONARY_FRAME = b"\x5d\x2a\x4d\x18"
SKIPPABLE = re.compile(rb"[\x50-\x5f]\x2a\x4d\x18")
FRAME = b"\x28\xb5\x2f\xfd"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
_REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
_TOKEN = re.compile(r"[!#$%&'*+\-.^_`|~0-9A-Za-z]+\Z")

#: Bytes of compressed records after which an archive is closed, and of the dictionary and of its training sample.
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 2 << 20
LEVEL = 3


class ArchiveError(ValueError):
    """An archive that breaks the format, with the place where it does."""


@dataclass
class Record:
    """The header fields, by lower-case name, and the block of a record."""

    headers: dict[str, str]
    block: bytes


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record in its written form. Line breaks in a value are percent-encoded."""
    lines = ["WARC/1.1"]
    for name, value in [*headers, ("Content-Length", str(len(block)))]:
        lines.append(f"{name}: {re.sub('[\\r\\n]', lambda m: f'%{ord(m.group()):02X}', value)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> Record:
    """The record that is all of ``data``; ArchiveError if its header or its length is not right."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ArchiveError("the header has no end")
    try:
        first, *lines = data[:end].decode().split("\r\n")
    except UnicodeDecodeError as e:
        raise ArchiveError("the header is not UTF-8") from e
    if first not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError(f"unknown version {first[:20]!r}")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not _TOKEN.match(name):
            raise ArchiveError(f"not a header field: {line[:40]!r}")
        if name.lower() in headers and name.lower() in _REQUIRED:
            raise ArchiveError(f"{name} is there twice")
        headers[name.lower()] = value.strip(" \t")
    for name in _REQUIRED:
        if name not in headers:
            raise ArchiveError(f"{name} is missing")
    if not re.fullmatch(r"[0-9]+", headers["content-length"]):
        raise ArchiveError("content-length is not a number")
    length = int(headers["content-length"])
    block, tail = data[end + 4 : end + 4 + length], data[end + 4 + length :]
    if len(block) != length or tail != b"\r\n\r\n":
        raise ArchiveError(f"content-length is {length}, but {len(data) - end - 8} bytes are there")
    return Record(headers, block)


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame ends that begins at ``at``: by its header and the sizes of its blocks."""
    if at + 6 > len(data):
        raise ArchiveError("a frame is cut off")
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    content = (1 if single else 0, 2, 4, 8)[flags >> 6]
    place = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + content
    while True:
        if place + 3 > len(data):
            raise ArchiveError("a frame is cut off")
        head = int.from_bytes(data[place : place + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3:
            raise ArchiveError("a block of an unknown kind")
        place += 3 + (1 if kind == 1 else size)
        if last:
            break
    place += 4 * checksum
    if place > len(data):
        raise ArchiveError("a frame is cut off")
    return place


def read_dictionary(data: memoryview) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame, if there is one, and where the records begin."""
    if bytes(data[:4]) != DICTIONARY_FRAME:
        return None, 0
    if len(data) < 8:
        raise ArchiveError("the dictionary frame is cut off")
    size = struct.unpack_from("<I", data, 4)[0]
    raw = bytes(data[8 : 8 + size])
    if len(raw) != size:
        raise ArchiveError("the dictionary frame is cut off")
    if raw[:4] == FRAME:
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return (zstandard.ZstdCompressionDict(raw) if raw else None), 8 + size


def read_archive(content: bytes) -> Iterator[Record]:
    """The records of one archive in order, each decoded from its own frame."""
    data = memoryview(content)
    dictionary, at = read_dictionary(data)
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        start = bytes(data[at : at + 4])
        if SKIPPABLE.match(start):
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        if start != FRAME:
            raise ArchiveError(f"no frame at byte {at}")
        end = _frame_end(data, at)
        try:
            record = decoder.decompressobj().decompress(bytes(data[at:end]))
        except zstandard.ZstdError as e:
            raise ArchiveError(f"the frame at byte {at} cannot be decoded: {e}") from e
        try:
            yield parse_record(record)
        except ArchiveError as e:
            raise ArchiveError(f"the record at byte {at}: {e}") from e
        at = end


def _train(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from the first records of an archive; None where they are too few to train on."""
    sample, held = [], 0
    for record in records:
        if held >= SAMPLE_BYTES:
            break
        sample.append(record[:100_000])
        held += len(sample[-1])
    if len(sample) < 8 or held < 10 * 1024:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, held // 8), sample, level=LEVEL)
    except zstandard.ZstdError:
        return None


def write_archive(records: list[bytes]) -> bytes:
    """One archive: the dictionary's frame, also if it is empty, and a frame per record."""
    dictionary = _train(records)
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes()) if dictionary else b""
    coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    return b"".join([DICTIONARY_FRAME, struct.pack("<I", len(packed)), packed, *map(coder.compress, records)])


def _page_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A response or, with the id of the page that holds its payload, a revisit."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{i}')}>"
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "text/html; charset=utf-8"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", name(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    return record_bytes(headers, payload if refers_to is None else b"")


def write_archives(pages: DataFrame, least_payload: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, content): archives with one record for each of ``pages`` (page_id, url, html).

    Of rows with equal payloads of at least ``least_payload`` bytes, that with
    the smallest page_id (null last) is the response and the others are
    revisits of it; among rows repeated with that id all are responses. A null
    html is an empty payload, a null url is left out. An archive holds about
    ``archive_bytes`` and at least one record. Extra columns are ignored; an
    empty table gives no archive.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # Payloads that occur once need no partner: only repeated ones go through the join, by their digest. The sums
    # are made before the shuffle, and adaptive execution broadcasts a small table or splits a hot digest.
    repeated = (
        rows.where(F.octet_length("payload") >= least_payload)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first_id is not null")
        .drop("n")
    )
    marked = rows.join(repeated, "digest", "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"),
        F.spark_partition_id().alias("part"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, made, part = [], 0, 0, 0

        def close() -> pa.RecordBatch:
            path = f"part-{part:05d}-{made:05d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([write_archive(waiting)], pa.binary())], ["path", "content"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to", "part")]
            for i in range(batch.num_rows):
                *values, part = (c[i].as_py() for c in columns)
                record = _page_record(*values)
                waiting.append(record)
                size += len(record)
                # Text shrinks to a third or less, so an archive stays below its size.
                if size >= 3 * archive_bytes:
                    yield close()
                    waiting, size, made = [], 0, made + 1
        if waiting:
            yield close()

    return marked.mapInArrow(write, "path string, content binary")


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the archive files below ``path``, in any store that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record of ``archives`` (path, content): path, number, type, record id, headers, block, its SHA-256.

    A damaged archive ends the job with an ArchiveError that names it and the
    place. A null or empty content has no records. Rows repeated with one path
    are read each.
    """
    schema = (
        "path string, number int, record_type string, record_id string, headers map<string,string>, block binary, block_sha256 string"
    )
    kinds = pa.schema(
        [
            ("path", pa.string()),
            ("number", pa.int32()),
            ("record_type", pa.string()),
            ("record_id", pa.string()),
            ("headers", pa.map_(pa.string(), pa.string())),
            ("block", pa.binary()),
            ("block_sha256", pa.string()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column("path")[i].as_py(), batch.column("content")[i].as_py()
                rows, size = [], 0
                try:
                    for number, record in enumerate(read_archive(content or b"")):
                        h = record.headers
                        rows.append((path, number, h["warc-type"], h["warc-record-id"], list(h.items()), record.block, hashlib.sha256(record.block).hexdigest()))
                        size += len(record.block)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)
                            rows, size = [], 0
                except ArchiveError as e:
                    raise ArchiveError(f"{path}: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds)

    return archives.select("path", "content").mapInArrow(read, schema)


def page_records(records: DataFrame) -> DataFrame:
    """Per record of a page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest and length are those of the block as read back; one
    that contradicts its header ends the job. A revisit has no block: its
    header says what the payload was.
    """
    header = lambda name: F.element_at("headers", name)
    told = F.regexp_replace(header("warc-payload-digest"), "^sha256:", "")
    response = F.col("record_type") == "response"
    same = (told == F.col("block_sha256")) & (header("x-payload-length").cast("long") == F.octet_length("block"))
    digest = F.when(
        response & ~same, F.raise_error(F.concat(F.lit("payload differs from its header: "), F.col("record_id")))
    ).otherwise(told)
    return records.select(
        header("x-page-id").cast("long").alias("page_id"),
        header("x-payload-length").cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"),
        "record_type",
        header("x-refers-to-page-id").cast("long").alias("refers_to"),
    )
