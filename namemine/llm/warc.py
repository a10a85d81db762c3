"""WARC archives compressed with Zstandard (operator 7): writer and reader.

An archive is a ``.warc.zst`` file: a leading skippable frame (magic 0x184D2A5D) holds the
dictionary, itself compressed; each record is one Zstandard frame of its own, so records can be
read independently. The reader loads the dictionary, decodes frame after frame and checks each
record: version line, mandatory headers, declared against real lengths, closing line breaks and
the payload's SHA-1 against its header.

Tasks write their archives to a folder that all executors share and return a manifest row per
archive. The manifest is a table that the reader deals out, a few archives a task, so no list of
archives passes through the driver; only archives of the manifest are read, so what a lost or repeated
attempt leaves behind does no harm, and each must hold as many records as its row says.

Which payloads repeat is found on slim rows. Those that make up over a ``HOT``-th of all repeated rows
(fewer than ``HOT``) are told by a broadcast, and their rows are dealt evenly; the rows of others join by key.

Defined cases: a null html is an empty payload; a null url has no target header; a null page_id is
written as an empty identifier and read back as null; among equal payloads of at least
``min_bytes`` bytes the rows of the smallest page_id (all of them, if repeated) are responses and
the others revisits; if all page_ids of a payload are null, all are responses; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namemine.llm.shared import only, shared_path, stage_table

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: An archive is closed beyond so many compressed bytes; a reader holds one archive a task.
ARCHIVE_BYTES = 32 << 20
#: First records of an archive (by number and bytes) that its dictionary is trained on.
SAMPLE_RECORDS, SAMPLE_BYTES = 256, 4 << 20
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
STEP = 1 << 16
#: A payload with more than a 1000th of the repeated rows is frequent.
HOT = 1000
#: Most tasks that read archives.
READERS = 10_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the pages carry no date, and archives are to be reproducible
URN = "urn:x-page:"


class WarcError(ValueError):
    """A record or archive breaks the format."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header_value(text: str) -> str:
    return " ".join(text.splitlines()).strip()


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record; ``payload`` None makes a revisit of ``refers_to``."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response" if payload is not None else "revisit"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if payload is None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    else:
        block += payload
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info_record() -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-info:1>\r\nWARC-Date: {DATE}\r\n"
    return f"{head}Content-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]):
    """A dictionary trained on the samples; None where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return None


def encode_archives(records: Iterator[bytes], archive_bytes: int = ARCHIVE_BYTES) -> Iterator[tuple[int, Iterator[bytes]]]:
    """(number of records, parts) of each archive; an archive's parts are held until it is full."""
    import zstandard

    records = iter(records)
    more = True
    while more:
        sample, size = [], 0
        while more and len(sample) < SAMPLE_RECORDS and size < SAMPLE_BYTES:
            record = next(records, None)
            more = record is not None
            if more:
                sample.append(record)
                size += len(record)
        if not sample:
            return
        dictionary = _dictionary([s[:STEP] for s in sample])
        parts = []
        if dictionary is not None:
            inner = zstandard.ZstdCompressor().compress(dictionary.as_bytes())
            parts.append(struct.pack("<II", DICTIONARY_MAGIC, len(inner)) + inner)
        frame = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True).compress
        parts += [frame(_info_record()), *map(frame, sample)]
        count, total = len(sample), sum(map(len, parts))
        while more and total < archive_bytes:
            record = next(records, None)
            more = record is not None
            if more:
                parts.append(frame(record))
                total += len(parts[-1])
                count += 1
        yield count, iter(parts)


def decode_archive(data) -> Iterator[bytes]:
    """The records of an archive's bytes, one from each frame."""
    import zstandard

    view, at, dictionary = memoryview(data), 0, None
    while at < len(view):
        if len(view) - at < 8:
            raise WarcError("cut off inside a frame's head")
        magic, size = struct.unpack_from("<II", view, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if at + 8 + size > len(view):
                raise WarcError("cut off inside a skippable frame")
            if magic == DICTIONARY_MAGIC and at == 0:
                inner = bytes(view[8 : 8 + size])
                if inner[:4] == struct.pack("<I", FRAME_MAGIC):
                    inner = zstandard.ZstdDecompressor().decompress(inner)
                dictionary = zstandard.ZstdCompressionDict(inner)
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        frame = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        out = []
        while not frame.eof:
            if at >= len(view):
                raise WarcError("cut off inside a frame")
            step = view[at : at + STEP]
            try:
                out.append(frame.decompress(step))
            except zstandard.ZstdError as e:
                raise WarcError(f"bad frame: {e}") from None
            at += len(step)
        at -= len(frame.unused_data)
        yield b"".join(out)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block), validated."""
    end = record.find(b"\r\n\r\n")
    if not record.startswith(b"WARC/1.") or end < 0:
        raise WarcError(f"no WARC version line or no end of the headers: {record[:60]!r}")
    headers = {}
    for line in record[:end].decode("utf-8").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"bad header line {line!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no header {name}")
    if not headers["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    block = record[end + 4 : -4]
    if record[-4:] != b"\r\n\r\n" or len(block) != int(headers["content-length"]):
        raise WarcError(f"{len(block)} bytes in a block of Content-Length {headers['content-length']}")
    return headers, block


def _page_of(value: str) -> int | None:
    inner = value.strip("<>")
    if not inner.startswith(URN):
        raise WarcError(f"foreign identifier {value!r}")
    return int(inner[len(URN) :]) if len(inner) > len(URN) else None


def page_record(record: bytes) -> dict | None:
    """A page's row from its record; None for records that hold no page."""
    headers, block = parse_record(record)
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    end = block.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("no end of the HTTP headers")
    fields = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in block[:end].decode("latin-1").split("\r\n")[1:])}
    payload, declared = block[end + 4 :], int(fields["content-length"])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != declared or base32_sha1(payload) != digest):
        raise WarcError(f"payload of {headers['warc-record-id']} doesn't match its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in headers):
        raise WarcError(f"revisit {headers['warc-record-id']} with a payload or without a reference")
    return {
        "page_id": _page_of(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "payload_bytes": declared,
        "payload_digest": digest, "record_type": kind,
        "refers_to": _page_of(headers["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def _file_system(uri: str):
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def _write(batches: Iterator[pa.RecordBatch], folder: str, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    files, root = _file_system(folder)
    context = TaskContext.get()
    part = context.partitionId() if context else 0

    def records() -> Iterator[bytes]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page_id, url, payload, size, digest, first = (x.as_py() for x in row)
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                revisit = first is not None and page_id != first
                yield record_bytes(page_id, url, None if revisit else payload, size, digest, first)

    for i, (count, parts) in enumerate(encode_archives(records(), archive_bytes)):
        name = f"part-{part:05d}-{i:04d}-{uuid.uuid4().hex}.warc.zst"
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:  # else ".zst" compresses again
            for data in parts:
                out.write(data)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64())], ["path", "n_records"])


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); the manifest ``path, n_records`` of
    the archives."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    files, root = _file_system(folder)
    files.create_dir(root, recursive=True)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = (only(pages, page_id="long", url="string", html="string").withColumn("payload", payload).drop("html")
            .withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload")))
    repeated = (rows.where(F.col("size") >= min_bytes).groupBy("sha1", "size")
                .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    repeated = stage_table(repeated, "repeated")
    n_rows = repeated.agg(F.sum("n")).first()[0] or 0
    hot = repeated.where(F.col("n") * HOT > n_rows).select("sha1", "size", F.col("first").alias("hot_first"), F.lit(True).alias("hot"))
    rest = repeated.where(F.col("n") * HOT <= n_rows).select(F.col("sha1").alias("key"), "size", "first")
    spread = F.concat(F.lit("#"), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)))  # equals no digest
    told = (rows.join(F.broadcast(hot), ["sha1", "size"], "left").withColumn("key", F.when(F.col("hot"), spread).otherwise(F.col("sha1")))
            .join(rest.hint("merge"), ["key", "size"], "left")
            .select("page_id", "url", "payload", "size", "sha1", F.coalesce("hot_first", "first").alias("first")))
    return stage_table(told.mapInArrow(lambda it: _write(it, folder, archive_bytes), "path string, n_records long"), "manifest")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """``archives`` (path, n_records) -> a row per page: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to and, if asked for, the payload (null for a revisit). A broken record or
    archive raises ``WarcError``, and so does a number of records other than ``n_records`` (unless null)."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema += ", payload binary" if payloads else ""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]

        def table(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for path, n_records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, at = _file_system(path)
                with files.open_input_file(at) as source:
                    content = source.read_buffer()
                rows, size, count = [], 0, 0
                for record in decode_archive(content):
                    row = page_record(record)
                    if row is not None:
                        rows.append(row)
                        size += len(record)
                        count += 1
                    if len(rows) >= 5000 or payloads and size >= 8 << 20:
                        yield table(rows)
                        rows, size = [], 0
                if n_records is not None and count != n_records:
                    raise WarcError(f"{path} holds {count} records, not {n_records}")
                if rows:
                    yield table(rows)

    listed = only(archives, path="string", n_records="long")
    return listed.repartition(max(1, min(listed.count(), READERS)), "path").mapInArrow(run, schema)
