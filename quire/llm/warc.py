"""WARC archives with a Zstandard dictionary in a leading skippable frame, one frame per record."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import fresh_name, one_file_a_task, read_bytes, save, write_bytes
from quire.session import scratch_path

# Fixed values of the format: skippable frame that holds a dictionary, and record fields.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
LEVEL = 3

_FILES = "file string, records long, raw_bytes long, stored_bytes long, dictionary_bytes long"
_RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str, date: str) -> bytes:
    """One WARC record. A revisit has no block; its payload's length is kept in an extension field."""
    named = "null" if page_id is None else str(page_id)
    fields = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{named}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        fields.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        fields += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    block = b"" if revisit else payload
    fields.append(f"Content-Length: {len(block)}")
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields["block"] = rest[: int(fields["Content-Length"])]
    return fields


#: Bytes of an archive that are decompressed at once.
PIECE_BYTES = 4096


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES, sample: int = SAMPLE_BYTES) -> bytes:
    """Trained on records spread evenly over the file, `sample` bytes of them at most; a raw one where too little is there to train on."""
    step = max(1, -(-sum(map(len, records)) // sample))
    chosen = records[::step]
    try:
        return zstandard.train_dictionary(size, chosen, k=256, d=8, f=20, split_point=1.0, accel=4, level=LEVEL, threads=0, steps=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(chosen)[:size]


def archive(records: list[bytes]) -> tuple[list[bytes], int]:
    """The parts of one file, and the size of its dictionary."""
    words = dictionary(records)
    shared = zstandard.ZstdCompressionDict(words)
    if len(words) > 8:
        shared.precompute_compress(level=LEVEL)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
    return [struct.pack("<II", DICTIONARY_FRAME, len(words)), words, *[packer.compress(r) for r in records]], len(words)


def unpack(data: bytes) -> Iterator[bytes]:
    """The records of one file, in order."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame at the start of the archive")
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    view, at = memoryview(data), 8 + size
    while at < len(view):
        # a frame is fed a piece at a time, so what it leaves unused is never more than a piece
        frame, parts = opener.decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise ValueError("the archive ends inside a record")
            piece = view[at : at + PIECE_BYTES]
            parts.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def plan_records(pages: DataFrame, smallest: int = 100) -> DataFrame:
    """Adds payload, payload_bytes, payload_digest, record_type and refers_to.

    Equal payloads of at least `smallest` bytes share one response, that of the
    smallest page_id (null ids never). Rows that repeat that id are responses
    too. Only digests go through the grouping (counted before the shuffle), and
    only those of two rows or more are joined back.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    groups = rows.where(F.col("payload_bytes") >= smallest).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = save(groups.where("n > 1 and first is not null").select(F.col("payload_digest").alias("_digest"), "first"), "payloads")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(shared, F.col("payload_digest") == F.col("_digest"), "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the planned records; returns the manifest (file, records, raw_bytes, stored_bytes, dictionary_bytes).

    A task closes a file when its records reach `file_bytes`, so it holds no
    more than one file. Names are unique to each attempt and only files in the
    manifest count, so what a lost task left behind is never read.
    """

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            parts, words = archive(held)
            name = fresh_name(folder, ".warc.zst")
            write_bytes(name, parts)
            values = [name, len(held), size, sum(map(len, parts)), words]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["file", "records", "raw_bytes", "stored_bytes", "dictionary_bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, _, digest, kind, first = [batch.column(c)[i].as_py() for c in range(7)]
                held.append(record(page, url, payload, first, kind == "revisit", digest, date))
                size += len(held[-1])
                if size >= file_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return save(records.mapInArrow(files, _FILES), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the files named in the manifest; payload null for a revisit. Digests are taken from the bytes read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [part.split()[0] for part in _RECORDS.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out = []
                for data in unpack(read_bytes(name)):
                    r = parse(data)
                    page = r["WARC-Record-ID"][10:-1]
                    revisit = r["WARC-Type"] == "revisit"
                    digest = r["WARC-Payload-Digest"][7:] if revisit else hashlib.sha256(r["block"]).hexdigest()
                    length = int(r["X-Payload-Length"]) if revisit else len(r["block"])
                    out.append((
                        None if page == "null" else int(page), r.get("WARC-Target-URI"), None if revisit else r["block"], length, digest,
                        r["WARC-Type"], int(r["WARC-Refers-To"][10:-1]) if revisit else None,
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)

    return one_file_a_task(manifest.select("file")).mapInArrow(rows, _RECORDS)


def archive_pages(pages: DataFrame, smallest: int = 100) -> DataFrame:
    """Writes all pages to archives below the shared folder and reads them back.

    Null html is an empty payload, null urls are left out of the record, extra
    columns are ignored, an empty table writes no file and gives no row.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(plan_records(pages, smallest), folder))
