"""WARC archives: one gzip member per record, read back sequentially.

Writing decides by payload digest which record is the response: of payloads of
at least ``MIN_REVISIT`` bytes that are equal, the smallest id's; the others
are revisits that refer to it.  Archives of about ``archive_bytes`` are binary
cells of a staged table, so they are written and read through Spark's own
file systems alone; ``export_archives`` makes files of them that other tools
open, and ``open_archives`` reads such files.

Reading feeds fixed-size chunks to an incremental zlib decompressor, frames
records by Content-Length, holds a member to exactly one record, and verifies
block digests, and payload digests of responses.

Defined results: null html is an empty payload (a response); a null id is the
largest: it revisits any equal payload that has an id, and is a response when
none has; rows that repeat the smallest id are all responses; a null url
leaves the target out; extra columns are not read; an empty table writes no
archive; a long page is one record.
"""

from __future__ import annotations

import hashlib
import io
import pathlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.staging import small_arrow_batches, staged

MIN_REVISIT = 100
CHUNK = 1 << 16
#: Records that one batch of the reader holds.
RECORDS = 256
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_WITH_ID, _WITHOUT_ID = 0x7175617272790001, 0x7175617272790000


def record_id(page_id: int | None) -> str:
    """A URN that carries the page id in its lower half."""
    high = _WITHOUT_ID if page_id is None else _WITH_ID
    return f"<urn:uuid:{uuid.UUID(int=(high << 64) | ((page_id or 0) & (1 << 64) - 1))}>"


def page_id_of(urn: str) -> int | None:
    value = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 64 == _WITHOUT_ID:
        return None
    low = value & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def _member(fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8") + block + b"\r\n\r\n") + packer.flush()


def info_record(level: int = 3) -> bytes:
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(int=1)}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level)


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 3) -> bytes:
    """A response with the payload, or a revisit with its HTTP head only."""
    revisit = refers_to is not None
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    fields += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _member(fields, http if revisit else http + payload, level)


def members(chunks: Iterable[bytes]) -> Iterator[bytearray]:
    """The decompressed bytes of each gzip member of a stream of chunks."""
    unpack, out = zlib.decompressobj(31), bytearray()
    begun = False
    for chunk in chunks:
        while chunk:
            out += unpack.decompress(chunk)
            begun = True
            if not unpack.eof:
                break
            yield out
            chunk, unpack, out, begun = unpack.unused_data, zlib.decompressobj(31), bytearray(), False
    if begun:
        raise ValueError("the archive ends inside a gzip member")


def parse_record(data: bytearray) -> tuple[dict[str, str], memoryview]:
    """(fields, block) of the one record of a member; framing and block digest are verified."""
    cut = data.find(b"\r\n\r\n")
    lines = data[: max(cut, 0)].decode("utf-8").split("\r\n")
    if cut < 0 or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    block = memoryview(data)[cut + 4 : cut + 4 + size]
    if len(block) != size or data[cut + 4 + size :] != b"\r\n\r\n":
        raise ValueError("content length and gzip member differ")
    if (said := fields.get("warc-block-digest")) and said != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("wrong block digest")
    return fields, block


def chunks_of(source: bytes | BinaryIO) -> Iterator[bytes]:
    """An archive's bytes, or an open file's, ``CHUNK`` at a time."""
    stream = io.BytesIO(source) if isinstance(source, bytes) else source
    return iter(lambda: stream.read(CHUNK), b"")


def read_archive(source: bytes | BinaryIO) -> Iterator[dict]:
    """The page records of an archive or open archive file, verified, in order; one record is held at a time."""
    for member in members(chunks_of(source)):
        fields, block = parse_record(member)
        kind = fields["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        head, _, payload = bytes(block).partition(b"\r\n\r\n")
        said = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
        size, digest = int(said[b"content-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError("wrong payload digest")
        yield {
            "page_id": page_id_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
            "refers_to": page_id_of(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "payload": payload if kind == "response" else None,
        }


def _archiver(archive_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not parts:
                    parts.append(info_record(level))
                    size = len(parts[0])
                parts.append(page_record(*row, level=level))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["archive"])
                    parts = []
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["archive"])

    return run


def _reader(with_payload: bool):
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    kinds |= {"payload": pa.binary()} if with_payload else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                records = read_archive(archive.as_py())
                while some := list(islice(records, RECORDS)):  # one archive's records a few at a time
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], t) for k, t in kinds.items()], names=list(kinds))

    return run


def write_archives(pages: DataFrame, archive_bytes: int = 1 << 20, level: int = 3) -> DataFrame:
    """A staged table of archives (column ``archive``) with a record for every row of ``pages``."""
    small_arrow_batches(pages.sparkSession)
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    lead = rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("lead"), F.count("*").alias("copies")).where("copies > 1 AND lead IS NOT NULL").select("digest", "lead")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("lead")), F.col("lead"))
    marked = rows.join(lead, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    return staged(marked.mapInArrow(_archiver(archive_bytes, level), "archive binary"), "warc")


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per response or revisit of the archives in column ``archive``."""
    small_arrow_batches(archives.sparkSession)
    tail = ", payload binary" if with_payload else ""
    return archives.select("archive").mapInArrow(_reader(with_payload), f"page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long{tail}")


def export_archives(archives: DataFrame, folder: str) -> None:
    """Write each archive as a ``.warc.gz`` file into a folder that all executors mount; other tools read these.

    A file is named by its content and put in place whole, so a task that runs
    twice leaves one file.
    """

    def write(rows: Iterator) -> None:
        target = pathlib.Path(folder.removeprefix("file://"))
        target.mkdir(parents=True, exist_ok=True)
        for row in rows:
            name = hashlib.sha256(row.archive).hexdigest()[:32]
            part = target / f".{name}.{uuid.uuid4().hex}"
            part.write_bytes(row.archive)
            part.replace(target / f"{name}.warc.gz")

    archives.select("archive").foreachPartition(write)


def open_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The ``.warc.gz`` files of a folder as a table of archives (column ``archive``)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.col("content").alias("archive"))
