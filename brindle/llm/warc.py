"""WARC archives with a Zstandard dictionary.

A dictionary is trained on a bounded sample of the records.  Each archive
begins with a skippable frame that holds it (itself compressed); then every
record is a frame of its own, so one record can be read without the others.
Payloads that were archived before are recorded as revisits.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import materialize, workers_import_this

# Fixed values of the formats: the dictionary frame's magic number, the
# compressed frame's, and the profile of revisits by payload digest.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_NAME = "urn:x-page:"
READ = 1 << 17


@dataclass(frozen=True)
class Settings:
    #: Payloads shorter than this are never revisits.
    least: int = 100
    #: Records that the dictionary is trained on, at most, and their payloads' bytes, at most.
    samples: int = 600
    sample_bytes: int = 1 << 16
    dictionary: int = 110 << 10
    level: int = 3
    #: An archive is closed beyond this many bytes and the next begun.
    archive: int = 1 << 30
    date: str = "1970-01-01T00:00:00Z"


def record(key: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit if ``refers_to`` is set, which keeps the payload's size in its HTTP header."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD_NAME}{'' if key is None else key}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=chr(37) + '!#$&()*+,/:;=?@[]~' + chr(39))}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{RECORD_NAME}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    size = int(fields["content-length"])
    if not head.startswith(b"WARC/1.") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return fields, rest[:size]


def dictionary_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body


def train(samples: list[bytes], settings: Settings) -> bytes:
    """A dictionary; empty if there is too little to train on."""
    try:
        return zstandard.train_dictionary(settings.dictionary, samples, level=settings.level).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


class Writer:
    """Writes archives of a task; ``done`` has (archive, records, bytes)."""

    def __init__(self, root: str, name: str, dictionary: bytes, settings: Settings):
        self.fs, self.root = FileSystem.from_uri(root)
        self.fs.create_dir(self.root, recursive=True)
        self.name, self.dictionary, self.settings = name, dictionary, settings
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=settings.level, dict_data=known, write_content_size=True, write_checksum=True)
        self.done: list[tuple[str, int, int]] = []
        self.out = None

    def write(self, raw: bytes) -> None:
        if self.out is None:
            self.archive, self.records, self.size = f"{self.name}-{len(self.done):05d}.warc.zst", 0, 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.archive}")
            if self.dictionary:
                self._put(dictionary_frame(self.dictionary))
            self._put(self.compressor.compress(info_record(self.settings.date)))
        self._put(self.compressor.compress(raw))
        self.records += 1
        if self.size >= self.settings.archive:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.archive, self.records, self.size))
            self.out = None


def records(root: str, archive: str) -> Iterator[bytes]:
    """The records of an archive, in order; needs no index and holds one record at a time."""
    fs, base = FileSystem.from_uri(root)
    with fs.open_input_stream(f"{base}/{archive}") as f:
        start, known = f.read(8), None
        if len(start) == 8 and struct.unpack("<I", start[:4])[0] == DICTIONARY_MAGIC:
            body = f.read(struct.unpack("<I", start[4:])[0])
            known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(body) if body[:4] == FRAME_MAGIC else body)
            start = b""
        decompressor = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
        rest = start
        while rest or (rest := f.read(READ)):
            one, parts = decompressor.decompressobj(), []
            parts.append(one.decompress(rest))
            while not one.eof:
                if not (more := f.read(READ)):
                    raise ValueError(f"{archive} ends within a record")
                parts.append(one.decompress(more))
            rest = one.unused_data
            yield b"".join(parts)


def write(spark: SparkSession, pages: DataFrame, root: str, settings: Settings = Settings(), key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Archive every row; return the table of archives (archive, records, bytes).

    The payload is the text in UTF-8, a null one empty.  Of equal payloads of
    ``settings.least`` bytes or more, the row with the smallest key is a
    response and the others revisits of it; rows with null keys never are what
    others refer to.  An empty table gives no archives.  A task that runs again
    writes files of its own name: only those in the returned table count.
    """
    workers_import_this(spark)
    html = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), html.alias("payload"), F.octet_length(html).cast("long").alias("size"), F.sha2(html, 256).alias("digest"))
    long_enough = rows.where(F.col("size") >= settings.least)
    first = long_enough.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1).select("digest", "first")
    revisit = (F.col("key") != F.col("first")) | (F.col("key").isNull() & F.col("first").isNotNull())
    # payloads too short to be revisits have no group: each goes its own way; one long payload of very many rows is a join that Spark splits
    group = F.when(F.col("size") >= settings.least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("key", "url").cast("string")))
    judged = rows.withColumn("group", group).join(first.withColumnRenamed("digest", "group"), "group", "left").select("key", "url", "payload", "size", "digest", F.when(revisit, F.col("first")).alias("refers_to"))

    # a first cut by the hash, at four times the bound, so that no task sends more than it must
    place = F.xxhash64("digest", "key")
    near = place.bitwiseAND(0xFFFFFFFF) / float(1 << 32) * max(1, pages.count()) < 4.0 * settings.samples
    fit = rows.where(near & F.col("size").between(1, settings.sample_bytes)).select("key", "url", "payload", "size", "digest").orderBy(place.bitwiseAND(0xFFFFFFFF), "digest", "key").limit(settings.samples)
    samples = [record(r.key, r.url, r.payload.encode(), r["size"], r.digest, None, settings.date) for r in fit.collect()]  # bounded
    shared = spark.sparkContext.broadcast(train(samples, settings))

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(root, f"part-{uuid.uuid4().hex}", shared.value, settings)
        for batch in batches:
            for k, u, p, n, digest, refers in zip(*batch.columns, strict=True):
                body = b"" if refers.is_valid else p.as_buffer().to_pybytes()
                writer.write(record(k.as_py(), u.as_py(), body, n.as_py(), digest.as_py(), refers.as_py(), settings.date))
        writer.close()
        yield pa.RecordBatch.from_pylist([dict(zip(("archive", "records", "bytes"), d, strict=True)) for d in writer.done], pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return materialize(spark, judged.mapInArrow(archived, "archive string, records long, bytes long"), "archives")


def read(spark: SparkSession, archives: DataFrame, root: str) -> DataFrame:
    """Per page record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, archive.

    No archives give no rows; a record of a null key has a null page_id.  Size and digest of a response are those of the payload read, and must be
    what its headers say; those of a revisit are what its headers say.
    """
    workers_import_this(spark)
    named = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for raw in records(root, archive):
                    fields, block = parse(raw)
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    size, digest = int(http.rpartition(b"Content-Length: ")[2]), fields["warc-payload-digest"].partition(":")[2]
                    if kind == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError(f"{archive}: a payload differs from its digest")
                    rows.append((_key(fields["warc-record-id"]), size, digest, kind, _key(fields.get("warc-refers-to", "")), archive))
                    if len(rows) == 4096:
                        yield _batch(rows, named, kinds)
                        rows = []
                yield _batch(rows, named, kinds)

    n = max(1, archives.count())
    return archives.select("archive").repartition(n).mapInArrow(read_back, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string")


def _key(name: str) -> int | None:
    found = name.strip("<>").removeprefix(RECORD_NAME)
    return int(found) if found else None


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)
