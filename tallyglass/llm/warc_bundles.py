"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own.  A bundle ends with a seek table in a
skippable frame (the public seekable format), so a reader finds every frame from the file's last bytes; the
index maps record ids to bundle, frame and the offset within the decompressed frame.  Every task writes
bundles of its own under new names; only those of finished tasks enter the index, so a task that is run
again leaves at most files that nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm.common import stored, utf8
from tallyglass.session import fresh_path

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 256 << 20
LEVEL = 3
REVISIT_BYTES = 1000
CAPTURED = "1970-01-01T00:00:00Z"

# Magic numbers of the seekable format, the revisit profile of WARC 1.1.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, page string, path string, frame int, frame_offset long, frame_bytes long, offset long, length long"
RECORD = "record_id string, page string, uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"

_CONTROL = re.compile(r"[\x00-\x20\x7f]")


# ---------------------------------------------------------------- records


def _header(name: str, value: str | None) -> bytes:
    return b"" if value is None else f"{name}: {value}\r\n".encode()


def record_bytes(record_id: str, page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit (``refers_to`` is a page) without."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    uri = "about:blank" if url is None else _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
    head = b"WARC/1.1\r\n" + b"".join(
        _header(*pair)
        for pair in (
            ("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", record_id),
            ("WARC-Date", CAPTURED),
            ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
            ("WARC-Profile", None if refers_to is None else REVISIT_PROFILE),
            ("X-Page", page),
            ("X-Refers-To-Page", refers_to),
            ("X-Payload-Length", str(len(payload))),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", str(len(body))),
        )
    )
    return head + b"\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` and the place behind it.  A payload that does not fit its digest is an error."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) for line in lines)
    body = end + 4
    after = body + int(head["Content-Length"])
    if data[after : after + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} is cut off")
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    payload = None
    if head["WARC-Type"] == "response":
        payload = data[data.index(b"\r\n\r\n", body) + 4 : after]
        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(head["X-Payload-Length"]):
            raise ValueError(f"record at {at} does not fit its digest")
    return {
        "record_id": head["WARC-Record-ID"], "page": head.get("X-Page"), "uri": head["WARC-Target-URI"], "record_type": head["WARC-Type"],
        "refers_to": head.get("X-Refers-To-Page"), "payload_bytes": int(head["X-Payload-Length"]), "payload_digest": digest, "payload": payload,
    }, after + 4


# ---------------------------------------------------------------- bundles


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the place in it.  Hadoop's names of the S3 store mean Arrow's; other stores
    have to be among those that Arrow knows (file, hdfs, s3, gs, abfs)."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))


class BundleWriter:
    """One file: frames as they fill, the seek table at the end."""

    def __init__(self, folder: str, frame_bytes: int = FRAME_BYTES):
        store, root = store_of(folder)
        name = f"{uuid.uuid4().hex}.warc.zst"
        store.create_dir(root, recursive=True)
        self.path, self.name, self.frame_bytes = f"{folder.rstrip('/')}/{name}", name, frame_bytes
        self.out = store.open_output_stream(f"{root}/{name}", compression=None)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.table: list[tuple[int, int]] = []
        self.size, self.count, self.held, self.pending, self.rows = 0, 0, 0, [], []

    def add(self, page, url, payload, digest, refers_to) -> None:
        record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.name}/{self.count}')}>"
        data = record_bytes(record_id, page, url, payload, digest, refers_to)
        self.count += 1
        self.rows.append([record_id, page, self.path, len(self.table), self.size, None, self.held, len(data)])
        self.pending.append(data)
        self.held += len(data)
        if self.held >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.pending:
            frame = self.packer.compress(b"".join(self.pending))
            self.out.write(frame)
            for row in reversed(self.rows):
                if row[5] is not None:
                    break
                row[5] = len(frame)
            self.table.append((len(frame), self.held))
            self.size, self.held, self.pending = self.size + len(frame), 0, []

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *entry) for entry in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.out.close()


def frames_of(source, size: int) -> list[tuple[int, int, int]]:
    """Offset, compressed and decompressed size of every frame, from the seek table of an open file."""
    source.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC or flags & 0x7F:
        raise ValueError("no seek table")
    width = 12 if flags else 8
    source.seek(size - 9 - count * width)
    table = source.read(count * width)
    out, at = [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", table, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_INDEX_ARROW = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[t]) for n, t in (c.split() for c in INDEX.split(", "))])
_RECORD_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in RECORD.split(", "))])


def with_revisits(pages: DataFrame, least_bytes: int = REVISIT_BYTES, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``page, url, payload, digest, refers_to`` of every row.  Of equal payloads of at least ``least_bytes`` the one with
    the largest id stays (every row of that id, if it repeats); rows without an id defer to it."""
    rows = pages.select(F.col(id_column).alias("page"), F.col(url_column).alias("url"), utf8(html_column).alias("payload"))
    digest = F.sha1("payload")
    groups = rows.where(F.length("payload") >= least_bytes).groupBy(digest.alias("d")).agg(F.max("page").alias("last"), F.count("*").alias("n"))
    # Written first: Spark then knows its size, and payloads move only if it is too large to broadcast.
    groups = stored(groups.where("n > 1 AND last IS NOT NULL").select("d", "last"), "revisits")
    rows = rows.withColumn("digest", digest).join(groups, F.col("digest") == F.col("d"), "left")
    refers = F.when(F.col("last").isNotNull() & ~F.coalesce(F.col("page") >= F.col("last"), F.lit(False)), F.col("last"))
    return rows.select(F.col("page").cast("string").alias("page"), "url", "payload", "digest", refers.cast("string").alias("refers_to"))


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes bundles below ``folder`` (any store that Arrow's file systems reach) and returns their index, stored
    beside them.  Takes the columns of ``with_revisits``.  An empty table writes no bundle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle = bundle or BundleWriter(folder, frame_bytes)
                bundle.add(*row)
                if bundle.size >= bundle_bytes:
                    bundle.close()
                    yield _batch(bundle.rows, _INDEX_ARROW)
                    bundle = None
        if bundle:
            bundle.close()
            yield _batch(bundle.rows, _INDEX_ARROW)

    path = f"{folder.rstrip('/')}/index"
    records.select("page", "url", "payload", "digest", "refers_to").mapInArrow(work, INDEX).write.parquet(path)
    return records.sparkSession.read.schema(INDEX).parquet(path)


def seek_tables(bundles: DataFrame) -> DataFrame:
    """``path, frame_offset, frame_bytes`` of every frame of the bundles ``path``, from the ends of the files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = store_of(path)
                with store.open_input_file(place) as source:
                    found = frames_of(source, source.size())
                columns = [pa.array([path] * len(found), pa.string()), *(pa.array([f[i] for f in found], pa.int64()) for i in (0, 1))]
                yield pa.record_batch(columns, names=["path", "frame_offset", "frame_bytes"])

    return bundles.select("path").distinct().mapInArrow(work, "path string, frame_offset long, frame_bytes long")


def read_bundles(index: DataFrame) -> DataFrame:
    """All records of the bundles that an index names, read frame by frame by their seek tables.

    A row of work is a frame, not a bundle, and frames are dealt to a number of tasks that does not shrink because a
    frame's name has few bytes: the tasks of the session, or one for each frame if there are fewer."""
    spark = index.sparkSession
    frames = stored(seek_tables(index), "frames")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for path, at, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, place = store_of(path)
                with store.open_input_file(place) as source:
                    source.seek(at)
                    data = unpack.decompress(source.read(packed))
                rows, offset = [], 0
                while offset < len(data):
                    record, offset = parse_record(data, offset)
                    rows.append([record[f.name] for f in _RECORD_ARROW])
                yield _batch(rows, _RECORD_ARROW)

    return frames.repartition(max(1, min(frames.count(), tasks)), "path", "frame_offset").mapInArrow(work, RECORD)


def fetch(index: DataFrame) -> DataFrame:
    """Only the records of the index rows given: each frame that holds one is read and unpacked once per batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            frames: dict[tuple, bytes] = {}
            for path, at, packed, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (path, at) not in frames:
                    store, place = store_of(path)
                    with store.open_input_file(place) as source:
                        source.seek(at)
                        frames = {(path, at): unpack.decompress(source.read(packed))}
                record, _ = parse_record(frames[path, at], offset)
                yield _batch([[record[f.name] for f in _RECORD_ARROW]], _RECORD_ARROW)

    wanted = index.select("path", "frame_offset", "frame_bytes", "offset").sortWithinPartitions("path", "frame_offset", "offset")
    return wanted.mapInArrow(work, RECORD)


def archive(pages: DataFrame, id_column: str = "page_id", **named) -> DataFrame:
    """Archives all rows and reads the archives back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    NULL html is an empty payload.  Repeated rows are a record each; other columns are ignored; an empty
    table gives an empty result."""
    spark: SparkSession = pages.sparkSession
    index = write_bundles(with_revisits(pages, id_column=id_column, **named), fresh_path(spark, "bundles"))
    kind = pages.schema[id_column].dataType
    return read_bundles(index).select(
        F.col("page").cast(kind).alias(id_column), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
