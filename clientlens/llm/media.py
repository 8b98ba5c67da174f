"""Media columns: texts stored as lossless images in archives, and a data source
that reads such archives by byte ranges."""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from clientlens.llm import files
from clientlens.llm.common import shared_dir

ROW = 192  # bytes of a pixel row: 64 pixels of 3 samples
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, TRIES = 32 << 20, 8 << 20, 4 << 20, 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format
SCHEMA = "archive string, member string, offset bigint, length bigint, media binary, error string"


def encode_png(payload: bytes) -> bytes:
    """An 8-bit RGB image, 64 pixels wide, whose samples are ``payload``."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    data = zlib.compress(np.pad(rows, ((0, 0), (1, 0))).tobytes(), 3)  # filter 0 before each row

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", data) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """Samples of an image as :func:`encode_png` stores them; checks every chunk."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, height = 8, [], None
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
            if (width, depth, colour) != (ROW // 3, 8, 2):
                raise ValueError("not an 8-bit RGB image of 64 columns")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(-1, ROW + 1)
    if len(rows) != height or rows[:, 0].any():
        raise ValueError("rows are filtered or missing")
    return rows[:, 1:].tobytes()


def image_feature(payload: bytes) -> str:
    """Mean of each colour, and a 64-bit map of the columns lighter than average."""
    px = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW // 3, 3)
    total = px.sum(axis=0, dtype=np.int64)  # exact, so the same everywhere
    mean = total.sum(axis=0) / (len(px) * ROW // 3)
    light = total.sum(axis=1)
    bits = int.from_bytes(np.packbits(light * len(light) > light.sum()).tobytes(), "big")
    return f"{mean[0]:.4f},{mean[1]:.4f},{mean[2]:.4f};{bits:016x}"


def write_archives(docs: DataFrame, folder: str) -> DataFrame:
    """Store every text of ``docs`` as an image in zip archives under ``folder``;
    (archive, members, bytes) of each.  A retried task writes the same names."""

    def write(batches):
        from pyspark import TaskContext

        part, count, buf, members = TaskContext.get().partitionId(), 0, io.BytesIO(), 0
        z = zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED)

        def closed():
            z.close()
            uri = f"{folder}/part-{part:06d}-{count:05d}.zip"
            files.write_whole(uri, buf.getvalue())
            return pa.RecordBatch.from_pydict({"archive": [uri], "members": [members], "bytes": [buf.tell()]})

        for b in batches:
            raw = b.column("text").cast(pa.binary())
            for doc_id, text in zip(b.column("doc_id").to_pylist(), raw, strict=True):
                t = text.as_py() or b""
                size = max(1, -(-len(t) // ROW)) * ROW
                name = f"{'null' if doc_id is None else doc_id}.{members}.{len(t)}.png"
                z.writestr(zipfile.ZipInfo(name), encode_png(t.ljust(size)))
                members += 1
                if buf.tell() >= ARCHIVE_BYTES:
                    yield closed()
                    count, members, buf = count + 1, 0, io.BytesIO()
                    z = zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED)
        if members:
            yield closed()

    d = docs.select(F.col("doc_id").cast("bigint"), "text")
    return d.mapInArrow(write, "archive string, members bigint, bytes bigint")


class ByteRange(InputPartition):
    def __init__(self, archive: str, lo: int, hi: int):
        self.archive, self.lo, self.hi = archive, lo, hi


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.step = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self):
        """Byte ranges over the archives, from names and sizes alone."""
        out = [
            ByteRange(uri, lo, min(lo + self.step, size))
            for uri, size in files.listed(self.folder, ".zip")
            for lo in range(0, size, self.step)
        ]
        return out or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange):
        """Batches of the members whose entry starts in the range.

        The archive's directory gives offsets; members are read one by one, and a
        member that fails its checksum or its read is tried again by itself from
        its offset on a new handle.  One that fails ``TRIES`` times is returned
        with an error and no media, and the others go on.
        """
        if not part.archive:
            return
        system, path = files.open_fs(part.archive)
        handle = system.open_input_file(path)
        with zipfile.ZipFile(handle) as z:
            members = [i for i in z.infolist() if part.lo <= i.header_offset < part.hi]
        handle = system.open_input_file(path)
        rows, held = [], 0
        for i in sorted(members, key=lambda i: i.header_offset):
            media, error = None, None
            for attempt in range(TRIES):
                try:
                    handle.seek(i.header_offset)
                    head = handle.read(30)
                    name, extra = struct.unpack_from("<HH", head, 26)
                    handle.seek(i.header_offset + 30 + name + extra)
                    media = handle.read(i.compress_size)
                    if zlib.crc32(media) != i.CRC:
                        raise OSError("checksum differs")
                    error = None
                    break
                except (OSError, struct.error) as e:
                    media, error = None, f"{type(e).__name__}: {e}"
                    time.sleep(0.1 * attempt)
                    handle = system.open_input_file(path)
            rows.append((part.archive, i.filename, i.header_offset, i.compress_size, media, error))
            held += i.compress_size
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("media", pa.binary()), ("error", pa.string())])


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``: a row per member."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").load(folder)


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Texts of ``docs`` stored as images, read back, decoded and described.

    Defined cases: null and empty texts are 192 spaces; a null doc_id comes back
    null; repeated rows are members of their own; an empty table gives no rows;
    other columns are ignored; a member that cannot be read fails the query here
    (:func:`read_archives` returns it with its error instead).
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "media")
    write_archives(docs, folder).agg(F.sum("members")).collect()

    def describe(batches):
        for b in batches:
            rows = []
            for member, media, error in zip(*(b.column(c).to_pylist() for c in ("member", "media", "error")), strict=True):
                if error:
                    raise OSError(f"{member}: {error}")
                doc, _, size, _ = member.split(".")
                p = decode_png(media)
                rows.append((
                    None if doc == "null" else int(doc), int(size), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]),
                    len(media), hashlib.sha256(media).hexdigest(), image_feature(p),
                ))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    return read_archives(spark, folder).select("member", "media", "error").mapInArrow(describe, OUT)


OUT = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
_NAMES = [c.split()[0] for c in OUT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def op4(spark, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
