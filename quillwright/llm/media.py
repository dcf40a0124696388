"""Operator 8 — media columns: archives of PNG members behind a Spark data source of their own.

* ``store`` turns each payload into a lossless 8-bit greyscale PNG, 192 samples a row, and writes the members of a task
  into one uncompressed ZIP archive (its members are compressed already) in the shared folder; archive names follow the
  partition and are put in place by a rename, so a repeated task replaces its own archive with equal content;
* ``ArchiveSource`` (format ``media_archive``) plans byte ranges over the archives of a folder from file sizes alone: the
  driver never reads a central directory. A task reads its archive's central directory, takes the members whose local
  header starts in its range, and streams them as Arrow batches bounded in bytes;
* a member is read by its offset, checked, and tried again on its own a few times; one that stays unreadable gives a
  row with ``error`` set and no payload, and its neighbours go on.

Defined results: null or empty text — one row of 192 spaces, ``n_bytes`` 0; null ``doc_id`` — kept as null; repeated rows —
one member each; equal texts — equal stored bytes, for nothing but the text goes into a member; an empty table — an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import filesystem, new_folder

WIDTH = 192
_PNG = b"\x89PNG\r\n\x1a\n"
MEMBER_SCHEMA = "doc_id bigint, member string, offset bigint, n_bytes bigint, media binary, payload binary, feature string, error string"


# ---------------------------------------------------------------- PNG, 8-bit greyscale


def pad(data: bytes, width: int = WIDTH) -> bytes:
    """``data`` with spaces up to a positive multiple of ``width``."""
    return data.ljust(max(1, -(-len(data) // width)) * width, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(data: bytes, level: int = 1) -> bytes:
    """Lossless PNG of ``data``, padded; the unpadded length is in a text chunk."""
    samples = np.frombuffer(pad(data), np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(samples), WIDTH + 1), np.uint8)  # filter type 0 before each line
    lines[:, 1:] = samples
    head = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0" + str(len(data)).encode()) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[bytes, int]:
    """Samples and unpadded length of a PNG that ``encode_png`` wrote; raises ValueError on any damage."""
    if media[:8] != _PNG:
        raise ValueError("no PNG signature")
    at, body, length, shape = 8, [], None, None
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack(">II", data[:8])
        elif kind == b"tEXt" and data.startswith(b"Length\0"):
            length = int(data[7:])
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    if shape is None:
        raise ValueError("no header chunk")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a line filter other than 0")
    payload = lines[:, 1:].tobytes()
    return payload, len(payload) if length is None else length


def feature(payload: bytes) -> str:
    """Mean, standard deviation, least and largest sample, and a 16-bin histogram in parts of 1000."""
    x = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, values = x.sum(), np.arange(256)
    mean = float(x @ values) / n
    dev = max(0.0, float(x @ (values * values)) / n - mean * mean) ** 0.5
    seen = np.flatnonzero(x)
    bins = x.reshape(16, 16).sum(axis=1) * 1000 // n
    return f"mean={mean:.4f};std={dev:.4f};min={seen[0]};max={seen[-1]};hist=" + ",".join(map(str, bins.tolist()))


# ---------------------------------------------------------------- ZIP, uncompressed members, sizes of 64 bits


class ArchiveWriter:
    """Appends stored members to a stream and ends it with a central directory; always with ZIP64 records."""

    def __init__(self, out) -> None:
        self.out, self.at, self.entries = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> int:
        raw, offset, crc = name.encode(), self.at, zlib.crc32(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0x800, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.entries.append((raw, offset, crc, len(data)))
        return offset

    def close(self) -> None:
        start = self.at
        for raw, offset, crc, size in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0x800, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + raw + extra)
        size, n, end = self.at - start, len(self.entries), self.at
        self._put(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self._put(struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


def directory(file, size: int) -> Iterator[tuple[str, int, int, int]]:
    """(name, offset of the local header, CRC-32, size) of an archive's members, from its central directory."""
    file.seek(size - 98)
    tail = file.read(98)
    if tail[:4] != b"PK\6\6":
        raise ValueError("no ZIP64 end record: not an archive of this writer")
    n, _, length, start = struct.unpack_from("<QQQQ", tail, 24)
    file.seek(start)
    data, at = file.read(length), 0
    for _ in range(n):
        crc, raw, extra = struct.unpack_from("<I8xHH", data, at + 16)
        name = data[at + 46 : at + 46 + raw].decode()
        member, _, offset = struct.unpack_from("<QQQ", data, at + 46 + raw + 4)
        yield name, offset, crc, member
        at += 46 + raw + extra


def read_member(file, offset: int, crc: int, size: int) -> bytes:
    """A member's bytes by the offset of its local header, checked against the directory's CRC-32."""
    file.seek(offset)
    head = file.read(30)
    if head[:4] != b"PK\3\4":
        raise ValueError("no local header at the offset")
    raw, extra = struct.unpack_from("<HH", head, 26)
    file.seek(offset + 30 + raw + extra)
    data = file.read(size)
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError("member's checksum")
    return data


# ---------------------------------------------------------------- writing and reading in Spark


def store(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id") -> None:
    """Write every row's payload into the archives of ``folder``; one archive for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        fs, at = filesystem(folder)
        final = f"{at}/part-{part:06d}.zip"
        temp = f"{at}/_{part:06d}-{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(temp) as out:
            archive = ArchiveWriter(out)
            for batch in batches:
                keys, texts = batch.column(0), batch.column(1).cast(pa.binary())
                for i in range(batch.num_rows):
                    k = keys[i].as_py()
                    archive.add(f"{n:08d}/{'' if k is None else k}.png", encode_png(texts[i].as_py() or b""))
                    n += 1
            archive.close()
        fs.move(temp, final) if n else fs.delete_file(temp)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64())], names=["part", "members"])

    docs.select(F.col(key).cast("bigint"), text).mapInArrow(run, "part int, members bigint").agg(F.sum("members")).collect()


class ByteRange(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int) -> None:
        self.path, self.size, self.start, self.end = path, size, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.range = int(options.get("rangebytes", 16 << 20))
        self.batch = int(options.get("batchbytes", 8 << 20))
        self.tries = int(options.get("tries", 3))

    def partitions(self) -> list[ByteRange]:
        fs, at = filesystem(self.folder)
        files = fs.get_file_info(pafs.FileSelector(at))
        files = sorted((f.path, f.size) for f in files if f.is_file and f.base_name.endswith(".zip") and f.base_name[0] != "_")
        return [ByteRange(p, n, lo, min(n, lo + self.range)) for p, n in files for lo in range(0, n, self.range)] or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = filesystem(self.folder)
        held, size = [], 0
        with fs.open_input_file(partition.path) as file:
            for name, offset, crc, n in directory(file, partition.size):
                if not partition.start <= offset < partition.end:
                    continue
                held.append((name, offset, *self.member(fs, partition.path, file, offset, crc, n)))
                size += sum(len(x) for x in held[-1][2:4] if x is not None)  # media and payload
                if size >= self.batch:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)

    def member(self, fs, path: str, file, offset: int, crc: int, n: int, read: Callable = read_member) -> tuple:
        """(media, payload, n_bytes, error) of one member; each further try opens the archive anew."""
        error = ""
        for k in range(self.tries):
            try:
                if k:
                    time.sleep(0.1 * 2**k)
                    with fs.open_input_file(path) as again:
                        media = read(again, offset, crc, n)
                else:
                    media = read(file, offset, crc, n)
                return media, *decode_png(media), None
            except (OSError, ValueError, struct.error, zlib.error) as e:
                error = f"{type(e).__name__}: {e}"
        return None, None, None, error


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names, offsets, media, payloads, lengths, errors = zip(*rows, strict=True)
    keys = [n.split("/", 1)[1][:-4] for n in names]
    return pa.RecordBatch.from_arrays(
        [pa.array([int(k) if k else None for k in keys], pa.int64()), pa.array(names), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(media, pa.binary()), pa.array(payloads, pa.binary()), pa.array([None if p is None else feature(p) for p in payloads], pa.string()), pa.array(errors, pa.string())],
        names=["doc_id", "member", "offset", "n_bytes", "media", "payload", "feature", "error"],
    )


class ArchiveSource(DataSource):
    """Options: ``path``, ``rangeBytes`` (a partition's bytes), ``batchBytes``, ``tries`` (of each member)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def media_column(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Store the texts as media and read them back, as ``MEMBER_SCHEMA``."""
    spark = docs.sparkSession
    folder = new_folder(spark, "media")
    store(docs, folder, text, key)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").option("path", folder).load()


def op8_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = media_column(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    tail = F.expr("substring(payload, octet_length(payload) - 15, 16)")
    return members.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "error",
    )
