"""Media columns: payloads as grayscale PNG images in archives, read back by a custom data source.

write_archives() stores every payload as 8-bit samples, 64 to a row, in ZIP archives of bounded size in the shared
folder. The data source plans byte ranges over the folder's archives from their sizes alone; a partition reads its
archive's central directory, takes the members that begin in its range, and streams them in Arrow batches. Each member
is read on its own, by its offset, checked against its CRC and read again if that fails.
"""

from __future__ import annotations

import binascii
import contextlib
import hashlib
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..scratch import Scratch

#: Samples in a row of an image; payloads are padded to a positive multiple of it.
ROW = 64
#: Bytes of an archive that one partition reads, and of members that one Arrow batch holds, about.
RANGE, BATCH = 16 << 20, 4 << 20
#: Bytes after which a task begins a new archive.
ARCHIVE = 64 << 20
#: Times that a member is read before its partition fails.
ATTEMPTS = 4
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % ROW or (0 if data else ROW))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes) -> bytes:
    """A grayscale image whose samples are the payload's bytes."""
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)  # each row begins with its filter type, 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The samples, by rows; only images as encode_png makes them."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, head, packed = 8, b"", []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a damaged PNG chunk")
        head, packed = (body, packed) if kind == b"IHDR" else (head, [*packed, body] if kind == b"IDAT" else packed)
        at += 12 + n
    width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", head)
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if (depth, colour) != (8, 0) or rows[:, 0].any():
        raise ValueError("not an unfiltered 8-bit grayscale image")
    return rows[:, 1:]


def features(samples: np.ndarray) -> str:
    """Rows, mean sample and a 64-bit average hash of the columns."""
    columns = samples.mean(0)
    return f"rows={len(samples)};mean={samples.mean():.3f};ahash={np.packbits(columns > columns.mean()).tobytes().hex()}"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a folder that Spark writes to, for Python workers; Spark's names of S3 are one to pyarrow."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def write_archives(docs: DataFrame, folder: str) -> DataFrame:
    """Writes archives of ARCHIVE bytes, about, and returns their names; doc_id and the unpadded size name a member.

    An archive's name is new for each attempt, and it counts only if the attempt's row does, so that lost
    executors leave no half archives in the result. Its size bounds its directory, which each range reads. Null texts
    are empty payloads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        rows = ((i, (text.as_py() or "").encode()) for batch in batches for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        row = next(rows, None)
        while row:
            name, k = f"{uuid.uuid4().hex}.zip", 0
            with fs.open_output_stream(f"{root}/{name}") as raw, zipfile.ZipFile(Unseekable(raw), "w", zipfile.ZIP_STORED) as archive:
                while row and raw.tell() < ARCHIVE:
                    i, data = row
                    archive.writestr(f"{k:09d}_{'' if i is None else i}_{len(data)}.png", encode_png(pad(data)))
                    k, row = k + 1, next(rows, None)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64())], names=["archive", "members"])

    return docs.select("doc_id", "text").mapInArrow(run, "archive string, members bigint")


class Unseekable:
    """What zipfile needs of a stream that can only be written on."""

    def __init__(self, raw):
        self.write, self.flush = raw.write, raw.flush


@dataclass
class Range(InputPartition):
    """The members of an archive that begin in [start, end)."""

    uri: str
    start: int
    end: int


class MediaArchives(DataSource):
    """spark.read.format("media_archives").option("archives", names, "\\n" between).load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "doc_id bigint, n_bytes bigint, media binary, attempts int"

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.names = options["path"].rstrip("/"), options.get("archives")

    def partitions(self) -> list[Range]:
        """One for each byte range of each archive, from the folder's listing; no directory is read here."""
        fs, root = filesystem(self.folder)
        wanted = None if self.names is None else set(self.names.split("\n"))
        infos = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        files = sorted((i.base_name, i.size) for i in infos if i.extension == "zip" and (wanted is None or i.base_name in wanted))
        return [Range(f"{self.folder}/{name}", a, a + RANGE) for name, size in files for a in range(0, size, RANGE)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        fs, path = filesystem(partition.uri)
        with fs.open_input_file(path) as raw, zipfile.ZipFile(raw) as archive:
            members = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.end]
        rows: list[tuple] = []
        held = 0
        with fs.open_input_file(path) as raw:
            for m in members:
                _, doc_id, n = m.filename.removesuffix(".png").split("_")
                data, attempts = read_member(raw, lambda: fs.open_input_file(path), m.header_offset, m.file_size, m.CRC)
                rows.append((int(doc_id) if doc_id else None, int(n), data, attempts))
                held += len(data)
                if held >= BATCH:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "media", "attempts"])


def read_member(raw, reopen: Callable, offset: int, size: int, crc: int) -> tuple[bytes, int]:
    """A stored member's bytes by its offset, and the attempts that it took; each but the first opens the archive anew."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            with contextlib.nullcontext(raw) if attempt == 1 else reopen() as file:
                head = file.read_at(30, offset)
                name, extra = struct.unpack("<HH", head[26:30])
                data = file.read_at(size, offset + 30 + name + extra)
            if len(data) == size and binascii.crc32(data) == crc:
                return data, attempt
            fault: Exception = ValueError(f"the member at {offset} has another checksum than its archive's directory says")
        except (OSError, struct.error) as e:
            fault = e
    raise fault


def read_archives(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    reader = spark.read.format("media_archives")
    return (reader if names is None else reader.option("archives", "\n".join(names))).load(folder)


def media_features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every row.

    All but doc_id and n_bytes come from the stored images, read back. Null texts are empty payloads (64 zero
    bytes); a null doc_id stays null; repeated rows are members each; an empty table gives an empty result;
    other columns of docs aren't read. doc_id is a long.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "media")
    folder = scratch.path("archives")
    written = scratch.save(write_archives(docs, folder), "written")
    names = [r["archive"] for r in written.select("archive").toLocalIterator()]  # one for each 64 MB, or each task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for value in b.column(2):
                media = value.as_py()
                samples = decode_png(media)
                payload = samples.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=NAMES)

    stored = read_archives(spark, folder, names)
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
