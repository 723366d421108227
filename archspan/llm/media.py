"""Media columns: a Spark data source over archives of images.

write_archives() stores payloads as 8-bit greyscale PNG images, 64 samples a
row, in ZIP archives (stored members) in a shared folder, beside a manifest. The
data source "archive_media" plans byte ranges of the archives from the manifest,
reads each archive's directory, streams the members of a range as Arrow batches
of bounded size, and reads a member again by its own offset where a read fails
or a checksum doesn't hold; a file that fails is opened anew.

Cases: null text is empty text; a payload is padded with zero bytes up to a
positive multiple of 64; null ids are kept, and a text id may be any text;
repeated rows are members of their own; equal texts give equal values; an empty
table gives an empty result; columns other than doc_id and text are ignored.
Payloads are whole texts, however long; a member must fit in memory.
"""

from __future__ import annotations

import hashlib

import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import common

WIDTH = 64
ROLL_BYTES = 128 << 20  # an archive is closed beyond so many bytes,
ROLL_MEMBERS = 50_000  # or members: within the limits of a plain ZIP directory
RANGE_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
READ_AHEAD = 1 << 20
TRIES = 4
LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"  # fixed values of the ZIP format
MANIFEST = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("members", pa.int64())])
PNG = b"\x89PNG\r\n\x1a\n"  # fixed value of the PNG format


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Lossless 8-bit greyscale image, WIDTH samples a row; equal payloads, equal bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # a filter byte 0 leads each row
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that to_png() made; ValueError if its checksums or shape don't hold."""
    if image[:8] != PNG:
        raise ValueError("not a PNG")
    at, size, data = 8, None, []
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("checksum of a chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[0] != WIDTH or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale image of this width")
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], WIDTH + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation, sign changes about the mean, and the fullest of 16 bands, of the samples."""
    x = np.frombuffer(payload, np.uint8)
    mean = x.mean()
    above = x > mean
    bands = np.bincount(x >> 4, minlength=16)
    return f"mean={mean:.4f};std={x.std():.4f};crossings={int((above[1:] != above[:-1]).sum())};band={int(bands.argmax())}:{int(bands.max())}"


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


class _Archive:
    """A ZIP archive of stored members, written front to back; it has its final name only when complete."""

    def __init__(self, folder: str):
        self.fs, top = filesystem(folder)
        self.fs.create_dir(top, recursive=True)
        self.path = f"{top}/{uuid.uuid4().hex}.zip"
        self.out, self.at, self.directory = self.fs.open_output_stream(self.path + ".part"), 0, []

    def add(self, name: str, data: bytes) -> None:
        label = name.encode()
        fields = struct.pack("<HHHHHIIIHH", 20, 0x800, 0, 0, 33, zlib.crc32(data), len(data), len(data), len(label), 0)
        self.directory.append(CENTRAL + struct.pack("<H", 20) + fields + struct.pack("<HHHII", 0, 0, 0, 0, self.at) + label)
        head = LOCAL + fields + label
        self.out.write(head)
        self.out.write(data)
        self.at += len(head) + len(data)

    def close(self) -> tuple[str, int, int]:
        listing = b"".join(self.directory)
        self.out.write(listing + END + struct.pack("<HHHHIIH", 0, 0, len(self.directory), len(self.directory), len(listing), self.at, 0))
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return self.path, self.at, len(self.directory)


def write_archives(docs: DataFrame, folder: str) -> str:
    """Writes archives below folder, and beside them a manifest (path, bytes of members, members) of those of the tasks that succeeded; the folder."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, n = None, 0
        for pdf in batches:
            for doc, text in zip(pdf["id"], pdf["text"], strict=True):
                archive = archive or _Archive(f"{folder}/archives")
                payload, size = padded(text)
                archive.add(f"{n:08d}-{size}-{'null' if doc is None else 'id-' + doc}.png", to_png(payload))
                n += 1
                if archive.at >= ROLL_BYTES or len(archive.directory) >= ROLL_MEMBERS:
                    yield pd.DataFrame([archive.close()], columns=["path", "bytes", "members"])
                    archive = None
        if archive:
            yield pd.DataFrame([archive.close()], columns=["path", "bytes", "members"])

    out = docs.selectExpr("cast(doc_id as string) AS id", "text").mapInPandas(rows, "path string, bytes long, members long")
    out.write.parquet(f"{folder}/manifest")
    return folder


def directory(archive, size: int) -> list[tuple[int, int, int, str]]:
    """(offset, bytes, checksum, name) of the members, by the archive's own directory."""
    archive.seek(size - 22)
    end = archive.read(22)
    if end[:4] != END:
        raise zipfile.BadZipFile("no end of directory")
    n, length, at = struct.unpack_from("<HII", end, 10)
    archive.seek(at)
    listing, out, p = archive.read(length), [], 0
    for _ in range(n):
        crc, data, _, label, extra, note = struct.unpack_from("<IIIHHH", listing, p + 16)
        offset = struct.unpack_from("<I", listing, p + 42)[0]
        out.append((offset, data, crc, listing[p + 46 : p + 46 + label].decode()))
        p += 46 + label + extra + note
    return out


class Range(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        super().__init__((path, low, high))
        self.path, self.low, self.high = path, low, high


class MediaReader(DataSourceReader):
    """Members whose header lies in a byte range, each checked, and tried again by its offset. It holds the folder's name alone."""

    def __init__(self, options):
        self.folder, self.step = options["folder"], int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self):
        """Byte ranges from the manifest; each carries its own path."""
        from pyarrow import dataset

        store, top = filesystem(f"{self.folder}/manifest")
        listed = dataset.dataset(top, filesystem=store, format="parquet", ignore_prefixes=["_", "."], schema=MANIFEST)
        out = []
        for b in listed.to_batches(columns=["path", "bytes"]):
            for path, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out += [Range(path, low, low + self.step) for low in range(0, max(1, size), self.step)]
        return sorted(out, key=lambda r: (r.path, r.low)) or [Range("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        archive = File(self.folder, partition.path)
        try:
            members = [m for m in archive.listed() if partition.low <= m[0] < partition.high]
            rows, held = [], 0
            for offset, size, crc, name in members:
                rows.append((name, fetch(archive, offset, size, crc, 30 + len(name.encode()) + size)))
                held += size
                if held >= BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)
        finally:
            archive.close()


class File:
    """An archive's bytes, read ahead; after a failure it is opened anew."""

    def __init__(self, folder: str, path: str):
        self.store, self.path = filesystem(folder)[0], path
        self.file, self.ahead = None, (0, b"")

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.file, self.ahead = None, (0, b"")

    def bytes(self, offset: int, need: int) -> bytes:
        """need bytes from offset; OSError where they can't be read, after which nothing read ahead is trusted."""
        try:
            low, held = self.ahead
            if not (low <= offset and offset + need <= low + len(held)):
                self.file = self.file or self.store.open_input_file(self.path)
                self.file.seek(offset)
                self.ahead = low, held = offset, self.file.read(max(need, READ_AHEAD))
            return held[offset - low :][:need]
        except OSError:
            self.close()
            raise

    def listed(self) -> list[tuple[int, int, int, str]]:
        def once():
            self.file = self.file or self.store.open_input_file(self.path)
            return directory(self.file, self.file.size())

        return tried(once, self)


def tried(once, archive: File, tries: int = TRIES):
    """What once gives; on an OSError or a wrong checksum (ValueError) again, with the archive opened anew."""
    for k in range(tries):
        try:
            return once()
        except (OSError, ValueError, zipfile.BadZipFile) as e:
            archive.close()
            if k == tries - 1:
                raise OSError(f"{archive.path} can't be read") from e
            time.sleep(0.05 * 2**k)


def fetch(archive: File, offset: int, size: int, crc: int, need: int, tries: int = TRIES) -> bytes:
    """A member by its own offset, read until its checksum holds."""

    def once() -> bytes:
        image = archive.bytes(offset, need)[need - size :]
        if len(image) != size or zlib.crc32(image) != crc:
            raise ValueError("checksum of a member")
        return image

    return tried(once, archive, tries)


def batch(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
    names = [n.removesuffix(".png").split("-", 3) for n, _ in rows]
    return pa.record_batch(
        {
            "id": pa.array([x[3] if len(x) > 3 else None for x in names], pa.string()),
            "n_bytes": pa.array([int(x[1]) for x in names], pa.int64()),
            "media": pa.array([d for _, d in rows], pa.binary()),
        }
    )


class ArchiveMedia(DataSource):
    @classmethod
    def name(cls):
        return "archive_media"

    def schema(self):
        return "id string, n_bytes long, media binary"

    def reader(self, schema):
        return MediaReader(self.options)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """id, n_bytes, media of all members of the archives of a folder's manifest."""
    spark.dataSource.register(ArchiveMedia)
    return spark.read.format("archive_media").options(folder=folder).load()


def media_features(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Stores the texts as images, reads them back, and describes what was read.

    With a folder the archives stay there, for read_archives(); without, they are removed once they are described.
    """
    spark = docs.sparkSession
    where = folder or common.new_path(spark, "media")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for image in pdf["media"]:
                payload = from_png(image)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)))
            told = pd.DataFrame(out, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], index=pdf.index)
            yield pd.concat([pdf[["id", "n_bytes"]], told], axis=1)

    read = read_archives(spark, write_archives(docs, where))
    told = read.mapInPandas(
        rows,
        "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
    told = told.selectExpr(f"cast(id as {kind}) AS doc_id", "* except (id)")
    if folder is None:
        told = common.durable(told, "features")
        remove(where)
    return told


def remove(folder: str) -> None:
    store, top = filesystem(folder)
    store.delete_dir(top)


__all__ = ["media_features", "read_archives", "write_archives", "to_png", "from_png", "feature", "padded", "remove"]
