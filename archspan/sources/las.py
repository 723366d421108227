"""Uncompressed LAS point clouds as a Spark data source: ranges of points a partition, Arrow batches.

Option `columns`: `all` (the default), `xyz`, or names behind commas; other fields
of a record aren't decoded, and no arrays are made of them.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

STEP = 1_000_000
BATCH = 65_536


FIELDS = {"x": "double", "y": "double", "z": "double", "intensity": "int", "classification": "int", "tile": "string"}


class Header(NamedTuple):
    version: tuple[int, int]
    format: int
    offset: int
    record: int
    count: int
    scale: tuple[float, float, float]
    move: tuple[float, float, float]
    crs: str  # the text or the keys of the reference system, as they are stored; empty where there is none


def header(path: str) -> Header:
    with open(path, "rb") as f:
        raw = f.read(375)
        if raw[:4] != b"LASF":
            raise ValueError("not a LAS file")
        crs = reference_system(f, raw)
    version = (raw[24], raw[25])
    offset = struct.unpack_from("<I", raw, 96)[0]
    fmt, record, count = struct.unpack_from("<BHI", raw, 104)
    if fmt & 0x80:
        raise ValueError("compressed points can't be read here; store them as Parquet")
    if version >= (1, 4) and not count:
        count = struct.unpack_from("<Q", raw, 247)[0]
    scale, move = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
    return Header(version, fmt, offset, record, count, scale, move, crs)


def reference_system(f, raw: bytes) -> str:
    """The well-known text, or else the geographic keys, among a file's variable records."""
    size, n = struct.unpack_from("<H", raw, 94)[0], struct.unpack_from("<I", raw, 100)[0]
    f.seek(size)
    found = {}
    for _ in range(n):
        head = f.read(54)
        if len(head) < 54:
            break
        user, kind, length = head[2:18].rstrip(b"\0"), *struct.unpack_from("<HH", head, 18)
        body = f.read(length)
        if user == b"LASF_Projection":
            found[kind] = body
    if 2112 in found:  # fixed values: the records of well-known text, and of geographic keys
        return found[2112].rstrip(b"\0").decode("utf-8", "replace")
    return found[34735].hex() if 34735 in found else ""


def asked_columns(option: str | None) -> list[str]:
    """The columns that an option asks for, in the reader's order."""
    names = {"all": list(FIELDS), "xyz": ["x", "y", "z"]}.get(option or "all") or [c.strip() for c in option.split(",")]
    if unknown := set(names) - set(FIELDS):
        raise ValueError(f"no columns {', '.join(sorted(unknown))}")
    return [c for c in FIELDS if c in names]


def files_of(path: str) -> list[str]:
    return sorted(glob.glob(os.path.join(path, "*.las"))) if os.path.isdir(path) else [path]


class Points(InputPartition):
    def __init__(self, file: str, low: int, high: int):
        super().__init__((file, low, high))
        self.file, self.low, self.high = file, low, high


class LasReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.columns = options["path"], asked_columns(options.get("columns"))

    def partitions(self):
        out = []
        for file in files_of(self.path):
            n = header(file).count
            out += [Points(file, a, min(a + STEP, n)) for a in range(0, n, STEP)]
        return out or [Points("", 0, 0)]

    def read(self, p):
        if not p.file:
            return
        h = header(p.file)
        places = {"x": ("<i4", 0), "y": ("<i4", 4), "z": ("<i4", 8), "intensity": ("<u2", 12), "classification": ("u1", 15 if h.format < 6 else 16)}  # fixed values of the format
        used = [c for c in self.columns if c in places]
        kind = np.dtype({"names": used, "formats": [places[c][0] for c in used], "offsets": [places[c][1] for c in used], "itemsize": h.record})
        for low in range(p.low, p.high, BATCH):
            n = min(BATCH, p.high - low)
            r = np.fromfile(p.file, kind, n, offset=h.offset + low * h.record)
            out = {}
            for c in self.columns:
                if c == "tile":
                    out[c] = pa.array([os.path.basename(p.file)] * n)
                else:
                    out[c] = r[c] * h.scale["xyz".index(c)] + h.move["xyz".index(c)] if c in "xyz" else r[c].astype(np.int32)
            yield pa.record_batch(out)


class Las(DataSource):
    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return ", ".join(f"{c} {FIELDS[c]}" for c in asked_columns(self.options.get("columns")))

    def reader(self, schema):
        return LasReader(self.options, schema)


def check_compatible(paths: list[str]) -> None:
    """Raises unless all files have one version, point format and reference system."""
    kinds = {(h.version, h.format, h.crs) for h in map(header, paths)}
    if len(kinds) > 1:
        raise ValueError(f"files differ: {sorted(kinds)}")


def write(path: str, x: np.ndarray, y: np.ndarray, z: np.ndarray, scale: float = 0.001, crs: str = "") -> None:
    """A small LAS 1.2 file of format 0; it has its name only when complete."""
    h = bytearray(227)
    text = crs.encode() + b"\0" if crs else b""
    record = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(text), b"") + text if crs else b""
    h[:4], h[24], h[25] = b"LASF", 1, 2
    struct.pack_into("<H", h, 94, 227)
    struct.pack_into("<II", h, 96, 227 + len(record), 1 if crs else 0)
    struct.pack_into("<BHI", h, 104, 0, 20, len(x))
    struct.pack_into("<3d", h, 131, scale, scale, scale)
    struct.pack_into("<6d", h, 179, *(v for a in (x, y, z) for v in ((a.max(), a.min()) if len(a) else (0, 0))))
    r = np.zeros(len(x), np.dtype({"names": ["X", "Y", "Z"], "formats": ["<i4"] * 3, "offsets": [0, 4, 8], "itemsize": 20}))
    for n, a in zip("XYZ", (x, y, z), strict=True):
        r[n] = np.rint(np.asarray(a) / scale)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(bytes(h) + record + r.tobytes())
    os.replace(part, path)


def write_by_key(points: DataFrame, key: str, folder: str) -> None:
    """Points as Parquet by key: the committer makes each file whole or absent."""
    points.repartition(key).withColumn("__k", F.col(key)).drop(key).withColumnRenamed("__k", key).write.mode("overwrite").partitionBy(key).parquet(folder)


def write_files_by_key(points: DataFrame, key: str, folder: str, scale: float = 0.001) -> DataFrame:
    """key, file, n: a LAS file for each key, in a folder that executors share. A file has its name only when complete, so a task that is run again replaces it whole."""
    import pandas as pd

    def one(pdf):
        os.makedirs(folder, exist_ok=True)
        k = pdf[key].iloc[0]
        path = os.path.join(folder, re.sub(r"[^A-Za-z0-9._-]+", "_", str(k)).strip("._") + ".las")
        write(path, *(pdf[c].to_numpy(float) for c in "xyz"), scale)
        return pd.DataFrame({key: [k], "file": [path], "n": [len(pdf)]})

    return points.select(key, "x", "y", "z").groupBy(key).applyInPandas(one, f"{key} {points.schema[key].dataType.simpleString()}, file string, n long")
