"""GeoPackage files as a Spark data source, read and written through sqlite3.

Reading: one partition a range of feature ids of a file; columns follow the
layer's table, geometry becomes WKB. SQLite needs files that executors can open,
so `path` is a folder or file that they share. Options: `layer` (a name, or its
number from 0), `columns` (names behind commas; others aren't read), `bbox`
(min x, min y, max x, max y: only features whose bounds meet it are read, by the
layer's R-tree where there is one), and `srid`, which overrides the stored one.
"""

from __future__ import annotations

import glob
import os
import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENVELOPE = (0, 32, 48, 48, 64)  # fixed values: bytes of the envelope by its kind
TYPES = {"INTEGER": T.LongType(), "INT": T.LongType(), "MEDIUMINT": T.LongType(), "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType(), "BOOLEAN": T.LongType(), "BLOB": T.BinaryType()}
STEP = 50_000


def wkb_of(blob: bytes | None) -> bytes | None:
    """The WKB of a GeoPackage blob."""
    if blob is None:
        return None
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    kind = blob[3] >> 1 & 7
    if kind >= len(ENVELOPE):
        raise ValueError("unknown envelope")
    return blob[8 + ENVELOPE[kind] :]


def blob_of(wkb: bytes, srid: int = 28992) -> bytes:
    return struct.pack("<2sBBi", b"GP", 0, 1, srid) + wkb


def wkb_column(blob: Column) -> Column:
    """wkb_of as column functions."""
    kind = F.conv(F.hex(F.substring(blob, 4, 1)), 16, 10).cast("int")
    size = F.element_at(F.array(*map(F.lit, ENVELOPE)), F.shiftright(kind, 1).bitwiseAND(7) + 1)
    return F.when(F.substring(blob, 1, 2) == F.lit(b"GP"), F.substr(blob, size + 9))


def files_of(path: str) -> list[str]:
    return sorted(glob.glob(os.path.join(path, "*.gpkg"))) if os.path.isdir(path) else [path]


def layer_of(db: sqlite3.Connection, layer: str | None) -> tuple[str, str, int]:
    """table, geometry column, srs of a layer; the first feature layer by default."""
    names = [r[0] for r in db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY rowid")]
    if layer not in names and (layer or "").isdigit() and int(layer) < len(names):
        layer = names[int(layer)]
    table = layer or (names[0] if names else None)
    if table not in names:
        raise ValueError(f"no feature layer {layer or ''}")
    column, srs = db.execute("SELECT column_name, srs_id FROM gpkg_geometry_columns WHERE table_name = ?", (table,)).fetchone()
    return table, column, srs


def wkb_bounds(wkb: bytes) -> tuple[float, float, float, float] | None:
    """min x, min y, max x, max y of a geometry of any type and dimension; None for an empty one."""
    xs: list[float] = []
    ys: list[float] = []

    def points(at: int, n: int, dims: int, order: str) -> int:
        flat = struct.unpack_from(f"{order}{n * dims}d", wkb, at)
        xs.extend(flat[::dims])
        ys.extend(flat[1::dims])
        return at + 8 * n * dims

    def walk(at: int) -> int:
        order = "<" if wkb[at] else ">"
        kind = struct.unpack_from(order + "I", wkb, at + 1)[0]
        at += 9 if kind & 0x20000000 else 5  # an embedded reference system
        dims = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000)
        kind &= 0xFFFF
        dims, kind = dims + (0, 1, 1, 2)[kind // 1000], kind % 1000
        if kind == 1:
            return points(at, 1, dims, order)
        n = struct.unpack_from(order + "I", wkb, at)[0]
        at += 4
        for _ in range(n if kind > 2 else 0):
            if kind == 3:
                at = points(at + 4, struct.unpack_from(order + "I", wkb, at)[0], dims, order)
            else:
                at = walk(at)
        return points(at, n, dims, order) if kind == 2 else at

    walk(0)
    xs, ys = [x for x in xs if x == x], [y for y in ys if y == y]
    return (min(xs), min(ys), max(xs), max(ys)) if xs and ys else None


def indexed(db: sqlite3.Connection, table: str, geometry: str) -> bool:
    return db.execute("SELECT count(*) FROM sqlite_master WHERE name = ?", (f"rtree_{table}_{geometry}",)).fetchone()[0] > 0


def extent(path: str, layer: str | None = None) -> tuple[float, float, float, float] | None:
    """Bounds of a layer over all files: from the R-trees, or the geometries where there is none."""
    found = []
    for file in files_of(path):
        with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as db:
            table, geometry, _ = layer_of(db, layer)
            if indexed(db, table, geometry):
                found.append(db.execute(f'SELECT min(minx), min(miny), max(maxx), max(maxy) FROM "rtree_{table}_{geometry}"').fetchone())
            else:
                found += [wkb_bounds(wkb_of(g)) for (g,) in db.execute(f'SELECT "{geometry}" FROM "{table}" WHERE "{geometry}" IS NOT NULL')]
    found = [b for b in found if b and b[0] is not None]
    return (min(b[0] for b in found), min(b[1] for b in found), max(b[2] for b in found), max(b[3] for b in found)) if found else None


class Rows(InputPartition):
    def __init__(self, file: str, low: int, high: int):
        super().__init__((file, low, high))
        self.file, self.low, self.high = file, low, high


class GpkgReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.layer, self.schema = options["path"], options.get("layer"), schema
        self.box = tuple(float(v) for v in options["bbox"].split(",")) if options.get("bbox") else None

    def partitions(self):
        out = []
        for file in files_of(self.path):
            with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as db:
                table = layer_of(db, self.layer)[0]
                low, high = db.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{table}"').fetchone()
                out += [Rows(file, a, min(a + STEP, high + 1)) for a in range(low, high + 1, STEP)]
        return out or [Rows("", 0, 0)]

    def read(self, partition) -> Iterator[tuple]:
        if not partition.file:
            return
        with sqlite3.connect(f"file:{partition.file}?mode=ro", uri=True) as db:
            table, geometry, _ = layer_of(db, self.layer)
            names = [f.name for f in self.schema.fields]
            columns = ", ".join('"' + n.replace('"', '""') + '"' for n in names)
            where, values = "rowid >= ? AND rowid < ?", [partition.low, partition.high]
            if self.box and indexed(db, table, geometry):
                where += f' AND rowid IN (SELECT id FROM "rtree_{table}_{geometry}" WHERE maxx >= ? AND maxy >= ? AND minx <= ? AND miny <= ?)'
                values += self.box
            for *row, blob in db.execute(f'SELECT {columns}, "{geometry}" FROM "{table}" WHERE {where}', values):
                if self.box:  # the R-tree rounds outwards
                    b = wkb_bounds(wkb_of(blob)) if blob is not None else None
                    if b is None or b[2] < self.box[0] or b[3] < self.box[1] or b[0] > self.box[2] or b[1] > self.box[3]:
                        continue
                yield tuple(wkb_of(v) if n == geometry else v for n, v in zip(names, row, strict=True))


class GeoPackage(DataSource):
    @classmethod
    def name(cls):
        return "gpkg"

    def schema(self):
        with sqlite3.connect(f"file:{files_of(self.options['path'])[0]}?mode=ro", uri=True) as db:
            table, geometry, srs = layer_of(db, self.options.get("layer"))
            fields, asked = [], [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
            srs = int(self.options.get("srid", srs))
            for _, name, kind, *_ in db.execute(f'PRAGMA table_info("{table}")'):
                t = T.BinaryType() if name == geometry else TYPES.get(kind.split("(")[0].upper(), T.StringType())
                fields.append(T.StructField(name, t, True, {"srid": srs} if name == geometry else {}))
            if missing := set(asked) - {f.name for f in fields}:
                raise ValueError(f"no columns {', '.join(sorted(missing))}")
            return T.StructType([f for f in fields if not asked or f.name in asked])

    def reader(self, schema):
        return GpkgReader(self.options, schema)


def write(df: DataFrame, folder: str, layer: str, geometry: str = "geom", srid: int = 28992) -> list[str]:
    """One file a partition, each with the layer's full metadata; a file has its name only when complete."""
    from pyspark import TaskContext

    kinds = {f.name: "BLOB" if f.name == geometry else {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL"}.get(f.dataType.simpleString(), "TEXT") for f in df.schema.fields}

    def rows(batches):
        import pandas as pd

        os.makedirs(folder, exist_ok=True)
        target = os.path.join(folder, f"{layer}-{TaskContext.get().partitionId():05d}.gpkg")
        part = f"{target}.{TaskContext.get().taskAttemptId()}.part"
        db = sqlite3.connect(part)
        create(db, layer, kinds, geometry, srid)
        names = list(kinds)
        quoted = ", ".join('"' + n + '"' for n in names)
        for pdf in batches:
            data = [tuple(blob_of(v, srid) if n == geometry and v is not None else None if v is None or v != v else v for n, v in zip(names, r, strict=True)) for r in pdf[names].astype(object).itertuples(index=False)]
            db.executemany(f'INSERT INTO "{layer}" ({quoted}) VALUES ({", ".join("?" * len(names))})', data)
        boxes = ((i, wkb_bounds(wkb_of(g))) for i, g in db.execute(f'SELECT rowid, "{geometry}" FROM "{layer}" WHERE "{geometry}" IS NOT NULL').fetchall())
        db.executemany(f'INSERT INTO "rtree_{layer}_{geometry}" VALUES (?, ?, ?, ?, ?)', [(i, b[0], b[2], b[1], b[3]) for i, b in boxes if b])
        ends = db.execute(f'SELECT min(minx), min(miny), max(maxx), max(maxy) FROM "rtree_{layer}_{geometry}"').fetchone()
        db.execute("UPDATE gpkg_contents SET min_x = ?, min_y = ?, max_x = ?, max_y = ?", ends)
        db.commit()
        db.close()
        os.replace(part, target)
        yield pd.DataFrame({"file": [target]})

    return [r["file"] for r in df.mapInPandas(rows, "file string").collect()]


def create(db: sqlite3.Connection, layer: str, kinds: dict[str, str], geometry: str, srid: int) -> None:
    """The format's application id ('GPKG') and its tables, and the layer's table and R-tree."""
    db.execute("PRAGMA application_id = 1196444487")
    db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT)")
    db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{srid}", srid, srid))
    db.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, description TEXT, last_change TEXT, min_x REAL, min_y REAL, max_x REAL, max_y REAL, srs_id INTEGER)")
    db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (layer, layer, srid))
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?, 'GEOMETRY', ?, 0, 0)", (layer, geometry, srid))
    columns = ", ".join(f'"{n}" {k}' for n, k in kinds.items())
    db.execute(f'CREATE TABLE "{layer}" (__fid INTEGER PRIMARY KEY, {columns})')
    db.execute(f'CREATE VIRTUAL TABLE "rtree_{layer}_{geometry}" USING rtree(id, minx, maxx, miny, maxy)')
    db.execute("CREATE TABLE gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL, scope TEXT NOT NULL)")
    db.execute("INSERT INTO gpkg_extensions VALUES (?, ?, 'gpkg_rtree_index', 'http://www.geopackage.org/spec120/#extension_rtree', 'write-only')", (layer, geometry))
