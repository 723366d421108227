"""Tiles and boxes: tile indexes, reads within bounds, and points stored by the cells of an octree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import st

BOX = ("min_x", "min_y", "max_x", "max_y")


def quoted(name: str) -> str:
    """An identifier for SQL; quotes in it are doubled."""
    return '"' + name.replace('"', '""') + '"'


def tile_index(layer: DataFrame, root: str, location: str = "location", geometry: str = "geom") -> DataFrame:
    """path, geom, bounds of each usable tile: relative locations are below root. Rows without location or geometry go; an index without usable rows is an error."""
    used = layer.where((F.coalesce(location, F.lit("")) != "") & F.col(geometry).isNotNull())
    if used.isEmpty():
        raise ValueError("no usable tile records")
    absolute = F.col(location).rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*:)")
    path = F.when(absolute, F.col(location)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(location, r"^(\./)+", "")))
    return used.select(path.alias("path"), F.col(geometry).alias("geom"), st("bounds", geometry).alias("bounds"))


def within(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose bounds columns meet box: plain comparisons, which a Parquet scan prunes row groups by."""
    a, b, c, d = (F.lit(float(v)) for v in box)
    return df.where((F.col("max_x") >= a) & (F.col("min_x") <= c) & (F.col("max_y") >= b) & (F.col("min_y") <= d))


def with_box(df: DataFrame, geometry: str = "geom") -> DataFrame:
    """df with bounds columns."""
    b = st("bounds", geometry)
    return df.select("*", F.explode(F.array(b)).alias("__b")).select(*df.columns, *[F.col("__b")[i].alias(n) for i, n in enumerate(BOX)])


def box_query(table: str, columns: list[str], geometry: str, box: tuple[float, float, float, float], srid: int = 28992) -> str:
    """The query by which a spatial database gives the asked columns of the features whose bounds meet box, for a JDBC read."""
    names = ", ".join(quoted(c) for c in columns)
    where = ", ".join(repr(float(v)) for v in box)
    of = ".".join(quoted(p) for p in table.split("."))
    return f"SELECT {names}, ST_AsBinary({quoted(geometry)}) AS {quoted(geometry)} FROM {of} WHERE {quoted(geometry)} && ST_MakeEnvelope({where}, {int(srid)})"


def polygon_features(layer: DataFrame, key: str, elevation: str | None, attributes: dict[str, str], geometry: str = "geom") -> DataFrame:
    """id, elevation (null stays null), has_elevation, the attributes in their types, part, geom: a row for each polygon of a feature."""
    up = F.col(elevation).cast("double") if elevation else F.lit(None).cast("double")
    typed = [F.expr(f"try_cast(`{n}` AS {t})").alias(n) for n, t in attributes.items()]
    known = up.isNotNull() & ~F.isnan(F.coalesce(up, F.lit(0.0))) & (F.abs(F.coalesce(up, F.lit(0.0))) < float("inf"))
    return layer.select(F.col(key).cast("string").alias("id"), up.alias("elevation"), known.alias("has_elevation"), *typed, F.posexplode(st("dump", st("polygon_parts", geometry))).alias("part", "geom"))


def one_by_id(df: DataFrame, key: str, value) -> DataFrame:
    """The row of an id, by a comparison that the scan is pruned by; one row, since an id is asked for."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def octree_cell(x: Column, y: Column, z: Column, cube: tuple[float, float, float, float], depth: Column) -> Column:
    """struct(cx, cy, cz) of the cell of a cube (min x, y, z and side) at a depth; the far sides belong to the last cells."""
    n = F.pow(F.lit(2.0), depth)
    at = lambda v, lo: F.least(F.floor((v - lo) / cube[3] * n), n - 1).cast("int")
    return F.struct(at(x, cube[0]).alias("cx"), at(y, cube[1]).alias("cy"), at(z, cube[2]).alias("cz"))


def by_octree(points: DataFrame, cube: tuple[float, float, float, float], depths: int, key: str) -> DataFrame:
    """points with depth, cx, cy, cz: a point is held at one depth, told by a hash of its key, so that each depth doubles the detail of the ones above in each direction."""
    share = F.pmod(F.xxhash64(key), F.lit(8**depths - 1))  # depth k holds 8^k of the shares
    ladder = F.lit(depths - 1)
    for k in range(depths - 2, -1, -1):
        ladder = F.when(share < (8 ** (k + 1) - 1) // 7, k).otherwise(ladder)
    out = points.withColumn("depth", ladder.cast("int"))
    return out.withColumn("__c", octree_cell(F.col("x"), F.col("y"), F.col("z"), cube, F.col("depth"))).select(*points.columns, "depth", "__c.*")


def cells_within(df: DataFrame, box: tuple[float, float, float, float], cube: tuple[float, float, float, float], most_depth: int) -> DataFrame:
    """Rows of cells down to most_depth whose bounds meet box: comparisons of partition columns alone, so other cells' files aren't opened."""
    side = cube[3] / F.pow(F.lit(2.0), F.col("depth"))
    x, y = cube[0] + F.col("cx") * side, cube[1] + F.col("cy") * side
    return df.where((F.col("depth") <= most_depth) & (x <= box[2]) & (x + side >= box[0]) & (y <= box[3]) & (y + side >= box[1]))


def write_octree(df: DataFrame, folder: str) -> None:
    """One folder a depth and cell; rows of a cell are brought together first."""
    df.repartition("depth", "cx", "cy", "cz").write.mode("overwrite").partitionBy("depth", "cx", "cy", "cz").parquet(folder)


def read_octree(spark: SparkSession, folder: str, box: tuple[float, float, float, float], cube: tuple[float, float, float, float], most_depth: int) -> DataFrame:
    return cells_within(spark.read.parquet(folder), box, cube, most_depth)


def spatial_order(df: DataFrame, bounds: str, key: str) -> DataFrame:
    """Rows sorted within partitions by the corner of their bounds, then key."""
    return df.sortWithinPartitions(F.col(bounds)[0], F.col(bounds)[1], key)
