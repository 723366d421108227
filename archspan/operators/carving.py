"""Underpass solids: polygons extruded between floor and ceiling, matched to models, with an account of what is skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import once
from ..functions.geometry import st

BELOW, ABOVE = 0.1, 2.5  # fixed values: how far a solid reaches below the house, and a ceiling's height where none is known


def _points(coordinates: Column) -> Column:
    """Points of a closed ring given as x, y, x, y, ..., without the last one."""
    n = F.floor(F.size(coordinates) / 2).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(coordinates, 2 * i).alias("x"), F.get(coordinates, 2 * i + 1).alias("y")))


def _at(p: Column, z: Column) -> Column:
    return F.struct(p["x"].alias("x"), p["y"].alias("y"), z.alias("z"))


def extruded(df: DataFrame, geometry: str, floor: str, roof: str, ignore_holes: bool = False) -> DataFrame:
    """df with faces: triangles (arrays of struct(x, y, z)) of the closed solid over a polygon, facing outwards; empty where the polygon isn't valid or has no area."""
    g = st("build_area", st("exterior_ring", geometry)) if ignore_holes else F.col(geometry)
    own = df.columns
    fine = st("is_valid", geometry) & (st("area", geometry) > 0) & (F.col(floor) < F.col(roof))
    out = once(df, __g=F.when(F.coalesce(fine, F.lit(False)), st("orient", g)))
    rings = F.transform(F.concat(F.array(st("exterior_ring", "__g")), st("interior_rings", "__g")), lambda r: _points(st("coordinates", r)))
    level = F.transform(st("triangles", "__g"), lambda t: _points(st("coordinates", st("orient", t))))
    out = once(out, __rings=F.when(F.col("__g").isNotNull(), rings), __level=F.when(F.col("__g").isNotNull(), level))
    lo, hi = F.col(floor), F.col(roof)
    tops = F.transform("__level", lambda t: F.transform(t, lambda p: _at(p, hi)))
    bottoms = F.transform("__level", lambda t: F.transform(F.reverse(t), lambda p: _at(p, lo)))

    def sides(ring: Column) -> Column:
        pair = lambda a, b: F.array(F.array(_at(a, lo), _at(b, lo), _at(b, hi)), F.array(_at(a, lo), _at(b, hi), _at(a, hi)))
        return F.flatten(F.transform(ring, lambda a, i: pair(a, F.get(ring, (i + 1) % F.size(ring)))))

    faces = F.concat(tops, bottoms, F.flatten(F.transform("__rings", sides)))
    return once(out, faces=F.coalesce(faces, F.slice(F.array(F.array(_at(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.lit(0.0)))), 1, 0))).select(*own, "faces")


def volume(faces: Column) -> Column:
    """What a closed solid of outward triangles encloses, from their determinants about its first point, so that large coordinates cost no digits."""
    first = F.get(F.get(faces, F.lit(0)), F.lit(0))

    def det(t: Column) -> Column:
        a, b, c = ({k: F.get(t, F.lit(i))[k] - first[k] for k in "xyz"} for i in range(3))
        return a["x"] * (b["y"] * c["z"] - b["z"] * c["y"]) - a["y"] * (b["x"] * c["z"] - b["z"] * c["x"]) + a["z"] * (b["x"] * c["y"] - b["y"] * c["x"])

    return F.aggregate(faces, F.lit(0.0), lambda s, t: s + det(t)) / 6


def drop_axis(normal: Column) -> Column:
    """The axis (0, 1, 2) along which a face is flattened: that of its normal's greatest part, the first of equals."""
    x, y, z = (F.abs(normal[k]) for k in "xyz")
    return F.when((x >= y) & (x >= z), 0).when(y >= z, 1).otherwise(2)


def flattened(ring: Column, axis: Column) -> Column:
    """Points of a ring without one coordinate."""
    return F.transform(ring, lambda p: F.struct(F.when(axis == 0, p["y"]).otherwise(p["x"]).alias("x"), F.when(axis == 2, p["y"]).otherwise(p["z"]).alias("y")))


def signed_area(ring: Column) -> Column:
    """Of a flat ring; 0 for fewer than three points."""
    n = F.size(ring)
    at = lambda i: F.get(ring, i % n)
    term = lambda i: at(i)["x"] * at(i + 1)["y"] - at(i + 1)["x"] * at(i)["y"]
    return F.when(n < 3, 0.0).otherwise(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + term(i)) / 2)


def carve(houses: DataFrame, polygons: DataFrame, ignore_holes: bool = False) -> DataFrame:
    """A row for each polygon of a model: id, part, floor, roof, faces, skip_reason.

    houses: id, min_z (null or not finite where a model has no points); polygons: id, part, elevation, geom. The floor is
    below the house's lowest point, the roof the elevation, or above that point where there is none.
    """
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    m = polygons.select("id", "part", "geom", F.col("elevation").cast("double").alias("elevation")).join(houses.select("id", F.col("min_z").cast("double").alias("min_z")), "id")
    m = m.withColumn("floor", F.when(known("min_z"), F.col("min_z") - BELOW)).withColumn("roof", F.when(known("min_z"), F.when(known("elevation"), F.col("elevation")).otherwise(F.col("min_z") + ABOVE)))
    solids = extruded(m, "geom", "floor", "roof", ignore_holes)
    reason = F.when(F.col("floor").isNull(), "no house min z").when(F.size("faces") == 0, "empty mesh")
    return solids.withColumn("skip_reason", reason).select("id", "part", "floor", "roof", "faces", "skip_reason")


def account(carved: DataFrame, houses: DataFrame) -> DataFrame:
    """id, processed, skipped, underpass_z (of the last polygon that counts), success for each model; models without polygons pass through."""
    n = carved.groupBy("id").agg(
        F.count_if(F.col("skip_reason").isNull()).alias("processed"), F.count_if(F.col("skip_reason").isNotNull()).alias("skipped"), F.max_by("roof", F.when(F.col("skip_reason").isNull(), F.col("part"))).alias("underpass_z")
    )
    out = houses.select("id").join(n, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("processed", "skipped")})
    return out.withColumn("success", F.col("processed") > 0)
