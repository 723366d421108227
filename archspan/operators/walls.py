"""Facades in oblique imagery: wall planes, visibility, projection, heights and their accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import planar
from ..functions.geometry import boxes_meet, st


def extruded(edges: DataFrame, z: DataFrame, key: str) -> DataFrame:
    """Edges (x1, y1, x2, y2) with the height range of their key, and wall area."""
    ends = z.groupBy(key).agg(F.min("z").alias("z0"), F.max("z").alias("z1"))
    length = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    return edges.join(ends, key).withColumn("wall_area", length * (F.col("z1") - F.col("z0")))


def visible(walls: DataFrame, cameras: DataFrame, reach: float, most_angle: float = 180.0) -> DataFrame:
    """Pairs of a wall and a camera within reach whose view meets the wall's normal at a negative dot product."""
    from .spatial import spatial_join

    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    w = walls.withColumn("mx", mx).withColumn("my", my).withColumn("l_bounds", F.array(mx, my, mx, my))
    c = cameras.withColumn("r_bounds", F.array(F.col("cx") - reach, F.col("cy") - reach, F.col("cx") + reach, F.col("cy") + reach))
    nx, ny = F.col("y2") - F.col("y1"), -(F.col("x2") - F.col("x1"))
    dot, angle = planar.facing(nx, ny, F.col("mx") - F.col("cx"), F.col("my") - F.col("cy"))
    pairs = spatial_join(w, c, 2 * reach).where((F.col("mx") != F.col("cx")) | (F.col("my") != F.col("cy")))
    return pairs.withColumn("dot", dot).withColumn("angle", angle).where((F.col("dot") < 0) & (F.col("angle") <= most_angle))


def pixel_height(row: Column, rows: Column, height: Column) -> Column:
    return height * (1 - row / rows)


def realistic(h: Column, facade: Column) -> Column:
    """h, or null where it reaches the facade's top or is too low to pass."""
    return F.when((h < facade - 0.2) & (h >= 2), h)


def assessment(rows: DataFrame, truth: str, methods: list[str]) -> DataFrame:
    """method, n, n_null, mae, rmse, mean relative error of each method, in one pass over stacked rows."""
    stacked = rows.select(F.col(truth).alias("t"), F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("v")) for m in methods])).alias("m")).select("t", "m.*")
    e = F.col("v") - F.col("t")
    return stacked.groupBy("method").agg(F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("n_null"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.try_divide(F.abs(e), F.col("t"))).alias("relative"))


def comparison(results: DataFrame, truth: DataFrame, images: DataFrame, size: float = 100.0) -> DataFrame:
    """underpass_id, surface_id, method, estimated, real: results that meet a true surface and lie within an image's footprint, once each.

    results: underpass_id, method, estimated, geom; truth: surface_id, real, geom; images: geom.
    """
    from .spatial import spatial_join

    r = results.select("underpass_id", "method", "estimated", F.col("geom").alias("l_geom"), st("bounds", "geom").alias("l_bounds"))
    t = truth.select("surface_id", "real", F.col("geom").alias("r_geom"), st("bounds", "geom").alias("r_bounds"))
    met = spatial_join(r, t, size, lambda _: st("intersects", "l_geom", "r_geom")).drop("r_geom", "r_bounds")
    i = images.select(F.col("geom").alias("r_geom"), st("bounds", "geom").alias("r_bounds"))
    seen = spatial_join(met.select("underpass_id", "l_geom", "l_bounds").dropDuplicates(["underpass_id"]), i, size, lambda _: st("within", "l_geom", "r_geom")).select("underpass_id").distinct()
    return met.join(seen, "underpass_id", "left_semi").select("underpass_id", "surface_id", "method", "estimated", "real").distinct()


def compared(pairs: DataFrame) -> DataFrame:
    """method, n, n_null, n_null_everywhere, mae, rmse, relative of comparison(): the nulls of a method are those that not all methods share."""
    null = F.col("estimated").isNull()
    everywhere = pairs.groupBy("underpass_id", "surface_id").agg(F.bool_and(null).alias("all_null"))
    e = F.abs(F.col("estimated") - F.col("real"))
    told = pairs.join(everywhere, ["underpass_id", "surface_id"])
    return told.groupBy("method").agg(F.count("*").alias("n"), F.count_if(null & ~F.col("all_null")).alias("n_null"), F.count_if("all_null").alias("n_null_everywhere"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.try_divide(e, F.col("real"))).alias("relative"))


def trimmed_mean(values: Column, share: float = 0.15) -> Column:
    """Mean without the given share at either end."""
    s = F.array_sort(values)
    k = F.floor(F.size(s) * share).cast("int")
    kept = F.slice(s, k + 1, F.size(s) - 2 * k)
    return F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)


def critical_edges(underpasses: DataFrame, buildings: DataFrame, tolerance: float, simplify: float, least: float, size: float = 100.0) -> DataFrame:
    """edge_id, underpass_id, building_id, x1, y1, x2, y2: edges of underpasses that meet a building at all, which lie within tolerance of their own building's boundary.

    underpasses: underpass_id, building_id, geom; buildings: building_id, geom. Outer rings are simplified first and edges
    shorter than least left out; ids run by underpass and place. An underpass counts once however many buildings it meets.
    """
    from .sequences import numbered
    from .spatial import spatial_join

    left = underpasses.select("underpass_id", "building_id", F.col("geom").alias("l_geom"), st("bounds", "geom").alias("l_bounds"))
    right = buildings.select(F.col("geom").alias("r_geom"), st("bounds", "geom").alias("r_bounds"))
    meets = spatial_join(left, right, size, lambda _: st("intersects", "l_geom", "r_geom")).select("underpass_id").distinct()
    own = buildings.select("building_id", st("buffer", st("boundary", "geom"), tolerance).alias("near"))
    rings = left.join(meets, "underpass_id", "left_semi").join(own, "building_id").select("underpass_id", "building_id", "near", st("coordinates", st("exterior_ring", st("simplify", "l_geom", simplify))).alias("c"))
    places = F.sequence(F.lit(0), F.floor(F.size("c") / 2).cast("int") - 2)
    e = rings.select("underpass_id", "building_id", "near", "c", F.explode(places).alias("seq"))
    e = e.select("underpass_id", "building_id", "near", "seq", *[F.get("c", 2 * F.col("seq") + k).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])
    e = e.where(F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2) >= least)
    line = st("line_of", F.array("x1", "y1", "x2", "y2"))
    kept = e.where(st("intersects", line, "near")).drop("near")
    return numbered(kept, ["underpass_id", "seq"], "edge_id").select("edge_id", "underpass_id", "building_id", "x1", "y1", "x2", "y2")


def critical_walls(edges: DataFrame, faces: DataFrame, tolerance: float, extend: float, size: float = 100.0) -> DataFrame:
    """edge_id, underpass_id, building_id, x1, y1, x2, y2, z0, z1, area: an upright wall on each edge, as high as the faces of its own building within tolerance of it.

    faces: building_id, geom (from above), z0, z1. Walls are made longer by extend at either end. Of two walls of which one
    lies along the other, the larger stays, or the one of the greater id.
    """
    from .relational import larger_containers

    f = faces.select("building_id", F.col("geom").alias("face"), st("bounds", "geom").alias("box"), F.col("z0").alias("f0"), F.col("z1").alias("f1"))
    near = st("buffer", st("line_of", F.array("x1", "y1", "x2", "y2")), tolerance)
    met = edges.withColumn("near", near).join(f, "building_id").where(boxes_meet(st("bounds", "near"), F.col("box")) & st("intersects", "near", "face"))
    w = met.groupBy("edge_id", "underpass_id", "building_id", "x1", "y1", "x2", "y2").agg(F.min("f0").alias("z0"), F.max("f1").alias("z1"))
    n = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    w = w.withColumn("n", n).where("n > 0").withColumn("ux", (F.col("x2") - F.col("x1")) / F.col("n") * extend).withColumn("uy", (F.col("y2") - F.col("y1")) / F.col("n") * extend)
    ends = {"x1": F.col("x1") - F.col("ux"), "y1": F.col("y1") - F.col("uy"), "x2": F.col("x2") + F.col("ux"), "y2": F.col("y2") + F.col("uy")}
    w = w.withColumns({**ends, "area": (F.col("n") + 2 * extend) * (F.col("z1") - F.col("z0"))}).drop("n", "ux", "uy")
    line = st("line_of", F.array("x1", "y1", "x2", "y2"))
    own = w.withColumn("bounds", F.array(F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2"))).withColumn("line", line).withColumn("every", F.lit(1))
    along = lambda a, b: st("covers", st("buffer", a, 1e-6), b)
    larger = (F.col("o_area") > F.col("i_area")) | ((F.col("o_area") == F.col("i_area")) & (F.col("o_edge_id") > F.col("i_edge_id")))
    inside = larger & (along(F.col("o_line"), F.col("i_line")) | along(F.col("i_line"), F.col("o_line")))
    return larger_containers(own, "edge_id", "every", "bounds", inside, size).select(w.columns)


def by_image(visible: DataFrame, cameras: DataFrame) -> DataFrame:
    """image_id, wall_ids in order, and the camera's place: an image's walls together."""
    place = cameras.select("image_id", "cx", "cy", "cz")
    return visible.groupBy("image_id").agg(F.sort_array(F.collect_list("wall_id")).alias("wall_ids")).join(place, "image_id")


def footprints_with_cameras(footprints: DataFrame, cameras: DataFrame) -> DataFrame:
    """Footprints with their camera's columns, null where the image has no camera."""
    return footprints.join(cameras, "image_id", "left")


IMAGE_SCALE, MOST_WIDE, MOST_HIGH = 4.0, 4096, 4096  # fixed values: by how much a facade may be larger than its image, and its greatest size


def facade_size(corners: Column, width: Column, height: Column) -> Column:
    """struct(width, height) in pixels of the upright image of a facade: the longer of either pair of opposite sides, within limits.

    corners: four struct(u, v), lower left, lower right, upper right, upper left; null where there aren't four finite ones, or
    where they span far more than the image.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    sound = (F.size(corners) == 4) & F.forall(corners, lambda p: finite(p["u"]) & finite(p["v"]))
    span = lambda k: F.array_max(F.transform(corners, lambda p: p[k])) - F.array_min(F.transform(corners, lambda p: p[k]))
    fits = (span("u") <= width * IMAGE_SCALE) & (span("v") <= height * IMAGE_SCALE)
    at = lambda i: F.get(corners, F.lit(i))
    side = lambda i, j: F.floor(F.sqrt((at(i)["u"] - at(j)["u"]) ** 2 + (at(i)["v"] - at(j)["v"]) ** 2)).cast("int")
    wide, high = F.greatest(side(2, 3), side(0, 1)), F.greatest(side(2, 1), side(3, 0))
    bounded = lambda v, most: F.greatest(F.lit(1), F.least(v, F.lit(most)))
    return F.when(F.coalesce(sound & fits, F.lit(False)), F.struct(bounded(wide, MOST_WIDE).alias("width"), bounded(high, MOST_HIGH).alias("height")))
