"""Queries of points, polygons, rasters and heights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import heights, sequences, spatial
from .registry import query
from .synth import oracle, table

_IN = """inside AS (SELECT p.point_id, e.pid, p.z FROM point p JOIN edge e ON floor(p.x / 40) = floor((e.pid % 100)) AND floor(p.y / 40) = floor(e.pid / 100e0)
GROUP BY p.point_id, e.pid, p.z, p.x, p.y HAVING sum(CASE WHEN (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (CASE WHEN e.y2 = e.y1 THEN 1 ELSE e.y2 - e.y1 END) + e.x1 THEN 1 ELSE 0 END) % 2 = 1)"""


def _polygons(spark, d):
    return spatial.ring_edges(table(spark, d, "edge"), "pid")


def _inside(spark, d, prepared=True):
    p = table(spark, d, "point").drop("pid")
    return spatial.points_in_polygons(p, _polygons(spark, d), 8.0, prepared)


@query(oracle(f"WITH {_IN} SELECT point_id, pid FROM inside"))
def j14_points_in_polygons(spark, d):
    return _inside(spark, d).select("point_id", "pid")


@query(oracle(f"WITH {_IN} SELECT pid, count(*) AS n, max(z) AS top FROM inside GROUP BY pid"))
def d15_crossing_number(spark, d):
    return _inside(spark, d, False).groupBy("pid").agg(F.count("*").alias("n"), F.max("z").alias("top"))


@query(oracle(f"WITH {_IN} SELECT pid, count(*) AS n, count(*) > 20 AS exceeded FROM inside GROUP BY pid"))
def r_1_capped_counts(spark, d):
    return spatial.capped(_inside(spark, d), "pid", 20)


@query(oracle("""SELECT p.point_id, f.pid FROM point p JOIN footprint f ON floor(p.x / 40) = floor(f.x0 / 40) AND floor(p.y / 40) = floor(f.y0 / 40)
AND p.x >= f.x0 AND p.x < f.x0 + f.w AND p.y >= f.y0 AND p.y < f.y0 + f.h
WHERE NOT (p.x > f.x0 + 2 AND p.x < f.x0 + 5 AND p.y > f.y0 + 2 AND p.y < f.y0 + 5)"""))
def d19_shell_minus_holes(spark, d):
    """Rectangles with a square hole: parity over all rings."""
    f = table(spark, d, "footprint")

    def ring(a, b, c, e):
        pts = [(a, b), (c, b), (c, e), (a, e)]
        return [F.struct(p[0].alias("x1"), p[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2")) for p, q in zip(pts, pts[1:] + pts[:1], strict=True)]

    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    poly = f.select("pid", F.array(*ring(x, y, x + w, y + h), *ring(x + 2, y + 2, x + 5, y + 5)).alias("edges"), F.array(x, y, x + w, y + h).alias("bounds"))
    return spatial.points_in_polygons(table(spark, d, "point").drop("pid"), poly, 8.0).select("point_id", "pid")


@query(oracle("""SELECT DISTINCT f.pid FROM footprint f JOIN road r ON r.subtype = 'road' AND r.class IN ('primary', 'residential', 'service')
AND r.xa <= f.x0 + f.w AND r.xb >= f.x0 AND r.y <= f.y0 + f.h AND r.y >= f.y0"""))
def d7_car_accessible(spark, d):
    """The buildings that a road of a class for cars meets: a spatial semi join."""
    f = table(spark, d, "footprint").select("pid", F.expr("array(x0, y0, x0 + w, y0 + h) AS l_bounds"))
    r = table(spark, d, "road").where(F.col("class").isin("primary", "residential", "service") & (F.col("subtype") == "road"))
    return spatial.spatial_join(f, r.select("road_id", F.expr("array(xa, y, xb, y) AS r_bounds")), 40.0, how="left_semi").select("pid")


@query(oracle("""SELECT a.pid AS a, b.pid AS b FROM footprint a JOIN footprint b ON a.pid < b.pid AND a.x0 - 15 <= b.x0 + b.w + 15 AND b.x0 - 15 <= a.x0 + a.w + 15
AND a.y0 - 15 <= b.y0 + b.h + 15 AND b.y0 - 15 <= a.y0 + a.h + 15"""))
def j10_spatial_join(spark, d):
    box = "array(x0 - 15, y0 - 15, x0 + w + 15, y0 + h + 15)"
    f = table(spark, d, "footprint")
    out = spatial.spatial_join(f.select(F.col("pid").alias("a"), F.expr(f"{box} AS l_bounds")), f.select(F.col("pid").alias("b"), F.expr(f"{box} AS r_bounds")), 80.0)
    return out.where("a < b").select("a", "b")


@query(oracle("""SELECT a.pid AS a, b.pid AS b FROM footprint a JOIN footprint b ON a.pid < b.pid AND a.pid % 3 = b.pid % 3 AND a.x0 - 30 <= b.x0 + b.w + 30 AND b.x0 - 30 <= a.x0 + a.w + 30
AND a.y0 - 30 <= b.y0 + b.h + 30 AND b.y0 - 30 <= a.y0 + a.h + 30"""))
def j11_spatial_with_equality(spark, d):
    """Pairs whose widened bounds meet and that are of one owner: the owner is part of the cell's key."""
    f = table(spark, d, "footprint").select("pid", (F.col("pid") % 3).alias("owner"), F.expr("array(x0 - 30, y0 - 30, x0 + w + 30, y0 + h + 30) AS bounds"))
    left, right = (f.select(F.col("pid").alias(n), "owner", F.col("bounds").alias(b)) for n, b in (("a", "l_bounds"), ("b", "r_bounds")))
    return spatial.spatial_join(left, right, 100.0, on=["owner"]).where("a < b").select("a", "b")


@query(oracle("""SELECT f.pid, CAST(floor(f.x0 / 400) * 1000 + floor(f.y0 / 400) AS BIGINT) AS tile FROM footprint f"""))
def j13_polygon_tiles(spark, d):
    f = table(spark, d, "footprint").select("pid", F.expr("array(x0, y0, x0 + w, y0 + h) AS l_bounds"))
    tiles = table(spark, d, "footprint").selectExpr("floor(x0 / 400) AS tx", "floor(y0 / 400) AS ty").distinct()
    tiles = tiles.select((F.col("tx") * 1000 + F.col("ty")).alias("tile"), F.expr("array(tx * 400d, ty * 400d, tx * 400d + 399.9, ty * 400d + 399.9) AS r_bounds"))
    return spatial.with_tiles(f, tiles, 400.0).select("pid", "tile")


@query(oracle("SELECT tile, list_sort(list(pid))[1] AS first_pid, count(*) AS n FROM (SELECT pid, CAST(floor(x0 / 400) * 1000 + floor(y0 / 400) AS BIGINT) AS tile FROM footprint) GROUP BY tile"))
def j15_inverted_tiles(spark, d):
    return j13_polygon_tiles(spark, d).groupBy("tile").agg(F.min("pid").alias("first_pid"), F.count("*").alias("n"))


@query(oracle("SELECT pid, CAST(floor(x0 / 400) AS BIGINT) AS cx, CAST(floor(y0 / 400) AS BIGINT) AS cy, (row_number() OVER (PARTITION BY floor(x0 / 400), floor(y0 / 400) ORDER BY pid) - 1) // 8 AS part FROM footprint"))
def d25_spatial_batches(spark, d):
    return spatial.batches(table(spark, d, "footprint").select("pid", "x0", "y0"), "x0", "y0", 400.0, "pid", 8).select("pid", "cx", "cy", "part")


_H = """hist AS (SELECT pid, CAST(CASE WHEN hi = lo THEN 50 ELSE least(floor((z - lo) / ((hi - lo) / 100)), 99) END AS INT) AS bin, count(*) AS n
FROM point JOIN (SELECT pid, min(z) AS lo, max(z) AS hi FROM point GROUP BY pid) r USING (pid) GROUP BY ALL)"""


@query(oracle(f"WITH {_H} SELECT pid, bin, n FROM hist"))
def a12_height_histogram(spark, d):
    return heights.histogram(table(spark, d, "point"), "pid", "z")


@query(oracle("SELECT pid, CAST(floor((y - floor(pid / 100e0) * 40) / 0.5e0) AS INT) AS \"row\", CAST(floor((x - (pid % 100) * 40) / 0.5e0) AS INT) AS col, count(*) AS n FROM point GROUP BY ALL"))
def a13_raster(spark, d):
    return _raster(spark, d)


def _raster(spark, d):
    return heights.raster(table(spark, d, "point"), "pid", (F.col("pid") % 100) * 40, F.floor(F.col("pid") / 100) * 40)


@query(oracle("SELECT pid, count(DISTINCT floor(x / 0.5e0) * 100000000 + floor(y / 0.5e0)) * 0.25e0 AS area FROM point GROUP BY pid"))
def a14_occupied_area(spark, d):
    return heights.occupied_area(_raster(spark, d), "pid")


@query(oracle("""SELECT point_id FROM (SELECT *, max(z) OVER (PARTITION BY pid) AS top, min(z) OVER (PARTITION BY pid) AS low FROM point)
WHERE z >= low AND (z < least(top, low + 4) OR (low + 4 >= top AND z <= top))"""))
def f8_band_mask(spark, d):
    p = table(spark, d, "point")
    e = p.groupBy("pid").agg(F.min("z").alias("low"), F.max("z").alias("top"))
    hi = F.least(F.col("top"), F.col("low") + 4)
    return p.join(e, "pid").where(heights.band(F.col("z"), F.col("low"), hi, F.col("top"))).select("point_id")


@query(oracle("SELECT count(*) AS n FROM point WHERE z IS NOT NULL"))
def f7_finite_points(spark, d):
    p = table(spark, d, "point")
    odd = p.withColumn("z", F.lit(float("nan"))).unionByName(p.withColumn("z", F.lit(float("inf"))))
    return p.unionByName(odd).where(heights.finite("x", "y", "z")).agg(F.count("*").alias("n"))


_CELLS = """cells AS (SELECT DISTINCT tile, CAST(floor(x / 40) AS INT) AS col, CAST(floor(y / 40) AS INT) AS "row", CAST(floor(z) AS INT) AS bin FROM point),
g AS (SELECT *, bin - lag(bin) OVER (PARTITION BY tile, "row", col ORDER BY bin) - 1 AS gap FROM cells WHERE bin BETWEEN 0 AND 12)"""


@query(oracle(f"""WITH {_CELLS} SELECT tile, "row", col FROM g GROUP BY ALL HAVING min(bin) = 0 AND max(bin) = 12 AND count(*) / 13e0 >= 0.85e0 AND coalesce(max(gap), 0) <= 1"""))
def d21_vertical_walls(spark, d):
    p = table(spark, d, "point").select("tile", F.floor(F.col("y") / 40).cast("int").alias("row"), F.floor(F.col("x") / 40).cast("int").alias("col"), F.floor("z").cast("int").alias("bin"))
    return heights.vertical_walls(p, "tile", F.lit(0), F.lit(12))


_LAYERS = """cells AS (SELECT DISTINCT tile, CAST(floor(x / 40) AS INT) AS col, CAST(floor(y / 40) AS INT) AS "row", CAST(1 + floor(z / 4) AS INT) AS layer FROM point)"""


@query(oracle(f"""WITH {_LAYERS} SELECT tile, "row", col, layer FROM cells c WHERE layer = 1
OR NOT EXISTS (SELECT 1 FROM cells l WHERE l.tile = c.tile AND l."row" = c."row" AND l.col = c.col AND l.layer > 1 AND l.layer < c.layer)"""))
def d23_exclusive_layers(spark, d):
    return heights.exclusive(_layers(spark, d), "tile")


def _layers(spark, d):
    at = [F.floor(F.col("y") / 40).cast("int").alias("row"), F.floor(F.col("x") / 40).cast("int").alias("col")]
    return table(spark, d, "point").select("tile", *at, (1 + F.floor(F.col("z") / 4)).cast("int").alias("layer")).distinct()


@query(oracle("""WITH RECURSIVE n AS (SELECT DISTINCT pid, CAST(floor((y - floor(pid / 100e0) * 40) / 2) * 1000 + floor((x - (pid % 100) * 40) / 2) AS BIGINT) AS c FROM point),
e AS (SELECT a.pid, a.c AS a, b.c AS b FROM n a JOIN n b ON a.pid = b.pid AND abs(a.c // 1000 - b.c // 1000) <= 1 AND abs(a.c % 1000 - b.c % 1000) <= 1),
reach AS (SELECT pid, a, b FROM e UNION SELECT r.pid, r.a, e.b FROM reach r JOIN e ON e.pid = r.pid AND e.a = r.b),
lab AS (SELECT pid, a, min(b) AS label FROM reach GROUP BY ALL), sz AS (SELECT pid, label, count(*) AS n FROM lab GROUP BY ALL)
SELECT pid, max(n) * 4e0 AS area FROM sz GROUP BY pid"""))
def d22_largest_component(spark, d):
    """The largest component of every building's raster of cells of two metres."""
    cells = heights.raster(table(spark, d, "point"), "pid", (F.col("pid") % 100) * 40, F.floor(F.col("pid") / 100) * 40, 2.0)
    return heights.component_areas(cells.select("pid", "row", "col"), ["pid"], 2.0)


@query()
def d22_all_components(spark, d):
    """All cells of every layer; checked against a plain version in the tests, since recursive SQL is slow on dense components."""
    return heights.component_areas(_layers(spark, d), ["tile", "layer"])


@query(oracle("""SELECT f.pid, CASE WHEN f.pid % 17 = 0 THEN 'invalid_geometry' WHEN f.pid % 13 = 0 THEN 'no_laz_tiles' WHEN n > 40 THEN 'too_many_points' WHEN coalesce(n, 0) = 0 THEN 'no_points' WHEN n < 25 THEN 'too_few_points' WHEN n > 40 THEN 'too_many_points' ELSE 'task' END AS status, coalesce(n, 0) AS point_count
FROM footprint f LEFT JOIN (SELECT pid, count(*) AS n FROM point GROUP BY pid) q USING (pid)"""))
def d26_batch_status(spark, d):
    out = _estimates(spark, d)
    return out.select("pid", F.when(F.col("status").isin("success", "failed"), "task").otherwise(F.col("status")).alias("status"), "point_count")


def _estimates(spark, d):
    f = table(spark, d, "footprint").select("pid", F.expr("array(x0, y0, x0 + 24, y0 + 20) AS bounds"), (F.col("pid") % 17 != 0).alias("valid"), F.when(F.col("pid") % 13 == 0, 0).otherwise(1).alias("tiles"))
    return heights.estimate_heights(table(spark, d, "point").select("pid", "x", "y", "z"), f, "pid", 25, 40)


def blocks(spark, d):
    """(points, polygons) of blocks of ten buildings: some 300 points each, with the default limits."""
    p = table(spark, d, "point").select(F.floor(F.col("pid") / 10).alias("block"), "x", "y", "z")
    f = table(spark, d, "footprint").groupBy(F.floor(F.col("pid") / 10).alias("block")).agg(F.min("x0").alias("x"), F.min("y0").alias("y"), F.max("x0").alias("x1"))
    return p, f.selectExpr("block", "array(x, y, x1 + 24, y + 20) AS bounds")


@query()
def d24_estimated_heights(spark, d):
    """Checked against a plain version in the tests."""
    out = heights.estimate_heights(*blocks(spark, d), "block")
    return out.select("block", "status", "point_count", F.round("underpass_z", 6).alias("underpass_z"), F.round("underpass_dh", 6).alias("underpass_dh"), "top_area", "bottom_area", F.size("peaks").alias("n_peaks"), "error")


_B = """b AS (SELECT t.tile, i.i AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT tile FROM point) t CROSS JOIN (SELECT unnest(range(0, 100)) AS i) i LEFT JOIN
(SELECT tile, CAST(least(floor((z - lo) / ((hi - lo) / 100)), 99) AS INT) AS bin, count(*) AS n FROM point JOIN (SELECT tile, min(z) AS lo, max(z) AS hi FROM point GROUP BY tile) r USING (tile) GROUP BY ALL) h ON h.tile = t.tile AND h.bin = i.i)"""


@query(oracle(f"WITH {_B}, s AS (SELECT tile, bin, n, round((0.25e0 * coalesce(lag(n, 2) OVER w, 0) + 0.75e0 * coalesce(lag(n) OVER w, 0) + n + 0.75e0 * coalesce(lead(n) OVER w, 0) + 0.25e0 * coalesce(lead(n, 2) OVER w, 0)) / 3, 9) AS s FROM b WINDOW w AS (PARTITION BY tile ORDER BY bin)) SELECT tile, count(*) FILTER (WHERE s > 0) AS n_smooth, max(s) AS top FROM s GROUP BY tile"))
def d20_smoothed_histogram(spark, d):
    h = heights.histogram(table(spark, d, "point"), "tile", "z")
    dense = h.select("tile").distinct().select("tile", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("bin")).join(h, ["tile", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    s = sequences.smoothed(dense, "tile", "n").withColumn("smooth", F.round("smooth", 9))
    return s.groupBy("tile").agg(F.count_if(F.col("smooth") > 0).alias("n_smooth"), F.max("smooth").alias("top"))
