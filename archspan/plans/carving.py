"""Queries of solids, walls, images and independent containment tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import planar
from ..functions.binding import once
from ..functions.geometry import rectangle, register, st
from ..operators import carving, cityjson, relational, walls
from ..storage import durable
from .models import _features
from .registry import query
from .synth import oracle, table


def _polygons(spark, d):
    """Rectangles, every other one with a square hole; every seventh without an elevation, every eleventh a bow tie."""
    register(spark)
    f = table(spark, d, "footprint")
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    whole = rectangle(x, y, x + w, y + h)
    holed = st("difference", whole, rectangle(x + 2, y + 2, x + 4, y + 4))
    bow = st("polygon_of", F.array(x, y, x + w, y + h, x + w, y, x, y + h, x, y))
    g = F.when(F.col("pid") % 11 == 0, bow).when(F.col("pid") % 2 == 0, holed).otherwise(whole)
    return f.select("identificatie", "pid", F.col("identificatie").alias("id"), F.lit(0).alias("part"), F.when(F.col("pid") % 7 != 0, F.lit(3.0) + F.col("pid") % 4).alias("elevation"), g.alias("geom"))


_SOLID = """WITH s AS (SELECT identificatie AS id, pid, (w * h - CASE WHEN pid % 2 = 0 THEN 4 ELSE 0 END) AS area, CASE WHEN pid % 7 <> 0 THEN 3e0 + pid % 4 ELSE 1 + 2.5e0 END AS roof, 1 - 0.1e0 AS low FROM footprint)"""


@query(oracle(f"{_SOLID} SELECT id, CASE WHEN pid % 11 <> 0 THEN round(area * (roof - low), 6) END AS volume, CASE WHEN pid % 11 = 0 THEN 0 WHEN pid % 2 = 0 THEN 32 ELSE 12 END AS n_faces, CASE WHEN pid % 11 = 0 THEN 'empty mesh' END AS skip_reason FROM s"))
def d36_extruded_solids(spark, d):
    """Closed solids: their volume is what their outward triangles enclose."""
    p = _polygons(spark, d)
    out = carving.carve(p.select("id", F.lit(1.0).alias("min_z")), p)
    v = F.when(F.col("skip_reason").isNull(), F.round(carving.volume(F.col("faces")), 6))
    return out.select("id", v.alias("volume"), F.size("faces").alias("n_faces"), "skip_reason")


@query(oracle("""SELECT identificatie AS id, CAST(CASE WHEN pid % 3 = 0 OR pid % 11 = 0 THEN 0 ELSE 1 END AS BIGINT) AS processed, CAST(CASE WHEN pid % 3 = 0 OR pid % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS skipped,
CASE WHEN pid % 3 <> 0 AND pid % 11 <> 0 THEN CASE WHEN pid % 7 <> 0 THEN 3e0 + pid % 4 ELSE 3.5e0 END END AS underpass_z, pid % 3 <> 0 AND pid % 11 <> 0 AS success FROM footprint"""))
def d40_carve_account(spark, d):
    """Every third house has no lowest point."""
    p = _polygons(spark, d)
    houses = p.select("id", F.when(F.col("pid") % 3 != 0, F.lit(1.0)).alias("min_z"))
    return carving.account(carving.carve(houses, p), houses)


@query(oracle("SELECT concat('b', pid) AS id, f.face, CAST(CASE WHEN f.face < 2 THEN 2 WHEN f.face % 2 = 0 THEN 1 ELSE 0 END AS INT) AS axis, round(CASE WHEN f.face < 2 THEN w * h * 0.25e0 WHEN f.face % 2 = 0 THEN w * 0.5e0 * (3 + pid % 5) * 0.25e0 ELSE h * 0.5e0 * (3 + pid % 5) * 0.25e0 END, 6) AS area FROM footprint, (SELECT CAST(unnest(range(0, 6)) AS INT) AS face) f WHERE pid % 6 <> 0"))
def m12_flattened_faces(spark, d):
    """Faces without the axis of their normal's greatest part, and what they enclose there."""
    f = cityjson.faces(_features(spark, d), [0.5, 0.5, 0.25], [100.0, 200.0, 0.0])
    f = once(f.select("id", "face", F.col("rings")[0].alias("ring")), normal=planar.newell(F.col("ring")))
    f = once(f, axis=carving.drop_axis(F.col("normal")))
    f = once(f, flat=carving.flattened(F.col("ring"), F.col("axis")))
    return f.select("id", "face", "axis", F.round(F.abs(carving.signed_area(F.col("flat"))), 6).alias("area"))


def _sites(spark, d):
    """(underpasses, buildings): an underpass along the right side of its building, as high as it, reaching two out of it."""
    register(spark)
    f = table(spark, d, "footprint").where("w >= 9")
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    u = f.select(F.col("pid").alias("underpass_id"), F.col("pid").alias("building_id"), rectangle(x + w - 4, y + 2, x + w + 2, y + h - 2).alias("geom"))
    return u, f.select(F.col("pid").alias("building_id"), rectangle(x, y, x + w, y + h).alias("geom"))


_CRITICAL = """WITH e AS (SELECT pid, x0 + w - 4 AS xa, x0 + w + 2 AS xb, y0 + 2 AS ya, y0 + h - 2 AS yb FROM footprint WHERE w >= 9),
c AS (SELECT pid, 0 AS seq, xa AS x1, ya AS y1, xb AS x2, ya AS y2 FROM e UNION ALL SELECT pid, 2, xb, yb, xa, yb FROM e)"""


@query(oracle(f"{_CRITICAL} SELECT pid AS underpass_id, count(*) AS n, sum(abs(x2 - x1) + abs(y2 - y1)) AS length, min(least(y1, y2)) AS low FROM c GROUP BY pid"))
def d27_critical_edges(spark, d):
    """The two sides that cross the building's wall; the others lie inside and outside of it."""
    e = walls.critical_edges(*_sites(spark, d), 0.1, 0.05, 1.0)
    length = F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))
    return e.groupBy("underpass_id").agg(F.count("*").alias("n"), F.sum(length).alias("length"), F.min(F.least("y1", "y2")).alias("low"))


@query(oracle(f"{_CRITICAL} SELECT pid AS underpass_id, least(y1, y2) AS y, 8 * (2e0 + pid % 5) AS area FROM c"))
def d28_critical_walls(spark, d):
    """Walls on critical edges, each twice: the smaller one of two along each other goes."""
    u, b = _sites(spark, d)
    e = walls.critical_edges(u, b, 0.1, 0.05, 1.0)
    e = e.withColumn("edge_id", F.col("edge_id") * 2)
    shorter = e.withColumns({"edge_id": F.col("edge_id") + 1, "x1": F.col("x1") + 0.25 * F.signum(F.col("x2") - F.col("x1"))})
    z = F.col("building_id") % 5
    faces = b.select("building_id", st("exterior_ring", "geom").alias("geom"), F.lit(1.0).alias("z0"), (z + 3.0).alias("z1"))
    w = walls.critical_walls(e.unionByName(shorter), faces, 0.1, 1.0)
    return w.select("underpass_id", F.least("y1", "y2").alias("y"), F.round("area", 6).alias("area"))


@query(oracle("SELECT pid, pid % 50 AS image_no, cx FROM footprint LEFT JOIN camera ON image_id = concat('img', pid % 50)"))
def j9_footprints_with_cameras(spark, d):
    f = table(spark, d, "footprint").select("pid", (F.col("pid") % 50).alias("image_no"), F.concat(F.lit("img"), (F.col("pid") % 50).cast("string")).alias("image_id"))
    return walls.footprints_with_cameras(f, table(spark, d, "camera").select("image_id", "cx")).select("pid", "image_no", "cx")


@query(oracle("SELECT image_id, array_to_string(list_sort(list(pid)), ',') AS wall_ids, any_value(cx) AS cx, any_value(cz) AS cz FROM footprint JOIN camera ON image_id = concat('img', pid % 50) GROUP BY image_id"))
def a10_walls_by_image(spark, d):
    v = table(spark, d, "footprint").select(F.col("pid").alias("wall_id"), F.concat(F.lit("img"), (F.col("pid") % 50).cast("string")).alias("image_id"))
    return walls.by_image(v, table(spark, d, "camera")).select("image_id", F.array_join("wall_ids", ",").alias("wall_ids"), "cx", "cz")


@query(oracle("SELECT concat('b', pid) AS id, CASE WHEN pid % 4 = 0 THEN 0 ELSE greatest(w, h) END AS area FROM footprint WHERE pid % 3 <> 0"))
def f12_a18_t7_carved_buildings(spark, d):
    """Buildings whose part was carved, by their greatest ceiling; some tell their areas as text, some as what is no number."""
    k = F.col("pid")
    done = F.when(k % 3 == 0, "0").when(k % 3 == 1, "1").otherwise("true")
    area = lambda c: F.when(k % 4 == 0, F.lit('"none"')).when(k % 4 == 1, F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))).otherwise(F.col(c).cast("string"))
    text = F.concat(F.lit('{"type":"CityJSONFeature","id":"b'), k.cast("string"), F.lit('","CityObjects":{"a":{"type":"Building"},"p":{"type":"BuildingPart","attributes":{"add_underpass_success":'), done,
                    F.lit('},"geometry":[{"type":"Solid","lod":"2.2","semantics":{"surfaces":[{"type":"OuterCeilingSurface","underpass_area":'), area("w"), F.lit('},{"type":"RoofSurface","underpass_area":999},{"type":"OuterCeilingSurface","underpass_area":'), area("h"), F.lit("}]}}]}}}"))
    return cityjson.carved_buildings(cityjson.parse(table(spark, d, "footprint").select(text.alias("value"))))


@query(oracle("SELECT underpass_id FROM status WHERE underpass_id % 10 <> 3 AND underpass_id % 7 <> 2"))
def f10_skip_lists(spark, d):
    """Work without what is over the limit and what is cached."""
    s = table(spark, d, "status").select("underpass_id", "identificatie")
    exceeded, cached = s.where("underpass_id % 10 = 3").select("underpass_id"), s.where("underpass_id % 7 = 2").select("underpass_id", "identificatie")
    return relational.unprocessed(s, (exceeded, ["underpass_id"]), (cached, ["underpass_id", "identificatie"])).select("underpass_id")


@query(oracle("""WITH inside AS (SELECT p.point_id, e.pid FROM point p JOIN edge e ON p.pid = e.pid GROUP BY p.point_id, e.pid, p.x, p.y
HAVING sum(CASE WHEN (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (CASE WHEN e.y2 = e.y1 THEN 1 ELSE e.y2 - e.y1 END) + e.x1 THEN 1 ELSE 0 END) % 2 = 1)
SELECT pid, count(*) AS crossing, count(*) AS angle, count(*) AS winding, count(*) AS fan, count(*) AS slabs FROM inside GROUP BY pid"""))  # no point lies on an edge
def d17_containment_variants(spark, d):
    """Independent tests of points in L-shaped rings: crossings, the sum of angles, winding, a fan of triangles, and slabs."""
    rings = table(spark, d, "edge").groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("seq", "x1", "y1", "x2", "y2"))).alias("e"))
    p = table(spark, d, "point").select("pid", "x", "y").join(rings, "pid")
    tests = {"crossing": planar.inside, "angle": planar.inside_by_angle, "winding": planar.inside_by_winding, "fan": planar.inside_by_fan, "slabs": planar.inside_by_slabs}
    told = p.select("pid", *[f(F.col("x"), F.col("y"), F.col("e")).alias(n) for n, f in tests.items()])
    return told.groupBy("pid").agg(*[F.count_if(n).alias(n) for n in tests]).where("crossing + angle + winding + fan + slabs > 0")


@query(oracle("""SELECT concat('b', pid) AS id, f.face, CASE WHEN f.face = 7 THEN 'OuterCeilingSurface' WHEN f.face = 0 THEN 'OuterCeilingSurface' WHEN f.face = 1 THEN 'RoofSurface' ELSE 'WallSurface' END AS kind
FROM footprint, (SELECT CAST(unnest([0, 1, 2, 3, 4, 5, 7]) AS INT) AS face) f WHERE pid % 6 <> 0"""))
def d38_inferred_semantics(spark, d):
    """Halves of a model's faces take the kind of the face that they lie on; a level face in between, turned down, takes its kind from its height."""
    f = durable(cityjson.faces(_features(spark, d, spread=True), [0.5, 0.5, 0.25], [100.0, 200.0, 0.0]), "faces")  # read four times; lines are parsed once
    ring = F.col("rings")[0]
    middle = lambda a, b: F.struct(*[((a[c] + b[c]) / 2).alias(c) for c in "xyz"])
    half = F.array(ring[0], middle(ring[0], ring[1]), middle(ring[2], ring[3]), ring[3])
    raised = F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), (p["z"] + 0.6).alias("z")))
    new = f.select("id", "face", half.alias("points")).unionByName(f.where("face = 0").select("id", F.lit(7).alias("face"), raised.alias("points")))
    return cityjson.inferred_kinds(new, f, f.select("id").distinct().withColumn("min_z", F.lit(0.0)))


@query(oracle("""WITH r AS (SELECT pid, w, h, CASE WHEN pid % 5 <> 0 AND pid % 10 <> 3 THEN 2.5e0 + pid % 4 END AS cc, CASE WHEN pid % 7 <> 0 AND pid % 10 <> 3 THEN 3e0 END AS depth, 2e0 + pid % 3 AS real FROM footprint WHERE pid % 100 < 50),
m AS (SELECT pid, 'cc' AS method, cc AS v, real, cc IS NULL AND depth IS NULL AS nowhere FROM r UNION ALL SELECT pid, 'depth', depth, real, cc IS NULL AND depth IS NULL FROM r)
SELECT method, count(*) AS n, count(*) FILTER (WHERE v IS NULL AND NOT nowhere) AS n_null, count(*) FILTER (WHERE nowhere) AS n_null_everywhere, round(avg(abs(v - real)), 9) AS mae, round(sqrt(avg((v - real) ** 2)), 9) AS rmse, round(avg(abs(v - real) / real), 9) AS relative FROM m GROUP BY method"""))
def d35_assessment_by_place(spark, d):
    """Estimates meet true surfaces by place; images, which overlap, cover the western half."""
    register(spark)
    f = table(spark, d, "footprint")
    x, y, k = F.col("x0"), F.col("y0"), F.col("pid")
    box = rectangle(x + 1, y + 1, x + 3, y + 3)
    lost = k % 10 == 3
    cc = f.select(k.alias("underpass_id"), F.lit("cc").alias("method"), F.when((k % 5 != 0) & ~lost, F.lit(2.5) + k % 4).alias("estimated"), box.alias("geom"))
    depth = f.select(k.alias("underpass_id"), F.lit("depth").alias("method"), F.when((k % 7 != 0) & ~lost, F.lit(3.0)).alias("estimated"), box.alias("geom"))
    truth = f.select(k.alias("surface_id"), (F.lit(2.0) + k % 3).alias("real"), rectangle(x + 2, y + 2, x + 5, y + 5).alias("geom"))
    strips = f.where("pid % 100 < 50").groupBy("y0").agg(F.count("*").alias("n"))
    images = strips.select(rectangle(F.lit(0.0), y, F.lit(2000.0), y + 30).alias("geom")).unionByName(strips.select(rectangle(F.lit(0.0), y - 10, F.lit(1000.0), y + 35).alias("geom")))
    out = walls.compared(walls.comparison(cc.unionByName(depth), truth, images))
    return out.select("method", "n", "n_null", "n_null_everywhere", *[F.round(c, 9).alias(c) for c in ("mae", "rmse", "relative")])


@query(oracle("SELECT pid, CASE WHEN pid % 7 <> 0 AND pid % 5 <> 0 THEN CAST(w * 10 AS INT) END AS width, CASE WHEN pid % 7 <> 0 AND pid % 5 <> 0 THEN CAST(greatest(1, h * 3 + 2 * (pid % 2)) AS INT) END AS height FROM footprint"))
def d30_facade_sizes(spark, d):
    """Projected walls, one side of some longer than the other; some lack a corner, and some span far more than their image."""
    f = table(spark, d, "footprint")
    w, h, k = F.col("w") * 10, F.col("h") * 3, F.col("pid")
    wide = F.when(k % 5 == 0, w + 1e7).otherwise(w)
    p = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    zero = F.lit(0.0)
    corners = F.array(p(zero, zero), p(wide, zero), p(wide, h + 2 * (k % 2)), p(zero, h + 2 * (k % 2)))
    some = F.when(k % 7 == 0, F.slice(corners, 1, 3)).otherwise(corners)
    size = walls.facade_size(some, F.lit(4000), F.lit(3000))
    return f.select("pid", size.alias("s")).select("pid", "s.width", "s.height")
