"""Queries of city models, validation reports, review tags, manifests, text functions, walls and accuracy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import planar
from ..operators import cityjson, review, validity, walls
from .registry import query
from .synth import oracle, table

_BOX = '[[[[0,3,2,1]],[[4,5,6,7]],[[0,1,5,4]],[[1,2,6,5]],[[2,3,7,6]],[[3,0,4,7]]]]'
_SEM = '{"surfaces":[{"type":"OuterCeilingSurface","id":"u1"},{"type":"RoofSurface"},{"type":"WallSurface"}],"values":[[0,1,2,2,2,2]]}'
_I = lambda e: f"cast(cast({e} AS bigint) AS varchar(20))"
_Z = "(3 + pid % 5)"
_V = ", ',', ".join(f"'[', {_I('x0' + x)}, ',', {_I('y0' + y)}, ',', {z}, ']'" for x, y, z in [(x, y, z) for z in ("'0'", _I(_Z)) for x, y in (("", ""), (" + w", ""), (" + w", " + h"), ("", " + h"))])
# Lines of a city model: a building of level 0 and its part, a box in two levels of detail, with an outer ceiling.
FEATURE = f"""
SELECT pid, w, h, concat('{{"type":"CityJSONFeature","id":"b', {_I('pid')}, '","CityObjects":{{"b', {_I('pid')}, '":{{"type":"Building","attributes":{{"identificatie":"', identificatie, '","storeys":"', {_I('pid % 4')}, '"}},"geometry":[{{"type":"MultiSurface","lod":"0","boundaries":[[[0,1,2,3]]]}}]}},"b', {_I('pid')},
 '-0":{{"type":"BuildingPart","geometry":[{{"type":"Solid","lod":"', CASE WHEN pid % 6 = 0 THEN '1.3' ELSE '2.2' END, '","boundaries":{_BOX},"semantics":{_SEM}}},{{"type":"Solid","lod":"1.2","boundaries":{_BOX}}}]}}}},"vertices":[', {_V}, ']}}') AS value
FROM footprint"""
SCALE, MOVE = [0.5, 0.5, 0.25], [100.0, 200.0, 0.0]


def _named(text: str, name: str) -> str:
    """SQL text whose table is a parameter; its other braces are doubled."""
    return text.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", f"FROM {{{name}}}")


def _features(spark, d, spread=False):
    """spread: lines are dealt to all tasks before they are parsed, since a small file of keys is few tasks' input."""
    f = table(spark, d, "footprint")
    f = f.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "pid") if spread else f
    return cityjson.parse(spark.sql(_named(FEATURE, "footprint"), footprint=f))


@query(oracle("SELECT concat('b', pid) AS id, 'u1' AS source, w * h * 0.25e0 AS area FROM footprint WHERE pid % 6 <> 0"))
def d43_underpass_area(spark, d):
    return cityjson.underpass_areas(cityjson.faces(_features(spark, d), SCALE, MOVE))


@query(oracle("""SELECT concat('b', pid) AS id, f.face, CASE f.face WHEN 0 THEN 'OuterCeilingSurface' WHEN 1 THEN 'RoofSurface' ELSE 'WallSurface' END AS kind,
round(CASE WHEN f.face < 2 THEN w * h * 0.25e0 WHEN f.face % 2 = 0 THEN w * 0.5e0 * (3 + pid % 5) * 0.25e0 ELSE h * 0.5e0 * (3 + pid % 5) * 0.25e0 END, 6) AS area
FROM footprint, (SELECT CAST(unnest(range(0, 6)) AS INT) AS face) f WHERE pid % 6 <> 0"""))
def s25_m11_faces(spark, d):
    f = cityjson.faces(_features(spark, d), SCALE, MOVE)
    return f.select("id", "face", "kind", F.round(cityjson.face_area(F.col("rings")), 6).alias("area"))


@query(oracle("""SELECT concat('b', pid) AS id, CASE f.face WHEN 0 THEN 'GroundSurface' WHEN 1 THEN 'RoofSurface' ELSE 'WallSurface' END AS kind, count(*) AS n
FROM footprint, (SELECT unnest(range(0, 6)) AS face) f WHERE pid % 6 <> 0 GROUP BY 1, 2"""))
def m13_d38_semantics(spark, d):
    """Semantics inferred from normals and heights."""
    f = cityjson.faces(_features(spark, d), SCALE, MOVE).select("id", planar.newell(F.col("rings")[0]).alias("n"), F.aggregate("rings", F.lit(0.0), lambda a, r: a + F.aggregate(r, F.lit(0.0), lambda b, p: b + p["z"]) / F.size(r)).alias("z"))
    length = planar.norm(F.col("n"))
    unit = F.struct(*[(F.col(f"n.{c}") / length).alias(c) for c in "xyz"])
    return f.select("id", planar.surface_kind(unit, F.col("z"), F.lit(0.0)).alias("kind")).groupBy("id", "kind").agg(F.count("*").alias("n"))


@query(oracle("""SELECT 'features' AS kind, count(*) AS value FROM footprint UNION ALL SELECT 'vertices', count(*) * 8 FROM footprint UNION ALL SELECT 'objects', count(*) * 2 FROM footprint
UNION ALL SELECT 'object Building', count(*) FROM footprint UNION ALL SELECT 'object BuildingPart', count(*) FROM footprint UNION ALL SELECT 'geometry MultiSurface', count(*) FROM footprint UNION ALL SELECT 'geometry Solid', count(*) * 2 FROM footprint"""))
def d47_model_statistics(spark, d):
    return cityjson.statistics(_features(spark, d))


@query(oracle("SELECT concat('b', pid) AS id, CASE WHEN pid % 6 = 0 THEN '0.0,1.2,1.3' ELSE '0.0,1.2,2.2' END AS lods FROM footprint"))
def x14_levels_of_detail(spark, d):
    return cityjson.levels(_features(spark, d)).select("id", F.array_join("lods", ",").alias("lods"))


@query(oracle("SELECT concat('b', pid) AS id, pid % 6 <> 0 AS found FROM footprint"))
def d44_solid_selection(spark, d):
    f = _features(spark, d)
    return f.select(F.col("feature.id").alias("id"), cityjson.solid(F.col("feature")).isNotNull().alias("found"))


@query(oracle("""SELECT concat('b', pid) AS id, pid % 3 = 0 AS is_changed, CASE WHEN pid % 3 = 0 THEN CAST(pid % 4 AS VARCHAR) END AS storeys, CASE WHEN pid % 3 = 0 THEN CAST(pid % 9 AS VARCHAR) END AS underpass_z,
CASE WHEN pid % 3 = 0 THEN 2 END AS n_objects, CASE WHEN pid % 3 = 0 THEN 8 END AS n_vertices, CASE WHEN pid % 3 = 0 AND pid % 6 <> 0 THEN w * h * 0.25e0 END AS area FROM footprint"""))
def k14_x11_attributes_merged(spark, d):
    f = _features(spark, d)
    values = table(spark, d, "footprint").where("pid % 3 = 0").select(F.concat(F.lit("b"), "pid").alias("id"), F.explode(F.create_map(F.lit("underpass_z"), (F.col("pid") % 9).cast("string"), F.lit("storeys"), F.lit("99"))).alias("name", "value"))
    out = cityjson.parse(cityjson.with_attributes(f, values), "changed")
    own = F.try_element_at(F.col("feature.CityObjects"), F.col("id"))["attributes"]
    told = out.select("id", F.col("changed").isNotNull().alias("is_changed"), own["storeys"].alias("storeys"), own["underpass_z"].alias("underpass_z"), F.when(F.col("feature").isNotNull(), F.size("feature.CityObjects")).alias("n_objects"), F.when(F.col("feature").isNotNull(), F.size("feature.vertices")).alias("n_vertices"))
    areas = cityjson.underpass_areas(cityjson.faces(out, SCALE, MOVE)).select("id", "area")
    return told.join(areas, "id", "left")


@query("SELECT s_suppkey, 'CityJSON' AS type, '2.0' AS version, false AS has_extensions, (s_suppkey % 4 + 1) * 0.25e0 AS scale_x FROM supplier")
def d48_header_rewrite(spark, d):
    """A header line for each supplier's model, with a scale of its own."""
    value = F.concat(F.lit('{"type":"CityJSON","version":"2.0","transform":{"scale":['), ((F.col("s_suppkey") % 4 + 1) * 0.25).cast("string"), F.lit(',0.5,0.25],"translate":[1,2,3]},"extensions":{"a":1}}'))
    h = table(spark, d, "supplier").select("s_suppkey", cityjson.without_key(value, "extensions").alias("value"))
    out = cityjson.header(h.withColumn("m", F.from_json("value", "map<string, string>")))
    return out.select("s_suppkey", F.col("m.type").alias("type"), F.col("m.version").alias("version"), F.map_contains_key("m", F.lit("extensions")).alias("has_extensions"), F.col("scale")[0].alias("scale_x"))


@query(oracle("SELECT pid, 0.5e0 * x0 + 100 AS x, (3 + pid % 5) * 0.25e0 AS z FROM footprint"))
def m15_dequantised(spark, d):
    f = _features(spark, d).select("pid", cityjson.vertices(F.col("feature"), F.array(*map(F.lit, SCALE)), F.array(*map(F.lit, MOVE))).alias("v"))
    return f.select("pid", F.col("v")[0][0].alias("x"), F.col("v")[4][2].alias("z"))


# Validation reports: one a supplier, with errors of parts; every seventh is corrupt.
_REPORT = """SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN '{"features": [' ELSE concat('{"validity":false,"features":[{"id":"o', cast(s_suppkey AS varchar(20)), '","validity":false,"errors":[{"code":', cast(101 + s_suppkey % 4 AS varchar(20)), ',"description":"A","id":"coid=o|geom=', cast(s_suppkey % 3 AS varchar(20)), '|face=x"},{"code":203,"description":"B","id":"coid=o|geom=1|geom=', cast(s_suppkey % 2 AS varchar(20)), '|shell=-1"}]}],"dataset_errors":[]}') END AS value FROM supplier"""


def _reports(spark, d):
    return validity.parse(spark.sql(_named(_REPORT, "supplier"), supplier=table(spark, d, "supplier")))


@query("SELECT CAST(101 + s_suppkey % 4 AS INT) AS code, count(*) AS n, count(*) AS n_objects FROM supplier WHERE s_suppkey % 7 <> 0 GROUP BY 1 UNION ALL SELECT 203, count(*), count(*) FROM supplier WHERE s_suppkey % 7 <> 0")
def d41_validation_summary(spark, d):
    return validity.summary(_reports(spark, d))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE s_suppkey % 7 = 0) AS n_corrupt FROM supplier")
def s30_tolerant_reports(spark, d):
    return _reports(spark, d).agg(F.count("*").alias("n"), F.count_if("corrupt").alias("n_corrupt"))


@query("""SELECT concat('o', s_suppkey) AS object, CAST(101 + s_suppkey % 4 AS INT) AS code, CAST(s_suppkey % 3 AS INT) AS geom, 0 AS face FROM supplier WHERE s_suppkey % 7 <> 0
UNION ALL SELECT concat('o', s_suppkey), 203, CAST(s_suppkey % 2 AS INT), 0 FROM supplier WHERE s_suppkey % 7 <> 0""")
def x7_error_id_parts(spark, d):
    p = validity.errors(_reports(spark, d)).withColumn("p", validity.parts(F.col("id")))
    return p.select("object", "code", validity.number(F.col("p"), "geom").alias("geom"), validity.number(F.col("p"), "face").alias("face"))


@query("SELECT concat('o', s_suppkey) AS object, CASE WHEN s_suppkey % 3 = s_suppkey % 2 THEN 1 ELSE 2 END AS n_geometries FROM supplier WHERE s_suppkey % 7 <> 0")
def x9_errors_by_geometry(spark, d):
    return validity.by_geometry(validity.errors(_reports(spark, d))).select("object", F.size("geometries").alias("n_geometries"))


@query("SELECT count(*) FILTER (WHERE c_custkey IS NOT NULL) AS n_attached, (SELECT count(*) FROM orders WHERE o_custkey % 10 = 9) AS n_unmatched FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 9) c ON c_custkey = o_custkey")
def x10_attached_values(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    c = table(spark, d, "customer").where("c_custkey % 10 <> 9").select(F.col("c_custkey").alias("k"), F.lit(1).alias("v"))
    held, lost = validity.attach(o, c, "k", "v")[0], validity.attach(c, o, "k", "o_orderkey")[1]
    n = held.join(c.select("k"), "k", "left_anti").agg(F.count("*").alias("n_unmatched"))
    assert lost.columns == ["k"]
    return held.agg(F.count("v").alias("n_attached")).join(n)


@query("SELECT c_custkey, concat('NL.IMBAG.Pand.', lpad(c_custkey::VARCHAR, 16, '0')) AS id, CASE WHEN c_custkey % 2 = 0 THEN concat('a_b', c_custkey) ELSE 'unknown' END AS file FROM customer")
def x2_x3_names(spark, d):
    c = table(spark, d, "customer")
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("..a /b"), F.col("c_custkey"))).otherwise("._ ")
    return c.select("c_custkey", review.building_id(F.concat(F.lit(" "), F.lpad(F.col("c_custkey").cast("string"), 16, "0"))).alias("id"), review.file_name(raw).alias("file"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'good,odd' ELSE 'odd' END AS tags FROM customer")
def x16_normal_tags(spark, d):
    tags = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("bad"), F.lit("good"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("odd"), F.lit("good"), F.lit("x"))).otherwise(F.array(F.lit("odd"), F.lit("odd")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(review.normal_tags(tags, ["good", "bad", "odd"], ["good", "bad"]), ",").alias("tags"))


_HELD = "held AS (SELECT o_custkey AS building, list_sort(list(o_orderkey)) AS u FROM orders GROUP BY o_custkey)"


@query(f"WITH {_HELD} SELECT building, CASE WHEN len(u) = 1 THEN u[1] END AS underpass, 'checked' AS tag, len(u) <> 1 AS legacy FROM held")
def x17_tag_migration(spark, d):
    v1 = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("building")).agg(F.collect_list("o_orderkey").alias("underpasses")).withColumn("tag", F.lit("checked"))
    return review.migrate(v1)


@query("SELECT o_custkey AS building, o_orderkey AS underpass, CASE WHEN o_orderkey % 4 = 0 THEN 'good' ELSE 'missing' END AS tag, o_orderkey % 4 <> 0 AS automatic FROM orders")
def x18_default_tags(spark, d):
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("building"), F.col("o_orderkey").alias("underpass"))
    return review.default_tags(t, t.where("underpass % 4 = 0").withColumn("tag", F.lit("good")).withColumn("automatic", F.lit(False)), "missing")


@query("SELECT o_custkey AS building, o_orderkey AS underpass FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT DISTINCT c_custkey, CAST(NULL AS BIGINT) FROM customer WHERE c_custkey % 50 = 0 OR c_custkey % 70 = 0")
def f14_review_targets(spark, d):
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("building"), F.col("o_orderkey").alias("underpass"), F.when(F.col("o_orderkey") % 5 == 0, "bad").otherwise("good").alias("tag"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("building"))
    return review.targets_with("bad", t, c.where("building % 50 = 0").withColumn("tag", F.lit("bad")), c.where("building % 70 = 0").withColumn("tag", F.lit("bad")))


@query("SELECT concat('a/', s_suppkey % 50, '.fcb') AS url, CASE min(s_suppkey) % 3 WHEN 0 THEN concat('L', min(s_suppkey)) ELSE concat(min(s_suppkey) % 50, '.fcb') END AS label FROM supplier GROUP BY s_suppkey % 50")
def s32_manifest(spark, d):
    k = F.col("s_suppkey")
    url = F.concat(F.lit("a/"), k % 50, F.lit(".fcb"))
    entry = F.when(k % 3 == 0, F.to_json(F.struct(url.alias("href"), F.concat(F.lit("L"), k).alias("name")))).otherwise(url)
    return review.manifest(table(spark, d, "supplier").select(k.alias("pos"), entry.alias("entry")))


@query("SELECT concat('u', s_suppkey) AS url, CASE WHEN s_suppkey % 2 = 0 THEN 'old' WHEN s_suppkey % 3 = 0 THEN 'found' ELSE 'up' END AS label, CASE WHEN s_suppkey % 5 = 0 OR (s_suppkey % 2 <> 0 AND s_suppkey % 3 <> 0) THEN 3 WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END AS ord FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 OR s_suppkey % 5 = 0")
def d49_merged_manifests(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("u"), "s_suppkey").alias("url"), "s_suppkey")
    of = lambda n, label: s.where(f"s_suppkey % {n} = 0").select("url", F.lit(label).alias("label"))
    return review.merge_manifests(of(2, "old"), of(3, "found"), of(5, "up"))


@query(oracle("SELECT underpass_id, CASE WHEN underpass_status = 'success' AND underpass_source = 'streetlidar' THEN 'measured' WHEN underpass_status = 'success' THEN 'assumed' WHEN underpass_status IS NULL THEN 'unknown' ELSE 'failed' END AS category FROM status"))
def x15_status_category(spark, d):
    return table(spark, d, "status").select("underpass_id", review.category(F.col("underpass_status"), F.col("underpass_source")).alias("category"))


@query("SELECT event_id, props->>'$.k' IS NULL AS no_k, len(json_keys(props)) AS n_keys FROM events")
def x12_json_keys(spark, d):
    m = F.from_json("props", "map<string, string>")
    return table(spark, d, "events").select("event_id", F.try_element_at(m, F.lit("k")).isNull().alias("no_k"), F.size(F.map_keys(m)).cast("long").alias("n_keys"))


@query("SELECT o_orderkey, left(concat_ws('; ', o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END), 10) AS error FROM orders")
def x20_error_text(spark, d):
    e = F.concat_ws("; ", "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")))
    return table(spark, d, "orders").select("o_orderkey", F.left(e, F.lit(10)).alias("error"))


_CAM = """p AS (SELECT c.image_id, c.width, c.height, c.f, x0 - cx AS dx, y0 - cy AS dy, 5 - cz AS dz, omega, phi, kappa, pid FROM camera c JOIN footprint ON abs(x0 - cx) <= 60 AND abs(y0 - cy) <= 60),
o AS (SELECT *, dx AS ax, cos(omega) * dy + sin(omega) * dz AS ay, -sin(omega) * dy + cos(omega) * dz AS az FROM p),
q AS (SELECT *, cos(phi) * ax - sin(phi) * az AS bx, ay AS by_, sin(phi) * ax + cos(phi) * az AS bz FROM o),
r AS (SELECT *, cos(kappa) * bx + sin(kappa) * by_ AS gx, -sin(kappa) * bx + cos(kappa) * by_ AS gy, bz AS gz FROM q),
uv AS (SELECT *, width / 2 - f * gx / gz AS u, height / 2 + f * gy / gz AS v FROM r WHERE gz < 0)"""


@query(oracle(f"WITH {_CAM} SELECT image_id, pid, round(u, 5) AS u, round(v, 5) AS v FROM uv WHERE u BETWEEN -100 AND width + 100 AND v BETWEEN -100 AND height + 100"))
def m7_projection(spark, d):
    f = table(spark, d, "footprint").select("pid", "x0", "y0", F.expr("array(x0, y0, x0, y0) AS l_bounds"))
    c = table(spark, d, "camera")
    cam = c.withColumn("r_bounds", F.expr("array(cx - 60, cy - 60, cx + 60, cy + 60)"))
    from ..operators.spatial import spatial_join

    pairs = spatial_join(f, cam, 120.0)
    p = planar.project({n: F.col(n) for n in ("omega", "phi", "kappa", "cx", "cy", "cz", "f", "width", "height")}, F.col("x0"), F.col("y0"), F.lit(5.0))
    return pairs.select("image_id", "pid", p.alias("p")).where("p IS NOT NULL").select("image_id", "pid", F.round("p.u", 5).alias("u"), F.round("p.v", 5).alias("v"))


@query(oracle("""WITH w AS (SELECT pid, seq, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my, y2 - y1 AS nx, x1 - x2 AS ny FROM edge)
SELECT pid, seq, image_id FROM w JOIN camera ON abs(mx - cx) <= 50 AND abs(my - cy) <= 50 AND (mx <> cx OR my <> cy) AND (nx * (mx - cx) + ny * (my - cy)) / (sqrt(nx ** 2 + ny ** 2) * sqrt((mx - cx) ** 2 + (my - cy) ** 2)) < 0"""))
def d29_visibility(spark, d):
    return walls.visible(table(spark, d, "edge"), table(spark, d, "camera"), 50.0).select("pid", "seq", "image_id")


@query(oracle("SELECT pid, seq, (abs(x2 - x1) + abs(y2 - y1)) * (z1 - z0) AS wall_area FROM edge JOIN (SELECT pid, min(z) AS z0, max(z) AS z1 FROM point GROUP BY pid) USING (pid)"))
def m9_d28_walls(spark, d):
    return walls.extruded(table(spark, d, "edge"), table(spark, d, "point").select("pid", "z"), "pid").select("pid", "seq", "wall_area")


_ASSESS = "r AS (SELECT 2e0 + o_orderkey % 7 AS t, CASE WHEN o_orderkey % 5 <> 0 THEN 2.5e0 + o_orderkey % 6 END AS cc, CASE WHEN o_orderkey % 9 <> 0 THEN 1.75e0 + o_orderkey % 8 END AS depth FROM orders)"


@query(f"""WITH {_ASSESS}, s AS (SELECT 'cc' AS method, t, cc AS v FROM r UNION ALL SELECT 'depth', t, depth FROM r)
SELECT method, count(v) AS n, count(*) - count(v) AS n_null, round(avg(abs(v - t)), 9) AS mae, round(sqrt(avg((v - t) ** 2)), 9) AS rmse, round(avg(abs(v - t) / t), 9) AS relative FROM s GROUP BY method""")
def a16_d35_assessment(spark, d):
    k = F.col("o_orderkey")
    r = table(spark, d, "orders").select((2.0 + k % 7).alias("t"), F.when(k % 5 != 0, 2.5 + k % 6).alias("cc"), F.when(k % 9 != 0, 1.75 + k % 8).alias("depth"))
    return walls.assessment(r, "t", ["cc", "depth"]).select("method", "n", "n_null", *[F.round(c, 9).alias(c) for c in ("mae", "rmse", "relative")])


@query("SELECT o_custkey, round((list_sum(list_sort(list(o_totalprice))[CAST(floor(count(*) * 0.15) AS INT) + 1 : CAST(count(*) - floor(count(*) * 0.15) AS INT)])) / (count(*) - 2 * floor(count(*) * 0.15)), 6) AS trimmed FROM orders GROUP BY o_custkey")
def a17_trimmed_mean(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(walls.trimmed_mean(F.collect_list("o_totalprice")), 6).alias("trimmed"))


@query("SELECT o_orderkey, CASE WHEN 12e0 * (1 - (o_orderkey % 100) / 100e0) < 11.8e0 AND 12e0 * (1 - (o_orderkey % 100) / 100e0) >= 2 THEN round(12e0 * (1 - (o_orderkey % 100) / 100e0), 9) END AS h FROM orders")
def m10_f11_pixel_heights(spark, d):
    h = walls.pixel_height((F.col("o_orderkey") % 100).cast("double"), F.lit(100.0), F.lit(12.0))
    return table(spark, d, "orders").select("o_orderkey", F.round(walls.realistic(h, F.lit(12.0)), 9).alias("h"))


@query("SELECT o_custkey, round(avg(o_totalprice), 6) AS mean, median(o_totalprice) AS median FROM orders GROUP BY o_custkey")
def d34_a22_mean_and_median(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 6).alias("mean"), F.median("o_totalprice").alias("median"))


@query(oracle("SELECT pid, max(z) - min(z) AS spread, coalesce(max(z), min(z) + 2.5) AS elevation FROM point GROUP BY pid"))
def a11_m18_z_ranges(spark, d):
    return table(spark, d, "point").groupBy("pid").agg((F.max("z") - F.min("z")).alias("spread"), F.coalesce(F.max("z"), F.min("z") + 2.5).alias("elevation"))


@query(oracle("SELECT f.identificatie AS a, g.identificatie AS b, f.cut FROM adjacent j JOIN footprint f ON f.identificatie = j.identificatie JOIN footprint g ON g.identificatie = j.adjacent_identificatie"))
def j3_adjacency(spark, d):
    f, j = table(spark, d, "footprint"), table(spark, d, "adjacent").select("identificatie", "adjacent_identificatie")
    a = j.join(f.select("identificatie", "cut"), "identificatie")
    return a.join(f.select(F.col("identificatie").alias("adjacent_identificatie")), "adjacent_identificatie").select(F.col("identificatie").alias("a"), F.col("adjacent_identificatie").alias("b"), "cut")


@query(oracle("SELECT f.identificatie, count(j.adjacent_pid) AS n FROM footprint f LEFT JOIN adjacent j ON j.identificatie = f.identificatie GROUP BY 1"))
def j4_left_adjacency(spark, d):
    j = table(spark, d, "adjacent").select("identificatie", "adjacent_pid")
    return table(spark, d, "footprint").join(j, "identificatie", "left").groupBy("identificatie").agg(F.count("adjacent_pid").alias("n"))


@query(oracle("""SELECT pid FROM footprint f WHERE NOT EXISTS (SELECT 1 FROM footprint g WHERE g.y0 = f.y0 AND g.pid <> f.pid AND g.w * g.h > f.w * f.h AND g.w >= f.w AND g.h >= f.h)"""))
def j20_larger_containers(spark, d):
    from ..operators.relational import larger_containers

    c = F.col
    holds = (c("o_w") * c("o_h") > c("i_w") * c("i_h")) & (c("o_w") >= c("i_w")) & (c("o_h") >= c("i_h"))
    f = table(spark, d, "footprint").select("pid", "y0", "w", "h", F.array(F.lit(0.0), F.lit(0.0), "w", "h").alias("bounds"))  # moved to one corner, so that all of a row meet
    return larger_containers(f, "pid", "y0", "bounds", holds, 40.0).select("pid")


@query(oracle("SELECT pid, arg_min(road_id, abs(y0 - y) * 100000 + road_id) AS road_id FROM footprint JOIN road ON xa <= x0 AND xb >= x0 AND abs(y0 - y) <= 50 GROUP BY pid"))
def j19_nearest_within(spark, d):
    """A theta join and the partner of the least difference."""
    from ..operators.spatial import spatial_join

    f = table(spark, d, "footprint").select("pid", "y0", F.expr("array(x0, y0 - 50, x0, y0 + 50) AS l_bounds"))
    r = table(spark, d, "road").select("road_id", "y", F.expr("array(xa, y, xb, y) AS r_bounds"))
    return spatial_join(f, r, 100.0).groupBy("pid").agg(F.min_by("road_id", F.struct(F.abs(F.col("y0") - F.col("y")), "road_id")).alias("road_id"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM lineitem")
def w3_row_index(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("i"))
