"""Queries of detection, edges, offset and the geometry functions; facts with closed forms, so that SQL can tell them too."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import planar
from ..functions.geometry import not_sliver, rectangle, register, shoelace, st
from ..operators import detect, edges, offset
from .registry import query
from .synth import oracle, table


def _buildings(spark, d):
    register(spark)
    f = table(spark, d, "footprint")
    x, y, w, h, cut = (F.col(c) for c in ("x0", "y0", "w", "h", "cut"))
    half = F.floor(w / 2)
    return f.select("pid", "identificatie", "key", "w", "h", "cut", rectangle(x, y, x + w, y + h).alias("geom"), rectangle(x, y, x + half, y + h).alias("t1"), rectangle(x + half, y, x + w - cut, y + h).alias("t2"),
                    rectangle(x, y, x + w - cut, y + h).alias("topo"), rectangle(x + w - cut, y, x + w, y + h).alias("strip"))


def _joined(spark, d):
    b = _buildings(spark, d)
    topo = b.select("key", F.col("t1").alias("geom")).unionByName(b.select("key", F.col("t2").alias("geom")))
    return detect.join_registers(b.select("identificatie", "geom"), topo)


@query(oracle("SELECT identificatie, sum(cut * h) AS area, count(*) AS n_parts FROM footprint WHERE cut > 0.4e0 GROUP BY identificatie"))
def m0_underpass_area(spark, d):
    """The flagship: registers joined, both snapped differences, parts that pass the sliver filter, and their area by building."""
    parts = detect.snapped_differences(_joined(spark, d)).where(not_sliver(F.col("geom"), detect.SLIVER))
    return parts.groupBy("identificatie").agg(F.sum(st("area", "geom")).alias("area"), F.count("*").alias("n_parts"))


@query(oracle("SELECT identificatie, (w - cut) * h AS area FROM footprint"))
def d1_registers_joined(spark, d):
    return _joined(spark, d).select("identificatie", st("area", "topo").alias("area"))


@query(oracle("SELECT identificatie, cut * h AS area FROM footprint WHERE cut > 0.4e0"))
def d2_differences(spark, d):
    return detect.differences(_joined(spark, d)).select("identificatie", st("area", "geom").alias("area"))


@query(oracle("SELECT identificatie, cut * h AS area FROM footprint WHERE cut > 0"))
def d3_snapped_differences(spark, d):
    return detect.snapped_differences(_joined(spark, d)).select("identificatie", st("area", "geom").alias("area"))


@query(oracle("SELECT row_number() OVER (ORDER BY identificatie) AS underpass_id, identificatie, cut * h AS area FROM footprint WHERE cut > 0.4e0"))
def d4_underpasses(spark, d):
    parts = detect.snapped_differences(_joined(spark, d))
    return detect.underpasses(parts).select(F.col("underpass_id").cast("long").alias("underpass_id"), "identificatie", st("area", "geom").alias("area"))


@query(oracle("SELECT count(*) FILTER (WHERE cut > 0.4e0) AS n_kept, count(*) FILTER (WHERE cut > 0 AND cut <= 0.4e0) AS n_slivers, count(*) FILTER (WHERE cut = 0) AS n_empty FROM footprint"))
def f1_f2_sliver_filter(spark, d):
    g = _buildings(spark, d).select(st("difference", "geom", "topo").alias("g")).select(F.explode(F.array(F.struct(st("is_empty", "g").alias("empty"), not_sliver(F.col("g"), 0.2).alias("ok")))).alias("f"))
    return g.agg(F.count_if(F.col("f.ok")).alias("n_kept"), F.count_if(~F.col("f.ok") & ~F.col("f.empty")).alias("n_slivers"), F.count_if(F.col("f.empty")).alias("n_empty"))


@query(oracle("SELECT pid, round(w * h, 6) AS area, round(2 * (w + h), 6) AS length, true AS valid, 1 AS parts, 5 AS points, 'Polygon' AS kind, round(x0 + w / 2, 6) AS cx, round(w * h, 6) AS shoelace, x0 AS min_x, y0 + h AS max_y FROM footprint"))
def g22_g25_measures(spark, d):
    b = _buildings(spark, d)
    return b.select(
        "pid", F.round(st("area", "geom"), 6).alias("area"), F.round(st("length", "geom"), 6).alias("length"), st("is_valid", "geom").alias("valid"), st("num_parts", "geom").alias("parts"),
        st("num_points", "geom").alias("points"), st("geometry_type", "geom").alias("kind"), F.round(st("bounds", st("centroid", "geom"))[0], 6).alias("cx"),
        F.round(shoelace(st("coordinates", st("orient", "geom"))), 6).alias("shoelace"), st("bounds", "geom")[0].alias("min_x"), st("bounds", "geom")[3].alias("max_y"),
    )


@query(oracle("SELECT pid, cut * h AS difference, (w - cut) * h AS intersection, w * h AS union_area, CASE WHEN cut > 0 THEN 1 ELSE 0 END AS parts FROM footprint"))
def g1_g5_overlay(spark, d):
    b = _buildings(spark, d)
    return b.select(
        "pid", st("area", st("difference", "geom", "topo")).alias("difference"), st("area", st("intersection", "geom", "topo")).alias("intersection"),
        st("area", st("union_all", F.array("topo", "geom"))).alias("union_area"), F.size(st("dump", st("multi", st("difference", "geom", "topo")))).alias("parts"),
    )


@query(oracle("SELECT pid, h + 2 * cut AS off_ring, h AS on_ring FROM footprint WHERE cut > 0"))
def g2_g3_line_overlay(spark, d):
    b = _buildings(spark, d).where("cut > 0")
    ring, topo = st("exterior_ring", "strip"), st("exterior_ring", "topo")
    length = lambda g: F.round(st("length", g), 6)
    on = st("line_intersection", ring, topo, 0.001)
    return b.select("pid", length(st("line_difference", ring, topo, 0.001)).alias("off_ring"), length(on).alias("on_ring"))


@query(oracle("SELECT pid, round((w - 0.4e0) * (h - 0.4e0), 6) AS eroded, round((w - 4e-1) * (h - 4e-1) - 4, 6) AS cropped, w * h AS built, w * h AS gridded, true AS inside FROM footprint"))
def g8_g24_shapes(spark, d):
    b = _buildings(spark, d).join(table(spark, d, "footprint").select("pid", "x0", "y0"), "pid")
    x, y = F.col("x0") + 2, F.col("y0") + 2
    holed = st("difference", "geom", rectangle(x, y, x + 2, y + 2))
    return b.select(
        "pid", F.round(st("area", st("buffer", "geom", -0.2)), 6).alias("eroded"), F.round(st("area", st("crop_buffer", holed, -0.2)), 6).alias("cropped"),
        st("area", st("build_area", st("exterior_ring", "geom"))).alias("built"), st("area", st("simplify", st("snap_grid", st("make_valid", "geom"), 0.25), 0.2)).alias("gridded"),
        st("within", st("point_on_surface", "geom"), "geom").alias("inside"),
    )


@query(oracle("SELECT pid, 'LINESTRING (0 0, 1 1)' AS line, 3 AS merged, w * h AS round_trip, true AS same FROM footprint"))
def g13_g28_codecs(spark, d):
    b = _buildings(spark, d)
    lines = F.array(st("from_text", F.lit("LINESTRING(0 0,1 0)")), st("from_text", F.lit("LINESTRING(1 0,2 0)")))
    return b.select(
        "pid", st("as_text", st("from_text", F.lit("LINESTRING(0 0,1 1)"))).alias("line"), st("num_points", st("line_merge", st("union_lines", lines))).alias("merged"),
        st("area", st("from_text", st("as_text", st("drop_z", "geom")))).alias("round_trip"), st("same_shape", "geom", st("polygon_parts", "geom")).alias("same"),
    )


_EDGE_KINDS = oracle("""SELECT pid, 'interior' AS edge_type, h AS length FROM footprint WHERE cut > 0.4e0 UNION ALL
SELECT pid, 'exterior', 2 * cut + h FROM footprint WHERE cut > 0.4e0 AND pid % 2 = 0 UNION ALL
SELECT pid, 'exterior', 2 * cut FROM footprint WHERE cut > 0.4e0 AND pid % 2 = 1 UNION ALL SELECT pid, 'shared', h FROM footprint WHERE cut > 0.4e0 AND pid % 2 = 1""")


def _edge_lengths(spark, d, by_ring):
    b = _buildings(spark, d).where("cut > 0.4").join(table(spark, d, "footprint").select("pid", "x0", "y0"), "pid")
    x, y = F.col("x0") + F.col("w"), F.col("y0")
    near = b.where("pid % 2 = 1").select("identificatie", rectangle(x, y, x + 5, y + F.col("h")).alias("geom"))
    out = edges.classify(b.select(F.col("pid").alias("underpass_id"), "identificatie", F.col("strip").alias("geom"), "topo"), near, by_ring=by_ring)
    return out.groupBy(F.col("underpass_id").alias("pid"), "edge_type").agg(F.round(F.sum(st("length", "geom")), 6).alias("length"))


@query(_EDGE_KINDS)
def d5_edges_by_area(spark, d):
    """Every other building has a neighbour along its right side."""
    return _edge_lengths(spark, d, False)


@query(_EDGE_KINDS)
def d6_edges_by_ring(spark, d):
    return _edge_lengths(spark, d, True)


@query(oracle("""WITH a AS (SELECT underpass_id, CASE WHEN atan2(x2 - x1, y2 - y1) < 0 THEN atan2(x2 - x1, y2 - y1) + 2 * pi() ELSE atan2(x2 - x1, y2 - y1) END + pi() / 2 AS az FROM kind WHERE edge_type = 'exterior'),
s AS (SELECT underpass_id, count(*) AS n, sqrt(stddev_samp(cos(az)) ** 2 + stddev_samp(sin(az)) ** 2) AS v FROM a GROUP BY underpass_id)
SELECT f.pid AS underpass_id, CASE WHEN s.n IS NULL THEN NULL WHEN s.n = 1 THEN false ELSE s.v >= 0.7 END AS pass_through FROM footprint f LEFT JOIN s ON s.underpass_id = f.pid"""))
def d8_pass_through(spark, d):
    u = table(spark, d, "footprint").select(F.col("pid").alias("underpass_id"))
    return edges.pass_through(u, table(spark, d, "kind"))


@query(oracle("SELECT underpass_id, count(*) AS n, sum(CASE WHEN edge_type = 'exterior' THEN 1 ELSE 0 END)::BIGINT AS n_movable, CAST(0 AS BIGINT) AS unmatched FROM kind GROUP BY underpass_id"))
def d9_ring_classification(spark, d):
    k = table(spark, d, "kind").withColumnRenamed("underpass_id", "key")
    turned = k.where("edge_type <> 'exterior'").select("key", F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    out = offset.classified_ring(k.select("key", "x1", "y1", "x2", "y2"), k.where("edge_type = 'exterior'").select("key", "x1", "y1", "x2", "y2"), turned)
    return out.withColumnRenamed("key", "underpass_id").select("underpass_id", "n", F.col("n_movable").cast("long").alias("n_movable"), "unmatched")


@query(oracle("""SELECT pid, CASE WHEN pid % 5 <> 4 THEN 10 END AS n, CASE WHEN pid % 5 <> 4 THEN 3 END AS n_movable, CASE WHEN pid % 5 <> 4 THEN w * 4 + 4 * (h - 4) - 1 END AS area,
CASE WHEN pid % 5 = 4 THEN 'edge_matching_failed' END AS reason FROM footprint"""))
def d9_classified_polygons(spark, d):
    """L-shaped rings with a square hole from loose edges, some turned round; one edge is lost in every fifth."""
    register(spark)
    e = table(spark, d, "edge").select(F.col("pid").alias("key"), "seq", "x1", "y1", "x2", "y2")
    f = table(spark, d, "footprint")
    x, y = F.col("x0") + 1, F.col("y0") + 1
    hole = f.select(F.col("pid").alias("key"), F.inline(F.array(*[F.struct(F.lit(10 + i).alias("seq"), a.alias("x1"), b.alias("y1"), c.alias("x2"), g.alias("y2")) for i, (a, b, c, g) in enumerate([(x, y, x + 1, y), (x + 1, y, x + 1, y + 1), (x + 1, y + 1, x, y + 1), (x, y + 1, x, y)])])))
    every = e.unionByName(hole).where("NOT (key % 5 = 4 AND seq = 2)")
    turn = (F.col("key") + F.col("seq")) % 2 == 0
    swap = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a)).alias(a)
    loose = every.select("key", swap("x1", "x2"), swap("y1", "y2"), swap("x2", "x1"), swap("y2", "y1"), F.col("seq").isin(1, 3, 11).alias("movable"))
    out = offset.classified_rings(loose)
    flat = F.flatten("rings")
    area = offset.shell_less_holes(F.transform("rings", offset.ring_polygon))
    return out.select(F.col("key").alias("pid"), F.when(flat.isNotNull(), F.size(flat)).alias("n"), F.when(flat.isNotNull(), F.size(F.filter(flat, lambda s: s["movable"]))).alias("n_movable"), F.round(st("area", area), 6).alias("area"), "reason")


def _rings(spark, d):
    f = table(spark, d, "footprint")
    x, y, w, h = F.col("x0"), F.col("y0"), F.col("w"), F.col("h")
    pts = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    move = [F.lit(False), F.col("pid") % 3 != 0, F.col("pid") % 3 != 0, F.lit(False)]
    segs = [F.struct(p[0].alias("x1"), p[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2"), m.alias("movable")) for p, q, m in zip(pts, pts[1:] + pts[:1], move, strict=True)]
    return f.select("pid", "w", "h", F.array(*segs).alias("ring"))


_OFFSET = oracle("SELECT pid, CASE WHEN pid % 3 = 0 THEN NULL ELSE (w + 1) * (h + 1) END AS area, CASE WHEN pid % 3 = 0 THEN 'no_movable_edges' END AS skip_reason FROM footprint")


@query(_OFFSET)
def d12_offset_linework(spark, d):
    """Right and top sides move out by one."""
    register(spark)
    return offset.offset_polygons(_rings(spark, d), 1.0, "linework").select("pid", F.round(st("area", "geom"), 6).alias("area"), "skip_reason")


@query(_OFFSET)
def d11_offset_patches(spark, d):
    register(spark)
    return offset.offset_polygons(_rings(spark, d), 1.0, "boolean_patch").select("pid", F.round(st("area", "geom"), 6).alias("area"), "skip_reason")


def _ring(points, movable):
    """Segments around points, counter-clockwise; movable: a column for each segment."""
    return F.array(*[F.struct(p[0].alias("x1"), p[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2"), m.alias("movable")) for p, q, m in zip(points, points[1:] + points[:1], movable, strict=True)])


def _holed(spark, d):
    """Rectangles with a square hole: the left and right sides are two chains, and the hole's right side moves in every other one."""
    f = table(spark, d, "footprint")
    x, y, w, h = F.col("x0"), F.col("y0"), F.col("w"), F.col("h")
    yes, no, odd = F.lit(True), F.lit(False), F.col("pid") % 2 == 1
    shell = _ring([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], [no, yes, no, yes])
    hole = _ring([(x + 2, y + 2), (x + 4, y + 2), (x + 4, y + 4), (x + 2, y + 4)], [no, odd, no, no])
    return f.select("pid", F.array(shell, hole).alias("rings"))


_HOLED = oracle("SELECT pid, (w + 1) * h - 2 * (2 + 0.5e0 * (pid % 2)) AS area, true AS valid FROM footprint")


@query(_HOLED)
def d11_holes_and_chains(spark, d):
    register(spark)
    return offset.offset_polygons(_holed(spark, d), 0.5).select("pid", F.round(st("area", "geom"), 6).alias("area"), st("is_valid", "geom").alias("valid"))


@query(_HOLED)
def d12_holes_by_linework(spark, d):
    register(spark)
    return offset.offset_polygons(_holed(spark, d), 0.5, "linework").select("pid", F.round(st("area", "geom"), 6).alias("area"), st("is_valid", "geom").alias("valid"))


@query(oracle("SELECT pid, (w - 0.5e0) * h + 3 * 2 AS area FROM footprint"))
def d11_chains_of_a_concave_ring(spark, d):
    """A step is cut into the top; its floor moves up by three, and beside it the right side moves in: two runs with different distances, one behind the other."""
    register(spark)
    f = table(spark, d, "footprint")
    x, y, w, h = F.col("x0"), F.col("y0"), F.col("w"), F.col("h")
    yes, no = F.lit(True), F.lit(False)
    points = [(x, y), (x + w, y), (x + w, y + h), (x + 5, y + h), (x + 5, y + h - 4), (x + 3, y + h - 4), (x + 3, y + h), (x, y + h)]
    up = offset.offset_polygons(f.select("pid", "x0", "y0", "w", "h", _ring(points, [no, no, no, no, yes, no, no, no]).alias("ring")), 3.0)
    area_up = up.select("pid", st("area", "geom").alias("up"))
    back = offset.offset_polygons(f.select("pid", _ring(points, [no, yes, no, no, no, no, no, no]).alias("ring")), -0.5)
    both = area_up.join(back.select("pid", st("area", "geom").alias("back")), "pid").join(f.select("pid", "w", "h"), "pid")
    return both.select("pid", F.round(F.col("up") + F.col("back") - (F.col("w") * F.col("h") - 8) + 8, 6).alias("area"))


@query(oracle("""SELECT CASE pid % 6 WHEN 0 THEN 'no_movable_edges' WHEN 1 THEN 'offset' WHEN 2 THEN 'edge_matching_failed' WHEN 3 THEN 'geometry_offset_failed' WHEN 4 THEN 'invalid_input_polygon'
ELSE 'geometry_offset_failed' END AS outcome, count(*) AS n FROM footprint GROUP BY 1"""))
def d14_skip_reasons(spark, d):
    """Rings that can't be moved: nothing movable, a gap, an edge without length, two edges, and all edges movable."""
    register(spark)
    x, y, w, h, k = F.col("x0"), F.col("y0"), F.col("w"), F.col("h"), F.col("pid") % 6
    pts = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    some = _ring(pts, [F.lit(False), k != 0, F.lit(False), F.lit(False)])
    gap = F.transform(some, lambda s, i: F.when(i == 2, s.withField("x2", s["x2"] + 1)).otherwise(s))
    point = _ring([*pts, pts[3]], [F.lit(True), *[F.lit(False)] * 4])
    every = F.transform(some, lambda s: s.withField("movable", F.lit(True)))
    ring = F.when(k == 2, gap).when(k == 3, point).when(k == 4, F.slice(some, 1, 2)).when(k == 5, every).otherwise(some)
    out = offset.offset_polygons(table(spark, d, "footprint").select("pid", ring.alias("ring")), 0.5)
    return out.select(F.coalesce("skip_reason", F.lit("offset")).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@query(oracle("""SELECT pid, CASE pid % 6 WHEN 0 THEN w * h WHEN 1 THEN (w + 2) * h WHEN 2 THEN w * (h + 1.5e0) END AS area,
CASE pid % 6 WHEN 3 THEN 'an edge has two offsets' WHEN 4 THEN 'an edge index is outside the shell' WHEN 5 THEN 'neighbouring edges are parallel' END AS error FROM footprint"""))
def m5_strict_edge_offsets(spark, d):
    register(spark)
    f = table(spark, d, "footprint")
    x, y, w, h, k = F.col("x0"), F.col("y0"), F.col("w"), F.col("h"), F.col("pid") % 6
    no = F.lit(False)
    pts = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    ring = F.when(k == 5, _ring([*pts[:1], (x + 1, y), *pts[1:]], [no] * 5)).otherwise(_ring(pts, [no] * 4))
    given = lambda *pairs: F.array(*[F.struct(F.lit(e).alias("edge"), F.lit(v).alias("distance")) for e, v in pairs])
    asked = F.when(k == 1, given((1, 2.0))).when(k == 2, given((0, 0.5), (2, 1.0))).when(k == 3, given((1, 1.0), (1, 2.0))).when(k == 4, given((9, 1.0))).when(k == 5, given((2, 1.0)))
    out = offset.offset_edges(f.select("pid", ring.alias("ring")), f.select("pid", F.inline(asked)), "pid")
    return out.select("pid", F.round(st("area", "geom"), 6).alias("area"), "error")


@query(oracle("SELECT pid, w * h AS area FROM footprint"))
def d13_zero_offset(spark, d):
    register(spark)
    return offset.offset_polygons(_rings(spark, d), 0.0).select("pid", st("area", "geom").alias("area"))


@query(oracle("SELECT pid, seq, x1 + (y2 - y1) / (abs(x2 - x1) + abs(y2 - y1)) AS ox1, y1 - (x2 - x1) / (abs(x2 - x1) + abs(y2 - y1)) AS oy1 FROM edge"))
def m1_offset_lines(spark, d):
    o = planar.offset(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), 1.0)
    return table(spark, d, "edge").select("pid", "seq", o.alias("o")).select("pid", "seq", F.col("o.x1").alias("ox1"), F.col("o.y1").alias("oy1"))


@query(oracle("SELECT a.pid, a.seq, CASE WHEN (a.x1 = a.x2) <> (b.x1 = b.x2) THEN a.x2 END AS x, CASE WHEN (a.x1 = a.x2) <> (b.x1 = b.x2) THEN a.y2 END AS y FROM edge a JOIN edge b ON a.pid = b.pid AND b.seq = (a.seq + 1) % 6"))
def m2_m3_line_meets(spark, d):
    e = table(spark, d, "edge")
    b = e.select("pid", ((F.col("seq") + 5) % 6).alias("seq"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    c = {n: F.col(n) for n in ("x1", "y1", "x2", "y2", "b_x1", "b_y1", "b_x2", "b_y2")}
    m = planar.meet(c["x1"], c["y1"], c["x2"] - c["x1"], c["y2"] - c["y1"], c["b_x1"], c["b_y1"], c["b_x2"] - c["b_x1"], c["b_y2"] - c["b_y1"])
    m = planar.miter(m, c["x2"], c["y2"], 1.0)
    return e.join(b, ["pid", "seq"]).select("pid", "seq", m.alias("m")).select("pid", "seq", "m.x", "m.y")


@query(oracle("SELECT pid, count(*) AS n FROM (SELECT DISTINCT pid, least(x1, x2), greatest(x1, x2), least(y1, y2), greatest(y1, y2) FROM edge) GROUP BY pid"))
def m6_segment_keys(spark, d):
    e = table(spark, d, "edge")
    k = planar.segment_key(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    back = planar.segment_key(*[F.col(c) for c in ("x2", "y2", "x1", "y1")])
    both = e.select("pid", k.alias("k")).unionByName(e.select("pid", back.alias("k")))
    return both.distinct().groupBy("pid").agg(F.count("*").alias("n"))


@query(oracle("SELECT pid, seq FROM edge WHERE sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) >= 9"))
def f6_long_edges(spark, d):
    return table(spark, d, "edge").where(edges.long_enough(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], 9.0)).select("pid", "seq")


def _corners(f, *points):
    """The polygon through points (x, y offsets as columns) of footprints."""
    xy = [c for px, py in [*points, points[0]] for c in (F.col("x0") + px, F.col("y0") + py)]
    return f.withColumn("geom", st("polygon_of", F.array(*xy)))


def _ells(spark, d):
    """Concave L-shaped polygons, as the edge table has them."""
    register(spark)
    w, h, n = F.col("w"), F.col("h"), lambda v: F.lit(float(v))
    return _corners(table(spark, d, "footprint"), (n(0), n(0)), (w, n(0)), (w, n(4)), (n(4), n(4)), (n(4), h), (n(0), h))


@query(oracle("SELECT pid, w * h / 4 AS difference, 2 AS parts, w * h / 4 AS intersection, w * h * 5 / 8 AS union_area, w * h / 2 AS area, 4 AS points FROM footprint"))
def g1_triangles(spark, d):
    """Triangles and a rectangle whose far corner is the middle of their long side: what is left has two parts that touch in a point."""
    register(spark)
    f = table(spark, d, "footprint")
    w, h, zero = F.col("w"), F.col("h"), F.lit(0.0)
    t = _corners(f, (zero, zero), (w, zero), (zero, h)).withColumnRenamed("geom", "t")
    t = t.withColumn("inner", rectangle(F.col("x0"), F.col("y0"), F.col("x0") + w / 2, F.col("y0") + h / 2)).withColumn("over", rectangle(F.col("x0"), F.col("y0"), F.col("x0") + w / 2, F.col("y0") + h))
    area = lambda g: F.round(st("area", g), 6)
    cut = st("difference", "t", "inner")
    return t.select(
        "pid", area(cut).alias("difference"), F.size(st("dump", cut)).alias("parts"), area(st("intersection", "t", "inner")).alias("intersection"),
        area(st("union_all", F.array("t", "over"))).alias("union_area"), area(F.col("t")).alias("area"), st("num_points", "t").alias("points"),
    )


@query(oracle("SELECT identificatie, 2 AS parts, least(w, 2 * w + 4 * (h - 4)) AS least_area, greatest(w, 2 * w + 4 * (h - 4)) AS greatest_area FROM footprint"))
def d4_parts_of_concave_buildings(spark, d):
    """A topographic band through an L-shaped building leaves two underpasses of it."""
    b = _ells(spark, d)
    topo = b.select("key", rectangle(F.col("x0") - 1, F.col("y0") + 1, F.col("x0") + F.col("w") + 1, F.col("y0") + 2).alias("geom"))
    parts = detect.snapped_differences(detect.join_registers(b.select("identificatie", "geom"), topo))
    u = detect.underpasses(parts).select("identificatie", F.round(st("area", "geom"), 6).alias("area"))
    return u.groupBy("identificatie").agg(F.count("*").cast("int").alias("parts"), F.min("area").alias("least_area"), F.max("area").alias("greatest_area"))


@query(oracle("""SELECT pid, round((w - 0.4e0) * 3.6e0 + 3.6e0 * (h - 4) + 0.04e0 * (1 - 4 * sin(pi() / 16)), 6) AS eroded, w * 4 + 4 * (h - 4) AS area, 2 * (w + h) AS length, true AS valid, false AS centre_of_box_inside FROM footprint WHERE w > 8 AND h > 8"""))
def g8_concave_measures(spark, d):
    """Erosion, area and outline of concave polygons, whose box has its centre outside of them; the inner corner is rounded in eight steps."""
    b = _ells(spark, d).where("w > 8 AND h > 8")
    centre = st("point_of", F.col("x0") + F.col("w") / 2, F.col("y0") + F.col("h") / 2)
    rounded = lambda g: F.round(g, 6)
    return b.select(
        "pid", rounded(st("area", st("buffer", "geom", -0.2))).alias("eroded"), rounded(st("area", "geom")).alias("area"), rounded(st("length", "geom")).alias("length"),
        st("is_valid", "geom").alias("valid"), st("covers", "geom", centre).alias("centre_of_box_inside"),
    )


@query(oracle("""SELECT CASE WHEN pid % 5 = 0 THEN 'unreadable' WHEN pid % 5 = 1 THEN 'invalid' ELSE 'sound' END AS kind, count(*) AS n, CAST(count(*) FILTER (WHERE pid % 5 > 1 AND cut > 0) AS BIGINT) AS n_left,
sum(CASE WHEN pid % 5 > 1 THEN cut * h END) AS area FROM footprint GROUP BY 1"""))
def g1_broken_rows(spark, d):
    """Every fifth geometry is cut off and every fifth a bow tie: those give empty differences, are told apart, and stop nothing."""
    b = _buildings(spark, d).join(table(spark, d, "footprint").select("pid", "x0", "y0"), "pid")
    x, y, w, h, k = F.col("x0"), F.col("y0"), F.col("w"), F.col("h"), F.col("pid") % 5
    bow = st("polygon_of", F.array(x, y, x + w, y + h, x + w, y, x, y + h, x, y))
    b = b.withColumn("geom", F.when(k == 0, F.expr("substring(geom, 1, 30)")).when(k == 1, bow).otherwise(F.col("geom")))
    told = b.select("cut", k.alias("k"), st("readable", "geom").alias("ok"), st("is_valid", "geom").alias("valid"), st("difference", "geom", "topo").alias("d"))
    kind = F.when(~F.col("ok"), "unreadable").when(~F.col("valid"), "invalid").otherwise("sound")
    sound = F.col("k") > 1
    return told.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_if(sound & ~st("is_empty", "d")).alias("n_left"), F.sum(F.when(sound, st("area", "d"))).alias("area"))
