import math

import numpy as np
import plain_heights
import pytest
from pyspark.sql import functions as F

from archspan.functions import planar
from archspan.functions.geometry import azimuth, not_sliver, rd_to_wgs84, register, shoelace, st
from archspan.operators import detect, edges, heights, offset, relational, sequences, spatial


def g(text):
    return st("from_text", F.lit(text))


def one(spark, *columns):
    register(spark)
    return spark.range(1).select(*columns).first()


SQUARE = "POLYGON((0 0,4 0,4 4,0 4,0 0))"


def test_overlay_cases(spark):
    a, b = g("POLYGON((0 0,2 0,2 2,0 2,0 0))"), g("POLYGON((1 0,2 0,2 1,1 1,1 0))")
    far, empty = g("POLYGON((9 9,10 9,10 10,9 10,9 9))"), g("POLYGON EMPTY")
    r = one(spark, st("area", st("difference", a, b)), st("area", st("difference", a, far)), st("is_empty", st("difference", a, a)), st("area", st("difference", a, empty)),
            st("is_empty", st("union_all", F.array().cast("array<binary>"))), st("area", st("union_all", F.array(F.lit(None).cast("binary"), empty, b))))
    assert tuple(r) == (3.0, 4.0, True, 4.0, True, 1.0)
    r = one(spark, not_sliver(g("POLYGON((0 0,.1 0,.1 .1,0 .1,0 0))"), 0.2), not_sliver(a, 0.2))
    assert tuple(r) == (False, True)


def test_snap_and_detect(spark):
    a, b = g("POLYGON((0 0,.999 0,.999 1,0 1,0 0))"), g("POLYGON((1.001 0,2 0,2 1,1.001 1,1.001 0))")
    r = one(spark, st("is_empty", st("snap", a, b, 0.01)), st("is_empty", st("snap", b, a, 0.01)), F.size(st("detect_step", a, a, 0.01)), F.size(st("detect_step", a, g("POLYGON EMPTY"), 0.01)))
    assert tuple(r) == (False, False, 0, 0)


def test_line_overlay_lengths_add_up(spark):
    a, b = g("LINESTRING(0 0,10 0)"), g("LINESTRING(4 0,6 0)")
    r = one(spark, st("length", st("line_difference", a, b, 0.001)), st("length", st("line_intersection", a, b, 0.001)), st("is_empty", st("line_intersection", a, g("POINT(3 3)"), 0.001)))
    assert tuple(r) == (8.0, 2.0, True)


def test_functions(spark):
    nested = g("GEOMETRYCOLLECTION(MULTIPOLYGON(((0 0,1 0,1 1,0 1,0 0))),POINT(0 0))")
    r = one(spark, st("is_empty", st("polygon_parts", nested)), st("geometry_type", st("multi", g(SQUARE))), F.size(st("interior_rings", g("POLYGON((0 0,9 0,9 9,0 9,0 0),(1 1,2 1,2 2,1 2,1 1))"))),
            st("covers", g(SQUARE), g("POINT(0 0)")), st("within", g("POINT(0 0)"), g(SQUARE)), st("distance", g("POINT(7 0)"), g(SQUARE)), st("area", F.lit(None).cast("binary")), st("bounds", g("POINT EMPTY")))
    assert tuple(r) == (True, "MultiPolygon", 1, True, False, 3.0, None, None)
    r = one(spark, azimuth(F.lit(1.0), F.lit(0.0)), azimuth(F.lit(-1.0), F.lit(0.0)), shoelace(F.array(*[F.lit(float(v)) for v in (0, 0, 0, 2, 2, 2, 2, 0, 0, 0)])))
    assert r[0] == pytest.approx(math.pi / 2) and r[1] == pytest.approx(3 * math.pi / 2) and r[2] == -4.0
    lon, lat = rd_to_wgs84(F.lit(155000.0), F.lit(463000.0))
    r = one(spark, lon, lat)
    assert r[0] == pytest.approx(5.3872, abs=1e-3) and r[1] == pytest.approx(52.1552, abs=1e-3)


def ring(points, movable):
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (*p, *q), strict=True)], F.lit(m).alias("movable")) for p, q, m in zip(points, points[1:] + points[:1], movable, strict=True)])


@pytest.mark.parametrize("strategy", ["linework", "boolean_patch"])
def test_offset_of_a_square(spark, strategy):
    register(spark)
    df = spark.range(1).select(ring([(0, 0), (4, 0), (4, 4), (0, 4)], [False, True, True, False]).alias("ring"))
    r = offset.offset_polygons(df, 1.0, strategy).select(st("same_shape", "geom", g("POLYGON((0 0,5 0,5 5,0 5,0 0))")), "skip_reason").first()
    assert tuple(r) == (True, None)


def test_offset_reasons(spark):
    register(spark)
    rings = [ring([(0, 0), (4, 0), (4, 4)], [False] * 3), ring([(0, 0), (0, 0), (4, 4)], [True] * 3), ring([(0, 0), (4, 0)], [True] * 2)]
    got = [offset.offset_polygons(spark.range(1).select(x.alias("ring")), 1.0).first()["skip_reason"] for x in rings]
    assert got == ["no_movable_edges", "geometry_offset_failed", "invalid_input_polygon"]
    with pytest.raises(ValueError):
        offset.offset_polygons(spark.range(1).select(rings[0].alias("ring")), 1.0, "other")


def test_moved_edges_lie_on_the_new_boundary(spark):
    register(spark)
    pts, d = [(0, 0), (10, 0), (10, 3), (4, 3), (4, 9), (0, 9)], 0.25
    df = spark.range(1).select(ring(pts, [False, True, True, True, False, True]).alias("ring"))
    out = offset.offset_polygons(df, d)
    moved = F.transform(F.filter("ring", lambda s: s["movable"]), lambda s: planar.offset(s["x1"], s["y1"], s["x2"], s["y2"], d))
    mid = F.transform(moved, lambda m: st("distance", st("point_of", (m["x1"] + m["x2"]) / 2, (m["y1"] + m["y2"]) / 2), st("boundary", "geom")))
    r = out.select(st("is_valid", "geom"), mid.alias("d")).first()
    assert r[0] and max(r["d"]) < 1e-6


def test_broken_geometry_costs_its_row_alone(spark):
    register(spark)
    square, bow = "POLYGON((0 0,2 0,2 2,0 2,0 0))", "POLYGON((0 0,2 2,2 0,0 2,0 0))"
    rows = spark.createDataFrame([(1, square, square), (2, bow, square), (3, None, square)], "k int, a string, b string")
    g = rows.select("k", st("from_text", "a").alias("a"), st("from_text", "b").alias("b"))
    cut = g.where("k = 1").select(F.lit(4).alias("k"), F.expr("substring(a, 1, 20)").alias("a"), "b").unionByName(g.where("k = 1").select(F.lit(5).alias("k"), F.lit(b"").alias("a"), "b"))
    every = g.unionByName(cut)
    told = every.select("k", st("readable", "a").alias("ok"), st("is_empty", st("difference", "a", "b")).alias("gone"), st("area", "a").alias("area"), (st("snap", "a", "b", 0.1) == F.col("a")).alias("same"),
                        F.size(st("detect_step", "a", "b", 0.01)).alias("parts"), st("is_valid", "a").alias("valid"), st("length", st("line_difference", "a", "b", 0.001)).alias("off")).collect()
    by = {r["k"]: r for r in told}
    assert [by[k]["ok"] for k in range(1, 6)] == [True, True, None, False, False]
    assert by[1]["gone"] and by[4]["gone"] and by[5]["gone"] and by[3]["gone"] is None
    assert by[1]["area"] == 4 and by[4]["area"] is None and by[4]["same"] and by[4]["parts"] == 0 and by[2]["valid"] is False and by[4]["off"] == 0
    joined = every.select(F.col("k").cast("string").alias("identificatie"), F.col("a").alias("registry"), F.col("b").alias("topo"))
    assert detect.differences(joined).count() <= 2 and detect.snapped_differences(joined.where("registry IS NOT NULL")).count() <= 1
    assert every.where(~st("readable", "a")).count() == 2  # such rows can be counted


def test_points_in_concave_ring(spark):
    pts = [(0, 0), (8, 0), (8, 4), (4, 2), (0, 4)]
    rng = np.random.default_rng(1)
    xy = rng.uniform([-1, -1], [9, 5], (2000, 2))
    edge = spark.createDataFrame([(1, *map(float, p), *map(float, q)) for p, q in zip(pts, pts[1:] + pts[:1], strict=True)], "pid int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "point_id int, x double, y double")

    def naive(x, y):
        odd = False
        for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    want = {i for i, (a, b) in enumerate(xy) if naive(a, b)}
    for prepared in (True, False):
        for size in (0.7, 3.0):
            got = {r["point_id"] for r in spatial.points_in_polygons(points, spatial.ring_edges(edge, "pid"), size, prepared).collect()}
            assert got == want


def test_spatial_join_has_each_pair_once(spark):
    rng = np.random.default_rng(2)
    lo = rng.uniform(0, 50, (60, 2))
    box = np.concatenate([lo, lo + rng.uniform(0, 20, (60, 2)) * np.repeat([0.01, 1, 60], 20)[:, None]], 1)  # some are points nearly, some larger than all others together
    df = spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(box)], "id int, b array<double>")
    out = spatial.spatial_join(df.select(F.col("id").alias("a"), F.col("b").alias("l_bounds")), df.select(F.col("id").alias("b"), F.col("b").alias("r_bounds")), 7.0)
    got = sorted((r["a"], r["b"]) for r in out.collect())
    want = sorted((i, j) for i in range(60) for j in range(60) if (box[i, :2] <= box[j, 2:]).all() and (box[j, :2] <= box[i, 2:]).all())
    assert got == want
    semi = spatial.spatial_join(df.where("id < 20").select(F.col("id").alias("a"), F.col("b").alias("l_bounds")), df.where("id >= 40").select(F.col("id").alias("b"), F.col("b").alias("r_bounds")), 7.0, how="left_semi")
    assert sorted(r["a"] for r in semi.collect()) == sorted({i for i, j in want if i < 20 and j >= 40})


def test_points_in_polygons_of_very_different_sizes(spark):
    rng = np.random.default_rng(5)
    rings = []
    for k, size in enumerate((0.4, 3, 30, 900)):
        for i in range(3):
            a = np.sort(rng.uniform(0, 2 * np.pi, 9))
            r = size * rng.uniform(0.4, 1, 9)
            c = rng.uniform(-20, 20, 2)
            rings.append((3 * k + i, np.stack([c[0] + r * np.cos(a), c[1] + r * np.sin(a)], 1)))
    edges_ = [(k, *map(float, p), *map(float, q)) for k, ring in rings for p, q in zip(ring, np.roll(ring, -1, 0))]
    edge = spark.createDataFrame(edges_, "pid int, x1 double, y1 double, x2 double, y2 double")
    xy = np.concatenate([rng.uniform(-30, 30, (1500, 2)), rng.uniform(-900, 900, (500, 2))])
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "point_id int, x double, y double")

    def holds(ring, x, y):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, 0)):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    want = {(i, k) for i, (x, y) in enumerate(xy) for k, ring in rings if holds(ring, x, y)}
    for prepared in (True, False):
        got = spatial.points_in_polygons(points, spatial.ring_edges(edge, "pid"), 1.0, prepared).select("point_id", "pid").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_largest_component():
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (1, 9), (12, 7), (25, 25)):
        for p in (0.0, 0.3, 0.5, 1.0):
            mask = rng.random(shape) < p
            assert heights.largest_component(mask) == plain_heights.flood(mask)


def clouds():
    """Point clouds of many shapes, with bounds: two layers, walls, plateaus, ties, points beyond the bounds, and each error."""
    rng = np.random.default_rng(4)
    box = (0.0, 0.0, 10.0, 8.0)
    out = []
    for n in (30, 300, 3000):
        x, y = rng.uniform(-0.5, 10.5, (2, 2 * n))
        out.append((x, y, np.append(rng.normal(0, 0.03, n), rng.normal(3.5, 0.03, n)), box))
        out.append((x, y, rng.integers(0, 50, 2 * n) * 0.25, box))
        out.append((np.round(x), np.round(y), rng.uniform(0, 5, 2 * n), box))
        out.append((x, y, np.repeat([1.0, 4.0], n), box))
        out.append((x, y, np.repeat(2.0, 2 * n), box))
    x, y = np.repeat(np.arange(8) * 1.25 + 0.1, 400), np.tile(np.arange(400) % 16 * 0.5, 8)
    floor = [(np.tile(np.linspace(0.1, 9.9, 40), 30), np.repeat(np.linspace(0.1, 7.9, 30), 40), np.full(1200, h)) for h in (0.0, 3.0, 6.0)]
    wall = (x, y, np.tile(np.linspace(0, 6, 400), 8))
    side = (np.full(4000, 5.1), np.full(4000, 4.1), np.linspace(0, 6, 4000))
    for parts in ([*floor, wall], [*floor, side], [floor[0], floor[2], side, side], [*floor[1:], wall, side]):
        out.append((*[np.concatenate(c) for c in zip(*parts)], box))
    out.append((np.array([1.0, 10.0]), np.array([8.0, 1.0]), np.array([np.nan, np.inf]), box))
    out.append((x, y, np.where(np.arange(len(x)) % 7, wall[2], np.nan), box))
    out.append((np.array([1.0]), np.array([1.0]), np.array([0.0]), box))
    return out


def test_estimates_equal_the_plain_estimator(spark):
    all_ = clouds()
    group = np.repeat(np.arange(len(all_)), [len(c[0]) for c in all_])
    got = heights.estimate(group, *(np.concatenate([c[k] for c in all_]) for k in range(3)), np.array([c[3] for c in all_]))
    errors = set()
    for i, c in enumerate(all_):
        want = plain_heights.estimate(*c)
        errors.add(want.get("error"))
        assert got["error"][i] == want.get("error"), i
        for k in ("underpass_z", "underpass_dh", "top_area", "bottom_area"):
            assert got[k][i] == pytest.approx(want.get(k)), (i, k)
        if got["peaks"][i]:
            assert [{k: pytest.approx(v) if isinstance(v, float) else v for k, v in p.items()} for p in want["peaks"]] == got["peaks"][i], i
    assert len(errors) == 3  # none, too few peaks, no finite points
    rows = [(i, float(a), float(b), float(h)) for i, c in enumerate(all_) for a, b, h in zip(*c[:3])]
    points = spark.createDataFrame(rows, "k int, x double, y double, z double")
    boxes = spark.createDataFrame([(i, list(c[3])) for i, c in enumerate(all_)] + [(99, [0.0] * 4)], "k int, bounds array<double>")
    told = {r["k"]: r for r in heights.estimate_heights(points, boxes, "k", 2, 5000).collect()}
    assert told[99]["status"] == "no_points" and told[len(all_) - 1]["status"] == "too_few_points" and "too_many_points" in {r["status"] for r in told.values()}
    for i, c in enumerate(all_):
        if told[i]["status"] in ("success", "failed"):
            assert told[i]["error"] == got["error"][i] and told[i]["underpass_z"] == got["underpass_z"][i]


def test_estimate_without_points():
    told = heights.estimate(np.zeros(0, int), *np.zeros((3, 0)), np.zeros((1, 4)))
    assert told["error"] == [heights.NONE_FINITE]


def test_peaks_are_separated_and_ranked():
    n = np.zeros(100)
    n[[10, 15, 50, 99]] = [50, 40, 90, 10]
    s = heights.smoothed_counts(n[None])
    found = [int(x) for x in heights.separated_maxima(s)[0] if x >= 0]
    assert found == plain_heights.peaks(n)[1] and found[0] == 50 and 15 not in found
    assert heights.refined_bins(np.array([[0, 3, 3, 0, 0.0]]), np.array([[0, 2, 3, 2, 0.0]]), np.array([2]))[0] == 2
    rng = np.random.default_rng(7)
    for _ in range(200):  # plateaus and ties
        n = rng.integers(0, 4, 100).astype(float)
        s, want = plain_heights.peaks(n)
        assert [x for x in heights.separated_maxima(s[None])[0].tolist() if x >= 0] == want
        assert heights.refined_bins(np.tile(n, (len(want), 1)), np.tile(s, (len(want), 1)), np.array(want)).tolist() == [plain_heights.refined(n, s, p) for p in want]


def test_components_of_far_cells(spark):
    cells = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("a", 900_000, 900_000), ("b", 5, -3), ("b", 5, -3), (None, 0, 0)], "k string, row int, col int")
    assert {(r["k"], r["area"]) for r in heights.component_areas(cells, ["k"], 1.0).collect()} == {("a", 2.0), ("b", 1.0), (None, 1.0)}
    assert heights.component_areas(cells.where("false"), ["k"], 1.0).count() == 0


@pytest.mark.parametrize("partitions", [3, 4, 200])
def test_numbers_are_consecutive_at_any_partition_count(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.range(0, 50_000, 1, 7).select(((F.col("id") * 7919) % 50_021).alias("k"), F.repeat(F.lit("x"), F.lit(200)).alias("wide"))
        got = sequences.numbered(df, ["k"]).select("k", "id")
        r = got.agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id")).first()
        assert tuple(r) == (50_000, 50_000, 1, 50_000)
        assert [x["k"] for x in got.orderBy("id").collect()] == sorted(x["k"] for x in df.select("k").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_numbered_and_islands(spark):
    df = spark.range(100).select(((F.col("id") * 37) % 101).alias("k"))
    got = sequences.numbered(df, ["k"]).orderBy("k").collect()
    assert [r["id"] for r in got] == list(range(1, 101)) and [r["k"] for r in got] == sorted(r["k"] for r in got)
    flags = spark.createDataFrame([(1, i, f) for i, f in enumerate([True, False, True, True])] + [(2, i, True) for i in range(3)], "key int, at int, m boolean")
    got = {(r["key"], r["at"], r["island"]) for r in sequences.cyclic_islands(flags, ["key"], "at", "m").collect()}
    assert got == {(1, 0, 2), (1, 2, 2), (1, 3, 2), (2, 0, -1), (2, 1, -1), (2, 2, -1)}


def test_relational_edge_cases(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "z"), (3, "y")], "k int, v string")
    assert sorted(map(tuple, relational.insert_if_absent(t, new, ["k"]).collect())) == [(1, "a"), (2, None), (3, "y")]
    up = relational.keyed_update(t, spark.createDataFrame([(1, None)], "k int, v string"), ["k"], ["v"])
    assert sorted(map(tuple, up.collect())) == [(1, None), (2, None)]
    assert relational.unprocessed(t.limit(0), (t, ["k"])).count() == 0


def test_pass_through_is_null_without_exterior_edges(spark):
    e = spark.createDataFrame([(1, "exterior", 0.0, 0.0, 1.0, 0.0), (2, "exterior", 0.0, 0.0, 1.0, 0.0), (2, "exterior", 1.0, 1.0, 0.0, 1.0), (3, "interior", 0.0, 0.0, 1.0, 0.0)], "underpass_id int, edge_type string, x1 double, y1 double, x2 double, y2 double")
    got = {r[0]: r[1] for r in edges.pass_through(spark.range(1, 4).select(F.col("id").cast("int").alias("underpass_id")), e).collect()}
    assert got == {1: False, 2: True, 3: None}


def test_empty_topo_keeps_the_registry_polygon(spark):
    register(spark)
    j = spark.range(1).select(F.lit("a").alias("identificatie"), g(SQUARE).alias("registry"), g("POLYGON EMPTY").alias("topo"))
    assert detect.differences(j).select(st("area", "geom")).first()[0] == 16.0
    assert detect.snapped_differences(j).count() == 0
