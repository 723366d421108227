"""Outward offset of a polygon's movable edges alone, its ring being an array of struct(x1, y1, x2, y2, movable)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import planar
from ..functions.binding import bind, once
from ..functions.geometry import st

MITER = 10.0


def _line(s: Column, d: float) -> Column:
    """struct(px, py, ux, uy): the support line of a segment, moved if it is movable."""
    n = F.sqrt((s["x2"] - s["x1"]) ** 2 + (s["y2"] - s["y1"]) ** 2)
    ux, uy = (s["x2"] - s["x1"]) / n, (s["y2"] - s["y1"]) / n
    m = F.when(s["movable"], d).otherwise(0.0)
    return F.struct((s["x1"] + uy * m).alias("px"), (s["y1"] - ux * m).alias("py"), ux.alias("ux"), uy.alias("uy"))


def _foot(x: Column, y: Column, line: Column) -> Column:
    t = (x - line["px"]) * line["ux"] + (y - line["py"]) * line["uy"]
    return F.struct((line["px"] + t * line["ux"]).alias("x"), (line["py"] + t * line["uy"]).alias("y"))


def offset_ring(ring: Column, d: float, tolerance: float = 1e-6) -> Column:
    """Vertices of the ring after the offset."""
    return F.flatten(offset_corners(ring, d, tolerance))


def offset_corners(ring: Column, d: float, tolerance: float = 1e-6) -> Column:
    """For each vertex of the ring what becomes of it: neighbours' lines meet; beyond the miter limit, and between parallels that don't coincide, a connector of two feet."""
    n = F.size(ring)

    def resolved(c: Column) -> Column:
        a, b, x, y = c["a"], c["b"], c["x"], c["y"]
        meet = planar.miter(planar.meet(a["px"], a["py"], a["ux"], a["uy"], b["px"], b["py"], b["ux"], b["uy"]), x, y, d, MITER)
        feet = F.array(_foot(x, y, a), _foot(x, y, b))
        parallel = F.abs(planar.cross(a["ux"], a["uy"], b["ux"], b["uy"])) <= 1e-9
        one_line = parallel & (F.abs(planar.cross(b["px"] - a["px"], b["py"] - a["py"], a["ux"], a["uy"])) <= tolerance)
        met = bind(meet, lambda m: F.when(m.isNotNull(), F.array(m)).otherwise(feet))
        return F.when(c["fixed"], F.array(F.struct(x.alias("x"), y.alias("y")))).when(one_line, F.slice(feet, 1, 1)).otherwise(met)

    def corner(i: Column) -> Column:
        sides = F.struct(F.get(ring, (i + n - 1) % n).alias("p"), F.get(ring, i).alias("q"))
        lines = lambda s: F.struct(
            _line(s["p"], d).alias("a"), _line(s["q"], d).alias("b"), s["q"]["x1"].alias("x"), s["q"]["y1"].alias("y"), (~s["p"]["movable"] & ~s["q"]["movable"]).alias("fixed")
        )
        return bind(sides, lambda s: bind(lines(s), resolved))

    return F.transform(F.sequence(F.lit(0), n - 1), corner)


def closed(points: Column) -> Column:
    """x, y, x, y, ... of vertices, closed."""
    return F.flatten(F.transform(F.concat(points, F.slice(points, 1, 1)), lambda p: F.array(p["x"], p["y"])))


def skip_reason(ring: Column) -> Column:
    """Why a ring can't be moved, before anything is computed."""
    no_length = F.exists(ring, lambda s: (s["x1"] == s["x2"]) & (s["y1"] == s["y2"]))
    open_ = F.exists(F.sequence(F.lit(0), F.size(ring) - 1), lambda i: (F.get(ring, i)["x2"] != F.get(ring, (i + 1) % F.size(ring))["x1"]) | (F.get(ring, i)["y2"] != F.get(ring, (i + 1) % F.size(ring))["y1"]))
    return F.when(F.size(ring) < 3, "invalid_input_polygon").when(open_, "edge_matching_failed").when(no_length, "geometry_offset_failed")


def chains(ring: Column) -> Column:
    """array of struct(first, n): the runs of movable segments around a ring; none where all or none are movable."""
    n = F.size(ring)
    moves = lambda i: F.get(ring, i % n)["movable"]
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: moves(i) & ~moves(i + n - 1))
    return F.transform(starts, lambda i: F.struct(i.alias("first"), F.array_min(F.filter(F.sequence(F.lit(1), n), lambda k: ~moves(i + k))).alias("n")))


def patches(ring: Column, corners: Column, d: float) -> Column:
    """array of struct(geom, x, y): for each chain the area between it and its new place, and a sample point halfway out from its first segment. corners: offset_corners of the ring."""
    n = F.size(ring)
    at = lambda i: F.get(ring, i % n)

    def patch(c: Column) -> Column:
        places = F.sequence(c["first"], c["first"] + c["n"])
        old = F.transform(places, lambda i: F.struct(at(i)["x1"].alias("x"), at(i)["y1"].alias("y")))
        new = F.flatten(F.transform(places, lambda i: F.get(corners, i % n)))
        s = at(c["first"])
        length = F.sqrt((s["x2"] - s["x1"]) ** 2 + (s["y2"] - s["y1"]) ** 2)
        x, y = (s["x1"] + s["x2"]) / 2 + (s["y2"] - s["y1"]) / length * (d / 2), (s["y1"] + s["y2"]) / 2 - (s["x2"] - s["x1"]) / length * (d / 2)
        return F.struct(st("make_valid", st("polygon_of", closed(F.concat(old, F.reverse(new))))).alias("geom"), x.alias("x"), y.alias("y"))

    return F.transform(chains(ring), patch)


def patched(old: Column, all_patches: Column) -> Column:
    """old with each patch joined, or cut away where its sample point lies on old, one behind the other."""

    def apply(g: Column, p: Column) -> Column:
        inside = st("covers", old, st("point_of", p["x"], p["y"]))
        return F.when(st("area", p["geom"]) <= 1e-9, g).when(inside, st("difference", g, p["geom"])).otherwise(st("union_all", F.array(g, p["geom"])))

    return F.aggregate(all_patches, old, apply)


def ring_polygon(ring: Column) -> Column:
    return st("polygon_of", closed(F.transform(ring, lambda s: F.struct(s["x1"].alias("x"), s["y1"].alias("y")))))


def shell_less_holes(polygons: Column) -> Column:
    """The first of an array of polygons less the others."""
    shell, holes = F.get(polygons, F.lit(0)), F.slice(polygons, 2, F.size(polygons))
    return F.when(F.size(polygons) == 1, shell).otherwise(st("difference", shell, st("union_all", holes)))


def offset_polygons(rings: DataFrame, d: float, strategy: str = "boolean_patch") -> DataFrame:
    """rings with geom and skip_reason. rings: any columns and `ring`, the shell, counter-clockwise; or `rings`, the shell and holes, each counter-clockwise.

    Movable edges move away from what their own ring encloses, so holes grow. Distance 0 is the polygon itself.

    boolean_patch: the areas between moved chains and their new places are joined to the old polygon, or cut away, as a
    sample point of each tells; all else stays as it is. A ring that is movable as a whole has no chain ends and fails.
    linework: rings are rebuilt from their support lines.

    Reasons: invalid_input_polygon, edge_matching_failed (a ring isn't closed), no_movable_edges, geometry_offset_failed
    (the result isn't one valid polygon), value_error (no distance).
    """
    if strategy not in ("linework", "boolean_patch"):
        raise ValueError("unknown strategy")
    own = rings.columns
    out = rings.withColumn("__all", F.col("rings") if "rings" in own else F.array("ring"))
    first = lambda reasons: F.get(F.filter(reasons, lambda r: r.isNotNull()), F.lit(0))
    movable = F.exists("__all", lambda r: F.exists(r, lambda s: s["movable"]))
    out = once(out, __reason=F.coalesce(F.when(F.lit(d != d), "value_error"), first(F.transform("__all", skip_reason)), F.when(~movable, "no_movable_edges")))
    ok = F.col("__reason").isNull() if d else ~F.coalesce(F.col("__reason") == "invalid_input_polygon", F.lit(False))
    old = F.transform("__all", ring_polygon)
    out = once(out, __old=F.when(ok, shell_less_holes(old)))
    if not d:
        return out.withColumn("geom", F.col("__old")).withColumn("skip_reason", F.lit(None).cast("string")).select(*own, "geom", "skip_reason")
    moved = once(out, __corners=F.when(ok, F.transform("__all", lambda r: offset_corners(r, d))))
    if strategy == "linework":
        new = F.transform("__corners", lambda c: st("polygon_of", closed(F.flatten(c))))
        moved = once(moved, __new=shell_less_holes(new))
    else:
        moved = once(moved, __patches=F.flatten(F.zip_with("__all", "__corners", lambda r, c: patches(r, c, d))))
        whole = F.exists("__all", lambda r: F.forall(r, lambda s: s["movable"]))
        moved = once(moved, __new=F.when(ok & ~whole, patched(F.col("__old"), F.col("__patches"))))
    g = F.col("__new")
    good = g.isNotNull() & st("is_valid", g) & (st("num_parts", g) == 1) & (st("area", g) > 1e-9)
    moved = once(moved, skip_reason=F.coalesce("__reason", F.when(~F.coalesce(good, F.lit(False)), "geometry_offset_failed")))
    return moved.withColumn("geom", F.when(F.col("skip_reason").isNull(), st("one_polygon", g))).select(*own, "geom", "skip_reason")


def offset_edges(polygons: DataFrame, offsets: DataFrame, key: str = "key") -> DataFrame:
    """key, geom, error: the strict offset of single edges of a shell. polygons: key, ring (counter-clockwise); offsets: key, edge, distance.

    Errors: an edge index outside the shell, two offsets of one edge, an edge without length, neighbours that are
    parallel, a result that isn't valid. A polygon without offsets stays as it is.
    """
    given = offsets.groupBy(key).agg(F.collect_list(F.struct("edge", "distance")).alias("__given"))
    p = polygons.select(key, "ring").join(given, key, "left").withColumn("__given", F.coalesce("__given", F.array().cast("array<struct<edge: int, distance: double>>")))
    n = F.size("ring")
    edges = F.transform("__given", lambda o: o["edge"])
    no_length = F.exists("ring", lambda s: (s["x1"] == s["x2"]) & (s["y1"] == s["y2"]))
    error = (
        F.when(n < 3, "the shell has fewer than three edges")
        .when(F.exists(edges, lambda e: (e < 0) | (e >= n)), "an edge index is outside the shell")
        .when(F.size(F.array_distinct(edges)) < F.size(edges), "an edge has two offsets")
        .when((F.size(edges) > 0) & no_length, "an edge has no length")
    )
    p = once(p, __error=error)
    by = lambda i: F.coalesce(F.get(F.filter("__given", lambda o: o["edge"] == i), F.lit(0))["distance"], F.lit(0.0))

    def line(s: Column, i: Column) -> Column:
        return bind(F.struct(s.alias("s"), by(i).alias("d"), F.sqrt((s["x2"] - s["x1"]) ** 2 + (s["y2"] - s["y1"]) ** 2).alias("n")), lambda v: F.struct(
            (v["s"]["x1"] + (v["s"]["y2"] - v["s"]["y1"]) / v["n"] * v["d"]).alias("px"), (v["s"]["y1"] - (v["s"]["x2"] - v["s"]["x1"]) / v["n"] * v["d"]).alias("py"),
            ((v["s"]["x2"] - v["s"]["x1"]) / v["n"]).alias("ux"), ((v["s"]["y2"] - v["s"]["y1"]) / v["n"]).alias("uy")))

    p = once(p, __lines=F.when(F.col("__error").isNull() & (F.size(edges) > 0), F.transform("ring", line)))
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("__lines", (i + n - 1) % n).alias("a"), F.get("__lines", i).alias("b")))
    p = once(p, __points=F.when(F.col("__lines").isNotNull(), F.transform(pairs, lambda c: planar.meet(*[c["a"][k] for k in ("px", "py", "ux", "uy")], *[c["b"][k] for k in ("px", "py", "ux", "uy")]))))
    parallel = F.exists("__points", lambda q: q.isNull())
    p = once(p, __geom=F.when(F.col("__points").isNull(), ring_polygon(F.col("ring"))).when(~parallel, st("polygon_of", closed(F.col("__points")))))
    wrong = F.coalesce("__error", F.when(parallel, "neighbouring edges are parallel"), F.when(~st("is_valid", "__geom"), "the result is not valid"))
    return once(p, error=wrong).select(key, F.when(F.col("error").isNull(), F.col("__geom")).alias("geom"), "error")


def classified_ring(ring: DataFrame, movable: DataFrame, fixed: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """key, n, n_movable, unmatched: segments of rings (key, x1, y1, x2, y2) matched by their undirected keys, each consumed once."""
    cols = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    keyed = lambda df: df.select("key", planar.segment_key(*cols, tolerance).alias("s"))
    m, f = keyed(movable).withColumn("movable", F.lit(1)), keyed(fixed).withColumn("movable", F.lit(0))
    given = m.unionByName(f).groupBy("key", "s").agg(F.count("*").alias("given"), F.max("movable").alias("movable"))
    found = keyed(ring).groupBy("key", "s").agg(F.count("*").alias("there"))
    both = found.join(given, ["key", "s"], "full")
    off = F.abs(F.coalesce("there", F.lit(0)) - F.coalesce("given", F.lit(0)))
    return both.groupBy("key").agg(F.sum(F.coalesce("there", F.lit(0))).alias("n"), F.sum(F.when(F.col("movable") == 1, F.col("there")).otherwise(0)).alias("n_movable"), F.sum(off).alias("unmatched"))


def classified_rings(edges: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """key, rings, reason: one polygon from the loose edges (x1, y1, x2, y2, movable) of each key, in any order and direction.

    rings: the shell and then the holes, each counter-clockwise, as offset_polygons() takes them; each of their segments is
    movable as the edge is that it matches. reason is edge_matching_failed where the edges don't make up one polygon, or a
    segment matches no edge or several, or an edge is left over.
    """
    cols = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    e = edges.select("key", planar.segment_key(*cols, tolerance).alias("s"), "movable", st("line_of", F.array(*cols)).alias("line"))
    g = e.groupBy("key").agg(F.collect_list(F.struct("s", "movable")).alias("given"), F.collect_list("line").alias("lines"))
    g = once(g, g=st("build_area", st("union_lines", "lines")))
    g = once(g, g=F.when((st("num_parts", "g") == 1) & ~st("is_empty", "g"), st("orient", st("one_polygon", "g"))))
    outlines = F.concat(F.array(st("coordinates", st("exterior_ring", "g"))), F.transform(st("interior_rings", "g"), lambda r: st("coordinates", r)))
    g = once(g, xy=F.when(F.col("g").isNotNull(), outlines))

    def segments(c: Column, turn: Column) -> Column:
        n = F.floor(F.size(c) / 2).cast("int") - 1
        at = lambda i: (F.get(c, 2 * i), F.get(c, 2 * i + 1))

        def one(i: Column) -> Column:
            (ax, ay), (bx, by) = at(i), at(i + 1)
            return F.struct(F.when(turn, bx).otherwise(ax).alias("x1"), F.when(turn, by).otherwise(ay).alias("y1"), F.when(turn, ax).otherwise(bx).alias("x2"), F.when(turn, ay).otherwise(by).alias("y2"))

        every = F.transform(F.sequence(F.lit(0), n - 1), one)
        return F.when(turn, F.reverse(every)).otherwise(every)

    g = once(g, segs=F.transform("xy", lambda c, k: segments(c, k > 0)))  # holes run clockwise in an oriented polygon

    def matched(s: Column) -> Column:
        return F.filter("given", lambda v: v["s"] == planar.segment_key(s["x1"], s["y1"], s["x2"], s["y2"], tolerance))

    g = once(g, found=F.transform("segs", lambda r: F.transform(r, lambda s: bind(matched(s), lambda m: F.struct(s["x1"].alias("x1"), s["y1"].alias("y1"), s["x2"].alias("x2"), s["y2"].alias("y2"), F.get(m, F.lit(0))["movable"].alias("movable"), F.size(m).alias("n"))))))
    flat = F.flatten("found")
    wrong = F.col("found").isNull() | F.exists(flat, lambda s: s["n"] != 1) | (F.size(flat) != F.size("given"))
    g = once(g, reason=F.when(F.coalesce(wrong, F.lit(True)), "edge_matching_failed"))
    rings = F.transform("found", lambda r: F.transform(r, lambda s: s.dropFields("n")))
    return g.select("key", F.when(F.col("reason").isNull(), rings).alias("rings"), "reason")
