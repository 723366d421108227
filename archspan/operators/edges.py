"""Boundary edges of underpasses: interior, exterior and shared ones; and what they tell of an underpass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import azimuth, st

GRID = 0.001
SNAP = 0.03
SPREAD = 0.7


def classify(underpasses: DataFrame, adjacent: DataFrame, snap: float = SNAP, snap_adjacent: float = SNAP, by_ring: bool = False) -> DataFrame:
    """underpass_id, identificatie, edge_type, part, geom.

    underpasses: underpass_id, identificatie, geom, topo; adjacent: identificatie, geom of neighbours. Exterior edges
    are off the topographic ring; the rest of the outer ring is interior. Exterior edges on a neighbour are shared.
    by_ring: holes are classified like the outer ring, and neighbours count by their rings, as the SQL variant has
    it; otherwise holes are interior and a neighbour's area counts.
    """
    line = lambda name, a, b: st(name, a, b, GRID)
    u = underpasses.withColumn("base", st("exterior_ring", st("snap", "topo", "geom", snap)))
    outer = u.select("underpass_id", "identificatie", "base", st("exterior_ring", "geom").alias("ring"), F.lit(True).alias("shell"))
    holes = u.select("underpass_id", "identificatie", "base", F.explode(st("interior_rings", "geom")).alias("ring"), F.lit(False).alias("shell"))
    if by_ring:
        rings = outer.unionByName(holes)
        inner_holes = None
    else:
        rings, inner_holes = outer, holes
    rings = rings.withColumn("exterior", line("line_difference", F.col("ring"), F.col("base")))
    rings = rings.withColumn("interior", line("line_difference", F.col("ring"), F.col("exterior")))
    area = st("exterior_ring", "geom") if by_ring else F.col("geom")
    near = adjacent.where(F.col("geom").isNotNull()).select("identificatie", area.alias("n")).groupBy("identificatie").agg(F.collect_set("n").alias("near"))
    rings = rings.join(near, "identificatie", "left")
    touch = F.transform(F.coalesce("near", F.array().cast("array<binary>")), lambda g: line("line_intersection", F.col("exterior"), g if by_ring else st("snap", g, F.col("exterior"), snap_adjacent)))
    rings = rings.withColumn("shared", st("union_lines", touch))
    rings = rings.withColumn("exterior", F.when(st("is_empty", "shared"), F.col("exterior")).otherwise(line("line_difference", F.col("exterior"), F.col("shared"))))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("edge_type"), F.col(k).alias("g")) for k in ("interior", "exterior", "shared")]))
    parts = rings.select("underpass_id", "identificatie", kinds.alias("k")).select("underpass_id", "identificatie", "k.edge_type", F.posexplode(st("dump", "k.g")).alias("part", "geom"))
    if inner_holes is not None:
        parts = parts.unionByName(inner_holes.select("underpass_id", "identificatie", F.lit("interior").alias("edge_type"), F.lit(-1).alias("part"), F.col("ring").alias("geom")))
    return parts


def spread(edges: DataFrame) -> DataFrame:
    """underpass_id, n, variability of the normals of exterior edges (x1, y1, x2, y2)."""
    a = azimuth(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) + F.pi() / 2
    n = edges.where("edge_type = 'exterior'").select("underpass_id", F.cos(a).alias("nx"), F.sin(a).alias("ny"))
    v = F.sqrt(F.stddev_samp("nx") ** 2 + F.stddev_samp("ny") ** 2)
    return n.groupBy("underpass_id").agg(F.count("*").alias("n"), v.alias("variability"))


def pass_through(underpasses: DataFrame, edges: DataFrame) -> DataFrame:
    """underpasses with pass_through: null without exterior edges, false with one, else whether their normals spread widely."""
    s = spread(edges)
    flag = F.when(F.col("n").isNotNull(), F.coalesce((F.col("n") > 1) & (F.col("variability") >= SPREAD), F.lit(False)))
    return underpasses.join(s, "underpass_id", "left").withColumn("pass_through", flag).drop("n", "variability")


def long_enough(x1: Column, y1: Column, x2: Column, y2: Column, least: float = 2.0) -> Column:
    return F.sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) >= least
