"""Detection of underpasses: a registry polygon less the topographic one of the same building."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import boxes_meet, not_sliver, st

SLIVER = 0.2
SNAP = 0.01


def join_registers(registry: DataFrame, topo: DataFrame) -> DataFrame:
    """identificatie, registry, topo: each registry polygon with the union of the topographic ones of its key that its bounds meet.

    registry: identificatie, geom; topo: key, geom. The key is the registry's id from its 15th character on; it is
    the hash key, and the bounds are what is left to test.
    """
    r = registry.select("identificatie", F.col("geom").alias("registry"), F.substring("identificatie", 15, 100).alias("key"))
    near = r.join(topo.select("key", F.col("geom").alias("t")), "key").where(boxes_meet(st("bounds", "registry"), st("bounds", "t")))
    return near.groupBy("identificatie", "registry").agg(st("union_all", F.collect_list("t")).alias("topo"))


def differences(joined: DataFrame, sliver: float = SLIVER) -> DataFrame:
    """identificatie, geom: registry less topo where an opening by sliver leaves anything. An empty topo gives the whole registry polygon, unfiltered.

    The difference is computed behind the grouping's exchange and the two facts about it go in one struct, so that the filter doesn't compute it anew.
    """
    g = joined.withColumn("geom", st("difference", "registry", "topo"))
    facts = g.select("identificatie", F.explode(F.array(F.struct("geom", (st("is_empty", "topo") | not_sliver(F.col("geom"), sliver)).alias("ok")))).alias("d"))
    return facts.where("d.ok").select("identificatie", "d.geom")


def snapped_differences(joined: DataFrame, tolerance: float = SNAP) -> DataFrame:
    """identificatie, part, geom: what is missing whichever of the two polygons is snapped to the other; no rows where topo is empty."""
    return joined.select("identificatie", F.posexplode(st("detect_step", "registry", "topo", tolerance)).alias("part", "geom"))


def underpasses(parts: DataFrame, sliver: float = SLIVER) -> DataFrame:
    """underpass_id, identificatie, geom: parts that pass the sliver filter, numbered by building and part."""
    from .sequences import numbered

    kept = parts.where(not_sliver(F.col("geom"), sliver))
    return numbered(kept, ["identificatie", "part"], "underpass_id").select("underpass_id", "identificatie", "geom")
