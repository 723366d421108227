"""Review tags and manifests of a viewer: normal forms, migration, filters and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import first_by

PREFIX = "NL.IMBAG.Pand."


def building_id(text: Column) -> Column:
    """A trimmed id; one of digits alone gets the register's prefix."""
    t = F.trim(text)
    return F.when(t.rlike("^[0-9]+$"), F.concat(F.lit(PREFIX), t)).otherwise(t)


def file_name(text: Column) -> Column:
    """A safe file name: other characters become _, and dots and underscores at the ends go."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), F.lit("._")), F.lit("")), F.lit("unknown"))


def normal_tags(tags: Column, allowed: list[str], status: list[str]) -> Column:
    """Allowed tags once each, in the allowed order; null if more than one of them is a status."""
    kept = F.filter(F.array(*map(F.lit, allowed)), lambda a: F.array_contains(tags, a))
    several = F.size(F.array_intersect(kept, F.array(*map(F.lit, status)))) > 1
    return F.when(~several, kept)


def migrate(v1: DataFrame) -> DataFrame:
    """building, underpass, tag, legacy of v1 rows (building, tag, underpasses): the tag goes to the only underpass, or stays with the building as legacy."""
    one = F.size("underpasses") == 1
    return v1.select("building", F.when(one, F.get("underpasses", F.lit(0))).alias("underpass"), "tag", (~one).alias("legacy"))


def default_tags(targets: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """tags and, for targets without any, a default marked automatic."""
    missing = targets.join(tags, ["building", "underpass"], "left_anti").select("building", "underpass", F.lit(tag).alias("tag"), F.lit(True).alias("automatic"))
    return tags.select("building", "underpass", "tag", "automatic").unionByName(missing)


def targets_with(tag: str, of_underpass: DataFrame, of_building: DataFrame, legacy: DataFrame) -> DataFrame:
    """building, underpass (null for the building as a whole) of what carries a tag on any of three levels."""
    a = of_underpass.where(F.col("tag") == tag).select("building", "underpass")
    rest = [t.where(F.col("tag") == tag).select("building", F.lit(None).cast(a.schema["underpass"].dataType).alias("underpass")) for t in (of_building, legacy)]
    return a.unionByName(rest[0]).unionByName(rest[1]).distinct()


def manifest(entries: DataFrame) -> DataFrame:
    """url, label of manifest texts, a string or an object with the url and the label under several names; one row a url, the first."""
    o = F.from_json("entry", "map<string, string>")
    get = lambda *names: F.coalesce(*[F.try_element_at(o, F.lit(n)) for n in names])
    url = F.when(F.col("entry").startswith("{"), get("url", "href", "path")).otherwise(F.col("entry"))
    label = F.coalesce(F.when(F.col("entry").startswith("{"), get("label", "name")), F.regexp_extract(url, "([^/]+)$", 1))
    return first_by(entries.select("pos", url.alias("url"), label.alias("label")).where("url IS NOT NULL"), ["url"], ["pos"]).select("url", "label")


def merge_manifests(old: DataFrame, found: DataFrame, uploaded: DataFrame) -> DataFrame:
    """url, label, ord: old labels stay, found ones follow, uploaded ones come last."""
    of = lambda d, k: d.select("url", "label", F.lit(k).alias("ord"))
    every = of(old, 1).unionByName(of(found, 2)).unionByName(of(uploaded, 3))
    return every.groupBy("url").agg(F.min_by("label", "ord").alias("label"), F.max(F.when(F.col("ord") == 3, 3).otherwise(0)).alias("__up"), F.min("ord").alias("ord")).select("url", "label", F.greatest("ord", "__up").alias("ord"))


def category(status: Column, source: Column) -> Column:
    """What a viewer shows: success in any of its spellings, by source."""
    ok = F.lower(status.cast("string")).isin("1", "true", "success")
    return F.when(ok & (source == "streetlidar"), "measured").when(ok, "assumed").when(status.isNull(), "unknown").otherwise("failed")
