"""City models as lines of JSON: one header and one feature a line.

Boundaries nest to a depth that the geometry's type tells, so they stay text
until a type is chosen. Lines that nothing changes pass through as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import planar
from ..functions.binding import bind, once

SURFACES = "struct<surfaces: array<map<string, string>>, values: string>"
OBJECT = f"struct<type: string, attributes: map<string, string>, geometry: array<struct<type: string, lod: string, boundaries: string, semantics: {SURFACES}>>, parents: array<string>, children: array<string>>"
FEATURE = f"struct<type: string, id: string, CityObjects: map<string, {OBJECT}>, vertices: array<array<double>>>"
HEADER = "struct<type: string, version: string, transform: struct<scale: array<double>, translate: array<double>>, metadata: map<string, string>, extensions: string>"
SOLID = "array<array<array<array<int>>>>"


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines with feature (null for other lines), parsed once a line."""
    return once(lines, feature=bind(F.from_json(column, FEATURE), lambda f: F.when(f["type"] == "CityJSONFeature", f)))


def header(lines: DataFrame, column: str = "value") -> DataFrame:
    """The transform of each header line: scale, translate."""
    h = F.from_json(column, HEADER)
    return lines.select(*[c for c in lines.columns if c != column], h.alias("h")).where("h.type = 'CityJSON'").select("*", "h.transform.scale", "h.transform.translate").drop("h")


def without_key(column: Column, key: str) -> Column:
    """JSON text of an object less one of its keys; what is left keeps its types."""
    m = F.parse_json(column).cast("map<string, variant>")
    return F.to_json(F.to_variant_object(F.map_filter(m, lambda k, v: k != key)))


def main_object(feature: Column) -> Column:
    """The building part that carries the solid: the id with -0, or the id itself."""
    objects = feature["CityObjects"]
    return F.coalesce(F.try_element_at(objects, F.concat(feature["id"], F.lit("-0"))), F.try_element_at(objects, feature["id"]))


def solid(feature: Column, lod: str = "2.2") -> Column:
    """The first solid of a level of detail; null where there is none."""
    return F.get(F.filter(main_object(feature)["geometry"], lambda g: (g["type"] == "Solid") & (g["lod"] == lod)), F.lit(0))


def vertices(feature: Column, scale: Column, translate: Column) -> Column:
    return planar.dequantised(feature["vertices"], scale, translate)


def faces(features: DataFrame, scale: list[float], translate: list[float], lod: str = "2.2") -> DataFrame:
    """id, face, kind, source, rings of each face of the solids: rings are arrays of real points, the outer one first."""
    kept = features.where("feature IS NOT NULL").select(F.col("feature.id").alias("id"), solid(F.col("feature"), lod).alias("g"), F.col("feature.vertices").alias("q"))
    g = once(kept, g=F.col("g"), q=F.col("q")).where("g IS NOT NULL")
    parsed = once(g, surfaces=F.col("g.semantics.surfaces"), b=F.get(F.from_json("g.boundaries", SOLID), F.lit(0)), values=F.get(F.from_json("g.semantics.values", "array<array<int>>"), F.lit(0)))
    f = parsed.select("id", "q", "surfaces", "values", F.posexplode("b").alias("face", "r"))
    s = F.get("surfaces", F.get("values", F.col("face")))
    place = lambda i, k: F.get(F.get("q", i), F.lit(k)) * scale[k] + translate[k]
    point = lambda i: F.struct(*[place(i, k).alias(c) for k, c in enumerate("xyz")])
    return once(f.select("id", "face", s.alias("s"), "q", "r"), kind=F.col("s.type"), source=F.col("s.id"), rings=F.transform("r", lambda ring: F.transform(ring, point))).select("id", "face", "kind", "source", "rings")


def face_area(rings: Column) -> Column:
    """Area of the outer ring less those of holes, at least 0."""
    areas = F.transform(rings, lambda r: planar.norm(planar.newell(r)) / 2)
    return F.greatest(F.lit(0.0), F.aggregate(areas, F.lit(0.0), lambda a, x: a - x) + 2 * F.get(areas, F.lit(0)))


def underpass_areas(f: DataFrame) -> DataFrame:
    """id, source, area of the outer ceilings of each underpass."""
    return f.where("kind = 'OuterCeilingSurface' AND source IS NOT NULL").groupBy("id", "source").agg(F.sum(face_area(F.col("rings"))).alias("area"))


def inferred_kinds(new: DataFrame, sources: DataFrame, houses: DataFrame) -> DataFrame:
    """id, face, kind of new faces: that of the first source surface of the same plane whose area holds the face's centroid, else by normal and height.

    new: id, face, points (an outer ring of struct(x, y, z)); sources: id, face, kind, rings, as faces() gives them;
    houses: id, min_z. A model's surfaces are one row's array; faces without an area are judged by height alone.
    """
    from .carving import drop_axis, flattened

    def unit(v: Column) -> Column:
        return bind(planar.norm(v), lambda n: F.struct(*[F.when(n > 0, v[c] / n).otherwise(0.0).alias(c) for c in "xyz"]))

    def segments(ring: Column) -> Column:
        nth = lambda i: F.get(ring, i % F.size(ring))
        return F.transform(F.sequence(F.lit(0), F.size(ring) - 1), lambda i: F.struct(nth(i)["x"].alias("x1"), nth(i)["y"].alias("y1"), nth(i + 1)["x"].alias("x2"), nth(i + 1)["y"].alias("y2")))

    s = sources.where(F.size(F.get("rings", F.lit(0))) >= 3).select("id", "face", "kind", "rings", unit(planar.newell(F.get("rings", F.lit(0)))).alias("n"))
    s = once(s, n=F.col("n"), p=F.get(F.get("rings", F.lit(0)), F.lit(0)), axis=drop_axis(F.col("n"))).where(planar.norm(F.col("n")) > 0)
    edges = F.flatten(F.transform(F.filter("rings", lambda r: F.size(r) >= 3), lambda r: bind(flattened(r, F.col("axis")), segments)))
    held = s.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("face", "kind", "n", "p", "axis", edges.alias("edges")))).alias("known"))
    mean = lambda c: F.aggregate("points", F.lit(0.0), lambda a, p: a + p[c]) / F.size("points")
    f = once(new, n=unit(planar.newell(F.col("points"))), c=F.struct(*[mean(k).alias(k) for k in "xyz"])).join(held.hint("merge"), "id", "left").join(houses.select("id", "min_z").hint("merge"), "id", "left")  # a row a model on either side is never small
    dot = lambda a, b: a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]

    def fits(k: Column) -> Column:
        off = F.struct(*[(F.col("c")[a] - k["p"][a]).alias(a) for a in "xyz"])
        x, y = F.when(k["axis"] == 0, F.col("c.y")).otherwise(F.col("c.x")), F.when(k["axis"] == 2, F.col("c.y")).otherwise(F.col("c.z"))
        one = (F.abs(F.abs(dot(F.col("n"), k["n"])) - 1) <= planar.NORMAL) & (F.abs(dot(off, k["n"])) <= planar.PLANE)
        return F.when(one, bind(F.struct(x.alias("x"), y.alias("y")), lambda at: planar.inside(at["x"], at["y"], k["edges"]))).otherwise(False)

    kind = F.get(F.filter("known", fits), F.lit(0))["kind"]
    return f.select("id", "face", F.coalesce(kind, planar.surface_kind(F.col("n"), F.col("c.z"), F.col("min_z"))).alias("kind"))


def last_of_source(f: DataFrame) -> DataFrame:
    """id, source, rings of the outer ceilings: of faces that name one source the last one counts."""
    kept = f.where("kind = 'OuterCeilingSurface' AND source IS NOT NULL")
    return kept.groupBy("id", "source").agg(F.max_by("rings", "face").alias("rings"))


def statistics(features: DataFrame) -> DataFrame:
    """kind, value of what the features hold: counts of features, objects, geometries and vertices, and of objects and geometries by type."""
    one = lambda kind, n=1: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), F.lit(n).cast("long").alias("n") if isinstance(n, int) else n.cast("long").alias("n"))
    objects = F.map_values("feature.CityObjects")
    kinds = F.transform(objects, lambda o: one(F.concat(F.lit("object "), o["type"])))
    shapes = F.flatten(F.transform(F.filter(objects, lambda o: o["geometry"].isNotNull()), lambda o: F.transform(o["geometry"], lambda g: one(F.concat(F.lit("geometry "), g["type"])))))
    totals = F.array(one("features"), one("vertices", F.size("feature.vertices")), one("objects", F.size("feature.CityObjects")))
    told = features.where("feature IS NOT NULL").select(F.inline(F.concat(totals, kinds, shapes)))
    return told.groupBy("kind").agg(F.sum("n").alias("value"))


def levels(features: DataFrame) -> DataFrame:
    """id, lods: the distinct levels of detail, by number."""
    g = F.flatten(F.transform(F.map_values("feature.CityObjects"), lambda o: F.transform(F.coalesce(o["geometry"], F.array().cast(f"array<struct<type: string, lod: string, boundaries: string, semantics: {SURFACES}>>")), lambda x: x["lod"])))
    return features.where("feature IS NOT NULL").select(F.col("feature.id").alias("id"), F.transform(F.array_sort(F.transform(F.array_distinct(g), lambda x: x.cast("double"))), lambda x: x.cast("string")).alias("lods"))


def with_attributes(features: DataFrame, values: DataFrame, column: str = "value") -> DataFrame:
    """id, the line, and changed: the whole feature with attributes from values (id, name, value) added to its own object; of one name's values the least wins and names that are there stay.

    changed is null for lines without values, which pass through as they are. Other members of a changed line keep their types.
    """
    one = values.groupBy("id", "name").agg(F.min("value").alias("value")).groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("__new"))
    out = features.withColumn("id", F.col("feature.id")).join(one, "id", "left")
    members = lambda v: v.cast("map<string, variant>")
    put = lambda m, k, v: F.map_concat(F.map_filter(m, lambda n, _: n != k), F.map_from_arrays(F.array(k), F.array(v)))
    obj = lambda m: F.to_variant_object(m)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    line = once(out, __top=F.when(F.col("__new").isNotNull(), members(F.parse_json(column))))
    line = once(line, __objects=members(F.try_element_at("__top", F.lit("CityObjects"))))
    line = once(line, __own=F.coalesce(members(F.try_element_at("__objects", "id")), none))
    line = once(line, __attributes=F.coalesce(members(F.try_element_at("__own", F.lit("attributes"))), none))
    fresh = F.transform_values(F.map_filter("__new", lambda k, v: ~F.map_contains_key("__attributes", k)), lambda k, v: v.cast("variant"))
    own = put(F.col("__own"), F.lit("attributes"), obj(F.map_concat("__attributes", fresh)))
    top = put(F.col("__top"), F.lit("CityObjects"), obj(put(F.col("__objects"), F.col("id"), obj(own))))
    return line.withColumn("changed", F.when(F.col("__top").isNotNull(), F.to_json(obj(top)))).select("id", column, "changed")


def carved_buildings(features: DataFrame, attribute: str = "add_underpass_success", area: str = "underpass_area") -> DataFrame:
    """id, area of features with a building part whose attribute is 1 or true: the greatest area among their outer ceilings, 0 where none is told; features of one id together, largest first."""
    f = features.where("feature IS NOT NULL").select(F.col("feature.id").alias("id"), F.map_values("feature.CityObjects").alias("o"))
    done = F.exists("o", lambda o: (o["type"] == "BuildingPart") & F.coalesce(F.try_element_at(o["attributes"], F.lit(attribute)), F.lit("")).isin("1", "true"))
    surfaces = F.flatten(F.flatten(F.transform(F.filter("o", lambda o: o["geometry"].isNotNull()), lambda o: F.transform(F.filter(o["geometry"], lambda g: g["semantics"]["surfaces"].isNotNull()), lambda g: g["semantics"]["surfaces"]))))
    areas = F.transform(F.filter(surfaces, lambda s: F.try_element_at(s, F.lit("type")) == "OuterCeilingSurface"), lambda s: F.try_element_at(s, F.lit(area)).try_cast("double"))
    out = f.where(done & F.col("id").isNotNull()).select("id", F.coalesce(F.array_max(areas), F.lit(0.0)).alias("area"))
    return out.groupBy("id").agg(F.max("area").alias("area")).orderBy(F.desc("area"), "id")
