"""Validation reports of solids: exploded, summarised and put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT = "struct<validity: boolean, features: array<struct<id: string, validity: boolean, errors: array<struct<code: int, description: string, id: string, info: string>>>>, dataset_errors: array<struct<code: int, description: string>>>"


def parse(reports: DataFrame, column: str = "value") -> DataFrame:
    """reports with report, null where the text is corrupt; such texts are counted, not dropped."""
    return reports.withColumn("report", F.from_json(column, REPORT, {"mode": "PERMISSIVE"})).withColumn("corrupt", F.col("report.features").isNull())


def errors(parsed: DataFrame) -> DataFrame:
    """object, code, description, id of each error of each feature."""
    f = parsed.where("NOT corrupt").select(F.explode("report.features").alias("f"))
    return f.select(F.col("f.id").alias("object"), F.explode("f.errors").alias("e")).select("object", "e.code", "e.description", "e.id")


def summary(parsed: DataFrame) -> DataFrame:
    """code, n, n_objects: how often each error occurs, and in how many objects; codes by number."""
    return errors(parsed).groupBy("code").agg(F.count("*").alias("n"), F.count_distinct("object").alias("n_objects"))


def parts(id_: Column) -> Column:
    """The map of an error id, key=value parts behind bars; of a repeated key the last one counts."""
    pairs = F.transform(F.filter(F.split(id_, r"\|"), lambda p: F.instr(p, "=") > 0), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substr(p, F.instr(p, F.lit("=")) + 1).alias("v")))
    last = F.filter(pairs, lambda p, i: F.size(F.filter(pairs, lambda q, j: (q["k"] == p["k"]) & (j > i))) == 0)
    return F.map_from_entries(last)


def number(map_: Column, key: str, default: int = 0) -> Column:
    """A part as a number that isn't negative, or default."""
    text = F.try_element_at(map_, F.lit(key))
    return F.when(text.rlike("^[0-9]{1,9}$"), F.when(text.rlike("^[0-9]{1,9}$"), text).cast("int")).otherwise(default)


def by_geometry(e: DataFrame) -> DataFrame:
    """object, geometries: errors grouped by geometry, a map of arrays in the order of codes."""
    p = e.withColumn("geom", number(parts(F.col("id")), "geom"))
    g = p.groupBy("object", "geom").agg(F.sort_array(F.collect_list(F.struct("code", "description"))).alias("errors"))
    return g.groupBy("object").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("geom").cast("string").alias("geom"), "errors")))).alias("geometries"))


def attach(objects: DataFrame, values: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """objects with column by key, and the keys of values without an object."""
    return objects.join(values.select(key, column), key, "left"), values.join(objects, key, "left_anti").select(key)


# Names of a report's members, and what they are called in a converted one.
RENAMED = {
    "type": "type",
    "val3dity_version": "val3dityVersion",
    "input_file": "inputFile",
    "input_file_type": "inputFileType",
    "time": "time",
    "validity": "validity",
    "features_overview": "featuresOverview",
    "primitives_overview": "primitivesOverview",
    "all_errors": "allErrors",
}


def renamed(column: Column) -> Column:
    """JSON text of the members of a report that have a new name, under it; members that are absent stay absent, and values keep their types."""
    m = F.parse_json(column).cast("map<string, variant>")
    names = F.create_map(*[F.lit(x) for pair in RENAMED.items() for x in pair])
    kept = F.map_filter(m, lambda k, v: F.map_contains_key(names, k))
    return F.to_json(F.to_variant_object(F.transform_keys(kept, lambda k, v: F.element_at(names, k))))


def scalar_parameters(column: Column) -> Column:
    """JSON text of the parameters that are numbers, truth values or texts; {} where there is no object of parameters."""
    p = F.try_variant_get(F.try_parse_json(column), "$.parameters", "map<string, variant>")
    kept = F.map_filter(p, lambda k, v: F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN|STRING)"))
    return F.coalesce(F.to_json(F.to_variant_object(kept)), F.lit("{}"))
