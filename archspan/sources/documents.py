"""Text sources and sinks: GeoJSON, city models, camera tables, CSV with JSON columns, file discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GEOMETRY = "struct<type: string, coordinates: string>"
COLLECTION = f"struct<type: string, name: string, features: array<struct<type: string, properties: map<string, string>, geometry: {GEOMETRY}>>>"
FILE_CHARS = 2_000_000  # fixed value: what a file of features holds, since it is read whole
CAMERA = "image_id string, width int, height int, cx double, cy double, cz double, omega double, phi double, kappa double, fx double, fy double, px double, py double"


def read_geojson(spark: SparkSession, path: str, properties: list[str] | None = None, kind: str | None = None) -> DataFrame:
    """file, properties, geometry of each feature of whole files; raises on what isn't a collection of features with the asked properties and type."""
    c = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", COLLECTION).alias("c"))
    check = lambda bad, what: F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit(what)).cast("boolean")).otherwise(F.lit(True))
    c = c.where(check(F.col("c.type") != "FeatureCollection", "not a FeatureCollection")).where(check(F.col("c.features").isNull(), "no features"))
    f = c.select("file", F.explode("c.features").alias("f"))
    f = f.where(check(F.col("f.type") != "Feature", "not a Feature")).where(check(F.col("f.geometry.type").isNull(), "no geometry"))
    if kind:
        f = f.where(check(F.col("f.geometry.type") != kind, f"geometry is no {kind}"))
    for p in properties or []:
        f = f.where(check(~F.map_contains_key("f.properties", F.lit(p)), f"property {p} is missing"))
    return f.select("file", "f.properties", "f.geometry")


def one_feature(features: DataFrame) -> DataFrame:
    """features, with an error for files that don't hold exactly one."""
    n = features.groupBy("file").agg(F.count("*").alias("n"))
    bad = F.when(F.col("n") != 1, F.raise_error(F.lit("not exactly one feature")).cast("boolean")).otherwise(F.lit(True))
    return features.join(n.where(bad).select("file"), "file", "left_semi")


def feature(geometry: Column, properties: Column) -> Column:
    """GeoJSON text of a feature; geometry: text of a GeoJSON geometry."""
    return F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(properties), F.lit(',"geometry":'), geometry, F.lit("}"))


def write_geojson_lines(features: DataFrame, column: str, path: str) -> None:
    """One feature a line: a form that can be written and read in parts."""
    features.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_geojson_collections(features: DataFrame, column: str, path: str, most: int = FILE_CHARS) -> None:
    """Files that are each a whole FeatureCollection of at most most characters, or of one feature: a partition goes to as many as it fills.

    A reader takes a file's text at once, so files must not grow with the table.
    """
    head, tail = '{"type":"FeatureCollection","features":[\n', "\n]}"

    def rows(batches):
        import pandas as pd

        whole = lambda t: pd.DataFrame({"value": [head + "\n,".join(t) + tail]})
        texts, size, written = [], len(head) + len(tail), False
        for pdf in batches:
            for t in pdf["value"]:
                if texts and size + len(t) + 2 > most:
                    yield whole(texts)
                    texts, size, written = [], len(head) + len(tail), True
                texts.append(t)
                size += len(t) + 2
        if texts or not written:
            yield whole(texts)

    values = features.select(F.col(column).alias("value")).where("value IS NOT NULL")
    values.mapInPandas(rows, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated camera rows; ids stay text."""
    return spark.read.schema(CAMERA).csv(path, sep="\t", header=False)


def write_csv_with_json(df: DataFrame, path: str) -> None:
    """CSV whose nested columns are JSON texts."""
    nested = [f.name for f in df.schema.fields if f.dataType.simpleString().startswith(("array", "struct", "map"))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").csv(path, header=True, escape='"')


def read_model_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, value, header of city model lines: a file's first line is its header."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines.where("trim(value) <> ''").withColumn("header", F.get_json_object("value", "$.type") == "CityJSON")


def concatenate(models: DataFrame, folder: Column) -> DataFrame:
    """folder, ord, value: one header and all features of each folder's files; write it partitioned by folder and sorted by ord."""
    m = models.withColumn("folder", folder)
    head = m.where("header").groupBy("folder").agg(F.min_by("value", "file").alias("value")).select("folder", F.lit(0).alias("ord"), "value")
    return head.unionByName(m.where("NOT header").select("folder", F.lit(1).alias("ord"), "value"))


def discover(spark: SparkSession, path: str, suffix: str, recursive: bool = True) -> DataFrame:
    """path, length of files with a suffix; names that start with two underscores are left out."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return f.select("path", "length").where(~F.regexp_extract("path", "([^/]+)$", 1).startswith("__"))
