"""Files around a run: settings, value tables, metrics, images."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = """file_name string, stem string, start_time string, wall_clock_seconds double, peak_rss_kb bigint, exit_code int, success boolean, log_file string,
cpu_percent_at_start double, load_avg_1min double, load_avg_5min double, load_avg_15min double, memory_total_mb double, memory_available_mb double, memory_percent double"""


@dataclass(frozen=True)
class Settings:
    """Where a run's tables are. Each setting must be given; none has a default."""

    host: str
    port: int
    database: str
    user: str
    password: str


def dotenv(text: str) -> dict[str, str]:
    """KEY=value lines; comments, blank lines and an export in front are allowed, and quotes around a value go."""
    out = {}
    for line in text.splitlines():
        m = re.match(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$", line)
        if m:
            value = m[2]
            out[m[1]] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else re.sub(r"\s+#.*$", "", value)
    return out


def settings(prefix: str, file: str | None = None, environment: dict[str, str] | None = None) -> Settings:
    """Settings by prefix and name from the environment, which comes first, and a file; KeyError names all that are missing."""
    given = {}
    if file and os.path.exists(file):
        with open(file) as f:
            given = dotenv(f.read())
    given |= {k: v for k, v in (os.environ if environment is None else environment).items() if v}
    names = {f.name: f"{prefix}{f.name}".upper() for f in fields(Settings)}
    if missing := [n for n in names.values() if not given.get(n)]:
        raise KeyError(", ".join(missing))
    return Settings(**{k: int(given[n]) if k == "port" else given[n] for k, n in names.items()})


def read_values(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """key, value of a CSV with a header; rows with a blank key or value, or a value that is no number, go; of repeated keys the greatest value counts."""
    df = spark.read.csv(path, header=True)
    return clean_values(df, key, value)


def clean_values(df: DataFrame, key: str, value: str) -> DataFrame:
    k, v = F.trim(F.col(key).cast("string")), F.expr(f"try_cast(trim(cast(`{value}` AS string)) AS double)")
    return df.select(k.alias(key), v.alias(value)).where(F.col(key).isNotNull() & (F.col(key) != "") & F.col(value).isNotNull()).groupBy(key).agg(F.max(value).alias(value))


def parse_metrics(files: DataFrame) -> DataFrame:
    """A row of metrics for each file (path, value: its whole text); corrupt ones have null metrics and are marked."""
    m = F.from_json("value", METRICS, {"mode": "PERMISSIVE"})
    return files.select("path", m.alias("m")).select("path", F.col("m.file_name").isNull().alias("corrupt"), "m.*")


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_metrics(files)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The good rows as CSV, with a header."""
    metrics.where("NOT corrupt").drop("path", "corrupt").write.mode("overwrite").csv(path, header=True)


def read_images(spark: SparkSession, names: DataFrame, folder: str) -> DataFrame:
    """image_id, content, found of the images that names asks for; missing files are skipped by the scan and marked here."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,tif,tiff}").option("ignoreMissingFiles", "true").load(folder)
    own = files.select(F.regexp_extract("path", r"([^/]+)\.[A-Za-z]+$", 1).alias("image_id"), "content")
    return names.join(own, "image_id", "left").withColumn("found", F.col("content").isNotNull())


def stamp() -> Column:
    """Now, as ISO text in UTC with milliseconds."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
