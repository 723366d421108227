"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import durable, forget, new_path, shared_dir  # noqa: F401


ROWS_A_FILE = 20_000


def files_for(rows: int) -> int:
    """In how many files a table of so many rows is written at most: few for a small table, however many partitions its shuffle has."""
    return max(8, rows // ROWS_A_FILE)


def written(df: DataFrame, tag: str, files: int) -> DataFrame:
    """durable() in at most so many files; their tasks take several partitions one after the other."""
    return durable(df.coalesce(files), tag)


def small(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """ids, a written table of one long a row, marked for broadcast while it has at most most rows (8 MB); beyond that, joins shuffle."""
    return F.broadcast(ids) if ids.count() <= most else ids


def texts(docs: DataFrame) -> DataFrame:
    """doc_id as text, so that pandas keeps long and null ids exactly, and text."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")


def typed(df: DataFrame, docs: DataFrame) -> DataFrame:
    """df with its doc_id in the type that docs has."""
    return df.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(n)


def smaller_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes as well as by rows, so that long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
