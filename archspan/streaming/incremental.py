"""Streams: resumable work against a sink, model lines that pass through or are decoded, running counts with a limit, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def resume(stream: DataFrame, sink: str, checkpoint: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Rows whose keys the sink doesn't hold go through work and are appended; a batch that is run again adds nothing."""

    def one(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(sink)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        todo = batch.dropDuplicates(keys)
        if there:
            todo = todo.join(spark.read.parquet(sink).select(*keys), keys, "left_anti")
        work(todo).write.mode("append").parquet(sink)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decode_matching(lines: DataFrame, wanted: DataFrame, id_path: str = "$.id") -> DataFrame:
    """Lines with their id and whether they are wanted: a peek at the id alone, so that others pass through as text. wanted: id; a static table that joins the stream."""
    peek = lines.withColumn("id", F.get_json_object("value", id_path))
    return peek.join(wanted.select("id").distinct().withColumn("match", F.lit(True)), "id", "left").withColumn("match", F.coalesce("match", F.lit(False)))


def running_counts(stream: DataFrame, key: str, most: int) -> DataFrame:
    """Counts by key so far, and whether they exceed a limit; the state is a number a key."""
    return stream.groupBy(key).agg(F.count("*").alias("n")).withColumn("exceeded", F.col("n") > most)


def windowed(stream: DataFrame, time: str, size: str, late: str, keys: list[str]) -> DataFrame:
    """Counts in tumbling windows, closed when the watermark passes; an extra, since the domain has no event time."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path)
