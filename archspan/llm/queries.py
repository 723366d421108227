"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, common, crf, lines, media, neardup, packing, pieces, quality, secrets, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.smaller_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_anisotropic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), common.crc_mod("doc_id", 4) != 2)
    held = F.coalesce(common.crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return quality.score(docs, model).select("doc_id", held, "score", "predicted")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = crf.fit(docs, common.crc_mod("doc_id", 5) != 0)
    held = F.coalesce(common.crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return crf.identify(docs, model).select("doc_id", held, "lang_pred", "score")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.CONTRACT_RULES)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


QUERIES = {
    f.__name__: f
    for f in (
        op1_anisotropic_neighbours,
        op2_sentencepiece,
        op3_quality_classifier,
        op4_best_fit_packing,
        op5_language_id,
        op6_secret_scans,
        op7_url_filters,
        op8_line_dedup,
        op9_media_columns,
        op10_near_duplicates,
    )
}
ORACLES: dict[str, str] = {"op7_url_filters": urls.ORACLE, "op8_line_dedup": lines.ORACLE}
