"""A corpus pipeline of five stages, from documents to packed sequences.

Each stage works on all that its predecessor kept. A stage gets (spark, docs,
sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from archspan.llm import common, lines, neardup, packing, quality, secrets


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from labels whose crc32(doc_id as text) mod 4 is not 2.

    Cases: null text is judged as empty text, very long texts whole; rows with a null or repeated id are judged one by
    one, each by its own text; where the labels don't show both good and bad documents nothing can be told, and all
    stay; an empty table stays empty; all columns, whatever their names, stay as they are.
    """
    common.smaller_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.fit(docs, labels, common.crc_mod("doc_id", 4) != 2))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; documents stay.

    Cases: null text stays null, and a page of boilerplate alone stays whole; sources are hosts, null ones a host of
    their own; exact copies, so repeated rows as well, count as one page of a host; of near copies that lose lines the
    least id keeps them; very long pages are worked on whole; n_chars follows the text; an empty table stays empty;
    other columns stay as they are.
    """
    common.smaller_batches(spark)
    return lines.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the one of the least id stays.

    Cases: documents with null text, empty text or no words are linked with nothing and stay; rows of a repeated or
    null id are documents of their own, told apart by their texts, and null ids come last; of rows with equal ids and
    texts one stays; an empty table stays empty; all columns stay as they are.
    """
    common.smaller_batches(spark)
    return neardup.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; documents stay.

    Cases: null text stays null and empty text empty; very long texts are scanned whole; spans that overlap are
    replaced together; repeated rows and null ids are worked on one by one; n_chars follows the text; an empty table
    stays empty; other columns stay as they are.
    """
    common.smaller_batches(spark)
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of 4096.

    Cases: null or empty text is the end id alone; very long texts are cut in as many pieces as they need; repeated rows
    and null ids are pieces of their own; of pieces of one length any may take a place; an empty table gives an empty
    result; other columns, whatever their names, are ignored.
    """
    common.smaller_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
