"""Line dedup by site-relative frequency.

Lines are counted once a page within each host; a line that more than a share
of the host's pages contain is boilerplate of that host and goes from its pages.
The boilerplate of one host is small by construction: with `percent`, at most
100 / percent times the mean number of lines of its pages. It is kept as a hash
table in an array: a line looks into its own bucket alone, so that the work on a
page follows its length. DataFrame functions alone are used, and lines are
compared by two 64-bit hashes.

The report counts page rows, as its SQL does. `drop_lines`, which goes before a
near-duplicate stage, must not take a text away with all its copies. There, exact
copies within a host count as one page; a page that would lose all its lines
keeps them; and of pages that lose lines and are near copies of each other, the
one of the least id keeps its lines.

Cases: null text stays null; blank lines stay; pages of a null host are a host
of their own; very long pages are worked on whole; hosts where a line is on fewer than `least` pages keep it; in the
report a page may end up with empty text, and repeated rows are pages of their
own; an empty table gives an empty result; all other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, neardup

PERCENT = 5
LEAST = 3
BUCKET = 4  # keys that a bucket of the hash table has on average


def _key(line):
    return F.struct(F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(17), line).alias("k2"))


def boilerplate(docs: DataFrame, host: str = "source", percent: int = PERCENT, least: int = LEAST, once: bool = False) -> DataFrame:
    """host, lines: the keys of each host's boilerplate, as hash_tables() gives them. With once, a host's pages of equal text count as one."""
    pages = docs.select(F.col(host).alias("host"), "text", *[_key(F.col("text")).alias("page")] * once)
    lines = pages.select(*pages.drop("text").columns, F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line")).where("trim(line) <> ''")
    lines = lines.withColumn("k", _key(F.col("line"))).drop("line")
    if once:
        lines, pages = lines.distinct(), pages.drop("text").distinct()
    counts = lines.groupBy("host", "k").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    total = pages.groupBy("host").agg(F.count("*").alias("pages")).withColumnRenamed("host", "h")
    often = counts.join(total, F.col("host").eqNullSafe(F.col("h"))).where(F.expr(f"100 * n > {percent} * pages")).select("host", "k")
    return hash_tables(often)


def _slot(key, n):
    return F.pmod(key["k1"], n).cast("int")


def hash_tables(keys: DataFrame) -> DataFrame:
    """host, lines: for each host an array of buckets, each an array of the keys k whose first hash modulo their number is the bucket's place."""
    size = keys.groupBy("host").agg(F.ceil(F.count("*") / BUCKET).alias("n"))
    size = size.withColumnRenamed("host", "h")
    dealt = keys.join(size, F.col("host").eqNullSafe(F.col("h"))).select("host", _slot(F.col("k"), F.col("n")).alias("slot"), "k")
    every = size.select(F.col("h").alias("host"), F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("slot"), F.lit(None).cast(keys.schema["k"].dataType).alias("k"))
    buckets = dealt.unionByName(every).groupBy("host", "slot").agg(F.collect_list("k").alias("k"))
    return buckets.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "k"))), lambda b: b["k"]).alias("lines"))


def _held(tables, key):
    return F.array_contains(F.get(tables, _slot(key, F.size(tables))), key)


def marked(docs: DataFrame, host: str = "source", percent: int = PERCENT, least: int = LEAST, once: bool = False) -> DataFrame:
    """docs with __clean, the text without boilerplate lines, and __lines and __dropped, their numbers."""
    bad = common.durable(boilerplate(docs, host, percent, least, once), "boilerplate").withColumnsRenamed({"host": "__host", "lines": "__bad"})
    out = docs.join(bad, docs[host].eqNullSafe(bad["__host"]), "left")
    split = F.split("text", "\n", -1)
    kept = F.filter(split, lambda x: (F.trim(x) == "") | ~_held(F.col("__bad"), _key(x)))
    out = out.withColumn("__kept", F.when(F.col("__bad").isNull(), split).otherwise(kept))
    out = out.withColumn("__clean", F.array_join("__kept", "\n")).withColumn("__lines", F.coalesce(F.size(split), F.lit(0)))
    return out.withColumn("__dropped", F.when(F.col("text").isNull(), 0).otherwise(F.col("__lines") - F.size("__kept"))).drop("__host", "__bad", "__kept")


def drop_lines(docs: DataFrame, host: str = "source", percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """docs with their boilerplate lines gone from text, but no text gone with all its copies; n_chars, where there is such a column, follows."""
    out = marked(docs, host, percent, least, once=True)
    stripped = (F.col("__dropped") > 0) & (F.trim(F.translate("__clean", "\n", " ")) != "")
    lost = common.durable(out.where(stripped).select("doc_id", "text"), "stripped")
    first = neardup.near_duplicates(lost).where("NOT kept").select(F.col("component_id").alias("__first")).distinct()
    out = out.join(common.small(common.written(first, "first", common.files_for(lost.count()))), F.col("doc_id").cast("bigint") == F.col("__first"), "left")
    out = out.withColumn("text", F.when(stripped & F.col("__first").isNull(), F.col("__clean")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def report(docs: DataFrame, host: str = "source", percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_dropped, text_md5 of each page after the dedup."""
    out = marked(docs.select("doc_id", host, "text"), host, percent, least)
    lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("__lines"))
    return out.select("doc_id", lines.cast("long").alias("n_lines"), F.col("__dropped").cast("long").alias("n_dropped"), F.md5("__clean").alias("text_md5"))


ORACLE = f"""
WITH lines AS (SELECT doc_id, source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents),
counts AS (SELECT source, line, count(*) AS n FROM lines WHERE trim(line) <> '' GROUP BY source, line),
total AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (SELECT counts.source, list(line) AS bl FROM counts JOIN total ON counts.source IS NOT DISTINCT FROM total.source
        WHERE n >= {LEAST} AND 100 * n > {PERCENT} * pages GROUP BY counts.source),
kept AS (SELECT doc_id, string_split(text, chr(10)) AS l, bl FROM documents LEFT JOIN bad ON documents.source IS NOT DISTINCT FROM bad.source),
clean AS (SELECT doc_id, l, CASE WHEN bl IS NULL THEN l ELSE list_filter(l, lambda x: NOT list_contains(bl, x)) END AS k FROM kept)
SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l) - len(k), 0) AS BIGINT) AS n_dropped,
       CASE WHEN l IS NULL THEN NULL ELSE md5(coalesce(array_to_string(k, chr(10)), '')) END AS text_md5
FROM clean
"""
