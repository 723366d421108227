"""Run reports: coverage, status counts, error groups, labelled histograms and quantiles, each in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels of the report's buckets, with their upper ends (inclusive where marked so), and its quantiles.
POINT_BUCKETS = [("0", 0), ("1-99", 99), ("100-999", 999), ("1k-10k", 9999), ("10k-100k", 99999), ("100k-1M", 999999), ("1M-5M", 4999999), (">=5M", None)]
Z_BUCKETS = [("<1", 1.0), ("1-1.5", 1.5), ("1.5-2", 2.0), ("2-2.5", 2.5), ("=2.5", "=2.5"), ("2.5-3", 3.0), ("3-3.5", 3.5), ("=3.5", "=3.5"), ("3.5-4", 4.0), ("4-5", 5.0), ("5-10", 10.0), (">=10", None)]
QUANTILES = [("p01", 0.01), ("p05", 0.05), ("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)]
# Patterns of errors and what groups them.
ERRORS = [
    (r"^Only [0-9]+ points inside polygon; minimum is ([0-9]+)$", "Too few points inside polygon <$1"),
    (r"^Selected more than ([0-9]+) points$", "Selected more than $1 points"),
]


def success() -> Column:
    return F.coalesce((F.col("underpass_source") == "streetlidar") & (F.col("underpass_status") == "success"), F.lit(False))


def coverage(status: DataFrame) -> DataFrame:
    """label, value, ord of five counts, by one aggregation."""
    source, state = F.col("underpass_source"), F.col("underpass_status")
    counts = [
        ("Total rows", F.lit(True)),
        ("Processed rows", source.isNotNull() | state.isNotNull()),
        ("Streetlidar success", success()),
        ("Fallback rows", source == "fallback"),
        ("Still placeholder/null", source.isNull() & state.isNull()),
    ]
    one = status.agg(*[F.count_if(c).alias(f"c{i}") for i, (_, c) in enumerate(counts, 1)])
    rows = F.array(*[F.struct(F.lit(t).alias("label"), F.col(f"c{i}").alias("value"), F.lit(i).alias("ord")) for i, (t, _) in enumerate(counts, 1)])
    return one.select(F.inline(rows))


def status_counts(status: DataFrame) -> DataFrame:
    """Rows, median height and median points by source and status."""
    return status.groupBy(F.coalesce("underpass_source", F.lit("null")).alias("source"), F.coalesce("underpass_status", F.lit("null")).alias("status")).agg(
        F.count("*").alias("n_rows"),
        F.round(F.expr("percentile(underpass_z, 0.5)"), 3).alias("z_median"),
        F.expr("percentile(underpass_point_count, 0.5)").alias("point_median"),
    )


def error_groups(status: DataFrame) -> DataFrame:
    """Rows by status and error, with the numbers of similar errors taken out."""
    error = F.col("underpass_error")
    group = F.coalesce(F.nullif(error, F.lit("")), F.lit("null"))
    for pattern, to in reversed(ERRORS):
        group = F.when(error.rlike(pattern), F.regexp_replace(error, pattern, to)).otherwise(group)
    wrong = status.where("underpass_error IS NOT NULL OR underpass_status <> 'success'")
    return wrong.groupBy(F.coalesce("underpass_status", F.lit("null")).alias("status"), group.alias("error_group")).agg(F.count("*").alias("n_rows"))


def bucket(value: Column, buckets: list[tuple], inclusive: bool) -> Column:
    """struct(ord, bucket): the first bucket whose end value doesn't pass; a text end is a value that is its own bucket; null is bucket 0."""
    out = F.when(value.isNull(), F.struct(F.lit(0).alias("ord"), F.lit("null").alias("bucket")))
    for i, (label, end) in enumerate(buckets, 1):
        here = F.struct(F.lit(i).alias("ord"), F.lit(label).alias("bucket"))
        if end is None:
            return out.otherwise(here)
        out = out.when(value == float(end[1:]) if isinstance(end, str) else value <= end if inclusive else value < end, here)
    return out


def histogram(status: DataFrame, value: str, buckets: list[tuple], inclusive: bool) -> DataFrame:
    """ord, bucket, rows, and those that are successes or not."""
    return (
        status.select(bucket(F.col(value), buckets, inclusive).alias("b"), success().alias("ok"))
        .groupBy("b.ord", "b.bucket")
        .agg(F.count("*").alias("n_rows"), F.count_if("ok").alias("n_success"), F.count_if(~F.col("ok")).alias("n_other"))
    )


def quantiles(status: DataFrame, value: str, digits: int) -> DataFrame:
    """label, value, ord: least, exact interpolated quantiles, greatest, mean, of successes."""
    v = F.col(value).cast("double")
    one = status.where(success() & v.isNotNull()).agg(
        F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.percentile(v, [q for _, q in QUANTILES]).alias("q")
    )
    labels = [("min", F.col("lo")), *((n, F.col("q")[i]) for i, (n, _) in enumerate(QUANTILES)), ("max", F.col("hi")), ("avg", F.col("mean"))]
    rows = F.array(*[F.struct(F.lit(n).alias("label"), F.round(c, digits).alias("value"), F.lit(i).alias("ord")) for i, (n, c) in enumerate(labels, 1)])
    return one.select(F.inline(rows))


def markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """One text column: a table row for each row."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def number(value: Column, digits: int = 0) -> Column:
    """A number with commas between thousands, or null as a word; digits that are zeros at the end go."""
    text = F.format_number(F.round(value, digits), digits)
    return F.coalesce(F.regexp_replace(text, r"(\.\d*?)0+$", "$1") if digits else text, F.lit("null"))


def section(df: DataFrame, title: str, columns: dict[str, Column], order: list[Column], numeric: set[str], place: int) -> DataFrame:
    """place, ord, line: a titled markdown table of df's rows in order. Reports are small: a row a status or bucket."""
    from pyspark.sql import Window

    head = [f"### {title}", "", "| " + " | ".join(columns) + " |", "|" + "|".join("---:" if c in numeric else "---" for c in columns) + "|"]
    top = df.sparkSession.createDataFrame([(place, i - len(head), t) for i, t in enumerate(head)], "place int, ord int, line string")
    rows = df.withColumn("__ord", F.row_number().over(Window.orderBy(*order)))
    cells = F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns.values()])
    return top.unionByName(rows.select(F.lit(place).alias("place"), (F.col("__ord") - 1).alias("ord"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line")))
