"""Windows, top-k and set operators over ordered rows. Each window has a key, so that no window is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable

PLACE_BITS = 33  # fixed value: the bits of monotonically_increasing_id() below the partition's number
HANNING = [0.25, 0.75, 1.0, 0.75, 0.25]  # hanning(7) without its zero ends; the sum is 3


def numbered(df: DataFrame, order: list[str], name: str = "id", first: int = 1) -> DataFrame:
    """df with consecutive ids in the order of columns: places within range partitions, and the partitions' starts, so that no task holds all rows.

    Range bounds come from a sample that each evaluation draws anew, so partitions and places are written once and
    both branches read them. There are as many starts as partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    cut = durable(cut, "numbered").withColumn("__part", F.shiftright("__at", PLACE_BITS)).withColumn("__place", F.col("__at").bitwiseAND((1 << PLACE_BITS) - 1))
    sizes = cut.groupBy("__part").agg(F.count("*").alias("n"))
    starts = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__start"))
    return cut.join(F.broadcast(starts), "__part").withColumn(name, F.col("__place") + F.col("__start") + first).drop("__at", "__part", "__place", "__start")


def smoothed(bins: DataFrame, key: str, value: str, at: str = "bin") -> DataFrame:
    """Dense bins with `smooth`, the convolution with a 7-wide Hann window, zero beyond the ends."""
    w = Window.partitionBy(key).orderBy(at)
    parts = [F.lag(value, 2, 0).over(w), F.lag(value, 1, 0).over(w), F.col(value), F.lead(value, 1, 0).over(w), F.lead(value, 2, 0).over(w)]
    return bins.withColumn("smooth", sum((p * c for p, c in zip(parts, HANNING, strict=True)), F.lit(0.0)) / 3)


def local_maxima(bins: DataFrame, key: str, value: str = "smooth", at: str = "bin") -> DataFrame:
    """Bins higher than the one before and no lower than the one behind; the ends must be strictly higher than their neighbour."""
    w = Window.partitionBy(key).orderBy(at)
    before, behind = F.lag(value).over(w), F.lead(value).over(w)
    rise = before.isNull() | (F.col(value) > before)
    fall = F.when(behind.isNull(), F.lit(True)).when(before.isNull(), F.col(value) > behind).otherwise(F.col(value) >= behind)
    return bins.withColumn("peak", rise & fall)


def cluster_bounds(bins: DataFrame, key: str, value: str = "smooth", at: str = "bin") -> DataFrame:
    """For each bin, how far one can walk left and right without rising: the next break on either side."""
    w = Window.partitionBy(key).orderBy(at)
    left = F.when(F.lag(value).over(w).isNull() | (F.lag(value).over(w) > F.col(value)), F.col(at))
    right = F.when(F.lead(value).over(w).isNull() | (F.lead(value).over(w) > F.col(value)), F.col(at))
    out = bins.withColumn("__l", left).withColumn("__r", right)
    out = out.withColumn("left", F.last("__l", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("right", F.first("__r", True).over(w.rowsBetween(0, Window.unboundedFollowing))).drop("__l", "__r")


def longest_gap(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys, gap: the longest run of absent values between the present ones."""
    w = Window.partitionBy(*keys).orderBy(at)
    gap = F.col(at) - F.lag(at).over(w) - 1
    return df.select(*keys, at).distinct().withColumn("__gap", gap).groupBy(*keys).agg(F.coalesce(F.max("__gap"), F.lit(0)).alias("gap"))


def cyclic_neighbours(df: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """df with `previous` and `following` values around a ring."""
    w = Window.partitionBy(*key).orderBy(at)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    previous = F.coalesce(F.lag(value).over(w), F.last(value).over(whole))
    return df.withColumn("previous", previous).withColumn("following", F.coalesce(F.lead(value).over(w), F.first(value).over(whole)))


def cyclic_islands(df: DataFrame, key: list[str], at: str, flag: str) -> DataFrame:
    """Rows whose flag holds, with `island`, the place where their run around the ring starts; -1 if the run is the whole ring."""
    ring = cyclic_neighbours(df, key, at, flag)
    w = Window.partitionBy(*key).orderBy(at)
    start = F.when(F.col(flag) & ~F.col("previous"), F.col(at))
    seen = F.last(start, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    final = F.last(start, True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ring.withColumn("island", F.coalesce(seen, final, F.lit(-1))).where(flag).drop("previous", "following")


def segments(points: Column) -> Column:
    """Consecutive pairs of an array, as struct(a, b)."""
    n = F.size(points)
    return F.transform(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), lambda p, i: F.struct(p.alias("a"), F.get(points, i + 1).alias("b")))


def top(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def separated(ranked: Column, distance: int) -> Column:
    """Of places ranked best first, those at least distance from each better one that was taken."""
    empty = F.slice(ranked, 1, 0)
    return F.aggregate(ranked, empty, lambda a, x: F.when(F.forall(a, lambda y: F.abs(x - y) >= distance), F.concat(a, F.array(x))).otherwise(a))


def second_highest(df: DataFrame, keys: list[str], value: str, share: float, name: str = "threshold") -> DataFrame:
    """keys, share of the second highest value of each key, or of its only one; a key's two best alone are held."""
    best = top(df, keys, [F.desc_nulls_last(value)], 2).groupBy(*keys)
    return best.agg((share * F.coalesce(F.when(F.count(value) > 1, F.min(value)), F.max(value), F.lit(0))).alias(name))


def every_kth(df: DataFrame, keys: list[str], at: str, budget: int) -> DataFrame:
    """At most about budget rows of each key, evenly by their order: the sampling is the feature.

    Rows are numbered over all keys by range partitions, so that a key with most of the rows is many tasks' work.
    """
    rows = numbered(df, [*keys, at], "__i", 0)
    sizes = rows.groupBy(*keys).agg(F.min("__i").alias("__first"), F.ceil(F.count("*") / budget).alias("__s"))
    sizes = sizes.withColumnsRenamed({k: f"__{k}" for k in keys})
    return rows.join(sizes, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).where("(__i - __first) % __s = 0").select(df.columns)


def natural_key(c: Column) -> list[Column]:
    """Numbers before texts, numbers by value."""
    return [F.expr(f"try_cast({c._jc.toString()} as bigint)").asc_nulls_last(), c.asc()]


def same_bag(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, rows: what either has more of; both are 0 for equal multisets."""
    left, right = a.exceptAll(b), b.exceptAll(a)
    return left.agg(F.count("*").alias("n")).select(F.lit("left").alias("side"), "n").unionByName(right.agg(F.count("*").alias("n")).select(F.lit("right").alias("side"), "n"))


def first_by(df: DataFrame, subset: list[str], order: list[str]) -> DataFrame:
    """One row for each value of subset: the first in order."""
    return top(df, subset, [F.col(o) for o in order], 1)
