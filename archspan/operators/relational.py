"""Keyed relational operators: pending work, keyed updates, insert-if-absent, anti and lookup joins."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import spatial_join


def pending(df: DataFrame, conditions: list[Column], cell: Column | None = None, key: str = "underpass_id", limit: int | None = None) -> DataFrame:
    """Rows that meet all conditions, in the order of cell and key; limit is for a report or a trial run."""
    out = df.where(reduce(and_, conditions)) if conditions else df
    out = out.orderBy(*([cell] if cell is not None else []), key)
    return out.limit(limit) if limit else out


def lookup(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of df whose key is asked for, once each."""
    return df.join(keys, on, "left_semi")


def unprocessed(df: DataFrame, *done: tuple[DataFrame, list[str]]) -> DataFrame:
    """Rows of df that are in none of the done tables, by their keys."""
    for table, keys in done:
        df = df.join(table, keys, "left_anti")
    return df


def insert_if_absent(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """target and the rows of new whose keys it lacks; of new rows with one key the first by all columns goes in."""
    first = new.groupBy(*keys).agg(F.min(F.struct(*[c for c in target.columns if c not in keys])).alias("__row"))
    fresh = first.join(target, keys, "left_anti")
    return target.unionByName(fresh.select(*keys, "__row.*").select(target.columns))


def keyed_update(target: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """target with columns from changes where the key matches, null values included; other rows stay as they are."""
    new = changes.select(*keys, F.struct(*columns).alias("__new"))
    out = target.join(new, keys, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)))
    return out.select(target.columns)


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with each column that it lacks, as nulls of the type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def source_of(status: Column) -> Column:
    """The source that a status stands for."""
    return F.when(status == "success", "streetlidar").when(status.isNotNull(), "fallback")


def with_fallback(features: DataFrame, values: DataFrame, key: str, value: str, low: float, high: float) -> DataFrame:
    """Features with their value, or one in [low, high) from a hash of the key, and where it came from. A hash, since the draw of a seeded generator depends on row order."""
    drawn = low + (high - low) * (F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(10_000)) / 10_000.0)
    out = features.join(values.select(key, value), key, "left")
    return out.withColumn("source", F.when(F.col(value).isNull(), "fallback").otherwise("measured")).withColumn(value, F.coalesce(value, drawn))


def larger_containers(df: DataFrame, key: str, group: str, bounds: str, inside: Column, size: float) -> DataFrame:
    """Rows that no other row of their group contains. inside: of columns i_* in o_*, whose bounds must meet as well; ties stay with the smaller key.

    Rows meet in cells of a grid, so a large group is no single key.
    """
    i = df.select(*[F.col(c).alias(f"i_{c}") for c in df.columns], F.col(bounds).alias("l_bounds"), F.col(group).alias("__g"))
    o = df.select(*[F.col(c).alias(f"o_{c}") for c in df.columns], F.col(bounds).alias("r_bounds"), F.col(group).alias("__g"))
    held = spatial_join(i, o, size, lambda _: (F.col(f"i_{key}") != F.col(f"o_{key}")) & inside, ["__g"])
    return df.join(held.select(F.col(f"i_{key}").alias(key)).distinct(), key, "left_anti")


def checked_lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """df with what table holds of its key, and __missing where it holds nothing."""
    return df.join(table.withColumn("__there", F.lit(True)), key, "left").withColumn("__missing", F.col("__there").isNull()).drop("__there")


def status_ladder(n: Column, tiles: Column, most: int, least: int) -> Column:
    """The first reason against a task, in the fixed order, or 'task'."""
    return F.when(tiles == 0, "no_laz_tiles").when(n > most, "too_many_points").when(n == 0, "no_points").when(n < least, "too_few_points").otherwise("task")
