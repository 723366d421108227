"""Values computed once however often a plan names them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def once(df: DataFrame, **values: Column) -> DataFrame:
    """df with columns that later projections and filters can't be folded into, so that each is computed once a row."""
    held = F.explode(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))).alias("__once")
    kept = [c for c in df.columns if c not in values]
    return df.select("*", held).select(*kept, *[F.col(f"__once.{n}").alias(n) for n in values])
