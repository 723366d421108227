"""Spatial joins on grids: an equi-join of cells, then bounds, then the exact test.

Cells double from level to level. A box is held at the level whose cells are as
large as it, so in four of them at most, however large it is; it is met there by
smaller boxes, which are dealt to the levels that occur on the other side as well.
A pair that shares several cells is kept in the cell of the least corner of the
two bounds' overlap alone, so no shuffle for duplicates is needed. Hot cells are
split by adaptive execution, as any skewed join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import planar


def cells(bounds: Column, size: Column | float) -> Column:
    """All grid cells that bounds (min x, min y, max x, max y) touch."""
    span = lambda lo, hi: F.sequence(F.floor(lo / size), F.floor(hi / size))
    return F.flatten(F.transform(span(bounds[0], bounds[2]), lambda cx: F.transform(span(bounds[1], bounds[3]), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


FINER = 2  # doublings by which polygons that points are looked up in lie in finer cells, 25 at most, so that many cells are wholly inside


def level(bounds: Column, size: float, finer: int = 0) -> Column:
    """How often a cell of size must double to be as large as the bounds, less finer."""
    side = F.greatest(bounds[2] - bounds[0], bounds[3] - bounds[1], F.lit(size)) / size
    return F.greatest(F.ceil(F.log2(side) - 1e-9).cast("int") - finer, F.lit(0))


def levels_of(df: DataFrame, bounds: str, size: float, finer: int = 0) -> list[int]:
    """The levels that occur: a few dozen numbers at most, since cells double."""
    return sorted(r[0] for r in df.select(level(F.col(bounds), size, finer)).distinct().collect() if r[0] is not None)


def dealt(df: DataFrame, bounds: str, size: float, others: list[int], finer: int = 0) -> DataFrame:
    """df with __at (level and cell) and __own: a row for each cell at its own level, and at the higher ones of others."""
    b, own = F.col(bounds), level(F.col(bounds), size, finer)
    higher = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda n: n > own)
    every = F.concat(F.array(own), higher)
    at = F.flatten(F.transform(every, lambda n: F.transform(cells(b, size * F.pow(F.lit(2.0), n)), lambda c: F.struct(n.alias("level"), c["cx"].alias("cx"), c["cy"].alias("cy")))))
    return df.withColumn("__own", own).withColumn("__at", F.explode(at)).withColumn("__own", F.col("__at.level") == F.col("__own"))


def spatial_join(left: DataFrame, right: DataFrame, size: float, test: Callable[[DataFrame], Column] | None = None, on: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Pairs of rows whose `l_bounds` and `r_bounds` meet and that pass test; on: columns that must be equal as well.

    how: inner, or left_semi for the left rows that have a partner. Columns of the two sides must differ in name.
    """
    l_all = dealt(left, "l_bounds", size, levels_of(right, "r_bounds", size)).withColumnRenamed("__own", "__l")
    r_all = dealt(right, "r_bounds", size, levels_of(left, "l_bounds", size)).withColumnRenamed("__own", "__r")
    a, b, cell = F.col("l_bounds"), F.col("r_bounds"), size * F.pow(F.lit(2.0), F.col("__at.level"))
    meet = (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])
    owner = (F.floor(F.greatest(a[0], b[0]) / cell) == F.col("__at.cx")) & (F.floor(F.greatest(a[1], b[1]) / cell) == F.col("__at.cy"))
    pairs = l_all.join(r_all, ["__at", *(on or [])]).where((F.col("__l") | F.col("__r")) & meet & owner)
    if test is not None:
        pairs = pairs.where(test(pairs))
    pairs = pairs.drop("__at", "__l", "__r")
    if how == "left_semi":
        key = [c for c in left.columns if c != "l_bounds"]
        return left.join(pairs.select(*key).distinct(), key, "left_semi")
    return pairs


def ring_edges(edges: DataFrame, key: str) -> DataFrame:
    """key, edges (array of struct), bounds: one row a polygon, all its rings together."""
    e = edges.groupBy(key).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"), *[F.min(c).alias(f"n_{c}") for c in ("x1", "y1")], *[F.max(c).alias(f"m_{c}") for c in ("x1", "y1")])
    return e.select(key, "edges", F.array("n_x1", "n_y1", "m_x1", "m_y1").alias("bounds"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, prepared: bool = True) -> DataFrame:
    """Points with each polygon (as ring_edges gives them) that holds them, by crossing parity; bounds are half-open.

    A polygon lies in cells of its own level, and a point is dealt to the levels that occur among the polygons.
    prepared: a polygon's cells that no edge touches are wholly inside or outside; the latter go, the former need no
    edge test, and in the rest the edges that can't be met are left out.
    """
    b, key = F.col("bounds"), [c for c in polygons.columns if c not in ("edges", "bounds")]
    found = levels_of(polygons, "bounds", size, FINER)
    p = dealt(polygons, "bounds", size, [], FINER).drop("__own")
    if prepared:
        side = size * F.pow(F.lit(2.0), F.col("__at.level"))
        x0, y0 = F.col("__at.cx") * side, F.col("__at.cy") * side
        beside = F.filter("edges", lambda e: (F.greatest(e["y1"], e["y2"]) >= y0) & (F.least(e["y1"], e["y2"]) <= y0 + side) & (F.greatest(e["x1"], e["x2"]) >= x0))
        touched = F.exists(beside, lambda e: F.least(e["x1"], e["x2"]) <= x0 + side)
        centre = planar.inside(x0 + side / 2, y0 + side / 2, F.col("edges"))
        p = p.withColumn("__touched", touched).withColumn("__full", ~F.col("__touched") & centre).where("__touched OR __full")
        p = p.withColumn("edges", F.when(F.col("__full"), F.slice("edges", 1, 0)).otherwise(beside))
    else:
        p = p.withColumn("__full", F.lit(False))
    at = [F.struct(F.lit(n).alias("level"), F.floor(F.col("x") / (size * 2.0**n)).alias("cx"), F.floor(F.col("y") / (size * 2.0**n)).alias("cy")) for n in found or [0]]
    q = points.withColumn("__at", at[0] if len(at) == 1 else F.explode(F.array(*at)))
    within = (F.col("x") >= b[0]) & (F.col("x") < b[2]) & (F.col("y") >= b[1]) & (F.col("y") < b[3])
    # Cells of polygons are many times what their source's size lets the planner expect, so they must not be broadcast.
    held = q.join(p.hint("merge"), "__at").where(within & (F.col("__full") | planar.inside(F.col("x"), F.col("y"), F.col("edges"))))
    return held.select(*points.columns, *key)


def capped(points: DataFrame, key: str, most: int) -> DataFrame:
    """key, n, exceeded of each group, and the points of those within the limit in `points`; all points count."""
    n = points.groupBy(key).agg(F.count("*").alias("n")).withColumn("exceeded", F.col("n") > most)
    return n


def batches(df: DataFrame, x: str, y: str, size: float, order: str, most: int) -> DataFrame:
    """df with cx, cy and part: rows of a cell in parts of at most most, in order."""
    from pyspark.sql import Window

    out = df.withColumn("cx", F.floor(F.col(x) / size)).withColumn("cy", F.floor(F.col(y) / size))
    rank = F.row_number().over(Window.partitionBy("cx", "cy").orderBy(order)) - 1
    return out.withColumn("part", F.floor(rank / most))


def with_tiles(polygons: DataFrame, tiles: DataFrame, size: float) -> DataFrame:
    """polygon key, tile: the tiles that each polygon's bounds meet; from it, polygons by tile are a groupBy."""
    return spatial_join(polygons, tiles, size)
