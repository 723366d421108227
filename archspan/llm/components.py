"""Distributed connected components by alternating stars.

Each round points the larger neighbours of a node to the smallest one around it
(large star), then the smaller ones (small star), until the edges are stars
around components' least nodes. Minima are combined before they are shuffled, and
the edges of a node with more than its share of all edges are dealt in parts, in
which minima are taken first, so that a hub is many tasks' work. Each round ends
in a table in the shared folder; the tables before it are removed. Up to FEW
edges, of which a task holds many times as many, one task labels all nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROUNDS = 60
FEW = 250_000  # edges: 4 MB
LEAST_HUB = 256  # edges from which a node may be a hub
MOST_HUBS = 100_000  # a node is a hub beyond this share of all edges, so there are at most twice as many: a small broadcast


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.expr("sum(cast(xxhash64(v, u) as decimal(38, 0)))").alias("s")).first()
    return row["n"], row["x"], row["s"]


def labelled(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of edges, and the least node that each can reach."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):  # labels go to the least around, then to their own label
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def _together(edges: DataFrame) -> DataFrame:
    """node, component of few edges, by one task without a shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            nodes, least = labelled(t.column("u").to_numpy(), t.column("v").to_numpy())
            yield pa.record_batch({"node": pa.array(nodes, pa.int64()), "component": pa.array(least, pa.int64())})

    return edges.coalesce(1).mapInArrow(rows, "node long, component long")


def _near(pairs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(u, m), the least around each node or itself; and pairs with the m of their u. n: how many edges there are."""
    part = max(LEAST_HUB, n // MOST_HUBS)
    hubs = pairs.groupBy("u").agg(F.count("*").alias("d")).where(F.col("d") > part).select(F.col("u").alias("hub"), F.ceil(F.col("d") / part).cast("int").alias("parts"))
    dealt = pairs.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left")
    dealt = dealt.select("u", "v", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.col("parts"))).cast("int").alias("part"))
    by_part = dealt.groupBy("u", "part").agg(F.min("v").alias("m"))
    least = by_part.groupBy("u").agg(F.min("m").alias("m")).select("u", F.least("u", "m").alias("m"))
    return least, dealt.join(by_part.select("u", "part").join(least, "u"), ["u", "part"])


def _star(pairs: DataFrame, large: bool, n: int) -> DataFrame:
    """pairs (u, v), both ways for the large star, v < u for the small star."""
    least, near = _near(pairs, n)
    if large:
        return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    there = near.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return there.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def connected_components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """node, component (the least node that can be reached): nodes of edges (u, v) alone. Null ends and loops are no edges, and repeated edges count once."""
    kept = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = common.written(kept, "edges", files) if files else common.durable(kept, "edges")
    if now.schema["u"].dataType.simpleString() == "bigint" and now.count() <= FEW:
        return _together(now)
    now = common.durable(now.distinct(), "edges")
    before = None
    for _ in range(ROUNDS):
        state = _state(now)
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = common.durable(_star(both, True, state[0]), "large")
        old, now = now, common.durable(_star(large, False, state[0]), "edges")
        common.forget(old, large)
    else:
        raise RuntimeError("components did not settle")
    centres = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
