"""Best-fit packing of token sequences by minimum bin slack.

Documents become token pieces of at most the capacity. For each bin the longest
piece left is set, and a subset-sum dynamic programme over the lengths that are
left, held as bits of an integer, finds the fullest combination beside it. The
combination is a pattern of lengths; it is used as often as the pieces last, so
that the work depends on the number of distinct lengths (at most the capacity)
and not on the number of pieces. Pieces take their places in the patterns by
their rank among the pieces of their length.

Cases: null or empty text is the end id alone; only longer documents are cut,
into as many pieces as they need; pieces of one length are taken in the order of
their tasks and places, and of equally full combinations the one of the longer
pieces; repeated rows and null ids are pieces of their own; an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .wordbpe import word_ids

CAPACITY = 4096
END_ID = 1
RANKS = 1 << 46  # ranks of one length stay below this


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece, with its task and its rank among the pieces of its length in that task."""
    end = struct.pack("<I", END_ID)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for pdf in batches:
            out, kept = [], []
            for doc, ids in zip(pdf["doc_id"], word_ids(path)([t or "" for t in pdf["text"]]), strict=True):
                ids += end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    length = len(part) // 4
                    out.append((doc, k, start, length, zlib.crc32(part), task, seen[length]))
                    seen[length] += 1
                    if with_ids:
                        kept.append(np.frombuffer(part, "<u4").astype(np.int64))
            told = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])
            yield told.assign(ids=pd.Series(kept, dtype=object)) if with_ids else told

    schema = "doc_id string, piece int, start long, length long, ids_crc32 long, task int, place long" + ", ids array<long>" * with_ids
    return common.typed(common.texts(docs).mapInPandas(rows, schema), docs)


def fullest(room: int, left: dict[int, int], lengths: list[int]) -> dict[int, int]:
    """The combination of lengths left with the largest sum up to room; lengths: descending."""
    reach, steps, inside, goal = 1, [], (1 << (room + 1)) - 1, 1 << room
    for x in lengths:
        if x > room or not left[x]:
            continue
        n, k = min(left[x], room // x), 1
        while n and not reach & goal:
            k = min(k, n)
            steps.append((x, k, reach))
            reach |= (reach << (x * k)) & inside
            n, k = n - k, 2 * k
        if reach & goal:
            break
    total, taken = reach.bit_length() - 1, {}
    for x, k, before in reversed(steps):
        if not before >> total & 1:
            taken[x] = taken.get(x, 0) + k
            total -= x * k
    return taken


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(lengths with multiplicity, times): together they use each length as often as counts says."""
    left = {x: n for x, n in counts.items() if n}
    out = []
    lengths = sorted(left, reverse=True)
    while lengths:
        first = lengths[0]
        left[first] -= 1
        bin_ = fullest(capacity - first, left, lengths)
        left[first] += 1
        bin_[first] = bin_.get(first, 0) + 1
        times = min(left[x] // m for x, m in bin_.items())
        for x, m in bin_.items():
            left[x] -= times * m
        out.append((bin_, times))
        if any(not left[x] for x in bin_):
            lengths = [x for x in lengths if left[x]]
    return out


def placement(found: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length and range of ranks: first sequence, pieces a sequence, and offset. At most capacity patterns of few lengths: bounded."""
    rows, used, sequence = [], {}, 0
    for bin_, times in found:
        at = 0
        for x, m in sorted(bin_.items(), reverse=True):
            rows.append((x * RANKS + used.get(x, 0), sequence, m, at))
            used[x] = used.get(x, 0) + m * times
            at += x * m
        sequence += times
    rows.sort()
    return dict(zip(("key", "sequence", "each", "offset"), np.array(rows, np.int64).reshape(-1, 4).T, strict=True))


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: each piece's place."""
    spark = docs.sparkSession
    cut = common.durable(pieces(docs, capacity, path), "pieces")
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    table = spark.sparkContext.broadcast(placement(patterns(counts, capacity)))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = table.value
        for pdf in batches:
            if pdf.empty:
                continue
            length, rank = pdf["length"].to_numpy(), (pdf["place"] + pdf["before"]).to_numpy()
            i = np.searchsorted(t["key"], length * RANKS + rank, side="right") - 1
            k = length * RANKS + rank - t["key"][i]
            yield pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(
                sequence_id=t["sequence"][i] + k // t["each"][i], offset=t["offset"][i] + k % t["each"][i] * length
            )

    cut = cut.withColumn("doc_id", F.col("doc_id").cast("string"))
    placed = cut.join(before.drop("n"), ["task", "length"]).mapInPandas(
        rows, "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return common.typed(placed, docs)
