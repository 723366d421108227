"""Nearest neighbours by score-aware anisotropic quantisation.

Euclidean nearness to a query q is the inner product q.x less half of |x|^2. Vectors are
quantised in subspaces of four dimensions with 16 codewords each (four bits);
the codebooks and the codes penalise the residual parallel to a vector more than
the rest of it, since that part changes large inner products.

1. code:   each vector gets its codes and its list, the nearest of k-means
           centres; there is a list for LIST_ROWS vectors, up to LISTS. Of equal
           vectors of a task only the least ids that can count go on.
2. probe:  PROBE_QUERIES of the queries (the smallest hashes of ids) are measured
           against all vectors; the number of lists that a query asks is the
           least with which PROBE_RECALL of their neighbours lie in asked lists.
3. scan:   lists are dealt in blocks of vectors and blocks of queries, so that no
           list is one task's work; vectors and queries meet by shuffle and
           neither is broadcast. A query's table is added up over a block's codes,
           the best REFINE are measured exactly, and so is every other row whose
           score, raised by DEVIATIONS of the block's quantisation error along the
           query, reaches the nearest of those: codes that can't tell rows apart
           leave none out.
4. rank:   a block hands on a query's nearest; they are ranked by query.

The codebooks and list centres are fitted on at most SAMPLE vectors (the smallest
hashes of ids); all vectors are searched. With exact, all lists are asked and all
rows measured.

Cases: vectors that are null, zero, or hold null or non-finite components take no
part; null ids neither; vectors of several dimensions are searched among those of
their own; equal vectors of a block are scanned once, and all their ids count;
ties go to the smaller id; a repeated row counts once; rows of one id with several
vectors are candidates of their own, a query takes the least of them, and rows
with a query's id are no candidates of it; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE = 20_000
BLOCK = 16_384  # vectors of a block
QUERIES = 4096  # queries of a block
REFINE = 256
DEVIATIONS = 3  # of the quantisation error, by which a row's score may be too low
SUB = 4
CODES = 16
LIST_ROWS = 1000
LISTS = 1024
PROBE_QUERIES = 256
PROBE_RECALL = 0.99
THRESHOLD = 0.2  # cosine from which inner products count, in the anisotropic weight
SWEEPS = 6


class Index(NamedTuple):
    dim: int
    books: np.ndarray  # subspace, code, place
    weight: float  # of the parallel residual, less 1
    centres: np.ndarray


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles from binary values of 8-byte floats."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def usable(table: DataFrame) -> DataFrame:
    """vec_id, x (doubles), dim of the rows that take part."""
    cast = table.selectExpr("cast(vec_id as bigint) vec_id", "cast(embedding as array<double>) x")
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    return cast.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.coalesce(sound, F.lit(False))).withColumn("dim", F.size("x"))


def pad(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % SUB))).reshape(len(x), -(-x.shape[1] // SUB), SUB)


def encode(x: np.ndarray, books: np.ndarray, weight: float, sweeps: int = 3) -> np.ndarray:
    """Codes of x: coordinate descent over subspaces on |r|^2 + weight * (r.x)^2 / |x|^2."""
    s = pad(x)
    w = weight / np.maximum((x**2).sum(1), 1e-300)
    error = ((s[:, :, None, :] - books[None]) ** 2).sum(3)  # row, subspace, code
    along = np.einsum("nms,nms->nm", s, s)[:, :, None] - np.einsum("nms,mcs->nmc", s, books)
    codes = error.argmin(2)
    rows = np.arange(len(x))
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(sweeps):
        for m in range(s.shape[1]):
            rest = total - along[rows, m, codes[:, m]]
            codes[:, m] = (error[:, m] + w[:, None] * (rest[:, None] + along[:, m]) ** 2).argmin(1)
            total = rest + along[rows, m, codes[:, m]]
    return codes


def fit(x: np.ndarray, dim: int, lists: int = 32) -> Index:
    """Codebooks by alternating codes and weighted least squares; list centres by k-means."""
    rng = np.random.default_rng(3)
    weight = max(0.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2) - 1)
    s = pad(x)
    m_all = s.shape[1]
    if not len(x):
        return Index(dim, np.zeros((m_all, CODES, SUB)), weight, np.zeros((1, dim)))
    books = s[rng.integers(0, len(x), CODES)].transpose(1, 0, 2).copy()
    books += rng.normal(0, 1e-6, books.shape)
    w = weight / (x**2).sum(1)
    for _ in range(SWEEPS):
        codes = encode(x, books, weight, 1)
        r = np.einsum("nms,nms->nm", s - books[np.arange(m_all), codes], s)
        for m in range(m_all):
            rest = r.sum(1) - r[:, m]
            for c in range(CODES):
                on = codes[:, m] == c
                if not on.any():
                    books[m, c] = s[rng.integers(0, len(x)), m]
                    continue
                y = s[on, m]
                left = on.sum() * np.eye(SUB) + (y * w[on, None]).T @ y
                right = (y * (1 + w[on] * (rest[on] + (y**2).sum(1)))[:, None]).sum(0)
                books[m, c] = np.linalg.solve(left, right)
            r[:, m] = ((s[:, m] - books[m, codes[:, m]]) * s[:, m]).sum(1)
    k = min(lists, len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        near = nearest_lists(x, centres, 1)[:, 0]
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, j], k) for j in range(dim)], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], centres)
    return Index(dim, books, weight, centres)


def nearest_lists(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    d = (centres**2).sum(1) - 2 * x @ centres.T
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte."""
    codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2))).astype(np.uint8)
    return codes[:, 0::2] << 4 | codes[:, 1::2]


def tables_of(index: Index, q: np.ndarray) -> np.ndarray:
    """Query, byte, value: inner products of a query with what a byte of codes stands for."""
    t = np.einsum("qms,mcs->qmc", pad(q), index.books).astype(np.float32)
    t = np.pad(t, ((0, 0), (0, t.shape[1] % 2), (0, 0)))
    return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, CODES * CODES)


def collapsed(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places of distinct rows in order of vector, then id: of equal vectors the k + 1 least ids, since one of them may be a query's own."""
    order = np.lexsort((ids, *x.T[::-1]))
    new = np.append(True, (x[order[1:]] != x[order[:-1]]).any(1))[: len(ids)]
    order = order[new | np.append(True, ids[order[1:]] != ids[order[:-1]])[: len(ids)]]
    new = np.append(True, (x[order[1:]] != x[order[:-1]]).any(1))[: len(order)]
    start = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank <= k]


def scan(index: Index, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, k: int, exact: bool = False):
    """(query number, id, distance) of each query's k nearest of a block. codes: packed, of the rows of x."""
    order = collapsed(ids, x, k)
    ids, x, codes = ids[order], x[order], codes[order]
    first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(1)))
    copies = np.diff(np.append(first, len(x)))
    u, codes = x[first], codes[first].astype(np.intp)
    half, norm = (u**2).sum(1) / 2, (q**2).sum(1)
    m = index.books.shape[0]
    flat = np.stack([codes >> 4, codes & 15], 2).reshape(len(u), -1)[:, :m]
    r = u - index.books[np.arange(m), flat].reshape(len(u), -1)[:, : u.shape[1]]
    slack = np.sqrt(np.maximum(0, ((q @ (r.T @ r / len(u))) * q).sum(1)))
    mine, n_mine = np.unique(ids[np.isin(ids, q_ids)], return_counts=True)
    own = np.zeros(len(q), int)
    at = np.searchsorted(q_ids, mine)
    own[at] = n_mine  # rows of a query's own id are no candidates
    every, refine = np.arange(len(u)), min(REFINE, len(u))
    step = max(1, min(64, 4_000_000 // (refine * q.shape[1])))
    out = []
    for low in range(0, len(q), step):
        part = slice(low, low + step)
        score = None
        if len(u) > refine and not exact:
            tables = tables_of(index, q[part])
            score = np.repeat(-half[None].astype(np.float32), len(tables), 0)
            for j in range(codes.shape[1]):
                score += np.take(tables[:, j], codes[:, j], axis=1)
            cut = np.argpartition(-score, refine - 1, axis=1)[:, :refine]
            best = np.sort((u[cut] @ q[part, :, None])[:, :, 0] - half[cut], axis=1)
        for i in range(low, min(low + step, len(q))):
            at = every
            if score is not None and k + own[i] <= refine:
                more = score[i - low] + DEVIATIONS * slack[i] >= best[i - low, -(k + own[i])]
                more[cut[i - low]] = True
                at = np.flatnonzero(more)
            near = u[at] @ q[i] - half[at]
            n = min(len(at), k + own[i])
            at = at[near >= np.partition(near, -n)[-n] - 1e-9 * (half[at].max() + norm[i])]  # rounding
            d = np.sqrt(((u[at] - q[i]) ** 2).sum(1))
            n = copies[at]
            place = np.repeat(first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found, dist = ids[place], np.repeat(d, n)
            other = found != q_ids[i]
            found, dist = found[other], dist[other]
            best_k = np.lexsort((found, dist))[:k]
            out.append((np.full(len(best_k), i), found[best_k], dist[best_k]))
    return [np.concatenate(z) for z in zip(*out, strict=True)]


def coded(rows: DataFrame, index, dim: int, k: int) -> DataFrame:
    """list, vec_id, x (binary), codes of rows; equal vectors of a task's block are collapsed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            held.clear()
            ids, x = t.column("vec_id").to_numpy(), t.column("x").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, dim)
            at = collapsed(ids, x, k)
            ids, x = ids[at], np.ascontiguousarray(x[at], "<f8")
            codes = packed(encode(x, index.value.books, index.value.weight))
            member = nearest_lists(x, index.value.centres, 1)[:, 0]
            return pa.record_batch({"list": pa.array(member, pa.int32()), "vec_id": pa.array(ids, pa.int64()), "x": pa.array([v.tobytes() for v in x], pa.binary()), "codes": pa.array([c.tobytes() for c in codes], pa.binary())})

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(h.num_rows for h in held) >= BLOCK // 2:
                yield done()
        if held:
            yield done()

    return rows.select("vec_id", "x").mapInArrow(work, "list int, vec_id long, x binary, codes binary")


def calibrated(vectors: DataFrame, asked: DataFrame, index: Index, dim: int, k: int) -> int:
    """How many lists a query must ask: told by the true neighbours of a bounded sample of the queries."""
    sample = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBE_QUERIES).toArrow()
    if not sample.num_rows or len(index.centres) == 1:
        return len(index.centres)
    q_ids, q = sample.column("vec_id").to_numpy(), sample.column("x").combine_chunks().values.to_numpy().reshape(-1, dim)
    shared = vectors.sparkSession.sparkContext.broadcast((q_ids, q))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            _, one = np.unique(b.column("vec_id").to_numpy(), return_index=True)  # a row may be there from several tasks
            b = b.take(pa.array(one))
            ids, x = b.column("vec_id").to_numpy(), matrix(b.column("x"), dim)
            d = (x**2).sum(1) - 2 * q @ x.T
            d[ids[None] == q_ids[:, None]] = np.inf
            at = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
            who = np.repeat(np.arange(len(q)), at.shape[1])
            told = b.select(["list", "vec_id"]).take(pa.array(at.ravel()))
            yield pa.record_batch({"q": pa.array(who, pa.int32()), "list": told.column("list"), "vec_id": told.column("vec_id"), "d": pa.array(d[who, at.ravel()])})

    near = vectors.select("list", "vec_id", "x").mapInArrow(work, "q int, list int, vec_id long, d double").where("d < double('infinity')").distinct()
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("d", "list"))).where(F.col("n") <= k).select("q", "list").toArrow()  # k a query
    order = nearest_lists(q, index.centres, len(index.centres)).argsort(1)
    rank = np.sort(order[near.column("q").to_numpy(), near.column("list").to_numpy()])
    return int(rank[min(len(rank) - 1, int(np.ceil(PROBE_RECALL * len(rank))) - 1)]) + 1 if len(rank) else 1


def probing(asked: DataFrame, index, dim: int, probes: int) -> DataFrame:
    """list, vec_id, x of each query, a row for each list that it asks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = b.column("x").values.to_numpy().reshape(-1, dim)
                lists = nearest_lists(q, index.value.centres, probes)
                x = pa.array([v.tobytes() for v in np.ascontiguousarray(q, "<f8")], pa.binary())
                every = pa.array(np.repeat(np.arange(len(q)), lists.shape[1]))
                yield pa.record_batch({"list": pa.array(lists.ravel(), pa.int32()), "vec_id": b.column("vec_id").take(every), "x": x.take(every)})

    return asked.select("vec_id", "x").mapInArrow(work, "list int, vec_id long, x binary")


def met(dealt: DataFrame, index, dim: int, k: int, exact: bool) -> DataFrame:
    """query_id, vec_id, score from rows (list, v, q, asks, vec_id, x, codes) of blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            asks = t.column("asks").to_numpy()
            some, rest = t.filter(pa.array(asks)), t.filter(pa.array(~asks))
            if not some.num_rows or not rest.num_rows:
                return pa.record_batch({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            some = some.sort_by("vec_id")
            q_ids = some.column("vec_id").to_numpy()
            codes = np.frombuffer(b"".join(rest.column("codes").to_pylist()), np.uint8).reshape(rest.num_rows, -1)
            i, ids, d = scan(index.value, q_ids, matrix(some.column("x"), dim), rest.column("vec_id").to_numpy(), matrix(rest.column("x"), dim), codes, k, exact)
            return pa.record_batch({"query_id": pa.array(q_ids[i], pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(d, pa.float64())})

        last = None
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("list", "v", "q")], 1)
            cuts = np.append(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key))
            low = 0
            for high in cuts.tolist():
                if high > low:
                    if held and tuple(key[low]) != last:
                        yield done()
                        held.clear()
                    held.append(b.slice(low, high - low))
                    last, low = tuple(key[low]), high
        if held:
            yield done()

    return dealt.mapInArrow(work, "query_id long, vec_id long, score double")


def search(table: DataFrame, queries: DataFrame, k: int = 10, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest in table (vec_id, embedding) of each row of queries."""
    spark = table.sparkSession
    path = common.new_path(spark, "nearest")
    spark.createDataFrame([], "query_id long, vec_id long, score double").write.parquet(path)
    every, asked = usable(table), usable(queries).groupBy("dim", "vec_id").agg(F.min("x").alias("x"))
    for dim, n in sorted(tuple(r) for r in every.groupBy("dim").agg(F.count("*")).collect()):
        _search(every.where(F.col("dim") == dim), asked.where(F.col("dim") == dim), dim, n, k, exact).write.mode("append").parquet(path)
    found = spark.read.schema("query_id long, vec_id long, score double").parquet(path).distinct()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, asked: DataFrame, dim: int, n: int, k: int, exact: bool) -> DataFrame:
    spark = rows.sparkSession
    sample = rows.select("vec_id", "x").orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(SAMPLE).toArrow()
    fitted = fit(sample.column("x").combine_chunks().values.to_numpy().reshape(-1, dim), dim, int(np.clip(n // LIST_ROWS, 1, LISTS)))
    index = spark.sparkContext.broadcast(fitted)  # LISTS centres and the codebooks
    vectors = common.durable(coded(rows, index, dim, k), "coded")
    asked = common.durable(asked.select("vec_id", "x"), "asked")
    probes = len(fitted.centres) if exact else calibrated(vectors, asked, fitted, dim, k)
    probed = common.durable(probing(asked, index, dim, probes), "probed")
    blocks = vectors.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("vs"))
    blocks = blocks.join(probed.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qs")), "list")  # LISTS rows at most
    deal = lambda of, many: F.pmod(F.xxhash64(of), F.col(many)).cast("int")
    spread = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    one = vectors.join(F.broadcast(blocks), "list").select("list", deal("vec_id", "vs").alias("v"), spread("qs").alias("q"), F.lit(False).alias("asks"), "vec_id", "x", "codes")
    two = probed.join(F.broadcast(blocks), "list").select("list", spread("vs").alias("v"), deal("vec_id", "qs").alias("q"), F.lit(True).alias("asks"), "vec_id", "x", F.lit(None).cast("binary").alias("codes"))
    dealt = one.unionByName(two).repartition("list", "v", "q").sortWithinPartitions("list", "v", "q")
    return met(dealt, index, dim, k, exact)
