"""Near-duplicates by SetSketch registers.

1. sets:       each text's distinct word shingles give a fingerprint of the set,
               its size, and SetSketch registers. Texts of one fingerprint are
               one class, whose least id stands for it.
2. bands:      classes whose registers agree in a band meet in a bucket. In a
               bucket of up to SMALL classes all pairs are estimated by joint
               likelihood; larger buckets are dealt in blocks, each with the
               bucket's least class, and a block gives a spanning forest of its
               likeliest pairs.
3. verify:     pairs are confirmed on the full sets of the two texts.
4. components: of the confirmed links. Classes that meet in large buckets and
               are still in several components form families. A class whose
               shingles are found in too few other components of its family
               can't reach the similarity with any of them, whatever its size,
               and goes; that is counted for all classes at once, again and again
               while many go. All pairs across components of those left, of sizes that allow
               a link, are confirmed, block by block, with no pair written out:
               no link is left out.

Cases: empty text or text without words: an empty set, linked with nothing;
null text is empty text; rows of one doc_id are one document; a null doc_id has
its class's component, which is null where no member has an id, and is kept; a
repeated row gives a repeated result; an empty table gives an empty result;
columns other than doc_id (an integer) and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .setsketch import REGISTERS, similarity, sketches
from .shingles import mixed, shingle_sets
from .wordbpe import spread

WORDS = 5
PERCENT = 80
ROWS = 4  # registers of a band
SMALL = 64
BLOCK = 512
HOT, MOST_HOT = 256, 100_000  # rows from which a group may be hot, and how many hot groups there may be
DEVIATIONS = 5  # of the estimate, below the threshold, up to which pairs are confirmed
PAIRS_AT_ONCE = 40_000
EXACT_BLOCK = 256  # sets whose intersections are taken at once
SHINGLES = 500_000  # of a block of a family, at most: with fewer in all, blocks are smaller,
PARTS, LEAST_SHINGLES = 8, 10_000  # so that there are about so many, but none smaller than this
PEEL_FROM, PEELS = 5_000_000, 4  # shingles of all families from which it pays to rule classes out first
COLUMNS = 4096


def describe(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, fingerprint (two longs) and sketch of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, n = shingle_sets(b.column("text").to_pylist(), words)
            sums = np.zeros((2, len(n)), np.uint64)
            at, on = (np.cumsum(n) - n)[n > 0], n > 0
            if on.any():
                sums[0, on] = np.add.reduceat(mixed(h ^ np.uint64(0x5851F42D4C957F2D)), at)
                sums[1, on] = np.add.reduceat(mixed(h * np.uint64(0x2545F4914F6CDD1D)), at)
            sketch = sketches(h, n)
            yield pa.record_batch(
                {
                    "doc_id": b.column("doc_id"),
                    "n_shingles": pa.array(n, pa.int64()),
                    "f1": pa.array(sums[0].view(np.int64)),
                    "f2": pa.array(sums[1].view(np.int64)),
                    "sketch": pa.array([s.tobytes() for s in sketch], pa.binary()),
                }
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(rows, "doc_id long, n_shingles long, f1 long, f2 long, sketch binary")


def band_keys(classes: DataFrame) -> DataFrame:
    """(key, node): a class in each of its bands; a key is the band and its registers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            regs = registers(b.column("sketch"))
            bands = np.ascontiguousarray(regs).view(np.uint64)  # four registers each
            keys = mixed(bands ^ (np.arange(1, bands.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            nodes = np.repeat(b.column("node").to_numpy(zero_copy_only=False), bands.shape[1])
            yield pa.record_batch({"key": pa.array(keys.ravel().view(np.int64)), "node": pa.array(nodes, pa.int64())})

    return classes.select("node", "sketch").mapInArrow(rows, "key long, node long")


def registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def least_estimate(percent: int) -> float:
    j = percent / 100
    return max(0.01, j - DEVIATIONS * np.sqrt(j * (1 - j) / REGISTERS))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Whole groups of rows sorted by keys, many at once: columns and sizes. Groups are of bounded size."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        key = [held.column(k).to_numpy() for k in keys]
        new = np.append(True, np.any([k[1:] != k[:-1] for k in key], axis=0)) if held.num_rows else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        if len(starts) > 1:
            yield columns(held.slice(0, starts[-1])), np.diff(starts)
            held = held.slice(starts[-1])
    if held is not None and held.num_rows:
        yield columns(held), np.array([held.num_rows])


def columns(t: pa.Table) -> dict[str, np.ndarray]:
    t = t.combine_chunks()
    return {n: registers(t.column(n)) if n == "sketch" else t.column(n).to_numpy() for n in t.column_names}


def pairs_within(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places in each group, at most about PAIRS_AT_ONCE at once and each group's pairs in one go with others or in parts."""
    start = np.cumsum(sizes) - sizes
    count = sizes * (sizes - 1) // 2
    lots = np.cumsum(count) // PAIRS_AT_ONCE
    for lot in np.unique(lots[count > 0]):
        which = np.flatnonzero((lots == lot) & (count > 0))
        n = sizes[which]
        left = spread(start[which], n)  # each place, then the places behind it in its group
        behind = np.repeat(start[which] + n, n) - left - 1
        yield np.repeat(left, behind), spread(left + 1, behind)


def estimates(c: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Estimated similarity of rows a and b; -1 where their sizes rule a link out."""
    n_a, n_b = c["n"][a], c["n"][b]
    out = np.full(len(a), -1.0)
    at = np.flatnonzero(100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
    for i in range(0, len(at), PAIRS_AT_ONCE):
        p = at[i : i + PAIRS_AT_ONCE]
        ra, rb = c["sketch"][a[p]], c["sketch"][b[p]]
        near = (ra == rb).mean(1) >= least_estimate(percent) - 0.1  # equal registers alone rule most pairs out
        p = p[near]
        out[p] = similarity(ra[near], rb[near], n_a[p], n_b[p])
    return out


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places, in a and b, of a spanning forest of largest weights (Kruskal)."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in np.argsort(-weight, kind="stable").tolist():
        x, y = top(int(a[i])), top(int(b[i]))
        if x != y:
            parent[x] = y
            out.append(i)
    return np.array(out, np.int64)


def hot_from(rows: DataFrame) -> int:
    """The size from which a group of rows may be hot: so large that there are few such groups, a small broadcast."""
    return max(HOT, rows.count() // MOST_HOT)


def joined(rows: DataFrame, groups: DataFrame, keys: list[str], hot: int) -> DataFrame:
    """rows joined by keys with groups (keys, size, ...), a written table. Rows of groups of more than hot rows stay where they are; the others are shuffled."""
    large, others = F.broadcast(groups.where(F.col("size") > hot)), groups.where(F.col("size") <= hot)
    return rows.join(large, keys, "left_anti").join(others, keys).unionByName(rows.join(large, keys))


def dealt_in_blocks(bands: DataFrame, hot: int, files: int) -> DataFrame:
    """key, size, node, block of the bands of buckets with several classes."""
    buckets = common.written(bands.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("least")).where("size > 1"), "sizes", files)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.when(F.col("node") == F.col("least"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), blocks).cast("int")))
    return joined(bands, buckets, ["key"], hot).select("key", "size", "node", F.explode(own).alias("block"))


def told(c: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    x, y = c["node"][a], c["node"][b]
    return pa.record_batch({"a": pa.array(np.minimum(x, y), pa.int64()), "b": pa.array(np.maximum(x, y), pa.int64())})


def candidates(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) to confirm, of members (key, block, size, node, n, sketch)."""
    least = least_estimate(percent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, sizes in groups(batches, ["key", "block"]):
            large = np.repeat(c["size"][np.cumsum(sizes) - sizes] > SMALL, sizes)
            for a, b in pairs_within(sizes):
                e = estimates(c, a, b, percent)
                on = e >= least
                a, b, e = a[on], b[on], e[on]
                keep = ~large[a]
                yield told(c, a[keep], b[keep])
                a, b, e = a[~keep], b[~keep], e[~keep]
                if len(a):
                    tree = forest(a, b, e)
                    yield told(c, a[tree], b[tree])

    dealt = members.repartition("key", "block").sortWithinPartitions("key", "block")
    return dealt.select("key", "block", "size", "node", "n", "sketch").mapInArrow(rows, "a long, b long").distinct()


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left set with each right one, by products of incidence matrices, a slice of columns at a time."""
    sizes = [len(x) for x in left + right]
    _, column, often = np.unique(np.concatenate(left + right), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    many = often[column] > 1
    row, column = row[many], np.unique(column[many], return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + COLUMNS + 1, COLUMNS))
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        m = np.zeros((len(sizes), COLUMNS), np.float32)
        m[row[lo:hi], column[lo:hi] - k * COLUMNS] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def member_sets(members: DataFrame, texts: DataFrame, words: int, files: int) -> DataFrame:
    """k, family, component, node, n, h (shingles) of members (family, node, component); texts: node, text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, n = shingle_sets(b.column("text").to_pylist(), words)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(h.view(np.int64)))
            yield pa.record_batch([*(b.column(c) for c in ("family", "component", "node")), pa.array(n, pa.int64()), lists], names=["family", "component", "node", "n", "h"])

    held = members.select("family", "component", "node").join(texts, "node").mapInArrow(rows, "family long, component long, node long, n long, h array<long>")
    return common.written(held.withColumn("k", F.monotonically_increasing_id()), "members", files)


def reachable(members: DataFrame, percent: int) -> DataFrame:
    """Where there are many: members whose shingles are shared with other components of the family often enough for a link with a set of any size there.

    Sets of n and m shingles that share s are linked where (100 + percent) * s >= percent * (n + m), and m is at least
    percent of n and no less than the family's least size.
    """
    before = None
    for _ in range(PEELS):
        total = members.agg(F.sum("n")).first()[0] or 0
        if total < PEEL_FROM or before is not None and total > 0.7 * before:  # few went: blocks are cheaper now
            break
        before = total
        each = members.select("family", "component", "k", F.explode("h").alias("s"))
        shared = each.groupBy("family", "s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("family", "s")
        own = each.join(shared, ["family", "s"], "left_anti").groupBy("k").agg(F.count("*").alias("own"))
        least = common.durable(members.groupBy("family").agg(F.min("n").alias("least"), F.count("*").alias("size")), "least")
        other, common_ = F.greatest("least", F.ceil(percent * F.col("n") / 100)), F.col("n") - F.coalesce("own", F.lit(0))
        told = joined(members.join(own, "k", "left"), least, ["family"], hot_from(members))
        left = told.where((100 + percent) * common_ >= percent * (F.col("n") + other)).select("k", "family", "component", "node", "n", "h")
        old, members = members, common.durable(left, "members")
        common.forget(old)
    return members


def blocks_of(members: DataFrame, percent: int) -> DataFrame:
    """Members dealt in pairs of blocks (family, x, i, y, j); right marks the second block's rows.

    A unit is a level of sizes, of which only it and the next one can be linked, and whether its rows are of the family's
    largest component, whose rows needn't meet each other. x and y are units, i and j blocks of them.
    """
    total = members.agg(F.sum("n")).first()[0] or 0
    block = min(SHINGLES, max(LEAST_SHINGLES, total // PARTS))
    level = (F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9) if percent < 100 else 2 * F.col("n")).cast("int")
    main = members.groupBy("family", "component").agg(F.count("*").alias("c")).groupBy("family").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("size"))
    hot = hot_from(members)
    m = joined(members, common.written(main, "main", 8), ["family"], hot).drop("size")
    m = m.withColumn("x", 2 * level + (F.col("component") == F.col("main")).cast("int"))
    sizes = m.groupBy("family", "x").agg(F.ceil(F.sum("n") / block).cast("int").alias("own"), F.count("*").alias("c"))
    sizes = sizes.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("x", "own"))).alias("own"), F.sum("c").alias("size"))  # a few dozen levels each
    m = joined(m, common.written(sizes, "units", 8), ["family"], hot)
    blocks = lambda x: F.coalesce(F.try_element_at("own", x), F.lit(0))
    i, rest = F.pmod(F.xxhash64("k"), blocks(F.col("x"))).cast("int"), F.col("x") % 2 == 0
    at = lambda x, i, y, j, right: F.struct(x.cast("int").alias("x"), i.cast("int").alias("i"), y.cast("int").alias("y"), j.cast("int").alias("j"), right.alias("right"))

    def with_unit(y: Column) -> Column:
        def one(j: Column) -> Column:
            first = (F.col("x") < y) | ((F.col("x") == y) & (i <= j))
            return F.when(first, at(F.col("x"), i, y, j, F.lit(False))).otherwise(at(y, j, F.col("x"), i, F.lit(True)))

        places = F.sequence(F.lit(0), F.greatest(blocks(y) - 1, F.lit(0)))
        return F.filter(F.transform(places, one), lambda _: blocks(y) > 0)

    even = F.col("x") - F.col("x") % 2
    units = F.flatten(F.transform(F.array(even, even + 2, even - 2), lambda u: F.when(rest, F.array(u, u + 1)).otherwise(F.array(u))))
    dealt = m.select("family", "component", "node", "h", F.explode(F.flatten(F.transform(units, with_unit))).alias("at"))
    return dealt.select("family", "at.*", "component", "node", "h")


def across(dealt: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between different components of one family, confirmed on full sets, of members in blocks.

    A task hands on the links that join components anew in a block, so fewer than it has rows.
    """
    keys = ["family", "x", "i", "y", "j"]

    def links(c: dict, one: np.ndarray, two: np.ndarray) -> pa.RecordBatch | None:
        sets = [c["h"][k] for k in (*one, *two)]
        count = np.array([len(x) for x in sets])
        both = intersections(sets[: len(one)], sets[len(one) :])
        union = count[: len(one), None] + count[None, len(one) :] - both
        x, y = np.nonzero((100 * both >= percent * union) & (c["component"][one][:, None] != c["component"][two][None, :]))
        if not len(x):
            return None
        tree = forest(c["component"][one[x]], c["component"][two[y]], both[x, y])
        return pa.record_batch({"u": pa.array(c["node"][one[x[tree]]], pa.int64()), "v": pa.array(c["node"][two[y[tree]]], pa.int64())})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, sizes in groups(batches, keys):
            for s, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
                at = np.arange(s, s + n)
                left, right = at[~c["right"][at]], at[c["right"][at]]
                within = c["x"][s] == c["y"][s] and c["i"][s] == c["j"][s]
                for k in range(0, len(left), EXACT_BLOCK):
                    for m in range(k if within else 0, len(left if within else right), EXACT_BLOCK):
                        told = links(c, left[k : k + EXACT_BLOCK], (left if within else right)[m : m + EXACT_BLOCK])
                        if told is not None:
                            yield told

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(rows, "u long, v long").distinct()


def open_families(dealt: DataFrame, found: DataFrame, hot: int, files: int) -> DataFrame | None:
    """(family, node, component): classes that meet in large buckets of several components; None where there are none."""
    large = dealt.where(F.col("size") > SMALL).select("key", "size", "node").distinct()
    large = large.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed_keys = large.groupBy("key", "size").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("node").alias("least")).where("lo <> hi")
    mixed_keys = common.written(mixed_keys.select("key", "size", "least"), "mixed", files)
    there = common.written(joined(large.select("key", "node", "component"), mixed_keys, ["key"], hot).select("node", "least", "component").distinct(), "open", files)
    if there.isEmpty():
        return None
    family = connected_components(there.select(F.col("node").alias("u"), F.col("least").alias("v")), files).withColumnRenamed("component", "family")
    nodes = common.written(there.select("node", "component").distinct().join(family, "node"), "families", files)
    return nodes.select("family", "node", "component")


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v): the pairs (a, b) whose full shingle sets reach percent. texts: node, text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            both = b.column("ta").to_pylist() + b.column("tb").to_pylist()
            unique = list(dict.fromkeys(both))
            number = {t: i for i, t in enumerate(unique)}
            h, n = shingle_sets(unique, words)
            sets = np.split(h, np.cumsum(n)[:-1])
            half = len(both) // 2
            keep = []
            for x, y in zip(both[:half], both[half:], strict=True):
                x, y = sets[number[x]], sets[number[y]]
                common_ = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * common_ >= percent * (len(x) + len(y) - common_) and common_ > 0)
            keep = pa.array(keep)
            yield pa.record_batch({"u": b.column("a").filter(keep), "v": b.column("b").filter(keep)})

    one, two = texts.selectExpr("node AS a", "text AS ta"), texts.selectExpr("node AS b", "text AS tb")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(rows, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row: components of texts whose sets' 100 * intersection >= percent * union."""
    sets = common.durable(describe(docs, words), "sets")
    # rows of one id are one document, and rows of one set are one class
    by_set = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2").agg(F.min("doc_id").alias("node"))
    files = common.files_for(sets.count())  # of the tables that follow, which have a few rows a text at most
    by_set = common.written(by_set, "classes", files)
    one = sets.where("n_shingles > 0").selectExpr("doc_id AS node", "f1", "f2", "n_shingles AS n", "sketch")
    classes = common.written(one.join(by_set.select("f1", "f2", "node"), ["f1", "f2", "node"]).dropDuplicates(["f1", "f2", "node"]).drop("f1", "f2"), "nodes", files)

    bands = common.durable(band_keys(classes), "bands")
    hot = hot_from(bands)
    dealt = common.written(dealt_in_blocks(bands, hot, files), "buckets", files)
    pairs = common.written(candidates(dealt.join(classes, "node"), percent), "pairs", files)

    links = common.written(confirm(pairs, texts_of(pairs, docs, files), words, percent), "links", files)
    if (shared := links_of_shared_ids(sets, files)) is not None:
        links = links.unionByName(shared)
    found = common.written(connected_components(links, files), "found", files)

    if (members := open_families(dealt, found, hot, files)) is not None:
        texts = texts_of(members.select(F.col("node").alias("a"), F.col("node").alias("b")), docs, files)
        left = reachable(member_sets(members, texts, words, files), percent)
        links = links.unionByName(common.written(across(blocks_of(left, percent), percent), "more", files))
        found = common.written(connected_components(links, files), "found", files)
    common.forget(classes, bands, dealt, pairs)

    node = by_set.join(found, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("component_id"))
    out = sets.drop("sketch").join(node, ["f1", "f2"], "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id")) | F.col("doc_id").isNull()).alias("kept"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of near-duplicates: the row of the least id, null ids last. Rows without words are in no group, and all stay.

    Where ids repeat or are null, rows are told apart by a number of their own, so that what stays is decided by text and not by id.
    """
    kind = docs.schema["doc_id"].dataType
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        gone = near_duplicates(docs, words, percent).where("NOT kept").select(F.col("doc_id").cast(kind).alias("doc_id"))
        gone = common.written(gone, "gone", common.files_for(docs.count()))
        return docs.join(common.small(gone), "doc_id", "left_anti").select(docs.columns)
    rows = common.durable(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), words, percent).select(F.col("doc_id").alias("__row"), "component_id")
    ids = rows.select("__row", F.col("doc_id").cast("bigint").alias("id")).join(found, "__row")
    least = ids.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "__row"))["__row"].alias("__row"))
    gone = ids.select("__row").join(least, "__row", "left_anti")
    gone = common.written(gone, "gone", common.files_for(rows.count()))
    return rows.join(common.small(gone), "__row", "left_anti").select(docs.columns)


def links_of_shared_ids(sets: DataFrame, files: int) -> DataFrame | None:
    """Links between the classes that rows of one repeated id belong to; None where ids are unique."""
    ids = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "f1", "f2")
    many = common.written(ids.groupBy("doc_id").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo <> hi").select("doc_id"), "ids", files)
    if many.isEmpty():
        return None
    mine = ids.join(many, "doc_id").distinct()
    least = ids.join(mine.select("f1", "f2").distinct(), ["f1", "f2"], "left_semi").groupBy("f1", "f2").agg(F.min("doc_id").alias("node"))
    return common.durable(mine.join(least, ["f1", "f2"]).select(F.col("doc_id").alias("u"), F.col("node").alias("v")), "shared")


def texts_of(pairs: DataFrame, docs: DataFrame, files: int) -> DataFrame:
    """node, text of the nodes of pairs (a, b): a row for each distinct text of an id, so one where ids are unique."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = docs.selectExpr("cast(doc_id as bigint) AS node", "text")
    return common.written(texts.join(common.small(common.written(nodes, "wanted", files)), "node", "left_semi").distinct(), "texts", files)
