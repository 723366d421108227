"""Clearance of underpasses from point clouds: height histograms, occupancy rasters, and the estimator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 0.5
BINS = 100
BAND = 0.5  # width of a peak's layer
SEPARATION = 10
SHOWN = 0.05
WALL_SHARE, WALL_GAP = 0.85, 1
AT_ONCE = 500_000  # points whose groups are worked on together
SIDE = 1 << 20  # cells of a raster are numbered row * SIDE + column


def histogram(points: DataFrame, key: str, value: str, bins: int = BINS) -> DataFrame:
    """key, bin, n: equal-width bins over each key's own range, the last one closed; bins without points are absent."""
    ends = points.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), F.lit(bins // 2)).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)))
    return points.join(ends, key).groupBy(key, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def raster(points: DataFrame, key: str, x0: Column, y0: Column, size: float = CELL) -> DataFrame:
    """key, row, col, n: counts of points by cell from a key's own corner."""
    row, col = F.floor((F.col("y") - y0) / size).cast("int"), F.floor((F.col("x") - x0) / size).cast("int")
    return points.groupBy(key, row.alias("row"), col.alias("col")).agg(F.count("*").alias("n"))


def occupied_area(cells: DataFrame, key: str, size: float = CELL) -> DataFrame:
    return cells.groupBy(key).agg((F.count_distinct("row", "col") * size * size).alias("area"))


def finite(*columns: str) -> Column:
    """Whether all values are numbers other than the infinities."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def band(value: Column, lo: Column, hi: Column, greatest: Column) -> Column:
    """[lo, hi), closed where hi is the greatest value of all."""
    near = F.abs(hi - greatest) <= 1e-8 + 1e-5 * F.abs(greatest)
    return (value >= lo) & ((value < hi) | (near & (value <= hi)))


def vertical_walls(points: DataFrame, key: str, low: Column, high: Column) -> DataFrame:
    """key, row, col of cells whose points occupy nearly every height bin from low to high. points: key, row, col, bin; low and high are of the key."""
    here = points.where((F.col("bin") >= low) & (F.col("bin") <= high)).withColumn("__w", high - low + 1).select(key, "row", "col", "bin", low.alias("__lo"), high.alias("__hi"), "__w").distinct()
    gap = F.col("bin") - F.lag("bin").over(Window.partitionBy(key, "row", "col").orderBy("bin")) - 1
    c = here.withColumn("gap", gap).groupBy(key, "row", "col").agg(
        F.min("bin").alias("a"), F.max("bin").alias("b"), F.count("*").alias("n"), F.max("gap").alias("gap"), F.first("__lo").alias("lo"), F.first("__hi").alias("hi"), F.first("__w").alias("w")
    )
    return c.where((F.col("hi") > F.col("lo")) & (F.col("a") == F.col("lo")) & (F.col("b") == F.col("hi")) & (F.col("n") / F.col("w") >= WALL_SHARE) & (F.coalesce("gap", F.lit(0)) <= WALL_GAP)).select(key, "row", "col")


def exclusive(cells: DataFrame, key: str, layer: str = "layer") -> DataFrame:
    """Cells of layers without those that a lower layer other than the floor (layer 1) has too."""
    w = Window.partitionBy(key, "row", "col")
    lower = F.min(F.when(F.col(layer) > 1, F.col(layer))).over(w)
    return cells.withColumn("__lower", lower).where((F.col(layer) == 1) | (F.col("__lower") == F.col(layer))).drop("__lower")


def component_sizes(group: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """The size of the component of each (group, cell), 8-connected. Sorted by group, then cell (row * SIDE + column, with a free column on either side); no dense mask is held."""
    n = len(cell)
    label = np.arange(n)
    if not n:
        return label
    _, number = np.unique(group, return_inverse=True)
    code = number * (np.int64(cell.max()) + 2 * SIDE + 2) + cell
    pairs = []
    for step in (1, SIDE - 1, SIDE, SIDE + 1):
        at = np.minimum(np.searchsorted(code, code + step), n - 1)
        hit = np.flatnonzero(code[at] == code + step)
        pairs.append(np.stack([hit, at[hit]], 1))
    pairs = np.concatenate(pairs)
    while len(pairs):  # labels go to the least around, then to their own label
        a, b = label[pairs[:, 0]], label[pairs[:, 1]]
        apart = a != b
        if not apart.any():
            break
        pairs, a, b = pairs[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return np.bincount(label, minlength=n)[label]


def largest_component(mask: np.ndarray) -> int:
    """Cells of the largest 8-connected component of a mask."""
    r, c = np.nonzero(mask)
    return int(component_sizes(np.zeros(len(r), int), r * SIDE + c + 1).max(initial=0))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, at_once: int = AT_ONCE) -> Iterator[pa.Table]:
    """Tables of whole groups from rows that are sorted by key: about at_once rows, or one larger group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size < at_once:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        _, first = np.unique(t.column(key).to_numpy(zero_copy_only=False), return_index=True)
        last = int(first.max(initial=0))
        if last:
            yield t.slice(0, last)
        held, size = t.slice(last).to_batches(), t.num_rows - last
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def component_areas(cells: DataFrame, keys: list[str], size: float = CELL) -> DataFrame:
    """keys, area of the largest 8-connected component of each key's cells (row, col).

    Many keys are worked on together. The memory of a task follows its cells, however far apart they lie.
    """
    numbered = cells.select(F.struct(*keys).alias("k"), F.xxhash64(*keys).alias("h"), "row", "col")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "h"):
            k = t.column("k").combine_chunks()
            _, group = np.unique(np.stack([pc.dictionary_encode(f).indices.to_numpy(zero_copy_only=False) for f in k.flatten()]), axis=1, return_inverse=True)
            row, col = (t.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
            code = (row - row.min()) * SIDE + col - col.min() + 1
            order = np.lexsort((code, group))
            group, code = group[order], code[order]
            new = np.append(True, (group[1:] != group[:-1]) | (code[1:] != code[:-1]))
            order, group, code = order[new], group[new], code[new]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            best = np.maximum.reduceat(component_sizes(group, code), first)
            one = k.take(pa.array(order[first]))
            yield pa.record_batch([*one.flatten(), pa.array(best * size * size)], names=[*keys, "area"])

    kinds = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)
    return numbered.repartition("h").sortWithinPartitions("h").mapInArrow(rows, f"{kinds}, area double")


def smoothed_counts(n: np.ndarray) -> np.ndarray:
    """Rows of counts, convolved with a Hann window of seven, zero beyond the ends."""
    k = np.hanning(7)
    wide = np.pad(n.astype(float), ((0, 0), (3, 3)))
    return sum(w * wide[:, i : i + n.shape[1]] for i, w in enumerate(k / k.sum()))


def separated_maxima(s: np.ndarray) -> np.ndarray:
    """Row by place: bins of local maxima, best first (equal ones by the higher bin) and SEPARATION apart; -1 where there are no more."""
    rise = np.concatenate([np.ones((len(s), 1), bool), s[:, 1:] > s[:, :-1]], 1)
    fall = np.concatenate([s[:, :-1] >= s[:, 1:], np.ones((len(s), 1), bool)], 1)
    fall[:, 0] = s[:, 0] > s[:, 1]
    left = np.where(rise & fall, s, -np.inf)
    every, bins, out = np.arange(len(s)), np.arange(s.shape[1]), []
    while np.isfinite(left).any():
        at = s.shape[1] - 1 - left[:, ::-1].argmax(1)
        found = np.isfinite(left[every, at])
        out.append(np.where(found, at, -1))
        left[(np.abs(bins - at[:, None]) < SEPARATION) & found[:, None]] = -np.inf
    return np.stack(out, 1) if out else np.full((len(s), 1), -1)


def refined_bins(n: np.ndarray, s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row, the fullest bin of the slope around bin at, nearest to it, the lower one of two. n, s, at: a row each."""
    bins = np.arange(n.shape[1])
    up = np.concatenate([np.ones((len(s), 1), bool), s[:, 1:] < s[:, :-1]], 1)  # a bin that the walk to the left can't pass
    stop = np.concatenate([s[:, 1:] > s[:, :-1], np.ones((len(s), 1), bool)], 1)
    low = np.where(up & (bins <= at[:, None]), bins, 0).max(1)
    high = np.where(stop & (bins >= at[:, None]), bins, n.shape[1] - 1).min(1)
    here = np.where((bins >= low[:, None]) & (bins <= high[:, None]), n, -1)
    best = here == here.max(1, keepdims=True)
    return np.where(best, np.abs(bins - at[:, None]) * 2 + (bins > at[:, None]), 10 * len(bins)).argmin(1)


NONE_FINITE = "No finite points available for height estimation"  # fixed values: the texts of errors
NO_PEAKS = "No Z histogram peaks found"
FEW_PEAKS = "Fewer than two usable Z peaks found"
FIELDS = {"peak_idx": "int", "display_order": "int", "selected": "boolean", "elevation": "double", "z_min": "double", "z_max": "double", "point_count": "int",
          "area_m2": "double", "largest_contiguous_area_m2": "double", "raw_count": "int", "smoothed_count": "double"}
PEAK = f"array<struct<{', '.join(f'{n}: {t}' for n, t in FIELDS.items())}>>"
PEAK_TYPE = pa.list_(pa.struct([(n, {"int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for n, t in FIELDS.items()]))


def estimate(group: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, bounds: np.ndarray) -> dict[str, list]:
    """For each group, a row of bounds: underpass_z, underpass_dh, top_area, bottom_area, peaks, error; all groups at once. group: numbers from 0, ascending."""
    m = len(bounds)
    ok = np.isfinite(x) & np.isfinite(y) & np.isfinite(z)
    group, x, y, z = group[ok], x[ok], y[ok], z[ok]
    there = np.bincount(group, minlength=m) > 0
    lo, hi = np.full(m, np.inf), np.full(m, -np.inf)
    np.minimum.at(lo, group, z)
    np.maximum.at(hi, group, z)
    lo, hi = np.where(there, lo, 0.0), np.where(there, hi, 1.0)
    flat = lo == hi
    edges = np.linspace(np.where(flat, lo - 0.5, lo), np.where(flat, hi + 0.5, hi), BINS + 1, axis=1)
    middle = (edges[:, 1:] + edges[:, :-1]) / 2
    bin_ = np.clip(((z - edges[group, 0]) / (edges[group, -1] - edges[group, 0]) * BINS).astype(np.int64), 0, BINS - 1)
    bin_ -= z < edges[group, bin_]  # rounding: bins are told by their edges
    bin_ += (z >= edges[group, bin_ + 1]) & (bin_ < BINS - 1)
    counts = np.bincount(group * BINS + bin_, minlength=m * BINS).reshape(m, BINS)
    smooth = smoothed_counts(counts)
    places = separated_maxima(smooth)
    # layers: one a peak, by group and height
    g, slot = np.nonzero((places >= 0) & there[:, None])
    peak = places[g, slot]
    best = refined_bins(counts[g], smooth[g], peak) if len(g) else peak
    order = np.lexsort((slot, best, g))
    g, peak, best = g[order], peak[order], best[order]
    height = middle[g, best]
    z_min, z_max = np.maximum(lo[g], height - BAND / 2), np.minimum(hi[g], height + BAND / 2)
    closed = np.isclose(z_max, hi[g])
    # rasters: cells of the points of each layer
    wide, high = (np.maximum(1, np.ceil((bounds[:, k + 2] - bounds[:, k]) / CELL - 1e-9)).astype(np.int64) for k in (0, 1))
    col, row = (np.floor((v - bounds[group, k]) / CELL).astype(np.int64) for k, v in ((0, x), (1, y)))
    strict = (col >= 0) & (col < wide[group]) & (row >= 0) & (row < high[group]) & (z < edges[group, -1])
    col -= x == bounds[group, 0] + wide[group] * CELL  # the far sides belong to the last cells
    row -= y == bounds[group, 1] + high[group] * CELL
    inside = (col >= 0) & (col < wide[group]) & (row >= 0) & (row < high[group])
    cell = row * SIDE + col + 1
    first, per = np.searchsorted(g, np.arange(m)), np.bincount(g, minlength=m)
    points, grid_l, grid_c = np.zeros(len(g), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(per.max(initial=0)):
        layer = np.where(per[group] > k, first[group] + k, -1)
        on = layer >= 0
        on[on] = (z[on] >= z_min[layer[on]]) & ((z[on] < z_max[layer[on]]) | (closed[layer[on]] & (z[on] <= z_max[layer[on]])))
        points += np.bincount(layer[on], minlength=len(g))
        on &= inside
        grid_l.append(layer[on])
        grid_c.append(cell[on])
    grid_l, grid_c = _distinct(np.concatenate(grid_l), np.concatenate(grid_c))
    area, contiguous = np.bincount(grid_l, minlength=len(g)) * CELL**2, _largest(grid_l, grid_c, len(g))
    raw = counts[g, best]
    # usable layers: their share of the second fullest
    second = np.array([0] * m)
    by_count = np.lexsort((-raw, g))
    second[per > 0] = raw[by_count][first[per > 0] + np.minimum(1, per[per > 0] - 1)]
    shown = raw >= SHOWN * second[g]
    none = np.bincount(g, shown, m) == 0
    shown[first[(per > 0) & none]] = True
    display = np.cumsum(shown) - (np.cumsum(shown) - shown)[first[g]] if len(g) else np.zeros(0, np.int64)  # from 1, by group
    usable = np.bincount(g, shown, m).astype(int) >= 2
    # own cells: the floor's all, and of each higher layer those that no layer between has
    on = shown[grid_l]
    own_l, own_c = grid_l[on], grid_c[on]
    rank = display[own_l]
    order = np.lexsort((rank, own_c, g[own_l]))
    own_l, own_c, rank = own_l[order], own_c[order], rank[order]
    upper = rank > 1
    u_l, u_c = own_l[upper], own_c[upper]
    lowest = np.append(True, (g[u_l][1:] != g[u_l][:-1]) | (u_c[1:] != u_c[:-1])) if len(u_l) else np.zeros(0, bool)
    rank_l, rank_c = np.concatenate([own_l[~upper], u_l[lowest]]), np.concatenate([own_c[~upper], u_c[lowest]])
    # walls between each shown layer and the next one, which count for both
    low_l = np.flatnonzero(shown)
    next_l = np.append(low_l[1:], -1)
    pair = np.flatnonzero((next_l >= 0) & (g[low_l] == g[next_l])) if len(low_l) else low_l
    low_l, next_l = low_l[pair], next_l[pair]
    pair_first, pair_n = np.searchsorted(g[low_l], np.arange(m)), np.bincount(g[low_l], minlength=m)
    for k in range(pair_n.max(initial=0)):
        p = np.where(strict & (pair_n[group] > k), pair_first[group] + k, -1)
        on = p >= 0
        on[on] = (bin_[on] >= best[low_l[p[on]]]) & (bin_[on] <= best[next_l[p[on]]])
        w_p, w_c = _walls(p[on], cell[on], bin_[on], best[low_l], best[next_l])
        for side in (low_l, next_l):
            rank_l, rank_c = np.append(rank_l, side[w_p]), np.append(rank_c, w_c)
    reach = _largest(*_distinct(rank_l, rank_c), len(g))
    # the two best shown layers, the lower one first
    key = np.lexsort((-np.arange(len(g)), area, reach, shown, g))[::-1] if len(g) else np.zeros(0, int)  # within a group the best first; of equals the lowest
    place = np.empty(len(g), int)
    place[key] = np.arange(len(g))
    start = len(g) - first - per
    chosen = shown & (place - start[g] < 2) & usable[g]
    two = np.flatnonzero(chosen).reshape(-1, 2)
    out: dict[str, list] = {n: [None] * m for n in ("underpass_z", "underpass_dh", "top_area", "bottom_area", "peaks", "error")}
    for a, b in two.tolist():
        i = g[a]
        out["underpass_z"][i], out["underpass_dh"][i] = float(height[b]), float(height[b] - height[a])
        out["top_area"][i], out["bottom_area"][i] = float(area[b]), float(area[a])
    told = {"peak_idx": peak, "display_order": display, "selected": chosen, "elevation": height, "z_min": z_min, "z_max": z_max, "point_count": points, "area_m2": area,
            "largest_contiguous_area_m2": contiguous, "raw_count": raw, "smoothed_count": smooth[g, peak]}
    lists = [v.tolist() for v in told.values()]
    visible = shown.tolist()
    for i in range(m):
        if not there[i]:
            out["error"][i] = NONE_FINITE
        elif not per[i]:
            out["error"][i] = NO_PEAKS
        elif not usable[i]:
            out["error"][i] = FEW_PEAKS
        else:
            at = range(first[i], first[i] + per[i])
            out["peaks"][i] = [dict(zip(told, (v[j] for v in lists), strict=True)) | ({} if visible[j] else {"display_order": None}) for j in at]
    return out


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    return a[new], b[new]


def _largest(layer: np.ndarray, cell: np.ndarray, n: int) -> np.ndarray:
    """Area of the largest component of each layer's cells."""
    out = np.zeros(n)
    np.maximum.at(out, layer, component_sizes(layer, cell) * CELL**2)
    return out


def _walls(pair: np.ndarray, cell: np.ndarray, bin_: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, cell) whose points fill nearly all bins from the pair's low to its high one, both of them included."""
    order = np.lexsort((bin_, cell, pair))
    pair, cell, bin_ = pair[order], cell[order], bin_[order]
    same = np.append(False, (pair[1:] == pair[:-1]) & (cell[1:] == cell[:-1]))[: len(pair)]
    new = ~np.append(False, same[1:] & (bin_[1:] == bin_[:-1]))[: len(pair)]
    pair, cell, bin_, same = pair[new], cell[new], bin_[new], same[new]
    if not len(pair):
        return pair, cell
    start = np.flatnonzero(~same)
    gap = np.where(same, bin_ - np.append(0, bin_[:-1]) - 1, 0)
    n, most = np.diff(np.append(start, len(pair))), np.maximum.reduceat(gap, start)
    lo, hi = low[pair[start]], high[pair[start]]
    full = (hi > lo) & (bin_[start] == lo) & (bin_[start + n - 1] == hi) & (n / (hi - lo + 1) >= WALL_SHARE) & (most <= WALL_GAP)
    return pair[start][full], cell[start][full]


def estimate_heights(points: DataFrame, polygons: DataFrame, key: str, least: int = 100, most: int = 5_000_000) -> DataFrame:
    """key, status, point_count, underpass_z, underpass_dh, top_area, bottom_area, peaks, error for each polygon (key, bounds).

    polygons may tell `tiles`, how many tiles their bounds meet, and `valid`; those without tiles, or that aren't valid,
    aren't worked on. Points are counted first, so that groups over the limit, whose size isn't bounded, and those under it never reach
    the estimator. It takes whole groups of a partition, many at once.
    """
    from .relational import status_ladder

    n = points.groupBy(key).agg(F.count("*").alias("n"))
    valid = F.coalesce("valid", F.lit(False)) if "valid" in polygons.columns else F.lit(True)
    tiles = F.coalesce("tiles", F.lit(0)) if "tiles" in polygons.columns else F.lit(1)
    tasks = n.where((F.col("n") >= least) & (F.col("n") <= most)).join(polygons.where(valid & (tiles > 0)).select(key, "bounds"), key)
    kind = points.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, key):
            k = t.column(key).to_numpy(zero_copy_only=False)
            keys, first, group = np.unique(k, return_index=True, return_inverse=True)
            box = np.array([t.column("bounds")[int(i)].as_py() for i in first], float)
            told = estimate(group, *(t.column(c).to_numpy().astype(float) for c in "xyz"), box)
            floats = [pa.array(told[c], pa.float64()) for c in ("underpass_z", "underpass_dh", "top_area", "bottom_area")]
            yield pa.record_batch([pa.array(keys, t.schema.field(key).type), *floats, pa.array(told["peaks"], PEAK_TYPE), pa.array(told["error"], pa.string())],
                                  names=[key, "underpass_z", "underpass_dh", "top_area", "bottom_area", "peaks", "error"])

    dealt = points.join(tasks.drop("n"), key).select(key, "x", "y", "z", "bounds").repartition(key).sortWithinPartitions(key)
    told = dealt.mapInArrow(rows, f"{key} {kind}, underpass_z double, underpass_dh double, top_area double, bottom_area double, peaks {PEAK}, error string")
    out = polygons.select(key, valid.alias("__valid"), tiles.alias("__tiles")).join(n, key, "left").withColumn("point_count", F.coalesce("n", F.lit(0))).drop("n").join(told, key, "left")
    ladder = F.when(~F.col("__valid"), "invalid_geometry").otherwise(status_ladder(F.col("point_count"), F.col("__tiles"), most, least))
    out = out.withColumn("__ladder", ladder).drop("__valid", "__tiles")
    ladder = F.col("__ladder")
    return out.withColumn("status", F.when(ladder != "task", ladder).when(F.col("error").isNotNull(), "failed").otherwise("success")).drop("__ladder")
