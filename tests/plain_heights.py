"""The height estimator for one group, peak by peak and cell by cell, to hold the vectorised one against."""

import numpy as np

CELL, BINS, BAND, SEPARATION, SHOWN, WALL_SHARE, WALL_GAP = 0.5, 100, 0.5, 10, 0.05, 0.85, 1


def flood(mask):
    """Cells of the largest 8-connected component, by flood fill."""
    left, best = {tuple(c) for c in np.argwhere(mask).tolist()}, 0
    while left:
        todo, n = [left.pop()], 0
        while todo:
            r, c = todo.pop()
            n += 1
            near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        best = max(best, n)
    return best


def peaks(n: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Smoothed counts, and separated local maxima, best first (equal ones by the higher bin)."""
    k = np.hanning(7)
    s = np.convolve(n, k / k.sum(), "same")
    rise, fall = np.append(True, s[1:] > s[:-1]), np.append(s[:-1] >= s[1:], True)
    fall[0] = len(s) == 1 or s[0] > s[1]
    found: list[int] = []
    for i in sorted(np.flatnonzero(rise & fall), key=lambda i: (-s[i], -i)):
        if all(abs(i - x) >= SEPARATION for x in found):
            found.append(int(i))
    return s, found


def refined(n: np.ndarray, s: np.ndarray, at: int) -> int:
    """The fullest bin of the slope around a peak, nearest to it, the lower one of two."""
    down = np.diff(s)
    lo, hi = at, at
    while lo and down[lo - 1] >= 0:
        lo -= 1
    while hi < len(s) - 1 and down[hi] <= 0:
        hi += 1
    best = lo + np.flatnonzero(n[lo : hi + 1] == n[lo : hi + 1].max())
    return int(best[np.argmin(np.abs(best - at))])


def estimate(x: np.ndarray, y: np.ndarray, z: np.ndarray, bounds: tuple[float, float, float, float]) -> dict:
    """underpass_z, dh, areas and candidate peaks, or error."""
    ok = np.isfinite(x) & np.isfinite(y) & np.isfinite(z)
    x, y, z = x[ok], y[ok], z[ok]
    if not len(z):
        return {"error": "No finite points available for height estimation"}
    n, edges = np.histogram(z, BINS)
    middle = (edges[1:] + edges[:-1]) / 2
    smooth, found = peaks(n)
    if not found:
        return {"error": "No Z histogram peaks found"}
    cols, rows = (max(1, int(np.ceil((hi - lo) / CELL - 1e-9))) for lo, hi in ((bounds[0], bounds[2]), (bounds[1], bounds[3])))
    col, row = np.floor((x - bounds[0]) / CELL).astype(int), np.floor((y - bounds[1]) / CELL).astype(int)
    bin_ = np.searchsorted(edges, z, "right") - 1
    wall_ok = (col >= 0) & (col < cols) & (row >= 0) & (row < rows) & (bin_ < BINS)
    g_col = np.where(x == bounds[0] + cols * CELL, cols - 1, col)
    g_row = np.where(y == bounds[1] + rows * CELL, rows - 1, row)
    grid_ok = (g_col >= 0) & (g_col < cols) & (g_row >= 0) & (g_row < rows)

    def grid(mask: np.ndarray) -> np.ndarray:
        out = np.zeros((rows, cols), bool)
        out[g_row[mask & grid_ok], g_col[mask & grid_ok]] = True
        return out

    layers = []
    for p in found:
        r = refined(n, smooth, p)
        lo, hi = max(z.min(), middle[r] - BAND / 2), min(z.max(), middle[r] + BAND / 2)
        mask = (z >= lo) & ((z <= hi) if np.isclose(hi, z.max()) else (z < hi))
        g = grid(mask)
        layers.append({"peak_idx": p, "refined": r, "elevation": middle[r], "z_min": lo, "z_max": hi, "point_count": int(mask.sum()), "grid": g,
                       "area_m2": g.sum() * CELL**2, "largest_contiguous_area_m2": flood(g) * CELL**2, "raw_count": int(n[r]), "smoothed_count": float(smooth[p])})
    layers.sort(key=lambda a: a["elevation"])
    counts = sorted((a["raw_count"] for a in layers), reverse=True)
    shown = [a for a in layers if a["raw_count"] >= SHOWN * counts[min(1, len(counts) - 1)]] or layers[:1]
    if len(shown) < 2:
        return {"error": "Fewer than two usable Z peaks found"}
    taken = np.zeros((rows, cols), bool)
    for k, a in enumerate(shown):
        a["own"] = a["grid"] & ~taken if k else a["grid"]
        taken |= a["grid"] if k else False
        a["wall"] = np.zeros((rows, cols), bool)
    for a, b in zip(shown, shown[1:], strict=False):
        lo, hi = a["refined"], b["refined"]
        if hi <= lo:
            continue
        hit = np.zeros((rows * cols, hi - lo + 1), bool)
        on = wall_ok & (bin_ >= lo) & (bin_ <= hi)
        hit[row[on] * cols + col[on], bin_[on] - lo] = True
        gap = run = np.zeros(len(hit), int)
        for column in hit.T:
            run = np.where(column, 0, run + 1)
            gap = np.maximum(gap, run)
        wall = (hit[:, 0] & hit[:, -1] & (hit.mean(1) >= WALL_SHARE) & (gap <= WALL_GAP)).reshape(rows, cols)
        a["wall"] |= wall
        b["wall"] |= wall
    for a in shown:
        a["rank"] = (flood(a["own"] | a["wall"]) * CELL**2, a["area_m2"])
    pair = sorted(sorted(shown, key=lambda a: a["rank"], reverse=True)[:2], key=lambda a: a["elevation"])
    names = ("peak_idx", "elevation", "z_min", "z_max", "point_count", "area_m2", "largest_contiguous_area_m2", "raw_count", "smoothed_count")
    order = {id(a): i for i, a in enumerate(shown, 1)}
    told = [{k: a[k] for k in names} | {"display_order": order.get(id(a)), "selected": any(a is b for b in pair)} for a in layers]
    return {"underpass_z": pair[1]["elevation"], "underpass_dh": pair[1]["elevation"] - pair[0]["elevation"], "top_area": pair[1]["area_m2"], "bottom_area": pair[0]["area_m2"], "peaks": told}
