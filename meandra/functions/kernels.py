"""Array kernels for what is not relational: distances, thinning, outlines, smoothing, alignment, clusters."""

from __future__ import annotations

import numpy as np


def along_rows(d2: np.ndarray) -> np.ndarray:
    """Least of d2 at another cell of the row and the squared way there. Shifts grow until none can give less."""
    out = d2.astype(float).copy()
    for k in range(1, d2.shape[1]):
        if not out.size or k * k >= out.max():
            break
        np.minimum(out[:, k:], d2[:, :-k] + k * k, out=out[:, k:])
        np.minimum(out[:, :-k], d2[:, k:] + k * k, out=out[:, :-k])
    return out


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of each true cell to the nearest false one; infinite without any.

    Columns are scanned once each way; rows are shifted as far as the greatest distance.
    """
    if not mask.size or mask.all():
        return np.full(mask.shape, np.inf)
    rows = np.arange(mask.shape[0], dtype=float)[:, None]
    above = np.maximum.accumulate(np.where(mask, -np.inf, rows), axis=0)
    below = np.minimum.accumulate(np.where(mask, np.inf, rows)[::-1], axis=0)[::-1]
    return np.sqrt(along_rows(np.minimum(rows - above, below - rows) ** 2))


def thin(mask: np.ndarray) -> np.ndarray:
    """One-pixel skeleton by two-phase parallel thinning (Zhang and Suen, 1984)."""
    m = np.pad(mask.astype(bool), 1)
    while True:
        gone = 0
        for phase in (0, 1):
            n, ne, e, se, s, sw, w, nw = (np.roll(m, shift, (0, 1)) for shift in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1)))
            ring = [n, ne, e, se, s, sw, w, nw]
            near = sum(r.astype(int) for r in ring)
            turns = sum((~a & b).astype(int) for a, b in zip(ring, [*ring[1:], ring[0]]))
            first, second = ((n & e & s), (e & s & w)) if phase == 0 else ((n & e & w), (n & s & w))
            drop = m & (near >= 2) & (near <= 6) & (turns == 1) & ~first & ~second
            m &= ~drop
            gone += int(drop.sum())
        if not gone:
            return m[1:-1, 1:-1]


def outline_segments(mask: np.ndarray) -> np.ndarray:
    """Unit cell edges (x0, y0, x1, y1) between true and false cells, the border counting as false."""
    m = np.pad(mask.astype(np.int8), 1)
    ys, xs = np.nonzero(np.diff(m, axis=0))
    yv, xv = np.nonzero(np.diff(m, axis=1))
    across = np.stack([xs - 1, ys, xs, ys], axis=1)
    upright = np.stack([xv, yv - 1, xv, yv], axis=1)
    return np.concatenate([across, upright])


def savgol(y: np.ndarray, width: int, degree: int = 3) -> np.ndarray:
    """Least-squares polynomial smoothing; each end follows the polynomial of its last full window."""
    n = len(y)
    if n < width:
        return y.astype(float).copy()
    half = width // 2
    t = np.arange(-half, half + 1, dtype=float)
    design = np.vander(t, degree + 1, increasing=True)
    fit = np.linalg.pinv(design)
    out = np.empty(n)
    out[half : n - half] = np.convolve(y, fit[0][::-1], "valid")
    ends = np.vander(np.arange(half, dtype=float) - half, degree + 1, increasing=True)
    out[:half] = ends @ (fit @ y[:width])
    ends = np.vander(np.arange(1, half + 1, dtype=float), degree + 1, increasing=True)
    out[n - half :] = ends @ (fit @ y[n - width :])
    return out


def _penalised(pts: np.ndarray, lam: float) -> np.ndarray:
    """Solution z of (I + lam D'D) z = pts, D the second differences: a factorisation of five bands, linear in time and memory."""
    n = len(pts)
    main = np.full(n, 1 + 6 * lam)
    main[[0, -1]], main[[1, -2]] = 1 + lam, 1 + 5 * lam
    if n == 4:
        main[1:3] = 1 + 5 * lam
    near = np.full(n - 1, -4 * lam)
    near[[0, -1]] = -2 * lam
    d, e, f = [0.0] * n, [0.0] * n, [0.0] * n
    z = pts.tolist()
    m, k, far = main.tolist(), near.tolist(), lam
    for i in range(n):  # L D L' with unit L: e and f hold its two lower bands
        d[i] = m[i] - (d[i - 1] * e[i - 1] ** 2 if i else 0.0) - (d[i - 2] * f[i - 2] ** 2 if i > 1 else 0.0)
        if i < n - 1:
            e[i] = (k[i] - (d[i - 1] * e[i - 1] * f[i - 1] if i else 0.0)) / d[i]
        if i < n - 2:
            f[i] = far / d[i]
        for c in (0, 1):
            z[i][c] -= (e[i - 1] * z[i - 1][c] if i else 0.0) + (f[i - 2] * z[i - 2][c] if i > 1 else 0.0)
    for i in range(n - 1, -1, -1):
        for c in (0, 1):
            z[i][c] = z[i][c] / d[i] - (e[i] * z[i + 1][c] if i < n - 1 else 0.0) - (f[i] * z[i + 2][c] if i < n - 2 else 0.0)
    return np.array(z)


def nearest(points: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Index of the point nearest to each place, the first on ties; in blocks of places."""
    return np.concatenate([((points[None] - places[i : i + 512, None]) ** 2).sum(axis=2).argmin(axis=1) for i in range(0, len(places), 512)])


def carried(places: np.ndarray, samples: np.ndarray, width: np.ndarray, method: str, most: float | None = None) -> np.ndarray:
    """Widths of samples along a line carried over to places; see paths.channel_width()."""
    if method == "inverse_distance":
        out = np.empty(len(places))
        for lo in range(0, len(places), 512):
            d2 = ((places[lo : lo + 512, None] - samples[None]) ** 2).sum(axis=2)
            k = 1 / np.maximum(d2, 1e-10)
            if most is not None:
                k = np.where(d2 <= most * most, k, 0.0)
            total = k.sum(axis=1)
            out[lo : lo + 512] = np.where(total > 0, (k * width).sum(axis=1) / np.where(total > 0, total, 1), np.nan)
        return out
    at = nearest(samples, places)
    if method == "nearest_neighbor":
        gaps = np.hypot(*np.diff(samples, axis=0).T)
        far = (3 * gaps.mean() if len(gaps) else np.inf) if most is None else most
        return np.where(np.hypot(*(places - samples[at]).T) <= far, width[at], np.nan)
    low, high = np.maximum(at - 1, 0), np.minimum(at + 1, len(samples) - 1)
    d = samples[high] - samples[low]
    size = (d * d).sum(axis=1)
    s = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(samples, axis=0).T))]) if len(samples) > 1 else np.zeros(1)
    t = np.clip(((places - samples[low]) * d).sum(axis=1) / np.where(size > 0, size, 1), 0, 1)
    along = s[low] + t * (s[high] - s[low])
    return np.where(size > 0, np.interp(along, s, width), width[at])


def median5(v: np.ndarray) -> np.ndarray:
    """Middle of five values, zeros beyond the ends."""
    return np.median(np.stack([np.pad(v, 2)[k : k + len(v)] for k in range(5)]), axis=0) if len(v) else v


def longer_arc(ring: np.ndarray, i: int, j: int, tolerance: float, towards: np.ndarray) -> np.ndarray:
    """Of the two ways round a ring between vertices i and j the one with more vertices after simplification, the first on ties.

    It begins at the end that is nearer to `towards`.
    """
    i, j = sorted((i, j))
    arcs = ring[i : j + 1], np.concatenate([ring[j:], ring[: i + 1]])
    arc = max(arcs, key=lambda a: len(simplify(a, tolerance)))
    near = [float(((arc[k] - towards) ** 2).sum()) for k in (0, -1)]
    return arc if near[0] <= near[1] else arc[::-1]


def spliced(one: list, two: list, width: dict, once: bool = False) -> list:
    """Path one with spans of path two put in where these are wider on the mean; ties keep path one.

    Spans are what the edges of only one path make, from source to sink, where both paths have a span of the same
    ends; or, `once`, all from the first node at which they part to the last at which they meet again.
    """

    def spans(a: list, b: list) -> dict[tuple, list]:
        other, out, now = set(zip(b, b[1:])), {}, []
        for step in zip(a, a[1:]):
            if step in other:
                if now:
                    out[now[0], now[-1]] = now
                now = []
            else:
                now = now + [step[1]] if now else list(step)
        if now:
            out[now[0], now[-1]] = now
        return out

    mean = lambda path: float(np.mean([width.get(s, 0.0) for s in zip(path, path[1:])]))
    first, second = spans(one, two), spans(two, one)
    if once:
        if not first or not second:
            return one
        shared = [n for n in one if n in set(two)]
        starts, ends = [a for a, _ in first if a in two], [b for _, b in first if b in two]
        if not starts or not ends or not shared:
            return one
        a, b = starts[0], ends[-1]
        if two.index(a) >= two.index(b):
            return one
        first = {(a, b): one[one.index(a) : one.index(b) + 1]}
        second = {(a, b): two[two.index(a) : two.index(b) + 1]}
    out = list(one)
    for ends, span in first.items():
        if ends in second and mean(second[ends]) > mean(span):
            a, b = out.index(ends[0]), out.index(ends[1])
            out[a : b + 1] = second[ends]
    return out


def smoothing_curve(x: np.ndarray, y: np.ndarray, step: float, residual: float) -> tuple[np.ndarray, np.ndarray]:
    """Penalised curve through points with squared residual at most `residual`, resampled about every `step`."""
    n = len(x)
    if n < 4:
        return x, y
    low, high = 0.0, 1e8
    pts = np.stack([x, y], axis=1).astype(float)
    best = pts
    for _ in range(50):
        lam = np.sqrt(max(low, 1e-8) * high)
        now = _penalised(pts, lam)
        if ((now - pts) ** 2).sum() <= residual:
            best, low = now, lam
        else:
            high = lam
    s = np.concatenate(([0], np.cumsum(np.hypot(*np.diff(best, axis=0).T))))
    u = np.linspace(0, s[-1], 1 + int(s[-1] / step)) if s[-1] > 0 else np.zeros(1)
    return np.interp(u, s, best[:, 0]), np.interp(u, s, best[:, 1])


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Kept vertices of a polyline (Douglas and Peucker, 1973)."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q = points[a], points[b]
        seg, mid = q - p, points[a + 1 : b]
        size = float(seg @ seg)
        t = np.clip((mid - p) @ seg / size, 0, 1) if size else np.zeros(len(mid))
        off = np.hypot(*(mid - (p + t[:, None] * seg)).T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counterclockwise, by a monotone chain."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def chain(seq: np.ndarray) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def align(a: np.ndarray, b: np.ndarray, power: float = 1.0) -> tuple[float, np.ndarray]:
    """Dynamic time warping: total cost of |a - b|^power and the path of index pairs from start to end."""
    return warp(np.abs(a[:, None] - b[None, :]) ** power)


def warp(cost: np.ndarray) -> tuple[float, np.ndarray]:
    """Dynamic time warping over a matrix of costs."""
    return warps([cost])[0]


def warps(costs: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """warp() of each matrix, all together; they are padded to one shape, which nothing before a matrix's end depends on."""
    if not costs:
        return []
    rows, cols = (np.array([c.shape[k] for c in costs]) for k in (0, 1))
    n, m = int(rows.max()), int(cols.max())
    cost = np.zeros((n, m, len(costs)))
    for b, c in enumerate(costs):
        cost[: c.shape[0], : c.shape[1], b] = c
    total = np.full((n + 1, m + 1, len(costs)), np.inf)
    total[0, 0] = 0
    for k in range(n + m - 1):  # antidiagonals: their cells do not depend on each other
        i = np.arange(max(0, k - m + 1), min(n, k + 1))
        j = k - i
        total[i + 1, j + 1] = cost[i, j] + np.minimum(np.minimum(total[i, j], total[i, j + 1]), total[i + 1, j])
    every = np.arange(len(costs))
    i, j, steps = rows - 1, cols - 1, np.empty((n + m - 1, 2, len(costs)), np.int64)
    length = np.zeros(len(costs), np.int64)
    b = every
    while len(b):
        steps[length[b], 0, b], steps[length[b], 1, b] = i[b], j[b]
        length[b] += 1
        b = b[(i[b] > 0) | (j[b] > 0)]
        p, q = i[b], j[b]
        step = np.argmin([total[p, q, b], total[p, q + 1, b], total[p + 1, q, b]], axis=0)
        i[b] -= step < 2
        j[b] -= step != 1
    ends = total[rows, cols, every].tolist()
    return [(ends[k], steps[: length[k], :, k][::-1].copy()) for k in range(len(costs))]


def average_linkage(points: np.ndarray, limit: float) -> np.ndarray:
    """Cluster numbers of points: pairs of clusters with the least mean distance join while it is at most `limit`."""
    n = len(points)
    members = [[i] for i in range(n)]
    dist = np.hypot(points[:, None, 0] - points[None, :, 0], points[:, None, 1] - points[None, :, 1])
    np.fill_diagonal(dist, np.inf)
    size = np.ones(n)
    for _ in range(n - 1):
        a, b = sorted(map(int, np.unravel_index(int(dist.argmin()), dist.shape)))
        if not dist[a, b] <= limit:
            break
        # the mean distance to a merged cluster is the mean of both, weighted by their sizes
        dist[a] = dist[:, a] = (size[a] * dist[a] + size[b] * dist[b]) / (size[a] + size[b])
        dist[a, a] = np.inf
        dist[b] = dist[:, b] = np.inf
        size[a] += size[b]
        members[a] += members[b]
        members[b] = []
    out = np.empty(n, int)
    for k, rows in enumerate(sorted((m for m in members if m), key=min)):
        out[rows] = k
    return out


def lowest_negative_minimum(data: np.ndarray, bins: int = 256, sigma: float = 5.0) -> float | None:
    """Largest negative local minimum of the smoothed histogram of the non-zero values; None without one."""
    v = data[(data != 0) & np.isfinite(data)]
    if not len(v):
        return None
    density, at = np.histogram(v, bins=bins, density=True)
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    smooth = np.convolve(np.pad(density, r, mode="symmetric"), w / w.sum(), "valid")
    mid = (at[:-1] + at[1:]) / 2
    low = np.flatnonzero((smooth[1:-1] < smooth[:-2]) & (smooth[1:-1] < smooth[2:])) + 1
    low = low[mid[low] < 0]
    return float(mid[low].max()) if len(low) else None


def gaussian(y: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing, mirrored at the ends, cut at four deviations."""
    r = int(4 * sigma + 0.5)
    if r == 0 or not len(y):
        return y.astype(float)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(y.astype(float), r, mode="symmetric"), w / w.sum(), "valid")


def curvature(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Curvature from central differences taken twice; NaN where a vertex repeats."""
    if len(x) < 2:
        return np.full(len(x), np.nan)
    dx, dy = np.gradient(x), np.gradient(y)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (dx * np.gradient(dy) - dy * np.gradient(dx)) / (dx * dx + dy * dy) ** 1.5


def offsets(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Signed offset of the matches of each vertex of curve 1 along its left normal, as a mean; NaN without one."""
    tx, ty = np.gradient(x1), np.gradient(y1)
    size = np.hypot(tx, ty)
    tx, ty = np.where(size > 0, tx / np.where(size > 0, size, 1), 1.0), np.where(size > 0, ty / np.where(size > 0, size, 1), 0.0)
    p, q = path[:, 0], path[:, 1]
    off = -ty[p] * (x2[q] - x1[p]) + tx[p] * (y2[q] - y1[p])
    n = np.bincount(p, minlength=len(x1))
    with np.errstate(invalid="ignore"):
        return np.bincount(p, weights=off, minlength=len(x1)) / np.where(n > 0, n, np.nan)


def clahe(image: np.ndarray, tiles: int = 8, clip: float = 0.01, bins: int = 256) -> np.ndarray:
    """Contrast-limited equalisation of an image of 0..1: each tile's clipped histogram, blended between tile centres."""
    rows, cols = image.shape
    level = np.clip((image * bins).astype(int), 0, bins - 1)
    edges = [np.linspace(0, n, min(tiles, n) + 1).astype(int) for n in (rows, cols)]
    maps = np.empty((len(edges[0]) - 1, len(edges[1]) - 1, bins))
    for i, (r0, r1) in enumerate(zip(edges[0][:-1], edges[0][1:])):
        for j, (c0, c1) in enumerate(zip(edges[1][:-1], edges[1][1:])):
            h = np.bincount(level[r0:r1, c0:c1].ravel(), minlength=bins) / ((r1 - r0) * (c1 - c0))
            most = max(clip, 1 / bins)
            h = np.minimum(h, most) + np.maximum(h - most, 0).sum() / bins
            maps[i, j] = np.cumsum(h) / h.sum()
    spots = []
    for n, e in zip((rows, cols), edges):
        centre = (e[:-1] + e[1:] - 1) / 2
        at = np.clip(np.interp(np.arange(n), centre, np.arange(len(centre))), 0, len(centre) - 1)
        low = np.minimum(at.astype(int), max(len(centre) - 2, 0))
        spots.append((low, np.minimum(low + 1, len(centre) - 1), at - low))
    (r0, r1, a), (c0, c1, b) = spots
    a, b = a[:, None], b[None, :]
    pick = lambda r, c: maps[r[:, None], c[None, :], level]
    return (1 - a) * ((1 - b) * pick(r0, c0) + b * pick(r0, c1)) + a * ((1 - b) * pick(r1, c0) + b * pick(r1, c1))


def smooth_ring(ring: np.ndarray, width: int = 21, tolerance: float | None = None) -> np.ndarray:
    """A closed ring after polynomial smoothing across its seam; with over 100 vertices simplified by 1.5 of their mean distance, or `tolerance`."""
    n = len(ring)
    if n < width:
        return ring.astype(float)
    half = width // 2
    wrapped = np.concatenate([ring[-half:], ring, ring[:half]]).astype(float)
    out = np.stack([savgol(wrapped[:, k], width)[half : half + n] for k in (0, 1)], axis=1)
    if n > 100:
        closed = np.concatenate([out, out[:1]])
        limit = 1.5 * float(np.hypot(*np.diff(closed, axis=0).T).mean()) if tolerance is None else tolerance
        out = simplify(closed, limit)[:-1]
    return out


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of true values."""
    turn = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(int), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(turn[::2], turn[1::2])]


def unstable(d: np.ndarray, window: int = 50, factor: float = 100.0) -> np.ndarray:
    """True where the smoothed sliding variance exceeds its median times a factor."""
    half, n = window // 2, len(d)
    sums, squares = np.concatenate([[0.0], np.cumsum(d)]), np.concatenate([[0.0], np.cumsum(d * d)])
    lo, hi = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half, n)
    k = hi - lo
    var = np.maximum((squares[hi] - squares[lo]) / k - ((sums[hi] - sums[lo]) / k) ** 2, 0)
    var = gaussian(var, window // 10)
    return var > np.median(var) * factor


def to_unit_range(v: np.ndarray) -> np.ndarray:
    """Scaled so that the 5th percentile is -1 and the 95th is 1; zeros where they are equal."""
    low, high = np.percentile(v, [5, 95])
    return 2 * (v - low) / (high - low) - 1 if high > low else np.zeros(len(v))


def solidity(row: np.ndarray, col: np.ndarray, cells: int | None = None) -> float:
    """Cells of a region (so many, if not those given) over the area of the convex hull of their corners."""
    corners = np.concatenate([np.stack([col + dx, row + dy], axis=1) for dx in (0, 1) for dy in (0, 1)]).astype(float)
    h = hull(corners)
    area = abs(np.dot(h[:, 0], np.roll(h[:, 1], -1)) - np.dot(h[:, 1], np.roll(h[:, 0], -1))) / 2
    return (len(row) if cells is None else cells) / float(area)


_AROUND = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def skeleton_graph(skeleton: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """(nodes, edges) of one-pixel lines: nodes as (row, col) centres, edges as (a, b, pixels from a to b).

    Pixels without exactly two neighbours make the nodes, those that touch one node together. A ring
    without such a pixel gets its first pixel as a node. Edges that leave and meet the same pair stay apart.
    """
    pixels = {(int(r), int(c)) for r, c in zip(*np.nonzero(skeleton))}
    near = {p: [q for dr, dc in _AROUND if (q := (p[0] + dr, p[1] + dc)) in pixels] for p in pixels}
    owner: dict[tuple[int, int], int] = {}
    groups: list[list[tuple[int, int]]] = []

    def claim(first: tuple[int, int], apart: bool) -> None:
        group, todo = [], [first]
        owner[first] = len(groups)
        while todo:
            p = todo.pop()
            group.append(p)
            for q in near[p] if apart else ():
                if q not in owner and len(near[q]) != 2:
                    owner[q] = len(groups)
                    todo.append(q)
        groups.append(sorted(group))

    for p in sorted(pixels):
        if p not in owner and len(near[p]) != 2:
            claim(p, True)
    edges: list[tuple[int, int, np.ndarray]] = []
    used: set[tuple[int, int]] = set()

    def follow(start: tuple[int, int], step: tuple[int, int]) -> None:
        line, before, now = [start], start, step
        while now not in owner:
            line.append(now)
            used.add(now)
            # a side step next to the node just left must not lead back to it
            onward = [q for q in near[now] if q != before and q not in used and not (q in owner and owner[q] == owner[start] and len(line) == 2)]
            if not onward:
                back = [q for q in near[now] if q in owner and q != before]
                if not back:
                    return
                now = back[0]
                break
            before, now = now, min(onward, key=lambda q: (q not in owner, abs(q[0] - line[-1][0]) + abs(q[1] - line[-1][1]), q))
        edges.append((owner[start], owner[now], np.array([*line, now], float)))

    def walk(k: int) -> None:
        for p in groups[k]:
            for q in near[p]:
                if q not in owner and q not in used:
                    follow(p, q)

    for k in range(len(groups)):
        walk(k)
    for p in sorted(pixels):  # rings
        if p not in owner and p not in used:
            claim(p, False)
            walk(len(groups) - 1)
    return np.array([np.mean(g, axis=0) for g in groups]).reshape(-1, 2), edges


def route(n: int, edges: list[tuple[int, int, float]], start: int, end: int) -> list[tuple[int, bool]] | None:
    """Edges (index, taken forwards) of the cheapest route between two nodes; None without one."""
    import heapq

    out: list[list[tuple[int, float, int, bool]]] = [[] for _ in range(n)]
    for k, (a, b, cost) in enumerate(edges):
        out[a].append((b, cost, k, True))
        out[b].append((a, cost, k, False))
    best, came, heap = {start: 0.0}, {}, [(0.0, start)]
    while heap:
        cost, at = heapq.heappop(heap)
        if at == end:
            break
        if cost > best[at]:
            continue
        for to, more, k, forwards in out[at]:
            if cost + more < best.get(to, np.inf):
                best[to], came[to] = cost + more, (at, k, forwards)
                heapq.heappush(heap, (cost + more, to))
    if end not in best:
        return None
    path, at = [], end
    while at != start:
        at, k, forwards = came[at]
        path.append((k, forwards))
    return path[::-1]


def graph_parts(n: int, edges: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """For each node the least node that edges lead to."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for u, v, _ in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return np.array([find(i) for i in range(n)], int)


def bridged(mask: np.ndarray, nodes: np.ndarray, edges: list, a: int, b: int, most: float) -> np.ndarray | None:
    """The mask with a line three cells wide over the shortest gap between the parts of nodes a and b; None over `most` cells."""
    part = graph_parts(len(nodes), edges)
    pixels = [np.concatenate([nodes[part == part[k]], *(pts for u, _, pts in edges if part[u] == part[k])]) for k in (a, b)]
    near = nearest(pixels[1], pixels[0])
    gap = np.hypot(*(pixels[0] - pixels[1][near]).T)
    k = int(gap.argmin())
    if gap[k] > most:
        return None
    p, q = pixels[0][k], pixels[1][near[k]]
    out, n = mask.copy(), int(np.ceil(gap[k])) * 2 + 1
    for r, c in np.rint(p + np.linspace(0, 1, n)[:, None] * (q - p)).astype(int):
        out[max(r - 1, 0) : r + 2, max(c - 1, 0) : c + 2] = True
    return out


def _longest_part(nodes: np.ndarray, edges: list, size: list[float], start: np.ndarray, end: np.ndarray) -> tuple[int, int] | None:
    """Of the five longest parts of a network the ends of the one whose route between the nodes nearest to two places is longest."""
    part = graph_parts(len(nodes), edges)
    length: dict[int, float] = {}
    for (u, _, _), s in zip(edges, size):
        length[part[u]] = length.get(part[u], 0.0) + s
    costs, best = [(u, v, s) for (u, v, _), s in zip(edges, size)], (0.0, None)
    for p in sorted(length, key=lambda p: (-length[p], p))[:5]:
        own = np.flatnonzero(part == p)
        u, v = (int(own[np.hypot(*(nodes[own] - x).T).argmin()]) for x in (start, end))
        if u == v:
            v = int(own[np.hypot(*(nodes[own] - nodes[u]).T).argmax()])
        way = route(len(nodes), costs, u, v)
        total = sum(size[k] for k, _ in way) if way else 0.0
        if total > best[0]:
            best = (total, (u, v))
    return best[1]


def main_line(mask: np.ndarray, start: tuple[float, float], end: tuple[float, float], gap: float = 200.0) -> tuple[np.ndarray, np.ndarray]:
    """(pixels, half widths) along the skeleton between the nodes nearest to two places; empty without any line.

    Parts of the skeleton that do not meet are bridged over the shortest gap, if that is at most `gap` cells. If no
    route comes of it, the longest part gives the line.
    """
    nothing = np.empty((0, 2)), np.empty(0)
    nodes, edges = skeleton_graph(thin(mask)) if mask.any() else nothing
    if not len(nodes):
        return nothing
    places = np.array(start, float), np.array(end, float)
    way = None
    for attempt in range(2):
        a, b = (int(np.hypot(*(nodes - p).T).argmin()) for p in places)
        size = [float(np.hypot(*np.diff(pts, axis=0).T).sum()) for _, _, pts in edges]
        way = route(len(nodes), [(u, v, s) for (u, v, _), s in zip(edges, size)], a, b)
        if way is not None or attempt:
            break
        wider = bridged(mask, nodes, edges, a, b, gap)
        if wider is None:
            break
        mask = wider
        nodes, edges = skeleton_graph(thin(mask))
    if way is None:
        longest = _longest_part(nodes, edges, size, *places)
        way = route(len(nodes), [(u, v, s) for (u, v, _), s in zip(edges, size)], *longest) if longest else None
    if not way:
        return nothing
    line = np.concatenate([edges[k][2] if forwards else edges[k][2][::-1] for k, forwards in way])
    line = line[np.concatenate([[True], (np.diff(line, axis=0) != 0).any(axis=1)])]
    deep = distance_transform(np.pad(mask, 1))[1:-1, 1:-1]
    return line, deep[line[:, 0].astype(int), line[:, 1].astype(int)]


def sides(line: np.ndarray, places: np.ndarray) -> np.ndarray:
    """1 for places on the left of a line of (row, col) vertices, seen downstream with rows downwards; -1 on the right; 0 on it."""
    tangent = np.gradient(line, axis=0) if len(line) > 1 else np.zeros_like(line)
    out = np.empty(len(places), int)
    for lo in range(0, len(places), 1024):
        p = places[lo : lo + 1024]
        k = ((p[:, None, :] - line[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        off = p - line[k]
        out[lo : lo + 1024] = np.sign(tangent[k, 1] * -off[:, 0] + tangent[k, 0] * off[:, 1]).astype(int)
    return out
