"""Polygon overlap and one-to-one assignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def bounds(polygon: Column) -> dict[str, Column]:
    """x1, y1, x2, y2 of an array of points; null without points."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return {"x1": F.array_min(xs), "y1": F.array_min(ys), "x2": F.array_max(xs), "y2": F.array_max(ys)}


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes; boxes that only touch give 0."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    inter = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    area = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
    return inter / (area(a) + area(b) - inter)


def _area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def _crossings(p: np.ndarray, y: float) -> np.ndarray:
    """Where a horizontal line meets a polygon's edges, sorted: inside lies between odd and even ones."""
    a, b = p, np.roll(p, -1, axis=0)
    hit = (a[:, 1] <= y) != (b[:, 1] <= y)
    a, b = a[hit], b[hit]
    return np.sort(a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1]))


def _edge_heights(p: np.ndarray, q: np.ndarray) -> list[float]:
    """Heights at which edges of the two polygons cross."""
    out = []
    a, b = p, np.roll(p, -1, axis=0)
    for c, d in zip(q, np.roll(q, -1, axis=0), strict=True):
        r, s = b - a, d - c
        den = r[:, 0] * s[1] - r[:, 1] * s[0]
        ok = np.abs(den) > 1e-12
        t = ((c[0] - a[ok, 0]) * s[1] - (c[1] - a[ok, 1]) * s[0]) / den[ok]
        u = ((c[0] - a[ok, 0]) * r[ok, 1] - (c[1] - a[ok, 1]) * r[ok, 0]) / den[ok]
        inside = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        out.extend((a[ok][inside, 1] + t[inside] * r[ok][inside, 1]).tolist())
    return out


def polygon_iou(p, q) -> float:
    """Intersection over union of two simple polygons by horizontal slabs (even-odd inside); fewer than 3 points give 0."""
    if p is None or q is None or len(p) < 3 or len(q) < 3:
        return 0.0
    p, q = np.asarray([list(x)[:2] for x in p], float), np.asarray([list(x)[:2] for x in q], float)
    if (p.max(0) <= q.min(0)).any() or (q.max(0) <= p.min(0)).any():
        return 0.0
    ys = np.unique(np.concatenate([p[:, 1], q[:, 1], _edge_heights(p, q)]))
    both = pa = qa = 0.0
    for lo, hi in zip(ys, ys[1:]):
        if hi - lo < 1e-9:
            continue
        mid = (lo + hi) / 2
        # Within a slab no edges cross: widths are linear, so the middle gives the area.
        x, y = _crossings(p, mid), _crossings(q, mid)
        pa += (hi - lo) * float((x[1::2] - x[::2]).sum())
        qa += (hi - lo) * float((y[1::2] - y[::2]).sum())
        for a, b in zip(x[::2], x[1::2]):
            for c, d in zip(y[::2], y[1::2]):
                both += (hi - lo) * max(0.0, min(b, d) - max(a, c))
    union = pa + qa - both
    return both / union if union > 0 else 0.0


def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one assignment of rows to columns with the greatest total score (shortest augmenting paths)."""
    n, m = score.shape
    if not n or not m:
        return []
    if n > m:
        return sorted((i, j) for j, i in assign(score.T))
    cost = -score
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            cur = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (cur < least[1:])
            least[1:][better], back[1:][better] = cur[better], j0
            free = np.where(used[1:], np.inf, least[1:])
            j1 = int(free.argmin()) + 1
            delta = free[j1 - 1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][~used[1:]] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            j1 = back[j0]
            match[j0] = match[j1]
            j0 = j1
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j])


def _turn(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def convex_hull(points: list) -> list:
    """The hull's corners, without points on its edges."""
    pts = sorted({(float(x), float(y)) for x, y in points})
    if len(pts) < 3:
        return [list(p) for p in pts]
    halves = []
    for order in (pts, pts[::-1]):
        half: list = []
        for p in order:
            while len(half) > 1 and _turn(half[-2], half[-1], p) <= 0:
                half.pop()
            half.append(p)
        halves.append(half[:-1])
    return [list(p) for p in halves[0] + halves[1]]


def is_simple(points: list) -> bool:
    """Whether no two edges of the closed outline cross or touch but at the corner they share."""
    n = len(points)
    if n < 3:
        return False
    between = lambda a, b, p: min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])
    for i in range(n):
        a, b = points[i], points[(i + 1) % n]
        if tuple(a) == tuple(b):
            return False
        for j in range(i + 1, n):
            c, d = points[j], points[(j + 1) % n]
            if j == i + 1 or (i == 0 and j == n - 1):  # neighbours: they may not fold back on each other
                shared, p, q = (b, a, d) if j == i + 1 else (a, b, c)
                if _turn(shared, p, q) == 0 and (p[0] - shared[0]) * (q[0] - shared[0]) + (p[1] - shared[1]) * (q[1] - shared[1]) > 0:
                    return False
                continue
            t1, t2, t3, t4 = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
            if ((t1 > 0) != (t2 > 0) and (t3 > 0) != (t4 > 0) and 0 not in (t1, t2, t3, t4)) or (t1 == 0 and between(a, b, c)) or (t2 == 0 and between(a, b, d)) or (t3 == 0 and between(c, d, a)) or (t4 == 0 and between(c, d, b)):
                return False
    return True


def repaired_polygon(points: list | None) -> tuple[str, list]:
    """(what was done, points): kept if simple, without repeated points if that is enough, else the convex hull; nothing with an area gives no points."""
    pts = [list(map(float, p[:2])) for p in points or [] if p is not None and len(p) > 1 and p[0] is not None and p[1] is not None]
    if len(pts) > 2 and is_simple(pts):
        return "kept", pts
    once = [p for i, p in enumerate(pts) if p != pts[i - 1]] if len(pts) > 1 else pts
    if len(once) > 2 and is_simple(once):
        return "deduplicated", once
    hull = convex_hull(once)
    return ("hull", hull) if len(hull) > 2 else ("empty", [])
