"""Lines and rings: Column expressions over arrays of struct<lat, lon>, and pandas UDFs for what needs a stack or a queue."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import spherical_distance

INFINITE = float("inf")


def segments(points: Column, closed: bool = False) -> Column:
    """Array of struct<a, b>: each point with the next one; a closed line also joins the last to the first."""
    n = F.size(points)
    following = F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, F.least(n, F.lit(1)))) if closed else F.slice(points, 2, F.greatest(n - 1, F.lit(0)))
    first = points if closed else F.slice(points, 1, F.greatest(n - 1, F.lit(0)))
    return F.zip_with(first, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def line_length(points: Column, closed: bool = False) -> Column:
    """Metres along the line on the sphere; 0 for fewer than two points."""
    return _total(F.transform(segments(points, closed), lambda s: spherical_distance(s["a"]["lat"], s["a"]["lon"], s["b"]["lat"], s["b"]["lon"])))


def signed_area(ring: Column) -> Column:
    """Square degrees, positive if the ring runs counter-clockwise (longitude to the right, latitude up)."""
    return _total(F.transform(segments(ring, True), lambda s: s["a"]["lon"] * s["b"]["lat"] - s["b"]["lon"] * s["a"]["lat"])) / 2


def is_ccw(ring: Column) -> Column:
    return signed_area(ring) > 0


def is_clockwise(ring: Column) -> Column:
    return signed_area(ring) < 0


def centroid(points: Column) -> Column:
    """The mean of the vertices."""
    return F.struct((_total(F.transform(points, lambda p: p["lat"])) / F.size(points)).alias("lat"), (_total(F.transform(points, lambda p: p["lon"])) / F.size(points)).alias("lon"))


def position_in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """1 inside, 0 on a vertex, -1 outside, by the even-odd rule; edges count half-open, so a point on the upper edge is outside."""
    return F.when(F.exists(ring, lambda p: (p["lat"] == lat) & (p["lon"] == lon)), 0).when(holds_half_open(lat, lon, ring), 1).otherwise(-1)


def holds_half_open(lat: Column, lon: Column, ring: Column) -> Column:
    """The even-odd rule alone, for vertices too: of rings that lie side by side only one holds a point on their border."""

    def crossed(s: Column) -> Column:
        a, b = s["a"], s["b"]
        spans = ((a["lat"] <= lat) & (lat < b["lat"])) | ((b["lat"] <= lat) & (lat < a["lat"]))
        rise = F.when(b["lat"] == a["lat"], F.lit(1.0)).otherwise(b["lat"] - a["lat"])  # never used where 1.0 stands
        return spans & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / rise + a["lon"])

    return F.size(F.filter(segments(ring, True), crossed)) % 2 == 1


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Inside or on a vertex."""
    return position_in_ring(lat, lon, ring) >= 0


def ring_within(inner: Column, outer: Column) -> Column:
    """Every vertex of inner lies in outer."""
    return F.forall(inner, lambda p: in_ring(p["lat"], p["lon"], outer))


def ring_partly_within(inner: Column, outer: Column) -> Column:
    """Some vertex of inner lies in outer."""
    return F.exists(inner, lambda p: in_ring(p["lat"], p["lon"], outer))


def ring_part_of(inner: Column, outer: Column, quorum: float | None = None) -> Column:
    """Whether inner is a part of outer.

    Without a quorum the first vertex that is not on outer's vertices decides (vertices alone decide for none);
    with one, that share of the vertices that lie clearly inside or outside must lie inside.
    """
    places = F.transform(inner, lambda p: position_in_ring(p["lat"], p["lon"], outer))
    clear = F.filter(places, lambda k: k != 0)
    if quorum is None:
        return F.coalesce(F.get(clear, F.lit(0)) == 1, F.lit(False))
    return (F.size(clear) > 0) & (F.size(F.filter(clear, lambda k: k == 1)) / F.greatest(F.size(clear), F.lit(1)) >= quorum)


def _side(p: Column, a: Column, b: Column) -> Column:
    """Positive if p is left of the line from a to b."""
    return (b["lon"] - a["lon"]) * (p["lat"] - a["lat"]) - (p["lon"] - a["lon"]) * (b["lat"] - a["lat"])


def lines_meet(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Whether two segments share a point; ends count."""

    def between(p: Column, a: Column, b: Column) -> Column:
        return (p["lon"] >= F.least(a["lon"], b["lon"])) & (p["lon"] <= F.greatest(a["lon"], b["lon"])) & (p["lat"] >= F.least(a["lat"], b["lat"])) & (p["lat"] <= F.greatest(a["lat"], b["lat"]))

    s1, s2, s3, s4 = _side(b1, a1, a2), _side(b2, a1, a2), _side(a1, b1, b2), _side(a2, b1, b2)
    crossing = (s1 * s2 < 0) & (s3 * s4 < 0)
    touching = reduce(lambda x, y: x | y, [(s == 0) & between(p, a, b) for s, p, a, b in ((s1, b1, a1, a2), (s2, b2, a1, a2), (s3, a1, b1, b2), (s4, a2, b1, b2))])
    return crossing | touching


def meeting_point(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """struct<lat, lon> where two segments cross; null if they don't, or are parallel."""
    det = (a2["lon"] - a1["lon"]) * (b2["lat"] - b1["lat"]) - (a2["lat"] - a1["lat"]) * (b2["lon"] - b1["lon"])
    t = ((b1["lon"] - a1["lon"]) * (b2["lat"] - b1["lat"]) - (b1["lat"] - a1["lat"]) * (b2["lon"] - b1["lon"])) / F.nullif(det, F.lit(0.0))
    return F.when(lines_meet(a1, a2, b1, b2) & t.isNotNull(), F.struct((a1["lat"] + t * (a2["lat"] - a1["lat"])).alias("lat"), (a1["lon"] + t * (a2["lon"] - a1["lon"])).alias("lon")))


def nearest_on_segment(p: Column, s: Column) -> Column:
    """struct<far, lat, lon>: planar distance in degrees to a segment and the closest point on it; a segment of no length is infinitely far and has no point."""
    a, b = s["a"], s["b"]
    dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
    square = dx * dx + dy * dy
    # greatest and least pass nulls over.
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["lon"] - a["lon"]) * dx + (p["lat"] - a["lat"]) * dy) / F.nullif(square, F.lit(0.0)))))
    lat, lon = a["lat"] + t * dy, a["lon"] + t * dx
    far = F.coalesce(F.sqrt((p["lon"] - lon) * (p["lon"] - lon) + (p["lat"] - lat) * (p["lat"] - lat)), F.lit(INFINITE))
    return F.struct(far.alias("far"), lat.alias("lat"), lon.alias("lon"))


def nearest_on_line(p: Column, points: Column, closed: bool = False) -> Column:
    """struct<metres, lat, lon>: on each segment the planar closest point, of these the one nearest on the sphere; null without a segment of any length."""
    each = F.filter(F.transform(segments(points, closed), lambda s: nearest_on_segment(p, s)), lambda c: c["lat"].isNotNull())
    return F.array_min(F.transform(each, lambda c: F.struct(spherical_distance(p["lat"], p["lon"], c["lat"], c["lon"]).alias("metres"), c["lat"].alias("lat"), c["lon"].alias("lon"))))


def is_circular(ids: Column) -> Column:
    """A way that ends where it begins."""
    return (F.size(ids) > 2) & (F.get(ids, F.lit(0)) == F.element_at(ids, -1))


def without_repeats(points: Column) -> Column:
    """Drops points equal to the one before."""
    return F.filter(points, lambda p, i: (i == 0) | (p["lat"] != F.get(points, i - 1)["lat"]) | (p["lon"] != F.get(points, i - 1)["lon"]))


# ---- what needs a stack or a queue, one array at a time in numpy

_LINE = "array<struct<lat:double,lon:double>>"


def _xy(points) -> np.ndarray:
    return np.array([(p["lat"], p["lon"]) for p in points], float).reshape(-1, 2)


def _rows(xy: np.ndarray) -> list[dict]:
    return [{"lat": float(a), "lon": float(b)} for a, b in xy]


def thinned(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices that Douglas and Peucker's method keeps: no dropped point is farther than tolerance from the line that is left."""
    keep = np.zeros(len(xy), bool)
    if len(xy):
        keep[[0, -1]] = True
    todo = [(0, len(xy) - 1)] if len(xy) > 2 else []
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        base = xy[b] - xy[a]
        length = np.hypot(*base)
        rest = xy[a + 1 : b] - xy[a]
        far = np.abs(rest[:, 0] * base[1] - rest[:, 1] * base[0]) / length if length else np.hypot(rest[:, 0], rest[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.flatnonzero(keep)


def simplified(points: Column, tolerance: float | Column) -> Column:
    """The line with fewer points, in degrees of tolerance."""

    @F.pandas_udf(_LINE)
    def f(lines: pd.Series, tolerances: pd.Series) -> pd.Series:
        out = []
        for line, most in zip(lines, tolerances, strict=True):
            xy = _xy(line if line is not None else [])
            out.append(_rows(xy[thinned(xy, most)]) if len(xy) else [])
        return pd.Series(out)

    return f(points, tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance)))


def bend(points: Column) -> Column:
    """How far, in degrees, a line's points lie at most from the straight line through its ends, or from its end if both are one; null without points."""
    a, b = F.get(points, F.lit(0)), F.try_element_at(points, F.lit(-1))
    dy, dx = b["lat"] - a["lat"], b["lon"] - a["lon"]
    off = lambda p: F.abs((p["lat"] - a["lat"]) * dx - (p["lon"] - a["lon"]) * dy) / F.hypot(dy, dx)
    return F.array_max(F.transform(points, lambda p: F.when((dy == 0) & (dx == 0), F.hypot(p["lat"] - a["lat"], p["lon"] - a["lon"])).otherwise(off(p))))


def _depths(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far points p[..., 2] lie from the nearest of their edges from a to b[..., n, 2], negative outside of these."""
    p, d = p[..., None, :], b - a
    spans = (a[..., 0] <= p[..., 0]) != (b[..., 0] <= p[..., 0])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = d[..., 1] * (p[..., 0] - a[..., 0]) / d[..., 0] + a[..., 1]
    inside = (spans & (p[..., 1] < at)).sum(-1) % 2 == 1
    square = (d**2).sum(-1)
    t = np.clip(((p - a) * d).sum(-1) / np.where(square > 0, square, 1), 0, 1)
    far = np.sqrt(((a + t[..., None] * d - p) ** 2).sum(-1)).min(-1)
    return np.where(inside, far, -far)


def innermost_points(rings: list[np.ndarray], precision: float) -> np.ndarray:
    """For each ring the point inside that is farthest from it, by quartering cells best first; the rings take their steps together, so that many small ones cost one numpy call a step."""
    n = max(map(len, rings))
    # Rings are filled up with their first point: edges without length, beside no other points than those that are there.
    a = np.stack([np.concatenate([r, np.repeat(r[:1], n - len(r), 0)]) for r in rings])
    b = np.roll(a, -1, 1)
    best = [r.mean(0) for r in rings]
    best_far = _depths(np.array(best), a, b).tolist()
    queues = []
    for k, r in enumerate(rings):
        low, high = r.min(0), r.max(0)
        half = max((high - low).min() / 2, precision / 2)
        cells = np.array([(lat, lon) for lat in np.arange(low[0] + half, high[0] + half, 2 * half) for lon in np.arange(low[1] + half, high[1] + half, 2 * half)]).reshape(-1, 2)
        queue = [(-(d + half * 2**0.5), lat, lon, half, d) for (lat, lon), d in zip(cells.tolist(), _depths(cells, a[k], b[k]).tolist(), strict=True)]
        heapq.heapify(queue)
        queues.append(queue)
    active = range(len(rings))
    while True:
        going, sizes, cells = [], [], []
        for k in active:
            if not queues[k]:
                continue
            bound, lat, lon, h, d = heapq.heappop(queues[k])
            if d > best_far[k]:
                best[k], best_far[k] = (lat, lon), d
            if -bound - best_far[k] > precision:
                h /= 2
                going.append(k)
                sizes.append(h)
                cells.append([(lat - h, lon - h), (lat - h, lon + h), (lat + h, lon - h), (lat + h, lon + h)])
        if not going:
            return np.array(best, float)
        deep = _depths(np.array(cells), a[going][:, None], b[going][:, None]).tolist()
        for k, h, four, depths in zip(going, sizes, cells, deep, strict=True):
            for (lat, lon), d in zip(four, depths, strict=True):
                heapq.heappush(queues[k], (-(d + h * 2**0.5), lat, lon, h, d))
        active = going


def polygon_centre(ring: Column, precision: float = 1e-5) -> Column:
    """Where a label may stand: the innermost point of a ring; null for fewer than three points."""

    @F.pandas_udf("lat double, lon double")
    def f(rings: pd.Series) -> pd.DataFrame:
        found = np.full((len(rings), 2), np.nan)
        # Rings of about one size together, so that filling up costs little.
        todo = sorted(((len(r), k) for k, r in enumerate(rings) if r is not None and len(r) > 2), reverse=True)
        while todo:
            together = [k for _, k in todo[: max(1, 40_000 // todo[0][0])]]
            todo = todo[len(together) :]
            found[together] = innermost_points([_xy(rings.iloc[k]) for k in together], precision)
        return pd.DataFrame(found, columns=["lat", "lon"])

    return f(ring)


def is_simple(ring: Column) -> Column:
    """No two edges of a ring meet but neighbours at their shared end; a sweep over edges sorted by longitude."""

    def simple(xy: np.ndarray) -> bool:
        n = len(xy)
        if n < 3:
            return False
        a, b = xy, np.roll(xy, -1, 0)
        order = np.argsort(np.minimum(a[:, 1], b[:, 1]), kind="stable")
        open_: list[int] = []
        for i in map(int, order):
            left = min(a[i, 1], b[i, 1])
            open_ = [j for j in open_ if max(a[j, 1], b[j, 1]) >= left]
            for j in open_:
                if (i - j) % n in (1, n - 1):
                    continue
                side = lambda p, q, r: (q[1] - p[1]) * (r[0] - p[0]) - (r[1] - p[1]) * (q[0] - p[0])
                s = side(a[i], b[i], a[j]), side(a[i], b[i], b[j]), side(a[j], b[j], a[i]), side(a[j], b[j], b[i])
                overlap = np.all(np.maximum(np.minimum(a[i], b[i]), np.minimum(a[j], b[j])) <= np.minimum(np.maximum(a[i], b[i]), np.maximum(a[j], b[j])))
                if overlap and s[0] * s[1] <= 0 and s[2] * s[3] <= 0:
                    return False
            open_.append(i)
        return True

    @F.pandas_udf("boolean")
    def f(rings: pd.Series) -> pd.Series:
        return pd.Series([simple(_xy(r)) if r is not None else None for r in rings])

    return f(ring)


def cells_of_line(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Array of struct<x, y>: the grid cells that a line between two cells runs through, one for each step of its longer side."""
    n = F.greatest(F.abs(x2 - x1), F.abs(y2 - y1)).cast("int")
    at = lambda a, b, k: a + F.when(n == 0, F.lit(0)).otherwise(F.floor((b - a) * k / F.greatest(n, F.lit(1)) + 0.5)).cast("long")
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(at(x1, x2, k).alias("x"), at(y1, y2, k).alias("y")))


def parallel_line(points: Column, offset: float) -> Column:
    """The line moved sideways by offset degrees (to the left if positive), each vertex along the mean of its edges' normals."""

    def moved(xy: np.ndarray) -> np.ndarray:
        if len(xy) < 2:
            return xy
        d = np.diff(xy, axis=0)
        length = np.hypot(d[:, 0], d[:, 1])
        normal = np.stack([d[:, 1], -d[:, 0]], 1) / np.where(length > 0, length, 1)[:, None]
        normal = np.concatenate([normal[:1], normal[:-1] + normal[1:], normal[-1:]])
        size = np.hypot(normal[:, 0], normal[:, 1])
        return xy + offset * normal / np.where(size > 0, size, 1)[:, None]

    @F.pandas_udf(_LINE)
    def f(lines: pd.Series) -> pd.Series:
        return pd.Series([_rows(moved(_xy(x if x is not None else []))) for x in lines])

    return f(points)
