"""Lines and rings cut at a box, and lines moved sideways: Column expressions over arrays of structs with two numeric fields.

Fields are named by the caller (lat and lon of points, x and y of pixels). Each value that an expression uses more than once is
bound to a lambda variable, so that it is computed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _point(values: tuple[Column, Column], names: tuple[str, str]) -> Column:
    return F.struct(values[0].alias(names[0]), values[1].alias(names[1]))


def _cut_side(ring: Column, names: tuple[str, str], axis: int, limit: Column, keep_above: bool) -> Column:
    """A ring's part on one side of a line along the other axis."""
    n, other = F.size(ring), names[1 - axis]

    def edge(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + 1) % n)
        gap = lambda c: (c[names[axis]] - limit) if keep_above else (limit - c[names[axis]])
        t = gap(p) / F.nullif(gap(p) - gap(q), F.lit(0.0))
        across = p[other] + t * (q[other] - p[other])
        met = _point((limit, across) if axis == 0 else (across, limit), names)
        here = F.when(gap(p) >= 0, F.array(p)).otherwise(F.slice(F.array(p), 1, 0))
        return F.concat(here, F.when((gap(p) > 0) & (gap(q) < 0) | (gap(p) < 0) & (gap(q) > 0), F.array(met)).otherwise(F.slice(F.array(p), 1, 0)))

    return F.flatten(F.transform(ring, edge))


def clip_ring(ring: Column, low: tuple[Column, Column], high: tuple[Column, Column], names: tuple[str, str] = ("lat", "lon")) -> Column:
    """The part of a ring within a box from low to high, one side after the other; empty if nothing is inside. Parts that a concave ring falls into are joined along the box's sides, as filling them needs no more."""
    steps = [(0, low[0], True), (0, high[0], False), (1, low[1], True), (1, high[1], False)]
    plain = F.transform(ring, lambda p: _point((p[names[0]].cast("double"), p[names[1]].cast("double")), names))

    def cut(value: Column, left: list) -> Column:
        if not left:
            return value
        axis, limit, above = left[0]
        return bound(value, lambda r: cut(_cut_side(r, names, axis, limit.cast("double"), above), left[1:]))

    return cut(plain, steps)


def clip_line(points: Column, low: tuple[Column, Column], high: tuple[Column, Column], names: tuple[str, str] = ("lat", "lon")) -> Column:
    """The parts of a line within a box, as an array of lines in order. A part that only touches the box from outside, in one point, is none."""

    def inside(i: Column, line: Column) -> Column:
        """The share of edge i within the box, as struct<i, t0, t1>."""
        p, q = F.get(line, i), F.get(line, i + 1)
        enters, leaves = [F.lit(0.0)], [F.lit(1.0)]
        blocked = F.lit(False)
        for k in (0, 1):
            a, d = p[names[k]], q[names[k]] - p[names[k]]
            still = d == 0
            t0, t1 = (low[k] - a) / F.nullif(d, F.lit(0.0)), (high[k] - a) / F.nullif(d, F.lit(0.0))
            enters.append(F.when(still, F.lit(0.0)).otherwise(F.least(t0, t1)))
            leaves.append(F.when(still, F.lit(1.0)).otherwise(F.greatest(t0, t1)))
            blocked = blocked | (still & ((a < low[k]) | (a > high[k])))
        return F.struct(i.alias("i"), F.greatest(*enters).alias("t0"), F.when(blocked, F.lit(-1.0)).otherwise(F.least(*leaves)).alias("t1"))

    def at(line: Column, i: Column, t: Column) -> Column:
        """A point of edge i; its ends are taken as they are."""
        p, q = F.get(line, i), F.get(line, i + 1)
        mid = _point((p[names[0]] + t * (q[names[0]] - p[names[0]]), p[names[1]] + t * (q[names[1]] - p[names[1]])), names)
        return F.when(t == 0, p).when(t == 1, q).otherwise(mid)

    def parts(line: Column, seen: Column) -> Column:
        goes_on = lambda e, k: F.coalesce((F.get(seen, k - 1)["i"] == e["i"] - 1) & (F.get(seen, k - 1)["t1"] == 1) & (e["t0"] == 0), F.lit(False))
        starts = F.filter(F.transform(seen, lambda e, k: F.when(~goes_on(e, k), k)), lambda k: k.isNotNull())

        def part(starts: Column, k: Column, j: Column) -> Column:
            end = F.coalesce(F.get(starts, j + 1), F.size(seen))
            own = F.slice(seen, k + 1, end - k)
            return F.concat(F.array(at(line, F.get(seen, k)["i"], F.get(seen, k)["t0"])), F.transform(own, lambda e: at(line, e["i"], e["t1"])))

        return bound(starts, lambda s: F.transform(s, lambda k, j: part(s, k, j)))

    plain = F.transform(points, lambda p: _point((p[names[0]].cast("double"), p[names[1]].cast("double")), names))
    edges = lambda line: F.when(F.size(line) < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.size(line) - 2, F.lit(0))))
    return bound(plain, lambda line: bound(F.filter(F.transform(edges(line), lambda i: inside(i, line)), lambda e: e["t0"] < e["t1"]), lambda seen: parts(line, seen)))


def offset_line(points: Column, offset: Column | float, names: tuple[str, str] = ("x", "y"), limit: float = 4.0) -> Column:
    """A line moved sideways by offset, to the left of its direction (first field to the right, second up) if positive.

    Inner vertices are mitred: they keep the distance from both edges. Where the mitre would be longer than limit times the offset, the corner is cut: both edges' own ends follow
    each other. Repeated points are dropped; fewer than two different points stay as they are.
    """
    a, b = names
    off = F.lit(float(offset)) if isinstance(offset, (int, float)) else offset.cast("double")
    plain = F.transform(points, lambda p: _point((p[a].cast("double"), p[b].cast("double")), names))
    single = lambda line: F.filter(line, lambda p, k: (k == 0) | (p != F.get(line, k - 1)))

    def normals(line: Column) -> Column:
        def one(k: Column) -> Column:
            dx, dy = F.get(line, k + 1)[a] - F.get(line, k)[a], F.get(line, k + 1)[b] - F.get(line, k)[b]
            return bound(F.sqrt(dx * dx + dy * dy), lambda size: F.struct((-dy / size).alias("x"), (dx / size).alias("y")))

        return F.transform(F.sequence(F.lit(0), F.size(line) - 2), one)

    def moved(line: Column, n: Column) -> Column:
        shift = lambda p, v, by: _point((p[a] + v["x"] * by, p[b] + v["y"] * by), names)

        def corner(p: Column, k: Column) -> Column:
            u, v = F.get(n, k - 1), F.get(n, k)
            share = 1 + u["x"] * v["x"] + u["y"] * v["y"]  # twice the square of the mitre's inverse length
            mitre = F.struct((u["x"] + v["x"]).alias("x"), (u["y"] + v["y"]).alias("y"))
            return (
                F.when(u.isNull(), F.array(shift(p, v, off))).when(v.isNull(), F.array(shift(p, u, off))).when(share * limit * limit < 2, F.array(shift(p, u, off), shift(p, v, off))).otherwise(F.array(shift(p, mitre, off / share)))
            )

        return F.flatten(F.transform(line, corner))

    return bound(plain, lambda all_: bound(single(all_), lambda line: F.when(F.size(line) < 2, line).otherwise(bound(normals(line), lambda n: moved(line, n)))))
