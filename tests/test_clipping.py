"""Clipping and offsets against plain geometry."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from atlasframe.functions import clipping

POINTS = "array<struct<lat:double,lon:double>>"


def view():
    """A box from (0, 0) to (10, 8)."""
    return (F.lit(0.0), F.lit(0.0)), (F.lit(10.0), F.lit(8.0))


def area(p):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True))) / 2 if p else 0.0


def inside_share(line, n=2000):
    """Length of a line within the box, by small steps."""
    total = 0.0
    for (a, b), (c, d) in zip(line, line[1:], strict=False):
        hit = sum(0 <= a + (c - a) * (k + 0.5) / n <= 10 and 0 <= b + (d - b) * (k + 0.5) / n <= 8 for k in range(n))
        total += math.hypot(c - a, d - b) * hit / n
    return total


def test_rings_by_a_grid_of_points(spark):
    rng = random.Random(1)
    rings = [[(rng.uniform(-6, 16), rng.uniform(-6, 14)) for _ in range(3)] for _ in range(40)] + [[(-5, -5), (15, -5), (15, 15), (-5, 15)], [(20, 20), (21, 20), (20, 21)], [(1, 1), (2, 1), (2, 2)], [(0, 0), (10, 0), (10, 8), (0, 8)]]
    df = spark.createDataFrame([(k, [(float(a), float(b)) for a, b in r]) for k, r in enumerate(rings)], f"k int, ring {POINTS}")
    got = {r.k: [tuple(p) for p in r.c] for r in df.select("k", clipping.clip_ring(F.col("ring"), *view()).alias("c")).collect()}
    for k, ring in enumerate(rings):
        side = lambda p, a, b: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        holds = lambda p: all(side(p, a, b) >= 0 for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) or all(side(p, a, b) <= 0 for a, b in zip(ring, ring[1:] + ring[:1], strict=True))  # noqa: E731, B023
        n = 60
        share = sum(holds((10 * (i + 0.5) / n, 8 * (j + 0.5) / n)) for i in range(n) for j in range(n)) / n / n
        assert area(got[k]) == pytest.approx(80 * share, abs=2.5) and all(-1e-9 <= a <= 10 + 1e-9 and -1e-9 <= b <= 8 + 1e-9 for a, b in got[k])
    assert [area(got[k]) for k in (40, 41, 42, 43)] == [80, 0, 0.5, 80]
    nothing = spark.createDataFrame([(1, None), (2, [])], f"k int, ring {POINTS}").select("k", clipping.clip_ring(F.col("ring"), *view()).alias("c")).collect()
    assert {r.k: r.c for r in nothing} == {1: None, 2: []}


def test_lines_keep_their_parts(spark):
    rng = random.Random(2)
    lines = [[(rng.uniform(-6, 16), rng.uniform(-6, 14)) for _ in range(rng.randrange(2, 9))] for _ in range(60)]
    lines += [[(1, 1), (2, 2), (20, 2), (20, 5), (5, 5)], [(-1, 4), (11, 4), (11, 5), (-1, 5)], [(1, 1), (1, 1), (2, 2)], [(-1, 0), (11, 0)], [(3, 3)], []]
    df = spark.createDataFrame([(k, [(float(a), float(b)) for a, b in r]) for k, r in enumerate(lines)], f"k int, line {POINTS}")
    got = {r.k: [[tuple(p) for p in part] for part in r.c] for r in df.select("k", clipping.clip_line(F.col("line"), *view()).alias("c")).collect()}
    for k in range(60):
        assert sum(math.dist(a, b) for part in got[k] for a, b in zip(part, part[1:], strict=False)) == pytest.approx(inside_share(lines[k]), rel=0.01, abs=0.05)
    assert [got[k] for k in range(60, 66)] == [[[(1, 1), (2, 2), (10, 2)], [(10, 5), (5, 5)]], [[(0, 4), (10, 4)], [(10, 5), (0, 5)]], [[(1, 1), (1, 1), (2, 2)]], [[(0, 0), (10, 0)]], [], []]


def test_offsets_keep_the_distance_from_both_edges(spark):
    lines = [[(0, 0), (10, 0), (10, 10)], [(0, 0), (10, 0), (0, 0.5)], [(0, 0), (5, 0), (5, 0), (10, 0)], [(1, 1)], [(2, 2), (2, 2)], []]
    df = spark.createDataFrame([(k, [(float(a), float(b)) for a, b in r]) for k, r in enumerate(lines)], "k int, line array<struct<x:double,y:double>>")
    got = {r.k: [(round(p.x, 6), round(p.y, 6)) for p in r.c] for r in df.select("k", clipping.offset_line(F.col("line"), 1.0).alias("c")).collect()}
    assert got[0] == [(0, 1), (9, 1), (9, 10)]
    assert len(got[1]) == 4  # too sharp for a mitre: the corner is cut
    assert got[2] == [(0, 1), (5, 1), (10, 1)] and got[3] == [(1, 1)] and got[4] == [(2, 2)] and got[5] == []
    right = df.where("k = 0").select(clipping.offset_line(F.col("line"), -1.0).alias("c")).first().c
    assert [(p.x, p.y) for p in right] == [(0, -1), (11, -1), (11, 10)]
    rng = random.Random(3)
    bends = [(0.0, 0.0)]
    for _ in range(30):
        turn = rng.uniform(-1, 1)
        bends.append((bends[-1][0] + 5 * math.cos(turn), bends[-1][1] + 5 * math.sin(turn)))
    moved = [tuple(p) for p in spark.createDataFrame([(bends,)], "line array<struct<x:double,y:double>>").select(clipping.offset_line(F.col("line"), 0.7)).first()[0]]
    for (a, b), (p, q) in zip(zip(bends, bends[1:], strict=False), zip(moved, moved[1:], strict=False), strict=True):
        for m in (p, q):
            assert ((b[0] - a[0]) * (m[1] - a[1]) - (b[1] - a[1]) * (m[0] - a[0])) / 5 == pytest.approx(0.7)
