"""Coast polygons of cells: sums of areas, clipped areas by another method, and cells that stay undecided."""

from __future__ import annotations

import math
import random

import pytest

from atlasframe.operators import coasts

LEVEL = 10
W, H = 360 / 2**LEVEL, 180 / 2**LEVEL


def lines(spark, found):
    """Lines of points in units of cells, u to the east and v to the north."""
    rows = [(k, [(v * H - 90, u * W - 180) for u, v in line]) for k, line in enumerate(found)]
    return spark.createDataFrame(rows, "way_id long, points array<struct<lat:double,lon:double>>")


def clipped(ring, x, y):
    """A convex ring's area within a cell, by clipping at its four sides."""
    for axis, limit, sign in ((0, x, 1), (0, x + 1, -1), (1, y, 1), (1, y + 1, -1)):
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            a, b = sign * (p[axis] - limit), sign * (q[axis] - limit)
            if a >= 0:
                out.append(p)
            if (a < 0) != (b < 0):
                t = a / (a - b)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        ring = out
        if not ring:
            return 0.0
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def test_islands_and_lakes_by_clipping(spark):
    """Ellipses apart from each other, counter-clockwise as islands; each cell's land is the sum of their parts in it."""
    rng = random.Random(8)
    rings = []
    for k in range(40):
        cu, cv = 500 + 4 * (k % 8) + rng.random(), 300 + 4 * (k // 8) + rng.random()
        a, b, n = rng.uniform(0.05, 1.4), rng.uniform(0.05, 1.4), rng.randrange(3, 60)
        rings.append([(cu + a * math.cos(2 * math.pi * i / n), cv + b * math.sin(2 * math.pi * i / n)) for i in range(n)])
    sizes = coasts.ground_sizes(coasts.ground_polygons(lines(spark, [r + r[:1] for r in rings]), LEVEL), LEVEL).collect()
    assert len(sizes) > 100
    for r in sizes:
        assert r.land == pytest.approx(sum(clipped(ring, r.x, r.y) for ring in rings), abs=1e-7) and r.land + r.water == pytest.approx(1, abs=1e-7)
    lakes = coasts.ground_sizes(coasts.ground_polygons(lines(spark, [(r + r[:1])[::-1] for r in rings]), LEVEL), LEVEL).collect()
    assert {(r.x, r.y): round(r.water, 6) for r in lakes} == {(r.x, r.y): round(r.land, 6) for r in sizes}


def test_coasts_that_cross_a_cell_twice_and_meet_inside(spark):
    # Water between two coasts: one runs east along v = 5.25 with land to its north, one west along v = 5.75 would contradict it; the other way round there is a strait.
    strait = [[(1.5, 5.75), (4.5, 5.75)], [(4.5, 5.25), (1.5, 5.25)]]
    sizes = {(r.x, r.y): (round(r.land, 9), round(r.water, 9)) for r in coasts.ground_sizes(coasts.ground_polygons(lines(spark, strait), LEVEL), LEVEL).collect()}
    assert sizes == {(2, 5): (0.5, 0.5), (3, 5): (0.5, 0.5)}  # the cells where lines end stay undecided
    joined = [[(1.5, 5.75), (2.5, 5.75)], [(2.5, 5.75), (4.5, 5.75)]]
    sizes = {(r.x, r.y): (round(r.land, 9), round(r.water, 9)) for r in coasts.ground_sizes(coasts.ground_polygons(lines(spark, joined), LEVEL), LEVEL).collect()}
    assert sizes == {(2, 5): (0.25, 0.75), (3, 5): (0.25, 0.75)}


def test_island_with_a_lake_in_one_cell(spark):
    square = lambda c, r: [(7.5 - r, 7.5 - r), (7.5 + r, 7.5 - r), (7.5 + r, 7.5 + r), (7.5 - r, 7.5 + r), (7.5 - r, 7.5 - r)]
    found = coasts.ground_sizes(coasts.ground_polygons(lines(spark, [square(0, 0.4), square(0, 0.2)[::-1]]), LEVEL), LEVEL).collect()
    assert [(r.x, r.y, round(r.land, 9), round(r.water, 9)) for r in found] == [(7, 7, 0.48, 0.52)]


def test_contradictions_null_and_short_lines(spark):
    between = [[(1.5, 5.25), (4.5, 5.25)], [(4.5, 5.75), (1.5, 5.75)], [(9.2, 9.2)], []]
    sizes = {(r.x, r.y): (round(r.land, 9), round(r.water, 9)) for r in coasts.ground_sizes(coasts.ground_polygons(lines(spark, between), LEVEL), LEVEL).collect()}
    assert sizes == {(2, 5): (0.5, 0.5), (3, 5): (0.5, 0.5)}
    both_east = [[(1.5, 5.25), (4.5, 5.25)], [(1.5, 5.75), (4.5, 5.75)]]  # between them each says something else
    assert coasts.ground_polygons(lines(spark, both_east), LEVEL).count() == 0
    assert coasts.ground_polygons(spark.createDataFrame([(1, None)], "way_id long, points array<struct<lat:double,lon:double>>"), LEVEL).count() == 0


def test_lines_through_corners_and_along_borders(spark):
    diamond = [(10.0, 9.0), (11.0, 10.0), (10.0, 11.0), (9.0, 10.0), (10.0, 9.0)]
    found = coasts.ground_sizes(coasts.ground_polygons(lines(spark, [diamond]), LEVEL), LEVEL).collect()
    assert all(abs(r.land + r.water - 1) < 1e-9 for r in found) and sum(r.land for r in found) == pytest.approx(2)


def test_a_cell_may_go_over_several_batches():
    """Cells stream through one task in order instead of a call for each; where batches end makes no difference."""
    import pandas as pd

    rows = [(0, 0, 1, 0, 0.5, 2.5, None, None), (0, 0, 2, 0, 2.7, 0.3, None, None), (0, 1, 3, 0, float("nan"), 1.5, "a", None), (5, 0, 4, 0, 3.5, 1.5, None, None)]
    heads = pd.DataFrame(rows, columns=["x", "y", "way", "k", "enter", "leave", "start", "end"])
    whole, parts = ([tuple(r)[:5] for t in coasts._rings_of_cells(b) for r in t.itertuples(index=False)] for b in (iter([heads]), iter([heads[:1], heads[1:3], heads[3:]])))
    assert whole == parts and [r[:5] for r in whole if r[0] == 5] == [(5, 0, "water", 0, 0), (5, 0, "land", 0, 0)]
    assert [r[2] for r in whole if r[1] == 1] == ["unknown"] and {r[2] for r in whole if r[:2] == (0, 0)} == {"water", "land"}


def test_long_rows_of_cells_fill_from_both_ends(spark):
    """Looking ahead costs no pass over the rest of the row for each cell."""
    from pyspark.sql import functions as F

    from atlasframe.operators import importing

    n = 60_000
    row = spark.range(n).select(F.col("id").alias("x"), F.lit(0).cast("long").alias("y"), F.when(F.col("id") == 0, "coast").when(F.col("id") == n - 1, "land").otherwise("unknown").alias("state"))
    import time

    began = time.time()
    assert {r.state: r["count"] for r in importing.filled_land(row).groupBy("state").count().collect()} == {"coast": 1, "land": n - 1}
    assert time.time() - began < 60


def test_water_spreads_a_ring_a_round(spark, monkeypatch):
    """A table is written for what becomes water in a round, not for all cells again."""
    from pyspark.sql import functions as F

    from atlasframe.operators import importing

    sizes, write = [], importing.written
    monkeypatch.setattr(importing, "written", lambda df: sizes.append((t := write(df)).count()) or t)
    block = spark.range(21 * 21).select((F.col("id") % 21).alias("x"), F.floor(F.col("id") / 21).alias("y"))
    known = spark.createDataFrame([(10, 10, "water"), (10, 12, "coast"), (30, 3, "coast")], "x long, y long, state string")
    got = {(r.x, r.y): r.state for r in importing.filled_water(known, block, 4).collect()}
    assert got[10, 6] == got[9, 13 - 2] == "water" and got[10, 12] == "coast" and got[10, 5] == got[10, 13] == "unknown" and got[30, 3] == "coast"
    assert len(got) == 442 and sum(v == "water" for v in got.values()) == 38
    assert sizes[0] == 441 and max(sizes[1:]) < 20
