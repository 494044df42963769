"""Placed labels against the greedy order."""

from __future__ import annotations

import random

from atlasframe import catalog
from atlasframe.operators import maps

SCHEMA = "tile string, obj_id long, priority int, x double, y double, width double, height double"


def greedy(rows):
    """One label after the other; rectangles of whole pixels."""
    out, standing = set(), {}
    rect = lambda r: (max(0, int(r[3] // 1)), int(r[4] // 1), max(1, int(r[5] // 1)), max(1, int(r[6] // 1)))
    for r in sorted(set(rows), key=lambda r: (r[0], r[2], r[1], rect(r)[1], rect(r)[0], rect(r)[2:])):
        x, y, w, h = rect(r)
        if all(x >= a + c or a >= x + w or y >= b + d or b >= y + h for a, b, c, d in standing.setdefault(r[0], [])):
            standing[r[0]].append((x, y, w, h))
            out.add((r[0], r[1], x, y))
    return out


def test_equals_greedy_with_a_tile_that_holds_a_third(spark):
    rng = random.Random(6)
    rows = []
    for k in range(1500):
        tile = "hot" if k % 3 == 0 else f"t{rng.randrange(40)}"
        rows.append((tile, k, rng.randrange(4), rng.uniform(-20, 500), rng.uniform(0, 500), rng.choice([0.0, 3.7, 40.0, 90.0, 300.0]), rng.choice([0.5, 12.0, 40.0])))
    rows += rows[:50] + [("t1", rows[0][1], 0, 5.0, 5.0, 20.0, 12.0), ("t1", rows[0][1], 0, 5.0, 30.0, 20.0, 12.0)]
    got = maps.placed_labels(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == greedy(rows)


def test_a_pile_of_labels_on_one_place_makes_no_pairs(spark):
    rows = [("hot", k, k % 7, 10.0, 10.0, 50.0, 12.0) for k in range(5000)] + [("hot", 9999, 9, 200.0, 10.0, 50.0, 12.0)]
    assert sorted(map(tuple, maps.placed_labels(spark.createDataFrame(rows, SCHEMA)).collect())) == [("hot", 0, 10, 10), ("hot", 9999, 200, 10)]


def test_nulls_and_empty_tables(spark):
    assert maps.placed_labels(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, 1, 0, 1.0, 1.0, 5.0, 5.0), ("a", None, 0, 1.0, 1.0, 5.0, 5.0), ("a", 2, 0, None, 1.0, 5.0, 5.0), ("a", 3, 5, 1.0, 1.0, 5.0, 5.0)]
    assert [tuple(r) for r in maps.placed_labels(spark.createDataFrame(rows, SCHEMA)).collect()] == [("a", 3, 1, 1)]


def test_query_equals_greedy(spark):
    from pyspark.sql import functions as F

    from atlasframe.functions import geo
    from atlasframe.plans.sample import view

    sf = "/root/testdata/sf0.001"
    t = maps.in_tiles(view(spark, sf, "nodes"), 10).withColumn("p", geo.mercator_pixel(F.col("lat"), F.col("lon"), 10))
    rows = [(f"{r.x}/{r.y}", r.obj_id, r.obj_id % 10, float(int(r.p.x % 256)), float(int(r.p.y % 256)), float(len(r.name) * 6), 12.0) for r in t.collect()]
    assert {(r.tile, r.obj_id) for r in catalog.QUERIES["m9_labels"](spark, sf).collect()} == {(a, b) for a, b, _, _ in greedy(rows)}
