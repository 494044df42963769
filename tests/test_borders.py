"""Points on the borders and corners of regions side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasframe.operators import region_tree, spatial


def box(a, b, c, d):
    return [(float(a), float(b)), (float(a), float(d)), (float(c), float(d)), (float(c), float(b))]


#: Four squares that meet in (1, 1); the first two also hang below a region that holds both.
SQUARES = [(1, box(0, 0, 1, 1)), (2, box(0, 1, 1, 2)), (3, box(1, 0, 2, 1)), (4, box(1, 1, 2, 2)), (9, box(0, 0, 2, 2))]
POINTS = [(1, 1.0, 1.0), (2, 0.5, 1.0), (3, 1.0, 0.5), (4, 2.0, 2.0), (5, 0.0, 0.0), (6, 1.0, 2.0)]


def given(spark):
    return spark.createDataFrame(POINTS, "key long, lat double, lon double"), spark.createDataFrame(SQUARES, "region_id long, ring array<struct<lat:double,lon:double>>")


def test_a_corner_lies_in_one_of_the_regions_around_it(spark):
    held = spatial.containing(*given(spark)).groupBy("key").agg(F.sort_array(F.collect_list("region_id")).alias("r"))
    assert {x.key: x.r for x in held.collect()} == {1: [4, 9], 2: [2, 9], 3: [3, 9], 5: [1, 9]}


def test_the_smallest_region_of_a_corner_is_the_one_north_east_of_it(spark):
    assert {x.key: x.region_id for x in spatial.smallest_containing(*given(spark)).collect()} == {1: 4, 2: 2, 3: 3, 5: 1}


def test_a_place_on_a_corner_names_the_region_north_east_of_it(spark):
    rows = [(k, f"R{k}", 2 if k == 9 else 8, ring) for k, ring in SQUARES]
    b = spark.createDataFrame(rows, "region_id long, name string, level int, ring array<struct<lat:double,lon:double>>")
    places = spark.createDataFrame([(1, "Eck", 1.0, 1.0), (2, "Rand", 1.0, 0.5)], "node_id long, name string, lat double, lon double")
    assert sorted(map(tuple, region_tree.build_aliases(places, region_tree.build_regions(b), b).collect())) == [(3, 2, "Rand"), (4, 1, "Eck")]


def test_lines_through_a_shared_edge_cross_once_each(spark, monkeypatch):
    """Shared edges are crossed as one shape; collinear and partial meetings pair only what crosses."""
    from itertools import product

    line = lambda *p: [(float(a), float(b)) for a, b in p]
    up = [(k, line((0, 1), (1, 1), (2, 1))) for k in range(30)] + [(40, line((0, 0), (2, 2))), (41, line((1, 0), (1, 2)))]
    level = [(100 + k, line((1, 0), (1, 1), (1, 2))) for k in range(30)] + [(140, line((0, 2), (2, 0)))]
    a, b = spark.createDataFrame(up, "a_id long, points array<struct<lat:double,lon:double>>"), spark.createDataFrame(level, "b_id long, points array<struct<lat:double,lon:double>>")
    place = F.round(F.col("lat") * 10).cast("long") * 1000 + F.round(F.col("lon") * 10).cast("long")
    want = sorted({tuple(r) for r in spatial.crossings(a, b).select("a_id", "b_id", place).collect()})
    rows = []
    plain = spatial.crossings
    monkeypatch.setattr(spatial, "crossings", lambda *x: rows.append((d := plain(*x)).count()) or d)
    got = sorted(tuple(r) for r in spatial.crossing_lines(a, b, place).collect())
    assert got == want and set(product(range(30), range(100, 130), [10010])) <= set(got) and rows[0] < 30
