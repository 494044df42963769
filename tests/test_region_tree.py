"""Building regions, aliases and streets from rings."""

from __future__ import annotations

from atlasframe.operators import region_tree

SCHEMA = "region_id long, name string, level int, ring array<struct<lat:double,lon:double>>"


def box(a, b, c, d):
    return [(float(a), float(b)), (float(a), float(d)), (float(c), float(d)), (float(c), float(b))]


ROWS = [
    (1, "Land", 2, box(0, 0, 10, 10)), (2, "Kreis", 6, box(0, 0, 5, 5)), (3, "Stadt", 8, box(1, 1, 2, 2)), (4, "Insel", 6, box(20, 20, 21, 21)), (4, "Insel", 6, box(7, 7, 8, 8)), (4, "Insel", 6, box(8.5, 7, 9, 8)),
    (5, "Stadtteil", 9, box(1.2, 1.2, 1.5, 1.5)), (6, None, 8, box(3, 3, 4, 4)), (7, "", 8, box(3, 3, 4, 4)), (8, "zu tief", 11, box(3, 3, 4, 4)), (9, "ohne Ring", 8, []), (10, "ohne Stufe", None, box(3, 3, 4, 4)), (11, "quer", 8, box(4, 4, 6, 6)),
]


def test_tree_of_rings(spark):
    got = {r.region_id: (r.parent_id, r.depth) for r in region_tree.build_regions(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got == {1: (None, 0), 2: (1, 1), 3: (2, 2), 4: (1, 1), 5: (3, 3), 11: (1, 1)}
    assert region_tree.build_regions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_aliases_and_streets_go_to_the_deepest_region(spark):
    b = spark.createDataFrame(ROWS, SCHEMA)
    regions = region_tree.build_regions(b)
    places = spark.createDataFrame([(1, "Altstadt", 1.3, 1.3), (2, "Stadt", 1.9, 1.9), (3, "Hof", 4.5, 0.5), (4, None, 1.3, 1.3), (5, "See", 50.0, 50.0), (6, "Strand", 7.5, 7.5)], "node_id long, name string, lat double, lon double")
    assert sorted(map(tuple, region_tree.build_aliases(places, regions, b).collect())) == [(2, 3, "Hof"), (4, 6, "Strand"), (5, 1, "Altstadt")]
    line = lambda *p: [(float(a), float(b)) for a, b in p]
    ways = [(1, "Gasse", line((1.3, 1.3), (1.4, 1.4), (1.9, 1.9))), (2, "Gasse", line((1.25, 1.3), (1.3, 1.3))), (3, "Allee", line((1.7, 1.7), (4.5, 4.5), (1.6, 1.6))), (4, "Grenze", line((1.3, 1.3), (1.8, 1.8))), (5, None, line((1.3, 1.3))), (6, "Meer", line((50, 50), (51, 51))), (7, "leer", [])]
    streets = region_tree.streets_of_regions(spark.createDataFrame(ways, "way_id long, name string, points array<struct<lat:double,lon:double>>"), regions, b)
    assert sorted((r.way_id, r.region_id, round(r.share, 3)) for r in streets.collect()) == [(1, 5, 0.667), (2, 5, 1.0), (3, 3, 0.667), (4, 5, 0.5)]
    places, objects = region_tree.build_locations(streets)
    assert sorted((r.region_id, r["name"]) for r in places.collect()) == [(3, "Allee"), (5, "Gasse"), (5, "Grenze")] and objects.count() == 4
    parks = spark.createDataFrame([(1, "Park", box(1.2, 1.2, 1.4, 1.4)), (2, "Wald", box(0, 0, 9, 9))], "area_id long, name string, ring array<struct<lat:double,lon:double>>")
    assert sorted(map(tuple, region_tree.areas_of_regions(parks, regions, b).collect())) == [(1, "Park", 5), (2, "Wald", 11)]
