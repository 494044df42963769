"""Searches over turns, merged areas and matched positions on small hand-made maps."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from atlasframe.operators import descriptions, importing, routing


@pytest.fixture(scope="module")
def graph(spark):
    # 1 -> 2 -> 3 -> 4 with a restricted way from 2 to 3, and an open detour over 5.
    rows = [("a", 1, 2, 10, False), ("b", 2, 3, 11, True), ("c", 3, 4, 12, False), ("d", 2, 5, 13, False), ("e", 5, 3, 13, False)]
    return spark.createDataFrame(rows, "edge_id string, from_id long, to_id long, way_id long, restricted boolean").withColumns({"cost": F.lit(1.0), "type": F.lit("primary"), "maxspeed": F.lit(None).cast("int")})


def _costs(spark, graph, start, excluded=None, vehicle=None, turned=False):
    starts = spark.createDataFrame([(0, start, 0.5, turned)], "source long, edge_id string, share double, turned boolean")
    costs = routing.costs_from(routing.start_states(starts, graph, vehicle), routing.turn_graph(graph, vehicle, excluded))
    return {r.node_id: round(r.cost, 9) for r in routing.node_costs(costs, graph).collect()}


def test_no_way_back_from_restricted_ways(spark, graph):
    assert _costs(spark, graph, "a") == {2: 0.5, 3: 1.5, 5: 1.5, 4: 3.5}
    # A search that begins on a restricted way may leave it.
    assert _costs(spark, graph, "b") == {3: 0.5, 4: 1.5}


def test_excluded_turns_and_turning_round(spark, graph):
    barred = spark.createDataFrame([(2, 10, 13)], "via_id long, from_way long, to_way long")
    assert _costs(spark, graph, "a", barred) == {2: 0.5, 3: 1.5}
    assert _costs(spark, graph, "c", vehicle="car", turned=True) == {4: 0.75}


def test_changes_of_ways_cost(spark, graph):
    found = _costs(spark, graph, "d", vehicle="car")
    # 40 m at 70 km/h where ways of one type meet; none along way 13.
    assert found == {5: 0.5, 3: 1.5, 4: round(2.5 + 0.04 / 70, 9)}


def test_merged_areas_keep_their_hole(spark):
    node = lambda x, y: y * 10 + x
    fields = [(y * 3 + x, "a", [node(x, y), node(x + 1, y), node(x + 1, y + 1), node(x, y + 1)]) for y in range(3) for x in range(3) if (x, y) != (1, 1)]
    fields += [(4, "b", [node(1, 1), node(2, 1), node(2, 2), node(1, 2)]), (20, "a", [node(7, 7), node(8, 7), node(8, 8)])]
    rings = {(r.area_id, len(r.ids)): r for r in importing.merged_areas(spark.createDataFrame(fields, "area_id long, type string, ids array<long>")).collect()}
    assert sorted(rings) == [(0, 4), (0, 12), (4, 4), (20, 3)] and rings[0, 12].n_areas == 8 and rings[20, 3].n_areas == 1
    hole = rings[0, 4].ids
    at = hole.index(node(1, 1))
    assert hole[at:] + hole[:at] == [node(1, 1), node(1, 2), node(2, 2), node(2, 1)]


def test_positions_off_the_route(spark):
    route = spark.createDataFrame([(1, k, 48.0, 8.0 + k / 100) for k in range(4)], "route long, idx int, lat double, lon double")
    seen = spark.createDataFrame([(1, 0, 48.0001, 8.015), (1, 1, 48.1, 8.015), (2, 2, 48.0, 8.0)], "route long, key int, lat double, lon double")
    found = {r.key: r for r in descriptions.matched_positions(seen, route, 50.0).collect()}
    assert found[0].idx == 1 and abs(found[0].distance - 11.12) < 0.01 and round(found[0].at_lon, 9) == 8.015
    assert found[1].idx is None and found[2].distance is None
