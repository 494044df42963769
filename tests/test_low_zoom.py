"""Lines of low zooms: one pass over the lines, and no Python for straight ones."""

from __future__ import annotations

from atlasframe.functions import shapes
from atlasframe.operators import importing


def line(*p):
    return [(float(a), float(b)) for a, b in p]


def test_straight_lines_keep_their_ends_without_python(spark, monkeypatch):
    asked, plain = [], shapes.simplified
    monkeypatch.setattr(shapes, "simplified", lambda points, most: asked.append((points, most)) or plain(points, most))
    rows = [(1, line((0, 0), (1, 1), (2, 2))), (2, line((0, 0), (3, 1), (0, 2))), (3, line((0, 0), (0.05, 0))), (4, line((0, 0), (5, 5))), (5, line((0, 0), (2, 2), (0, 0))), (6, line((0, 0), (2, 0.0001), (4, 0)))]
    lines = spark.createDataFrame(rows, "way_id long, points array<struct<lat:double,lon:double>>")
    low = importing.low_zoom(lines, "way_id", "points", [0, 4, 12])
    got = {(r.way_id, r.zoom): [tuple(p) for p in r.points] for r in low.collect()}
    assert got[1, 4] == [(0, 0), (2, 2)] and got[1, 0] == got[1, 4] and got[2, 4] == rows[1][1] and (3, 4) not in got and got[3, 12] == rows[2][1]
    assert got[4, 0] == rows[3][1] and got[5, 4] == rows[4][1] and got[6, 4] == [(0, 0), (4, 0)] and len(got[6, 12]) == 3
    assert len(asked) == 1


def test_a_node_with_many_ways_makes_its_text_once(spark, tmp_path):
    """Each row of a way names all ways of its node; the text comes from the node."""
    from atlasframe.plans import routes

    plan = routes.g18_route_junctions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("array_join(")
