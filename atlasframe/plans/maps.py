"""Queries of map drawing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clipping, geo, shapes
from ..operators import coasts, maps
from ..registry import query
from .sample import ISLAND_LEVEL, area_rings, island_coasts, sql, table, view, way_lines

_RULES = [
    (1, "line", None, 0, None, None, None, {"color": "#808080", "width": "1"}),
    (2, "line", "motorway", 5, None, None, None, {"color": "#ff0000"}),
    (3, "line", "primary", 10, 13, None, None, {"color": "#ffff00", "width": "2"}),
    (4, "arrow", None, 12, None, True, None, {"symbol": "arrow"}),
    (5, "line", "track", 15, None, None, None, {"color": "#000000"}),
    (6, "line", None, 0, None, None, 5.0, {"width": "3"}),
]


def _rules(spark):
    return spark.createDataFrame(_RULES, "rule_no int, slot string, type string, min_zoom int, max_zoom int, oneway boolean, min_size double, attributes map<string,string>")


@query(sql("ways")("""SELECT way_id AS obj_id, 'line' AS slot, 'color' AS attribute, CASE type WHEN 'motorway' THEN '#ff0000' WHEN 'primary' THEN '#ffff00' ELSE '#808080' END AS value FROM ways
UNION ALL SELECT way_id, 'line', 'width', CASE WHEN n_points >= 5 THEN '3' WHEN type = 'primary' THEN '2' ELSE '1' END FROM ways UNION ALL SELECT way_id, 'arrow', 'symbol', 'arrow' FROM ways WHERE oneway"""))
def m6_styles(spark, sf_dir):
    w = view(spark, sf_dir, "ways").select(F.col("way_id").alias("obj_id"), "type", "oneway", F.col("n_points").cast("double").alias("size"))
    return maps.resolved_styles(w, _rules(spark), 12)


@query(sql("ways")("SELECT way_id FROM ways WHERE type IN ('motorway', 'primary')"))
def m2_types_at_zoom(spark, sf_dir):
    """Ways of the types that have a rule of their own at a zoom level."""
    return view(spark, sf_dir, "ways").join(maps.types_at(_rules(spark), 12), "type", "left_semi").select("way_id")


@query(sql("areas", "corners")("""SELECT area_id FROM corners GROUP BY area_id HAVING min(clat) <= 48.5 AND max(clat) >= 47.5 AND min(clon) <= 9 AND max(clon) >= 8 AND (max(clat) - min(clat) > 5 * 360 / CAST(262144 AS DOUBLE) OR max(clon) - min(clon) > 5 * 360 / CAST(262144 AS DOUBLE))"""))
def f20_visible(spark, sf_dir):
    a = area_rings(spark, sf_dir).withColumn("box", geo.box_of_points(F.col("ring")))
    return maps.visible(a, geo.box(*map(F.lit, (47.5, 8.0, 48.5, 9.0))), 10, 5.0).select("area_id")


@query(sql("ways", "way_points")("""SELECT way_id, round(sum((lon + 180) / 360 * 262144), 2) AS x_sum FROM way_points GROUP BY way_id"""))
def m8_draw_list(spark, sf_dir):
    d = maps.draw_list(way_lines(spark, sf_dir), 10)
    return d.select("way_id", F.round(F.aggregate(F.transform("pixels", lambda p: p["x"]), F.lit(0.0), lambda a, x: a + x), 2).alias("x_sum"))


@query(sql("areas")(""", cut AS (SELECT *, greatest(0, least(lon + half, 8.9) - greatest(lon - half, 7.7)) * greatest(0, least(lat + half, 48.6) - greatest(lat - half, 47.3)) AS body, greatest(lat + half, 47.3) AS y0, least(lat + 1.5 * half, 48.6) AS y1 FROM areas),
steps AS (SELECT *, unnest(list_sort(list_transform([y0, y1, lat + 1.5 * half - abs(7.7 - lon) / 2, lat + 1.5 * half - abs(8.9 - lon) / 2], lambda y: least(greatest(y, y0), y1)))) AS y FROM cut WHERE y0 < y1),
wide AS (SELECT area_id, y, greatest(0, least(lon + 2 * (lat + 1.5 * half - y), 8.9) - greatest(lon - 2 * (lat + 1.5 * half - y), 7.7)) AS w FROM steps),
roof AS (SELECT area_id, sum((y - y_before) * (w + w_before) / 2) AS size FROM (SELECT *, lag(y) OVER o AS y_before, lag(w) OVER o AS w_before FROM wide WINDOW o AS (PARTITION BY area_id ORDER BY y)) GROUP BY area_id)
SELECT area_id, round(body + coalesce(size, 0), 10) AS size FROM cut LEFT JOIN roof USING (area_id) WHERE body + coalesce(size, 0) > 0"""))
def m8_clipped_areas(spark, sf_dir):
    """The size, in square degrees, of what a view shows of each area: a square and its roof, cut at the view's sides."""
    ring = clipping.clip_ring(F.col("ring"), (F.lit(47.3), F.lit(7.7)), (F.lit(48.6), F.lit(8.9)))
    shown = area_rings(spark, sf_dir).withColumn("size", F.abs(shapes.signed_area(ring))).where("size > 0")
    return shown.select("area_id", F.round("size", 10).alias("size"))


@query(sql("ways", "way_points")("""SELECT way_id, round(sum(greatest(0, b - a)), 9) AS shown FROM (
  SELECT w.way_id, greatest(CASE WHEN upright = 1 THEN p.lat ELSE p.lon END, CASE WHEN upright = 1 THEN 48.1 ELSE 8.1 END) AS a, least(CASE WHEN upright = 1 THEN q.lat ELSE q.lon END, CASE WHEN upright = 1 THEN 48.2 ELSE 8.3 END) AS b,
    CASE WHEN upright = 1 THEN p.lon BETWEEN 8.1 AND 8.3 ELSE p.lat BETWEEN 48.1 AND 48.2 END AS seen
  FROM ways w JOIN way_points p USING (way_id) JOIN way_points q ON q.way_id = p.way_id AND q.idx = p.idx + 1) WHERE seen GROUP BY way_id HAVING sum(greatest(0, b - a)) > 0"""))
def m8_clipped_ways(spark, sf_dir):
    """The length, in degrees, of what a view shows of each way."""
    parts = clipping.clip_line(F.col("points"), (F.lit(48.1), F.lit(8.1)), (F.lit(48.2), F.lit(8.3)))
    lines = way_lines(spark, sf_dir).select("way_id", F.explode(parts).alias("part"))
    step = F.transform(shapes.segments(F.col("part")), lambda s: F.hypot(s["b"]["lat"] - s["a"]["lat"], s["b"]["lon"] - s["a"]["lon"]))
    return lines.groupBy("way_id").agg(F.round(F.sum(F.aggregate(step, F.lit(0.0), lambda t, x: t + x)), 9).alias("shown"))


@query(sql("areas")("""SELECT area_id, round((4 + 2 * sqrt(CAST(1.25 AS DOUBLE))) * half - 2 * CAST(0.0001 AS DOUBLE) * (1 + tan((pi() / 2 - atan(CAST(0.5 AS DOUBLE))) / 2) + CAST(0.5 AS DOUBLE)), 10) AS length FROM areas"""))
def m8_offset_outlines(spark, sf_dir):
    """The length of each area's outline, open between its last and first corner, moved inwards."""
    line = clipping.offset_line(F.col("ring"), 0.0001, ("lon", "lat"))
    step = F.transform(shapes.segments(line), lambda s: F.hypot(s["b"]["lat"] - s["a"]["lat"], s["b"]["lon"] - s["a"]["lon"]))
    return area_rings(spark, sf_dir).select("area_id", F.round(F.aggregate(step, F.lit(0.0), lambda t, x: t + x), 10).alias("length"))


@query(sql("areas", "ways")("""SELECT kind, obj_id, CAST(row_number() OVER (ORDER BY k, layer, v, obj_id) AS INT) AS rank FROM (SELECT 0 AS k, 'area' AS kind, area_id AS obj_id, area_id % 3 AS layer, -half AS v FROM areas UNION ALL SELECT 1, 'way', way_id, way_id % 2, CAST(grade AS DOUBLE) FROM ways)"""))
def o10_draw_order(spark, sf_dir):
    a = view(spark, sf_dir, "areas").select(F.col("area_id").alias("obj_id"), (F.col("area_id") % 3).alias("layer"), F.col("half").alias("size"))
    w = view(spark, sf_dir, "ways").select(F.col("way_id").alias("obj_id"), (F.col("way_id") % 2).alias("layer"), F.col("grade").alias("priority"))
    return maps.draw_order(a, w)


@query(sql("nodes")("""SELECT z, x, y, count(*) AS n FROM (SELECT 10 AS z, CAST(floor((lon + 180) / 360 * 1024) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 1024) AS BIGINT) AS y FROM nodes) GROUP BY ALL"""))
def m1_tiles(spark, sf_dir):
    return maps.in_tiles(view(spark, sf_dir, "nodes"), 10).groupBy("z", "x", "y").agg(F.count("*").alias("n"))


@query("""SELECT CAST(22 AS INT) AS z, CAST(p_partkey AS BIGINT) AS x, CAST(p_partkey AS BIGINT) AS y, CASE WHEN p_partkey // 4 % 2 = 0 AND p_partkey // 4 >= (SELECT min(p_partkey) FROM part) THEN 20 END::INT AS parent_z FROM part WHERE p_partkey % 4 <> 0""")
def m4_missing_tiles(spark, sf_dir):
    """A tile for each part. Every fourth one is loaded, and every second tile two levels above."""
    wanted = table(spark, sf_dir, "part").select(F.lit(22).alias("z"), F.col("p_partkey").alias("x"), F.col("p_partkey").alias("y"))
    loaded = wanted.where("x % 4 = 0").unionByName(wanted.where("x % 2 = 0").select(F.lit(20).alias("z"), "x", "y"))
    return maps.missing_tiles(wanted, loaded)


@query(sql("islands", "island_cells")("""SELECT x, y, CASE WHEN touched AND NOT inner_cell THEN 'coast' ELSE 'water' END AS state FROM island_cells WHERE x BETWEEN 7 AND 146 AND y <= 6 UNION SELECT x, y, 'water' FROM (SELECT unnest(generate_series(7, 146)) AS x), (SELECT unnest(generate_series(0, 6)) AS y) WHERE (x, y) NOT IN (SELECT x, y FROM island_cells)"""))
def p16_ground_tiles(spark, sf_dir):
    """The cells of a box of 140 by 7, some with the coasts of islands; the others are water by default."""
    w, h = 360 / 2.0**ISLAND_LEVEL, 180 / 2.0**ISLAND_LEVEL
    box = spark.createDataFrame([(0.5 * h - 90, 7.5 * w - 180, 6.5 * h - 90, 146.5 * w - 180)], "min_lat double, min_lon double, max_lat double, max_lon double")
    stored = coasts.ground_polygons(island_coasts(spark, sf_dir), ISLAND_LEVEL).select("x", "y", F.lit("coast").alias("state")).distinct()
    return maps.ground_tiles(box, ISLAND_LEVEL, stored, "water")


@query()
def m9_labels(spark, sf_dir):
    """No SQL: placing is greedy. One label a node, in tiles of zoom 10."""
    t = maps.in_tiles(view(spark, sf_dir, "nodes"), 10).withColumn("p", geo.mercator_pixel(F.col("lat"), F.col("lon"), 10))
    labels = t.select(F.concat_ws("/", "x", "y").alias("tile"), "obj_id", (F.col("obj_id") % 10).alias("priority"), (F.col("p.x") % 256).cast("int").alias("x"), (F.col("p.y") % 256).cast("int").alias("y"), (F.length("name") * 6).alias("width"), F.lit(12).alias("height"))
    return maps.placed_labels(labels).select("tile", "obj_id")


@query(sql("nodes", "ways", "areas")("""SELECT type, count(*) FILTER (kind = 'node') AS nodes, count(*) FILTER (kind = 'way') AS ways, count(*) FILTER (kind = 'area') AS areas, count(name) AS labels, count(*) AS total FROM (SELECT type, name, 'node' AS kind FROM nodes UNION ALL SELECT type, name, 'way' FROM ways UNION ALL SELECT type, name, 'area' FROM areas) GROUP BY type"""))
def a13_painter_statistics(spark, sf_dir):
    k = lambda name, kind: view(spark, sf_dir, name).select("type", "name", F.lit(kind).alias("kind"))
    return maps.painter_statistics(k("nodes", "node").unionByName(k("ways", "way")).unionByName(k("areas", "area")))


@query(sql("nodes")("""SELECT obj_id % 20 AS place, arg_min(obj_id, (lat, lon, obj_id)) AS obj_id FROM nodes GROUP BY obj_id % 20"""))
def d2_best_object(spark, sf_dir):
    n = view(spark, sf_dir, "nodes")
    return maps.best_object_at(n.select((F.col("obj_id") % 20).alias("place"), "obj_id", F.lit("node").alias("kind"), F.col("lat").alias("distance"), F.col("lon").alias("size"), "name"))
