"""Queries by place: radius, box, nearest object and containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, shapes
from ..operators import spatial
from ..registry import query
from .sample import area_rings, haversine, sql, vincenty, view, way_lines

LAT, LON = 48.1, 8.2
_SEGMENTS = """, e AS (SELECT way_id, lat AS alat, lon AS alon, lead(lat) OVER w AS blat, lead(lon) OVER w AS blon FROM way_points WINDOW w AS (PARTITION BY way_id ORDER BY idx)),
c AS (SELECT *, greatest(0, least(1, ((8.2 - alon) * (blon - alon) + (48.1 - alat) * (blat - alat)) / ((blon - alon) * (blon - alon) + (blat - alat) * (blat - alat)))) AS t FROM e WHERE blat IS NOT NULL),
p AS (SELECT way_id, alat + t * (blat - alat) AS clat, alon + t * (blon - alon) AS clon FROM c)"""
_EDGES = """, e AS (SELECT a.area_id, a.clat AS alat, a.clon AS alon, b.clat AS blat, b.clon AS blon FROM corners a JOIN corners b ON a.area_id = b.area_id AND b.k = (a.k + 1) % 5),
c AS (SELECT *, greatest(0, least(1, ((8.2 - alon) * (blon - alon) + (48.1 - alat) * (blat - alat)) / ((blon - alon) * (blon - alon) + (blat - alat) * (blat - alat)))) AS t FROM e),
p AS (SELECT area_id, alat + t * (blat - alat) AS clat, alon + t * (blon - alon) AS clon FROM c),
held AS (SELECT area_id, sum(CASE WHEN ((alat <= 48.1 AND 48.1 < blat) OR (blat <= 48.1 AND 48.1 < alat)) AND 8.2 < (blon - alon) * (48.1 - alat) / CASE WHEN blat = alat THEN 1 ELSE blat - alat END + alon THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM e GROUP BY area_id)"""


@query(sql("nodes")(f"SELECT obj_id, type, name, round(metres, 3) AS distance FROM ({vincenty('SELECT * FROM nodes', '48.1', '8.2', 'lat', 'lon')}) WHERE metres <= 20000"))
def p4_nodes_in_radius(spark, sf_dir):
    """Nodes at most 20 km away, by distance."""
    found = spatial.nodes_in_radius(view(spark, sf_dir, "nodes"), LAT, LON, 20_000.0)
    return found.select("obj_id", "type", "name", F.round("distance", 3).alias("distance")).orderBy("distance", "obj_id")


@query(sql("nodes")("""SELECT obj_id FROM nodes, (SELECT CAST(3000 AS DOUBLE) / CAST(6371010 AS DOUBLE) AS r) WHERE lat >= 47 AND type = 'depot' AND 2 * CAST(6371010 AS DOUBLE) * asin(sqrt(pow(sin(radians(lat - 48.1) / 2), 2) + cos(radians(48.1)) * cos(radians(lat)) * pow(sin(radians(lon - 8.2) / 2), 2))) <= 60000 * 0.7 AND false"""))
def p4_inscribed_box(spark, sf_dir):
    """The compatible box lies within the circle: nothing of it is outside, so what is found beyond the radius is nothing."""
    n = view(spark, sf_dir, "nodes")
    boxed = spatial.nodes_in_radius(n, LAT, LON, 60_000.0, inscribed=True, ellipsoid=False)
    return boxed.join(spatial.nodes_in_radius(n, LAT, LON, 60_000.0, ellipsoid=False), "obj_id", "left_anti").select("obj_id")


@query(sql("ways", "way_points")(f"""{_SEGMENTS} SELECT way_id, round(min(metres), 3) AS distance FROM ({vincenty('SELECT * FROM p', '48.1', '8.2', 'clat', 'clon')}) GROUP BY way_id HAVING min(metres) <= 2000"""))
def p5_ways_in_radius(spark, sf_dir):
    return spatial.ways_in_radius(way_lines(spark, sf_dir), LAT, LON, 2000.0).select("way_id", F.round("distance", 3).alias("distance"))


@query(sql("areas", "corners")(f"""{_EDGES} SELECT area_id, inside, round(CASE WHEN inside THEN 0 ELSE min(metres) END, 3) AS distance FROM ({vincenty('SELECT * FROM p', '48.1', '8.2', 'clat', 'clon')}) JOIN held USING (area_id) GROUP BY area_id, inside HAVING inside OR min(metres) <= 15000"""))
def p6_areas_in_radius(spark, sf_dir):
    return spatial.areas_in_radius(area_rings(spark, sf_dir), LAT, LON, 15_000.0).select("area_id", "inside", F.round("distance", 3).alias("distance"))


@query(sql("nodes")(f"SELECT obj_id, round(metres, 3) AS distance FROM ({vincenty('SELECT * FROM nodes', '48.25', '8.5', 'lat', 'lon')}) WHERE lat BETWEEN 48 AND 48.5 AND lon BETWEEN 8 AND 9"))
def p7_nodes_in_box(spark, sf_dir):
    return spatial.nodes_in_box(view(spark, sf_dir, "nodes"), 48.0, 8.0, 48.5, 9.0).select("obj_id", F.round("distance", 3).alias("distance"))


@query(sql("ways", "way_points")("""SELECT way_id FROM way_points GROUP BY way_id HAVING min(lat) <= 48.12 AND max(lat) >= 48.08 AND min(lon) <= 8.22 AND max(lon) >= 8.18"""))
def p8_ways_in_box(spark, sf_dir):
    return spatial.lines_in_box(way_lines(spark, sf_dir), 48.08, 8.18, 48.12, 8.22).select("way_id")


@query(sql("areas", "corners")("""SELECT area_id FROM corners GROUP BY area_id HAVING min(clat) <= 48.5 AND max(clat) >= 48 AND min(clon) <= 8.5 AND max(clon) >= 8"""))
def p9_areas_in_box(spark, sf_dir):
    return spatial.lines_in_box(area_rings(spark, sf_dir), 48.0, 8.0, 48.5, 8.5, key="area_id", points="ring", closed=True).select("area_id")


@query(sql("nodes", "ways", "way_points", "areas", "corners")(f""", n AS (SELECT 'node' AS kind, obj_id, metres FROM ({vincenty('SELECT * FROM nodes', '48.1', '8.2', 'lat', 'lon')})),
{_SEGMENTS[2:].replace('e AS', 'we AS').replace('FROM e', 'FROM we').replace('c AS', 'wc AS').replace('FROM c', 'FROM wc').replace('p AS', 'wp AS')},
w AS (SELECT 'way' AS kind, way_id AS obj_id, min(metres) AS metres FROM ({vincenty('SELECT * FROM wp', '48.1', '8.2', 'clat', 'clon')}) GROUP BY way_id){_EDGES},
a AS (SELECT 'area' AS kind, area_id AS obj_id, CASE WHEN inside THEN 0 ELSE min(metres) END AS metres FROM ({vincenty('SELECT * FROM p', '48.1', '8.2', 'clat', 'clon')}) JOIN held USING (area_id) GROUP BY area_id, inside)
SELECT kind, obj_id, round(metres, 3) AS distance FROM (SELECT * FROM n UNION ALL SELECT * FROM w UNION ALL SELECT * FROM a) WHERE metres <= 3000"""))
def p11_points_of_interest(spark, sf_dir):
    found = spatial.points_of_interest(view(spark, sf_dir, "nodes"), way_lines(spark, sf_dir), area_rings(spark, sf_dir), LAT, LON, 3000.0)
    return found.select("kind", "obj_id", F.round("distance", 3).alias("distance"))


@query(sql("nodes")(f"""SELECT db_id, obj_id, round(metres, 3) AS distance FROM (SELECT *, CAST(obj_id % 2 AS INT) AS db_id FROM ({vincenty('SELECT * FROM nodes', '48.1', '8.2', 'lat', 'lon')})) WHERE metres <= 20000 AND type IN ('depot', 'shop_machinery')"""))
def p12_poi_over_databases(spark, sf_dir):
    """Nodes dealt over two databases, searched as one."""
    n = view(spark, sf_dir, "nodes")
    whole = n.where("obj_id % 2 = 0").withColumn("db_id", F.lit(0)).unionByName(n.where("obj_id % 2 = 1").withColumn("db_id", F.lit(1)))
    return spatial.nodes_in_radius(whole, LAT, LON, 20_000.0, ["depot", "shop_machinery"]).select("db_id", "obj_id", F.round("distance", 3).alias("distance"))


_TILE10 = "CAST(floor((lon + 180) / (360 / CAST(1024 AS DOUBLE))) AS BIGINT)", "CAST(floor((lat + 90) / (180 / CAST(1024 AS DOUBLE))) AS BIGINT)"


@query(sql("nodes")(f"""SELECT obj_id FROM nodes WHERE ({_TILE10[0]}, {_TILE10[1]}) IN (SELECT ({_TILE10[0]}, {_TILE10[1]}) FROM nodes WHERE type = 'depot')"""))
def p14_coverage(spark, sf_dir):
    n = view(spark, sf_dir, "nodes")
    return spatial.is_covered(n, spatial.covered_tiles(n.where("type = 'depot'"), 10), 10).select("obj_id")


@query(sql("nodes")("SELECT round(min(lat), 7) AS min_lat, round(min(lon), 7) AS min_lon, round(max(lat), 7) AS max_lat, round(max(lon), 7) AS max_lon FROM nodes"))
def p18_bounding_box(spark, sf_dir):
    from ..operators.importing import bounding_box

    b = bounding_box(view(spark, sf_dir, "nodes"))
    return b.select(*[F.round(c, 7).alias(c) for c in b.columns])


@query(sql("nodes", "regions")("""SELECT obj_id AS key, arg_min(region_id, level * -1000000 + region_id) AS region_id FROM nodes JOIN regions ON lat >= min_lat AND lat < max_lat AND lon >= min_lon AND lon < max_lon GROUP BY obj_id"""))
def j7_smallest_region(spark, sf_dir):
    """The city that each node stands in (regions hold their cities, so the smallest box is the deepest region)."""
    r = view(spark, sf_dir, "regions")
    at = lambda a, b: F.struct(F.col(a).alias("lat"), F.col(b).alias("lon"))
    rings = r.select("region_id", F.array(at("min_lat", "min_lon"), at("min_lat", "max_lon"), at("max_lat", "max_lon"), at("max_lat", "min_lon")).alias("ring"))
    return spatial.smallest_containing(view(spark, sf_dir, "nodes").select(F.col("obj_id").alias("key"), "lat", "lon"), rings)


@query(sql("areas", "regions")("""SELECT area_id, array_to_string(list(region_id ORDER BY level DESC), ',') AS regions FROM areas JOIN regions ON lat >= min_lat AND lat < max_lat AND lon >= min_lon AND lon < max_lon GROUP BY area_id"""))
def j11_regions_of_areas(spark, sf_dir):
    """The regions that each area's centre stands in, smallest first."""
    r = view(spark, sf_dir, "regions")
    at = lambda a, b: F.struct(F.col(a).alias("lat"), F.col(b).alias("lon"))
    rings = r.select("region_id", F.array(at("min_lat", "min_lon"), at("min_lat", "max_lon"), at("max_lat", "max_lon"), at("max_lat", "min_lon")).alias("ring"))
    held = spatial.containing(view(spark, sf_dir, "areas").select(F.col("area_id").alias("key"), "lat", "lon"), rings)
    inner = F.array_sort(F.collect_list(F.struct("size", "region_id")))
    return held.groupBy(F.col("key").alias("area_id")).agg(F.array_join(F.transform(inner, lambda x: x["region_id"].cast("string")), ",").alias("regions"))


@query(sql("regions")("SELECT region_id, parent_id FROM regions WHERE parent_id IS NOT NULL"))
def j8_region_parents(spark, sf_dir):
    """The tree of regions found again from their shapes."""
    r = view(spark, sf_dir, "regions")
    at = lambda a, b: F.struct(F.col(a).alias("lat"), F.col(b).alias("lon"))
    return spatial.region_parents(r.select("region_id", "level", F.array(at("min_lat", "min_lon"), at("min_lat", "max_lon"), at("max_lat", "max_lon"), at("max_lat", "min_lon")).alias("ring")))


@query(sql("nodes")(f"""SELECT a.obj_id AS key, b.obj_id, round({haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) AS distance FROM nodes a JOIN nodes b ON abs(a.lat - b.lat) < 0.02 AND abs(a.lon - b.lon) < 0.03 WHERE a.type = 'depot' AND b.type <> 'depot' AND {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 2000"""))
def j13_near_pairs(spark, sf_dir):
    n = view(spark, sf_dir, "nodes")
    pairs = spatial.near_pairs(n.where("type = 'depot'").select(F.col("obj_id").alias("key"), "lat", "lon"), n.where("type <> 'depot'"), 2000.0)
    return pairs.select("key", "obj_id", F.round("distance", 3).alias("distance"))


@query(sql("nodes", "ways", "way_points")(f"""SELECT obj_id AS key, arg_min(node_id, (d, node_id)) AS node_id, round(min(d), 3) AS distance FROM (SELECT n.obj_id, p.node_id, {haversine('n.lat', 'n.lon', 'p.lat', 'p.lon')} AS d FROM nodes n JOIN (SELECT DISTINCT node_id, lat, lon FROM way_points) p ON abs(n.lat - p.lat) < 0.01 AND abs(n.lon - p.lon) < 0.015) WHERE d <= 1000 GROUP BY obj_id"""))
def j13_nearest_road_node(spark, sf_dir):
    from .sample import way_points

    road = way_points(spark, sf_dir).select(F.col("node_id").alias("obj_id"), "lat", "lon").distinct()
    found = spatial.nearest(view(spark, sf_dir, "nodes").select(F.col("obj_id").alias("key"), "lat", "lon"), road, 1000.0)
    return found.select("key", F.col("obj_id").alias("node_id"), F.round("distance", 3).alias("distance"))


@query(sql("ways", "way_points")("""SELECT a.way_id AS a_id, b.way_id AS b_id, a.node_id FROM way_points a JOIN way_points b USING (node_id) JOIN ways wa ON wa.way_id = a.way_id JOIN ways wb ON wb.way_id = b.way_id
WHERE wa.upright = 1 AND wb.upright = 0 GROUP BY ALL"""))
def j18_path_crossings(spark, sf_dir):
    """Upright ways cross level ones at the grid's nodes."""
    w = way_lines(spark, sf_dir)
    node = F.round((F.col("lat") - 48) * 500).cast("long") * 1000 + F.round((F.col("lon") - 8) * 1000 / 3).cast("long")
    met = spatial.crossing_lines(w.where("upright = 1").select(F.col("way_id").alias("a_id"), "points"), w.where("upright = 0").select(F.col("way_id").alias("b_id"), "points"), node)
    return met.withColumnRenamed("place", "node_id")


@query(sql("areas", "corners")("""SELECT type, count(*) AS n_cells FROM (SELECT DISTINCT type, unnest(generate_series(CAST(floor((x1 + 180) / (360 / CAST(4096 AS DOUBLE))) AS BIGINT), CAST(floor((x2 + 180) / (360 / CAST(4096 AS DOUBLE))) AS BIGINT))) AS x, y FROM (
  SELECT type, x1, x2, unnest(generate_series(CAST(floor((y1 + 90) / (180 / CAST(4096 AS DOUBLE))) AS BIGINT), CAST(floor((y2 + 90) / (180 / CAST(4096 AS DOUBLE))) AS BIGINT))) AS y FROM (
  SELECT area_id, type, min(clat) AS y1, max(clat) AS y2, min(clon) AS x1, max(clon) AS x2 FROM corners JOIN areas USING (area_id) GROUP BY ALL))) GROUP BY type"""))
def i14_grid_index(spark, sf_dir):
    cells = spatial.grid_cells(area_rings(spark, sf_dir), "area_id", "ring", 12)
    return spatial.cell_fill(cells).select("type", "n_cells")


_LEVEL = "CAST(greatest(0, least(20, floor(log2(360 / (2 * half))), floor(log2(180 / (2.5 * half))))) AS INT)"


@query(sql("areas")(f"""SELECT area_id, {_LEVEL} AS level, CAST(floor((lon - half + 180) / (360 / pow(2, {_LEVEL}))) AS BIGINT) AS x, CAST(floor((lat - half + 90) / (180 / pow(2, {_LEVEL}))) AS BIGINT) AS y FROM areas"""))
def i15_quadtree_index(spark, sf_dir):
    a = view(spark, sf_dir, "areas")
    # The exact size rather than a difference of coordinates, so that sizes at a power of two fall to one side in both engines.
    fit = lambda whole, size: F.floor(F.log2(F.lit(whole) / size))
    level = F.greatest(F.lit(0), F.least(F.lit(20), fit(360.0, 2 * F.col("half")), fit(180.0, 2.5 * F.col("half")))).cast("int")
    t = geo.tile(F.col("lat") - F.col("half"), F.col("lon") - F.col("half"), level)
    return a.select("area_id", level.alias("level"), t["x"].alias("x"), t["y"].alias("y"))


@query(sql("areas", "corners")("SELECT area_id FROM corners GROUP BY area_id HAVING min(clat) <= 48.3 AND max(clat) >= 48 AND min(clon) <= 8.4 AND max(clon) >= 8"))
def p3_quadtree_search(spark, sf_dir):
    a = area_rings(spark, sf_dir).withColumn("box", geo.box_of_points(F.col("ring")))
    return spatial.quadtree_search(a.withColumn("cell", spatial.quadtree_cell(F.col("box"))), 48.0, 8.0, 48.3, 8.4).select("area_id")


@query(sql("nodes")(f"SELECT DISTINCT {_TILE10[0]} AS x, {_TILE10[1]} AS y FROM nodes"))
def i16_coverage_index(spark, sf_dir):
    return spatial.covered_tiles(view(spark, sf_dir, "nodes"), 10)


@query(sql("nodes")(f"SELECT obj_id FROM nodes WHERE {_TILE10[0]} BETWEEN 533 AND 535 AND {_TILE10[1]} BETWEEN 784 AND 787"))
def p1_tile_range(spark, sf_dir):
    """A box of tiles as a range on derived columns."""
    t = geo.tile(F.col("lat"), F.col("lon"), 10)
    return view(spark, sf_dir, "nodes").where(t["x"].between(533, 535) & t["y"].between(784, 787)).select("obj_id")


@query(sql("ways", "way_points")("""SELECT DISTINCT way_id FROM (SELECT way_id, min(lat) AS y1, max(lat) AS y2, min(lon) AS x1, max(lon) AS x2 FROM way_points GROUP BY way_id)
WHERE floor((y1 + 90) / (180 / CAST(4096 AS DOUBLE))) <= 3140 AND floor((y2 + 90) / (180 / CAST(4096 AS DOUBLE))) >= 3138 AND floor((x1 + 180) / (360 / CAST(4096 AS DOUBLE))) <= 2141 AND floor((x2 + 180) / (360 / CAST(4096 AS DOUBLE))) >= 2139"""))
def p2_way_index(spark, sf_dir):
    cells = spatial.grid_cells(way_lines(spark, sf_dir), "way_id", "points", 12)
    return cells.where("x between 2139 and 2141 and y between 3138 and 3140").select("way_id").distinct()


@query(sql("nodes")("SELECT obj_id FROM nodes"))
def o1_spatial_sort(spark, sf_dir):
    return spatial.by_place(view(spark, sf_dir, "nodes"), F.col("lat"), F.col("lon")).select("obj_id")


@query(sql("ways", "way_points")("SELECT way_id, CASE WHEN n_points >= 2 THEN n_points - 1 ELSE 0 END AS n_steps, n_points = 1 AS single FROM ways"))
def x14_cells_of_lines(spark, sf_dir):
    """Ways run along grid lines, so a line of n points runs through n cells."""
    w = view(spark, sf_dir, "ways")
    x2, y2 = F.col("x0") + F.when(F.col("upright") == 1, 0).otherwise(F.col("n_points") - 1), F.col("y0") + F.when(F.col("upright") == 1, F.col("n_points") - 1).otherwise(0)
    cells = shapes.cells_of_line(F.col("x0"), F.col("y0"), x2, y2)
    return w.select("way_id", (F.size(cells) - 1).cast("long").alias("n_steps"), (F.size(cells) == 1).alias("single"))


