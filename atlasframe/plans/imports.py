"""Queries of the import: from raw objects to indexed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coasts, importing
from ..registry import query
from ..session import share_package
from .sample import ISLAND_LEVEL, area_rings, island_coasts, sql, table, view, way_lines, way_points


@query("""SELECT p_partkey AS osm_id, count(*) OVER (PARTITION BY k) AS n_same, row_number() OVER (PARTITION BY k ORDER BY p_partkey) AS serial FROM (SELECT p_partkey, p_partkey % 97 AS k FROM part)""")
def i3_serials(spark, sf_dir):
    """Parts at 97 places: coincident ones are numbered."""
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("osm_id"), (48 + (F.col("p_partkey") % 97).cast("double") / 100).alias("lat"), F.lit(8.0).alias("lon"))
    s = importing.serials(c)
    return s.join(s.groupBy("point_id").agg(F.count("*").alias("n_same")), "point_id").select("osm_id", "n_same", F.col("serial").cast("long").alias("serial"))


@query(sql("ways", "way_points")("SELECT way_id, n_points, round(sum(lat * (idx + 1)), 6) AS lat_check, round(sum(lon * (idx + 1)), 6) AS lon_check FROM way_points JOIN ways USING (way_id) GROUP BY way_id, n_points"))
def j1_resolved_refs(spark, sf_dir):
    coords = way_points(spark, sf_dir).select(F.col("node_id").alias("osm_id"), "lat", "lon").distinct()
    r = importing.resolved(way_lines(spark, sf_dir).select("way_id", F.col("ids").alias("refs")), coords)
    weighed = lambda c: F.round(F.aggregate(F.transform("points", lambda p, i: p[c] * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6)
    return r.select("way_id", F.size("points").cast("long").alias("n_points"), weighed("lat").alias("lat_check"), weighed("lon").alias("lon_check"))


@query(sql("ways")("SELECT way_id FROM ways WHERE way_id NOT IN (SELECT way_id FROM ways WHERE way_id % 10 = 3)"))
def j3_blacklist(spark, sf_dir):
    w = view(spark, sf_dir, "ways")
    return importing.unused(w, w.where("way_id % 10 = 3"), "way_id").select("way_id")


@query(sql("areas")("SELECT area_id AS relation_id, 2 AS n_rings, 1 AS outer_depth, 2 AS inner_depth, 10 AS n_ids FROM areas"))
def i5_multipolygons(spark, sf_dir):
    """Each area in two open halves and a hole in one closed piece, stitched and nested again."""
    a = area_rings(spark, sf_dir)
    ids = lambda *k: F.array(*[F.col("area_id") * 10 + x for x in k])
    members = a.select(F.col("area_id").alias("relation_id"), F.explode(F.array(ids(0, 1, 2), ids(0, 4, 3, 2), ids(5, 6, 7, 8, 9, 5))).alias("refs"))
    shrunk = F.transform("ring", lambda p: F.struct((F.col("lat") + (p["lat"] - F.col("lat")) * 0.4).alias("lat"), (F.col("lon") + (p["lon"] - F.col("lon")) * 0.4).alias("lon")))
    coords = a.select("area_id", F.posexplode(F.concat("ring", shrunk)).alias("k", "p")).select((F.col("area_id") * 10 + F.col("k")).alias("osm_id"), "p.lat", "p.lon")
    r = importing.rings_of_relations(members, coords)
    return r.groupBy("relation_id").agg(F.count("*").cast("int").alias("n_rings"), F.min("depth").alias("outer_depth"), F.max("depth").alias("inner_depth"), F.sum(F.size("ids")).cast("int").alias("n_ids"))


@query(sql("nodes", "ways", "areas")("SELECT type, count(*) FILTER (kind = 'node') AS node, count(*) FILTER (kind = 'way') AS way, count(*) FILTER (kind = 'area') AS area FROM (SELECT type, 'node' AS kind FROM nodes UNION ALL SELECT type, 'way' FROM ways UNION ALL SELECT type, 'area' FROM areas) GROUP BY type"))
def a1_distribution(spark, sf_dir):
    k = lambda name, kind: view(spark, sf_dir, name).select("type", F.lit(kind).alias("kind"))
    return importing.distribution(k("nodes", "node").unionByName(k("ways", "way")).unionByName(k("areas", "area")))


@query(sql("ways", "way_points")("SELECT node_id, count(DISTINCT way_id) AS n_ways FROM way_points GROUP BY node_id"))
def a4_use_counts(spark, sf_dir):
    return importing.use_counts(way_points(spark, sf_dir))


@query(sql("ways", "way_points")("SELECT node_id FROM way_points GROUP BY node_id HAVING count(*) >= 2 UNION SELECT node_id FROM way_points JOIN ways USING (way_id) WHERE idx = 0 OR idx = n_points - 1"))
def i10_relevant_nodes(spark, sf_dir):
    return importing.relevant_nodes(way_points(spark, sf_dir))


@query("SELECT CAST(k AS BIGINT) * 2 AS way_id, CAST(least(n, 3) AS BIGINT) AS n_merged, CAST(4 * least(n, 3) - least(n, 3) + 1 AS BIGINT) AS n_ids FROM (SELECT n_nationkey AS k, 1 + n_nationkey % 3 AS n FROM nation)")
def i9_merged_ways(spark, sf_dir):
    """Streets of one, two or three pieces a nation that follow each other; a side street meets each and joins nothing."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    pieces = n.select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") % 3)).alias("i"))
    ids = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")), lambda j: F.col("k") * 1000 + F.col("i") * 3 + j)
    ways = pieces.select(F.when(F.col("i") == 0, F.col("k") * 2).otherwise(1_000_000 + F.col("k") * 10 + F.col("i")).alias("way_id"), F.lit("residential").alias("type"), F.concat(F.lit("S"), F.col("k").cast("string")).alias("name"), ids.alias("ids"))
    return importing.merged_ways(ways).select("way_id", "n_merged", F.size("ids").cast("long").alias("n_ids"))


@query(sql("ways")("SELECT way_id, n_points FROM ways"))
def i12_reduced_lines(spark, sf_dir):
    """Every vertex twice: the repetitions go."""
    w = way_lines(spark, sf_dir).withColumn("points", F.flatten(F.transform("points", lambda p: F.array(p, p))))
    return w.select("way_id", F.size(importing.reduced_line(F.col("points"))).cast("long").alias("n_points"))


@query(sql("ways")("SELECT way_id, zoom, 2 AS n_kept FROM ways, (SELECT unnest([8, 10, 12]) AS zoom) WHERE (n_points - 1) * CASE WHEN upright = 1 THEN CAST(2 AS DOUBLE) ELSE CAST(3 AS DOUBLE) END / 1000 > 360 / CAST(256 * pow(2, zoom) AS DOUBLE)"))
def i18_low_zoom(spark, sf_dir):
    """Straight ways keep their ends at each zoom where they are larger than a pixel."""
    low = importing.low_zoom(way_lines(spark, sf_dir), "way_id", "points", [8, 10, 12])
    return low.select("way_id", "zoom", F.size("points").alias("n_kept"))


@query("SELECT CAST(k AS BIGINT) AS route_id, CAST(0 AS INT) AS segment, CAST(p AS INT) AS pos, CAST(k * 100 + CASE p WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS BIGINT) AS way_id, p <> 1 AS forward FROM (SELECT n_nationkey AS k, unnest([0, 1, 2]) AS p FROM nation)")
def i23_route_chains(spark, sf_dir):
    """Three ways a nation that form one line, the middle one drawn backwards."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    way = lambda i, a, b: F.struct((F.col("k") * 100 + i).alias("way_id"), (F.col("k") * 10 + a).alias("first"), (F.col("k") * 10 + b).alias("last"))
    ways = n.select("k", F.explode(F.array(way(0, 3, 2), way(1, 3, 4), way(2, 1, 2))).alias("w")).select(F.col("k").alias("route_id"), "w.*")
    # Both ends of the line have one way only; the smaller way id at an end begins: turn the line so that this is way 2.
    flipped = ways.withColumn("first", F.when(F.col("way_id") % 100 == 1, F.col("first")).otherwise(F.col("first")))
    chained = importing.route_chains(flipped.select("route_id", "way_id"), flipped)
    turned = chained.groupBy("route_id", "segment").agg(F.max("pos").alias("most"))
    whole = chained.join(turned, ["route_id", "segment"])
    # The chain begins at way 1's open end (the smaller id); told from the other end it runs 2, 0, 1.
    return whole.select("route_id", "segment", (F.col("most") - F.col("pos")).alias("pos"), "way_id", (~F.col("forward")).alias("forward"))


@query("""SELECT o_custkey % 20 AS master_id, o_custkey AS route_id, kind, row_number() OVER (PARTITION BY o_custkey, kind ORDER BY idx) AS pos, obj_id, name FROM (
  SELECT o_custkey, o_orderkey AS idx, o_orderkey % 50 AS obj_id, CASE WHEN o_orderkey % 3 = 0 THEN 'stop' WHEN o_orderkey % 3 = 1 THEN 'platform' END AS kind FROM orders WHERE o_custkey % 20 <> 7) JOIN (SELECT p_partkey, p_name AS name FROM part) ON p_partkey = obj_id WHERE kind IS NOT NULL""")
def i22_transport_routes(spark, sf_dir):
    """Customers as bus lines, their orders as stops and platforms; lines without a master are left out."""
    o = table(spark, sf_dir, "orders")
    role = F.when(F.col("o_orderkey") % 3 == 0, "stop_exit_only").when(F.col("o_orderkey") % 3 == 1, "platform").otherwise("forward")
    members = o.select(F.col("o_custkey").alias("route_id"), F.col("o_orderkey").alias("idx"), (F.col("o_orderkey") % 50).alias("obj_id"), role.alias("role"))
    variants = o.select(F.col("o_custkey").alias("route_id")).distinct()
    masters = variants.where("route_id % 20 <> 7").select((F.col("route_id") % 20).alias("master_id"), "route_id")
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("obj_id"), F.col("p_name").alias("name"))
    return importing.transport_routes(masters, variants, members, nodes).withColumn("pos", F.col("pos").cast("long"))


def _island_cells(spark, sf_dir):
    """(x, y, state): coast cells by the islands' polygons, and unknown ones around and inside them, seven by seven for each island."""
    lines = island_coasts(spark, sf_dir)
    coast = coasts.ground_polygons(lines, ISLAND_LEVEL).select("x", "y").distinct()
    places = F.transform(F.sequence(F.lit(0), F.lit(48)), lambda k: F.struct((F.col("x") + k % 7).alias("x"), (F.col("y") + F.floor(k / 7)).alias("y")))
    block = lines.select(F.explode(places).alias("c")).select("c.x", "c.y")
    return lines, block, coast.withColumn("state", F.lit("coast"))


@query(sql("islands", "island_cells")("SELECT x, y, round(land / 1000000, 6) AS land, round(1 - land / 1000000, 6) AS water FROM island_cells WHERE touched AND NOT inner_cell"))
def i17_coast_polygons(spark, sf_dir):
    """Parts as islands: the share of land and water of each cell that their coasts run through, from the polygons' areas."""
    sizes = coasts.ground_sizes(coasts.ground_polygons(island_coasts(spark, sf_dir), ISLAND_LEVEL), ISLAND_LEVEL)
    return sizes.select("x", "y", F.round("land", 6).alias("land"), F.round("water", 6).alias("water"))


@query(sql("islands", "island_cells")("SELECT x, y, CASE WHEN inner_cell THEN 'unknown' WHEN touched THEN 'coast' ELSE 'water' END AS state FROM island_cells"))
def i17_filled_water(spark, sf_dir):
    """Water spreads from one cell beside each island over all cells around it; what the coast cells close in stays unknown."""
    lines, block, coast = _island_cells(spark, sf_dir)
    seed = lines.select((F.col("x") + 6).alias("x"), (F.col("y") + 6).alias("y"), F.lit("water").alias("state"))
    return importing.filled_water(coast.unionByName(seed), block)


@query(sql("islands", "island_cells")("SELECT x, y, CASE WHEN inner_cell THEN 'land' WHEN touched THEN 'coast' ELSE 'unknown' END AS state FROM island_cells"))
def i17_filled_land(spark, sf_dir):
    """Land spreads from one inner cell of each island between its coasts, in rows and columns."""
    lines, block, coast = _island_cells(spark, sf_dir)
    inner = lines.where("floor(u1 / 1000) > floor(u0 / 1000) + 1 and floor(v1 / 1000) > floor(v0 / 1000) + 1")
    seed = inner.select((F.col("x") + F.floor(F.col("u0") / 1000) + 1).alias("x"), (F.col("y") + F.floor(F.col("v0") / 1000) + 1).alias("y"), F.lit("land").alias("state"))
    known = coast.unionByName(seed)
    return importing.filled_land(block.join(known, ["x", "y"], "left").select("x", "y", F.coalesce("state", F.lit("unknown")).alias("state")))


@query(sql("ways", "way_points")("""SELECT DISTINCT CAST(floor((lon + 180) / (360 / CAST(32768 AS DOUBLE))) AS BIGINT) AS x, CAST(floor((lat + 90) / (180 / CAST(32768 AS DOUBLE))) AS BIGINT) AS y, 'coast' AS state FROM way_points"""))
def i17_coast_cells(spark, sf_dir):
    """Ways as coastlines, in cells larger than their edges: the cells of their vertices."""
    return importing.coast_cells(way_lines(spark, sf_dir), 15)


@query(sql("areas")("SELECT area_id, true AS inside, round(lat, 6) AS lat FROM areas"))
def a18_area_centre(spark, sf_dir):
    """A pentagon's centroid is inside it."""
    from ..functions import shapes

    share_package(spark)
    a = area_rings(spark, sf_dir).withColumn("c", shapes.centroid(F.col("ring")))
    return a.select("area_id", shapes.in_ring(F.col("c.lat"), F.col("c.lon"), F.col("ring")).alias("inside"), F.round(F.col("c.lat") - F.col("half") * 0.3, 6).alias("lat"))


@query("""WITH RECURSIVE f AS (SELECT p_partkey AS id, p_size % 2 AS type, p_partkey // 64 AS y, p_partkey % 64 AS x FROM part),
l AS MATERIALIZED (SELECT p.id AS a, q.id AS b FROM f p JOIN f q ON p.type = q.type AND abs(p.x - q.x) + abs(p.y - q.y) = 1),
c AS (SELECT id, id AS other FROM f UNION SELECT c.id, l.b FROM c JOIN l ON l.a = c.other),
m AS (SELECT id, min(other) AS area_id FROM c GROUP BY id),
e AS (SELECT area_id, count(*) AS n_areas, 4 * count(*) - sum((SELECT count(*) FROM l WHERE a = m.id)) AS n_edges FROM m GROUP BY area_id)
SELECT area_id, n_areas, CAST(n_edges AS BIGINT) AS n_edges, CAST(2 * n_areas AS BIGINT) AS twice_size FROM e""")
def i8_merged_areas(spark, sf_dir):
    """Parts as fields of a board, 64 in a row; fields of one kind that lie side by side merge. The size comes from the rings, so it tells whether they close and holes turn the other way."""
    f = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 2).alias("type"), F.floor(F.col("p_partkey") / 64).alias("y"), (F.col("p_partkey") % 64).alias("x"))
    node = lambda dx, dy: (F.col("y") + dy) * 1000 + F.col("x") + dx
    merged = importing.merged_areas(f.select(F.col("p_partkey").alias("area_id"), "type", F.array(node(0, 0), node(1, 0), node(1, 1), node(0, 1)).alias("ids")))
    x, y = lambda i: i % 1000, lambda i: F.floor(i / 1000)
    after = F.concat(F.slice("ids", 2, F.size("ids") - 1), F.slice("ids", 1, 1))
    twice = F.aggregate(F.zip_with("ids", after, lambda a, b: x(a) * y(b) - x(b) * y(a)), F.lit(0).cast("long"), lambda acc, v: acc + v)
    rings = merged.select("area_id", "n_areas", F.size("ids").cast("long").alias("n"), twice.alias("twice"))
    return rings.groupBy("area_id", "n_areas").agg(F.sum("n").alias("n_edges"), F.sum("twice").alias("twice_size"))
