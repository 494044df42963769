"""Queries of the road graph: junctions, edges, costs, paths and what is told along them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geo import spherical_distance
from ..operators import descriptions, routing
from ..registry import query
from .sample import haversine, sql, table, view, way_points

_EDGES = f""", junction AS (SELECT node_id FROM way_points GROUP BY node_id HAVING count(DISTINCT way_id) >= 2),
m AS (SELECT *, sum(coalesce({haversine('plat', 'plon', 'lat', 'lon')}, 0)) OVER (PARTITION BY way_id ORDER BY idx) AS far FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM way_points WINDOW w AS (PARTITION BY way_id ORDER BY idx))),
k AS (SELECT m.* FROM m JOIN ways USING (way_id) WHERE idx = 0 OR idx = n_points - 1 OR node_id IN (SELECT node_id FROM junction)),
s AS (SELECT way_id, node_id AS a, lead(node_id) OVER w AS b, lead(far) OVER w - far AS metres FROM k WINDOW w AS (PARTITION BY way_id ORDER BY idx)),
edges AS (SELECT a AS from_id, b AS to_id, way_id, metres, type, maxspeed, grade FROM s JOIN ways USING (way_id) WHERE b IS NOT NULL UNION ALL SELECT b, a, way_id, metres, type, maxspeed, grade FROM s JOIN ways USING (way_id) WHERE b IS NOT NULL AND NOT oneway)"""
_SPEED = "CASE type WHEN 'motorway' THEN 110 WHEN 'primary' THEN 70 WHEN 'secondary' THEN 60 WHEN 'residential' THEN 40 ELSE 0 END"
_CAR = f"least(CAST({_SPEED} AS DOUBLE), CASE WHEN maxspeed > 0 THEN CAST(maxspeed AS DOUBLE) ELSE CAST({_SPEED} AS DOUBLE) END)"
SOURCES = (20, 60)


def _graph(spark, sf_dir):
    return routing.edges(way_points(spark, sf_dir), view(spark, sf_dir, "ways"))


@query(sql("ways", "way_points")("SELECT node_id, count(DISTINCT way_id) AS n_ways FROM way_points GROUP BY node_id HAVING count(DISTINCT way_id) >= 2"))
def g1_junctions(spark, sf_dir):
    return routing.junctions(way_points(spark, sf_dir))


@query(sql("ways", "way_points")("SELECT node_id, array_to_string(list_sort(list(DISTINCT way_id)), ',') AS ways FROM way_points GROUP BY node_id HAVING count(DISTINCT way_id) >= 2"))
def g2_junction_objects(spark, sf_dir):
    return routing.junction_objects(way_points(spark, sf_dir)).select("node_id", F.array_join("way_ids", ",").alias("ways"))


@query(sql("ways", "way_points")(f"{_EDGES} SELECT from_id, to_id, way_id, round(metres, 3) AS metres FROM edges"))
def g3_edges(spark, sf_dir):
    return _graph(spark, sf_dir).select("from_id", "to_id", "way_id", F.round("metres", 3).alias("metres"))


@query(sql("ways", "way_points")(f"""{_EDGES}, r AS (SELECT node_id AS via_id, min(way_id) AS from_way, max(way_id) AS to_way, CASE WHEN node_id % 2 = 0 THEN 'allow' ELSE 'forbid' END AS kind FROM way_points GROUP BY node_id HAVING count(DISTINCT way_id) >= 2)
SELECT via_id, from_way, to_way FROM r WHERE kind = 'forbid' UNION SELECT DISTINCT r.via_id, r.from_way, e.way_id FROM r JOIN edges e ON e.from_id = r.via_id WHERE kind = 'allow' AND e.way_id <> r.to_way AND e.way_id <> r.from_way"""))
def g5_excluded_turns(spark, sf_dir):
    r = way_points(spark, sf_dir).groupBy(F.col("node_id").alias("via_id")).agg(F.min("way_id").alias("from_way"), F.max("way_id").alias("to_way"), F.countDistinct("way_id").alias("n")).where("n >= 2")
    return routing.excluded_turns(r.select("via_id", "from_way", "to_way", F.when(F.col("via_id") % 2 == 0, "allow").otherwise("forbid").alias("kind")), _graph(spark, sf_dir))


@query(sql("ways", "way_points")(f"{_EDGES} SELECT from_id, to_id, way_id, round(metres / 1000, 6) AS km, round(metres / 1000 / least(160, {_CAR}), 9) AS hours FROM edges WHERE {_CAR} > 0"))
def g7_g8_costs(spark, sf_dir):
    g = routing.usable(_graph(spark, sf_dir), "car")
    return g.select("from_id", "to_id", "way_id", F.round(routing.shortest_cost(), 6).alias("km"), F.round(routing.fastest_cost("car"), 9).alias("hours"))


@query(sql("ways")("""SELECT way_id, least(s, coalesce(maxspeed, s))::DOUBLE AS car, (CASE WHEN type = 'motorway' THEN 0 ELSE least(5, coalesce(maxspeed, 5)) END)::DOUBLE AS foot FROM (SELECT *, CASE type WHEN 'motorway' THEN 110 WHEN 'primary' THEN 70 WHEN 'secondary' THEN 60 WHEN 'residential' THEN 40 ELSE 0 END AS s FROM ways)"""))
def g9_profiles(spark, sf_dir):
    """The speed of each way for two profiles."""
    w = view(spark, sf_dir, "ways")
    return w.select("way_id", routing.speed("car", F.col("type"), F.col("maxspeed")).alias("car"), routing.speed("foot", F.col("type"), F.col("maxspeed")).alias("foot"))


def _relaxed(rounds: int, limit: float) -> str:
    """SQL: rounds of relaxation in nested views."""
    parts = ["c0 AS (SELECT node_id AS source, node_id, CAST(0 AS DOUBLE) AS cost FROM (SELECT unnest([" + ", ".join(f"{y} * 1000 + {x}" for y in SOURCES for x in SOURCES) + "]) AS node_id))"]
    for k in range(rounds):
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT source, node_id, min(cost) AS cost FROM (SELECT * FROM c{k} UNION ALL SELECT source, to_id, c.cost + e.cost FROM c{k} c JOIN w e ON e.from_id = c.node_id WHERE c.cost + e.cost <= {limit}) GROUP BY source, node_id)")
    return ", w AS MATERIALIZED (SELECT from_id, to_id, min(metres / 1000) AS cost FROM edges GROUP BY from_id, to_id), " + ", ".join(parts) + f" SELECT source, node_id, round(cost, 6) AS km FROM c{rounds}"


@query(sql("ways", "way_points")(f"{_EDGES}{_relaxed(9, 1.8)}"))
def g10_path_costs(spark, sf_dir):
    """Kilometres from four crossings to all nodes within 1.8 km along ways."""
    g = _graph(spark, sf_dir).withColumn("cost", routing.shortest_cost())
    sources = spark.createDataFrame([(y * 1000 + x,) * 2 for y in SOURCES for x in SOURCES], "source long, node_id long")
    return routing.costs_from(sources, g, limit=1.8).select("source", "node_id", F.round("cost", 6).alias("km"))


#: Steps north and east from a search's source to its targets.
_TARGETS = ((1, 2), (2, -3), (-2, 4), (5, 1), (-3, -3))


@query(sql("ways", "way_points")(f"{_EDGES}{_relaxed(9, 1.8)} WHERE node_id - source IN ({', '.join(str(y * 1000 + x) for y, x in _TARGETS)})"))
def g10_goal_directed(spark, sf_dir):
    """Kilometres from four crossings to some targets each, by searches that landmarks around them guide; of costs up to 1.8 km."""
    g = _graph(spark, sf_dir).withColumn("cost", routing.shortest_cost())
    rim = [y * 1000 + x for y in (min(SOURCES) - 6, max(SOURCES) + 6) for x in (min(SOURCES) - 6, max(SOURCES) + 6)]
    known = routing.landmark_costs(spark.createDataFrame([(n,) for n in rim], "node_id long"), g, limit=4.0)
    nodes = view(spark, sf_dir, "way_points").select(F.col("node_id").alias("target")).distinct()
    pairs = spark.createDataFrame([(y * 1000 + x, (y + dy) * 1000 + x + dx) for y in SOURCES for x in SOURCES for dy, dx in _TARGETS], "source long, target long").join(nodes, "target")
    found = routing.search_to(pairs, g, known).where("node_id = target and cost <= 1.8")
    return found.select("source", "node_id", F.round("cost", 6).alias("km"))


_RESTRICTED, _BEGIN, _LIMIT_HOURS = "way_id % 11 = 0", "way_id % 500 = 0", 0.02
#: Edges as states of a search by car: their hours, restrictions of turns as in g5, turns with what a change of ways costs.
_TURNS = f"""{_EDGES}, drive AS MATERIALIZED (SELECT from_id, to_id, way_id, any_value(type) AS type, any_value({_CAR}) AS speed, min(metres) / 1000 / least(160, any_value({_CAR})) AS hours, {_RESTRICTED} AS shut FROM edges WHERE {_CAR} > 0 GROUP BY from_id, to_id, way_id),
r AS (SELECT node_id AS via_id, min(way_id) AS from_way, max(way_id) AS to_way, CASE WHEN node_id % 2 = 0 THEN 'allow' ELSE 'forbid' END AS kind FROM way_points GROUP BY node_id HAVING count(DISTINCT way_id) >= 2),
barred AS MATERIALIZED (SELECT via_id, from_way, to_way FROM r WHERE kind = 'forbid' UNION SELECT DISTINCT r.via_id, r.from_way, e.way_id FROM r JOIN drive e ON e.from_id = r.via_id WHERE kind = 'allow' AND e.way_id <> r.to_way AND e.way_id <> r.from_way),
turn AS MATERIALIZED (SELECT a.from_id AS a0, a.to_id AS via, a.way_id AS way_a, a.shut AS shut_a, b.to_id AS b1, b.way_id AS way_b, b.shut AS shut_b, b.hours AS own,
  b.hours + CASE WHEN a.way_id = b.way_id THEN 0 ELSE least(CASE WHEN a.type <> b.type THEN 250 ELSE 40 END / 1000 / least(a.speed, b.speed), CAST(10 AS DOUBLE) / 3600) END AS cost
  FROM drive a JOIN drive b ON a.to_id = b.from_id WHERE a.from_id <> b.to_id AND NOT EXISTS (SELECT 1 FROM barred x WHERE x.via_id = a.to_id AND x.from_way = a.way_id AND x.to_way = b.way_id)),
starts AS (SELECT way_id AS source, from_id, to_id, way_id, CAST(0.25 AS DOUBLE) AS share, hours, shut FROM drive WHERE {_BEGIN}),
t0 AS (SELECT source, from_id, to_id, way_id, shut AS leaving, (1 - share) * hours AS cost FROM starts)"""


def _turned(rounds: int) -> str:
    """SQL: rounds of relaxation over turns in nested views; the last is named costs."""
    parts = []
    for k in range(rounds):
        parts.append(f"""t{k + 1} AS MATERIALIZED (SELECT source, from_id, to_id, way_id, leaving, min(cost) AS cost FROM (SELECT * FROM t{k} UNION ALL
  SELECT source, via, b1, way_b, leaving AND shut_b, t.cost + turn.cost FROM t{k} t JOIN turn ON a0 = from_id AND via = to_id AND way_a = way_id WHERE (leaving OR shut_b OR NOT shut_a) AND t.cost + turn.cost <= {_LIMIT_HOURS}) GROUP BY ALL)""")
    return ", " + ", ".join(parts) + f", costs AS (SELECT * FROM t{rounds})"


def _drive(spark, sf_dir):
    """Edges for a car with ids, hours and restricted ones; turns that may be taken; places a quarter along each edge of some ways, where searches begin."""
    g = routing.usable(_graph(spark, sf_dir), "car").groupBy("from_id", "to_id", "way_id").agg(F.min("metres").alias("metres"), F.first("type").alias("type"), F.first("maxspeed").alias("maxspeed"))
    g = g.withColumns({"cost": routing.fastest_cost("car"), "restricted": F.expr(_RESTRICTED), "edge_id": F.concat_ws(":", "way_id", "from_id", "to_id")})
    steps = routing.turn_graph(g, "car", g5_excluded_turns(spark, sf_dir))
    starts = g.where(_BEGIN).select(F.col("way_id").alias("source"), "edge_id", F.lit(0.25).alias("share"), F.lit(False).alias("turned"))
    return g, steps, starts


@query(sql("ways", "way_points")(f"{_TURNS}{_turned(12)} SELECT source, to_id AS node_id, round(min(cost), 9) AS hours FROM costs GROUP BY source, to_id"))
def g10_turn_costs(spark, sf_dir):
    """Hours by car to all nodes within 0.02 hours, with turn restrictions, changes of ways and restricted ways, for each of some ways from places on it."""
    g, steps, starts = _drive(spark, sf_dir)
    costs = routing.costs_from(routing.start_states(starts, g, "car"), steps, limit=_LIMIT_HOURS)
    return routing.node_costs(costs, g).select("source", "node_id", F.round("cost", 9).alias("hours"))


@query(sql("ways", "way_points")(f"""{_TURNS}{_turned(12)}, places AS (SELECT from_id * 1000000 + to_id AS target, * FROM drive WHERE way_id % 2 = 1)
SELECT source, target, round(min(cost), 9) AS hours FROM (
  SELECT source, target, c.cost + turn.cost - 0.5 * own AS cost FROM costs c JOIN turn ON a0 = c.from_id AND via = c.to_id AND way_a = c.way_id JOIN places p ON p.from_id = via AND p.to_id = b1 AND p.way_id = way_b WHERE leaving OR shut_b OR NOT shut_a
  UNION ALL SELECT source, target, (0.5 - share) * p.hours FROM starts s JOIN places p USING (from_id, to_id, way_id) WHERE share <= 0.5) GROUP BY source, target"""))
def g12_place_costs(spark, sf_dir):
    """The same searches, to the middles of edges."""
    g, steps, starts = _drive(spark, sf_dir)
    costs = routing.costs_from(routing.start_states(starts, g, "car"), steps, limit=_LIMIT_HOURS)
    places = g.where("way_id % 2 = 1").select((F.col("from_id") * 1000000 + F.col("to_id")).alias("target"), "edge_id", F.lit(0.5).alias("share"))
    return routing.costs_to_places(places, starts, costs, g, steps).select("source", "target", F.round("cost", 9).alias("hours"))


@query()
def g14_paths(spark, sf_dir):
    """The nodes of the cheapest paths to the farthest node of each search. No SQL: of several cheapest paths one is taken."""
    g = _graph(spark, sf_dir).withColumn("cost", routing.shortest_cost())
    sources = spark.createDataFrame([(y * 1000 + x,) * 2 for y in SOURCES for x in SOURCES], "source long, node_id long")
    costs = routing.costs_from(sources, g, limit=1.2)
    far = costs.groupBy("source").agg(F.max(F.struct("cost", "node_id")).alias("b")).select("source", F.col("b.node_id").alias("target"))
    return routing.paths_to(far, costs)


@query(sql("nodes")("""SELECT obj_id AS node_id, 0 AS db_a, 1 AS db_b FROM nodes WHERE obj_id % 3 = 0"""))
def j17_node_twins(spark, sf_dir):
    """Two databases that share every third node."""
    n = view(spark, sf_dir, "nodes").select(F.col("obj_id").alias("node_id"))
    return routing.node_twins(n.withColumn("db_id", F.lit(0)).unionByName(n.where("node_id % 3 = 0").withColumn("db_id", F.lit(1))))


# ---- routes told: each order's way, left and right turns made from its line numbers

_ROUTE = """, r AS (SELECT l_orderkey AS route, idx, lat, lon, name, maxspeed, type FROM (
  SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INT) - 1 AS idx, 48 + CAST(l_partkey % 200 AS DOUBLE) / 1000 AS lat, 8 + CAST(l_suppkey % 100 AS DOUBLE) / 1000 AS lon,
    'Street ' || l_returnflag AS name, 30 + CAST(l_quantity AS INT) % 3 * 20 AS maxspeed, CASE WHEN l_linestatus = 'O' THEN 'motorway' ELSE 'primary' END AS type FROM lineitem))"""


def _route(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem").withColumn("idx", F.row_number().over(w) - 1)
    return items.select(
        F.col("l_orderkey").alias("route"), "idx", F.col("l_partkey").alias("node_id"), (48 + (F.col("l_partkey") % 200).cast("double") / 1000).alias("lat"), (8 + (F.col("l_suppkey") % 100).cast("double") / 1000).alias("lon"),
        F.col("l_orderkey").alias("way_id"), F.concat(F.lit("Street "), F.col("l_returnflag")).alias("name"), F.col("l_returnflag").alias("ref"), F.when(F.col("l_linestatus") == "O", "motorway").otherwise("primary").alias("type"),
        (30 + F.col("l_quantity").cast("int") % 3 * 20).alias("maxspeed"),
    )


@query(sql("nodes")(f"""{_ROUTE}, s AS (SELECT *, coalesce({haversine('plat', 'plon', 'lat', 'lon')}, 0) AS step FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(maxspeed) OVER w AS pspeed FROM r WINDOW w AS (PARTITION BY route ORDER BY idx)))
SELECT route, idx, round(sum(step) OVER w, 3) AS distance, round(sum(coalesce(step / (CAST(pspeed AS DOUBLE) / 3.6), 0)) OVER w, 3) AS time FROM s WINDOW w AS (PARTITION BY route ORDER BY idx)"""))
def r2_distance_and_time(spark, sf_dir):
    r = descriptions.distance_and_time(_route(spark, sf_dir), F.col("maxspeed").cast("double"))
    return r.select("route", "idx", F.round("distance", 3).alias("distance"), F.round("time", 3).alias("time"))


@query(sql("nodes")(f"""{_ROUTE} SELECT route, idx, CASE WHEN p IS NOT NULL AND name <> pname THEN name END AS changed_name, CASE WHEN p IS NOT NULL AND type <> ptype THEN type END AS changed_type, CASE WHEN p IS NOT NULL AND maxspeed <> pspeed THEN maxspeed END AS changed_maxspeed
FROM (SELECT *, lag(idx) OVER w AS p, lag(name) OVER w AS pname, lag(type) OVER w AS ptype, lag(maxspeed) OVER w AS pspeed FROM r WINDOW w AS (PARTITION BY route ORDER BY idx))"""))
def r3_way_changes(spark, sf_dir):
    return descriptions.way_changes(_route(spark, sf_dir)).select("route", "idx", "changed_name", "changed_type", "changed_maxspeed")


def _sql_bearing(a: str, b: str, c: str, d: str) -> str:
    x = f"degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))))"
    return f"(({x}) - 360 * floor(({x}) / 360))"


_IN = f"({_sql_bearing('lat', 'lon', 'plat', 'plon')} + 180 - 360 * floor(({_sql_bearing('lat', 'lon', 'plat', 'plon')} + 180) / 360))"


@query(sql("nodes")(f"""{_ROUTE}, t AS (SELECT route, idx, lat, lon, plat, plon, nlat, nlon, {_sql_bearing('lat', 'lon', 'nlat', 'nlon')} - {_IN} AS raw FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon FROM r WINDOW w AS (PARTITION BY route ORDER BY idx))),
u AS (SELECT route, idx, raw - 360 * floor(raw / 360) AS a FROM t)
SELECT route, idx, round(CASE WHEN a > 180 THEN a - 360 ELSE a END, 4) AS turn_angle FROM u"""))
def r5_directions(spark, sf_dir):
    return descriptions.directions(_route(spark, sf_dir)).select("route", "idx", F.round("turn_angle", 4).alias("turn_angle"))


@query(sql("nodes")(f"""{_ROUTE} SELECT route, idx, CASE WHEN type = 'motorway' AND coalesce(ptype, '') <> 'motorway' THEN 'enter' WHEN type <> 'motorway' AND ptype = 'motorway' THEN 'leave' WHEN type = 'motorway' AND ptype = 'motorway' AND name <> pname THEN 'change' END AS motorway
FROM (SELECT *, lag(name) OVER w AS pname, lag(type) OVER w AS ptype FROM r WINDOW w AS (PARTITION BY route ORDER BY idx))"""))
def r6_motorways(spark, sf_dir):
    return descriptions.motorways(_route(spark, sf_dir)).select("route", "idx", "motorway")


@query(sql("nodes")(f"""{_ROUTE} SELECT route, idx, sum(CASE WHEN idx > 0 AND idx % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY route ORDER BY idx) AS section FROM r"""))
def r10_sections(spark, sf_dir):
    s = descriptions.sections(_route(spark, sf_dir), (F.col("idx") > 0) & (F.col("idx") % 3 == 0))
    return s.select("route", "idx", "section")


@query(sql("nodes")(f"""{_ROUTE} SELECT route, idx, idx = 0 AS is_start, idx = max(idx) OVER (PARTITION BY route) AS is_target FROM r"""))
def r1_start_and_target(spark, sf_dir):
    return descriptions.start_and_target(_route(spark, sf_dir)).select("route", "idx", "is_start", "is_target")


@query()
def r7_instructions(spark, sf_dir):
    """Everything chained. No SQL: curves fold over following nodes."""
    r = _route(spark, sf_dir).withColumns({"n_exits": F.lit(3), "in_roundabout": F.col("idx") % 5 == 3})
    told = r.transform(descriptions.start_and_target).transform(descriptions.way_changes).transform(descriptions.directions).transform(descriptions.motorways).transform(descriptions.roundabouts).transform(descriptions.instructions)
    return told.select("route", "idx", "turn", "instruction")


@query(sql("nodes")(_ROUTE + " SELECT route, CAST(to_json(list({'idx': idx, 'lat': lat, 'lon': lon, 'name': name} ORDER BY idx)) AS VARCHAR) AS json FROM r GROUP BY route"))
def k6_route_json(spark, sf_dir):
    return descriptions.as_json(_route(spark, sf_dir).select("route", "idx", "lat", "lon", "name"))


@query(sql("nodes")("""SELECT obj_id, round((10 + 5 * lat) * 0.01, 9) AS at_most FROM nodes"""))
def g11_cost_limits(spark, sf_dir):
    """Latitudes as kilometres of the straight line."""
    return view(spark, sf_dir, "nodes").select("obj_id", F.round(routing.cost_limit(F.col("lat"), 0.01), 9).alias("at_most"))


_STEPS = ", s AS (SELECT *, lag(node_id) OVER (PARTITION BY route ORDER BY idx) AS came, lead(node_id) OVER (PARTITION BY route ORDER BY idx) AS goes FROM (SELECT r.*, l_partkey AS node_id FROM r JOIN (SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INT) - 1 AS k FROM lineitem) ON l_orderkey = route AND k = idx))"


@query(sql("nodes")(_ROUTE + _STEPS + ", g AS (SELECT DISTINCT node_id AS a, goes AS b FROM s WHERE goes IS NOT NULL) SELECT route, idx, count(b) FILTER (b IS DISTINCT FROM came) AS n_exits FROM s LEFT JOIN g ON a = node_id GROUP BY route, idx"))
def r4_exits(spark, sf_dir):
    """Parts that follow each other in some order as the graph."""
    r = _route(spark, sf_dir)
    w = Window.partitionBy("route").orderBy("idx")
    graph = r.select(F.col("node_id").alias("from_id"), F.lead("node_id").over(w).alias("to_id")).where("to_id is not null")
    return descriptions.exits(r, graph).select("route", "idx", "n_exits")


@query(sql("nodes")(_ROUTE + _STEPS + ", w AS (SELECT l_partkey AS node_id, list_sort(list(DISTINCT l_orderkey)) AS ways FROM lineitem GROUP BY 1) SELECT route, idx, len(list_filter(ways, lambda x: x <> route)) AS n_crossing, coalesce(list_sum(list_filter(ways, lambda x: x <> route)), 0)::BIGINT AS crossing FROM s JOIN w USING (node_id)"))
def r4_crossing_ways(spark, sf_dir):
    """Orders that share a part cross there."""
    ways = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("node_id")).agg(F.array_sort(F.collect_set("l_orderkey")).alias("way_ids"))
    x = descriptions.crossing_ways(_route(spark, sf_dir), ways)
    return x.select("route", "idx", F.size("crossing").cast("long").alias("n_crossing"), F.aggregate("crossing", F.lit(0).cast("long"), lambda a, v: a + v).alias("crossing"))


@query(sql("nodes")(_ROUTE + " SELECT route, idx, lanes FROM (SELECT route, idx, maxspeed AS lanes, lag(maxspeed) OVER (PARTITION BY route ORDER BY idx) AS was FROM r) WHERE lanes IS DISTINCT FROM was"))
def n8_lane_changes(spark, sf_dir):
    """Speed limits stand for lanes."""
    return descriptions.lane_changes(_route(spark, sf_dir).withColumn("lanes", F.col("maxspeed"))).select("route", "idx", "lanes")


_DISTANCE = haversine("plat", "plon", "lat", "lon")


@query(sql("nodes")(f"""{_ROUTE}, d AS (SELECT *, sum(coalesce({_DISTANCE}, 0)) OVER (PARTITION BY route ORDER BY idx) AS distance FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM r WINDOW w AS (PARTITION BY route ORDER BY idx))),
e AS (SELECT *, distance / 50000 AS hours, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon, lead(distance / 50000) OVER w AS nhours, last_value(distance) OVER (PARTITION BY route ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total FROM d WINDOW w AS (PARTITION BY route ORDER BY idx)),
p AS (SELECT *, (lat * 3 + nlat) / 4 AS mlat, (lon * 3 + nlon) / 4 AS mlon FROM e WHERE nlat IS NOT NULL),
q AS (SELECT *, {haversine('lat', 'lon', 'mlat', 'mlon')} AS gone, {haversine('lat', 'lon', 'nlat', 'nlon')} AS between_ FROM p)
SELECT route, idx, round(total - distance - gone, 3) AS remaining, round(((nhours - hours) * CASE WHEN between_ = 0 THEN 0 ELSE 1 - gone / between_ END + total / 50000 - nhours) * 3600, 1) AS seconds FROM q WHERE gone <= between_ AND total - distance - gone >= 0"""))
def n7_arrival(spark, sf_dir):
    """Positions a quarter of the way from each node to the next, at 50 km/h."""
    w = Window.partitionBy("route").orderBy("idx")
    r = _route(spark, sf_dir)
    step = F.coalesce(spherical_distance(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    r = r.withColumn("step", step).withColumn("distance", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("hours", F.col("distance") / 50000).select("route", "idx", "lat", "lon", "distance", "hours")
    middle = lambda c: ((F.col(c) * 3 + F.lead(c).over(w)) / 4).alias(c)
    at = F.timestamp_seconds(F.lit(1_700_000_000))
    positions = r.select("route", "idx", at.alias("ts"), middle("lat"), middle("lon")).where("lat is not null")
    found = descriptions.arrival(positions, r)
    return found.select("route", "idx", F.round("remaining", 3).alias("remaining"), F.round((F.unix_micros("arrival") - F.unix_micros("ts")) / 1e6, 1).alias("seconds"))


_POSITIONS = """, seg AS (SELECT route, idx, lat AS alat, lon AS alon, lead(lat) OVER w AS blat, lead(lon) OVER w AS blon FROM r WINDOW w AS (PARTITION BY route ORDER BY idx)),
pos AS (SELECT route, idx AS key, (alat * 3 + blat) / 4 + 0.002 * (idx % 3) AS lat, (alon * 3 + blon) / 4 AS lon FROM seg WHERE blat IS NOT NULL)"""


@query(sql("nodes")(f"""{_ROUTE}{_POSITIONS},
c AS (SELECT pos.*, idx, alat, alon, blat, blon, greatest(0, least(1, ((lon - alon) * (blon - alon) + (lat - alat) * (blat - alat)) / nullif((blon - alon) * (blon - alon) + (blat - alat) * (blat - alat), 0))) AS t FROM pos JOIN seg USING (route) WHERE blat IS NOT NULL AND (alat <> blat OR alon <> blon)),
d AS (SELECT *, alat + t * (blat - alat) AS clat, alon + t * (blon - alon) AS clon FROM c),
e AS (SELECT route, key, round(min({haversine('lat', 'lon', 'clat', 'clon')}), 3) AS distance FROM d GROUP BY route, key)
SELECT pos.route, pos.key, CASE WHEN distance <= 300 THEN distance END AS distance FROM pos LEFT JOIN e USING (route, key)"""))
def j16_matched_positions(spark, sf_dir):
    """Positions a quarter of the way from each node to the next, two of three of them aside; on the route within 300 m."""
    r = _route(spark, sf_dir).select("route", "idx", "lat", "lon")
    w = Window.partitionBy("route").orderBy("idx")
    middle = lambda c: (F.col(c) * 3 + F.lead(c).over(w)) / 4
    positions = r.select("route", F.col("idx").alias("key"), (middle("lat") + 0.002 * (F.col("idx") % 3)).alias("lat"), middle("lon").alias("lon")).where("lat is not null")
    # Millimetres decide, so what rounds down to 300 m is on the route.
    found = descriptions.matched_positions(positions, r, 300.0005, level=10).withColumn("distance", F.round("distance", 3))
    return found.select("route", "key", F.when(F.col("distance") <= 300, F.col("distance")).alias("distance"))


@query("""WITH p AS (SELECT l_orderkey AS route, l_linenumber AS key, CAST(l_quantity AS DOUBLE) AS place FROM lineitem), t AS (SELECT l_orderkey AS route, CAST(l_linenumber * 10 AS DOUBLE) AS place, 'to ' || min(l_returnflag) AS instruction FROM lineitem GROUP BY ALL),
n AS (SELECT p.route, p.key, p.place, min(t.place) AS next_place, arg_min(instruction, t.place) AS instruction FROM p LEFT JOIN t ON t.route = p.route AND t.place > p.place GROUP BY ALL)
SELECT route, key, place, next_place, instruction FROM (SELECT *, lag(next_place) OVER w AS was, row_number() OVER w AS no FROM n WINDOW w AS (PARTITION BY route ORDER BY place, key)) WHERE no = 1 OR next_place IS DISTINCT FROM was""")
def n5_next_instructions(spark, sf_dir):
    """Quantities as places along an order, instructions every ten."""
    items = table(spark, sf_dir, "lineitem")
    positions = items.select(F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("key"), F.col("l_quantity").cast("double").alias("at"))
    told = items.groupBy(F.col("l_orderkey").alias("route"), (F.col("l_linenumber") * 10).cast("double").alias("at")).agg(F.concat(F.lit("to "), F.min("l_returnflag")).alias("instruction"))
    return descriptions.next_instructions(positions, told).withColumnsRenamed({"at": "place", "next_at": "next_place"})


@query(sql("ways", "way_points")("SELECT way_id AS route, 0 AS pos, CASE WHEN way_id % 2 = 0 THEN idx ELSE n_points - 1 - idx END AS no, node_id FROM way_points JOIN ways USING (way_id) WHERE n_points >= 3 UNION ALL SELECT way_id, 1, no, node_id FROM (SELECT way_id, CASE WHEN way_id % 2 = 0 THEN n_points - 1 - idx ELSE idx END AS no, node_id FROM way_points JOIN ways USING (way_id) WHERE n_points >= 3) WHERE no > 0"))
def g17_route_points(spark, sf_dir):
    """Routes that go along a way and back."""
    w = view(spark, sf_dir, "ways").where("n_points >= 3")
    first, last = F.lit(0).cast("long"), F.col("n_points") - 1
    there = w.select(F.col("way_id").alias("route"), F.lit(0).alias("pos"), "way_id", F.when(F.col("way_id") % 2 == 0, first).otherwise(last).alias("first"), F.when(F.col("way_id") % 2 == 0, last).otherwise(first).alias("last"))
    back = there.select("route", F.lit(1).alias("pos"), "way_id", F.col("last").alias("first"), F.col("first").alias("last"))
    return descriptions.points_of_parts(there.unionByName(back), way_points(spark, sf_dir)).select("route", "pos", "no", "node_id")


@query(sql("ways", "way_points")("SELECT p.way_id AS route, p.idx, array_to_string(list_sort(list(DISTINCT o.way_id)), ',') AS ways FROM way_points p JOIN way_points o USING (node_id) GROUP BY p.way_id, p.idx HAVING count(DISTINCT o.way_id) >= 2"))
def g18_route_junctions(spark, sf_dir):
    """What meets at the nodes of each way, taken as a route."""
    points = way_points(spark, sf_dir)
    # The text of a node is made once, not for each way that comes through.
    texts = routing.junction_objects(points).select("node_id", F.array_join(F.transform("way_ids", lambda i: i.cast("string")), ",").alias("ways"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    # Few bytes of numbers make long rows, so partitions must not be merged by their bytes.
    met = points.select("node_id", "way_id", "idx").repartition(parts, "node_id").join(texts.repartition(parts, "node_id"), "node_id")
    return met.select(F.col("way_id").alias("route"), "idx", "ways")


_WEIGHT = haversine("lat", "lon", "nlat", "nlon")


@query(sql("nodes")(f"""{_ROUTE}, p AS (SELECT DISTINCT l_orderkey AS obj_id, l_partkey AS node_id FROM lineitem),
c AS (SELECT obj_id, CAST(row_number() OVER w AS INT) - 1 AS idx, node_id, 48 + CAST(node_id % 200 AS DOUBLE) / 1000 AS lat, 8 + CAST(node_id * 7 % 100 AS DOUBLE) / 1000 AS lon FROM p WINDOW w AS (PARTITION BY obj_id ORDER BY node_id)),
m AS (SELECT *, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS nlat, coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS nlon FROM c WINDOW w AS (PARTITION BY obj_id ORDER BY idx)),
d AS (SELECT *, {_WEIGHT} AS step FROM m), a AS (SELECT *, sum(step) OVER (PARTITION BY obj_id ORDER BY idx) - step AS away, sum(step) OVER (PARTITION BY obj_id) AS total FROM d),
k AS (SELECT * FROM a WHERE node_id % 3 = 0), t AS (SELECT *, lead(node_id) OVER w AS b, lead(away) OVER w AS bat, first_value(node_id) OVER w AS f, first_value(away) OVER w AS fat FROM k WINDOW w AS (PARTITION BY obj_id ORDER BY idx))
SELECT obj_id, node_id AS from_id, coalesce(b, f) AS to_id, round(coalesce(bat, fat + total) - away, 3) AS metres FROM t WHERE node_id <> coalesce(b, f)"""))
def g4_ring_edges(spark, sf_dir):
    """The parts of an order as a closed line; every third part is a route node."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("obj_id"), F.col("l_partkey").alias("node_id")).distinct()
    ring = p.select("obj_id", (F.row_number().over(Window.partitionBy("obj_id").orderBy("node_id")) - 1).alias("idx"), "node_id", (48 + (F.col("node_id") % 200).cast("double") / 1000).alias("lat"), (8 + (F.col("node_id") * 7 % 100).cast("double") / 1000).alias("lon"))
    nodes = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("node_id"))
    return routing.ring_edges(ring, nodes).select("obj_id", "from_id", "to_id", F.round("metres", 3).alias("metres"))


@query(sql("ways", "way_points")(f"{_EDGES} SELECT from_id, to_id, way_id, CAST(CASE type WHEN 'motorway' THEN 4 WHEN 'track' THEN 3 ELSE 7 END AS INT) AS vehicles FROM edges"))
def g6_vehicle_masks(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return g.select("from_id", "to_id", "way_id", routing.vehicle_mask(F.col("type"), F.col("maxspeed")).alias("vehicles"))
