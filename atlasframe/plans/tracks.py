"""Queries over GPS tracks, elevation and positions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import tracks
from ..registry import query
from ..streaming import agents, tunnels, voice
from .sample import haversine, sql, table, view, way_lines


def _points(spark, sf_dir):
    p = view(spark, sf_dir, "positions")
    return p.select(F.col("vehicle").alias("track"), F.col("event_id").alias("idx"), "lat", "lon", (F.col("event_id") % 100).cast("double").alias("ele"), "ts", F.when(F.col("event_id") % 4 != 0, F.col("accuracy") / 5).alias("hdop"), F.when(F.col("event_id") % 2 == 0, F.col("accuracy") / 10).alias("pdop"))


@query(sql("positions")("SELECT vehicle AS track, event_id AS idx FROM positions WHERE coalesce(CASE WHEN event_id % 4 <> 0 THEN accuracy / 5 END, CASE WHEN event_id % 2 = 0 THEN accuracy / 10 END, 0) <= 15"))
def f23_accurate_points(spark, sf_dir):
    return tracks.accurate(_points(spark, sf_dir)).select("track", "idx")


@query(sql("positions")(f""", o AS (SELECT vehicle, event_id, lat, lon, row_number() OVER (PARTITION BY vehicle ORDER BY event_id) AS n FROM positions),
k AS (SELECT vehicle, event_id, lat, lon, n, true AS kept, lat AS klat, lon AS klon FROM o WHERE n = 1
  UNION ALL SELECT o.vehicle, o.event_id, o.lat, o.lon, o.n, {haversine('k.klat', 'k.klon', 'o.lat', 'o.lon')} > 500, CASE WHEN {haversine('k.klat', 'k.klon', 'o.lat', 'o.lon')} > 500 THEN o.lat ELSE k.klat END, CASE WHEN {haversine('k.klat', 'k.klon', 'o.lat', 'o.lon')} > 500 THEN o.lon ELSE k.klon END
  FROM k JOIN o ON o.vehicle = k.vehicle AND o.n = k.n + 1)
SELECT vehicle AS track, event_id AS idx FROM k WHERE kept"""))
def e1_far_apart(spark, sf_dir):
    """Each vehicle's positions, thinned to 500 m."""
    return tracks.far_apart(_points(spark, sf_dir), 500.0).select("track", "idx")


@query(sql("positions")(f"""SELECT track, count(*) AS n, round(sum(coalesce({haversine('plat', 'plon', 'lat', 'lon')}, 0)), 2) AS metres, sum(greatest(coalesce(ele - pele, 0), 0)) AS climb FROM (SELECT vehicle AS track, lat, lon, CAST(event_id % 100 AS DOUBLE) AS ele, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(CAST(event_id % 100 AS DOUBLE)) OVER w AS pele FROM positions WINDOW w AS (PARTITION BY vehicle ORDER BY event_id)) GROUP BY track"""))
def e5_track_statistics(spark, sf_dir):
    return tracks.statistics(_points(spark, sf_dir)).select("track", "n", F.round("metres", 2).alias("metres"), "climb")


@query(sql("positions")("""SELECT vehicle AS track, event_id AS idx, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY vehicle) AS micros FROM positions"""))
def n12_replay(spark, sf_dir):
    start = F.to_timestamp(F.lit("2030-01-01 00:00:00"))
    moved = tracks.replay(_points(spark, sf_dir), "2030-01-01 00:00:00")
    return moved.select("track", "idx", (F.unix_micros("ts") - F.unix_micros(start)).alias("micros"))


@query(sql("positions")(f""", p AS (SELECT vehicle AS track, event_id AS idx, epoch_us(ts) // 2000 AS micros, lat, lon, lag(epoch_us(ts) // 2000) OVER w AS was, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM positions WINDOW w AS (PARTITION BY vehicle ORDER BY epoch_us(ts) // 2000, event_id)),
g AS (SELECT *, CASE WHEN CAST(micros AS DOUBLE) / 1e6 - CAST(was AS DOUBLE) / 1e6 <= 10 THEN CAST(micros AS DOUBLE) / 1e6 - CAST(was AS DOUBLE) / 1e6 END AS gap FROM p),
v AS (SELECT track, idx, sum(CASE WHEN gap IS NOT NULL THEN {haversine('plat', 'plon', 'lat', 'lon')} END) OVER r / nullif(sum(gap) OVER r, 0) * 3.6 AS v FROM g WINDOW r AS (PARTITION BY track ORDER BY micros RANGE BETWEEN 3000000 PRECEDING AND CURRENT ROW))
SELECT track, idx, round(CASE WHEN v > 9000 THEN -1 ELSE v END, 3) AS speed FROM v"""))
def w7_sliding_speed(spark, sf_dir):
    """Time goes 2,000 times as fast as in the events, so that positions are seconds apart."""
    faster = F.timestamp_micros(F.floor(F.unix_micros("ts") / 2000))
    return tracks.speeds(_points(spark, sf_dir).withColumn("ts", faster), cap=9000.0).select("track", "idx", F.round("speed", 3).alias("speed"))


@query(sql("ways")("""SELECT way_id AS a_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT way_id, y0 AS y1, y0 + CASE WHEN upright = 1 THEN n_points - 1 ELSE 0 END AS y2, upright FROM ways WHERE type = 'track') JOIN (SELECT unnest(generate_series(0, 130)) AS c) ON c >= y1 AND c < y2 WHERE upright = 1 GROUP BY way_id"""))
def e4_elevation_profile(spark, sf_dir):
    """Contour lines half way between the grid's rows: an upright way of n points crosses n - 1 of them."""
    lines = way_lines(spark, sf_dir).where("type = 'track'").select(F.col("way_id").alias("a_id"), "points")
    at = lambda lon: F.struct((48 + (F.col("id").cast("double") + 0.5) * 2 / 1000).alias("lat"), F.lit(lon).alias("lon"))
    contours = spark.range(131).select(F.col("id").alias("b_id"), F.array(*[at(7.9985 + 0.06 * k) for k in range(8)]).alias("points"), (F.col("id") * 10.0).alias("ele"))
    return tracks.elevation_profile(lines, contours).groupBy("a_id").agg(F.count("*").alias("n"))


def _grid(spark, sf_dir):
    """Heights of a file of 60 by 60 cells, from parts by their numbers: those of one cell pile up."""
    cell = table(spark, sf_dir, "part").select((F.floor(F.col("p_partkey") / 60) % 60).cast("int").alias("row"), (F.col("p_partkey") % 60).cast("int").alias("col"), "p_size")
    return cell.groupBy("row", "col").agg((F.sum("p_size") * 3 % 401).cast("int").alias("height")).select(F.lit("N48E008").alias("file"), "row", "col", "height")


_GRID = "(SELECT CAST(p_partkey // 60 % 60 AS INT) AS row, CAST(p_partkey % 60 AS INT) AS col, CAST(sum(p_size) * 3 % 401 AS INT) AS height FROM part GROUP BY ALL)"


@query(sql("nodes")(f"""SELECT obj_id AS key, height FROM nodes LEFT JOIN {_GRID} g ON floor(lat) = 48 AND floor(lon) = 8 AND row = CAST(least(59, floor((1 - (lat - 48)) * 59 + 0.5)) AS INT) AND col = CAST(least(59, floor((lon - 8) * 59 + 0.5)) AS INT)"""))
def p17_heights(spark, sf_dir):
    return tracks.height_at(_grid(spark, sf_dir), view(spark, sf_dir, "nodes").select(F.col("obj_id").alias("key"), "lat", "lon"), 60).select("key", "height")


@query(f"""SELECT row, col, round(greatest(0, cos(radians(45)) * cos(s) + sin(radians(45)) * sin(s) * cos(radians(135) - a)), 6) AS shade FROM (SELECT row, col, atan(sqrt(dx * dx + dy * dy)) AS s, atan2(dy, -dx) AS a FROM (
  SELECT g.row, g.col, (e.height - w.height) / CAST(180 AS DOUBLE) AS dx, (s.height - n.height) / CAST(180 AS DOUBLE) AS dy FROM {_GRID} g JOIN {_GRID} e ON e.row = g.row AND e.col = g.col + 1 JOIN {_GRID} w ON w.row = g.row AND w.col = g.col - 1 JOIN {_GRID} s ON s.col = g.col AND s.row = g.row + 1 JOIN {_GRID} n ON n.col = g.col AND n.row = g.row - 1))""")
def m10_hill_shading(spark, sf_dir):
    return tracks.hill_shading(_grid(spark, sf_dir)).select("row", "col", F.round("shade", 6).alias("shade"))


@query(f"""SELECT CAST(level AS DOUBLE) AS level, count(*) AS n FROM (SELECT unnest(generate_series(0, 400, 20)) AS level) JOIN (SELECT a.height AS h, b.height AS o FROM {_GRID} a JOIN {_GRID} b ON (b.row = a.row AND b.col = a.col + 1) OR (b.col = a.col AND b.row = a.row + 1)) ON level > least(h, o) AND level <= greatest(h, o) GROUP BY level""")
def m10_contours(spark, sf_dir):
    return tracks.contour_segments(_grid(spark, sf_dir), 20.0).groupBy("level").agg(F.count("*").alias("n"))


def _messages(spark, sf_dir):
    p = view(spark, sf_dir, "positions")
    return p.select("vehicle", "ts", "event_id", "lat", "lon", "accuracy", F.lit(None).cast("double").alias("speed"), (F.col("event_id") % 3 != 0).alias("on_route"), F.col("event_type").alias("street"))


@query(sql("positions")("""SELECT vehicle, epoch_us(ts) AS micros, kind FROM (SELECT vehicle, ts, 'street ' || event_type AS kind, lag(event_type) OVER (PARTITION BY vehicle ORDER BY ts, event_id) AS before, event_type FROM positions) WHERE before IS DISTINCT FROM event_type"""))
def n9_street_changes(spark, sf_dir):
    found = agents.over_table(_messages(spark, sf_dir), agents.STREET)
    return found.select("vehicle", F.unix_micros("ts").alias("micros"), "kind")


_TURNED = "degrees(atan2(sin(radians(o.lon - k.klon)) * cos(radians(o.lat)), cos(radians(k.klat)) * sin(radians(o.lat)) - sin(radians(k.klat)) * cos(radians(o.lat)) * cos(radians(o.lon - k.klon))))"


@query(sql("positions")(f""", o AS (SELECT vehicle, epoch_us(ts) AS micros, lat, lon, row_number() OVER (PARTITION BY vehicle ORDER BY ts, event_id) AS n FROM positions),
k AS (SELECT vehicle, n, micros, lat AS klat, lon AS klon, CAST(0 AS DOUBLE) AS heading, false AS told FROM o WHERE n = 1
  UNION ALL SELECT vehicle, n, micros, CASE WHEN told THEN lat ELSE klat END, CASE WHEN told THEN lon ELSE klon END, CASE WHEN told THEN turned ELSE heading END, told FROM (
    SELECT *, moved > 2 AND NOT (least(abs(turned - heading), 360 - abs(turned - heading)) > 135 AND moved < 15) AS told FROM (
      SELECT o.*, k.klat, k.klon, k.heading, {haversine('k.klat', 'k.klon', 'o.lat', 'o.lon')} AS moved, {_TURNED} - 360 * floor({_TURNED} / 360) AS turned FROM k JOIN o ON o.vehicle = k.vehicle AND o.n = k.n + 1)))
SELECT vehicle, micros, round(heading, 4) AS bearing FROM k WHERE told"""))
def n3_bearings(spark, sf_dir):
    return agents.over_table(_messages(spark, sf_dir), agents.BEARING).select("vehicle", F.unix_micros("ts").alias("micros"), F.round("value", 4).alias("bearing"))


@query(sql("positions")(f""", o AS (SELECT vehicle, epoch_us(ts) AS micros, lat, lon, lag(epoch_us(ts)) OVER w AS was, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM positions WHERE accuracy < 100 WINDOW w AS (PARTITION BY vehicle ORDER BY ts, event_id)),
v AS (SELECT vehicle, micros, {haversine('plat', 'plon', 'lat', 'lon')} / ((micros - was) / 1e6) * 3.6 AS v FROM o WHERE micros - was >= 1000000)
SELECT vehicle, micros, round(CASE WHEN v > 200 THEN -1 ELSE v END, 4) AS speed FROM v"""))
def n4_speeds(spark, sf_dir):
    """Events are more than 3 s apart, so each speed is that of one step."""
    return agents.over_table(_messages(spark, sf_dir), agents.SPEED).select("vehicle", F.unix_micros("ts").alias("micros"), F.round("value", 4).alias("speed"))


@query(sql("positions")(f""", s AS (SELECT *, on_route IS DISTINCT FROM lag(on_route) OVER w AS fresh FROM (SELECT *, event_id % 3 <> 0 AS on_route FROM positions) WINDOW w AS (PARTITION BY vehicle ORDER BY ts, event_id)),
t AS (SELECT *, max(CASE WHEN fresh THEN epoch_us(ts) END) OVER (PARTITION BY vehicle ORDER BY ts, event_id) AS since FROM s)
SELECT vehicle, epoch_us(ts) AS micros, 'reroute' AS kind FROM t WHERE NOT on_route AND NOT fresh AND epoch_us(ts) - since > 5000000
UNION ALL SELECT vehicle, epoch_us(ts), 'target' FROM t WHERE on_route AND {haversine('lat', 'lon', '48.005', '8.005')} < 30"""))
def n6_route_state(spark, sf_dir):
    return agents.over_table(_messages(spark, sf_dir), agents.route_state((48.005, 8.005))).select("vehicle", F.unix_micros("ts").alias("micros"), "kind")


@query(sql("positions")(""", o AS (SELECT vehicle, epoch_us(ts) AS micros, CASE WHEN accuracy > 100 THEN 'low_accuracy' WHEN event_id % 3 <> 0 THEN 'on_route' ELSE 'off_route' END AS kind, row_number() OVER (PARTITION BY vehicle ORDER BY ts, event_id) AS n FROM positions),
k AS (SELECT *, true AS told, micros AS told_at FROM o WHERE n = 1
  UNION ALL SELECT o.*, o.kind <> k.kind OR o.micros - k.told_at >= 100000, CASE WHEN o.kind <> k.kind OR o.micros - k.told_at >= 100000 THEN o.micros ELSE k.told_at END FROM k JOIN o ON o.vehicle = k.vehicle AND o.n = k.n + 1)
SELECT vehicle, micros, kind FROM k WHERE told"""))
def n2_position_state(spark, sf_dir):
    return agents.over_table(_messages(spark, sf_dir), agents.position_state()).select("vehicle", F.unix_micros("ts").alias("micros"), "kind")


@query(sql("positions")(f""", a AS (SELECT * FROM positions WHERE coalesce(CASE WHEN event_id % 4 <> 0 THEN accuracy / 5 END, CASE WHEN event_id % 2 = 0 THEN accuracy / 10 END, 0) <= 15),
o AS (SELECT vehicle, event_id, lat, lon, row_number() OVER (PARTITION BY vehicle ORDER BY event_id) AS n FROM a),
k AS (SELECT vehicle, event_id, lat, lon, n, true AS kept, lat AS klat, lon AS klon FROM o WHERE n = 1
  UNION ALL SELECT o.vehicle, o.event_id, o.lat, o.lon, o.n, {haversine('k.klat', 'k.klon', 'o.lat', 'o.lon')} > 10, CASE WHEN {haversine('k.klat', 'k.klon', 'o.lat', 'o.lon')} > 10 THEN o.lat ELSE k.klat END, CASE WHEN {haversine('k.klat', 'k.klon', 'o.lat', 'o.lon')} > 10 THEN o.lon ELSE k.klon END
  FROM k JOIN o ON o.vehicle = k.vehicle AND o.n = k.n + 1)
SELECT vehicle AS track, event_id AS idx FROM k WHERE kept"""))
def e3_piped(spark, sf_dir):
    return tracks.piped(_points(spark, sf_dir)).select("track", "idx")


@query("""SELECT l_orderkey AS way_id, l_linenumber AS line, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_tax, l_partkey, l_suppkey) AS INT) AS rank FROM lineitem""")
def o11_ordered_elevations(spark, sf_dir):
    """Line items as points of elevation along their order; those of one distance by elevation, then place."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("distance"), F.col("l_tax").alias("ele"), F.col("l_partkey").alias("lat"), F.col("l_suppkey").alias("lon"))
    return tracks.ordered_elevations(items).select("way_id", "line", "rank")


@query(sql("positions")(""", fixes AS (SELECT vehicle, ts, CAST(event_id * 37 % 1000 AS DOUBLE) AS along, lead(ts) OVER (PARTITION BY vehicle ORDER BY ts, CAST(event_id * 37 % 1000 AS DOUBLE)) AS after FROM positions WHERE accuracy < 100),
edges AS (SELECT j, 100.0::DOUBLE * j AS start, 10.0::DOUBLE + 5 * j AS speed, coalesce(sum(100 / (10.0::DOUBLE + 5 * j)) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM (SELECT unnest(generate_series(0, 9)) AS j)),
placed AS (SELECT f.*, j BETWEEN 3 AND 6 AS tunnel, s0 + (along - start) / speed AS s FROM fixes f JOIN edges ON j = floor(along / 100)),
ticks AS (SELECT *, k, ts + to_seconds(2 + k) AS t, s + 2 + k AS now, s + 1 + k AS before, (SELECT s0 FROM edges WHERE j = 7) AS last FROM placed, (SELECT unnest(generate_series(0, 14)) AS k))
SELECT vehicle, epoch_us(ts) AS micros, 'fix' AS kind, along FROM fixes
UNION ALL SELECT vehicle, epoch_us(t), 'estimate_in_tunnel', round(start + (now - s0) * speed, 6) FROM ticks JOIN edges ON now >= s0 AND now < s0 + 100 / speed WHERE tunnel AND now < last AND (after IS NULL OR t < after)
UNION ALL SELECT vehicle, epoch_us(t), 'no_signal', CASE WHEN tunnel THEN 700 ELSE along END FROM ticks WHERE CASE WHEN tunnel THEN now >= last AND (k = 0 OR before < last) ELSE k = 0 END AND (after IS NULL OR t < after)"""))
def n2_tunnel_estimates(spark, sf_dir):
    """Each vehicle's route is a kilometre of ten edges, four of them in a tunnel; where its fixes stop, it is moved on in the tunnel second by second."""
    p = view(spark, sf_dir, "positions").select("vehicle", "ts", (F.col("event_id") * 37 % 1000).cast("double").alias("along"), "accuracy")
    edge = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("j")
    edges = p.select("vehicle").distinct().select("vehicle", edge).select("vehicle", (100.0 * F.col("j")).alias("start"), (100.0 * (F.col("j") + 1)).alias("to"), (10.0 + 5 * F.col("j")).alias("speed"), F.col("j").between(3, 6).alias("tunnel"))
    rows = tunnels.reckoned_table(tunnels.with_tunnels(p, edges))
    return rows.select("vehicle", F.unix_micros("ts").alias("micros"), "kind", F.round("along", 6).alias("along"))


@query(sql("positions")(""", o AS (SELECT vehicle, epoch_us(ts) AS micros, n, CAST(n * 60 + event_id % 50 AS DOUBLE) AS along, event_id % 11 = 0 AS lost FROM (SELECT *, row_number() OVER (PARTITION BY vehicle ORDER BY ts, event_id) AS n FROM positions)),
i AS (SELECT vehicle, k, CAST(k * 400 + k * 37 % 290 AS DOUBLE) AS pos, CASE k % 5 WHEN 0 THEN 'turn_left' WHEN 1 THEN 'turn_right' WHEN 2 THEN 'straight_on' WHEN 3 THEN 'sharp_left' ELSE 'leave_motorway' END AS kind FROM (SELECT vehicle, unnest(generate_series(1, max(n) * 60 // 400 + 2)) AS k FROM o GROUP BY vehicle)),
t AS (SELECT *, lag(pos) OVER w AS before, lead(pos) OVER w AS then_at, lead(kind) OVER w AS then_kind FROM i WINDOW w AS (PARTITION BY vehicle ORDER BY pos)),
m AS (SELECT o.*, kind, pos, then_kind, then_at, pos - along AS ahead FROM o LEFT JOIN t ON t.vehicle = o.vehicle AND along <= pos AND along > coalesce(before, -1)),
f AS (SELECT vehicle, n, micros, along, kind, pos, then_kind, then_at, ahead, lost, NOT lost AS signal, CASE WHEN lost THEN -1 ELSE micros END AS seen, lost AS say_lost, false AS say_found, NOT lost AND ahead < 900 AS say, CASE WHEN NOT lost AND ahead < 900 THEN pos ELSE -1 END AS last_at, CASE WHEN NOT lost AND ahead < 900 THEN along ELSE 0 END AS said FROM m WHERE n = 1
  UNION ALL SELECT s.vehicle, s.n, s.micros, s.along, s.kind, s.pos, s.then_kind, s.then_at, s.ahead, s.lost, CASE WHEN NOT s.lost THEN true WHEN f.signal AND s.micros - f.seen > 10000000 THEN false ELSE f.signal END, CASE WHEN s.lost THEN f.seen ELSE s.micros END,
    f.signal AND s.lost AND s.micros - f.seen > 10000000, NOT s.lost AND NOT f.signal, NOT s.lost AND s.talk, CASE WHEN NOT s.lost AND s.talk THEN s.pos ELSE f.last_at END, CASE WHEN NOT s.lost AND s.talk THEN s.along ELSE f.said END
  FROM f JOIN LATERAL (SELECT m.*, m.ahead < 900 AND (m.pos <> f.last_at OR m.along - f.said < -50 OR (m.ahead < 550 AND m.along - f.said > 300) OR (m.ahead < 150 AND m.along - f.said > 200) OR (m.ahead < 60 AND m.along - f.said > 100)) AS talk FROM m WHERE m.vehicle = f.vehicle AND m.n = f.n + 1) s ON true)
SELECT vehicle, micros, 'gps_found' AS said, 0.0 AS ahead FROM f WHERE say_found
UNION ALL SELECT vehicle, micros, 'gps_lost', 0.0 FROM f WHERE say_lost
UNION ALL SELECT vehicle, micros, CASE WHEN ahead < 80 THEN '' ELSE 'after ' || CASE WHEN ahead > 800 THEN 800 WHEN ahead > 700 THEN 700 WHEN ahead > 600 THEN 600 WHEN ahead > 500 THEN 500 WHEN ahead > 400 THEN 400 WHEN ahead > 300 THEN 300 WHEN ahead > 200 THEN 200 WHEN ahead > 100 THEN 100 WHEN ahead > 80 THEN 80 ELSE 50 END || ' metres ' END || kind || CASE WHEN then_at - pos <= 200 THEN ' then ' || then_kind ELSE '' END, ahead FROM f WHERE say"""))
def n10_voice(spark, sf_dir):
    """What each vehicle is told on a route with an instruction about every 400 metres; every eleventh message has no signal."""
    by = Window.partitionBy("vehicle").orderBy("ts", "event_id")
    p = view(spark, sf_dir, "positions").withColumn("n", F.row_number().over(by))
    messages = p.select("vehicle", "ts", "event_id", (F.col("n") * 60 + F.col("event_id") % 50).cast("double").alias("along"), F.when(F.col("event_id") % 11 == 0, "no_signal").otherwise("on_route").alias("state"))
    k = p.groupBy("vehicle").agg(F.max("n").alias("n")).select("vehicle", F.explode(F.sequence(F.lit(1), F.floor(F.col("n") * 60 / 400).cast("int") + 2)).alias("k"))
    kind = F.element_at(F.array(*map(F.lit, ("turn_left", "turn_right", "straight_on", "sharp_left", "leave_motorway"))), F.col("k") % 5 + 1)
    told = voice.announcements(k.select("vehicle", (F.col("k") * 400 + F.col("k") * 37 % 290).cast("double").alias("at"), kind.alias("kind"), F.lit(None).cast("int").alias("exit")))
    said = agents.over_table(voice.with_announcements(messages, told), voice.voice())
    return said.select("vehicle", F.unix_micros("ts").alias("micros"), F.col("kind").alias("said"), F.col("value").alias("ahead"))
