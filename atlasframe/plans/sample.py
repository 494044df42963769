"""Map data made from the driver's tables by fixed formulas, as DataFrames and as DuckDB SQL.

Points of interest stand at hashed places between 47 and 49 degrees north and 7 and 10 east. Each order is a way on a
grid of 128 by 128 crossings, with a vertex for each of its line items. Parts are pentagon areas. Regions, nations and five
cities in each nation form the tree of administrative regions; customers are addresses in streets of these cities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID = 128

#: Texts that are valid in Spark and DuckDB alike; names in braces are tables.
_SHARED = {
    "nodes": """
        SELECT obj_id, type, name, 47 + CAST(obj_id * 7919 % 100000 AS DOUBLE) / 50000 AS lat, 7 + CAST(obj_id * 104729 % 100000 AS DOUBLE) / 100000 * 3 AS lon FROM (
          SELECT c_custkey AS obj_id, lower('shop_' || c_mktsegment) AS type, c_name AS name FROM {customer}
          UNION ALL SELECT 10000000 + s_suppkey, 'depot', s_name FROM {supplier}
          UNION ALL SELECT 20000000 + p_partkey, lower('stock_' || p_type), p_name FROM {part})""",
    "ways": """
        SELECT o_orderkey AS way_id,
          CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'motorway' WHEN '2' THEN 'primary' WHEN '3' THEN 'secondary' WHEN '4' THEN 'residential' ELSE 'track' END AS type,
          'Street ' || CAST(o_custkey % 500 AS STRING) AS name, o_orderkey % 5 = 0 AS oneway,
          CASE WHEN o_orderkey % 3 = 0 THEN CAST(30 + o_orderkey % 10 * 10 AS INT) END AS maxspeed, CAST(1 + o_orderkey % 5 AS INT) AS grade,
          o_orderkey * 111 % 128 AS x0, CAST(floor(o_orderkey / 128) AS BIGINT) * 77 % 128 AS y0, o_custkey % 2 AS upright, n_points
        FROM {orders} JOIN (SELECT l_orderkey, count(*) AS n_points FROM {lineitem} GROUP BY l_orderkey HAVING count(*) >= 2) AS counted ON l_orderkey = o_orderkey""",
    "areas": """
        SELECT p_partkey AS area_id, lower(p_type) AS type, p_name AS name, lat, lon, 0.0005 * p_size AS half FROM (
          SELECT p_partkey, p_type, p_name, CAST(p_size AS DOUBLE) AS p_size, 47 + CAST(p_partkey * 7919 % 100000 AS DOUBLE) / 50000 AS lat, 7 + CAST(p_partkey * 104729 % 100000 AS DOUBLE) / 100000 * 3 AS lon FROM {part}) AS placed""",
    "islands": """
        SELECT p_partkey AS way_id, p_partkey % 256 * 7 AS x, CAST(floor(p_partkey / 256) AS BIGINT) * 7 AS y, CAST(313 + p_partkey % 7 * 100 AS BIGINT) AS u0, CAST(257 + p_partkey % 3 * 200 AS BIGINT) AS v0,
          CAST(713 + p_partkey % 7 * 100 + p_size % 5 * 1000 AS BIGINT) AS u1, CAST(757 + p_partkey % 3 * 200 + p_size % 4 * 900 AS BIGINT) AS v1 FROM {part}""",
    "regions": """
        SELECT 1000 + CAST(r_regionkey AS BIGINT) AS region_id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name, 2 AS level,
          CAST(47 AS DOUBLE) AS min_lat, 7 + CAST(r_regionkey AS DOUBLE) * 3 / 5 AS min_lon, CAST(49 AS DOUBLE) AS max_lat, 7 + CAST(r_regionkey + 1 AS DOUBLE) * 3 / 5 AS max_lon FROM {region}
        UNION ALL
        SELECT 2000 + CAST(n_nationkey AS BIGINT), 1000 + CAST(n_regionkey AS BIGINT), n_name, 4, 47 + CAST(k AS DOUBLE) * 2 / m, 7 + CAST(n_regionkey AS DOUBLE) * 3 / 5, 47 + CAST(k + 1 AS DOUBLE) * 2 / m, 7 + CAST(n_regionkey + 1 AS DOUBLE) * 3 / 5
        FROM (SELECT n_nationkey, n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k, count(*) OVER (PARTITION BY n_regionkey) AS m FROM {nation}) AS placed
        UNION ALL
        SELECT 3000 + CAST(n_nationkey AS BIGINT) * 10 + c, 2000 + CAST(n_nationkey AS BIGINT), n_name || ' ' || side, 8, 47 + CAST(k AS DOUBLE) * 2 / m, 7 + CAST(n_regionkey * 5 + c AS DOUBLE) * 3 / 25, 47 + CAST(k + 1 AS DOUBLE) * 2 / m, 7 + CAST(n_regionkey * 5 + c + 1 AS DOUBLE) * 3 / 25
        FROM (SELECT n_nationkey, n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k, count(*) OVER (PARTITION BY n_regionkey) AS m FROM {nation}) AS placed
        CROSS JOIN (SELECT 0 AS c, 'North' AS side UNION ALL SELECT 1, 'East' UNION ALL SELECT 2, 'South' UNION ALL SELECT 3, 'West' UNION ALL SELECT 4, 'Centre') AS sides""",
    "locations": """
        SELECT DISTINCT region_id * 100 + k AS location_id, region_id, CAST(10000 + region_id AS STRING) AS postal_area, 'Station Road ' || CAST(k AS STRING) AS name FROM (
          SELECT 3000 + CAST(c_nationkey AS BIGINT) * 10 + c_custkey % 5 AS region_id, c_custkey % 37 AS k FROM {customer}) AS streets""",
    "addresses": """
        SELECT c_custkey AS address_id, (3000 + CAST(c_nationkey AS BIGINT) * 10 + c_custkey % 5) * 100 + c_custkey % 37 AS location_id, CAST(1 + c_custkey % 97 AS STRING) AS name FROM {customer}""",
    "pois": """SELECT s_suppkey AS poi_id, 2000 + CAST(s_nationkey AS BIGINT) AS region_id, s_name AS name FROM {supplier}""",
    "positions": """
        SELECT user_id AS vehicle, event_id, CAST(ts AS TIMESTAMP) AS ts, value AS accuracy, 48 + CAST(event_id * 37 % 1000 AS DOUBLE) / 100000 AS lat, 8 + CAST(event_id * 53 % 1000 AS DOUBLE) / 100000 AS lon, event_type FROM {events}""",
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: DuckDB only.
_DUCK = {
    "way_points": """
        SELECT way_id, idx, (y0 + CASE WHEN upright = 1 THEN idx ELSE 0 END) * 1000 + x0 + CASE WHEN upright = 1 THEN 0 ELSE idx END AS node_id,
          48 + CAST(y0 + CASE WHEN upright = 1 THEN idx ELSE 0 END AS DOUBLE) * 2 / 1000 AS lat, 8 + CAST(x0 + CASE WHEN upright = 1 THEN 0 ELSE idx END AS DOUBLE) * 3 / 1000 AS lon
        FROM (SELECT *, unnest(generate_series(0, n_points - 1)) AS idx FROM ways)""",
    "island_cells": """
        SELECT x + i AS x, y + j AS y, (least(u1, 1000 * (i + 1)) - greatest(u0, 1000 * i)) * (least(v1, 1000 * (j + 1)) - greatest(v0, 1000 * j)) AS land,
          i >= u0 // 1000 AND i <= u1 // 1000 AND j >= v0 // 1000 AND j <= v1 // 1000 AS touched, i > u0 // 1000 AND i < u1 // 1000 AND j > v0 // 1000 AND j < v1 // 1000 AS inner_cell
        FROM islands, (SELECT unnest(generate_series(0, 6)) AS i), (SELECT unnest(generate_series(0, 6)) AS j)""",
    "corners": """
        SELECT area_id, k, CASE WHEN k IN (0, 1) THEN lat - half WHEN k IN (2, 4) THEN lat + half ELSE lat + 1.5 * half END AS clat,
          CASE WHEN k IN (0, 4) THEN lon - half WHEN k IN (1, 2) THEN lon + half ELSE lon END AS clon FROM areas, (SELECT unnest([0, 1, 2, 3, 4]) AS k)""",
}
_NEEDS = {"way_points": ("ways",), "corners": ("areas",), "island_cells": ("islands",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name."""
    if name == "way_points":
        return way_points(spark, sf_dir)
    text = _SHARED[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in text})


def way_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(way_id, idx, node_id, lat, lon): the vertices of all ways, made on the spot from their numbers."""
    w = view(spark, sf_dir, "ways").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_points") - 1)).alias("idx"))
    x = F.col("x0") + F.when(F.col("upright") == 1, 0).otherwise(F.col("idx"))
    y = F.col("y0") + F.when(F.col("upright") == 1, F.col("idx")).otherwise(0)
    return w.select("way_id", "idx", (y * 1000 + x).alias("node_id"), (48 + y.cast("double") * 2 / 1000).alias("lat"), (8 + x.cast("double") * 3 / 1000).alias("lon"))


def way_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways with points: array<struct<lat, lon>> and ids: array<long>, built in the row without a shuffle beyond the ways' own."""
    w = view(spark, sf_dir, "ways")
    at = F.sequence(F.lit(0).cast("long"), F.col("n_points") - 1)
    x = lambda k: F.col("x0") + F.when(F.col("upright") == 1, 0).otherwise(k)
    y = lambda k: F.col("y0") + F.when(F.col("upright") == 1, k).otherwise(0)
    points = F.transform(at, lambda k: F.struct((48 + y(k).cast("double") * 2 / 1000).alias("lat"), (8 + x(k).cast("double") * 3 / 1000).alias("lon")))
    return w.withColumn("points", points).withColumn("ids", F.transform(at, lambda k: y(k) * 1000 + x(k)))


def area_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas with ring: array<struct<lat, lon>>, a pentagon, counter-clockwise."""
    a = view(spark, sf_dir, "areas")
    corner = lambda dy, dx: F.struct((F.col("lat") + dy * F.col("half")).alias("lat"), (F.col("lon") + dx * F.col("half")).alias("lon"))
    return a.withColumn("ring", F.array(corner(-1, -1), corner(-1, 1), corner(1, 1), F.struct((F.col("lat") + 1.5 * F.col("half")).alias("lat"), F.col("lon")), corner(1, -1)))


#: Level of the cells in which islands are laid out, each in seven by seven of them; their numbers are thousandths of a cell.
ISLAND_LEVEL = 15


def island_coasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands with points: a closed coastline, a rectangle with its land to the left."""
    w, h = 360 / 2.0**ISLAND_LEVEL, 180 / 2.0**ISLAND_LEVEL
    corner = lambda u, v: F.struct(((F.col("y") + F.col(v) / 1000) * h - 90).alias("lat"), ((F.col("x") + F.col(u) / 1000) * w - 180).alias("lon"))
    return view(spark, sf_dir, "islands").withColumn("points", F.array(corner("u0", "v0"), corner("u1", "v0"), corner("u1", "v1"), corner("u0", "v1"), corner("u0", "v0")))


def sql(*views: str) -> Callable[[str], str]:
    """Put the named views in front of a DuckDB query; the query begins with SELECT, or with a comma and more views."""

    def whole(body: str) -> str:
        names: list[str] = []
        for v in views:
            names += [n for n in (*_NEEDS.get(v, ()), v) if n not in names]
        plain = {t: t for t in _TABLES}
        parts = ",\n".join(f"{n} AS ({_DUCK[n] if n in _DUCK else _SHARED[n].format(**plain)})" for n in names)
        return f"WITH RECURSIVE {parts}\n{body.strip()}"

    return whole


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """SQL for metres on the sphere."""
    h = f"(sin(radians(({lat2}) - ({lat1})) / 2) * sin(radians(({lat2}) - ({lat1})) / 2) + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians(({lon2}) - ({lon1})) / 2) * sin(radians(({lon2}) - ({lon1})) / 2))"
    return f"(2 * CAST(6371010 AS DOUBLE) * atan2(sqrt({h}), sqrt(1 - {h})))"


def vincenty(source: str, lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """SQL that adds a column metres on the ellipsoid to the rows of source, by ten rounds in nested selects."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    d = lambda x: f"CAST({x!r} AS DOUBLE)"
    q = f"SELECT *, atan({d(1 - f)} * tan(radians({lat1}))) AS v_u1, atan({d(1 - f)} * tan(radians({lat2}))) AS v_u2, radians(({lon2}) - ({lon1})) AS v_l FROM ({source})"
    q = f"SELECT *, v_l AS v_lam, sin(v_u1) AS v_s1, cos(v_u1) AS v_c1, sin(v_u2) AS v_s2, cos(v_u2) AS v_c2 FROM ({q})"
    for k in range(10):
        q = f"SELECT *, sqrt(pow(v_c2 * sin(v_lam), 2) + pow(v_c1 * v_s2 - v_s1 * v_c2 * cos(v_lam), 2)) AS v_ss, v_s1 * v_s2 + v_c1 * v_c2 * cos(v_lam) AS v_cs FROM ({q})"
        q = f"SELECT *, atan2(v_ss, v_cs) AS v_sigma, CASE WHEN v_ss > 0 THEN v_c1 * v_c2 * sin(v_lam) / v_ss ELSE 0 END AS v_sa FROM ({q})"
        q = f"SELECT *, 1 - v_sa * v_sa AS v_cos2 FROM ({q})"
        q = f"SELECT *, CASE WHEN v_cos2 > 0 THEN v_cs - 2 * v_s1 * v_s2 / v_cos2 ELSE 0 END AS v_c2m, {d(f / 16)} * v_cos2 * (4 + {d(f)} * (4 - 3 * v_cos2)) AS v_c FROM ({q})"
        if k < 9:
            gone = "v_ss, v_cs, v_sigma, v_sa, v_cos2, v_c2m, v_c"
            q = f"SELECT * EXCLUDE (v_lam, {gone}), v_l + (1 - v_c) * {d(f)} * v_sa * (v_sigma + v_c * v_ss * (v_c2m + v_c * v_cs * (-1 + 2 * v_c2m * v_c2m))) AS v_lam FROM ({q})"
    q = f"SELECT *, v_cos2 * {d((a * a - b * b) / (b * b))} AS v_uu FROM ({q})"
    q = f"SELECT *, 1 + v_uu / 16384 * (4096 + v_uu * (-768 + v_uu * (320 - 175 * v_uu))) AS v_a, v_uu / 1024 * (256 + v_uu * (-128 + v_uu * (74 - 47 * v_uu))) AS v_b FROM ({q})"
    return f"SELECT *, CASE WHEN v_ss > 0 THEN {d(b)} * v_a * (v_sigma - v_b * v_ss * (v_c2m + v_b / 4 * (v_cs * (-1 + 2 * v_c2m * v_c2m) - v_b / 6 * v_c2m * (-3 + 4 * v_ss * v_ss) * (-3 + 4 * v_c2m * v_c2m)))) ELSE 0 END AS metres FROM ({q})"
