"""Radius, box, nearest-object and containment queries over map objects.

Objects are rows with lat and lon, with points (an open line) or with ring (a closed one). Single searches push a box down
to the scan; joins of many searches with many objects meet in tiles, so that both sides are dealt by (tile) and no task
compares all with all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, shapes
from ..functions.geodesic import ellipsoidal_distance
from ..session import share_package, written

#: Level of the tile grid where joins meet: cells of about 2.4 by 1.2 km at the equator.
LEVEL = 14


def metres(a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column, ellipsoid: bool) -> Column:
    return ellipsoidal_distance(a_lat, a_lon, b_lat, b_lon) if ellipsoid else geo.spherical_distance(a_lat, a_lon, b_lat, b_lon)


def of_types(objects: DataFrame, types: list[str] | None, column: str = "type") -> DataFrame:
    """Objects of the given types; None keeps all, an empty list none."""
    return objects if types is None else objects.where(F.col(column).isin(types) if types else F.lit(False))


def _wide(radius: float) -> float:
    """A radius on the sphere that surely holds that radius on the ellipsoid."""
    return radius * 1.01


def nodes_in_radius(nodes: DataFrame, lat: float, lon: float, radius: float, types: list[str] | None = None, ellipsoid: bool = True, inscribed: bool = False) -> DataFrame:
    """nodes with distance (metres), those at most radius away.

    inscribed keeps only what lies in the box whose corners lie on the circle, as a database does that asks its index for that box.
    """
    share_package(nodes.sparkSession)
    limits = (geo.box_within if inscribed else geo.box_around)(F.lit(lat), F.lit(lon), F.lit(radius if inscribed else _wide(radius)))
    near = of_types(nodes, types).where(geo.in_box(F.col("lat"), F.col("lon"), limits))
    return near.withColumn("distance", metres(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"), ellipsoid)).where(F.col("distance") <= radius)


def nodes_in_box(nodes: DataFrame, min_lat: float, min_lon: float, max_lat: float, max_lon: float, types: list[str] | None = None) -> DataFrame:
    """nodes in a closed box with their distance to its centre."""
    share_package(nodes.sparkSession)
    b = geo.box(*map(F.lit, (min_lat, min_lon, max_lat, max_lon)))
    return of_types(nodes, types).where(geo.in_box(F.col("lat"), F.col("lon"), b)).withColumn("distance", ellipsoidal_distance(F.lit((min_lat + max_lat) / 2), F.lit((min_lon + max_lon) / 2), F.col("lat"), F.col("lon")))


def _nearest_edges(lines: DataFrame, key: str, points: str, closed: bool, lat: float, lon: float, limits: Column, ellipsoid: bool) -> DataFrame:
    """(key, distance, closest_lat, closest_lon) of the lines whose box meets limits: of each edge's closest point in the plane the nearest one; edges without length are left out."""
    p = F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
    boxed = lines.withColumn("af_box", geo.box_of_points(F.col(points))).where(geo.boxes_meet(F.col("af_box"), limits))
    edges = boxed.select(key, F.explode(shapes.segments(F.col(points), closed)).alias("edge")).withColumn("at", shapes.nearest_on_segment(p, F.col("edge"))).where("at.lat is not null")
    far = edges.select(key, F.col("at.lat").alias("c_lat"), F.col("at.lon").alias("c_lon")).withColumn("distance", metres(F.lit(lat), F.lit(lon), F.col("c_lat"), F.col("c_lon"), ellipsoid))
    return far.groupBy(key).agg(F.min(F.struct("distance", "c_lat", "c_lon")).alias("best")).select(key, "best.distance", F.col("best.c_lat").alias("closest_lat"), F.col("best.c_lon").alias("closest_lon"))


def ways_in_radius(ways: DataFrame, lat: float, lon: float, radius: float, types: list[str] | None = None, key: str = "way_id", ellipsoid: bool = True) -> DataFrame:
    """(key, distance, closest_lat, closest_lon) of ways at most radius away."""
    share_package(ways.sparkSession)
    return _nearest_edges(of_types(ways, types), key, "points", False, lat, lon, geo.box_around(F.lit(lat), F.lit(lon), F.lit(_wide(radius))), ellipsoid).where(F.col("distance") <= radius)


def areas_in_radius(areas: DataFrame, lat: float, lon: float, radius: float, types: list[str] | None = None, key: str = "area_id", ellipsoid: bool = True) -> DataFrame:
    """(key, distance, inside, closest_lat, closest_lon) of areas at most radius away; an area that holds the point has distance 0. Holes aren't looked at."""
    share_package(areas.sparkSession)
    limits = geo.box_around(F.lit(lat), F.lit(lon), F.lit(_wide(radius)))
    own = of_types(areas, types)
    edges = _nearest_edges(own, key, "ring", True, lat, lon, limits, ellipsoid)
    inside = own.where(geo.in_box(F.lit(lat), F.lit(lon), geo.box_of_points(F.col("ring"))) & shapes.in_ring(F.lit(lat), F.lit(lon), F.col("ring"))).select(key, F.lit(True).alias("held"))
    found = edges.join(inside, key, "left").withColumn("inside", F.coalesce("held", F.lit(False)))
    at = lambda c, v: F.when(F.col("inside"), F.lit(v)).otherwise(F.col(c)).alias(c)
    return found.select(key, at("distance", 0.0), "inside", at("closest_lat", lat), at("closest_lon", lon)).where(F.col("distance") <= radius)


def lines_in_box(lines: DataFrame, min_lat: float, min_lon: float, max_lat: float, max_lon: float, types: list[str] | None = None, key: str = "way_id", points: str = "points", closed: bool = False) -> DataFrame:
    """(key, distance, ...) of ways or areas whose box meets the box, with the distance of their edges to the box's centre."""
    share_package(lines.sparkSession)
    return _nearest_edges(of_types(lines, types), key, points, closed, (min_lat + max_lat) / 2, (min_lon + max_lon) / 2, geo.box(*map(F.lit, (min_lat, min_lon, max_lat, max_lon))), True)


def points_of_interest(nodes: DataFrame, ways: DataFrame, areas: DataFrame, lat: float, lon: float, radius: float, types: list[str] | None = None) -> DataFrame:
    """(kind, obj_id, distance) of nodes, ways and areas in one table."""
    n = nodes_in_radius(nodes, lat, lon, radius, types).select(F.lit("node").alias("kind"), "obj_id", "distance")
    w = ways_in_radius(ways, lat, lon, radius, types).select(F.lit("way").alias("kind"), F.col("way_id").alias("obj_id"), "distance")
    a = areas_in_radius(areas, lat, lon, radius, types).select(F.lit("area").alias("kind"), F.col("area_id").alias("obj_id"), "distance")
    return n.unionByName(w).unionByName(a)


# ---- joins


def near_pairs(searches: DataFrame, objects: DataFrame, radius: float, level: int = LEVEL) -> DataFrame:
    """Each search (key, lat, lon) with all objects (obj_id, lat, lon) at most radius away: (key, obj_id, distance).

    A search names the tiles that its circle touches, an object lies in one, so a pair meets once. A smaller level
    suits a larger radius.
    """
    asked = searches.select("key", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    asked = asked.withColumn("tile", F.explode(geo.tiles_of_box(geo.box_around(F.col("s_lat"), F.col("s_lon"), F.lit(radius)), level)))
    placed = objects.select("obj_id", "lat", "lon", geo.tile(F.col("lat"), F.col("lon"), level).alias("tile"))
    pairs = asked.join(placed, "tile")
    return pairs.select("key", "obj_id", geo.spherical_distance(F.col("s_lat"), F.col("s_lon"), F.col("lat"), F.col("lon")).alias("distance")).where(F.col("distance") <= radius)


def nearest(searches: DataFrame, objects: DataFrame, radius: float, level: int = LEVEL) -> DataFrame:
    """(key, obj_id, distance): the nearest object of each search within radius, ties to the smaller id. Searches without one are missing. The minimum is partly taken before the shuffle."""
    return near_pairs(searches, objects, radius, level).groupBy("key").agg(F.min(F.struct("distance", "obj_id")).alias("best")).select("key", "best.obj_id", "best.distance")


def containing(points: DataFrame, regions: DataFrame, level: int = 9) -> DataFrame:
    """Each point (key, lat, lon) with all regions (region_id, ring) that hold it: (key, region_id, size in square degrees of the region's box). Borders and corners count half-open, so neighbours share no point."""
    boxed = regions.select("region_id", "ring", geo.box_of_points(F.col("ring")).alias("box"))
    tiles = boxed.select("*", F.explode(geo.tiles_of_box(F.col("box"), level)).alias("tile"))
    met = points.select("key", "lat", "lon", geo.tile(F.col("lat"), F.col("lon"), level).alias("tile")).join(tiles, "tile")
    held = met.where(geo.in_box(F.col("lat"), F.col("lon"), F.col("box")) & shapes.holds_half_open(F.col("lat"), F.col("lon"), F.col("ring")))
    return held.select("key", "region_id", geo.box_size(F.col("box")).alias("size"))


def smallest_containing(points: DataFrame, regions: DataFrame, level: int = 9) -> DataFrame:
    """(key, region_id): the region with the smallest box of those that hold the point; ties to the smaller id."""
    return containing(points, regions, level).groupBy("key").agg(F.min(F.struct("size", "region_id")).alias("best")).select("key", "best.region_id")


def region_parents(regions: DataFrame, share: float = 0.9, level: int = 7) -> DataFrame:
    """(region_id, parent_id): of the regions (region_id, level, ring) of a smaller level that hold a share of a region's corners and centre, the one with the highest level, then the smallest."""
    c = shapes.centroid(F.col("ring"))
    probes = regions.select("region_id", F.col("level").alias("own_level"), F.explode(F.concat("ring", F.array(c))).alias("p"))
    # Probes move a little towards the centre, so that shared borders don't count against a child.
    centre = regions.select("region_id", c.alias("c"))
    moved = probes.join(centre, "region_id").select(F.struct("region_id", "own_level", F.monotonically_increasing_id().alias("n")).alias("key"), (F.col("p.lat") * 0.98 + F.col("c.lat") * 0.02).alias("lat"), (F.col("p.lon") * 0.98 + F.col("c.lon") * 0.02).alias("lon"))
    held = containing(moved, regions, level).join(regions.select("region_id", F.col("level").alias("up_level"), F.size("ring").alias("n_ring")), "region_id")
    held = held.where(F.col("up_level") < F.col("key.own_level")).groupBy(F.col("key.region_id").alias("child"), "region_id", "up_level", "size").count()
    n = regions.select(F.col("region_id").alias("child"), (F.size("ring") + 1).alias("n_probes"))
    enough = held.join(n, "child").where(F.col("count") >= share * F.col("n_probes"))
    best = enough.groupBy("child").agg(F.max(F.struct("up_level", (-F.col("size")).alias("small"), (-F.col("region_id")).alias("id"))).alias("best"))
    return best.select(F.col("child").alias("region_id"), (-F.col("best.id")).alias("parent_id"))


def edge_level(lines: DataFrame, most: int = 20) -> int:
    """The finest tile level whose tiles are no smaller than the median edge of lines (points); LEVEL without edges."""
    box = geo.box_of_points(F.array("s.a", "s.b"))
    long = F.greatest(box["max_lat"] - box["min_lat"], box["max_lon"] - box["min_lon"])
    median = lines.select(F.explode(shapes.segments(F.col("points"))).alias("s")).agg(F.percentile_approx(long, 0.5, 1000).alias("m")).first()["m"]
    return LEVEL if median is None else max(1, min(most, int(math.log2(180 / max(median, 1e-9)))))


def crossings(lines: DataFrame, others: DataFrame, level: int | None = None) -> DataFrame:
    """Where edges of lines (a_id, points) cross edges of others (b_id, points): (a_id, b_id, lat, lon), each pair of edges once.

    Edges meet in the tiles that their boxes touch, at a level that suits their length if none is given. Boxes are compared first, and a pair counts only in the tile where the
    south-west corner of both boxes' common part lies, so no pair comes twice and nothing is shuffled after the join.
    """
    level = edge_level(lines) if level is None else level

    def edges(df: DataFrame, key: str, name: str) -> DataFrame:
        e = df.select(key, F.explode(shapes.segments(F.col("points"))).alias(name)).withColumn(f"{name}_box", geo.box_of_points(F.array(f"{name}.a", f"{name}.b")))
        return e.withColumn("tile", F.explode(geo.tiles_of_box(F.col(f"{name}_box"), level))).repartition(parts, "tile")

    # Few bytes make many pairs here, so partitions must not be merged by their bytes.
    spark = lines.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    p, q = F.col("u_box"), F.col("v_box")
    corner = geo.tile(F.greatest(p["min_lat"], q["min_lat"]), F.greatest(p["min_lon"], q["min_lon"]), level)
    near = edges(lines, "a_id", "u").join(edges(others, "b_id", "v"), "tile").where(geo.boxes_meet(p, q) & (corner == F.col("tile")))
    met = near.withColumn("at", shapes.meeting_point(F.col("u.a"), F.col("u.b"), F.col("v.a"), F.col("v.b"))).where("at is not null")
    return met.select("a_id", "b_id", "at.lat", "at.lon")


def crossing_lines(lines: DataFrame, others: DataFrame, place: Column, level: int | None = None) -> DataFrame:
    """(a_id, b_id, place): which of lines (a_id, points) and others (b_id, points) cross at which place, a Column of lat and lon; each once.

    Edges that many lines share are crossed once, as shapes. Where all shapes of both sides that meet at a place cross each other there, all lines
    through it do, so pairs come from one join by place and aren't shuffled; only at other places are they made by shape and made distinct.
    """
    spark = lines.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    edges = lambda df, key, name: df.select(key, F.explode(shapes.segments(F.col("points"))).alias(name))
    drawn = lambda e, key, name: e.select(name).distinct().select(F.col(name).alias(key), F.array(f"{name}.a", f"{name}.b").alias("points"))
    a, b = edges(lines, "a_id", "u"), edges(others, "b_id", "v")
    found = crossings(drawn(a, "a_id", "u"), drawn(b, "b_id", "v"), level)
    met = written(found.select(F.col("a_id").alias("u"), F.col("b_id").alias("v"), place.alias("place")).distinct())
    sizes = met.groupBy("place").agg(F.countDistinct("u").alias("n_u"), F.countDistinct("v").alias("n_v"), F.count("*").alias("n"))
    whole = sizes.where(F.col("n_u") * F.col("n_v") == F.col("n")).select("place")
    full, rest = met.join(whole, "place", "left_semi"), met.join(whole, "place", "left_anti")
    through = lambda e, key, name: full.select("place", name).distinct().join(e, name).select("place", key).distinct().repartition(parts, "place")
    pairs = through(a, "a_id", "u").join(through(b, "b_id", "v"), "place").select("a_id", "b_id", "place")
    return pairs.unionByName(rest.join(a, "u").join(b, "v").select("a_id", "b_id", "place").distinct())


# ---- grids


def covered_tiles(points: DataFrame, level: int) -> DataFrame:
    """(x, y): the distinct tiles that hold data."""
    t = geo.tile(F.col("lat"), F.col("lon"), level)
    return points.select(t.alias("t")).select("t.x", "t.y").distinct()


def is_covered(points: DataFrame, covered: DataFrame, level: int) -> DataFrame:
    """points in covered tiles."""
    t = geo.tile(F.col("lat"), F.col("lon"), level)
    return points.withColumns({"x": t["x"], "y": t["y"]}).join(covered, ["x", "y"], "left_semi").drop("x", "y")


def grid_cells(lines: DataFrame, key: str, points: str, level: int) -> DataFrame:
    """(key, type, x, y): a line is listed in each cell that its box touches."""
    return lines.select(key, "type", F.explode(geo.tiles_of_box(geo.box_of_points(F.col(points)), level)).alias("t")).select(key, "type", "t.x", "t.y")


def cell_fill(cells: DataFrame) -> DataFrame:
    """(type, n_cells, average, most): how many objects lie in a type's cells, by which an index picks its level."""
    per_cell = cells.groupBy("type", "x", "y").count()
    return per_cell.groupBy("type").agg(F.count("*").alias("n_cells"), F.avg("count").alias("average"), F.max("count").alias("most"))


def quadtree_cell(b: Column, most: int = 20) -> Column:
    """struct<level, x, y>: the deepest level whose cells are as large as a box, and the cell of its south-west corner."""
    fit = lambda whole, size: F.when(size > 0, F.floor(F.log2(F.lit(whole) / size))).otherwise(most)
    level = F.greatest(F.lit(0), F.least(F.lit(most), fit(360.0, b["max_lon"] - b["min_lon"]), fit(180.0, b["max_lat"] - b["min_lat"]))).cast("int")
    t = geo.tile(b["min_lat"], b["min_lon"], level)
    return F.struct(level.alias("level"), t["x"].alias("x"), t["y"].alias("y"))


def quadtree_search(areas: DataFrame, min_lat: float, min_lon: float, max_lat: float, max_lon: float, max_level: int = 20) -> DataFrame:
    """Rows of areas (with cell from quadtree_cell and box) that may meet a box, by level and cell, then by their boxes. A box may reach into the next cell, so the search begins one cell before."""
    n = F.pow(F.lit(2.0), F.col("cell.level"))
    x = lambda lon: F.floor((lon + 180) / (360 / n))
    y = lambda lat: F.floor((lat + 90) / (180 / n))
    cell = (F.col("cell.level") <= max_level) & (F.col("cell.x") >= x(F.lit(min_lon)) - 1) & (F.col("cell.x") <= x(F.lit(max_lon))) & (F.col("cell.y") >= y(F.lit(min_lat)) - 1) & (F.col("cell.y") <= y(F.lit(max_lat)))
    return areas.where(cell & geo.boxes_meet(F.col("box"), geo.box(*map(F.lit, (min_lat, min_lon, max_lat, max_lon)))))


def by_place(df: DataFrame, lat: Column, lon: Column, level: int = LEVEL, partitions: int | None = None) -> DataFrame:
    """df sorted along a space-filling curve: files and row groups hold neighbours, so that boxes prune them."""
    t = geo.tile(lat, lon, level)
    keyed = df.withColumn("af_z", geo.z_order(t["x"], t["y"]))
    dealt = keyed.repartitionByRange(partitions, "af_z") if partitions else keyed.repartitionByRange("af_z")
    return dealt.sortWithinPartitions("af_z").drop("af_z")
