"""The tree of administrative regions from boundary rings alone, with place nodes as aliases and streets in their regions.

boundaries: (region_id, name, level, ring), one row for each outer ring of a boundary. The tree's tables are those that searches read: regions
(region_id, parent_id, name, level, depth), aliases (region_id, node_id, name), locations (location_id, region_id, name) and what lies in a location.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import written
from . import locations, spatial

#: Administrative levels beyond this are no regions of the tree.
MAX_LEVEL = 10


def usable(boundaries: DataFrame, max_level: int = MAX_LEVEL) -> DataFrame:
    """Boundaries with an id, a name, a level up to max_level and a ring of three points or more."""
    return boundaries.where(F.col("region_id").isNotNull() & (F.trim("name") != "") & F.col("level").between(0, max_level) & (F.size("ring") >= 3))


def build_regions(boundaries: DataFrame, max_level: int = MAX_LEVEL, tile_level: int = 7) -> DataFrame:
    """(region_id, parent_id, name, level, depth): each boundary below the deepest one of a smaller level that holds nearly all of it; depth counts from 0.

    A boundary of several rings is one region, by its name's smallest ring text; its parent is the one that most of its rings lie in, of equals the smaller id.
    """
    rings = usable(boundaries, max_level).select("region_id", "name", F.col("level").cast("int").alias("level"), "ring").withColumn("part", F.struct("region_id", F.xxhash64("ring").alias("h")))
    regions = rings.groupBy("region_id").agg(F.min("name").alias("name"), F.min("level").alias("level"))
    # Each ring looks for its parent on its own; what it finds is a ring of the parent.
    numbered = written(rings.dropDuplicates(["region_id", "part"]).select(F.xxhash64("part").alias("ring_id"), "region_id", "level", "ring"))
    found = spatial.region_parents(numbered.select(F.col("ring_id").alias("region_id"), "level", "ring"), level=tile_level)
    owner = numbered.select("ring_id", "region_id")
    pairs = found.join(owner.select(F.col("ring_id").alias("region_id"), F.col("region_id").alias("child")), "region_id").join(owner.select(F.col("ring_id").alias("parent_id"), F.col("region_id").alias("up")), "parent_id")
    votes = pairs.where("child <> up").groupBy("child", "up").count()
    parents = votes.groupBy("child").agg(F.max(F.struct("count", (-F.col("up")).alias("small"))).alias("best")).select(F.col("child").alias("region_id"), (-F.col("best.small")).alias("parent_id"))
    tree = written(regions.join(parents, "region_id", "left").select("region_id", "parent_id", "name", "level"))
    depth = locations.closure(tree).groupBy("region_id").agg(F.max("up").alias("depth"))
    return tree.join(depth, "region_id").select("region_id", "parent_id", "name", "level", "depth")


def deepest(points: DataFrame, regions: DataFrame, boundaries: DataFrame, tile_level: int = 9) -> DataFrame:
    """(key, region_id, depth): the deepest region of the tree whose ring holds a point (key, lat, lon), of equals the one with the smaller box, then id. Points outside of all have no row."""
    rings = boundaries.join(regions.select("region_id"), "region_id", "left_semi").select("region_id", "ring")
    held = spatial.containing(points, rings, tile_level).join(regions.select("region_id", "depth"), "region_id")
    best = held.groupBy("key").agg(F.max(F.struct("depth", (-F.col("size")).alias("small"), (-F.col("region_id")).alias("id"))).alias("best"))
    return best.select("key", (-F.col("best.id")).alias("region_id"), "best.depth")


def build_aliases(places: DataFrame, regions: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(region_id, node_id, name): named place nodes (node_id, name, lat, lon) as other names of the deepest region around them; a place named like its region is none."""
    named = places.where(F.trim("name") != "")
    at = deepest(named.select(F.col("node_id").alias("key"), "lat", "lon"), regions, boundaries)
    met = named.select("node_id", "name").join(at.select(F.col("key").alias("node_id"), "region_id"), "node_id")
    own = regions.select("region_id", F.col("name").alias("own"))
    return met.join(own, "region_id").where("name <> own").select("region_id", "node_id", "name")


def streets_of_regions(streets: DataFrame, regions: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(way_id, name, region_id, share): named streets (way_id, name, points), each in the region that is the deepest one of most of its points, with their share of all its points; of equals the deeper one, then the smaller id. Streets outside of all regions have no row.

    Points are dealt out by tile, not by street, and votes are summed before they are shuffled, so long streets and large regions cost no single task.
    """
    named = streets.where((F.trim("name") != "") & (F.size("points") > 0))
    points = named.select("way_id", F.posexplode("points").alias("n", "p")).select(F.struct("way_id", "n").alias("key"), "p.lat", "p.lon")
    votes = deepest(points, regions, boundaries).groupBy(F.col("key.way_id").alias("way_id"), "region_id", "depth").count()
    best = votes.groupBy("way_id").agg(F.max(F.struct("count", "depth", (-F.col("region_id")).alias("id"))).alias("best"))
    return named.join(best, "way_id").select("way_id", "name", (-F.col("best.id")).alias("region_id"), (F.col("best.count") / F.size("points")).alias("share"))


def areas_of_regions(areas: DataFrame, regions: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(area_id, name, region_id): named areas (area_id, name, ring) by the centre of their boxes."""
    named = areas.where((F.trim("name") != "") & (F.size("ring") >= 3))
    centre = named.select(F.col("area_id").alias("key"), geo.box_centre(geo.box_of_points(F.col("ring"))).alias("c")).select("key", "c.lat", "c.lon")
    return named.select("area_id", "name").join(deepest(centre, regions, boundaries).select(F.col("key").alias("area_id"), "region_id"), "area_id").select("area_id", "name", "region_id")


def build_locations(streets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """locations (location_id, region_id, name) and their objects (location_id, way_id): streets (way_id, name, region_id) of one name in one region are one location, its id a hash of both."""
    keyed = streets.withColumn("location_id", F.xxhash64("region_id", "name"))
    return keyed.select("location_id", "region_id", "name").distinct(), keyed.select("location_id", "way_id")
