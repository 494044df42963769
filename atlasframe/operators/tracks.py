"""GPS tracks and elevation: points are rows (track, idx, lat, lon, ele, ts, hdop, pdop), attributes may be null."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_metres, spherical_distance
from ..session import share_package


def accurate(points: DataFrame, most: float = 15.0) -> DataFrame:
    """Points whose horizontal dilution, else whose positional one, is at most most; unknown ones stay."""
    return points.where(F.coalesce("hdop", "pdop", F.lit(0.0)) <= most)


def far_apart(points: DataFrame, least: float = 10.0, drop_first: bool = False) -> DataFrame:
    """Points more than least metres from the last one kept, a fold along each track. drop_first starts from the first point without keeping it, as its distance to itself is 0.

    Tracks stream through their tasks in order; of a track a task holds the last point kept. Points without a place are left out.
    """
    share_package(points.sparkSession)
    names = points.columns

    def fold(batches):
        track = last = None
        for t in batches:
            keep = np.zeros(len(t), bool)
            for k, (own, lat, lon) in enumerate(zip(t["track"], t["lat"].to_numpy(float), t["lon"].to_numpy(float), strict=True)):
                if last is None or own != track:
                    track, last, keep[k] = own, (lat, lon), not drop_first
                elif haversine_metres(*last, lat, lon) > least:
                    last, keep[k] = (lat, lon), True
            yield t[keep]

    placed = points.where("lat is not null and lon is not null").repartition("track").sortWithinPartitions("track", "idx")
    return placed.mapInPandas(fold, points.schema).select(*names)


def matching(points: Column, keep) -> Column:
    """The points of an array that a predicate keeps."""
    return F.filter(points, keep)


def statistics(points: DataFrame) -> DataFrame:
    """(track, n, metres, seconds, climb, descent, box): one row for each track; attributes that are missing add nothing."""
    along = Window.partitionBy("track").orderBy("idx")
    step = F.coalesce(spherical_distance(F.lag("lat").over(along), F.lag("lon").over(along), F.col("lat"), F.col("lon")), F.lit(0.0))
    up = F.col("ele") - F.last("ele", True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = points.withColumns({"af_step": step, "af_up": up})
    return rows.groupBy("track").agg(
        F.count("*").alias("n"), F.sum("af_step").alias("metres"), (F.max(F.unix_micros("ts")) / 1e6 - F.min(F.unix_micros("ts")) / 1e6).alias("seconds"), F.sum(F.greatest("af_up", F.lit(0.0))).alias("climb"), F.sum(F.greatest(-F.col("af_up"), F.lit(0.0))).alias("descent"),
        F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"),
    )


def piped(points: DataFrame, most_dilution: float = 15.0, least: float = 10.0) -> DataFrame:
    """First the accurate points, then those far apart."""
    return far_apart(accurate(points, most_dilution), least)


def speeds(points: DataFrame, seconds: int = 3, cap: float = 200.0) -> DataFrame:
    """points with speed (km/h) over the seconds before, from positions; null without a step in them, -1 above the cap. Gaps of more than 10 s count as no step."""
    by_time = Window.partitionBy("track").orderBy("ts", "idx")
    gap = F.unix_micros("ts") / 1e6 - F.unix_micros(F.lag("ts").over(by_time)) / 1e6
    metres = spherical_distance(F.lag("lat").over(by_time), F.lag("lon").over(by_time), F.col("lat"), F.col("lon"))
    steps = points.withColumns({"af_gap": F.when(gap <= 10, gap), "af_metres": F.when(gap <= 10, metres), "af_at": F.unix_micros("ts")})
    window = Window.partitionBy("track").orderBy("af_at").rangeBetween(-seconds * 1_000_000, 0)
    v = F.sum("af_metres").over(window) / F.nullif(F.sum("af_gap").over(window), F.lit(0.0)) * 3.6
    return steps.withColumn("speed", F.when(v > cap, -1.0).otherwise(v)).drop("af_gap", "af_metres", "af_at")


def replay(points: DataFrame, start) -> DataFrame:
    """points with ts moved so that each track begins at start, for feeding a stream of positions."""
    first = F.min(F.unix_micros("ts")).over(Window.partitionBy("track"))
    return points.withColumn("ts", F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + F.unix_micros("ts") - first))


def elevation_profile(lines: DataFrame, contours: DataFrame, level: int = 14) -> DataFrame:
    """(a_id, distance, ele, lat, lon): where lines (a_id, points) cross contour lines (b_id, points, ele), by distance from the line's start.

    Lines that cross a contour twice at one place count it once.
    """
    from ..functions.shapes import segments
    from .spatial import crossings

    met = crossings(lines, contours.select("b_id", "points"), level).join(contours.select("b_id", "ele"), "b_id")
    along = Window.partitionBy("a_id").orderBy("no")
    edges = lines.select("a_id", F.posexplode(segments(F.col("points"))).alias("no", "s"))
    length = spherical_distance(F.col("s.a.lat"), F.col("s.a.lon"), F.col("s.b.lat"), F.col("s.b.lon"))
    starts = edges.withColumn("before", F.sum(length).over(along.rowsBetween(Window.unboundedPreceding, 0)) - length)
    off = lambda c: F.abs((F.col("s.b.lon") - F.col("s.a.lon")) * (F.col("lat") - F.col("s.a.lat")) - (F.col("lon") - F.col("s.a.lon")) * (F.col("s.b.lat") - F.col("s.a.lat")))
    onto = met.join(starts, "a_id").withColumn("off", off("s"))
    near = F.struct("off", (F.col("before") + spherical_distance(F.col("s.a.lat"), F.col("s.a.lon"), F.col("lat"), F.col("lon"))).alias("distance"))
    inside = (F.col("lat") >= F.least("s.a.lat", "s.b.lat") - 1e-9) & (F.col("lat") <= F.greatest("s.a.lat", "s.b.lat") + 1e-9) & (F.col("lon") >= F.least("s.a.lon", "s.b.lon") - 1e-9) & (F.col("lon") <= F.greatest("s.a.lon", "s.b.lon") + 1e-9)
    return onto.where(inside).groupBy("a_id", "ele", "lat", "lon").agg(F.min(near).alias("b")).select("a_id", "b.distance", "ele", "lat", "lon")


# ---- height grids (file, row, col, height), rows from north


def height_at(grid: DataFrame, points: DataFrame, size: int = 1201) -> DataFrame:
    """points (key, lat, lon) with the height of the cell they lie in; file is the tile's name such as N51E007. Null where there is none."""
    lat0, lon0 = F.floor("lat"), F.floor("lon")
    name = F.concat(F.when(lat0 >= 0, "N").otherwise("S"), F.lpad(F.abs(lat0).cast("string"), 2, "0"), F.when(lon0 >= 0, "E").otherwise("W"), F.lpad(F.abs(lon0).cast("string"), 3, "0"))
    row = F.least(F.lit(size - 1), F.floor((1 - (F.col("lat") - lat0)) * (size - 1) + 0.5)).cast("int")
    col = F.least(F.lit(size - 1), F.floor((F.col("lon") - lon0) * (size - 1) + 0.5)).cast("int")
    return points.withColumns({"file": name, "row": row, "col": col}).join(grid, ["file", "row", "col"], "left").select(*points.columns, "height")


def hill_shading(grid: DataFrame, azimuth: float = 315.0, altitude: float = 45.0, metres: float = 90.0) -> DataFrame:
    """grid with shade from 0 to 1: light from azimuth and altitude on slopes from the four neighbours; cells without all four are left out. Neighbours are windows along rows and columns."""
    import math

    across, down = Window.partitionBy("file", "row").orderBy("col"), Window.partitionBy("file", "col").orderBy("row")
    dz_dx = (F.lead("height").over(across) - F.lag("height").over(across)) / (2 * metres)
    dz_dy = (F.lead("height").over(down) - F.lag("height").over(down)) / (2 * metres)
    sloped = grid.withColumns({"af_dx": dz_dx, "af_dy": dz_dy}).where("af_dx is not null and af_dy is not null")
    zenith, light = math.radians(90 - altitude), math.radians(360 - azimuth + 90)
    slope, aspect = F.atan(F.sqrt(F.col("af_dx") * F.col("af_dx") + F.col("af_dy") * F.col("af_dy"))), F.atan2(F.col("af_dy"), -F.col("af_dx"))
    shade = math.cos(zenith) * F.cos(slope) + math.sin(zenith) * F.sin(slope) * F.cos(light - aspect)
    return sloped.withColumn("shade", F.greatest(F.lit(0.0), shade)).drop("af_dx", "af_dy")


def contour_segments(grid: DataFrame, interval: float) -> DataFrame:
    """(file, level, row, col, side): grid edges that a contour crosses, right or down from a cell, for each multiple of interval between two neighbours."""
    across, down = Window.partitionBy("file", "row").orderBy("col"), Window.partitionBy("file", "col").orderBy("row")
    both = grid.withColumns({"right": F.lead("height").over(across), "down": F.lead("height").over(down)})
    sides = both.select("file", "row", "col", "height", F.explode(F.array(F.struct(F.lit("right").alias("side"), F.col("right").alias("other")), F.struct(F.lit("down").alias("side"), F.col("down").alias("other")))).alias("e")).where("e.other is not null")
    low, high = F.least("height", "e.other"), F.greatest("height", "e.other")
    first, last = F.floor(low / interval) + 1, F.floor(high / interval)
    return sides.where(first <= last).select("file", F.explode(F.sequence(first, last)).alias("k"), "row", "col", "e.side").select("file", (F.col("k") * interval).alias("level"), "row", "col", "side")


def ordered_elevations(points: DataFrame) -> DataFrame:
    """points (way_id, distance, ele, lat, lon) with rank: along each way by distance, then elevation, then place."""
    return points.withColumn("rank", F.row_number().over(Window.partitionBy("way_id").orderBy("distance", "ele", "lat", "lon")))
