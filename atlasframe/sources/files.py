"""Readers and writers of map files. Every reader gives DataFrames and opens paths through Spark alone.

Raw tables: nodes (id, lat, lon, tags), ways (id, refs, tags), relations (id, members, tags).
"""

from __future__ import annotations

import struct
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import share_package, written
from . import pbf

_TAG = "tag array<struct<_k:string,_v:string>>"


def _tags() -> Column:
    return F.map_from_entries(F.coalesce(F.transform("tag", lambda t: F.struct(t["_k"].alias("key"), t["_v"].alias("value"))), F.array().cast("array<struct<key:string,value:string>>"))).alias("tags")


def read_osm_xml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes, ways and relations of XML map files; a file is split between tasks by the XML source."""
    read = lambda row, schema: spark.read.format("xml").option("rowTag", row).schema(schema).load(path)
    nodes = read("node", f"_id long, _lat double, _lon double, {_TAG}").select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), _tags())
    ways = read("way", f"_id long, nd array<struct<_ref:long>>, {_TAG}").select(F.col("_id").alias("id"), F.coalesce(F.transform("nd", lambda n: n["_ref"]), F.array().cast("array<long>")).alias("refs"), _tags())
    member = F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("id"), m["_role"].alias("role")))
    relations = read("relation", f"_id long, member array<struct<_type:string,_ref:long,_role:string>>, {_TAG}").select(F.col("_id").alias("id"), F.coalesce(member, F.array().cast(pbf.MEMBERS)).alias("members"), _tags())
    return {"nodes": nodes, "ways": ways, "relations": relations}


def read_osm_pbf(spark: SparkSession, path: str, partition_bytes: int = pbf.PARTITION_BYTES) -> dict[str, DataFrame]:
    """nodes, ways and relations of a PBF file or of a folder of them.

    Where pyarrow knows the file system, the osm_pbf source reads ranges of blobs, as many tasks as a file has of them. From other file systems Spark's own reader
    loads a file as one value, which one task cuts into blobs, so give large extracts there as several files. Objects are decoded once and written to the shared folder, for three tables.
    """
    share_package(spark)
    if "://" not in path or path.split("://")[0] in pbf.SCHEMES:
        spark.dataSource.register(pbf.OsmPbf)
        found = spark.read.format("osm_pbf").option("partition_bytes", partition_bytes).load(path)
    else:

        def cut(batches):
            for b in batches:
                for content in b.column(0):
                    for blob in pbf.blobs(content.as_py()):
                        yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["blob"])

        def decode(batches):
            for b in batches:
                yield from pbf.batches(blob.as_py() for blob in b.column(0))

        blobs = spark.read.format("binaryFile").load(path).select("content").mapInArrow(cut, "blob binary").repartition(spark.sparkContext.defaultParallelism)
        found = blobs.mapInArrow(decode, pbf.SCHEMA)
    objects = written(found)
    return {
        "nodes": objects.where("kind = 'node'").select("id", "lat", "lon", "tags"),
        "ways": objects.where("kind = 'way'").select("id", "refs", "tags"),
        "relations": objects.where("kind = 'relation'").select("id", "members", "tags"),
    }


def read_osm(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """Several files of either format by their suffix, as one set of tables."""
    found = [(read_osm_pbf if p.endswith(".pbf") else read_osm_xml)(spark, p) for p in paths]
    return {k: reduce(DataFrame.unionByName, [f[k] for f in found]) for k in ("nodes", "ways", "relations")}


# ---- polygon files, tracks, heights, shapes


def read_poly(spark: SparkSession, path: str) -> DataFrame:
    """(file, ring_no, name, ring): rings of .poly files: a title, then sections of a name, lines of lon and lat, END. A closing point that equals the first is dropped; names with ! are holes."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\nEND\s*(?:\r?\n|$)").alias("sections"))
    s = files.select("file", F.posexplode("sections").alias("ring_no", "body")).where(F.trim("body") != "")
    body = s.withColumn("lines", F.filter(F.split(F.when(F.col("ring_no") == 0, F.regexp_replace("body", r"^[^\n]*\n", "")).otherwise(F.col("body")), r"\r?\n"), lambda x: F.trim(x) != ""))
    numbers = lambda x: F.filter(F.split(F.trim(x), r"\s+"), lambda y: y != "")
    point = lambda x: F.struct(F.get(numbers(x), F.lit(1)).cast("double").alias("lat"), F.get(numbers(x), F.lit(0)).cast("double").alias("lon"))
    rows = body.where(F.size("lines") > 1).select("file", "ring_no", F.trim(F.get("lines", F.lit(0))).alias("name"), F.transform(F.slice("lines", 2, F.size("lines") - 1), point).alias("ring"))
    closed = (F.size("ring") > 1) & (F.get("ring", F.lit(0)) == F.element_at("ring", -1))
    return rows.withColumn("ring", F.when(closed, F.slice("ring", F.lit(1), F.size("ring") - 1)).otherwise(F.col("ring")))


_POINT = "_lat double, _lon double, ele double, time string, course double, hdop double, vdop double, pdop double, name string"


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """(file, track, seg, idx, lat, lon, ele, ts, course, hdop, vdop, pdop) of track points; what a point doesn't tell is null."""
    from ..functions.text import iso_time

    schema = f"name string, trkseg array<struct<trkpt:array<struct<{', '.join(f.replace(' ', ':') for f in _POINT.split(', '))}>>>>"
    tracks = spark.read.format("xml").option("rowTag", "trk").schema(schema).load(path).select(F.input_file_name().alias("file"), "trkseg")
    numbered = tracks.withColumn("track", F.row_number().over(Window.partitionBy("file").orderBy(F.monotonically_increasing_id())) - 1)
    points = numbered.select("file", "track", F.posexplode("trkseg").alias("seg", "s")).select("file", "track", "seg", F.posexplode("s.trkpt").alias("idx", "p"))
    return points.select("file", "track", "seg", "idx", F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), "p.ele", iso_time(F.col("p.time")).alias("ts"), "p.course", "p.hdop", "p.vdop", "p.pdop")


def read_gpx_waypoints(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, lat, lon, ele, ts) of way points."""
    from ..functions.text import iso_time

    w = spark.read.format("xml").option("rowTag", "wpt").schema(_POINT).load(path)
    return w.select(F.input_file_name().alias("file"), "name", F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "ele", iso_time(F.col("time")).alias("ts"))


def gpx_documents(points: DataFrame) -> DataFrame:
    """(track, gpx): each track (track, seg, idx, lat, lon, ele, ts) as an XML document."""
    from ..functions.text import iso_text

    tag = lambda name, c: F.coalesce(F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>")), F.lit(""))
    point = F.concat(F.lit('<trkpt lat="'), F.format_string("%.7f", F.col("lat")), F.lit('" lon="'), F.format_string("%.7f", F.col("lon")), F.lit('">'), tag("ele", F.when(F.col("ele").isNotNull(), F.format_string("%.1f", F.col("ele")))), tag("time", iso_text(F.col("ts"))), F.lit("</trkpt>"))
    segs = points.withColumn("x", point).groupBy("track", "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda p: p["x"]), "").alias("x"))
    body = segs.groupBy("track").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "x"))), lambda s: F.concat(F.lit("<trkseg>"), s["x"], F.lit("</trkseg>"))), "").alias("x"))
    return body.select("track", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><trk>'), "x", F.lit("</trk></gpx>")).alias("gpx"))


def read_heights(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, col, height) of .hgt files: square grids of big-endian 16-bit metres, rows from north; -32768 is null. file is the name without its suffix."""
    share_package(spark)

    def read(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                grid = np.frombuffer(content.as_py(), ">i2").astype(np.int32)
                size = int(round(len(grid) ** 0.5))
                for row in range(size):
                    own = grid[row * size : (row + 1) * size]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * size), pa.array(np.full(size, row, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(own, mask=own == -32768)], names=["file", "row", "col", "height"])

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.hgt$", 1).alias("file"), "content")
    return files.mapInArrow(read, "file string, row int, col int, height int")


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """(file, shape, part, ring) of lines and polygons in ESRI .shp files."""
    share_package(spark)
    point = pa.struct([("lat", pa.float64()), ("lon", pa.float64())])

    def read(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw, at = content.as_py(), 100
                while at + 8 < len(raw):
                    number, words = struct.unpack(">ii", raw[at : at + 8])
                    record = raw[at + 8 : at + 8 + 2 * words]
                    at += 8 + 2 * words
                    if struct.unpack("<i", record[:4])[0] not in (3, 5):
                        continue
                    n_parts, n_points = struct.unpack("<ii", record[36:44])
                    starts = [*np.frombuffer(record, "<i4", n_parts, 44).tolist(), n_points]
                    xy = np.frombuffer(record, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2)
                    rings = [[{"lat": float(y), "lon": float(x)} for x, y in xy[i:j]] for i, j in zip(starts, starts[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n_parts), pa.array([number] * n_parts, pa.int32()), pa.array(range(n_parts), pa.int32()), pa.array(rings, pa.list_(point))], names=["file", "shape", "part", "ring"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, "file string, shape int, part int, ring array<struct<lat:double,lon:double>>")


# ---- databases: folders of parquet tables with a manifest


VERSION = 1


def save_database(tables: dict[str, DataFrame], path: str) -> None:
    """Write tables and a manifest of their names and the format's version."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(n, VERSION) for n in tables], "name string, version int").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def open_database(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a database by name; an error if its format is of another version."""
    manifest = spark.read.schema("name string, version int").json(f"{path}/manifest").collect()  # one row for each table
    if any(r["version"] != VERSION for r in manifest):
        raise ValueError(f"{path} was written in another format than version {VERSION}")
    return {r["name"]: spark.read.parquet(f"{path}/{r['name']}") for r in manifest}


def open_databases(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """Several databases as one set of tables with db_id, the place of their path in the list. A table that some of them lack, or a column, holds what the others have."""
    opened = [open_database(spark, p) for p in paths]
    names = dict.fromkeys(n for o in opened for n in o)
    union = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    return {n: reduce(union, [o[n].withColumn("db_id", F.lit(k)) for k, o in enumerate(opened) if n in o]) for n in names}


def write_tiles(rows: DataFrame, path: str) -> None:
    """A pyramid of rows with z, x and y, one folder a tile, so that a map reads only the tiles it shows."""
    rows.repartition("z", "x", "y").write.mode("overwrite").partitionBy("z", "x", "y").parquet(path)


def map_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, directory, size, version, time): entries of nested JSON lists of maps: folders have items (dir), maps a directory. Folders may lie in each other to any depth; one that is both gives a row and its items."""
    entry = "name string, directory string, size long, version int, timestamp long, dir string"
    level = spark.read.schema(entry).option("multiLine", True).json(path).withColumn("path", F.array("name"))
    items = F.from_json("dir", f"array<struct<{entry.replace(' ', ':').replace(',:', ',')}>>")
    rows = level.where(F.lit(False))
    while True:
        level = written(level)
        rows = rows.unionByName(level.where("directory is not null"))
        inner = level.where("dir is not null").select(F.col("path").alias("up"), F.explode(items).alias("e")).select("e.*", F.concat("up", F.array("e.name")).alias("path"))
        if level.where("dir is not null").isEmpty():
            break
        level = inner
    return rows.select(F.array_join("path", "/").alias("path"), "name", "directory", "size", "version", F.timestamp_seconds("timestamp").alias("time"))
