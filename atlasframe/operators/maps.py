"""What a map draws: styles, draw lists in order, labels and statistics as DataFrames; painting them is not a job for a cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..session import discard, written


def resolved_styles(objects: DataFrame, rules: DataFrame, zoom: int) -> DataFrame:
    """(obj_id, slot, attribute values): the style of each object (obj_id, type, oneway, size) at a zoom level.

    rules: (rule_no, slot, type, min_zoom, max_zoom, oneway, min_size, attributes: map). A rule without a type, direction or size applies to all. For each slot and
    attribute the last rule that applies and sets it wins. Rules are a style sheet, so a few thousand rows at most; they reach objects by their type.
    """
    now = rules.where((F.col("min_zoom") <= zoom) & (F.coalesce("max_zoom", F.lit(99)) >= zoom))
    rule = F.collect_list(F.struct("rule_no", "slot", "oneway", "min_size", F.map_entries("attributes").alias("sets")))
    listed = now.where("type is not null").groupBy("type").agg(rule.alias("typed"))
    general = now.where("type is null").groupBy().agg(rule.alias("general"))
    # The sheet goes to every task, and each object is styled within its row: objects aren't shuffled.
    rows = objects.select("obj_id", "type", "oneway", "size").join(F.broadcast(listed), "type", "left").crossJoin(F.broadcast(general))  # one row on the right side
    both = F.array_sort(F.concat("general", F.coalesce("typed", F.array().cast(dict(general.dtypes)["general"]))))
    fits = lambda r: (r["oneway"].isNull() | (r["oneway"] == F.col("oneway"))) & (r["min_size"].isNull() | (F.col("size") >= r["min_size"]))
    entries = F.flatten(F.transform(F.filter(both, fits), lambda r: F.transform(r["sets"], lambda e: F.struct(F.struct(r["slot"].alias("slot"), e["key"].alias("attribute")).alias("of"), e["value"].alias("value")))))
    rows = rows.select("obj_id", entries.alias("e"))
    last = F.transform(F.array_distinct(F.transform("e", lambda x: x["of"])), lambda k: F.struct(k["slot"].alias("slot"), k["attribute"].alias("attribute"), F.element_at(F.filter("e", lambda x: x["of"] == k), -1)["value"].alias("value")))
    return rows.select("obj_id", F.explode(last).alias("s")).select("obj_id", "s.*")


def types_at(rules: DataFrame, zoom: int) -> DataFrame:
    """(type): types that some rule draws at a zoom level."""
    return rules.where((F.col("min_zoom") <= zoom) & (F.coalesce("max_zoom", F.lit(99)) >= zoom) & F.col("type").isNotNull()).select("type").distinct()


def visible(objects: DataFrame, box: Column, zoom: int, least_pixels: float = 1.0) -> DataFrame:
    """objects (box) that meet a box and are larger than so many pixels in one direction."""
    pixel = 360.0 / (256 << zoom)
    b = F.col("box")
    return objects.where(geo.boxes_meet(b, box) & (((b["max_lat"] - b["min_lat"]) > least_pixels * pixel) | ((b["max_lon"] - b["min_lon"]) > least_pixels * pixel)))


def draw_list(lines: DataFrame, zoom: int, points: str = "points") -> DataFrame:
    """lines with pixels: array<struct<x, y>> at a zoom level."""
    return lines.withColumn("pixels", F.transform(points, lambda p: geo.mercator_pixel(p["lat"], p["lon"], zoom)))


def draw_order(areas: DataFrame, ways: DataFrame) -> DataFrame:
    """(kind, obj_id, rank): areas (obj_id, layer, size) by layer, then large ones first, below ways (obj_id, layer, priority) by layer, then priority. Ranks count within a map's objects."""
    a = areas.select(F.lit(0).alias("k"), F.lit("area").alias("kind"), "obj_id", "layer", (-F.col("size")).alias("by"))
    w = ways.select(F.lit(1).alias("k"), F.lit("way").alias("kind"), "obj_id", "layer", F.col("priority").cast("double").alias("by"))
    order = ("k", "layer", "by", "obj_id")
    # Ranges in order, each sorted by itself; a range's ranks begin after the rows of those before it.
    ranges = a.unionByName(w).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(ranges.select("kind", "obj_id", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")))
    sizes = rows.groupBy("range").count()  # one row for each range
    before = sizes.select("range", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "range").select("kind", "obj_id", (F.col("before") + F.col("at") + 1).cast("int").alias("rank"))


def in_tiles(nodes: DataFrame, zoom: int) -> DataFrame:
    """nodes with their web tile x, y, for writing a tile pyramid or reading single tiles."""
    t = geo.web_tile(F.col("lat"), F.col("lon"), zoom)
    return nodes.withColumns({"z": F.lit(zoom), "x": t["x"], "y": t["y"]})


def missing_tiles(wanted: DataFrame, loaded: DataFrame) -> DataFrame:
    """Tiles (z, x, y) that aren't loaded, with the nearest loaded parent's zoom, if any, whose data may fill in."""
    gone = wanted.join(loaded, ["z", "x", "y"], "left_anti")
    ups = gone.select("*", F.explode(F.sequence(F.lit(1), F.greatest(F.col("z"), F.lit(1)))).alias("up")).where("up <= z")
    keyed = ups.select("z", "x", "y", (F.col("z") - F.col("up")).alias("pz"), F.expr("shiftright(x, up)").alias("px"), F.expr("shiftright(y, up)").alias("py"))
    have = loaded.select(F.col("z").alias("pz"), F.col("x").alias("px"), F.col("y").alias("py"))
    parent = keyed.join(have, ["pz", "px", "py"]).groupBy("z", "x", "y").agg(F.max("pz").alias("parent_z"))
    return gone.join(parent, ["z", "x", "y"], "left")


def ground_tiles(box: DataFrame, level: int, stored: DataFrame, default: str = "unknown") -> DataFrame:
    """(x, y, state) of all tiles of one box row (min_lat, ...), from stored ones or the default."""
    b = F.struct("min_lat", "min_lon", "max_lat", "max_lon")
    cells = box.select(F.explode(geo.tiles_of_box(b, level)).alias("t")).select("t.x", "t.y")
    return cells.join(stored, ["x", "y"], "left").select("x", "y", F.coalesce("state", F.lit(default)).alias("state"))


#: Cells, in pixels, in which labels look for those that they may meet.
LABEL_CELL = (128, 32)


def placed_labels(labels: DataFrame, cell: tuple[int, int] = LABEL_CELL) -> DataFrame:
    """(tile, obj_id, x, y): labels (tile, obj_id, priority, x, y, width, height in pixels) that find a free place, the most important (smallest priority, then obj_id, y, x) first.

    A label is dropped if its rectangle meets one that stands; so the result is that of placing one after the other. It is found in rounds: a label that comes
    first among the undecided ones in every cell it covers stands, as whatever it could meet shares a cell with it; what meets it goes. Neither step
    pairs labels with each other: a cell gives its first label, and at most one label of a cell stands in a round, so a tile of any number of labels is spread over its cells.
    Rectangles begin at whole pixels, at 0 at least, and are one pixel wide and high at least. Repeated rows count once; rows with a null have no place.
    """
    w, h = cell
    left = F.greatest(F.lit(0), F.floor("x")).cast("long")
    known = labels.select("tile", "obj_id", "priority", "x", "y", "width", "height").dropna()
    sized = known.select("tile", "obj_id", "priority", left.alias("x"), F.floor("y").cast("long").alias("y"), F.greatest(F.lit(1), F.floor("width")).cast("long").alias("width"), F.greatest(F.lit(1), F.floor("height")).cast("long").alias("height"))
    key = ["tile", "priority", "obj_id", "y", "x", "width", "height"]
    first = F.struct(*key[1:])
    span = lambda at, size, unit: F.sequence(F.floor(F.col(at) / unit), F.floor((F.col(at) + F.col(size) - 1) / unit))
    cells = F.flatten(F.transform(span("x", "width", w), lambda a: F.transform(span("y", "height", h), lambda b: F.struct(a.alias("cx"), b.alias("cy")))))
    over = lambda rows: rows.select("*", F.explode(cells).alias("c")).select(*key, "c.cx", "c.cy")
    left_over = written(sized.distinct())
    standing = []
    while not left_over.isEmpty():
        covering = over(left_over)
        # By cell the label that comes first, and by label the cells in which it does.
        heads = covering.groupBy("tile", "cx", "cy").agg(F.min(first).alias("m")).groupBy("tile", "m").count().select("tile", "m.*", "count")
        stands = written(heads.where(F.col("count") == F.size(cells)).select(*key))
        taken = over(stands).select("tile", "cx", "cy", *[F.col(c).alias(f"s_{c}") for c in ("x", "y", "width", "height")])
        apart = (F.col("x") >= F.col("s_x") + F.col("s_width")) | (F.col("s_x") >= F.col("x") + F.col("width")) | (F.col("y") >= F.col("s_y") + F.col("s_height")) | (F.col("s_y") >= F.col("y") + F.col("height"))
        gone = covering.join(taken, ["tile", "cx", "cy"]).where(~apart).select(*key).distinct()  # what stands meets itself
        before, left_over = left_over, written(left_over.join(gone, key, "left_anti"))
        discard(before)
        standing.append(stands)
    found = sized.select("tile", "obj_id", "x", "y").where(F.lit(False))
    for part in standing:
        found = found.unionByName(part.select("tile", "obj_id", "x", "y"))
    return found


def painter_statistics(objects: DataFrame) -> DataFrame:
    """(type, nodes, ways, areas, labels, total), most first."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return objects.groupBy("type").agg(n("node").alias("nodes"), n("way").alias("ways"), n("area").alias("areas"), F.count_if(F.col("name").isNotNull()).alias("labels"), F.count("*").alias("total"))


def label_text(*candidates: str) -> Column:
    """The first of several columns with a text."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in candidates])


def best_object_at(found: DataFrame) -> DataFrame:
    """(place, obj_id): of candidates (place, obj_id, kind, inside, distance, size, name) the one a user means: named before nameless, node before way before area, near before far, small before large."""
    order = F.struct(F.col("name").isNull().alias("nameless"), F.when(F.col("kind") == "node", 0).when(F.col("kind") == "way", 1).otherwise(2).alias("k"), "distance", "size", "obj_id")
    return found.groupBy("place").agg(F.min(order).alias("b")).select("place", "b.obj_id")
