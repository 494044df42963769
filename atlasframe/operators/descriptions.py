"""What a route says: each function adds columns to the nodes of routes, so that they chain with DataFrame.transform.

route rows: (route, idx, node_id, lat, lon, way_id, name, ref, type, maxspeed, oneway); way columns tell of the way that leaves the
node and are null at the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import final_bearing, initial_bearing, relative_angle, spherical_distance
from ..functions.shapes import nearest_on_segment

#: The bounds of turns in degrees.
STRAIGHT, SLIGHT, TURN = 10.0, 45.0, 120.0
#: For curves: degrees at which one may begin, degrees that a further node must add, metres between its nodes and in all.
CURVE_FROM, CURVE_TO, CURVE_ADD, CURVE_STEP, CURVE_MOST = 5.0, 10.0, 5.0, 20.0, 300.0


def _along():
    return Window.partitionBy("route").orderBy("idx")


def _so_far():
    return _along().rowsBetween(Window.unboundedPreceding, 0)


def start_and_target(route: DataFrame) -> DataFrame:
    """is_start, is_target."""
    return route.withColumns({"is_start": F.lag("idx").over(_along()).isNull(), "is_target": F.lead("idx").over(_along()).isNull()})


def distance_and_time(route: DataFrame, speed: Column) -> DataFrame:
    """distance (metres) and time (seconds) from the start, at the speed (km/h) of the way that led here."""
    step = F.coalesce(spherical_distance(F.lag("lat").over(_along()), F.lag("lon").over(_along()), F.col("lat"), F.col("lon")), F.lit(0.0))
    timed = route.withColumns({"af_step": step, "af_speed": speed}).withColumn("af_time", F.coalesce(F.col("af_step") / (F.lag("af_speed").over(_along()) / 3.6), F.lit(0.0)))
    return timed.withColumns({"distance": F.sum("af_step").over(_so_far()), "time": F.sum("af_time").over(_so_far())}).drop("af_step", "af_speed", "af_time")


def way_changes(route: DataFrame) -> DataFrame:
    """changed_name, changed_type and changed_maxspeed: the new value where it differs from the one before, null where it stays. A name that only toggles between name and reference doesn't change."""
    same = lambda c: F.lag(c).over(_along()).eqNullSafe(F.col(c))
    inner = F.lag("idx").over(_along()).isNotNull() & F.col("way_id").isNotNull()
    renamed = inner & ~same("name") & ~same("ref")
    return route.withColumns({"changed_name": F.when(renamed, F.coalesce("name", "ref")), "changed_type": F.when(inner & ~same("type"), F.col("type")), "changed_maxspeed": F.when(inner & ~same("maxspeed"), F.col("maxspeed"))})


def move(angle: Column) -> Column:
    """A turn's name by its angle, right is positive."""
    side = lambda left, right: F.when(angle < 0, left).otherwise(right)
    size = F.abs(angle)
    return F.when(size <= STRAIGHT, "straight on").when(size <= SLIGHT, side("slightly left", "slightly right")).when(size <= TURN, side("left", "right")).otherwise(side("sharp left", "sharp right"))


def directions(route: DataFrame) -> DataFrame:
    """turn_angle, curve_angle and turn at inner nodes: the change of bearing at the node; a small turn that goes on in the same direction over near nodes counts as one curve.

    The curve is a fold over the nodes that follow within CURVE_MOST metres, gathered by a range window.
    """
    here = lambda c: F.col(c)
    before, after = lambda c: F.lag(c).over(_along()), lambda c: F.lead(c).over(_along())
    came = final_bearing(before("lat"), before("lon"), here("lat"), here("lon"))
    goes = initial_bearing(here("lat"), here("lon"), after("lat"), after("lon"))
    step = F.coalesce(spherical_distance(before("lat"), before("lon"), here("lat"), here("lon")), F.lit(0.0))
    marked = route.withColumns({"af_in": came, "af_out": goes, "af_step": step}).withColumn("af_turn", relative_angle(F.col("af_out") - F.col("af_in")))
    marked = marked.withColumn("af_at", F.sum("af_step").over(_so_far()))
    ahead = F.collect_list(F.struct(F.col("af_step").alias("step"), F.col("af_out").alias("out"))).over(Window.partitionBy("route").orderBy((F.col("af_at") * 1000).cast("long")).rangeBetween(Window.currentRow, int(CURVE_MOST * 1000)))
    start = F.struct(F.col("af_out").alias("bearing"), F.lit(True).alias("going"), F.lit(0).alias("n"))

    def add(acc: Column, x: Column) -> Column:
        more = relative_angle(x["out"] - acc["bearing"])
        # The first entry is the node itself; the first one after it begins the curve, those behind must be near.
        keeps = acc["going"] & x["out"].isNotNull() & ((acc["n"] <= 1) | (x["step"] <= CURVE_STEP)) & (F.abs(more) >= CURVE_ADD) & (F.signum(more) == F.signum(F.col("af_turn")))
        first = acc["n"] == 0
        return F.struct(F.when(~first & keeps, x["out"]).otherwise(acc["bearing"]).alias("bearing"), (first | F.coalesce(keeps, F.lit(False))).alias("going"), (acc["n"] + 1).alias("n"))

    curved = marked.withColumn("af_curve", F.aggregate(ahead, start, add, lambda acc: acc["bearing"]))
    small = F.abs("af_turn").between(CURVE_FROM, CURVE_TO)
    angle = F.when(small, relative_angle(F.col("af_curve") - F.col("af_in"))).otherwise(F.col("af_turn"))
    return curved.withColumns({"turn_angle": F.col("af_turn"), "curve_angle": angle, "turn": F.when(F.col("af_turn").isNotNull(), move(angle))}).drop("af_in", "af_out", "af_step", "af_turn", "af_at", "af_curve")


def exits(route: DataFrame, graph: DataFrame) -> DataFrame:
    """n_exits: how many edges (from_id, to_id) leave the node, other than back where the route came from."""
    came = route.select("route", "idx", "node_id", F.lag("node_id").over(_along()).alias("came"))
    out = came.join(graph.select(F.col("from_id").alias("node_id"), "to_id").distinct(), "node_id").where(~F.col("to_id").eqNullSafe(F.col("came")))
    return route.join(out.groupBy("route", "idx").agg(F.count("*").alias("n_exits")), ["route", "idx"], "left").withColumn("n_exits", F.coalesce("n_exits", F.lit(0)))


def crossing_ways(route: DataFrame, node_ways: DataFrame) -> DataFrame:
    """crossing: the ways (node_id, way_ids) at the node that the route doesn't use there, sorted."""
    joined = route.join(node_ways, "node_id", "left").withColumn("af_before", F.lag("way_id").over(_along()))
    return joined.withColumn("crossing", F.array_except(F.coalesce("way_ids", F.array().cast("array<bigint>")), F.array_compact(F.array("way_id", "af_before")))).drop("way_ids", "af_before")


def motorways(route: DataFrame, types: tuple[str, ...] = ("motorway", "trunk")) -> DataFrame:
    """motorway: enter, change or leave where the route does; change is from one of another reference or name to the next."""
    on = F.coalesce(F.col("type").isin(*types), F.lit(False))
    was = F.coalesce(F.lag("type").over(_along()).isin(*types), F.lit(False))
    renamed = ~F.coalesce("ref", "name").eqNullSafe(F.coalesce(F.lag("ref").over(_along()), F.lag("name").over(_along())))
    return route.withColumn("motorway", F.when(on & ~was, "enter").when(was & ~on, "leave").when(on & was & renamed, "change"))


def roundabouts(route: DataFrame) -> DataFrame:
    """roundabout: enter, leave (with roundabout_exit, the exit's number) or null; route has in_roundabout and n_exits.

    Stretches in a roundabout are islands of equal flags; exits are counted within one.
    """
    inside = F.coalesce("in_roundabout", F.lit(False))
    was = F.coalesce(F.lag("in_roundabout").over(_along()), F.lit(False))
    marked = route.withColumns({"af_on": inside, "af_was": was}).withColumn("af_no", F.sum((F.col("af_on") & ~F.col("af_was")).cast("int")).over(_so_far()))
    passed = F.sum(F.when(F.col("af_was") & (F.col("n_exits") > 1), 1).otherwise(0)).over(Window.partitionBy("route", "af_no").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    counted = marked.withColumn("af_passed", passed)
    return counted.withColumns({"roundabout": F.when(F.col("af_on") & ~F.col("af_was"), "enter").when(F.col("af_was") & ~F.col("af_on"), "leave"), "roundabout_exit": F.when(F.col("af_was") & ~F.col("af_on"), F.col("af_passed"))}).drop("af_on", "af_was", "af_no", "af_passed")


def sections(route: DataFrame, via: Column) -> DataFrame:
    """section: counts from 0 and grows at each node that via marks."""
    return route.withColumn("section", F.sum(F.when(via, 1).otherwise(0)).over(_so_far()))


#: Which turns of a lane suit which move.
LANES_FOR = {
    "left": ("left", "slight_left", "through;left"), "sharp left": ("left", "sharp_left", "through;sharp_left"), "slightly left": ("slight_left", "left", "merge_to_left", "through;slight_left", "through;left"),
    "right": ("right", "slight_right", "through;right"), "sharp right": ("right", "sharp_right", "through;sharp_right"), "slightly right": ("slight_right", "right", "merge_to_right", "through;slight_right", "through;right"),
    "straight on": ("through", "none", "through;left", "through;right", "through;slight_left", "through;slight_right", "through;sharp_left", "through;sharp_right"),
}


def suggested_lanes(route: DataFrame) -> DataFrame:
    """lane_from and lane_to (from 0, left to right): the run of lanes that suit the next turn; route has lane_turns (array) and turn. Null where no lane suits."""
    fits = F.create_map(*[x for k, v in LANES_FOR.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    next_turn = F.coalesce(F.lead("turn").over(_along()), F.lit("straight on"))
    places = F.filter(F.transform("lane_turns", lambda t, i: F.when(F.array_contains(F.element_at(fits, F.col("af_next")), t), i)), lambda i: i.isNotNull())
    return route.withColumn("af_next", next_turn).withColumns({"lane_from": F.array_min(places), "lane_to": F.array_max(places)}).drop("af_next")


def pois_at_route(route: DataFrame, pois: DataFrame, most: float = 30.0) -> DataFrame:
    """(route, poi_id, idx, distance): each place (poi_id, lat, lon) nearer than most metres to a node of a route, at its nearest node."""
    from .spatial import near_pairs

    keyed = route.select(F.struct("route", "idx").alias("key"), "lat", "lon")
    near = near_pairs(keyed, pois.withColumnRenamed("poi_id", "obj_id"), most, 16)
    best = near.groupBy("key.route", "obj_id").agg(F.min(F.struct("distance", F.col("key.idx").alias("idx"))).alias("b"))
    return best.select("route", F.col("obj_id").alias("poi_id"), "b.idx", "b.distance")


def instructions(route: DataFrame) -> DataFrame:
    """instruction: what is told at the node, if anything; needs the columns of start_and_target, way_changes, directions, motorways and roundabouts.

    Roundabouts and motorways come before turns. A slight turn is not told where name and reference stay, nor any turn where there is no other exit.
    """
    minor = F.col("turn").isin("straight on", "slightly left", "slightly right")
    silent = (minor & F.col("changed_name").isNull()) | (F.col("n_exits") <= 1)
    turned = F.when(F.col("turn").isNotNull() & ~silent, F.concat(F.lit("turn "), F.col("turn"), F.coalesce(F.concat(F.lit(" into "), F.col("changed_name")), F.lit(""))))
    text = (
        F.when(F.col("is_start"), F.concat(F.lit("start"), F.coalesce(F.concat(F.lit(" at "), F.coalesce("name", "ref")), F.lit(""))))
        .when(F.col("is_target"), "target reached")
        .when(F.col("roundabout") == "enter", "enter roundabout")
        .when(F.col("roundabout") == "leave", F.concat(F.lit("leave roundabout at exit "), F.col("roundabout_exit").cast("string")))
        .when(F.col("motorway").isNotNull(), F.concat(F.col("motorway"), F.lit(" motorway"), F.coalesce(F.concat(F.lit(" "), F.coalesce("ref", "name")), F.lit(""))))
        .otherwise(F.coalesce(turned, F.concat(F.lit("way changes into "), F.col("changed_name"))))
    )
    return route.withColumn("instruction", text)


def as_json(route: DataFrame) -> DataFrame:
    """(route, json): all nodes of a route in order as one document."""
    fields = [c for c in route.columns if c != "route"]
    return route.groupBy("route").agg(F.to_json(F.array_sort(F.collect_list(F.struct("idx", *[c for c in fields if c != "idx"])))).alias("json"))


# ---- what a position on a route tells


def arrival(positions: DataFrame, route: DataFrame) -> DataFrame:
    """positions with remaining (metres) and arrival: from the node passed last and the way to the next one.

    positions: (route, idx, ts, lat, lon), idx the node passed last. route: (route, idx, lat, lon, distance, hours), summed from the start. Positions at a
    last node, or farther from their node than the next one is, are left out.
    """
    nodes = route.select("route", "idx", F.struct("lat", "lon").alias("af_node"), F.col("distance").alias("af_far"), F.col("hours").alias("af_hours"), F.lead(F.struct("lat", "lon", "hours")).over(_along()).alias("af_next"))
    ends = route.groupBy("route").agg(F.max_by(F.struct("distance", "hours"), "idx").alias("af_end"))
    x = positions.join(nodes, ["route", "idx"]).join(ends, "route").where("af_next is not null")
    gone = spherical_distance(F.col("af_node.lat"), F.col("af_node.lon"), F.col("lat"), F.col("lon"))
    between = spherical_distance(F.col("af_node.lat"), F.col("af_node.lon"), F.col("af_next.lat"), F.col("af_next.lon"))
    x = x.withColumns({"af_gone": gone, "af_between": between}).where("af_gone <= af_between")
    left = F.when(F.col("af_between") == 0, 0.0).otherwise(1 - F.col("af_gone") / F.col("af_between"))
    hours = (F.col("af_next.hours") - F.col("af_hours")) * left + F.col("af_end.hours") - F.col("af_next.hours")
    remaining = F.col("af_end.distance") - F.col("af_far") - F.col("af_gone")
    arrives = F.timestamp_micros(F.unix_micros("ts") + F.floor(hours * 3_600_000_000).cast("long"))
    x = x.withColumns({"remaining": remaining, "arrival": arrives}).where("remaining >= 0")
    return x.select(*[F.col(f"`{c}`") for c in positions.columns], "remaining", "arrival")


def lane_changes(route: DataFrame) -> DataFrame:
    """(route, idx, lanes): nodes from which on the lanes (any struct or text) differ from those before; the first node with lanes counts as one."""
    return route.withColumn("af_was", F.lag("lanes").over(_along())).where(~F.col("lanes").eqNullSafe(F.col("af_was"))).select("route", "idx", "lanes")


def matched_positions(positions: DataFrame, route: DataFrame, most: float, level: int = 14) -> DataFrame:
    """positions (route, key, lat, lon) with idx, at_lat, at_lon and distance: the closest place on the own route's segments, idx the node before it; null beyond most metres (off the route).

    A segment lies in all tiles that come within most metres of its box, so a position asks its own tile alone and meets each segment once; the best place of
    each is kept before the shuffle. level suits the length of segments.
    """
    node = F.struct("lat", "lon")
    parts = route.select("route", "idx", node.alias("a"), F.lead(node).over(_along()).alias("b")).where("b is not null")
    # A little wider than asked for, as a circle's box at one end is narrower than where it lies nearer to a pole.
    around = lambda end: geo.box_around(F.col(f"{end}.lat"), F.col(f"{end}.lon"), F.lit(1.02 * most + 1))
    reach = geo.box_or(around("a"), around("b"))
    placed = parts.select("route", "idx", F.struct("a", "b").alias("part"), F.explode(geo.tiles_of_box(reach, level)).alias("tile"))
    asked = positions.select("route", "key", node.alias("p"), geo.tile(F.col("lat"), F.col("lon"), level).alias("tile"))
    met = asked.join(placed, ["route", "tile"]).withColumn("at", nearest_on_segment(F.col("p"), F.col("part"))).where("at.lat is not null")
    far = spherical_distance(F.col("p.lat"), F.col("p.lon"), F.col("at.lat"), F.col("at.lon"))
    best = met.withColumn("distance", far).where(F.col("distance") <= most).groupBy("route", "key").agg(F.min(F.struct("distance", "idx", "at")).alias("m"))
    found = best.select("route", "key", "m.idx", F.col("m.at.lat").alias("at_lat"), F.col("m.at.lon").alias("at_lon"), "m.distance")
    return positions.join(found, ["route", "key"], "left")


def next_instructions(positions: DataFrame, told: DataFrame) -> DataFrame:
    """(route, key, at, next_at, instruction): each position (route, key, at) that changes what is told next, the first of told (route, at, instruction) beyond it; null behind the last one."""
    nothing = F.lit(None)
    rows = positions.select("route", "at", F.lit(1).alias("side"), "key", nothing.cast("string").alias("text"))
    rows = rows.unionByName(told.select("route", "at", F.lit(0).alias("side"), nothing.cast(dict(positions.dtypes)["key"]).alias("key"), F.col("instruction").alias("text")))
    # What stands where a position is has been passed.
    ahead = Window.partitionBy("route").orderBy("at", "side", "key").rowsBetween(1, Window.unboundedFollowing)
    coming = F.first(F.when(F.col("side") == 0, F.struct("at", "text")), True).over(ahead)
    along = Window.partitionBy("route").orderBy("at", "key")
    seen = rows.withColumn("next", coming).where("side = 1")
    seen = seen.withColumns({"was": F.lag("next").over(along), "no": F.row_number().over(along)})
    return seen.where((F.col("no") == 1) | ~F.col("next").eqNullSafe(F.col("was"))).select("route", "key", "at", F.col("next.at").alias("next_at"), F.col("next.text").alias("instruction"))


def points_of_parts(parts: DataFrame, way_points: DataFrame) -> DataFrame:
    """(route, pos, no, node_id, lat, lon): all points of a route's parts (route, pos, way_id, first, last), each a run of a way's points in either direction; a point that ends one part and begins the next stands once."""
    met = way_points.join(parts, "way_id").where(F.col("idx").between(F.least("first", "last"), F.greatest("first", "last")))
    met = met.withColumn("no", F.abs(F.col("idx") - F.col("first"))).where("no > 0 or pos = 0")
    return met.select("route", "pos", "no", "node_id", "lat", "lon")
