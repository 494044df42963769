"""The road graph and paths on it.

way_points (way_id, idx, node_id, lat, lon) become junctions and directed edges (from_id, to_id, way_id, metres, ...);
paths come from rounds of joins that relax a frontier, so the graph is never on one machine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import spherical_distance
from ..session import discard, written

#: km/h by type and vehicle; 0 can't be used.
SPEEDS = {
    "car": {"motorway": 110.0, "primary": 70.0, "secondary": 60.0, "residential": 40.0, "track": 0.0},
    "bicycle": {"motorway": 0.0, "primary": 20.0, "secondary": 20.0, "residential": 18.0, "track": 14.0},
    "foot": {"motorway": 0.0, "primary": 5.0, "secondary": 5.0, "residential": 5.0, "track": 5.0},
}
VEHICLE_BITS = {"foot": 1, "bicycle": 2, "car": 4}
VEHICLE_MAX = {"car": 160.0, "bicycle": 20.0, "foot": 5.0}
#: Metres that stand for a junction between ways of one type, and of two; the most hours it may cost.
PENALTY_SAME, PENALTY_OTHER, PENALTY_MOST = 40.0, 250.0, 10.0 / 3600
#: Hours that turning round at the start costs.
U_TURN = {"car": 15.0 / 60, "bicycle": 1.0 / 60, "foot": 0.0}


def junctions(way_points: DataFrame) -> DataFrame:
    """(node_id, n_ways): nodes of two ways or more, each way counted once."""
    return way_points.select("node_id", "way_id").distinct().groupBy("node_id").agg(F.count("*").alias("n_ways")).where("n_ways >= 2")


def junction_objects(way_points: DataFrame) -> DataFrame:
    """(node_id, way_ids): the ways at each junction, sorted."""
    groups = way_points.groupBy("node_id").agg(F.array_sort(F.collect_set("way_id")).alias("way_ids"))
    return groups.where(F.size("way_ids") >= 2)


def edges(way_points: DataFrame, ways: DataFrame) -> DataFrame:
    """(from_id, to_id, way_id, metres, type, maxspeed, grade): along each way from one route node to the next, both ways unless it is one-way. Route nodes are junctions and the ways' ends; metres are spherical."""
    along = Window.partitionBy("way_id").orderBy("idx")
    step = F.coalesce(spherical_distance(F.lag("lat").over(along), F.lag("lon").over(along), F.col("lat"), F.col("lon")), F.lit(0.0))
    measured = way_points.withColumns({"step": step, "end": F.lead("idx").over(along).isNull()}).withColumn("at", F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    kept = measured.join(junctions(way_points).select("node_id", F.lit(True).alias("shared")), "node_id", "left").where("shared or idx = 0 or end")
    nodes = kept.select("way_id", F.col("node_id").alias("from_id"), F.lead("node_id").over(along).alias("to_id"), (F.lead("at").over(along) - F.col("at")).alias("metres")).where("to_id is not null and from_id <> to_id")
    whole = nodes.join(ways.select("way_id", "type", "oneway", "maxspeed", "grade"), "way_id")
    back = whole.where("not oneway").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "way_id", "metres", "type", "maxspeed", "grade")
    return whole.select("from_id", "to_id", "way_id", "metres", "type", "maxspeed", "grade").unionByName(back)


def ring_edges(ring_points: DataFrame, route_nodes: DataFrame) -> DataFrame:
    """(obj_id, from_id, to_id, metres): from each route node (node_id) of a closed line to the next one around it, for roundabouts and areas one may cross along their edge.

    ring_points: (obj_id, idx, node_id, lat, lon), the first point not repeated at the end. A line with one route node only has no edge.
    """
    around = Window.partitionBy("obj_id").orderBy("idx")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here, first = F.struct("lat", "lon"), F.first(F.struct("lat", "lon")).over(whole)
    measured = ring_points.withColumn("next", F.coalesce(F.lead(here).over(around), first)).withColumn("step", spherical_distance(F.col("lat"), F.col("lon"), F.col("next.lat"), F.col("next.lon")))
    measured = measured.withColumns({"total": F.sum("step").over(whole), "at": F.sum("step").over(around.rowsBetween(Window.unboundedPreceding, 0)) - F.col("step")})
    kept = measured.join(route_nodes.select("node_id").distinct(), "node_id")
    to = F.struct(F.col("node_id").alias("id"), F.col("at").alias("at"))
    closed = F.struct(F.first("node_id").over(whole).alias("id"), (F.first("at").over(whole) + F.col("total")).alias("at"))
    found = kept.withColumn("to", F.coalesce(F.lead(to).over(around), closed))
    return found.select("obj_id", F.col("node_id").alias("from_id"), F.col("to.id").alias("to_id"), (F.col("to.at") - F.col("at")).alias("metres")).where("from_id <> to_id")


def vehicle_mask(kind: Column, maxspeed: Column) -> Column:
    """Which vehicles may use a way: 1 on foot, 2 bicycle, 4 car, added up."""
    return sum((F.when(speed(v, kind, maxspeed) > 0, bit).otherwise(0) for v, bit in VEHICLE_BITS.items()), F.lit(0))


def speed(vehicle: str, kind: Column, maxspeed: Column) -> Column:
    """km/h on a way: the vehicle's for the type, at most what is allowed; 0 can't be used."""
    table = F.create_map(*[F.lit(x) for kv in SPEEDS[vehicle].items() for x in kv])
    own = F.coalesce(F.try_element_at(table, kind), F.lit(0.0))
    return F.least(own, F.when(maxspeed > 0, maxspeed.cast("double")).otherwise(own))


def usable(edge_rows: DataFrame, vehicle: str) -> DataFrame:
    """Edges that a vehicle may use."""
    return edge_rows.where(speed(vehicle, F.col("type"), F.col("maxspeed")) > 0)


def shortest_cost() -> Column:
    """Kilometres."""
    return F.col("metres") / 1000


def fastest_cost(vehicle: str) -> Column:
    """Hours without junctions."""
    return F.col("metres") / 1000 / F.least(F.lit(VEHICLE_MAX[vehicle]), speed(vehicle, F.col("type"), F.col("maxspeed")))


def junction_penalty(vehicle: str, type_in: Column, max_in: Column, type_out: Column, max_out: Column) -> Column:
    """Hours that a change of ways costs."""
    slow = F.least(speed(vehicle, type_in, max_in), speed(vehicle, type_out, max_out))
    return F.least(F.when(type_in != type_out, PENALTY_OTHER).otherwise(PENALTY_SAME) / 1000 / F.nullif(slow, F.lit(0.0)), F.lit(PENALTY_MOST))


def cost_limit(airline_km: Column, cost_per_km: float, least_km: float = 10.0, factor: float = 5.0) -> Column:
    """Beyond which cost a search gives up: that of least_km, and factor times that of the straight line."""
    return (least_km + factor * airline_km) * cost_per_km


def excluded_turns(restrictions: DataFrame, graph: DataFrame) -> DataFrame:
    """(via_id, from_way, to_way): turns that may not be taken.

    restrictions: (via_id, from_way, to_way, kind). forbid bars that turn; allow bars all other ways out of the node from that way.
    """
    forbid = restrictions.where("kind = 'forbid'").select("via_id", "from_way", "to_way")
    out = graph.select(F.col("from_id").alias("via_id"), F.col("way_id").alias("out_way")).distinct()
    allow = restrictions.where("kind = 'allow'").join(out, "via_id")
    other = allow.groupBy("via_id", "from_way", "out_way").agg(F.max((F.col("out_way") == F.col("to_way")).cast("int")).alias("ok")).where("ok = 0 and out_way <> from_way")
    return forbid.unionByName(other.select("via_id", "from_way", F.col("out_way").alias("to_way"))).distinct()


def turns(graph: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(from_edge, to_edge, ...): pairs of edges that follow each other, but for those back to the node before and excluded ones. graph has edge_id."""
    side = lambda at, edge, way, other, end: graph.select(F.col(at).alias("via_id"), F.col("edge_id").alias(edge), F.col("way_id").alias(way), F.col(other).alias(end), *[F.col(c).alias(f"{c}_{end}") for c in graph.columns if c in ("type", "maxspeed", "cost", "restricted")])
    pairs = side("to_id", "from_edge", "from_way", "from_id", "came").join(side("from_id", "to_edge", "to_way", "to_id", "goes"), "via_id").where("came <> goes")
    if excluded is not None:
        pairs = pairs.join(excluded, ["via_id", "from_way", "to_way"], "left_anti")
    return pairs


def _state(edge: Column, leaving: Column) -> Column:
    return F.struct(edge.alias("edge"), leaving.alias("leaving"))


def turn_graph(graph: DataFrame, vehicle: str | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """(from_id, to_id, cost): turns as a graph for costs_from whose nodes are states (edge, leaving).

    graph: (edge_id, from_id, to_id, way_id, type, maxspeed, cost, restricted). A cost is that of the edge after the turn
    and, with a vehicle, of the change of ways in hours. Whoever enters a restricted edge from an open one stays on
    restricted ones; leaving is true on the restricted edges that a search has begun on and not yet left.
    """
    pairs = turns(graph, excluded)
    change = F.lit(0.0)
    if vehicle is not None:
        change = F.when(F.col("from_way") == F.col("to_way"), 0.0).otherwise(F.coalesce(junction_penalty(vehicle, F.col("type_came"), F.col("maxspeed_came"), F.col("type_goes"), F.col("maxspeed_goes")), F.lit(PENALTY_MOST)))
    ways_on = F.when(~F.col("restricted_came"), F.array(F.lit(False))).when(F.col("restricted_goes"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))
    steps = pairs.select("from_edge", "to_edge", "restricted_goes", (change + F.col("cost_goes")).alias("cost"), F.explode(ways_on).alias("leaving"))
    return steps.select(_state(F.col("from_edge"), F.col("leaving")).alias("from_id"), _state(F.col("to_edge"), F.col("leaving") & F.col("restricted_goes")).alias("to_id"), "cost")


def start_states(starts: DataFrame, graph: DataFrame, vehicle: str | None = None) -> DataFrame:
    """(source, node_id, cost) for costs_from over a turn_graph.

    starts: (source, edge_id, share, turned): a place on an edge, by the share of it that lies behind, for each direction in
    which the search may set out; where turned is true this means turning round, which costs a vehicle some hours.
    """
    rest = (1 - F.col("share")) * F.col("cost") + F.when(F.col("turned"), U_TURN[vehicle] if vehicle else 0.0).otherwise(0.0)
    return starts.join(graph.select("edge_id", "cost", "restricted"), "edge_id").select("source", _state(F.col("edge_id"), F.col("restricted")).alias("node_id"), rest.alias("cost"))


def node_costs(state_costs: DataFrame, graph: DataFrame) -> DataFrame:
    """(source, node_id, cost): the least cost to each node at the end of an edge, from costs_from over a turn_graph."""
    ends = graph.select(F.col("edge_id").alias("edge"), F.col("to_id").alias("at_id"))
    return state_costs.withColumn("edge", F.col("node_id.edge")).join(ends, "edge").groupBy("source", F.col("at_id").alias("node_id")).agg(F.min("cost").alias("cost"))


def costs_to_places(targets: DataFrame, starts: DataFrame, state_costs: DataFrame, graph: DataFrame, steps: DataFrame) -> DataFrame:
    """(source, target, cost): the least cost to places (target, edge_id, share) on edges, from costs_from over the turn_graph steps; starts as for start_states."""
    ends = targets.join(graph.select("edge_id", F.col("cost").alias("whole")), "edge_id")
    into = steps.select(F.col("from_id").alias("node_id"), F.col("to_id.edge").alias("edge_id"), F.col("cost").alias("step")).join(ends, "edge_id")
    by_turn = state_costs.join(into, "node_id").select("source", "target", (F.col("cost") + F.col("step") - (1 - F.col("share")) * F.col("whole")).alias("cost"))
    ahead = starts.where("not turned").select("source", "edge_id", F.col("share").alias("behind")).join(ends, "edge_id").where("behind <= share")
    at_once = ahead.select("source", "target", ((F.col("share") - F.col("behind")) * F.col("whole")).alias("cost"))
    return by_turn.unionByName(at_once).groupBy("source", "target").agg(F.min("cost").alias("cost"))


def costs_from(sources: DataFrame, graph: DataFrame, limit: float | None = None) -> DataFrame:
    """(source, node_id, cost, hops, prev_id): the least cost from each source (source, node_id, and a cost to begin with if there is one) to every node it reaches.

    graph: (from_id, to_id, cost), costs not negative. Each round joins only nodes whose cost fell in the round before with their edges and keeps the least
    cost of each node; it ends when no cost falls. Every round is a written table, which the next one replaces. Ties go to the smaller predecessor.
    """
    lightest = graph.groupBy("from_id", "to_id").agg(F.min("cost").alias("cost"))
    lightest = written(lightest)
    none = F.lit(None).cast(dict(graph.dtypes)["from_id"])
    begun = F.min("cost") if "cost" in sources.columns else F.lit(0.0)
    first = sources.groupBy("source", "node_id").agg(begun.alias("cost"))
    if limit is not None:
        first = first.where(F.col("cost") <= limit)
    now = written(first.select("source", "node_id", "cost", F.lit(0).alias("hops"), none.alias("prev_id"), F.lit(True).alias("fresh")))
    while True:
        moved = now.where("fresh").select("source", F.col("node_id").alias("from_id"), F.col("cost").alias("c0"), F.col("hops").alias("h0")).join(lightest, "from_id")
        new = moved.select("source", F.col("to_id").alias("node_id"), (F.col("c0") + F.col("cost")).alias("cost"), (F.col("h0") + 1).alias("hops"), F.col("from_id").alias("prev_id"), F.lit(True).alias("fresh"))
        if limit is not None:
            new = new.where(F.col("cost") <= limit)
        both = now.withColumn("fresh", F.lit(False)).unionByName(new)
        # An old row wins a tie against a new one (false sorts first), so nothing moves without need.
        best = both.groupBy("source", "node_id").agg(F.min(F.struct("cost", "fresh", "prev_id", "hops")).alias("b"))
        before, now = now, written(best.select("source", "node_id", "b.cost", "b.hops", "b.prev_id", "b.fresh"))
        discard(before)
        if now.where("fresh").isEmpty():
            break
    return now.select("source", "node_id", "cost", "hops", "prev_id")


def landmark_costs(landmarks: DataFrame, graph: DataFrame, limit: float | None = None) -> DataFrame:
    """(node_id, away, back): for each node the costs from the landmarks (node_id) to it and from it to them, as maps by landmark. Nodes beyond limit of a landmark lack it.

    A few landmarks at the rim of the map serve all searches over a graph, so this table is made once and kept with the graph.
    """
    starts = landmarks.select(F.col("node_id").alias("source"), "node_id")
    turned = graph.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "cost")
    ways = [costs_from(starts, g, limit).select("node_id", "source", "cost", F.lit(k).alias("way")) for k, g in enumerate((graph, turned))]
    of = lambda k: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("way") == k, F.struct("source", "cost")))))
    return written(ways[0].unionByName(ways[1]).groupBy("node_id").agg(of(0).alias("away"), of(1).alias("back")))


def _least_cost(at: tuple[Column, Column], target: tuple[Column, Column]) -> Column:
    """A bound from below of the cost from a node to a target by the triangle inequality, from their (away, back) maps; 0 without a landmark in common."""
    ahead = F.transform(F.map_entries(target[0]), lambda e: e["value"] - F.try_element_at(at[0], e["key"]))
    behind = F.transform(F.map_entries(at[1]), lambda e: e["value"] - F.try_element_at(target[1], e["key"]))
    top = lambda values: F.coalesce(F.array_max(F.array_compact(values)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.coalesce(top(ahead), F.lit(0.0)), F.coalesce(top(behind), F.lit(0.0)))


def search_to(pairs: DataFrame, graph: DataFrame, known: DataFrame) -> DataFrame:
    """(source, target, node_id, cost, prev_id): what a search from each source to its target (source, target) settles; the rows of the target itself hold the answers.

    known is landmark_costs of the same graph. A node is only gone on from while its cost and the bound to the target from below don't exceed the best
    cost known: at first that of a way over a landmark, later the target's own. Costs to targets are those of costs_from; targets that can't be reached have no row.
    """
    lightest = written(graph.groupBy("from_id", "to_id").agg(F.min("cost").alias("cost")))
    none = F.lit(None).cast(dict(graph.dtypes)["from_id"])
    of = lambda name, to: known.select(F.col("node_id").alias(name), F.col("away").alias(f"{to}_away"), F.col("back").alias(f"{to}_back"))
    asked = pairs.select("source", "target").distinct().join(of("source", "s"), "source", "left").join(of("target", "t"), "target", "left")
    over = F.array_min(F.array_compact(F.transform(F.map_entries("s_back"), lambda e: e["value"] + F.try_element_at("t_away", e["key"]))))
    asked = written(asked.select("source", "target", "t_away", "t_back", F.coalesce(over, F.lit(float("inf"))).alias("over")))
    now = written(asked.select("source", "target", F.col("source").alias("node_id"), F.lit(0.0).alias("cost"), none.alias("prev_id"), F.lit(True).alias("fresh")))
    while True:
        best = now.where("node_id = target").select("source", "target", F.col("cost").alias("found"))
        limits = asked.join(best, ["source", "target"], "left").withColumn("most", F.least("over", F.coalesce("found", F.lit(float("inf")))))
        moved = now.where("fresh").select("source", "target", F.col("node_id").alias("from_id"), F.col("cost").alias("c0")).join(lightest, "from_id")
        new = moved.select("source", "target", F.col("to_id").alias("node_id"), (F.col("c0") + F.col("cost")).alias("cost"), F.col("from_id").alias("prev_id"), F.lit(True).alias("fresh"))
        judged = new.join(limits, ["source", "target"]).join(of("node_id", "n"), "node_id", "left")
        least = F.coalesce(_least_cost((F.col("n_away"), F.col("n_back")), (F.col("t_away"), F.col("t_back"))), F.lit(0.0))
        # A little more than the best cost, as sums of one way's costs in another order may differ in their last digits.
        kept = judged.where(F.col("cost") + least <= F.col("most") * (1 + 1e-12) + 1e-12).select(*new.columns)
        both = now.withColumn("fresh", F.lit(False)).unionByName(kept)
        top = both.groupBy("source", "target", "node_id").agg(F.min(F.struct("cost", "fresh", "prev_id")).alias("b"))
        before, now = now, written(top.select("source", "target", "node_id", "b.cost", "b.prev_id", "b.fresh"))
        discard(before)
        if now.where("fresh").isEmpty():
            break
    return now.drop("fresh")


def paths_to(targets: DataFrame, costs: DataFrame) -> DataFrame:
    """(source, target, pos, node_id): the nodes of the cheapest path from each source to each target (source, target), from the target's end back, pos 0 the source."""
    step = written(targets.join(costs.withColumnRenamed("node_id", "target"), ["source", "target"]).select("source", "target", F.col("target").alias("node_id"), "prev_id", F.lit(0).alias("back")))
    parts = [step]
    before = costs.select("source", F.col("node_id").alias("prev_id"), F.col("prev_id").alias("p"))
    k = 0
    while not step.where("prev_id is not null").isEmpty():
        k += 1
        step = written(step.join(before, ["source", "prev_id"]).select("source", "target", F.col("prev_id").alias("node_id"), F.col("p").alias("prev_id"), F.lit(k).alias("back")))
        parts.append(step)
    whole = reduce(DataFrame.unionByName, parts)
    return whole.select("source", "target", (F.row_number().over(Window.partitionBy("source", "target").orderBy(F.desc("back"))) - 1).alias("pos"), "node_id")


def route_via(stops: list[int], graph: DataFrame, **options) -> DataFrame:
    """(leg, pos, node_id): the cheapest path through several nodes in order, leg by leg."""
    spark = graph.sparkSession
    legs = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(stops, stops[1:], strict=False))], "source long, node_id long, target long")
    costs = costs_from(legs.select("source", "node_id"), graph, **options)
    return paths_to(legs.select("source", "target"), costs).select(F.col("source").alias("leg"), "pos", "node_id")


def with_twins(graph: DataFrame, twins: DataFrame) -> DataFrame:
    """Edges of several databases (db_id, from_id, to_id, cost) as one graph of keys 'db:node', with free edges between equal nodes (node_id, db_a, db_b), both ways."""
    key = lambda db, node: F.concat_ws(":", db, node)
    own = graph.select(key("db_id", "from_id").alias("from_id"), key("db_id", "to_id").alias("to_id"), "cost")
    walk = lambda a, b: twins.select(key(a, "node_id").alias("from_id"), key(b, "node_id").alias("to_id"), F.lit(0.0).alias("cost"))
    return own.unionByName(walk("db_a", "db_b")).unionByName(walk("db_b", "db_a"))


def node_twins(nodes: DataFrame) -> DataFrame:
    """(node_id, db_a, db_b): nodes (db_id, node_id) that two databases share."""
    a, b = nodes.select("node_id", F.col("db_id").alias("db_a")), nodes.select("node_id", F.col("db_id").alias("db_b"))
    return a.join(b, "node_id").where("db_a < db_b").distinct()
