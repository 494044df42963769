"""From raw map objects to tables that queries read: one function for each step, DataFrame in, DataFrame out."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, shapes
from ..session import share_package, written


def serials(coords: DataFrame) -> DataFrame:
    """coords (osm_id, lat, lon) with point_id and serial: coincident points are numbered from 1 by id, a point alone has 1."""
    keyed = coords.withColumn("point_id", geo.point_id(F.col("lat"), F.col("lon")))
    return keyed.withColumn("serial", F.row_number().over(Window.partitionBy("point_id").orderBy("osm_id")))


def resolved(ways: DataFrame, coords: DataFrame, key: str = "way_id") -> DataFrame:
    """(key, points): ways (key, refs) with the points (osm_id, lat, lon) of their refs in order. Ways with a ref that no point has are left out."""
    refs = ways.select(key, F.size("refs").alias("n"), F.posexplode("refs").alias("idx", "osm_id"))
    met = refs.join(coords.select("osm_id", "lat", "lon"), "osm_id")
    rows = met.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("idx", "osm_id", "lat", "lon"))).alias("rows")).where(F.size("rows") == F.col("n"))
    return rows.select(key, F.transform("rows", lambda r: F.struct(r["osm_id"].alias("id"), r["lat"].alias("lat"), r["lon"].alias("lon"))).alias("points"))


def unused(objects: DataFrame, blacklist: DataFrame, key: str) -> DataFrame:
    """objects whose key isn't taken by another, such as ways that are rings of relations."""
    return objects.join(blacklist.select(key).distinct(), key, "left_anti")


def _rings_of(pieces: list[list[int]]) -> list[list[int]]:
    """Closed rings of ids from open pieces that share their ends, smallest first id first; pieces that close no ring are dropped."""
    closed = [p[:-1] for p in pieces if len(p) > 3 and p[0] == p[-1]]
    todo = sorted(p for p in pieces if not (len(p) > 3 and p[0] == p[-1]))
    while todo:
        line = list(todo.pop(0))
        grown = True
        while grown and line[0] != line[-1]:
            grown = False
            for k, p in enumerate(todo):
                if line[-1] in (p[0], p[-1]):
                    line += p[1:] if p[0] == line[-1] else p[-2::-1]
                    del todo[k]
                    grown = True
                    break
        if len(line) > 3 and line[0] == line[-1]:
            closed.append(line[:-1])
    return closed


def rings_of_relations(members: DataFrame, coords: DataFrame) -> DataFrame:
    """(relation_id, ring_no, depth, ids, ring): closed rings of multipolygons from their member ways (relation_id, refs).

    depth is 1 for outer rings, 2 for holes in them, 3 for islands in holes and so on, by how many other rings of the relation hold
    a ring. Stitching runs for each relation on its own; nesting compares rings of one relation by Columns.
    """

    def stitch(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        rings = _rings_of([list(map(int, r)) for r in t["refs"]])
        return pd.DataFrame({"relation_id": [key[0]] * len(rings), "ring_no": range(len(rings)), "ids": rings})

    share_package(members.sparkSession)
    rings = members.select("relation_id", "refs").groupBy("relation_id").applyInPandas(stitch, "relation_id long, ring_no int, ids array<long>")
    found = resolved(rings.select(F.struct("relation_id", "ring_no").alias("k"), F.col("ids").alias("refs")), coords, "k")
    found = written(found.select("k.relation_id", "k.ring_no", F.transform("points", lambda p: p["id"]).alias("ids"), F.transform("points", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("ring")))
    other = found.select("relation_id", F.col("ring_no").alias("outer_no"), F.col("ring").alias("outer_ring"))
    held = found.join(other, "relation_id").where((F.col("ring_no") != F.col("outer_no")) & shapes.ring_part_of(F.col("ring"), F.col("outer_ring")))
    depth = held.groupBy("relation_id", "ring_no").agg(F.countDistinct("outer_no").alias("n"))
    return found.join(depth, ["relation_id", "ring_no"], "left").select("relation_id", "ring_no", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("depth"), "ids", "ring")


def chains(links: DataFrame) -> DataFrame:
    """(id, head, pos): the place of each element in its chain, for links (id, next_id) where each element has one follower and one predecessor at most.

    Pointer doubling: after k rounds each element looks 2^k places back, so the number of joins grows with the logarithm of
    the longest chain. A closed chain begins with its smallest id.
    """
    linked = links.where("next_id is not null")
    ids = links.select("id").union(linked.select("next_id")).distinct()
    back = linked.select(F.col("next_id").alias("id"), F.col("id").alias("far"))
    now = ids.join(back, "id", "left").select("id", "far", F.when(F.col("far").isNull(), 0).otherwise(1).cast("long").alias("pos"), F.when(F.col("far").isNull(), F.col("id")).alias("head"), F.least("id", F.coalesce("far", "id")).alias("low"))
    now = written(now)
    seen, open_now = 1, now.where("far is not null").count()
    total = open_now
    while open_now and seen <= 2 * total:
        other = now.select(F.col("id").alias("far"), F.col("far").alias("farther"), F.col("pos").alias("more"), F.col("head").alias("head2"), F.col("low").alias("low2"))
        joined = now.join(other, "far", "left")
        now = written(joined.select("id", F.col("farther").alias("far"), (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos"), F.coalesce("head", "head2").alias("head"), F.least("low", F.coalesce("low2", "low")).alias("low")))
        seen, open_now = seen * 2, now.where("far is not null").count()
    if open_now:  # what still looks back is closed: cut it before its smallest element
        cut = now.where("far is not null and id = low").select(F.col("id").alias("next_id"))
        opened = links.join(cut, "next_id", "left_semi").select("id", F.lit(None).cast("long").alias("next_id"))
        return chains(written(links.join(cut, "next_id", "left_anti").select("id", "next_id").unionByName(opened)))
    return now.select("id", "head", "pos")


def merged_ways(ways: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Ways of equal type and features joined end to start: (way_id, type, name, n_merged, ids).

    ways: (way_id, type, name, ids). Two ways join where one ends and another one begins and no third way of their kind has an end there, and
    the node isn't one of blocked (node_id), such as a turn restriction's. The merged way carries its first way's id.
    """
    ends = ways.select("way_id", "type", "name", F.element_at("ids", 1).alias("first"), F.element_at("ids", -1).alias("last"))
    ends = ends.where(F.col("first") != F.col("last"))
    at = ends.select("type", "name", F.col("first").alias("node_id"), F.col("way_id").alias("begins"), F.lit(None).cast("long").alias("ends")).unionByName(ends.select("type", "name", F.col("last").alias("node_id"), F.lit(None).cast("long").alias("begins"), F.col("way_id").alias("ends")))
    joints = at.groupBy("type", "name", "node_id").agg(F.count("*").alias("n"), F.max("begins").alias("begins"), F.max("ends").alias("ends")).where("n = 2 and begins is not null and ends is not null and begins <> ends")
    if blocked is not None:
        joints = joints.join(blocked.select("node_id").distinct(), "node_id", "left_anti")
    following = joints.select(F.col("ends").alias("id"), F.col("begins").alias("next_id"))
    links = ways.select(F.col("way_id").alias("id")).join(following, "id", "left")
    placed = chains(written(links)).withColumnRenamed("id", "way_id")
    parts = ways.join(placed, "way_id").groupBy("head").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts"), F.first("type").alias("type"), F.first("name").alias("name"))
    ids = F.flatten(F.transform("parts", lambda p, i: F.when(i == 0, p["ids"]).otherwise(F.slice(p["ids"], 2, F.greatest(F.size(p["ids"]) - 1, F.lit(0))))))
    return parts.select(F.col("head").alias("way_id"), "type", "name", F.size("parts").cast("long").alias("n_merged"), ids.alias("ids"))


def components(links: DataFrame) -> DataFrame:
    """(id, component): what links (a, b) connect, named by the smallest id. Each round takes the least name of the neighbours and then that name's own, so names travel in doubling steps; a round is a written table."""
    both = written(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct())
    now = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("component")))
    while True:
        near = both.join(now.withColumnsRenamed({"id": "b", "component": "c"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        least = now.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "c").alias("c"))
        jump = now.select(F.col("id").alias("c"), F.col("component").alias("further"))
        after = written(least.join(jump, "c").select("id", "was", F.col("further").alias("component")))
        now = after.select("id", "component")
        if after.where("was <> component").isEmpty():
            return now


def merged_areas(areas: DataFrame) -> DataFrame:
    """Areas of one type that share an edge, as one: (area_id, type, n_areas, ids), a row for each ring of what is left, outer ones counter-clockwise and holes clockwise.

    areas: (area_id, type, ids), rings of node ids, counter-clockwise, the first not repeated at the end. A merged area has the smallest id of
    its parts. Edges that two parts share go; the others follow each other around. No task sees more than one ring.
    """
    after = F.concat(F.slice("ids", 2, F.size("ids") - 1), F.slice("ids", 1, 1))
    edges = written(areas.select("area_id", "type", F.explode(F.arrays_zip(F.col("ids").alias("a"), after.alias("b"))).alias("e")).select("area_id", "type", "e.a", "e.b"))
    turned = edges.select("type", F.col("area_id").alias("other"), F.col("b").alias("a"), F.col("a").alias("b"))
    of_area = components(edges.join(turned, ["type", "a", "b"]).select(F.col("area_id").alias("a"), F.col("other").alias("b")))
    main = F.coalesce("component", "area_id").alias("main")
    named = written(areas.select("area_id", "type").join(of_area.withColumnRenamed("id", "area_id"), "area_id", "left").select("area_id", "type", main))
    own = edges.drop("type").join(named, "area_id").select("main", "type", "a", "b")
    left = own.join(own.select("main", F.col("b").alias("a"), F.col("a").alias("b")), ["main", "a", "b"], "left_anti")
    left = written(left.withColumn("edge", F.monotonically_increasing_id()))
    # Where rings touch, the edges that come in and go out are paired by their order.
    place = lambda node, other: F.row_number().over(Window.partitionBy("main", node).orderBy(other))
    comes = left.select("main", F.col("b").alias("node"), F.col("edge").alias("id"), place("b", "a").alias("k"))
    goes = left.select("main", F.col("a").alias("node"), F.col("edge").alias("next_id"), place("a", "b").alias("k"))
    placed = chains(written(comes.join(goes, ["main", "node", "k"]).select("id", "next_id")))
    rings = left.join(placed.withColumnRenamed("id", "edge"), "edge").groupBy("main", "type", "head").agg(F.array_sort(F.collect_list(F.struct("pos", "a"))).alias("ring"))
    counts = named.groupBy("main").agg(F.count("*").alias("n_areas"))
    return rings.join(counts, "main").select(F.col("main").alias("area_id"), "type", "n_areas", F.transform("ring", lambda x: x["a"]).alias("ids"))


def use_counts(way_points: DataFrame) -> DataFrame:
    """(node_id, n_ways): by how many ways a node is used, each way once."""
    return way_points.select("node_id", "way_id").distinct().groupBy("node_id").agg(F.count("*").alias("n_ways"))


def relevant_nodes(way_points: DataFrame) -> DataFrame:
    """(node_id): nodes that two vertices share, and the ends of ways. Only these keep their identity."""
    last = F.max("idx").over(Window.partitionBy("way_id"))
    ends = way_points.select("node_id", "idx", last.alias("last")).where("idx = 0 or idx = last").select("node_id")
    return way_points.groupBy("node_id").count().where("count >= 2").select("node_id").union(ends).distinct()


def reduced_line(p: Column) -> Column:
    """An array of points without those that, stored in 27 bits, equal the one before."""
    same = lambda a, b: (geo.raw_lat(a["lat"]) == geo.raw_lat(b["lat"])) & (geo.raw_lon(a["lon"]) == geo.raw_lon(b["lon"]))
    return F.filter(p, lambda x, i: (i == 0) | ~F.coalesce(same(x, F.get(p, i - 1)), F.lit(False)))


def low_zoom(lines: DataFrame, key: str, points: str, zooms: list[int], tile_pixels: int = 256, closed: bool = False) -> DataFrame:
    """(key, zoom, points): lines in fewer points for each zoom level, with an eighth of a pixel as tolerance; what is a pixel or smaller in both directions is left out."""
    share_package(lines.sparkSession)
    p = F.col("af_points")
    plain = F.transform(points, lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))
    steps = F.array(*[F.struct(F.lit(z).alias("zoom"), F.lit(360.0 / (tile_pixels << z)).alias("pixel")) for z in zooms])
    # All zooms in one pass; box and bend are computed once for a line.
    measured = lines.select(key, plain.alias("af_points")).select(key, "af_points", geo.box_of_points(p).alias("b"), shapes.bend(p).alias("bend"))
    seen = measured.select("*", F.explode(steps).alias("z")).where(((F.col("b.max_lat") - F.col("b.min_lat")) > F.col("z.pixel")) | ((F.col("b.max_lon") - F.col("b.min_lon")) > F.col("z.pixel")))
    tolerance = F.col("z.pixel") / 8
    # Lines that are surely straight enough keep their ends without going through Python.
    straight = F.coalesce((F.size(p) <= 2) | (F.col("bend") < tolerance * (1 - 1e-9)), F.lit(False))
    ends = F.when(F.size(p) <= 2, p).otherwise(F.array(F.get(p, F.lit(0)), F.try_element_at(p, F.lit(-1))))
    thin = F.when(straight, ends).otherwise(shapes.simplified(F.when(~straight, p), tolerance))
    found = seen.select(key, "z.zoom", thin.alias(points))
    # An open line larger than a pixel keeps two ends; a condition on its points would send it to Python twice.
    return found.where(F.size(points) >= 3) if closed else found


def route_chains(members: DataFrame, ways: DataFrame) -> DataFrame:
    """(route_id, segment, pos, way_id, forward): the member ways of a route (route_id, way_id) in order of travel.

    Ways (way_id, first, last) are chained over shared ends from an end that only one of them has, else from the smallest way; each chain is a segment.
    """

    def chain(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        left = {int(w): (int(a), int(b)) for w, a, b in zip(t["way_id"], t["first"], t["last"], strict=True)}
        out, segment = [], 0
        while left:
            degree: dict[int, int] = {}
            for ends in left.values():
                for e in ends:
                    degree[e] = degree.get(e, 0) + 1
            starts = sorted((w, a, b) for w, (a, b) in left.items() if degree[a] == 1 or degree[b] == 1) or [(w, *left[w]) for w in [min(left)]]
            w, a, b = starts[0]
            at = a if degree[a] == 1 or degree[b] != 1 else b
            pos = 0
            while True:
                following = sorted(w for w, ends in left.items() if at in ends)
                if not following:
                    break
                w = following[0]
                a, b = left.pop(w)
                out.append((key[0], segment, pos, w, a == at))
                at, pos = (b if a == at else a), pos + 1
            segment += 1
        return pd.DataFrame(out, columns=["route_id", "segment", "pos", "way_id", "forward"])

    share_package(members.sparkSession)
    return members.join(ways.select("way_id", "first", "last"), "way_id").groupBy("route_id").applyInPandas(chain, "route_id long, segment int, pos int, way_id long, forward boolean")


#: Member roles of public transport routes.
STOP_ROLES, PLATFORM_ROLES = ("stop", "stop_entry_only", "stop_exit_only"), ("platform", "platform_entry_only", "platform_exit_only")


def transport_routes(masters: DataFrame, variants: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(master_id, route_id, kind, pos, obj_id, name): stops and platforms of the variants of public transport routes, in order.

    masters: (master_id, route_id); variants: (route_id); members: (route_id, idx, obj_id, role); nodes: (obj_id, name). Variants without a master are left out.
    """
    known = variants.join(masters, "route_id")
    kind = F.when(F.col("role").isin(*STOP_ROLES), "stop").when(F.col("role").isin(*PLATFORM_ROLES), "platform")
    rows = members.withColumn("kind", kind).where("kind is not null").join(known.select("master_id", "route_id"), "route_id").join(nodes, "obj_id", "left")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("master_id", "route_id", "kind").orderBy("idx"))).select("master_id", "route_id", "kind", "pos", "obj_id", "name")


def distribution(objects: DataFrame) -> DataFrame:
    """(type, node, way, area): how many objects of each kind a type has."""
    n = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    return objects.groupBy("type").agg(n("node"), n("way"), n("area"))


def bounding_box(points: DataFrame) -> DataFrame:
    return points.agg(F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"))


# ---- land and water in cells


def filled_water(cells: DataFrame, within: DataFrame, rounds: int = 20) -> DataFrame:
    """cells (x, y, state) after rounds in which unknown cells of within (x, y) beside water become water, all at once in each round."""
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    now = written(within.join(cells, ["x", "y"], "left").select("x", "y", F.coalesce("state", F.lit("unknown")).alias("state")))
    outside = cells.join(within, ["x", "y"], "left_anti").select("x", "y", "state")
    none = now.select("x", "y").where(F.lit(False))
    wet, last, edge = [], none, now.where("state = 'water'").select("x", "y")
    for _ in range(rounds):
        beside = edge.select("x", "y", step.alias("s")).select((F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y")).distinct()
        # What became water earlier and lies beside the edge did so in the last two rounds, so the table isn't written again.
        fresh = beside.join(edge.union(last), ["x", "y"], "left_anti")
        new = written(now.where("state = 'unknown'").join(fresh, ["x", "y"], "left_semi").select("x", "y"))
        if new.isEmpty():
            break
        wet.append(new)
        last, edge = edge, new
    flooded = reduce(DataFrame.union, wet, none).distinct().withColumn("wet", F.lit(True))
    now = now.join(flooded, ["x", "y"], "left").select("x", "y", F.when(F.col("wet"), "water").otherwise(F.col("state")).alias("state"))
    return now.unionByName(outside)


def filled_land(cells: DataFrame) -> DataFrame:
    """cells (x, y, state) where runs of unknown cells between land or coast on one side and land on the other, in a row or a column, have become land; repeated until nothing changes."""
    now = written(cells)
    while True:
        changed = now
        for line, along in (("y", "x"), ("x", "y")):
            before = F.last(F.when(F.col("state") != "unknown", F.struct("state", along)), True).over(Window.partitionBy(line).orderBy(along).rowsBetween(Window.unboundedPreceding, -1))
            # From the other end, as a frame up to the last row would be read anew for each row.
            after = F.last(F.when(F.col("state") != "unknown", F.struct("state", along)), True).over(Window.partitionBy(line).orderBy(F.desc(along)).rowsBetween(Window.unboundedPreceding, -1))
            marked = changed.withColumns({"b": before, "a": after})
            solid = (F.col("b.state").isin("land", "coast") & (F.col("a.state") == "land")) | ((F.col("b.state") == "land") & F.col("a.state").isin("land", "coast"))
            changed = marked.withColumn("state", F.when((F.col("state") == "unknown") & F.coalesce(solid, F.lit(False)), "land").otherwise(F.col("state"))).drop("a", "b")
        changed = written(changed)
        n = lambda df: df.where("state = 'unknown'").count()
        if n(changed) == n(now):
            return changed
        now = changed


def coast_cells(lines: DataFrame, level: int) -> DataFrame:
    """(x, y, state): the cells that coastlines (points) run through."""
    cells = lines.select(F.explode(shapes.segments(F.col("points"))).alias("s")).select(geo.tile(F.col("s.a.lat"), F.col("s.a.lon"), level).alias("p"), geo.tile(F.col("s.b.lat"), F.col("s.b.lon"), level).alias("q"))
    return cells.select(F.explode(shapes.cells_of_line(F.col("p.x"), F.col("p.y"), F.col("q.x"), F.col("q.y"))).alias("c")).select("c.x", "c.y").distinct().withColumn("state", F.lit("coast"))
