"""Search by names in the tree of regions, streets and addresses, prefix search over all names, and what describes a place.

Tables: regions (region_id, parent_id, name, level), locations (location_id, region_id, postal_area, name),
addresses (address_id, location_id, name), pois (poi_id, region_id, name). Quality is match or candidate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import spherical_distance
from ..functions.text import count_words, lookup_form, match_quality, split_at_space, transliterated
from ..session import share_package, written

#: match sorts before candidate.
_RANK = {"match": 1, "candidate": 2}


def closure(regions: DataFrame) -> DataFrame:
    """(region_id, ancestor_id, up): each region with itself (up 0) and all regions above it. One join for each level of the tree, however deep; regions that are above themselves raise an error."""
    parents = regions.where("parent_id is not null").select(F.col("region_id").alias("ancestor_id"), "parent_id")
    step = regions.select("region_id", F.col("region_id").alias("ancestor_id"), F.lit(0).alias("up"))
    parts = [step]
    while True:
        step = written(step.join(parents, "ancestor_id").select("region_id", F.col("parent_id").alias("ancestor_id"), (F.col("up") + 1).alias("up")))
        if step.isEmpty():
            break
        if not step.where("region_id = ancestor_id").isEmpty():
            raise ValueError("a region is above itself")
        parts.append(step)
    return reduce(DataFrame.unionByName, parts)


def full_names(regions: DataFrame, tree: DataFrame) -> DataFrame:
    """(region_id, depth, path): the names from the region up to its root, joined by commas."""
    named = tree.join(regions.select(F.col("region_id").alias("ancestor_id"), "name"), "ancestor_id")
    rows = named.groupBy("region_id").agg(F.max("up").alias("depth"), F.array_sort(F.collect_list(F.struct("up", "name"))).alias("names"))
    return rows.select("region_id", "depth", F.array_join(F.transform("names", lambda x: x["name"]), ", ").alias("path"))


def search_patterns(words: Column, most: int, ignored: list[str]) -> Column:
    """Array of struct<text, rest>: the first and the last words of a query, up to most of them, without ignored ones (upper case); longest first, each text once. rest holds the other words."""
    n = F.least(F.size(words), F.lit(most))
    take = lambda a, k: F.array_join(F.slice(words, a, k), " ")
    cut = lambda a, k: F.slice(words, a, F.greatest(k, F.lit(0)))
    lengths = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    heads = F.transform(lengths, lambda k: F.struct(take(F.lit(1), k).alias("text"), cut(k + 1, F.size(words) - k).alias("rest")))
    tails = F.transform(lengths, lambda k: F.struct(take(F.size(words) - k + 1, k).alias("text"), cut(F.lit(1), F.size(words) - k).alias("rest")))
    kept = F.filter(F.concat(heads, tails), lambda p: ~F.upper(p["text"]).isin(*ignored) if ignored else F.lit(True))
    keyed = F.array_distinct(F.transform(kept, lambda p: F.struct((-F.length(p["text"])).alias("short"), p["text"].alias("text"), p["rest"].alias("rest"))))
    return F.transform(F.array_sort(keyed), lambda p: F.struct(p["text"].alias("text"), p["rest"].alias("rest")))


def _rank(quality: str | Column) -> Column:
    q = F.col(quality) if isinstance(quality, str) else quality
    return F.when(q == "match", 1).when(q == "candidate", 2).otherwise(3)


def _best(found: DataFrame, keys: list[str], orders: list[str]) -> DataFrame:
    """The best row for each key."""
    return found.groupBy(*keys).agg(F.min(F.struct(*orders)).alias("b"))


def search_by_form(regions: DataFrame, locations: DataFrame, addresses: DataFrame, tree: DataFrame, region: str, location: str | None = None, address: str | None = None, exact: bool = False) -> DataFrame:
    """(region_id, location_id, address_id, region_quality, location_quality, address_quality) for given names.

    Locations count in the region that matches or in any below it. What a name was not given for stays null; an address without a match leaves its location as it is.
    With exact only matches count.
    """
    ok = lambda q: F.col(q) == "match" if exact else F.col(q).isNotNull()
    top = regions.select(F.col("region_id").alias("ancestor_id"), match_quality(F.col("name"), F.lit(region)).alias("region_quality")).where(ok("region_quality"))
    if location is None:
        none = F.lit(None)
        return top.select(F.col("ancestor_id").alias("region_id"), none.cast("long").alias("location_id"), none.cast("long").alias("address_id"), "region_quality", none.cast("string").alias("location_quality"), none.cast("string").alias("address_quality"))
    below = top.join(tree, "ancestor_id").groupBy("region_id").agg(F.min(_rank("region_quality")).alias("r"))
    streets = locations.select("location_id", "region_id", match_quality(F.col("name"), F.lit(location)).alias("location_quality")).where(ok("location_quality"))
    found = streets.join(below, "region_id").select("region_id", "location_id", F.when(F.col("r") == 1, "match").otherwise("candidate").alias("region_quality"), "location_quality")
    if address is None:
        return found.select("region_id", "location_id", F.lit(None).cast("long").alias("address_id"), "region_quality", "location_quality", F.lit(None).cast("string").alias("address_quality"))
    houses = addresses.select("location_id", "address_id", match_quality(F.col("name"), F.lit(address)).alias("address_quality")).where(ok("address_quality"))
    return found.join(houses, "location_id", "left").select("region_id", "location_id", "address_id", "region_quality", "location_quality", "address_quality")


def search_by_string(queries: DataFrame, regions: DataFrame, locations: DataFrame, addresses: DataFrame, tree: DataFrame, ignored: list[str], most_words: int = 4) -> DataFrame:
    """(query_id, region_id, location_id, address_id, region_quality, location_quality, address_quality) of free texts (query_id, query).

    The first or last words of a text name a region, the first or last of those left a location in or below it, the rest an address. A query
    that names a region alone finds that. The small table of queries' patterns meets names by equality of their words' first token where
    possible: patterns are joined with regions once, all later steps are equi-joins on the tree.
    """
    share_package(queries.sparkSession)
    asked = queries.select("query_id", F.explode(search_patterns(split_at_space(F.regexp_replace("query", ",", " ")), most_words, ignored)).alias("p")).select("query_id", "p.text", "p.rest")
    names = regions.select(F.col("region_id").alias("ancestor_id"), "name", F.explode(_pieces(F.upper("name"))).alias("piece"))
    top = asked.withColumn("piece", F.upper("text")).join(names, "piece").withColumn("region_quality", match_quality(F.col("name"), F.col("text")))
    top = top.groupBy("query_id", "ancestor_id").agg(F.min(F.struct(_rank("region_quality").alias("r"), (-F.length("text")).alias("short"), "text", "rest")).alias("b")).select("query_id", "ancestor_id", "b.r", "b.rest")
    alone = top.where(F.size("rest") == 0).select("query_id", F.col("ancestor_id").alias("region_id"), F.lit(None).cast("long").alias("location_id"), F.lit(None).cast("long").alias("address_id"), "r", F.lit(3).alias("l"), F.lit(3).alias("a"))
    below = top.where(F.size("rest") > 0).join(tree, "ancestor_id").select("query_id", "region_id", "r", F.explode(search_patterns(F.col("rest"), most_words, ignored)).alias("p"))
    streets = locations.select("location_id", "region_id", "name", F.explode(_pieces(F.upper("name"))).alias("piece"))
    hit = below.withColumn("piece", F.upper("p.text")).join(streets, ["region_id", "piece"]).withColumn("l", _rank(match_quality(F.col("name"), F.col("p.text"))))
    hit = hit.groupBy("query_id", "region_id", "location_id").agg(F.min(F.struct("r", "l", (-F.length("p.text")).alias("short"), F.col("p.rest").alias("rest"))).alias("b")).select("query_id", "region_id", "location_id", "b.r", "b.l", F.array_join("b.rest", " ").alias("left"))
    houses = addresses.select("location_id", "address_id", F.col("name").alias("house"))
    number = hit.join(houses, "location_id", "left").withColumn("q", F.when(F.col("left") != "", match_quality(F.col("house"), F.col("left"))))
    number = number.groupBy("query_id", "region_id", "location_id", "r", "l").agg(F.min(F.when(F.col("q").isNotNull(), F.struct(_rank("q").alias("a"), "address_id"))).alias("b"))
    full = number.select("query_id", "region_id", "location_id", F.col("b.address_id").alias("address_id"), "r", "l", F.coalesce("b.a", F.lit(3)).alias("a"))
    word = lambda c: F.when(F.col(c) == 1, "match").when(F.col(c) == 2, "candidate")
    return full.unionByName(alone).select("query_id", "region_id", "location_id", "address_id", word("r").alias("region_quality"), word("l").alias("location_quality"), word("a").alias("address_quality"))


def _pieces(name: Column) -> Column:
    """All runs of a name's words: a pattern that is one of them is held by the name, so that names and patterns meet by equality."""
    w = split_at_space(name)
    n = F.size(w)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.greatest(n - i + 1, F.lit(1))), lambda k: F.array_join(F.slice(w, i, k), " "))))
    return F.array_distinct(runs)


def search_pois(regions: DataFrame, pois: DataFrame, tree: DataFrame, region: str, poi: str) -> DataFrame:
    """(poi_id, region_id, region_quality, poi_quality) in or below the regions of a name."""
    top = regions.select(F.col("region_id").alias("ancestor_id"), _rank(match_quality(F.col("name"), F.lit(region))).alias("r")).where("r < 3")
    below = top.join(tree, "ancestor_id").groupBy("region_id").agg(F.min("r").alias("r"))
    own = pois.select("poi_id", "region_id", match_quality(F.col("name"), F.lit(poi)).alias("poi_quality")).where("poi_quality is not null")
    return own.join(below, "region_id").select("poi_id", "region_id", F.when(F.col("r") == 1, "match").otherwise("candidate").alias("region_quality"), "poi_quality")


def ranked(found: DataFrame, limit: int, *keys: str) -> DataFrame:
    """The best rows by qualities, then keys, with limit_reached: whether there were more."""
    order = [_rank(c) for c in found.columns if c.endswith("_quality")] + [F.col(k) for k in keys]
    top = found.orderBy(*order).limit(limit + 1)
    n = F.count("*").over(Window.partitionBy())
    rank = F.row_number().over(Window.partitionBy().orderBy(*order))
    return top.select("*", (n > limit).alias("limit_reached"), rank.alias("rank")).where(F.col("rank") <= limit)


# ---- prefix search


def text_index(entries: DataFrame) -> DataFrame:
    """(group, key, text, ref) of entries (group, text, ref): the key is the text's lookup form without marks. Write it sorted by key, so that prefixes prune."""
    share_package(entries.sparkSession)
    return entries.where("text <> ''").select("group", lookup_form(transliterated(F.col("text"))).alias("key"), "text", "ref")


def prefix_search(index: DataFrame, prefix: str, groups: list[str]) -> DataFrame:
    """(group, text, refs): texts whose key begins with the prefix's key, each with its objects."""
    key = F.regexp_replace(F.trim(F.lower(F.lit(prefix))), r"\s+", " ")
    hit = index.where(F.col("group").isin(groups) & F.startswith("key", key))
    return hit.groupBy("group", "text").agg(F.array_sort(F.collect_set("ref")).alias("refs"))


# ---- building the tree


def name_votes(named: DataFrame) -> DataFrame:
    """(key, name): the name that most objects (key, name) give a place; ties to the smaller name."""
    counts = named.groupBy("key", "name").count()
    return counts.groupBy("key").agg(F.min(F.struct((-F.col("count")).alias("few"), "name")).alias("b")).select("key", "b.name")


def ignorable_tokens(names: DataFrame, least: int = 5) -> DataFrame:
    """(token): short words (5 letters or fewer) and pairs that end in one, which stand in so many names of more than two words that they tell nothing.

    The threshold is a hundredth of the distinct tokens of each class, least at least; names that are such a token themselves keep it.
    """
    words = names.select(split_at_space(F.upper("name")).alias("w")).where(F.size("w") > 2)
    singles = words.select(F.explode("w").alias("token")).where(F.octet_length("token") <= 5)
    pairs = words.select(F.explode(F.transform(F.slice("w", 2, F.size("w") - 1), lambda x, i: F.struct(F.concat_ws(" ", F.get("w", i), x).alias("token"), x.alias("last")))).alias("p")).where(F.octet_length("p.last") <= 5).select("p.token")
    own = names.select(F.upper("name").alias("token")).where(F.size(split_at_space(F.col("token"))) <= 2).distinct()

    def over(tokens: DataFrame) -> DataFrame:
        counts = tokens.groupBy("token").count()
        limit = counts.agg(F.greatest(F.lit(least).cast("double"), F.count("*") / 100).alias("limit"))
        return counts.join(F.broadcast(limit)).where(F.col("count") > F.col("limit")).select("token")  # one row of limits

    return over(singles).union(over(pairs)).distinct().join(own, "token", "left_anti")


def region_metrics(regions: DataFrame, locations: DataFrame, addresses: DataFrame, pois: DataFrame) -> DataFrame:
    """(kind, words): the most words of a name, by which queries are cut."""
    most = lambda df, kind: df.agg(F.max(count_words(F.col("name"))).alias("words")).select(F.lit(kind).alias("kind"), F.coalesce("words", F.lit(0)).alias("words"))
    return most(regions, "region").unionByName(most(locations, "location")).unionByName(most(addresses, "address")).unionByName(most(pois, "poi"))


def matched_addresses(addresses: DataFrame, locations: DataFrame) -> DataFrame:
    """(address_id, location_id): addresses (address_id, region_id, postal_area, street, name) of the street of that name in their region and postal area; else of the region's street of that name, smallest id first."""
    norm = lambda c: lookup_form(F.col(c))
    streets = locations.select("location_id", "region_id", "postal_area", norm("name").alias("street_key"))
    own = addresses.select("address_id", "region_id", "postal_area", norm("street").alias("street_key"))
    exact = own.join(streets, ["region_id", "postal_area", "street_key"], "left").groupBy("address_id", "region_id", "street_key").agg(F.min("location_id").alias("exact"))
    other = streets.groupBy("region_id", "street_key").agg(F.min("location_id").alias("other"))
    return exact.join(other, ["region_id", "street_key"], "left").select("address_id", F.coalesce("exact", "other").alias("location_id"))


def without_default_postal(rows: DataFrame) -> DataFrame:
    """rows (region_id, postal_area, name): what stands in a region's default area ('') goes if the region has it in an area with a name."""
    named = rows.where("postal_area <> ''").select("region_id", "name").distinct().withColumn("postal_area", F.lit(""))
    return rows.join(named, ["region_id", "postal_area", "name"], "left_anti")


# ---- ranking and merging of results

#: The weight of kinds of results.
KIND_RANKS = {"country": 1.0, "state": 0.93, "town": 0.9, "street": 0.8, "address": 0.8, "stop": 0.7}


def client_rank(kind: Column, quality: Column, distance: Column) -> Column:
    """What orders results for a user: kind, quality of the match and nearness (metres)."""
    by_kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KIND_RANKS.items() for x in kv]), kind), F.lit(0.5))
    by_match = F.when(quality == "match", 1.0).when(quality == "candidate", 0.75).otherwise(0.5)
    return by_kind * by_match / F.ln(distance / 1000 + F.exp(F.lit(1.0)))


def merged_nearby(found: DataFrame, radius: float, level: int = 14) -> DataFrame:
    """found (obj_id, name, lat, lon) with main_id: results of one name within radius of each other in one step, named by the smallest id that is near."""
    from ..functions import geo

    around = found.select(F.col("obj_id").alias("key"), "name", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.explode(geo.tiles_of_box(geo.box_around(F.col("lat"), F.col("lon"), F.lit(radius)), level)).alias("tile"))
    placed = found.select("obj_id", "name", "lat", "lon", geo.tile(F.col("lat"), F.col("lon"), level).alias("tile"))
    near = around.join(placed, ["tile", "name"]).where(spherical_distance(F.col("a_lat"), F.col("a_lon"), F.col("lat"), F.col("lon")) <= radius)
    return found.join(near.groupBy(F.col("key").alias("obj_id")).agg(F.min("obj_id").alias("main_id")), "obj_id")


# ---- description of places


def crossings_by_name(way_points: DataFrame, ways: DataFrame) -> DataFrame:
    """(node_id, n_names, names): nodes where streets of two names or more meet."""
    named = way_points.join(ways.where("name is not null").select("way_id", "name"), "way_id")
    groups = named.groupBy("node_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return groups.where(F.size("names") >= 2).select("node_id", F.size("names").alias("n_names"), F.array_join("names", ", ").alias("names"))


def milestones_around(stones: DataFrame, positions: DataFrame) -> DataFrame:
    """positions (way_id, pos, key) with before and after: the last milestone (way_id, pos, distance) at or before the place along the way and the next one behind it."""
    rows = stones.select("way_id", "pos", "distance", F.lit(None).cast("long").alias("key"), F.lit(0).alias("side")).unionByName(positions.select("way_id", "pos", F.lit(None).cast("double").alias("distance"), "key", F.lit(1).alias("side")))
    along = Window.partitionBy("way_id").orderBy("pos", "side", "key")
    both = rows.select("*", F.last("distance", True).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("before"), F.first("distance", True).over(along.rowsBetween(0, Window.unboundedFollowing)).alias("after"))
    return both.where("side = 1").select("key", "way_id", "pos", "before", "after")


def place_description(found: DataFrame) -> DataFrame:
    """One row for each place of candidates (place, kind, obj_id, distance, size, inside): the best of each kind as a struct column.

    Objects that hold the place come first, smallest first, then others by distance.
    """
    order = F.struct((~F.col("inside")).alias("out"), F.when(F.col("inside"), F.col("size")).otherwise(F.col("distance")).alias("by"), "obj_id", "distance", "inside")
    best = found.groupBy("place", "kind").agg(F.min(order).alias("b"))
    pick = lambda kind: F.first(F.when(F.col("kind") == kind, F.struct("b.obj_id", "b.distance", "b.inside")), True).alias(kind)
    return best.groupBy("place").agg(*[pick(k) for k in ("name", "address", "poi", "way", "crossing", "milestone")])


def object_description(objects: DataFrame) -> DataFrame:
    """(obj_id, section, entry, value): what the features of objects (obj_id, features: map<string, string>) say, in sections."""
    #: Sections and the features they show, in order.
    sections = (("general", ("name", "name_alt", "ref", "operator", "brand")), ("location", ("location", "address", "postal_code", "is_in")), ("contact", ("phone", "website")), ("opening", ("opening_hours",)), ("routing", ("access", "max_speed", "lanes", "grade")), ("structure", ("bridge", "tunnel", "layer", "width", "elevation")))
    entries = F.array(*[F.struct(F.lit(100 * i + k).alias("no"), F.lit(s).alias("section"), F.lit(f).alias("entry"), F.try_element_at("features", F.lit(f)).alias("value")) for i, (s, fs) in enumerate(sections) for k, f in enumerate(fs)])
    return objects.select("obj_id", F.explode(F.filter(entries, lambda e: e["value"].isNotNull())).alias("e")).select("obj_id", "e.no", "e.section", "e.entry", "e.value")


# ---- names beside the main one, lists and order


def match_regions(regions: DataFrame, pattern: str) -> DataFrame:
    """(region_id, name, quality): regions (region_id, names: array, the main name first) by the name that fits a pattern best; of equally good ones the first."""
    named = regions.select("region_id", F.posexplode("names").alias("pos", "name"))
    rated = named.withColumn("quality", match_quality(F.col("name"), F.lit(pattern))).where("quality is not null")
    best = rated.groupBy("region_id").agg(F.min(F.struct(_rank("quality").alias("rank"), "pos", "name", "quality")).alias("b"))
    return best.select("region_id", "b.name", "b.quality")


def limited_addresses(addresses: DataFrame, limit: int) -> DataFrame:
    """(location_id, address_id, name, rank, limit_reached): each location's addresses by name, the first limit of them; whether there are more."""
    by_name = Window.partitionBy("location_id").orderBy("name", "address_id")
    ranked = addresses.withColumns({"rank": F.row_number().over(by_name), "limit_reached": F.lead("address_id", limit).over(by_name).isNotNull()})
    reached = F.first("limit_reached").over(by_name)
    return ranked.withColumn("limit_reached", reached).where(F.col("rank") <= limit).select("location_id", "address_id", "name", "rank", "limit_reached")


def regions_of_cells(cells: DataFrame) -> DataFrame:
    """(x, y, region_ids): the regions (x, y, region_id, size) of each cell, smallest first, so that the first that holds a point is its region."""
    groups = cells.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("size", "region_id"))).alias("r"))
    return groups.select("x", "y", F.transform("r", lambda r: r["region_id"]).alias("region_ids"))


def distinct_results(results: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """results with one row for each value of keys, the first by order."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return results.withColumn("af_no", F.row_number().over(first)).where("af_no = 1").drop("af_no")


def entries_of_objects(objects: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry_id, kind, obj_id): the addresses, streets and places (entry_id, kind, obj_ids: array) that are made of any of objects (obj_id)."""
    return entries.select("entry_id", "kind", F.explode(F.array_distinct("obj_ids")).alias("obj_id")).join(objects.select("obj_id").distinct(), "obj_id", "left_semi")


def combined_search(structured: DataFrame, free: DataFrame, limit: int) -> DataFrame:
    """(query, obj_id, name, rank): hits (query, obj_id, name, quality) of a structured and of a free-text search, an object once, the structured hit first; the first limit of each query by quality (smaller is better), then name."""
    both = structured.withColumn("af_side", F.lit(0)).unionByName(free.withColumn("af_side", F.lit(1)))
    one = both.groupBy("query", "obj_id").agg(F.min(F.struct("af_side", "quality", "name")).alias("b"))
    order = Window.partitionBy("query").orderBy("b.af_side", "b.quality", "b.name", "obj_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", "obj_id", "b.name", "rank")
