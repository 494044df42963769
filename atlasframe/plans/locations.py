"""Queries by name: the tree of regions, streets, addresses, points of interest and prefix search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import locations as ops, region_tree
from ..registry import query
from ..session import share_package
from .sample import haversine, sql, table, view, way_lines, way_points

_TREE = ", tree AS (SELECT region_id, region_id AS ancestor_id, 0 AS up FROM regions UNION ALL SELECT t.region_id, r.parent_id, t.up + 1 FROM tree t JOIN regions r ON r.region_id = t.ancestor_id WHERE r.parent_id IS NOT NULL)"


def _tree(spark, sf_dir):
    return ops.closure(view(spark, sf_dir, "regions"))


@query(sql("regions")(f"{_TREE} SELECT region_id, ancestor_id, up FROM tree"))
def l1_region_tree(spark, sf_dir):
    return _tree(spark, sf_dir)


@query(sql("regions", "locations")(f"{_TREE} SELECT ancestor_id AS region_id, count(*) AS n_locations FROM tree JOIN locations USING (region_id) GROUP BY ancestor_id"))
def l2_locations_below(spark, sf_dir):
    below = _tree(spark, sf_dir).join(view(spark, sf_dir, "locations"), "region_id")
    return below.groupBy(F.col("ancestor_id").alias("region_id")).agg(F.count("*").alias("n_locations"))


@query(sql("regions")("SELECT c.region_id, 2 AS depth, c.name || ', ' || n.name || ', ' || r.name AS path FROM regions c JOIN regions n ON c.parent_id = n.region_id JOIN regions r ON n.parent_id = r.region_id UNION ALL SELECT n.region_id, 1, n.name || ', ' || r.name FROM regions n JOIN regions r ON n.parent_id = r.region_id WHERE n.level = 4 UNION ALL SELECT region_id, 0, name FROM regions WHERE level = 2"))
def l3_ancestor_names(spark, sf_dir):
    return ops.full_names(view(spark, sf_dir, "regions"), _tree(spark, sf_dir))


@query("""SELECT p_partkey, CASE WHEN a = b THEN a || ' ' || b || '()|' || a || '(' || b || ')|' || b || '(' || a || ')' ELSE a || ' ' || b || '()|' || CASE WHEN length(a) > length(b) OR (length(a) = length(b) AND a < b) THEN a || '(' || b || ')|' || b || '(' || a || ')' ELSE b || '(' || a || ')|' || a || '(' || b || ')' END END AS patterns FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)""")
def l4_search_patterns(spark, sf_dir):
    from ..functions.text import tokens

    p = table(spark, sf_dir, "part").select("p_partkey", ops.search_patterns(tokens(F.col("p_name")), 4, []).alias("p"))
    return p.select("p_partkey", F.array_join(F.transform("p", lambda x: F.concat(x["text"], F.lit("("), F.array_join(x["rest"], " "), F.lit(")"))), "|").alias("patterns"))


@query(sql("regions", "locations", "addresses")(f"""{_TREE}, q AS (SELECT address_id AS query_id, a.location_id, l.region_id, l.name AS street, a.name AS house, r.name AS city FROM addresses a JOIN locations l USING (location_id) JOIN regions r ON r.region_id = l.region_id),
cities AS (SELECT q.*, r.region_id AS found_id FROM q JOIN regions r ON r.name = q.city),
streets AS (SELECT c.query_id, c.house, l.region_id, l.location_id, l.name = c.street AS same FROM cities c JOIN tree t ON t.ancestor_id = c.found_id JOIN locations l ON l.region_id = t.region_id WHERE contains(' ' || l.name || ' ', ' ' || c.street || ' ') ),
houses AS (SELECT s.query_id, s.region_id, s.location_id, min(CASE WHEN upper(a.name) = upper(s.house) THEN 1000000000 + a.address_id WHEN contains(upper(a.name), upper(s.house)) THEN 2000000000 + a.address_id END) AS k FROM streets s LEFT JOIN addresses a ON a.location_id = s.location_id WHERE same GROUP BY ALL)
SELECT query_id, region_id, location_id, k % 1000000000 AS address_id, 'match' AS region_quality, 'match' AS location_quality, CASE WHEN k < 2000000000 THEN 'match' WHEN k IS NOT NULL THEN 'candidate' END AS address_quality FROM houses"""))
def l5_search_by_string(spark, sf_dir):
    """Every address asked for as free text: city, street and house. Of the answers those where city and street match."""
    regions, streets, houses = (view(spark, sf_dir, n) for n in ("regions", "locations", "addresses"))
    asked = houses.join(streets.select("location_id", "region_id", F.col("name").alias("street")), "location_id").join(regions.select("region_id", F.col("name").alias("city")), "region_id")
    queries = asked.select(F.col("address_id").alias("query_id"), F.concat_ws(" ", "city", "street", "name").alias("query"))
    found = ops.search_by_string(queries, regions, streets, houses, _tree(spark, sf_dir), [])
    return found.where("region_quality = 'match' and location_quality = 'match'")


@query(sql("regions", "locations", "addresses")(f"""{_TREE}, top AS (SELECT t.region_id, min(CASE WHEN upper(r.name) = 'NATION_1' THEN 1 ELSE 2 END) AS q FROM regions r JOIN tree t ON t.ancestor_id = r.region_id WHERE contains(upper(r.name), 'NATION_1') GROUP BY t.region_id),
s AS (SELECT l.region_id, l.location_id, q, CASE WHEN upper(l.name) = 'STATION ROAD 3' THEN 'match' ELSE 'candidate' END AS lq FROM locations l JOIN top USING (region_id) WHERE contains(upper(l.name), 'STATION ROAD 3'))
SELECT s.region_id, s.location_id, a.address_id, CASE WHEN q = 1 THEN 'match' ELSE 'candidate' END AS region_quality, lq AS location_quality, CASE WHEN a.name = '5' THEN 'match' WHEN a.name IS NOT NULL THEN 'candidate' END AS address_quality FROM s LEFT JOIN addresses a ON a.location_id = s.location_id AND contains(a.name, '5')"""))
def l6_search_by_form(spark, sf_dir):
    r, loc, a = (view(spark, sf_dir, n) for n in ("regions", "locations", "addresses"))
    return ops.search_by_form(r, loc, a, _tree(spark, sf_dir), "nation_1", "station road 3", "5")


@query(sql("regions", "pois")(f"""{_TREE} SELECT poi_id, p.region_id, CASE WHEN min(CASE WHEN upper(r.name) = 'ASIA' THEN 1 ELSE 2 END) = 1 THEN 'match' ELSE 'candidate' END AS region_quality, CASE WHEN p.name = 'Supplier#000000002' THEN 'match' ELSE 'candidate' END AS poi_quality FROM pois p JOIN tree t USING (region_id) JOIN regions r ON r.region_id = t.ancestor_id WHERE contains(upper(r.name), 'ASIA') AND contains(p.name, '00000') GROUP BY poi_id, p.region_id, p.name"""))
def l7_search_pois(spark, sf_dir):
    return ops.search_pois(view(spark, sf_dir, "regions"), view(spark, sf_dir, "pois"), _tree(spark, sf_dir), "asia", "00000").withColumn("poi_quality", F.when(F.lit(False), "").otherwise(F.col("poi_quality"))).transform(
        lambda df: df.join(view(spark, sf_dir, "pois").select("poi_id", F.col("name")), "poi_id").select("poi_id", "region_id", "region_quality", F.when(F.col("name") == "Supplier#000000002", "match").otherwise("candidate").alias("poi_quality"))
    )


@query("""SELECT lang AS "group", t AS text, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS refs FROM (SELECT lang, split_part(coalesce(text, ''), ' ', 1) AS t, doc_id FROM documents) WHERE t <> '' AND starts_with(lower(strip_accents(replace(t, 'ß', 'ss'))), 'a') AND lang IN ('de', 'en') AND regexp_full_match(t, '[A-Za-zÄÖÜäöüßéèáíóú]+') GROUP BY lang, t""")
def l10_prefix_search(spark, sf_dir):
    """First words of documents as names, by language as group."""
    share_package(spark)
    d = table(spark, sf_dir, "documents")
    first = F.substring_index(F.coalesce("text", F.lit("")), " ", 1)
    entries = d.select(F.col("lang").alias("group"), first.alias("text"), F.col("doc_id").alias("ref")).where(F.regexp_like("text", F.lit("^[A-Za-zÄÖÜäöüßéèáíóú]+$")))
    return ops.prefix_search(ops.text_index(entries), "A", ["de", "en"]).select("group", "text", F.array_join("refs", ",").alias("refs"))


@query(sql("nodes")("""SELECT type AS key, arg_min(name, (-n, name)) AS name FROM (SELECT type, split_part(name, ' ', 1) AS name, count(*) AS n FROM nodes WHERE type LIKE 'stock%' GROUP BY ALL) GROUP BY type"""))
def a6_name_votes(spark, sf_dir):
    n = view(spark, sf_dir, "nodes").where("type like 'stock%'")
    return ops.name_votes(n.select(F.col("type").alias("key"), F.substring_index("name", " ", 1).alias("name")))


@query(sql("locations")("""SELECT DISTINCT 'ROAD' AS token FROM locations"""))
def a7_ignorable_tokens(spark, sf_dir):
    """Of 'Station Road 7' only ROAD is short and stands in more than a hundredth of the names' tokens, numbers aside."""
    names = view(spark, sf_dir, "locations").select("name")
    t = ops.ignorable_tokens(names.where("name rlike '[a-z]'"))
    return t.where(F.regexp_like("token", F.lit("^[A-Z]+$")))


@query("SELECT * FROM (VALUES ('region', 2), ('location', 3), ('address', 1), ('poi', 1)) AS t(kind, words)")
def a8_region_metrics(spark, sf_dir):
    return ops.region_metrics(*(view(spark, sf_dir, n) for n in ("regions", "locations", "addresses", "pois")))


@query("SELECT 2 AS depth")
def a9_tree_depth(spark, sf_dir):
    return _tree(spark, sf_dir).agg(F.max("up").alias("depth"))


@query(sql("locations", "addresses")("""SELECT a.address_id, a.location_id FROM addresses a"""))
def j10_matched_addresses(spark, sf_dir):
    """Addresses by the name of their street, every third with another postal area."""
    loc = view(spark, sf_dir, "locations")
    own = view(spark, sf_dir, "addresses").join(loc.select("location_id", "region_id", "postal_area", F.upper("name").alias("street")), "location_id")
    moved = own.withColumn("postal_area", F.when(F.col("address_id") % 3 == 0, "00000").otherwise(F.col("postal_area")))
    return ops.matched_addresses(moved, loc)


@query(sql("locations")("""SELECT region_id, postal_area, name FROM locations WHERE location_id % 2 = 0 UNION ALL SELECT region_id, '', name FROM locations WHERE location_id % 2 = 1"""))
def u6_postal_cleanup(spark, sf_dir):
    loc = view(spark, sf_dir, "locations").select("location_id", "region_id", "postal_area", "name")
    rows = loc.where("location_id % 2 = 0").unionByName(loc.withColumn("postal_area", F.lit("")))
    return ops.without_default_postal(rows.drop("location_id"))


@query(sql("nodes")(f"""SELECT a.obj_id, min(b.obj_id) AS main_id FROM nodes a JOIN nodes b ON a.type = b.type AND abs(a.lat - b.lat) < 0.05 AND abs(a.lon - b.lon) < 0.08 AND {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 4000 GROUP BY a.obj_id"""))
def u5_merged_nearby(spark, sf_dir):
    n = view(spark, sf_dir, "nodes").select("obj_id", F.col("type").alias("name"), "lat", "lon")
    return ops.merged_nearby(n, 4000.0, 13).select("obj_id", "main_id")


@query(sql("nodes")(f"""SELECT obj_id, round(CASE WHEN type = 'depot' THEN 0.9 ELSE 0.5 END * 0.75 / ln({haversine('48.1', '8.2', 'lat', 'lon')} / 1000 + exp(1)), 6) AS rank FROM nodes"""))
def o9_client_rank(spark, sf_dir):
    from ..functions.geo import spherical_distance

    n = view(spark, sf_dir, "nodes")
    kind = F.when(F.col("type") == "depot", "town").otherwise("shop")
    return n.select("obj_id", F.round(ops.client_rank(kind, F.lit("candidate"), spherical_distance(F.lit(48.1), F.lit(8.2), F.col("lat"), F.col("lon"))), 6).alias("rank"))


@query(sql("regions")("""SELECT region_id, quality, limit_reached, rank FROM (SELECT region_id, CASE WHEN name = 'NATION_1' THEN 'match' ELSE 'candidate' END AS quality, count(*) OVER () > 10 AS limit_reached, CAST(row_number() OVER (ORDER BY name <> 'NATION_1', name, region_id) AS INT) AS rank FROM regions WHERE contains(name, 'NATION_1')) WHERE rank <= 10"""))
def o3_ranked_with_limit(spark, sf_dir):
    from ..functions.text import match_quality

    r = view(spark, sf_dir, "regions").withColumn("name_quality", match_quality(F.col("name"), F.lit("nation_1"))).where("name_quality is not null")
    return ops.ranked(r, 10, "name", "region_id").select("region_id", F.col("name_quality").alias("quality"), "limit_reached", "rank")


@query(sql("ways", "way_points")("""SELECT node_id, count(DISTINCT name) AS n_names FROM way_points JOIN ways USING (way_id) GROUP BY node_id HAVING count(DISTINCT name) >= 2"""))
def a15_crossings(spark, sf_dir):
    c = ops.crossings_by_name(way_points(spark, sf_dir), view(spark, sf_dir, "ways"))
    return c.select("node_id", F.col("n_names").cast("long").alias("n_names"))


@query("""WITH s AS (SELECT l_orderkey AS way_id, CAST(l_linenumber AS DOUBLE) AS pos, min(l_quantity) AS distance FROM lineitem GROUP BY ALL), p AS (SELECT DISTINCT l_orderkey AS way_id, CAST(2.5 AS DOUBLE) AS pos, l_orderkey AS key FROM lineitem)
SELECT key, (SELECT arg_max(distance, s.pos) FROM s WHERE s.way_id = p.way_id AND s.pos <= p.pos) AS before, (SELECT arg_min(distance, s.pos) FROM s WHERE s.way_id = p.way_id AND s.pos >= p.pos) AS after FROM p""")
def w10_milestones(spark, sf_dir):
    """Line numbers as milestones along an order, around 2.5."""
    items = table(spark, sf_dir, "lineitem")
    stones = items.groupBy(F.col("l_orderkey").alias("way_id"), F.col("l_linenumber").cast("double").alias("pos")).agg(F.min("l_quantity").alias("distance"))
    places = items.select(F.col("l_orderkey").alias("way_id"), F.lit(2.5).alias("pos"), F.col("l_orderkey").alias("key")).distinct()
    return ops.milestones_around(stones, places).select("key", "before", "after")


@query(sql("nodes")("""SELECT obj_id % 50 AS place, arg_min(obj_id, (lat, obj_id)) FILTER (type = 'depot') AS poi_id, arg_min(obj_id, (lat, obj_id)) FILTER (type <> 'depot') AS name_id FROM nodes GROUP BY obj_id % 50"""))
def l15_place_description(spark, sf_dir):
    n = view(spark, sf_dir, "nodes")
    found = n.select((F.col("obj_id") % 50).alias("place"), F.when(F.col("type") == "depot", "poi").otherwise("name").alias("kind"), "obj_id", F.col("lat").alias("distance"), F.lit(0.0).alias("size"), F.lit(False).alias("inside"))
    return ops.place_description(found).select("place", F.col("poi.obj_id").alias("poi_id"), F.col("name.obj_id").alias("name_id"))


@query(sql("ways")("""SELECT way_id AS obj_id, 'general' AS section, 'name' AS entry, name AS value FROM ways UNION ALL SELECT way_id, 'routing', 'max_speed', CAST(maxspeed AS VARCHAR) FROM ways WHERE maxspeed IS NOT NULL UNION ALL SELECT way_id, 'routing', 'grade', CAST(grade AS VARCHAR) FROM ways"""))
def d1_object_description(spark, sf_dir):
    w = view(spark, sf_dir, "ways")
    f = F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.lit("max_speed"), F.col("maxspeed").cast("string"), F.lit("grade"), F.col("grade").cast("string")), lambda k, v: v.isNotNull())
    return ops.object_description(w.select(F.col("way_id").alias("obj_id"), f.alias("features"))).drop("no")


@query(sql("regions")("""SELECT region_id, CASE WHEN contains(upper(name), 'AS') THEN name ELSE 'Area ' || name END AS name, CASE WHEN upper(name) = 'ASIA' THEN 'match' ELSE 'candidate' END AS quality FROM regions WHERE contains(upper(name), 'ASIA')
UNION ALL SELECT region_id, 'Asia ' || region_id, 'candidate' FROM regions WHERE region_id % 2 = 0 AND NOT contains(upper(name), 'ASIA')"""))
def l9_other_names(spark, sf_dir):
    """Regions with an even number have a second name."""
    r = view(spark, sf_dir, "regions")
    names = F.when(F.col("region_id") % 2 == 0, F.array("name", F.concat(F.lit("Asia "), F.col("region_id").cast("string")))).otherwise(F.array("name"))
    return ops.match_regions(r.select("region_id", names.alias("names")), "asia")


@query(sql("addresses")("""SELECT location_id, address_id, name, CAST(n AS INT) AS rank, total > 3 AS limit_reached FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY name, address_id) AS n, count(*) OVER (PARTITION BY location_id) AS total FROM addresses) WHERE n <= 3"""))
def o4_limited_addresses(spark, sf_dir):
    return ops.limited_addresses(view(spark, sf_dir, "addresses"), 3)


@query(sql("regions")("""SELECT CAST(floor(min_lon) AS BIGINT) AS x, CAST(floor(min_lat) AS BIGINT) AS y, array_to_string(list(region_id ORDER BY size, region_id), ',') AS regions FROM (SELECT *, (max_lat - min_lat) * (max_lon - min_lon) AS size FROM regions) GROUP BY ALL"""))
def o7_regions_of_cells(spark, sf_dir):
    r = view(spark, sf_dir, "regions")
    cells = r.select(F.floor("min_lon").alias("x"), F.floor("min_lat").alias("y"), "region_id", ((F.col("max_lat") - F.col("min_lat")) * (F.col("max_lon") - F.col("min_lon"))).alias("size"))
    return ops.regions_of_cells(cells).select("x", "y", F.array_join(F.transform("region_ids", lambda i: i.cast("string")), ",").alias("regions"))


@query(sql("addresses", "locations")("""SELECT name AS street, min(location_id) AS location_id FROM locations GROUP BY name"""))
def u3_distinct_results(spark, sf_dir):
    """Streets by name, each once."""
    streets = view(spark, sf_dir, "locations").select(F.col("name").alias("street"), "location_id")
    return ops.distinct_results(streets, ["street"], ["location_id"])


@query("""SELECT DISTINCT l_orderkey AS entry_id, CASE WHEN l_orderkey % 2 = 0 THEN 'street' ELSE 'address' END AS kind, l_partkey AS obj_id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10)""")
def j12_entries_of_objects(spark, sf_dir):
    """Orders as entries made of parts, asked for by the small parts."""
    items = table(spark, sf_dir, "lineitem")
    entries = items.groupBy(F.col("l_orderkey").alias("entry_id")).agg(F.collect_list("l_partkey").alias("obj_ids")).withColumn("kind", F.when(F.col("entry_id") % 2 == 0, "street").otherwise("address"))
    return ops.entries_of_objects(table(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").alias("obj_id")), entries)


@query("""WITH s AS (SELECT c_nationkey AS query, c_custkey AS obj_id, c_name AS name, 1 + c_custkey % 3 AS quality, 0 AS side FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_nationkey, c_custkey, 'near ' || c_name, 1 + c_custkey % 2, 1 FROM customer),
o AS (SELECT query, obj_id, arg_min(name, side) AS name, arg_min(quality, side) AS quality, min(side) AS side FROM s GROUP BY query, obj_id)
SELECT query, obj_id, name, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY side, quality, name, obj_id) AS rank FROM o) WHERE rank <= 20""")
def l11_combined_search(spark, sf_dir):
    """Nations as queries: half of a nation's customers found by structure, all of them by text."""
    c = table(spark, sf_dir, "customer")
    hits = lambda rows, name, kinds: rows.select(F.col("c_nationkey").alias("query"), F.col("c_custkey").alias("obj_id"), name.alias("name"), (1 + F.col("c_custkey") % kinds).alias("quality"))
    return ops.combined_search(hits(c.where("c_custkey % 2 = 0"), F.col("c_name"), 3), hits(c, F.concat(F.lit("near "), F.col("c_name")), 2), 20)


def _boundaries(spark, sf_dir):
    """The regions' boxes as rings, each with its level and name but without its parent."""
    corner = lambda lat, lon: F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    ring = F.array(corner("min_lat", "min_lon"), corner("min_lat", "max_lon"), corner("max_lat", "max_lon"), corner("max_lat", "min_lon"))
    return view(spark, sf_dir, "regions").select("region_id", "name", "level", ring.alias("ring"))


@query(sql("regions")("""SELECT region_id, parent_id, name, CAST(level AS INT) AS level, CAST(CASE level WHEN 2 THEN 0 WHEN 4 THEN 1 ELSE 2 END AS INT) AS depth FROM regions"""))
def l12_built_regions(spark, sf_dir):
    """The tree of regions from their rings alone: parents are found, not read."""
    return region_tree.build_regions(_boundaries(spark, sf_dir))


@query(sql("regions", "nodes")("""SELECT region_id, obj_id AS node_id, n.name FROM (SELECT * FROM nodes WHERE type = 'depot') n JOIN regions r ON r.level = 8 AND n.lat >= min_lat AND n.lat < max_lat AND n.lon >= min_lon AND n.lon < max_lon"""))
def l12_built_aliases(spark, sf_dir):
    """Suppliers as places: other names of the cities that they lie in."""
    b = _boundaries(spark, sf_dir)
    places = view(spark, sf_dir, "nodes").where("type = 'depot'").select(F.col("obj_id").alias("node_id"), "name", "lat", "lon")
    return region_tree.build_aliases(places, region_tree.build_regions(b), b)


@query(sql("regions", "ways", "way_points")(""", v AS (SELECT way_id, region_id, count(*) AS n FROM way_points p JOIN regions r ON r.level = 8 AND p.lat >= min_lat AND p.lat < max_lat AND p.lon >= min_lon AND p.lon < max_lon GROUP BY ALL),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY way_id ORDER BY n DESC, region_id) = 1)
SELECT region_id, name, count(*) AS n_ways, sum(n)::BIGINT AS n_points FROM b JOIN ways USING (way_id) GROUP BY region_id, name"""))
def l12_built_streets(spark, sf_dir):
    """Ways as streets: the locations of each city, with their ways and these ways' points inside it."""
    b = _boundaries(spark, sf_dir)
    w = way_lines(spark, sf_dir).select("way_id", "name", "points")
    s = region_tree.streets_of_regions(w, region_tree.build_regions(b), b)
    places, objects = region_tree.build_locations(s)
    points = s.join(w.select("way_id", F.size("points").alias("n")), "way_id").select("way_id", F.round(F.col("share") * F.col("n")).cast("long").alias("n_points"))
    return places.join(objects, "location_id").join(points, "way_id").groupBy("region_id", "name").agg(F.count("*").alias("n_ways"), F.sum("n_points").alias("n_points"))
