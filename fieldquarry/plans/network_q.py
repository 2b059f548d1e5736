"""Queries of networks from map payloads (S6-S11): orders are ways, suppliers their places, and every thousand orders an area."""

from pyspark.sql import functions as F

from ..sources import network
from .views import Book, hav, rounded

BOOK = Book()
query = BOOK.query


def _payloads(v):
    """(area, payload): each area's ways, ferry relations and some node bodies as the text of a map payload."""
    points = v("ways")
    at = F.array_sort(F.collect_list(F.struct("pos", "node", "latitude", "longitude")))
    ways = points.groupBy("area", "way", "kind").agg(at.alias("p"))
    kind = "struct<type: string, id: bigint, nodes: array<bigint>, tags: map<string,string>, geometry: array<struct<lat: double, lon: double>>, members: array<struct<type: string, ref: bigint, role: string>>>"
    geometry = F.transform("p", lambda x: F.struct(x["latitude"].alias("lat"), x["longitude"].alias("lon")))
    tags = F.when(F.col("kind") == "ferry", F.create_map(F.lit("route"), F.lit("ferry"))).otherwise(F.create_map(F.lit("highway"), F.col("kind")))
    element = F.struct(F.lit("way").alias("type"), F.col("way").alias("id"), F.transform("p", lambda x: x["node"]).alias("nodes"), tags.alias("tags"), geometry.alias("geometry"), F.lit(None).alias("members")).cast(kind)
    ferries = ways.filter("kind = 'ferry'").withColumn("relation", F.col("area") * 100 + F.col("way") % 24)
    # a ferry's first place is a stop, and so is one that no payload holds
    members = F.array(F.struct(F.lit("way").alias("type"), F.col("way").alias("ref"), F.lit("").alias("role")), F.struct(F.lit("node").alias("type"), F.col("p")[0]["node"].alias("ref"), F.lit("stop").alias("role")), F.struct(F.lit("node").alias("type"), (-F.col("way")).alias("ref"), F.lit("stop").alias("role")))
    relations = ferries.groupBy("area", "relation").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(members)))).alias("members"))
    route = F.create_map(F.lit("type"), F.lit("route"), F.lit("route"), F.lit("ferry"))
    relation = F.struct(F.lit("relation").alias("type"), F.col("relation").alias("id"), F.lit(None).alias("nodes"), route.alias("tags"), F.lit(None).alias("geometry"), "members").cast(kind)
    bodies = points.filter("node % 2 = 0").select("area", "node").distinct()
    body = F.struct(F.lit("node").alias("type"), F.col("node").alias("id"), F.lit(None).alias("nodes"), F.lit(None).alias("tags"), F.lit(None).alias("geometry"), F.lit(None).alias("members")).cast(kind)
    every = ways.select("area", F.lit(0).alias("part"), F.col("way").alias("n"), element.alias("e")).unionByName(relations.select("area", F.lit(1).alias("part"), F.col("relation").alias("n"), relation.alias("e"))).unionByName(bodies.select("area", F.lit(2).alias("part"), F.col("node").alias("n"), body.alias("e")))
    rows = every.groupBy("area").agg(F.sort_array(F.collect_list(F.struct("part", "n", F.to_json("e").alias("j")))).alias("es"))
    return rows.select(F.col("area").cast("string").alias("area"), F.concat(F.lit('{"elements":['), F.array_join(F.transform("es", lambda x: x["j"]), ","), F.lit("]}")).alias("payload"))


def _items(v):
    return network.elements(_payloads(v))


_SEGMENTS = f"""seg AS (SELECT *, lead(node) OVER w AS node2, {hav("latitude", "longitude", "lead(latitude) OVER w", "lead(longitude) OVER w")} AS m FROM ways WINDOW w AS (PARTITION BY area, way ORDER BY pos)),
cut AS (SELECT area, way, pos, kind, node, node2, m, 'osm:' || area || ':node:' || node AS n1, 'osm:' || area || ':node:' || node2 AS n2 FROM seg WHERE node2 IS NOT NULL),
roads AS (SELECT least(n1, n2) AS from_node_id, greatest(n1, n2) AS to_node_id, m, area, way, pos, kind FROM cut WHERE kind <> 'ferry' AND node <> node2 AND m > 0),
net AS (SELECT from_node_id, to_node_id, min(m) AS distance_m, arg_min(kind, (m, way, pos)) AS highway, CAST(arg_min(way, (m, way, pos)) AS VARCHAR) AS osm_way_id FROM roads GROUP BY 1, 2),
land AS (SELECT DISTINCT node AS raw, area, 'osm:' || area || ':node:' || node AS land FROM (SELECT *, count(*) OVER (PARTITION BY area, way) AS size FROM ways) WHERE kind <> 'ferry' AND size >= 2)"""


@query(f"WITH {_SEGMENTS} SELECT from_node_id, to_node_id, round(distance_m, 3) AS distance_m, CASE highway WHEN 'path' THEN 'trail' ELSE 'road' END AS network_mode, osm_way_id FROM net")
def s6_highway_network(v):
    _, edges = network.highway_network(_items(v))
    return rounded(edges.select("from_node_id", "to_node_id", "distance_m", "network_mode", "osm_way_id"), 3)


_ENDS = f"""{_SEGMENTS}, ferry AS (SELECT area, way, arg_min(node, pos) AS a, arg_max(node, pos) AS b FROM ways WHERE kind = 'ferry' GROUP BY 1, 2), size AS (SELECT area, way, sum(m) AS m FROM cut WHERE kind = 'ferry' GROUP BY 1, 2),
sea AS (SELECT least(x.land, y.land) AS from_node_id, greatest(x.land, y.land) AS to_node_id, m, f.way AS way, CASE WHEN x.land < y.land THEN x.area || '|' || y.area ELSE y.area || '|' || x.area END AS survey_area_id
  FROM ferry f JOIN size USING (area, way) JOIN land x ON x.raw = f.a JOIN land y ON y.raw = f.b WHERE x.land <> y.land AND m > 0)"""


@query(f"WITH {_ENDS} SELECT from_node_id, to_node_id, round(min(m), 3) AS distance_m FROM sea GROUP BY 1, 2")
def s7_ferry_ways(v):
    items = _items(v)
    nodes, _ = network.highway_network(items)
    return rounded(network.ferry_ways(items, nodes).select("from_node_id", "to_node_id", "distance_m"), 3)


_STOPS = f"""{_SEGMENTS}, rel AS (SELECT area*100 + way%24 AS relation, area, way FROM ways WHERE kind = 'ferry' GROUP BY 1, 2, 3), graph AS (SELECT relation, node, node2, min(m) AS m FROM rel JOIN cut USING (area, way) WHERE node <> node2 GROUP BY 1, 2, 3),
stops AS (SELECT DISTINCT relation, node AS stop FROM rel JOIN ways USING (area, way) WHERE pos = 1 UNION SELECT relation, -way FROM rel),
flags AS (SELECT relation, stop, stop IN (SELECT node FROM ways WHERE node%2 = 0) AS body, stop IN (SELECT node FROM graph g WHERE g.relation = stops.relation UNION SELECT node2 FROM graph g WHERE g.relation = stops.relation) AS inside, stop IN (SELECT raw FROM land) AS land FROM stops)"""


@query(f"WITH {_STOPS} SELECT relation AS ferry_relation_id, stop AS stop_node_id, body AS node_body_present, inside AS in_ferry_member_way_graph, land AS in_land_highway_graph, inside AND land AS exact_terminal_usable FROM flags")
def s9_ferry_stops(v):
    items = _items(v)
    nodes, _ = network.highway_network(items)
    return network.ferry_stops(items, nodes)


@query(f"""WITH RECURSIVE {_STOPS}, ends AS (SELECT relation, stop AS source FROM flags WHERE inside AND land), both_ways AS (SELECT relation, node AS u, node2 AS v, m FROM graph UNION ALL SELECT relation, node2, node, m FROM graph),
paths(relation, source, node, cost) USING KEY (relation, source, node) AS (SELECT relation, source, source, 0e0 FROM ends UNION SELECT n.relation, n.source, n.node, n.cost FROM (SELECT d.relation, d.source, e.v AS node, min(d.cost + e.m) AS cost FROM paths d JOIN both_ways e ON d.relation = e.relation AND d.node = e.u WHERE d.cost + e.m <= 5e6 GROUP BY 1, 2, 3) n
  LEFT JOIN recurring.paths o ON o.relation = n.relation AND o.source = n.source AND o.node = n.node WHERE o.cost IS NULL OR n.cost < o.cost),
sea AS (SELECT least(x.land, y.land) AS from_node_id, greatest(x.land, y.land) AS to_node_id, cost FROM paths p JOIN ends e ON e.relation = p.relation AND e.source = p.node JOIN land x ON x.raw = p.source JOIN land y ON y.raw = p.node WHERE p.source < p.node AND x.land <> y.land)
SELECT from_node_id, to_node_id, round(min(cost), 3) AS distance_m FROM sea GROUP BY 1, 2""")
def s8_ferry_relations(v):
    items = _items(v)
    nodes, _ = network.highway_network(items)
    return rounded(network.ferry_relations(items, nodes, stops_only=True).select("from_node_id", "to_node_id", "distance_m"), 3)


@query(f"""WITH RECURSIVE {_STOPS}, step AS (SELECT from_node_id AS u, to_node_id AS v FROM net UNION SELECT to_node_id, from_node_id FROM net), r AS (SELECT u AS v, u AS c FROM step UNION SELECT r.v, s.v FROM r JOIN step s ON r.c = s.u), k AS (SELECT v AS node, min(c) AS component FROM r GROUP BY 1),
so_far AS (SELECT raw FROM land WHERE area%2 = 1), marked AS (SELECT node, component, CAST(regexp_extract(node, ':node:([0-9-]+)$', 1) AS BIGINT) AS raw FROM k),
kept AS (SELECT node FROM marked WHERE component IN (SELECT component FROM marked WHERE raw IN (SELECT stop FROM stops)) AND component IN (SELECT component FROM marked WHERE raw IN (SELECT raw FROM so_far)))
SELECT from_node_id, to_node_id, round(distance_m, 3) AS distance_m FROM net WHERE from_node_id IN (SELECT node FROM kept)""")
def s10_stop_highways(v):
    items = _items(v)
    nodes, edges = network.highway_network(items)
    stops = network.ferry_stops(items, nodes)
    # the network known so far is that of every other area
    known = nodes.filter(F.col("survey_area_id").cast("long") % 2 == 1)
    _, edges = network.stop_highways(items, known, stops, (nodes, edges))
    return rounded(edges.select("from_node_id", "to_node_id", "distance_m"), 3)


@query(f"""WITH {_ENDS}, every AS (SELECT from_node_id, to_node_id, distance_m, 0 AS source FROM net UNION ALL SELECT from_node_id, to_node_id, min(m), 1 FROM sea GROUP BY 1, 2)
SELECT from_node_id, to_node_id, round(min(distance_m), 3) AS distance_m, CASE arg_min(source, (distance_m, source)) WHEN 0 THEN 'land' ELSE 'ferry' END AS kind FROM every GROUP BY 1, 2""")
def s11_merged_network(v):
    items = _items(v)
    nodes, edges = network.highway_network(items)
    sea = network.ferry_ways(items, nodes)
    _, merged = network.merge_networks([nodes], [edges, sea])
    kind = F.when(F.col("network_mode") == "ferry", "ferry").otherwise("land")
    return rounded(merged.select("from_node_id", "to_node_id", "distance_m", kind.alias("kind")), 3)
