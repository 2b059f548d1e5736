"""Road, trail and ferry networks from map payloads.

Payload files are JSON text, one per survey area; every step is a join or an aggregation over their exploded elements.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..operators.graph import bounded_paths, components
from .scratch import materialise

# fixed values: the parts of a payload that are read, and the highway classes that count as trails
PAYLOAD = """elements array<struct<type: string, id: bigint, nodes: array<bigint>, role: string,
  tags: map<string, string>, lat: double, lon: double, geometry: array<struct<lat: double, lon: double>>,
  members: array<struct<type: string, ref: bigint, role: string>>>>"""
TRAILS = ("path", "footway", "bridleway", "steps", "track")
#: Edges of an area that one task takes for its components.
AREA_EDGES = 4_000_000


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(area, payload) of a folder of JSON files; the area is the file's name without its ending."""
    files = spark.read.text(path, wholetext=True).withColumn("area", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return files.select("area", F.col("value").alias("payload"))


def elements(payloads: DataFrame) -> DataFrame:
    """One row per element of each area's payload, parsed once and written: every step below reads elements several times."""
    parsed = payloads.select(F.col("area").cast("string").alias("area"), F.from_json("payload", PAYLOAD).alias("p"))
    return materialise(parsed.select("area", F.posexplode("p.elements").alias("place", "e")).select("area", "place", "e.*"), "elements")


def _way_points(ways: DataFrame) -> DataFrame:
    """(area, way, pos, raw, node, lat, lon): points of ways; node names by raw id where ids line up with the geometry, else by coordinates."""
    good = (F.size("geometry") >= 2) & ~F.exists("geometry", lambda g: g.lat.isNull() | g.lon.isNull())
    points = ways.filter(good).withColumn("_aligned", F.coalesce(F.size("nodes") == F.size("geometry"), F.lit(False)))
    points = points.select("area", "place", F.col("id").alias("way"), "tags", "nodes", "_aligned", F.posexplode("geometry").alias("pos", "g"))
    raw = F.when(F.col("_aligned"), F.expr("nodes[pos]"))
    coordinate = F.concat(F.lit("osm:"), F.col("area"), F.lit(":coord:"), F.format_string("%.7f,%.7f", F.col("g.lat"), F.col("g.lon")))
    name = F.coalesce(F.concat(F.lit("osm:"), F.col("area"), F.lit(":node:"), raw.cast("string")), coordinate)
    return points.select("area", "place", "way", "tags", "pos", raw.alias("raw"), name.alias("node"), F.col("g.lat").alias("latitude"), F.col("g.lon").alias("longitude"))


def _segments(points: DataFrame) -> DataFrame:
    """Consecutive points of a way as segments with their length."""
    w = Window.partitionBy("area", "place").orderBy("pos")
    out = points.withColumns({"_to": F.lead("node").over(w), "_to_raw": F.lead("raw").over(w), "_lat2": F.lead("latitude").over(w), "_lon2": F.lead("longitude").over(w)}).filter("_to is not null")
    return out.withColumn("distance_m", haversine_m("latitude", "longitude", "_lat2", "_lon2"))


def highway_network(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of highway ways (S6): shared node ids join ways, the shortest of equal edges stays.

    A node with two positions more than 1e-7 degrees apart is an error.
    """
    ways = items.filter((F.col("type") == "way") & (F.trim(F.coalesce(F.col("tags")["highway"], F.lit(""))) != ""))
    points = _way_points(ways)
    spread = points.groupBy("area", "node").agg(F.min_by(F.struct("latitude", "longitude"), F.struct("place", "pos")).alias("p"), *[f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("latitude", "longitude")])
    spread = materialise(spread, "network-nodes")
    torn = spread.filter((F.col("hi_latitude") - F.col("lo_latitude") > 1e-7) | (F.col("hi_longitude") - F.col("lo_longitude") > 1e-7)).limit(1).collect()
    if torn:
        raise ValueError(f"node {torn[0].node} has inconsistent coordinates in area {torn[0].area}")
    nodes = spread.select(F.col("node").alias("network_node_id"), F.col("area").alias("survey_area_id"), "p.latitude", "p.longitude")
    cut = _segments(points).filter("node <> _to and distance_m > 0 and distance_m < double('infinity')")
    highway = F.trim(F.col("tags")["highway"])
    cut = cut.select(F.least("node", "_to").alias("from_node_id"), F.greatest("node", "_to").alias("to_node_id"), "distance_m", F.col("area").alias("survey_area_id"), F.when(highway.isin(*TRAILS), "trail").otherwise("road").alias("network_mode"), highway.alias("highway"), F.col("way").cast("string").alias("osm_way_id"), "place", "pos")
    best = cut.groupBy("from_node_id", "to_node_id").agg(F.min(F.struct("distance_m", "place", "pos", "survey_area_id", "network_mode", "highway", "osm_way_id")).alias("b"))
    return nodes, best.select("from_node_id", "to_node_id", "b.distance_m", "b.survey_area_id", "b.network_mode", "b.highway", "b.osm_way_id")


def _land(nodes: DataFrame) -> DataFrame:
    raw = F.regexp_extract("network_node_id", r":node:([0-9-]+)$", 1)
    return nodes.select(raw.alias("raw"), F.col("network_node_id").alias("land_node"), F.col("survey_area_id").alias("land_area")).filter("raw <> ''")


def _ferry_edges(ends: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Edges between every pair of land copies of two raw ends; ``ends``: a_raw, b_raw, distance_m and ``columns``."""
    land = _land(nodes)
    a = land.select(F.col("raw").alias("a_raw"), F.col("land_node").alias("_n1"), F.col("land_area").alias("_a1"))
    b = land.select(F.col("raw").alias("b_raw"), F.col("land_node").alias("_n2"), F.col("land_area").alias("_a2"))
    met = ends.join(a, "a_raw").join(b, "b_raw").filter("_n1 <> _n2")
    first = F.col("_n1") < F.col("_n2")
    area = F.when(first, F.concat_ws("|", "_a1", "_a2")).otherwise(F.concat_ws("|", "_a2", "_a1"))
    met = met.select(F.least("_n1", "_n2").alias("from_node_id"), F.greatest("_n1", "_n2").alias("to_node_id"), "distance_m", area.alias("survey_area_id"), F.lit("ferry").alias("network_mode"), *columns)
    return met.groupBy("from_node_id", "to_node_id").agg(F.min(F.struct("distance_m", "survey_area_id", "network_mode", *columns)).alias("b")).select("from_node_id", "to_node_id", "b.*")


def ferry_ways(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of ferry ways both of whose ends are land nodes by raw id, the shortest for each pair."""
    ways = items.filter((F.col("type") == "way") & (F.col("tags")["route"] == "ferry") & (F.size("nodes") == F.size("geometry")))
    points = _way_points(ways)
    length = _segments(points).groupBy("area", "place").agg(F.sum("distance_m").alias("distance_m"))
    ends = points.groupBy("area", "place").agg(F.min_by("raw", "pos").cast("string").alias("a_raw"), F.max_by("raw", "pos").cast("string").alias("b_raw"), F.first("way").cast("string").alias("osm_way_id"))
    return _ferry_edges(ends.join(length, ["area", "place"]).filter("distance_m > 0"), nodes, ["osm_way_id"])


def _relations(items: DataFrame) -> DataFrame:
    return items.filter((F.col("type") == "relation") & (F.col("tags")["type"] == "route") & (F.col("tags")["route"] == "ferry"))


def relation_segments(items: DataFrame) -> DataFrame:
    """(relation, u, v, distance_m): the graph of each ferry relation's member ways by raw node ids."""
    members = _relations(items).select("area", F.col("id").alias("relation"), F.explode("members").alias("m")).filter("m.type = 'way'").select("area", "relation", F.col("m.ref").alias("way")).distinct()
    ways = items.filter((F.col("type") == "way") & (F.size("nodes") == F.size("geometry")))
    cut = _segments(_way_points(ways)).filter("raw is not null and raw <> _to_raw")
    found = members.join(cut.select("area", "way", F.col("raw").alias("u"), F.col("_to_raw").alias("v"), "distance_m"), ["area", "way"]).groupBy("relation", "u", "v").agg(F.min("distance_m").alias("distance_m"))
    return materialise(found, "relation-segments")


def ferry_stops(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every member of role ``stop`` of a ferry relation: whether its node is there, in the relation's graph, on land, and usable."""
    stops = _relations(items).select(F.col("id").alias("relation"), F.explode("members").alias("m")).filter("m.type = 'node' and m.role = 'stop' and m.ref is not null").select("relation", F.col("m.ref").alias("stop"))
    bodies = items.filter("type = 'node'").select(F.col("id").alias("stop"), F.lit(True).alias("_body")).distinct()
    cut = relation_segments(items)
    inside = cut.select("relation", F.col("u").alias("stop")).union(cut.select("relation", "v")).distinct().withColumn("_in", F.lit(True))
    land = _land(nodes).select(F.col("raw").cast("long").alias("stop"), F.lit(True).alias("_land")).distinct()
    out = stops.join(bodies, "stop", "left").join(inside, ["relation", "stop"], "left").join(land, "stop", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return out.select(F.col("relation").alias("ferry_relation_id"), F.col("stop").alias("stop_node_id"), flag("_body").alias("node_body_present"), flag("_in").alias("in_ferry_member_way_graph"), flag("_land").alias("in_land_highway_graph"), (flag("_in") & flag("_land")).alias("exact_terminal_usable"))


def ferry_relations(items: DataFrame, nodes: DataFrame, stops_only: bool = False, limit_m: float = 5e6) -> DataFrame:
    """Edges between land-matched terminals of each ferry relation, as long as the shortest path over its member ways.

    ``stops_only``: terminals are the usable stops (S9), else every node of the graph that is on land.
    """
    cut = relation_segments(items)
    ends = cut.select("relation", F.col("u").alias("source")).union(cut.select("relation", "v")).distinct()
    if stops_only:
        ends = ferry_stops(items, nodes).filter("exact_terminal_usable").select(F.col("ferry_relation_id").alias("relation"), F.col("stop_node_id").alias("source")).distinct()
    land = _land(nodes).select(F.col("raw").cast("long").alias("source")).distinct()
    ends = ends.join(land, "source", "left_semi").select("relation", "source")
    pairs = bounded_paths(cut, ends, limit_m, "u", "v", keys=["relation"], targets=ends.withColumnRenamed("source", "node")).filter("source < node")
    named = pairs.select(F.col("source").cast("string").alias("a_raw"), F.col("node").cast("string").alias("b_raw"), F.col("cost").alias("distance_m"), F.col("relation").cast("string").alias("ferry_relation_id"))
    return _ferry_edges(named, nodes, ["ferry_relation_id"])


def _linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of n nodes can reach over edges (a, b)."""
    label = np.arange(n)
    while True:
        one, two = label[a], label[b]
        if not (apart := one != two).any():
            return label
        np.minimum.at(label, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        while ((up := label[label]) != label).any():
            label = up


def area_components(edges: DataFrame) -> DataFrame:
    """(node, component) of a highway network: the smallest node that each can reach.

    Names of nodes hold their area, so edges never leave it, and an area, which came as one payload, is a group; areas of more
    than ``AREA_EDGES`` edges go by ``components``.
    """
    slim = edges.select("survey_area_id", "from_node_id", "to_node_id")
    large = materialise(slim.groupBy("survey_area_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > AREA_EDGES).select("survey_area_id"), "large")

    def link(own: pd.DataFrame) -> pd.DataFrame:
        names, number = np.unique(own[["from_node_id", "to_node_id"]].to_numpy(object).T.ravel(), return_inverse=True)
        return pd.DataFrame({"node": names, "component": names[_linked(number[: len(own)], number[len(own) :], len(names))]})

    found = slim.join(large, "survey_area_id", "left_anti").groupBy("survey_area_id").applyInPandas(link, "node string, component string")
    if not large.isEmpty():
        found = found.unionByName(components(slim.join(large, "survey_area_id", "left_semi"), "from_node_id", "to_node_id"))
    return materialise(found, "network-components")


def stop_highways(items: DataFrame, nodes: DataFrame, stops: DataFrame, found: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of highway components, by shared nodes, that hold a ferry stop and a land node already known.

    ``found`` is the ``highway_network`` of the items, if there is one already.
    """
    found_nodes, found_edges = found or highway_network(items)
    found_edges = materialise(found_edges, "network-edges")
    named = area_components(found_edges)
    raw = F.regexp_extract("node", r":node:([0-9-]+)$", 1)
    marked = named.withColumn("_raw", raw)
    with_stop = marked.join(stops.select(F.col("stop_node_id").cast("string").alias("_raw")).distinct(), "_raw", "left_semi").select("component").distinct()
    with_land = marked.join(_land(nodes).select(F.col("raw").alias("_raw")).distinct(), "_raw", "left_semi").select("component").distinct()
    keep = named.join(with_stop, "component", "left_semi").join(with_land, "component", "left_semi").select("node")
    new_nodes = found_nodes.join(keep, found_nodes.network_node_id == keep.node, "left_semi")
    return new_nodes, found_edges.join(keep, found_edges.from_node_id == keep.node, "left_semi")


def merge_networks(nodes: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One network of several tables: the first of equal node ids, the shortest of equal edges."""

    def together(frames: list[DataFrame]) -> DataFrame:
        out = frames[0].withColumn("_from", F.lit(0))
        for i, f in enumerate(frames[1:], 1):
            out = out.unionByName(f.withColumn("_from", F.lit(i)), allowMissingColumns=True)
        return out

    n, e = together(nodes), together(edges)
    rest = [c for c in n.columns if c not in ("network_node_id", "_from")]
    one = n.groupBy("network_node_id").agg(F.min_by(F.struct(*rest), F.struct("_from", *rest)).alias("b")).select("network_node_id", "b.*")
    rest = [c for c in e.columns if c not in ("from_node_id", "to_node_id", "distance_m", "_from")]
    short = e.groupBy("from_node_id", "to_node_id").agg(F.min_by(F.struct("distance_m", *rest), F.struct("distance_m", "_from", *rest)).alias("b")).select("from_node_id", "to_node_id", "b.*")
    return one, short
