"""Queries of environmental support, patches and graphs; the flagship is the patch product."""

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import graph, joins, support
from .views import FEATURES, Book, hav, rounded, rounded_metres

BOOK = Book()
query = BOOK.query
_D = hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")


AREA = ["survey_area_id"]


def _both(v):
    return v("universe"), v("known")


def _long(features: list[str] = FEATURES, worlds: str = "SELECT DISTINCT a, pid AS world FROM p") -> str:
    """SQL of features in long form, scaled prototypes (z), kernel scales (kern), distances (d) and ranks (r) of each area's worlds."""
    return f"""WITH u AS (SELECT survey_area_id AS a, row_id, unnest(range(1, {len(features) + 1})) AS j, unnest([{', '.join(features)}]) AS v FROM universe),
p AS (SELECT survey_area_id AS a, row_id AS pid, unnest(range(1, {len(features) + 1})) AS j, unnest([{', '.join(features)}]) AS v FROM known),
worlds AS ({worlds}),
m AS (SELECT a, world, j, quantile_cont(v, 0.5) AS med, CASE WHEN quantile_cont(v, 0.75) - quantile_cont(v, 0.25) > 1e-9 THEN quantile_cont(v, 0.75) - quantile_cont(v, 0.25) ELSE 1e0 END AS s FROM worlds JOIN p USING (a) WHERE pid <> world GROUP BY 1, 2, 3),
z AS (SELECT a, world, pid, j, v/s AS z FROM m JOIN p USING (a, j) WHERE pid <> world),
nn AS (SELECT a, world, i, min(d) AS d FROM (SELECT x.a, x.world, x.pid AS i, sqrt(sum(pow(x.z - y.z, 2))) AS d FROM z x JOIN z y ON x.a = y.a AND x.world = y.world AND x.j = y.j AND x.pid <> y.pid GROUP BY 1, 2, 3, y.pid) GROUP BY 1, 2, 3),
kern AS (SELECT a, world, greatest(0.25e0, quantile_cont(d, 0.5)) AS h FROM nn GROUP BY 1, 2),
d AS (SELECT a, world, row_id, pid, sqrt(sum(pow(v/s - z, 2))) AS d FROM m JOIN u USING (a, j) JOIN z USING (a, world, j) GROUP BY 1, 2, 3, 4),
n AS (SELECT a, world, row_id, round(min(d), 9) AS nearest, list_sort(list(d)) AS ds FROM d GROUP BY 1, 2, 3),
r AS (SELECT a, world, row_id, nearest, ds, (rank() OVER (PARTITION BY a, world ORDER BY nearest) + (count(*) OVER (PARTITION BY a, world, nearest) - 1)/2e0)/count(*) OVER (PARTITION BY a, world) AS rank FROM n) """


_WHOLE = "SELECT DISTINCT a, -1 AS world FROM p"
_ONE, _LOO = _long(worlds=_WHOLE), _long()
_CONSENSUS = "c AS (SELECT a, row_id, CAST(quantile_cont(CAST(CAST(rank AS FLOAT) AS DOUBLE), 0.5) AS FLOAT) AS consensus, stddev_pop(CAST(CAST(rank AS FLOAT) AS DOUBLE)) AS uncertainty FROM r GROUP BY 1, 2)"
_CELLS = f"{_CONSENSUS}, cells_in AS (SELECT c.a, c.row_id, latitude, longitude, CAST(consensus AS DOUBLE) AS rank FROM c JOIN universe ON c.row_id = universe.row_id WHERE CAST(consensus AS DOUBLE) <= {{threshold}})"


@query(_ONE + "SELECT row_id, round(nearest, 5) AS nearest, round(rank, 6) AS support_rank FROM r")
def e1_geometry(v):
    universe, protos = _both(v)
    return rounded(support.geometry(universe, protos, FEATURES, AREA).select("row_id", "nearest", "support_rank"), nearest=5)


@query(_ONE + "SELECT d.row_id, d.pid AS prototype_id, round(exp(-0.5e0*pow(d.d/h, 2)), 6) AS responsibility FROM d JOIN kern USING (a, world)")
def e1_responsibility(v):
    universe, protos = _both(v)
    flat = support.geometry(universe, protos, FEATURES, AREA).select("row_id", F.explode(F.arrays_zip(F.col("ids").alias("i"), F.col("responsibility").alias("r"))).alias("x"))
    return rounded(flat.select("row_id", F.col("x.i").alias("prototype_id"), F.col("x.r").alias("responsibility")))


@query(_LOO + f", {_CONSENSUS} SELECT row_id, round(CAST(consensus AS DOUBLE), 4) AS consensus, round(uncertainty, 4) AS uncertainty FROM c")
def e2_consensus(v):
    universe, protos = _both(v)
    out = support.consensus(universe, protos, FEATURES, AREA)
    return rounded(out.select("row_id", F.col("consensus").cast("double").alias("consensus"), "uncertainty"), 4)


@query(_LOO + f"SELECT a AS survey_area_id, count(*) AS leave_one_out_worlds, round(min(h), 6) AS kernel_scale_min, round(max(h), 6) AS kernel_scale_max, '{';'.join(FEATURES)}' AS features FROM kern GROUP BY 1")
def e2_audit(v):
    return rounded(support.consensus_audit(_both(v)[1], FEATURES, AREA))


@query(_LOO + f", {_CELLS.format(threshold=0.3)} SELECT row_id, a AS survey_area_id, round(rank, 6) AS ecological_support_rank, round(1 - rank, 6) AS priority_score FROM cells_in")
def e3_support_cells(v):
    universe, protos = _both(v)
    cells = support.support_cells(universe, support.consensus(universe, protos, FEATURES, AREA), 0.3, keys=AREA)
    return rounded(cells.select("row_id", "survey_area_id", "ecological_support_rank", "priority_score"))


def patch_product(universe, protos, threshold: float = 0.25, merge_m: float = 3000.0):
    """Bounded patches of each area's cells that are closest to its known points, whichever of these is left out."""
    ranks = support.consensus(universe, protos, FEATURES, AREA)
    cells = support.support_cells(universe, ranks, threshold, keys=AREA)
    return scoring.product(graph.patches(cells, merge_m), threshold)


def _list_distance(a: str, b: str) -> str:
    return hav(f"{a}.y", f"{a}.x", f"{b}.y", f"{b}.x")


# cells taken one after another: t holds an area's patches so far, each with its founder and members
_LINK = f"""o AS (SELECT a, row_id, {{{{'id': row_id, 'y': latitude, 'x': longitude, 'r': rank}}}} AS cell, row_number() OVER (PARTITION BY a ORDER BY row_id) AS k FROM cells_in),
t AS (SELECT a, 1 AS k, [[cell]] AS ps FROM o WHERE k = 1
  UNION ALL SELECT a, k, CASE WHEN f IS NULL OR list_min(f) > {{limit}} THEN list_append(ps, [cell])
      ELSE list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN i = list_position(f, list_min(f)) THEN list_append(ps[i], cell) ELSE ps[i] END) END
    FROM (SELECT t.a, o.k, o.cell, t.ps, list_transform(t.ps, lambda q: list_max(list_transform(q, lambda m: {_list_distance('m', 'o.cell')}))) AS f FROM t JOIN o ON o.a = t.a AND o.k = t.k + 1)),
whole AS (SELECT a, unnest(range(1, len(ps) + 1)) AS number, unnest(ps) AS q FROM t QUALIFY row_number() OVER (PARTITION BY a ORDER BY k DESC) = 1),
members AS (SELECT a, number, unnest(q) AS m FROM whole),
rep AS (SELECT a, number, m.y AS latitude, m.x AS longitude FROM members QUALIFY row_number() OVER (PARTITION BY a, number ORDER BY m.r, CAST(m.id AS VARCHAR)) = 1)"""


@query((_LOO + f", {_CELLS.format(threshold=0.25)}, {_LINK.format(limit='3000e0')} ").replace("WITH u", "WITH RECURSIVE u") + f"""SELECT a || '-Z' || lpad(CAST(number AS VARCHAR), 3, '0') AS candidate_patch_id, a AS survey_area_id, rep.latitude, rep.longitude, count(*) AS support_cell_count, round_even(max({hav('rep.latitude', 'rep.longitude', 'm.y', 'm.x')}), 1) AS candidate_patch_radius_m,
  3000e0 AS patch_merge_distance_m, 0.25e0 AS support_fraction, 'untouched_confirmation_passed' AS validation_status FROM members JOIN rep USING (a, number) GROUP BY a, number, 2, 3, 4""")
def g2_p24_patch_product(v):
    return patch_product(*_both(v))


@query("""SELECT 'Z' || row_id AS candidate_patch_id, survey_area_id, latitude, longitude, row_id%9 + 1 AS support_cell_count, round(slope*10, 1) AS candidate_patch_radius_m, 500e0 AS patch_merge_distance_m, 0.05e0 AS support_fraction, 'untouched_confirmation_passed' AS validation_status FROM candidates""")
def p24_product(v):
    rows = v("candidates").select(F.concat(F.lit("Z"), F.col("row_id").cast("string")).alias("zone_id"), "survey_area_id", "latitude", "longitude", (F.col("row_id") % 9 + 1).alias("zone_member_count"), F.round(F.col("slope") * 10, 1).alias("zone_radius_m"), F.lit(500.0).alias("zone_merge_threshold_m"), "slope")
    return scoring.product(rows, 0.05)


@query(_ONE + "SELECT row_id, round(rank, 6) AS support_rank FROM r")
def e4_finite_rank(v):
    universe, protos = _both(v)
    return rounded(support.finite_geometry(universe, protos, FEATURES, AREA).select("row_id", "support_rank"))


@query(_ONE + "SELECT row_id, round(ds[2], 6) AS second_nearest, round((ds[1]+ds[2])/2, 6) AS mean_two FROM r")
def e5_persistent(v):
    universe, protos = _both(v)
    return rounded(support.persistent_support(universe, protos, FEATURES, AREA).select("row_id", "second_nearest", "mean_two"))


@query()
def e6_mode_distance(v):
    universe, protos = _both(v)
    out = support.mode_distances(universe, support.mode_centres(protos, FEATURES, AREA), FEATURES, AREA)
    return rounded(out.select("row_id", "k", "kmeans_centroid_distance", "kmeans_medoid_distance"), 4)


@query(_ONE + ", t AS (SELECT a, count(*) AS t FROM r WHERE rank <= 0.3 GROUP BY 1) SELECT row_id FROM r JOIN t USING (a) QUALIFY row_number() OVER (PARTITION BY a ORDER BY round((ds[1]+ds[2]+ds[3])/3, 9), row_id) <= t")
def e7_local_scale(v):
    universe, protos = _both(v)
    return support.local_scale(universe, protos, FEATURES, AREA, 3, 0.3).select("row_id")


_VIEW = "SELECT {name} AS view, a AS survey_area_id, row_id FROM ({sql} SELECT a, row_id FROM r QUALIFY row_number() OVER (PARTITION BY a ORDER BY nearest, row_id) <= ceil(count(*) OVER (PARTITION BY a)/10e0))"


@query(" UNION ALL ".join(_VIEW.format(name=f"'{n}'", sql=_long(f, _WHOLE)) for n, f in (("first", FEATURES[:3]), ("second", FEATURES[3:]))))
def e8_multi_view(v):
    universe, protos = _both(v)
    views = {n: support.finite_geometry(universe, protos, f, AREA).select("survey_area_id", "row_id", "support_rank") for n, f in (("first", FEATURES[:3]), ("second", FEATURES[3:]))}
    target = universe.groupBy("survey_area_id").agg(F.ceil(F.count("*") / 10).alias("target_cells"))
    return support.multi_view(views, AREA, target).select("view", "survey_area_id", "row_id")


@query()
def e9_modes(v):
    return rounded(support.environmental_modes(_both(v)[1], FEATURES, AREA))


@query()
def e10_mode_balanced(v):
    universe, protos = _both(v)
    return support.mode_balanced(universe, protos, FEATURES, AREA, 0.2)


@query(_ONE + ", q AS (SELECT row_id, pid FROM d QUALIFY row_number() OVER (PARTITION BY pid ORDER BY d, row_id) <= 5) SELECT row_id, count(*) AS prototypes FROM q GROUP BY 1")
def e11_prototype_quota(v):
    universe, protos = _both(v)
    return support.prototype_quota(universe, protos, FEATURES, AREA, 5).select("row_id", "prototypes")


@query("""WITH k AS (SELECT survey_area_id, row_id, draw, row_number() OVER (PARTITION BY survey_area_id, draw ORDER BY md5(concat_ws(':', 0, draw, row_id)), row_id) AS k, count(*) OVER (PARTITION BY survey_area_id, draw) AS n FROM known, range(1, 6) d(draw)),
l AS (SELECT survey_area_id, draw, list_sort(list(row_id)) AS removed FROM k WHERE k <= greatest(1, round_even(n*0.2e0, 0)) GROUP BY 1, 2)
SELECT DISTINCT survey_area_id, 'canonical' AS world, '' AS removed FROM known UNION ALL SELECT survey_area_id, 'without ' || row_id, CAST(row_id AS VARCHAR) FROM known
UNION ALL SELECT survey_area_id, 'draw ' || min(draw), array_to_string(removed, ',') FROM l GROUP BY survey_area_id, removed""")
def e12_perturbations(v):
    return support.perturbations(_both(v)[1], AREA, 5).select("survey_area_id", "world", F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed"))


_LEVELS = "(VALUES (0.05e0), (0.1e0), (0.2e0), (0.4e0), (0.8e0)) l(level)"


# left-out prototypes are cells here too: their own distance is found again by their features
@query(_LOO + f""", own AS (SELECT m.a, m.world, round(min(d), 9) AS own FROM (SELECT m.a, m.world, z.pid, sqrt(sum(pow(p.v/m.s - z.z, 2))) AS d FROM m JOIN p ON p.a = m.a AND p.j = m.j AND p.pid = m.world JOIN z ON z.a = m.a AND z.world = m.world AND z.j = m.j GROUP BY 1, 2, 3) m GROUP BY 1, 2),
left_out AS (SELECT r.a, r.world, (count(*) FILTER (nearest < own) + (count(*) FILTER (nearest = own) + 2)/2e0)/(count(*) + 1) AS rank FROM r JOIN own ON own.a = r.a AND own.world = r.world GROUP BY 1, 2),
recovery AS (SELECT a, level, avg(CASE WHEN rank <= level + 1e-12 THEN 1e0 ELSE 0e0 END) AS recovery FROM left_out, {_LEVELS} GROUP BY 1, 2),
whole AS (SELECT a, row_id, rank AS whole FROM ({_ONE} SELECT a, row_id, rank FROM r)),
per AS (SELECT r.a, level, world, count(*) FILTER (rank <= level + 1e-12 OR whole <= level + 1e-12) AS n, count(*) FILTER (rank <= level + 1e-12 AND whole <= level + 1e-12) AS met FROM r JOIN whole ON r.a = whole.a AND r.row_id = whole.row_id, {_LEVELS} GROUP BY 1, 2, 3),
overlap AS (SELECT a, level, quantile_cont(CASE WHEN n > 0 THEN met/n ELSE 1e0 END, 0.5) AS median_jaccard FROM per GROUP BY 1, 2)
SELECT a AS survey_area_id, level, round(recovery, 6) AS recovery, round(median_jaccard, 6) AS median_jaccard, coalesce(min(level) FILTER (recovery >= {{target}}) OVER (PARTITION BY a), 1e0) AS support_quantile FROM recovery JOIN overlap USING (a, level)""".replace("{target}", "0.5"))
def e13_adaptive_threshold(v):
    universe, protos = _both(v)
    return rounded(support.adaptive_levels(universe, protos, FEATURES, AREA, [0.05, 0.1, 0.2, 0.4, 0.8], 0.5))


# areas of every fifth number have no training points, and detections of one value make an area's distances small
@query(f"""WITH n AS (SELECT a.row_id, a.survey_area_id, min({_D})/1000 AS km FROM candidates a LEFT JOIN detections b ON a.survey_area_id = b.survey_area_id AND b.survey_area_id%5 <> 0 GROUP BY 1, 2), t AS (SELECT survey_area_id, quantile_cont(km, 0.95) AS p FROM n GROUP BY 1)
SELECT row_id, round(CASE WHEN km IS NULL THEN 1e0 ELSE greatest(0e0, least(1e0, km/greatest(p, 1e-6))) END, 6) AS gap FROM n JOIN t USING (survey_area_id)""")
def e14_survey_gap(v):
    near = joins.nearest_training_km(v("candidates"), v("detections").filter("survey_area_id % 5 <> 0").withColumnRenamed("row_id", "training_id"), AREA)
    return rounded(support.survey_gap(near, "survey_area_id").select("row_id", "gap"))


@query(f"""WITH d AS (SELECT a.survey_area_id, quantile_cont({_D}, 0.9)/1000 AS km FROM detections a JOIN detections b ON a.survey_area_id = b.survey_area_id AND a.row_id < b.row_id GROUP BY 1)
SELECT survey_area_id, round(CASE WHEN n = 1 THEN 1e0 ELSE greatest(0.25e0, km) END, 6) AS spatial_scale_km FROM (SELECT survey_area_id, count(*) AS n FROM detections GROUP BY 1) LEFT JOIN d USING (survey_area_id)""")
def e14_spatial_scale(v):
    return rounded(support.spatial_scale(v("detections").select("survey_area_id", "row_id", "latitude", "longitude"), AREA))


_TIERS = "(VALUES (0.1e0), (0.25e0), (0.5e0)) s(support_tier)"


@query(_LOO + f", {_CONSENSUS} SELECT support_tier, a AS survey_area_id, count(*) AS cells FROM c, {_TIERS} WHERE CAST(consensus AS DOUBLE) <= support_tier GROUP BY 1, 2")
def e15_s19_tiers(v):
    universe, protos = _both(v)
    ranks = support.consensus(universe, protos, FEATURES, AREA)
    return support.tier_masks(ranks, [0.1, 0.25, 0.5]).groupBy("support_tier", "survey_area_id").agg(F.count("*").alias("cells"))


@query(_LOO + f""", {_CONSENSUS}, tiers AS (SELECT a, row_id, support_tier FROM c, {_TIERS} WHERE CAST(consensus AS DOUBLE) <= support_tier),
near AS (SELECT a.survey_area_id AS a, a.detection_cluster_id AS det, b.row_id, radius_km FROM later a JOIN universe b ON a.survey_area_id = b.survey_area_id, (VALUES (0.5e0), (1e0), (3e0)) k(radius_km) WHERE {_D} <= radius_km*1000),
declared AS (SELECT survey_area_id AS a, count(*) AS n FROM later GROUP BY 1), quota AS (SELECT a, support_tier, count(*) AS quota FROM tiers GROUP BY 1, 2),
seen AS (SELECT a, support_tier, radius_km, count(DISTINCT det) AS got FROM tiers JOIN near USING (a, row_id) GROUP BY 1, 2, 3),
drawn AS (SELECT survey_area_id AS a, row_id, draw, row_number() OVER (PARTITION BY survey_area_id, draw ORDER BY md5(concat_ws(':', 0, draw, row_id)), row_id) AS k FROM universe, range(1, 11) d(draw)),
chance AS (SELECT a, support_tier, radius_km, sum(got) AS got FROM (SELECT a, support_tier, radius_km, draw, count(DISTINCT det) AS got FROM drawn JOIN quota USING (a) JOIN near USING (a, row_id) WHERE k <= quota GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)
SELECT declared.a AS survey_area_id, t.support_tier, r.radius_km, declared.n AS n_detections, coalesce(seen.got, 0) AS n_recovered, round(coalesce(seen.got, 0)/n, 6) AS recall, round(coalesce(chance.got, 0)/(n*10e0), 6) AS random_recall, round(coalesce(seen.got, 0)/n - coalesce(chance.got, 0)/(n*10e0), 6) AS lift
FROM declared CROSS JOIN (VALUES (0.1e0), (0.25e0), (0.5e0)) t(support_tier) CROSS JOIN (VALUES (0.5e0), (1e0), (3e0)) r(radius_km) LEFT JOIN seen ON seen.a = declared.a AND seen.support_tier = t.support_tier AND seen.radius_km = r.radius_km LEFT JOIN chance ON chance.a = declared.a AND chance.support_tier = t.support_tier AND chance.radius_km = r.radius_km""")
def e15_tier_recovery(v):
    universe, protos = _both(v)
    ranks = support.consensus(universe, protos, FEATURES, AREA).drop("survey_area_id")
    out = support.tier_evaluation(ranks, universe, v("later"), [0.1, 0.25, 0.5], [0.5, 1.0, 3.0], "survey_area_id", 10)
    return rounded(out.select("survey_area_id", "support_tier", "radius_km", "n_detections", "n_recovered", "recall", "random_recall", "lift"))


@query()
def s19_tier_patches(v):
    universe, protos = _both(v)
    ranks = support.consensus(universe, protos, FEATURES, AREA)
    cells = universe.join(support.tier_masks(ranks, [0.1, 0.25, 0.5]).withColumn("ecological_support_rank", F.col("consensus").cast("double")), [*AREA, "row_id"])
    # a cell stands once for each tier
    cells = cells.withColumns({"cell": F.col("row_id"), "row_id": F.concat_ws("-", F.col("support_tier").cast("string"), F.format_string("%012d", "row_id"))})
    return graph.patches(cells, 3000.0, keys=["support_tier"]).groupBy("support_tier", "survey_area_id").agg(F.count("*").alias("patches"), F.sum("zone_member_count").alias("cells"))


@query("""WITH RECURSIVE b AS (SELECT from_node_id AS a, to_node_id AS b FROM edges UNION SELECT to_node_id, from_node_id FROM edges),
r AS (SELECT row_id AS v, row_id AS c FROM detections UNION SELECT r.v, b.b FROM r JOIN b ON r.c = b.a) SELECT v AS node, min(c) AS component FROM r GROUP BY 1""")
def g1_components(v):
    return graph.components(v("edges"), "from_node_id", "to_node_id", v("detections").select(F.col("row_id").alias("node")))


@query(f"""WITH RECURSIVE e AS (SELECT a.row_id AS a, b.row_id AS b FROM candidates a JOIN candidates b ON a.survey_area_id = b.survey_area_id WHERE {_D} <= 1200),
r AS (SELECT a AS v, a AS c FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.c = e.a) SELECT v AS row_id, min(c) AS component FROM r GROUP BY 1""")
def g1_distance_components(v):
    return graph.distance_components(v("candidates"), 1200.0, AREA).select("row_id", "component")


def _network(v):
    nodes = v("detections").select(F.col("row_id").alias("network_node_id"), "survey_area_id", "latitude", "longitude")
    a = nodes.select(F.col("network_node_id").alias("from_node_id"), F.col("latitude").alias("la"), F.col("longitude").alias("lo"))
    b = nodes.select(F.col("network_node_id").alias("to_node_id"), F.col("latitude").alias("lb"), F.col("longitude").alias("lob"))
    edges = v("edges").join(a, "from_node_id").join(b, "to_node_id").withColumn("distance_m", joins.haversine_m("la", "lo", "lb", "lob")).select("from_node_id", "to_node_id", "distance_m")
    return nodes, edges


_WEIGHTED = f"w AS (SELECT from_node_id AS u, to_node_id AS v, {_D} AS m FROM edges e JOIN detections a ON a.row_id = e.from_node_id JOIN detections b ON b.row_id = e.to_node_id), both_ways AS (SELECT u, v, m FROM w WHERE m <= 250000 UNION ALL SELECT v, u, m FROM w WHERE m <= 250000)"


# least costs: a pair's row is replaced whenever a cheaper path is found
_PATHS = """paths(source, node, cost) USING KEY (source, node) AS (SELECT row_id, row_id, 0e0 FROM detections
  UNION SELECT n.source, n.node, n.cost FROM (SELECT d.source, e.v AS node, min(d.cost + e.m) AS cost FROM paths d JOIN both_ways e ON d.node = e.u WHERE d.cost + e.m <= {limit} GROUP BY 1, 2) n
    LEFT JOIN recurring.paths o ON o.source = n.source AND o.node = n.node WHERE o.cost IS NULL OR n.cost < o.cost)"""


@query(f"WITH RECURSIVE {_WEIGHTED}, {_PATHS.format(limit=250000)} SELECT source, node, round(cost, 3) AS cost FROM paths")
def g3_bounded_paths(v):
    nodes, edges = _network(v)
    return rounded_metres(graph.bounded_paths(graph.clean_edges(edges), nodes.select(F.col("network_node_id").alias("source")), 250_000.0), "cost")


def _patches(v):
    return v("candidates").select(F.col("row_id").alias("candidate_patch_id"), "survey_area_id", "latitude", "longitude")


@query(f"""WITH RECURSIVE {_WEIGHTED}, {_PATHS.format(limit=120000)}, snap AS (SELECT a.row_id AS patch, b.row_id AS node, {_D} AS access FROM candidates a JOIN detections b ON a.survey_area_id = b.survey_area_id QUALIFY row_number() OVER (PARTITION BY a.row_id ORDER BY {_D}, b.row_id) = 1),
near AS (SELECT * FROM snap WHERE access <= 4000)
SELECT a.patch AS from_patch_id, b.patch AS to_patch_id, round(a.access, 3) AS from_access_m, round(p.cost, 3) AS path_m, round(b.access, 3) AS to_access_m, round(a.access + p.cost + b.access, 3) AS total_m
FROM near a JOIN paths p ON p.source = a.node JOIN near b ON b.node = p.node WHERE a.patch < b.patch AND a.access + p.cost + b.access <= 120000 + 1e-9""")
def g4_patch_reachability(v):
    nodes, edges = _network(v)
    out = graph.patch_reachability(_patches(v), nodes, edges, 120_000.0, 4000.0)
    for c in ("from_access_m", "path_m", "to_access_m", "total_m"):
        out = rounded_metres(out, c)
    return out


@query("SELECT DISTINCT least(from_node_id, to_node_id) AS from_patch_id, greatest(from_node_id, to_node_id) AS to_patch_id FROM edges")
def g5_explicit_edges(v):
    e = v("edges").select(F.col("to_node_id").alias("from_patch_id"), F.col("from_node_id").alias("to_patch_id"))
    return graph.explicit_edges(v("detections").select(F.col("row_id").alias("candidate_patch_id")), e)


@query()
def g6_zones(v):
    return graph.scored_zones(v("candidates"), 2000.0).drop("member_ids")


@query(f"""WITH RECURSIVE e AS (SELECT a.row_id AS a, b.row_id AS b FROM candidates a JOIN candidates b ON a.survey_area_id = b.survey_area_id WHERE {_D} <= 1500),
r AS (SELECT a AS v, a AS c FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.c = e.a), k AS (SELECT v AS row_id, min(c) AS cluster FROM r GROUP BY 1)
SELECT cluster AS detection_cluster_id, count(*) AS n_source_points FROM k GROUP BY 1""")
def g7_detection_clusters(v):
    return graph.detection_clusters(v("candidates"), 1500.0, "survey_area_id").select("detection_cluster_id", "n_source_points")


@query(f"""WITH RECURSIVE n AS (SELECT a.survey_area_id, a.row_id, min({_D}) AS m FROM candidates a JOIN candidates b ON a.survey_area_id = b.survey_area_id AND a.row_id <> b.row_id GROUP BY 1, 2),
q AS (SELECT survey_area_id, count(*) AS t, greatest(500e0, least(40000e0, 3*coalesce(quantile_cont(m, 0.75) FILTER (m > 0), 5000e0))) AS eps FROM n GROUP BY 1),
e AS (SELECT a.row_id AS a, b.row_id AS b FROM candidates a JOIN candidates b ON a.survey_area_id = b.survey_area_id JOIN q ON q.survey_area_id = a.survey_area_id WHERE {_D} <= eps),
r AS (SELECT row_id AS v, row_id AS c FROM candidates UNION SELECT r.v, e.b FROM r JOIN e ON r.c = e.a), k AS (SELECT v AS row_id, min(c) AS component FROM r GROUP BY 1),
s AS (SELECT survey_area_id, component, count(*) AS size FROM k JOIN candidates USING (row_id) GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY survey_area_id ORDER BY size DESC, component) AS place, max(size) OVER (PARTITION BY survey_area_id) AS largest FROM s)
SELECT k.row_id, k.component, size, round(CASE WHEN t >= 5 THEN eps END, 3) AS cluster_eps_m, CASE WHEN t < 5 OR largest < 2 OR place = 1 THEN 'main_range' WHEN size >= 2 AND size >= greatest(3, ceil(t*0.01)) THEN 'disjunct_range' ELSE 'possible_remote_noise' END AS scope_class
FROM k JOIN o USING (component) JOIN q USING (survey_area_id)""")
def g8_survey_scope(v):
    out = graph.survey_scope(v("candidates"), AREA, low_km=0.5, high_km=40.0)
    return rounded(out.select("row_id", "component", "size", "cluster_eps_m", "scope_class"), 3)


# again and again the point with the most points left around it takes them: t holds an area's points that are left
_HUBS = f"""WITH RECURSIVE l AS (SELECT survey_area_id, list({{'id': row_id, 'y': latitude, 'x': longitude}} ORDER BY row_id) AS pts FROM candidates GROUP BY 1),
t AS (SELECT survey_area_id, 0 AS k, pts[1] AS hub, pts AS took, pts FROM l
  UNION ALL SELECT survey_area_id, k + 1, h, list_filter(pts, lambda q: {_list_distance('q', 'h')} <= 5000), list_filter(pts, lambda q: {_list_distance('q', 'h')} > 5000)
    FROM (SELECT *, pts[list_position(n, list_max(n))] AS h FROM (SELECT *, list_transform(pts, lambda p: len(list_filter(pts, lambda q: {_list_distance('p', 'q')} <= 5000))) AS n FROM t WHERE len(pts) > 0)))"""


@query(_HUBS + " SELECT survey_area_id, hub.id AS hub, len(took) AS members, k AS hub_rank FROM t WHERE k BETWEEN 1 AND 4")
def g9_region_hubs(v):
    return graph.region_hubs(v("candidates"), 5000.0, 4, AREA)


@query(_HUBS + " SELECT survey_area_id, k AS region_id, unnest(took).id AS row_id FROM t WHERE k > 0")
def g9_survey_regions(v):
    return graph.survey_regions(v("candidates"), 5000.0, AREA).select("survey_area_id", "region_id", "row_id")


_REGIONS = _HUBS + f""", m AS (SELECT survey_area_id, k AS region_id, unnest(took) AS p FROM t WHERE k > 0), d AS (SELECT x.survey_area_id, x.region_id, x.p AS p, round(sum({_list_distance('x.p', 'y.p')}), 6) AS s, max({_list_distance('x.p', 'y.p')}) AS far FROM m x JOIN m y ON x.survey_area_id = y.survey_area_id AND x.region_id = y.region_id GROUP BY 1, 2, 3),
c AS (SELECT survey_area_id, region_id, p AS centre, far FROM d QUALIFY row_number() OVER (PARTITION BY survey_area_id, region_id ORDER BY s, p.id) = 1),
g AS (SELECT survey_area_id, region_id, centre.id AS medoid_id, centre.y AS y, centre.x AS x, any_value(c.far) AS radius, count(*) AS n, max(d.far) AS diameter FROM d JOIN c USING (survey_area_id, region_id) GROUP BY 1, 2, 3, 4, 5)"""


@query(_REGIONS + "SELECT survey_area_id, region_id, medoid_id, n AS record_count, round_even(n/sum(n) OVER (PARTITION BY survey_area_id), 4) AS record_share, round_even(diameter/1000, 1) AS diameter_km, round_even(radius/1000, 1) AS center_radius_km FROM g")
def g9_region_table(v):
    regions = graph.survey_regions(v("candidates"), 5000.0, AREA)
    return graph.region_table(regions, AREA).select("survey_area_id", "region_id", "medoid_id", "record_count", "record_share", "diameter_km", "center_radius_km")


def _from(n: int) -> str:
    return hav("g.y", "g.x", f"c{n}.y", f"c{n}.x")


@query(_REGIONS + f""", f AS (SELECT * FROM g QUALIFY n >= 3 OR max(n) OVER (PARTITION BY survey_area_id) < 3), c1 AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY survey_area_id ORDER BY n DESC, region_id) = 1),
g2 AS (SELECT g.*, {_from(1)} AS d1, max(g.n) OVER (PARTITION BY survey_area_id) AS many FROM f g JOIN c1 USING (survey_area_id)), r2 AS (SELECT *, max(d1) OVER (PARTITION BY survey_area_id) AS top FROM g2 WHERE region_id NOT IN (SELECT region_id FROM c1 WHERE c1.survey_area_id = g2.survey_area_id)),
c2 AS (SELECT * FROM r2 QUALIFY row_number() OVER (PARTITION BY survey_area_id ORDER BY 0.45e0*n/many + 0.55e0*d1/top DESC, region_id) = 1),
r3 AS (SELECT g.*, least(g.d1, {_from(2)}) AS d FROM r2 g JOIN c2 USING (survey_area_id) WHERE g.region_id <> c2.region_id), c3 AS (SELECT * FROM r3 QUALIFY row_number() OVER (PARTITION BY survey_area_id ORDER BY d DESC, region_id) = 1)
SELECT survey_area_id, region_id, 1 AS card_rank, 'Recommended' AS card_role FROM c1 UNION ALL SELECT survey_area_id, region_id, 2, 'Discovery' FROM c2 UNION ALL SELECT survey_area_id, region_id, 3, 'Range contrast' FROM c3""")
def g9_region_cards(v):
    regions = graph.survey_regions(v("candidates"), 5000.0, AREA)
    return graph.region_cards(graph.region_table(regions, AREA), AREA).select("survey_area_id", "region_id", "card_rank", "card_role")


@query(_HUBS + f""", s AS (SELECT survey_area_id, count(*) FILTER (len(took) >= 3) AS stable FROM t WHERE k > 0 GROUP BY 1), w AS (SELECT a.survey_area_id, max({_D})/1000 AS km, count(DISTINCT a.row_id) AS n FROM candidates a JOIN candidates b ON a.survey_area_id = b.survey_area_id GROUP BY 1)
SELECT survey_area_id, n AS eligible_records, stable AS stable_regions, round_even(km, 1) AS total_span_km, CASE WHEN km <= 80 THEN 'narrow/local' WHEN km <= 300 THEN 'regional' WHEN stable <= 3 THEN 'disjunct' ELSE 'widespread' END AS distribution_regime FROM s JOIN w USING (survey_area_id)""")
def g9_distribution_regime(v):
    regions = graph.survey_regions(v("candidates"), 5000.0, AREA)
    return graph.distribution_regime(regions, graph.region_table(regions, AREA), AREA)


_CATCHMENT = """WITH m AS (SELECT {g} AS g, survey_area_id AS part, {patch} AS patch, row_id, CASE WHEN row_id%23 <> 0 THEN latitude END AS latitude, longitude FROM candidates), every AS (SELECT DISTINCT g, part, patch AS target FROM m),
pairs AS (SELECT DISTINCT a.g, a.part, a.patch, b.patch AS target FROM m a JOIN m b ON a.part = b.part AND {d} <= 2500 UNION SELECT g, part, target, target FROM every),
raw AS (SELECT g, part, target, 1e0/degree/sqrt(size) AS raw, raw/sum(raw) OVER (PARTITION BY g) AS weight FROM (SELECT g, part, target, count(*) AS degree FROM pairs GROUP BY 1, 2, 3) JOIN (SELECT g, part, count(*) AS size FROM every GROUP BY 1, 2) USING (g, part)),
catchment AS (SELECT g, part, patch, target, weight FROM pairs JOIN raw USING (g, part, target))"""


# one candidate in 23 has no latitude; pools are of five areas, an area is a component
@query(_CATCHMENT.format(g="survey_area_id%5", patch="CAST(floor(row_id/50e0) AS BIGINT)", d=_D) + " SELECT g AS pool, part AS survey_area_id, patch, target, round(weight, 9) AS weight FROM catchment")
def g10_catchments(v):
    members = v("candidates").withColumns({"pool": F.col("survey_area_id") % 5, "candidate_patch_id": F.floor(F.col("row_id") / 50), "latitude": F.when(F.col("row_id") % 23 != 0, F.col("latitude"))})
    return rounded(graph.catchments(members, 2500.0, ["pool"]).select("pool", "survey_area_id", "patch", "target", "weight"), 9)


@query(_ONE + "SELECT a AS survey_area_id, row_id%20 AS candidate_patch_id, pid AS prototype_id, round(max(exp(-0.5e0*pow(d.d/h, 2))), 6) AS responsibility FROM d JOIN kern USING (a, world) GROUP BY 1, 2, 3")
def g11_patch_responsibility(v):
    universe, protos = _both(v)
    cells = support.geometry(universe, protos, FEATURES, AREA)
    members = universe.select("row_id", (F.col("row_id") % 20).alias("candidate_patch_id"))
    return rounded(graph.patch_responsibility(cells, members, AREA))
