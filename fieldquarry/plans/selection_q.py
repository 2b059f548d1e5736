"""Queries of selections: form a over areas, form b over all candidates."""

import re

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import graph, joins, selection, support
from .views import Book, hav, rounded
from .support_q import _CATCHMENT, _network, _patches

BOOK = Book()
query = BOOK.query
AREA = ["survey_area_id"]
_D = hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")
_PICK = hav("b.latitude", "b.longitude", "p.latitude", "p.longitude")


def greedy_sql(base: str, columns: list[str], k: int, first: str, later: str, order: str = "v DESC, row_id", seen: str = "", start: str = "") -> str:
    """CTEs b and p1 .. pk: k rounds over the pools g of ``base``, each taking a pool's best row by its value v.

    ``later`` is a value over what ``seen`` aggregates from the rows picked before (p); ``start`` names the same for the first round.
    """
    own = ", ".join(f"b.{c}" for c in columns)
    pick = "SELECT * FROM ({0}) QUALIFY row_number() OVER (PARTITION BY g ORDER BY {1}) = 1"
    parts = [f"b AS ({base})", "p1 AS (" + pick.format(f"SELECT {own}{start}, 1 AS decision_rank, {first} AS v FROM b", order) + ")"]
    for i in range(2, k + 1):
        picked = " UNION ALL ".join(f"SELECT * FROM p{j}" for j in range(1, i))
        inner = f"SELECT {own}{seen}, count(*) FILTER (p.row_id = b.row_id) AS own FROM b JOIN ({picked}) p ON p.g = b.g GROUP BY {own}"
        names = ", ".join([*columns, *re.findall(r" AS (\w+)(?=,|$)", seen)])
        parts.append(f"p{i} AS (" + pick.format(f"SELECT {names}, {i} AS decision_rank, {later} AS v FROM ({inner}) WHERE own = 0", order) + ")")
    return "WITH " + ", ".join(parts) + " "


def _picks(k: int, select: str) -> str:
    return " UNION ALL ".join(f"SELECT {select} FROM p{i}" for i in range(1, k + 1))


_SCORED = "SELECT {g} AS g, row_id, survey_area_id AS area, latitude, longitude, greatest(0e0, least(1e0, priority_score)) AS s, {w} AS w FROM candidates"
_NEAR = f", min({_PICK}) AS near"
_UTILITY = "w*s + (1-w)*(1-exp(-near/25000e0))"


@query("SELECT survey_area_id, site_id FROM candidates QUALIFY row_number() OVER (PARTITION BY survey_area_id ORDER BY sdm_suitability DESC NULLS LAST, site_id) <= 5")
def k3_score_top_k(v):
    return selection.score_top_k(v("candidates"), 5, AREA, "sdm_suitability").select("survey_area_id", "site_id")


@query()
def k2_recommended_zones(v):
    zones = graph.scored_zones(v("candidates"), 2000.0)
    return scoring.top_quota(zones, 3, 8, score="zone_score", ident="zone_id").select("survey_area_id", "zone_id", "zone_score")


@query(greedy_sql(_SCORED.format(g="survey_area_id", w="0.25e0"), ["g", "row_id", "latitude", "longitude", "s", "w"], 5, "w*s + (1-w)*0.5e0", _UTILITY, "v DESC, s DESC, row_id", _NEAR, ", NULL AS near")
    + _picks(5, "g AS survey_area_id, row_id, decision_rank, round(v, 6) AS utility"))
def k4_complementary(v):
    return rounded(selection.complementary(v("candidates"), 5, AREA))


@query(greedy_sql(_SCORED.format(g="survey_area_id%5", w="0.25e0"), ["g", "row_id", "area", "latitude", "longitude", "s", "w"], 8, "w*s + (1-w)*0.5e0", _UTILITY, "open DESC, v DESC, s DESC, row_id", _NEAR + ", count(*) FILTER (p.area = b.area) = 0 AS open", ", NULL AS near, true AS open")
    + _picks(8, "g AS pool, row_id, decision_rank, round(v, 6) AS utility"))
def k5_area_balanced(v):
    return rounded(selection.area_balanced(v("candidates").withColumn("pool", F.col("survey_area_id") % 5), 8, ["pool"]))


@query(greedy_sql(_SCORED.format(g="survey_area_id", w="CASE survey_area_id%2 WHEN 0 THEN 1e0 ELSE 0.75e0 END"), ["g", "row_id", "latitude", "longitude", "s", "w"], 5, "w*s + (1-w)*0.5e0", _UTILITY, "v DESC, s DESC, row_id", _NEAR, ", NULL AS near")
    + _picks(5, "g AS survey_area_id, CASE g%2 WHEN 0 THEN 'plant' ELSE 'animal' END AS taxon_group, row_id, decision_rank, round(v, 6) AS utility"))
def k6_group_policy(v):
    return rounded(selection.group_policy(v("candidates").withColumn("taxon_group", F.when(F.col("survey_area_id") % 2 == 0, "plant").otherwise("animal")), AREA))


_SCALED = """WITH f AS (SELECT survey_area_id AS g, row_id, latitude, longitude, unnest(range(1, {n} + 1)) AS j, unnest([{features}]) AS v FROM candidates), m AS (SELECT g, j, quantile_cont(v, 0.5) AS med FROM f GROUP BY 1, 2),
h AS (SELECT g, row_id, latitude, longitude, j, coalesce(v, med) AS v FROM f JOIN m USING (g, j)), q AS (SELECT g, j, quantile_cont(v, 0.25) AS lo, quantile_cont(v, 0.5) AS mid, quantile_cont(v, 0.75) AS hi FROM h GROUP BY 1, 2),
z AS (SELECT g, row_id, latitude, longitude, list(CASE WHEN hi <> lo THEN (v - mid)/(hi - lo) ELSE 0e0 END ORDER BY j) AS z FROM h JOIN q USING (g, j) GROUP BY 1, 2, 3, 4)"""


@query(greedy_sql(f"SELECT a.survey_area_id AS g, a.row_id, a.latitude, a.longitude, sum({_D})/count(*) AS mean FROM candidates a JOIN candidates b ON a.survey_area_id = b.survey_area_id GROUP BY 1, 2, 3, 4", ["g", "row_id", "latitude", "longitude", "mean"], 5, "mean", "near", seen=_NEAR, start=", NULL AS near")
    + _picks(5, "g AS survey_area_id, row_id, decision_rank, round(v, 3) AS distance_m"))
def k7_geographic_maximin(v):
    return rounded(selection.geographic_maximin(v("candidates"), 5, AREA), 3)


@query(greedy_sql(_SCALED.format(n=3, features="slope, aspect, analogue_score") + " SELECT a.g, a.row_id, a.z, avg(list_distance(a.z, b.z)) AS mean FROM z a JOIN z b ON a.g = b.g GROUP BY 1, 2, 3", ["g", "row_id", "z", "mean"], 5, "mean", "near", seen=", min(list_distance(b.z, p.z)) AS near", start=", NULL AS near")
    + _picks(5, "g AS survey_area_id, row_id, decision_rank, round(v, 6) AS distance"))
def k8_environmental_maximin(v):
    return rounded(selection.environmental_maximin(v("candidates"), 5, ["slope", "aspect", "analogue_score"], AREA))


@query(greedy_sql(_SCALED.format(n=2, features="slope, aspect") + f""", d AS (SELECT a.g, a.row_id, a.latitude, a.longitude, a.z, {_D} AS geo, list_distance(a.z, b.z) AS env FROM z a JOIN z b ON a.g = b.g), t AS (SELECT g, 0.5e0/max(geo) AS sg, 0.5e0/max(env) AS se FROM d GROUP BY 1)
    SELECT g, row_id, latitude, longitude, z, sg, se, avg(sg*geo + se*env) AS mean FROM d JOIN t USING (g) GROUP BY 1, 2, 3, 4, 5, 6, 7""", ["g", "row_id", "latitude", "longitude", "z", "sg", "se", "mean"], 5, "mean", "near", seen=f", min(b.sg*{_PICK} + b.se*list_distance(b.z, p.z)) AS near", start=", NULL AS near")
    + _picks(5, "g AS survey_area_id, row_id, decision_rank, round(v, 6) AS distance"))
def k9_dual_maximin(v):
    return rounded(selection.dual_maximin(v("candidates"), 5, ["slope", "aspect"], AREA))


@query(greedy_sql("SELECT 1 AS g, row_id, (longitude - lo)*111.32e0*cos(radians(la)) AS x, (latitude - la)*110.574e0 AS y FROM candidates, (SELECT avg(latitude) AS la, avg(longitude) AS lo FROM candidates)", ["g", "row_id", "x", "y"], 12, "-(x*x + y*y)", "near", seen=", min(sqrt(pow(b.x - p.x, 2) + pow(b.y - p.y, 2))) AS near", start=", NULL AS near")
    + _picks(12, "row_id, decision_rank, round(v, 6) AS utility"))
def k10_centroid_first(v):
    return rounded(selection.centroid_first(v("candidates").select("row_id", "latitude", "longitude"), 12).select("row_id", "decision_rank", "utility"))


def cover_sql(pairs: str, k: int) -> str:
    """CTEs n and p1 .. pk: rounds of the most uncovered b of the pairs (g, a, b), ties to the smaller a."""
    parts = [f"n AS ({pairs})", "p1 AS (SELECT g, a, count(*) AS gain, 1 AS turn FROM n GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY g ORDER BY gain DESC, a) = 1)"]
    for i in range(2, k + 1):
        picked = " UNION ALL ".join(f"SELECT g, a FROM p{j}" for j in range(1, i))
        parts.append(f"c{i} AS (SELECT DISTINCT n.g, n.b FROM n JOIN ({picked}) p ON n.g = p.g AND n.a = p.a)")
        left = f"SELECT n.g, n.a, count(*) - count(c.b) AS gain, {i} AS turn FROM n LEFT JOIN c{i} c ON n.g = c.g AND n.b = c.b WHERE (n.g, n.a) NOT IN ({picked}) GROUP BY 1, 2"
        parts.append(f"p{i} AS (SELECT * FROM ({left}) QUALIFY row_number() OVER (PARTITION BY g ORDER BY gain DESC, a) = 1)")
    return "WITH " + ", ".join(parts) + ", every AS (" + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(1, k + 1)) + ") "


@query(cover_sql(f"SELECT a.survey_area_id AS g, a.row_id AS a, b.row_id AS b FROM candidates a JOIN candidates b ON a.survey_area_id = b.survey_area_id WHERE {_D} <= 3000", 3)
    + """SELECT g AS survey_area_id, a AS row_id, gain AS marginal_covered_candidates, turn AS coverage_rank, round(sum(gain) OVER (PARTITION BY g ORDER BY turn)/m, 6) AS cumulative_coverage_fraction FROM every JOIN (SELECT survey_area_id AS g, count(*) AS m FROM candidates GROUP BY 1) USING (g)""")
def k11_max_coverage(v):
    return rounded(selection.max_coverage(v("candidates"), 3.0, 3, AREA))


@query("SELECT round(quantile_cont(row_id%5*400e0, 0.5) FILTER (row_id%5 > 0)/1000, 6) AS scale_km, 'median candidate_patch_radius_m' AS source FROM candidates UNION ALL SELECT 1.5e0, 'patch_merge_distance_m' UNION ALL SELECT 0e0, 'empty'")
def k12_coverage_scale(v):
    patches = v("candidates").select("row_id", (F.col("row_id") % 5 * 400.0).alias("candidate_patch_radius_m"))
    out = None
    for one in (patches, patches.withColumn("patch_merge_distance_m", F.lit(1500.0)), patches.filter("row_id < 0")):
        scale, source = selection.coverage_scale_km(one)
        row = v("candidates").limit(1).select(F.lit(scale).alias("scale_km"), F.lit(source).alias("source"))
        out = row if out is None else out.unionByName(row)
    return rounded(out)


# which rows have no scale: each table breaks one rule in some rows
@query("""SELECT * FROM (VALUES ('no column', true), ('null', true), ('infinite', true), ('zero', true), ('two values', true), ('within tolerance', false), ('no positive radius', true)) t(fixture, refused) WHERE EXISTS (FROM candidates)""")
def k12_refused_scales(v):
    base = v("candidates").select("row_id")
    first = F.col("row_id") % 7 == 0
    tables = {
        "no column": base,
        "null": base.withColumn("patch_merge_distance_m", F.when(~first, 500.0)),
        "infinite": base.withColumn("patch_merge_distance_m", F.when(first, float("inf")).otherwise(500.0)),
        "zero": base.withColumn("patch_merge_distance_m", F.when(first, 0.0).otherwise(500.0)),
        "two values": base.withColumns({"patch_merge_distance_m": F.when(first, 700.0).otherwise(500.0), "candidate_patch_radius_m": F.lit(300.0)}),
        "within tolerance": base.withColumn("patch_merge_distance_m", F.when(first, 500.0 + 1e-7).otherwise(500.0)),
        "no positive radius": base.withColumn("candidate_patch_radius_m", F.lit(0.0)),
    }
    out = None
    for name, table in tables.items():
        try:
            selection.coverage_scale_km(table)
            refused = False
        except ValueError:
            refused = True
        row = base.limit(1).select(F.lit(name).alias("fixture"), F.lit(refused).alias("refused"))
        out = row if out is None else out.unionByName(row)
    return out


@query()
def k12_k13_movement_cover(v):
    patches = v("candidates").withColumns({"candidate_patch_radius_m": F.col("row_id") % 5 * 400.0 + 400.0})
    scale, _ = selection.coverage_scale_km(patches)
    return rounded(selection.movement_cover(patches, 2.5, scale))


@query()
def k14_reachability_cover(v):
    nodes, edges = _network(v)
    reach = graph.patch_reachability(_patches(v), nodes, edges, 60_000.0, 4000.0)
    return rounded(selection.reachability_cover(_patches(v), reach, 4.0, ident="candidate_patch_id"))


_COVER = f"SELECT a.survey_area_id, a.detection_cluster_id AS occ_id, b.cand_id FROM detections a JOIN candidates b ON a.survey_area_id = b.survey_area_id WHERE {_D} <= 6000"


@query(cover_sql(f"SELECT DISTINCT survey_area_id AS g, cand_id AS a, occ_id AS b FROM ({_COVER})", 3) + "SELECT g AS survey_area_id, a AS cand_id, turn AS decision_rank, gain FROM every WHERE gain > 0")
def k15_heldout_oracle(v):
    held = v("detections").select("survey_area_id", F.col("detection_cluster_id").alias("occ_id"), "latitude", "longitude")
    return selection.heldout_oracle(joins.Coverage(held, v("candidates"), 6.0, AREA), 3, AREA)


@query()
def k16_portfolios(v):
    scored = scoring.discovery_learning(v("candidates"), []).withColumns({"survey_gap": F.lit(0.0), "pool": F.col("survey_area_id") % 5})
    out = None
    for plan in selection.PLANS:
        one = selection.portfolio(scored, plan, 8, ["pool"])
        out = one if out is None else out.unionByName(one)
    return rounded(out)


_PORTFOLIO = """SELECT survey_area_id%5 AS g, row_id, survey_area_id AS area, latitude, longitude, {weights}, candidate_type IN ('Occurrence-supported survey range') AS t1, candidate_type IN ('Habitat-match', 'Survey-gap') AS t2, candidate_type = 'Environmental-test' AS t3 FROM candidates"""
_TYPED = "((t1 AND had1 < {w1}) OR (t2 AND had2 < {w2}) OR (t3 AND had3 < {w3})) DESC"


def portfolio_sql(plan: str, k: int) -> str:
    """Rounds of a plan's choice: rows of areas without one first, then rows of types short of their number, then the value."""
    weights, least = selection.PLANS[plan]
    fixed = f"{weights['discovery']}e0*priority_score + {weights['learning']}e0*coalesce(analogue_score, 0e0) + {weights['survey_gap']}e0*(row_id%11)/10e0 + {weights['accessibility']}e0*(1 - slope/60e0) AS fixed"
    value = f"round(fixed + {weights['representation']}e0*(1 - exp(-near/25000e0)) - {weights['redundancy']}e0*exp(-near/1000e0), 12)"
    # the types' least numbers never exceed k here, and every pool has rows of all types beyond them
    order = "open DESC, " + _TYPED.format(w1=least["known"], w2=least["discovery"], w3=least["learning"]) + ", v DESC, row_id"
    seen = _NEAR + ", count(*) FILTER (p.area = b.area) = 0 AS open" + "".join(f", count(*) FILTER (p.t{i}) AS had{i}" for i in (1, 2, 3))
    start = ", NULL AS near, true AS open, 0 AS had1, 0 AS had2, 0 AS had3"
    columns = ["g", "row_id", "area", "latitude", "longitude", "fixed", "t1", "t2", "t3"]
    return greedy_sql(_PORTFOLIO.format(weights=fixed), columns, k, f"round(fixed + {weights['representation']}e0, 12)", value, order, seen, start) + _picks(k, f"g AS pool, row_id, decision_rank, round(v, 6) AS utility, '{plan}' AS plan")


@query(" UNION ALL ".join(f"SELECT * FROM ({portfolio_sql(p, 8)})" for p in selection.PLANS))
def k16_portfolio_choice(v):
    rows = v("candidates").select(
        "row_id", "survey_area_id", (F.col("survey_area_id") % 5).alias("pool"), "latitude", "longitude", "candidate_type", F.col("priority_score").alias("discovery_value"), F.coalesce("analogue_score", F.lit(0.0)).alias("learning_value"), (1 - F.col("slope") / 60).alias("accessibility_score"), (F.col("row_id") % 11 / 10).alias("survey_gap")
    )
    out = None
    for plan in selection.PLANS:
        one = selection.portfolio(rows, plan, 8, ["pool"])
        out = one if out is None else out.unionByName(one)
    return rounded(out)


# patches are candidates, pools are of five areas, an area is a component; a scale is 90 % of an area's pair distances
_GREEDY = f"""{_CATCHMENT.format(g="survey_area_id%5", patch="row_id", d=_D)}, scales AS (SELECT a.survey_area_id AS part, greatest(0.25e0, quantile_cont({_D}, 0.9)/1000) AS scale FROM candidates a JOIN candidates b ON a.survey_area_id = b.survey_area_id AND a.row_id < b.row_id GROUP BY 1),
near AS (SELECT a.row_id, min({_D})/1000 AS km FROM candidates a LEFT JOIN detections b ON a.survey_area_id = b.survey_area_id GROUP BY 1), gaps AS (SELECT row_id, CASE WHEN km IS NULL THEN 1e0 ELSE least(1e0, km/greatest(quantile_cont(km, 0.95) OVER (PARTITION BY survey_area_id), 1e-6)) END AS gap FROM near JOIN candidates USING (row_id)),
reach AS (SELECT g, patch AS row_id, list({{'t': target, 'w': weight}}) AS targets FROM catchment GROUP BY 1, 2)
SELECT survey_area_id%5 AS g, row_id, survey_area_id AS part, latitude, longitude, coalesce(analogue_score, 0e0) AS r1, coalesce(sdm_suitability, 0e0) AS r2, priority_score AS support, slope/60 AS cost, scale, gap, targets FROM candidates c JOIN scales ON scales.part = c.survey_area_id JOIN gaps USING (row_id) JOIN reach USING (row_id)"""
_COVER_GAIN = "(greatest(r1 - s1, 0) + greatest(r2 - s2, 0))/2"
_SPREAD = "CASE WHEN fresh THEN 1e0 ELSE least(1e0, near/1000/scale) END"
_CAUGHT = "coalesce(list_sum(list_transform(list_filter(targets, lambda x: NOT list_contains(reached, x.t)), lambda x: x.w)), 0e0)"
_GREEDY_COLUMNS = ["g", "row_id", "part", "latitude", "longitude", "r1", "r2", "support", "cost", "scale", "gap", "targets"]


def patch_sql(k: int, w_cover: float, w_support: float, w_new: float, w_cost: float, w_spread: float, w_gap: float, w_catch: float) -> str:
    value = f"round({w_cover}e0*{_COVER_GAIN} + {w_support}e0*support + CASE WHEN fresh THEN {w_new}e0 ELSE 0e0 END - {w_cost}e0*cost"
    ties = [f"round({_COVER_GAIN}, 12) DESC"]
    for w, term in ((w_spread, _SPREAD), (w_gap, "gap"), (w_catch, _CAUGHT)):
        if w:
            value += f" + {w}e0*({term})"
            ties = [f"round({term}, 12) DESC", *ties] if term == _CAUGHT else [*ties, f"round({term}, 12) DESC"]
    order = ", ".join(["v DESC", *ties, "support DESC", "cost", "row_id"])
    near = hav("b.latitude", "b.longitude", "p.latitude", "p.longitude")
    seen = f", min({near}) FILTER (p.part = b.part) AS near, max(p.r1) AS s1, max(p.r2) AS s2, count(*) FILTER (p.part = b.part) = 0 AS fresh, flatten(list(list_transform(p.targets, lambda x: x.t))) AS reached"
    start = ", NULL AS near, 0e0 AS s1, 0e0 AS s2, true AS fresh, [] AS reached"
    parts = greedy_sql(_GREEDY, _GREEDY_COLUMNS, k, "{first}", value + ", 12)", order, seen, start)
    first = (value + ", 12)").replace(_CAUGHT, "coalesce(list_sum(list_transform(targets, lambda x: x.w)), 0e0)").replace(_SPREAD, "1e0").replace("CASE WHEN fresh THEN", "CASE WHEN true THEN").replace("s1", "0e0").replace("s2", "0e0")
    return parts.replace("{first}", first) + _picks(k, "g AS pool, row_id AS candidate_patch_id, decision_rank, round(v, 6) AS utility")


def _greedy_patches(v, spatial: bool = True):
    """Candidates as patches, with their component's scale and survey gap where these weigh."""
    rows = v("candidates").withColumn("pool", F.col("survey_area_id") % 5)
    if spatial:
        near = joins.nearest_training_km(rows, v("detections").withColumnRenamed("row_id", "training_id"), AREA)
        gaps = support.survey_gap(near, "survey_area_id").select("row_id", "gap")
        scales = support.spatial_scale(rows.select("survey_area_id", "row_id", "latitude", "longitude"), AREA)
        rows = rows.join(gaps, "row_id").join(scales, AREA)
    weighed = ["gap", "spatial_scale_km"] if spatial else []
    return rows.select(F.col("row_id").alias("candidate_patch_id"), "pool", F.col("survey_area_id").alias("component"), "latitude", "longitude", F.col("priority_score").alias("support"), (F.col("slope") / 60).alias("cost"), *weighed, F.array(F.coalesce("analogue_score", F.lit(0.0)), F.coalesce("sdm_suitability", F.lit(0.0))).alias("responsibility"))


def _greedy_targets(v):
    """The patches' catchments."""
    members = v("candidates").withColumns({"pool": F.col("survey_area_id") % 5, "candidate_patch_id": F.col("row_id"), "latitude": F.when(F.col("row_id") % 23 != 0, F.col("latitude"))})
    return graph.Catchments(members, 2500.0, ["pool"])


@query(patch_sql(6, 1.0, 0.25, 0.25, 0.1, 0.0, 0.0, 0.0))
def k17_prototype_greedy(v):
    return rounded(selection.prototype_greedy(_greedy_patches(v, spatial=False), 6, ["pool"], weights=(1.0, 0.25, 0.25, 0.1, 0.0, 0.0, 0.0)))


@query(patch_sql(6, 1.0, 0.25, 0.25, 0.1, 0.3, 0.2, 0.0))
def k18_spatial_greedy(v):
    return rounded(selection.prototype_greedy(_greedy_patches(v), 6, ["pool"], weights=(1.0, 0.25, 0.25, 0.1, 0.3, 0.2, 0.0)))


@query(patch_sql(6, 1.0, 0.1, 0.1, 0.02, 0.3, 0.2, 4.0))
def k17_k18_k19_prototype_greedy(v):
    return rounded(selection.prototype_greedy(_greedy_patches(v), 6, ["pool"], weights=(1.0, 0.1, 0.1, 0.02, 0.3, 0.2, 4.0), targets=_greedy_targets(v)))


@query("""WITH w AS (SELECT survey_area_id AS area, CAST(count(*) AS DOUBLE) AS weight FROM candidates GROUP BY 1), e AS (SELECT *, weight*37/sum(weight) OVER () AS e FROM w),
f AS (SELECT *, floor(e + 1e-9) AS f, round(e - floor(e + 1e-9), 9) AS r FROM e) SELECT area, CAST(f + CASE WHEN row_number() OVER (ORDER BY r DESC, area) <= 37 - sum(f) OVER () THEN 1 ELSE 0 END AS INT) AS quota FROM f""")
def k20_largest_remainder(v):
    w = v("candidates").groupBy(F.col("survey_area_id").alias("area")).agg(F.count("*").cast("double").alias("weight"))
    return selection.largest_remainder(w, 37, []).select("area", "quota")


@query()
def k21_balanced_sample(v):
    return selection.balanced_sample(v("candidates").select("row_id", "latitude", "longitude", "priority_score"), 40, weight="priority_score", least_m=500.0).select("row_id", "draw_order")


def thinning_sql(points: str, radius_m: str) -> str:
    """CTEs o and t: the points (g, row_id, y, x) of each g in order of ids, kept if farther than the radius from all kept ones."""
    return f"""o AS (SELECT g, {{'id': row_id, 'y': y, 'x': x}} AS p, {radius_m} AS radius, row_number() OVER (PARTITION BY g ORDER BY row_id) AS k FROM ({points})),
t AS (SELECT g, 1 AS k, [p] AS kept FROM o WHERE k = 1 UNION ALL SELECT t.g, o.k, CASE WHEN list_min(list_transform(kept, lambda q: {hav('q.y', 'q.x', 'o.p.y', 'o.p.x')})) > radius THEN list_append(kept, o.p) ELSE kept END FROM t JOIN o ON o.g = t.g AND o.k = t.k + 1),
whole AS (SELECT g, kept FROM t QUALIFY row_number() OVER (PARTITION BY g ORDER BY k DESC) = 1)"""


@query("WITH RECURSIVE " + thinning_sql("SELECT survey_area_id AS g, row_id, latitude AS y, longitude AS x FROM candidates", "1000e0") + " SELECT g AS survey_area_id, unnest(kept).id AS row_id FROM whole")
def s5_thinning(v):
    return selection.distance_thinning(v("candidates"), 1000.0, AREA).select("survey_area_id", "row_id")


@query("WITH RECURSIVE " + thinning_sql("SELECT {'taxon': survey_area_id%3, 'level': level, 'm': [5e0, 10e0, 20e0, 40e0, 80e0][level + 1]*1000} AS g, row_id, latitude AS y, longitude AS x FROM detections, range(5) l(level)", "g.m")
    + """, n AS (SELECT g.taxon AS taxon, g.level AS level, len(kept) AS n, kept FROM whole), pick AS (SELECT taxon, coalesce(min(level) FILTER (n <= 32), max(level)) AS level FROM n WHERE n >= 5 GROUP BY 1), rows AS (SELECT taxon, level, unnest(kept).id AS row_id FROM n JOIN pick USING (taxon, level))
SELECT taxon, row_id, CAST(level AS INT) AS level FROM rows QUALIFY row_number() OVER (PARTITION BY taxon ORDER BY row_id) <= 32""")
def s4_prototype_ladder(v):
    return selection.prototype_ladder(v("detections").withColumn("taxon", F.col("survey_area_id") % 3), ["taxon"]).select("taxon", "row_id", "level")
