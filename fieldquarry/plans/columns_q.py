"""Queries of sources, column expressions, scores and small decisions."""

from pyspark.sql import functions as F

from ..functions import geo, scoring
from ..sources import tables
from .views import Book, hav, rounded

BOOK = Book()
query = BOOK.query


@query(f"SELECT row_id, round({hav('latitude', 'longitude', '33e0', '133e0')}, 3) AS d FROM candidates")
def p1_great_circle(v):
    return rounded(v("candidates").select("row_id", geo.haversine_m("latitude", "longitude", F.lit(33.0), F.lit(133.0)).alias("d")), 3)


@query("SELECT row_id, survey_area_id FROM candidates WHERE latitude BETWEEN 31 AND 34 AND longitude BETWEEN 131 AND 133.5")
def p2_extent(v):
    return geo.in_extent(v("candidates"), (131, 31, 133.5, 34)).select("row_id", "survey_area_id")


@query("SELECT row_id, round(sin(radians(aspect)), 6)+0e0 AS aspect_sin, round(cos(radians(aspect)), 6)+0e0 AS aspect_cos FROM candidates")
def p3_aspect(v):
    return rounded(geo.aspect_parts(v("candidates"), "aspect").select("row_id", "aspect_sin", "aspect_cos"))


@query("SELECT row_id FROM candidates WHERE analogue_score IS NOT NULL AND sdm_suitability IS NOT NULL AND isfinite(analogue_score) AND isfinite(sdm_suitability)")
def p4_complete_features(v):
    return geo.complete_features(v("candidates"), ["analogue_score", "sdm_suitability"]).select("row_id")


@query("SELECT concat_ws(':', CAST(CAST(floor(latitude/0.5e0) AS BIGINT) AS VARCHAR), CAST(CAST(floor(longitude/0.5e0) AS BIGINT) AS VARCHAR)) AS block, count(*) AS n FROM candidates GROUP BY 1")
def p5_spatial_blocks(v):
    return v("candidates").groupBy(geo.block_key("latitude", "longitude", 0.5).alias("block")).agg(F.count("*").alias("n"))


@query("SELECT taxon, latitude, longitude, min(row_id) AS row_id FROM occurrences GROUP BY 1, 2, 3 QUALIFY count(*) OVER (PARTITION BY taxon) >= 5")
def s3_clean_occurrences(v):
    return tables.clean_occurrences(v("occurrences"), ["taxon"]).select("taxon", "latitude", "longitude", "row_id")


@query("""SELECT d.row_id, c.height FROM detections d LEFT JOIN cells c ON c.area = d.survey_area_id % 4
  AND c.c = CAST(floor((d.longitude - 130e0 - d.survey_area_id*0.25e0)/0.01e0) AS INT) AND c.r = CAST(floor((30.2e0 + d.survey_area_id*0.25e0 - d.latitude)/0.01e0) AS INT)""")
def s17_sample_surfaces(v):
    points = v("detections").withColumns({"area": (F.col("survey_area_id") % 4).cast("int"), "x": F.col("longitude") - F.lit(130.0) - F.col("survey_area_id") * 0.25, "y": F.col("latitude")})
    points = points.withColumn("y", -(F.lit(30.2) + F.col("survey_area_id") * 0.25 - F.col("latitude")))
    return tables.sample_surfaces(points, v("cells"), ["height"], 0.0, 0.0, 0.01, "area", "x", "y").select("row_id", "height")


@query("SELECT area, r, c FROM cells WHERE r % 3 = 0 AND c % 3 = 0")
def s18_candidate_grid(v):
    cells = v("cells").withColumns({"latitude": F.col("r") * 1.0, "longitude": F.col("area") * 100.0 + F.col("c")})
    return tables.candidate_grid(cells, 3).select("area", "r", "c")


_SCORES = """WITH b AS (SELECT row_id, candidate_type, analogue_score AS l, sdm_suitability AS m, (CASE WHEN analogue_score IS NULL THEN 0e0 ELSE 0.25e0 END + CASE WHEN sdm_suitability IS NULL THEN 0e0 ELSE 0.15e0 END) AS w FROM candidates),
s AS (SELECT *, CASE WHEN w > 0 THEN (coalesce(l,0e0)*0.25e0+coalesce(m,0e0)*0.15e0)/w ELSE 0e0 END AS base,
  CASE WHEN l IS NOT NULL AND m IS NOT NULL THEN (l+m)/2*(1-abs(l-m)) ELSE 0e0 END AS agree, CASE WHEN l IS NOT NULL AND m IS NOT NULL THEN abs(l-m) ELSE 0e0 END AS apart FROM b)
SELECT row_id, round_even(base, 4) AS base, round_even(agree, 4) AS agreement, round_even(least(1e0, base + 0.1e0*agree + 0.05e0*apart*CASE WHEN regexp_matches(candidate_type, '(?i)model-only|environmental-test') THEN 1 ELSE 0 END), 4) AS score,
  CASE WHEN m IS NOT NULL AND agree >= 0.55 AND m >= 0.5 THEN 'Cross-scale consensus' WHEN m IS NOT NULL AND coalesce(l,0) >= 0.5 AND m < 0.5 THEN 'Local-habitat support; weak macro support'
    WHEN m IS NOT NULL AND m >= 0.5 AND coalesce(l,0) < 0.5 THEN 'Macro-model exploration' WHEN coalesce(l,0) >= 0.5 THEN 'Local-habitat potential' ELSE 'Limited evidence' END AS class FROM s"""


def _scores(v, exclude):
    out = scoring.integrated_scores(v("candidates").drop("priority_score"), [], exclude_occurrence_derived=exclude)
    return out


@query(_SCORES)
def p7_integrated_scores(v):
    return _scores(v, False).select("row_id", F.col("integrated_base_score").alias("base"), F.col("evidence_agreement_score").alias("agreement"), F.col("integrated_support_score").alias("score"), F.col("integrated_evidence_class").alias("class"))


@query("SELECT row_id, analogue_score IS NOT NULL AS local_available, sdm_suitability IS NOT NULL AS model_available FROM candidates")
def p8_scores_without_occurrences(v):
    return _scores(v, True).select("row_id", F.col("component_local_habitat_available").alias("local_available"), F.col("component_macro_model_available").alias("model_available"))


@query("""WITH e AS (SELECT survey_area_id, min(slope) AS lo, max(slope) AS hi FROM candidates GROUP BY 1)
SELECT row_id, round(CASE WHEN lo >= 0 AND hi <= 1 THEN slope WHEN hi-lo <= 1e-12 THEN 0.5e0 ELSE (slope-lo)/(hi-lo) END, 6) AS unit FROM candidates JOIN e USING (survey_area_id)""")
def p6_unit_values(v):
    return rounded(scoring.with_units(v("candidates"), {"unit": ["slope"]}, ["survey_area_id"]).select("row_id", "unit"))


@query("""SELECT CASE WHEN contains(lower(candidate_type), 'model-only') THEN 'Model-led exploration zone' WHEN contains(lower(candidate_type), 'environmental-test') THEN 'Range-boundary comparison zone'
  WHEN contains(lower(candidate_type), 'survey-gap') THEN 'Under-sampled verification zone' WHEN contains(lower(candidate_type), 'habitat') THEN 'Similar-habitat zone'
  WHEN contains(lower(candidate_type), 'occurrence') THEN 'Known-location zone' ELSE 'Survey evidence zone' END AS role, count(*) AS n FROM candidates GROUP BY 1""")
def p9_roles(v):
    return v("candidates").groupBy(scoring.candidate_role(F.col("candidate_type")).alias("role")).agg(F.count("*").alias("n"))


@query("SELECT row_id FROM candidates WHERE NOT regexp_matches(candidate_type, '(?i)occurrence|known')")
def p10_without_known(v):
    return scoring.without_known_locations(v("candidates")).select("row_id")


@query("""SELECT row_id, NOT (is_land = 'water' OR slope > 45 OR coalesce(distance_to_road_m > 500, false)) AS eligible,
  concat_ws(';', CASE WHEN is_land = 'water' THEN 'water' END, CASE WHEN slope > 45 THEN 'dangerous_slope' END, CASE WHEN distance_to_road_m > 500 THEN 'beyond_access_distance' END) AS exclusion_reason,
  concat_ws(';', CASE WHEN is_land = 'unknown' THEN 'land' END, 'legal_access', CASE WHEN distance_to_road_m IS NULL THEN 'physical_access' END) AS unknown_constraints FROM candidates""")
def p11_hard_constraints(v):
    return scoring.hard_constraints(v("candidates")).select("row_id", "eligible", "exclusion_reason", "unknown_constraints")


@query("SELECT row_id, CASE WHEN analogue_score >= 0.67 THEN 'high' WHEN analogue_score >= 0.34 THEN 'medium' ELSE 'low' END AS level, CAST((CASE WHEN analogue_score IS NULL THEN 0 ELSE 1 END) AS INT) AS evidence_count FROM candidates")
def p12_p13_discovery(v):
    out = scoring.discovery_learning(v("candidates"), [])
    return out.select("row_id", scoring.level(F.col("analogue_score")).alias("level"), F.col("evidence_count").cast("int").alias("evidence_count"))


@query("""SELECT survey_area_id AS site_id, arg_min(is_land IN ('yes', 'TRUE'), row_id) AS success FROM candidates WHERE is_land IN ('yes', 'TRUE') OR slope < 30 AND is_land = 'absent' GROUP BY 1""")
def p14_field_results(v):
    return scoring.field_results(v("candidates").withColumn("site_id", F.col("survey_area_id")), "is_land")


@query("""WITH c AS (SELECT survey_area_id, is_land AS "window", count(*) AS n FROM candidates WHERE is_land <> 'unknown' GROUP BY 1, 2)
SELECT DISTINCT a.survey_area_id, coalesce(b."window", 'Unknown; verify phenology locally') AS "window" FROM candidates a LEFT JOIN (SELECT survey_area_id, "window" FROM c QUALIFY row_number() OVER (PARTITION BY survey_area_id ORDER BY n DESC, "window") = 1) b USING (survey_area_id)""")
def p15_modal_window(v):
    return scoring.modal_window(v("candidates"), "is_land", ["survey_area_id"])


@query("""WITH t AS (SELECT row_id, CASE row_id%4 WHEN 0 THEN 'Plantae' ELSE 'Animalia' END AS k, CASE row_id%5 WHEN 0 THEN 'Aves' WHEN 1 THEN 'Actinopterygii' ELSE 'Insecta' END AS c, CASE WHEN row_id%6=0 THEN NULL ELSE (row_id%11)/10e0 END AS f FROM candidates),
d AS (SELECT *, CASE WHEN k = 'Plantae' THEN 'terrestrial' WHEN f <= 0.2e0 THEN 'marine' WHEN f <= 0.65e0 THEN 'coastal' WHEN c = 'Actinopterygii' THEN 'inland_aquatic' ELSE 'terrestrial' END AS domain FROM t)
SELECT row_id, domain, CASE WHEN domain <> 'terrestrial' OR c = 'Aves' THEN 10e0 ELSE 5e0 END AS radius_km FROM d""")
def p16_p17_domains(v):
    t = v("candidates").select("row_id", F.when(F.col("row_id") % 4 == 0, "Plantae").otherwise("Animalia").alias("k"), F.when(F.col("row_id") % 5 == 0, "Aves").when(F.col("row_id") % 5 == 1, "Actinopterygii").otherwise("Insecta").alias("c"), F.when(F.col("row_id") % 6 != 0, (F.col("row_id") % 11) / F.lit(10.0)).alias("f"))
    t = t.withColumn("domain", scoring.surface_domain(F.col("k"), F.col("c"), F.col("f")))
    return t.select("row_id", "domain", scoring.recovery_radius_km(F.col("c"), F.col("domain")).alias("radius_km"))


@query("""SELECT row_id, greatest(slope*100/sqrt(2e0), coalesce(distance_to_road_m, 0e0), aspect) <= 2500 AS technical_eligibility FROM candidates""")
def p18_precision(v):
    t = v("candidates").withColumns({"cell": F.col("slope") * 100, "target": F.lit(5.0)})
    return scoring.precision_audit(t, "cell", "distance_to_road_m", "aspect", "target").select("row_id", "technical_eligibility")


@query("""SELECT row_id, CASE row_id%3 WHEN 0 THEN 'plant' WHEN 1 THEN 'bird' ELSE 'other' END AS protocol FROM candidates""")
def p19_protocols(v):
    c = v("candidates").select("row_id", F.when(F.col("row_id") % 3 == 0, "Plantae").otherwise("Animalia").alias("kingdom"), F.when(F.col("row_id") % 3 == 1, "Aves").otherwise("x").alias("class"))
    rules = c.sparkSession.createDataFrame([(1, "plantae", None, "plant"), (2, None, "aves", "bird"), (9, None, None, "other")], "priority int, kingdom string, class string, protocol string")
    return scoring.survey_protocol(c, rules).select("row_id", "protocol")


@query("""WITH n AS (SELECT row_id, slope, greatest(100e0, slope*100, coalesce(nullif(distance_to_road_m, 0), 0), coalesce(nullif(aspect, 0), 0)) AS need FROM candidates)
SELECT row_id, CAST(CASE WHEN need <= 100 THEN 100 WHEN need <= 250 THEN 250 WHEN need <= 500 THEN 500 WHEN need <= 1000 THEN 1000 WHEN need <= 2000 THEN 2000 WHEN need <= 5000 THEN 5000 ELSE ceil(need/100)*100 END AS INT) AS cell,
  CASE WHEN slope < 15 THEN 'jackknife' WHEN slope < 30 THEN 'random holdout' WHEN slope < 50 THEN 'random k-fold' ELSE 'block' END AS method FROM n""")
def p20_p21_choices(v):
    return v("candidates").select("row_id", scoring.cell_size(F.col("slope") * 100, F.col("distance_to_road_m"), F.col("aspect")).cast("int").alias("cell"), scoring.partition_method(F.col("slope"), F.lit(None).cast("double")).alias("method"))


@query("SELECT row_id, coalesce(analogue_score*0.75e0 + slope/61e0*0.25e0, -1e0) AS blend, greatest(coalesce(analogue_score, 0e0), slope/61e0) AS worse FROM candidates")
def p27_rank_blends(v):
    a, b = F.col("analogue_score"), F.col("slope") / 61.0
    return v("candidates").select("row_id", F.coalesce(scoring.rank_blend(a, b, 0.25), F.lit(-1.0)).alias("blend"), scoring.rank_and(F.coalesce(a, F.lit(0.0)), b).alias("worse"))


def _month(i: int, scale: str) -> str:
    return f"CASE WHEN (row_id + {i})%17 = 0 THEN -999e0 ELSE CAST((row_id*{7 + 3 * i} + {11 * i})%400 AS DOUBLE)/{scale} END"


_MEANS = "list_filter([{0}], lambda x: x <> -999)"
_T = _MEANS.format(", ".join(_month(i, "10e0") for i in range(12)))
_R = _MEANS.format(", ".join(f"CASE WHEN row_id%29 = 0 THEN 0e0 WHEN (row_id + {i})%17 = 0 THEN -999e0 ELSE {d}*({_month(i, '50e0')}) END" for i, d in enumerate(scoring.MONTH_DAYS)))


@query(f"""WITH m AS (SELECT latitude, longitude, {_T} AS t, {_R} AS r FROM candidates WHERE row_id%13 <> 0)
SELECT round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, round(list_avg(t), 6) AS bio1, round(list_stddev_pop(t)*100, 4) AS bio4, round(list_sum(r), 4) AS bio12, round(list_min(r), 6) AS bio14, round(list_stddev_pop(r)*100/list_avg(r), 4) AS bio15 FROM m WHERE len(t) > 0 AND len(r) > 0 AND list_avg(r) > 0""")
def p22_bioclim(v):
    c = v("candidates")
    gone = lambda i: (F.col("row_id") + i) % 17 == 0
    month = lambda i, scale: F.when(gone(i), -999.0).otherwise((F.col("row_id") * (7 + 3 * i) + 11 * i) % 400 / F.lit(scale))
    heat = c.select("latitude", "longitude", *[month(i, 10.0).alias(m) for i, m in enumerate(scoring.MONTHS)])
    # the other climatology lacks some cells, and some are dry
    rain = c.filter("row_id % 13 <> 0").select("latitude", "longitude", *[F.when(F.col("row_id") % 29 == 0, 0.0).otherwise(month(i, 50.0)).alias(m) for i, m in enumerate(scoring.MONTHS)])
    return rounded(scoring.bioclim(heat, rain), 4, latitude=6, longitude=6, bio1=6, bio14=6)


_BOXES = [("north", 130.0, 33.0, 134.0, 37.0), ("south", 129.0, 29.0, 133.0, 34.0)]


@query("""WITH b AS (SELECT * FROM (VALUES ('north', 130e0, 33e0, 134e0, 37e0), ('south', 129e0, 29e0, 133e0, 34e0)) t(region, west, south, east, north)),
m AS (SELECT row_id, region, pow(longitude-(west+east)/2, 2)+pow(latitude-(south+north)/2, 2) AS d FROM candidates JOIN b ON longitude BETWEEN west AND east AND latitude BETWEEN south AND north)
SELECT c.row_id, m.region FROM candidates c LEFT JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, region) = 1) m USING (row_id)""")
def p28_regions(v):
    c = v("candidates")
    return scoring.region_of(c, c.sparkSession.createDataFrame(_BOXES, "region string, west double, south double, east double, north double")).select("row_id", "region")


@query("""WITH t AS (SELECT row_id, row_id%3 AS source, CASE WHEN row_id%4=1 THEN ' Isle '||survey_area_id||' ' ELSE '' END AS island FROM detections)
SELECT row_id, last_value(CASE WHEN island <> '' THEN lower(trim(island)) END IGNORE NULLS) OVER (PARTITION BY source ORDER BY row_id) AS island FROM t""")
def p29_field_locations(v):
    t = v("detections").withColumns({"source": F.col("row_id") % 3, "island": F.when(F.col("row_id") % 4 == 1, F.concat(F.lit(" Isle "), F.col("survey_area_id").cast("string"), F.lit(" "))).otherwise("")})
    return tables.field_locations(t, source=["source"]).select("row_id", "island")


@query("SELECT DISTINCT lower(trim(candidate_type)) AS name, regexp_replace(regexp_replace(candidate_type, '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS token FROM candidates")
def p25_names(v):
    return v("candidates").select(geo.area_name("candidate_type").alias("name"), geo.id_token("candidate_type").alias("token")).distinct()


@query("SELECT survey_area_id, site_id, round(priority_score, 6) AS score FROM candidates QUALIFY row_number() OVER (PARTITION BY survey_area_id ORDER BY priority_score DESC, site_id) <= 3")
def k1_top_per_area(v):
    return rounded(scoring.top_quota(v("candidates"), 3, 8).select("survey_area_id", "site_id", F.col("priority_score").alias("score")))
