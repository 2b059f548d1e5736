"""Queries of distance joins, ranks and focal windows."""

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import joins, windows
from .views import Book, hav, rounded, rounded_metres

BOOK = Book()
query = BOOK.query
_D = hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")


@query(f"SELECT a.row_id AS a, b.row_id AS b, round({_D}, 3) AS distance_m FROM candidates a JOIN candidates b ON a.survey_area_id = b.survey_area_id WHERE {_D} <= 4000")
def j2_radius_join(v):
    return rounded_metres(joins.within_radius(v("candidates"), 4000.0, ["survey_area_id"]).select("a", "b", "distance_m"), "distance_m")


@query(f"SELECT a.detection_cluster_id AS d, b.site_id AS c, round({_D}, 3) AS distance_m FROM detections a JOIN candidates b ON a.survey_area_id = b.survey_area_id")
def j1_pair_distances(v):
    out = joins.pair_distances(v("detections"), v("candidates"), ["survey_area_id"], "detection_cluster_id", "site_id")
    return rounded_metres(out.select(F.col("detection_cluster_id").alias("d"), F.col("site_id").alias("c"), "distance_m"), "distance_m")


_NEAREST = f"SELECT a.row_id AS c, b.row_id AS d, {_D} AS m FROM candidates a LEFT JOIN detections b ON a.survey_area_id = b.survey_area_id QUALIFY row_number() OVER (PARTITION BY a.row_id ORDER BY {_D}, b.row_id) = 1"


@query(f"SELECT c, d, round(m, 3) AS distance_m FROM ({_NEAREST})")
def j3_nearest(v):
    near = joins.nearest_join(v("candidates").select(F.col("row_id").alias("c"), "survey_area_id", "latitude", "longitude"), v("detections").withColumnRenamed("row_id", "d"), ["survey_area_id"], "c", "d", radius_m=2000.0)
    return rounded(near.select("c", "d", "distance_m"), 3)


@query(f"""WITH s AS (SELECT a.row_id, b.value, {_D}/6371008.8e0 AS d, row_number() OVER (PARTITION BY a.row_id ORDER BY {_D}, b.row_id) AS k FROM candidates a, detections b)
SELECT row_id, round(sum(value/pow(greatest(d, 1e-10), 2))/sum(1/pow(greatest(d, 1e-10), 2)), 4) AS value FROM s WHERE k <= 4 GROUP BY 1""")
def j4_inverse_distance(v):
    return rounded(joins.inverse_distance(v("candidates"), v("detections").withColumnRenamed("row_id", "station_id"), ["value"]), 4)


@query(f"""SELECT a.detection_cluster_id, arg_min(b.site_id, {_D}) AS site_id, round(min({_D})/1000, 6) AS nearest_km, coalesce(min({_D}) <= 2000, false) AS recovered_2km, coalesce(min({_D}) <= 10000, false) AS recovered_10km
FROM detections a LEFT JOIN candidates b ON a.survey_area_id = b.survey_area_id GROUP BY 1""")
def j5_recovery(v):
    out = joins.nearest_candidate_recovery(v("detections"), v("candidates"), [2.0, 10.0], ["survey_area_id"])
    out = out.withColumn("nearest_km", F.when(F.col("site_id").isNotNull(), F.col("nearest_km")))
    return rounded(out.select("detection_cluster_id", "site_id", "nearest_km", "recovered_2km", "recovered_10km"))


_COVER = f"SELECT a.survey_area_id, a.detection_cluster_id AS occ_id, b.cand_id, {_D}/1000 AS dist_km FROM detections a JOIN candidates b ON a.survey_area_id = b.survey_area_id WHERE {_D} <= 10000"


@query(f"SELECT survey_area_id, occ_id, cand_id, round(dist_km, 6) AS dist_km FROM ({_COVER})")
def j6_fold_coverage(v):
    held = v("detections").select("survey_area_id", F.col("detection_cluster_id").alias("occ_id"), "latitude", "longitude")
    return rounded_metres(joins.fold_coverage(held, v("candidates"), 10.0, ["survey_area_id"], "occ_id", "cand_id"), "dist_km", 6)


@query(f"SELECT survey_area_id, occ_id, cand_id FROM ({_COVER}) WHERE dist_km <= 4")
def p23_smaller_radius(v):
    held = v("detections").select("survey_area_id", F.col("detection_cluster_id").alias("occ_id"), "latitude", "longitude")
    return scoring.covered_within(joins.fold_coverage(held, v("candidates"), 10.0, ["survey_area_id"], "occ_id", "cand_id"), 4.0).select("survey_area_id", "occ_id", "cand_id")


@query(f"""SELECT a.row_id AS stop_id, round(min(greatest(0e0, {_D} - b.row_id%5*100)), 3) AS bound_m, min(greatest(0e0, {_D} - b.row_id%5*100)) > 5000 + 1e-9 AS pruned FROM candidates a, detections b GROUP BY 1""")
def j7_footprint_bounds(v):
    patches = v("detections").select(F.col("row_id").alias("candidate_patch_id"), "latitude", "longitude", (F.col("row_id") % 5 * 100.0).alias("candidate_patch_radius_m"))
    return rounded(joins.footprint_bounds(v("candidates").withColumnRenamed("row_id", "stop_id"), patches, 5000.0).select("stop_id", "bound_m", "pruned"), 3)


@query(f"SELECT a.survey_area_id AS area_a, b.survey_area_id AS area_b, round(min({_D}), 3) AS distance_m FROM detections a JOIN detections b ON a.survey_area_id < b.survey_area_id WHERE {_D} <= 30000 GROUP BY 1, 2")
def j8_close_areas(v):
    return rounded(joins.close_area_pairs(v("detections"), 30_000.0), 3)


@query("""SELECT candidate_type AS taxon, count(*) AS n FROM candidates WHERE candidate_type <> 'Survey-gap' AND NOT starts_with(lower(candidate_type), 'model') AND NOT starts_with(lower(candidate_type), 'env') GROUP BY 1""")
def j10_exclude_taxa(v):
    c = v("candidates").withColumnRenamed("candidate_type", "taxon")
    s = c.sparkSession
    kept = joins.exclude_taxa(c, s.createDataFrame([("Survey-gap",)], "taxon string"), s.createDataFrame([("MODEL",), ("Env",)], "prefix string"))
    return kept.groupBy("taxon").agg(F.count("*").alias("n"))


@query(f"SELECT c AS row_id, round(m/1000, 6) AS nearest_training_km FROM ({_NEAREST})")
def j11_nearest_training(v):
    out = joins.nearest_training_km(v("candidates"), v("detections").withColumnRenamed("row_id", "training_id"), ["survey_area_id"])
    return rounded(out.select("row_id", "nearest_training_km"))


@query("""WITH z AS (SELECT row_id AS zone_id, row_number() OVER (PARTITION BY survey_area_id ORDER BY slope, row_id) AS b, row_number() OVER (PARTITION BY survey_area_id ORDER BY aspect, row_id) AS a, coalesce(analogue_score, 0e0) AS l, coalesce(sdm_suitability, 0e0) AS m FROM candidates)
SELECT zone_id, CAST(b - a AS BIGINT) AS rank_change, round(CASE WHEN l+m > 0 THEN 2*l*m/(l+m) ELSE 0e0 END, 6) AS agreement,
  CASE WHEN l >= 0.5 AND m >= 0.5 THEN 'Concordant — highest priority' WHEN l >= m THEN 'Local evidence first' ELSE 'Model-led exploration' END AS agreement_class FROM z""")
def j9_zone_comparison(v):
    c = v("candidates").withColumnRenamed("row_id", "zone_id")
    before = windows.sequence_rank(c, ["survey_area_id"], ["slope", "zone_id"], "zone_rank")
    after = windows.sequence_rank(c, ["survey_area_id"], ["aspect", "zone_id"], "zone_rank").withColumns({"observed_support_score": F.lit(None).cast("double"), "local_habitat_support_score": F.col("analogue_score"), "model_support_score": F.col("sdm_suitability")})
    out = scoring.zone_comparison(before, after)
    return rounded(out.select("zone_id", F.col("rank_change").cast("long").alias("rank_change"), F.col("agreement_score").alias("agreement"), "agreement_class"))


_RANK = "(rank() OVER (PARTITION BY {k} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}, {c}) - 1)/2e0)/count(*) OVER (PARTITION BY {k})"


@query(f"SELECT row_id, round({_RANK.format(k='survey_area_id', c='slope')}, 9) AS rank FROM candidates")
def w1_average_rank(v):
    return rounded(windows.percent_rank_average(v("candidates"), "slope", ["survey_area_id"]).select("row_id", "rank"), 9)


@query(f"SELECT row_id, round({_RANK.format(k='1', c='slope')}, 9) AS rank FROM candidates")
def w1_distributed_rank(v):
    return rounded(windows.percent_rank_average(v("candidates"), "slope", [], distributed=True).select("row_id", "rank"), 9)


@query(f"""WITH r AS (SELECT survey_area_id, {_RANK.format(k='survey_area_id', c='analogue_score')} AS a, {_RANK.format(k='survey_area_id', c='slope')} AS b FROM (SELECT * FROM candidates WHERE analogue_score IS NOT NULL))
SELECT survey_area_id, CASE WHEN count(*) >= 3 THEN round(corr(a, b), 6) END AS spearman, count(*) AS pairs FROM r GROUP BY 1""")
def w2_spearman(v):
    return rounded(windows.spearman(v("candidates"), "analogue_score", "slope", ["survey_area_id"]))


@query("""WITH k AS (SELECT row_id, survey_area_id, row_number() OVER (PARTITION BY survey_area_id ORDER BY slope, row_id) AS k, count(*) OVER (PARTITION BY survey_area_id) AS n FROM candidates)
SELECT row_id, CAST(greatest(0, ceil((k-1)*4e0/greatest(n-1, 1) - 1e-9) - 1) AS INT) AS stratum FROM k""")
def w3_strata(v):
    return windows.quantile_strata(v("candidates"), "slope", 4, ["survey_area_id"]).select("row_id", "stratum")


@query("SELECT survey_area_id, slope, min(row_id) AS row_id FROM candidates GROUP BY 1, 2")
def w4_keep_first(v):
    return windows.keep_first(v("candidates"), ["survey_area_id", "slope"], ["row_id"]).select("survey_area_id", "slope", "row_id")


@query("SELECT row_id, row_number() OVER (PARTITION BY survey_area_id ORDER BY priority_score DESC, row_id) AS zone_rank FROM candidates")
def w5_sequence(v):
    return windows.sequence_rank(v("candidates"), ["survey_area_id"], [F.desc("priority_score"), "row_id"], "zone_rank").select("row_id", F.col("zone_rank").cast("long").alias("zone_rank"))


@query("""SELECT row_id, last_value(sdm_suitability IGNORE NULLS) OVER (PARTITION BY survey_area_id ORDER BY row_id) AS filled FROM candidates""")
def w6_forward_fill(v):
    from ..sources.tables import forward_fill

    return forward_fill(v("candidates"), "sdm_suitability", ["survey_area_id"]).select("row_id", F.col("sdm_suitability").alias("filled"))


# every cell with the cells of its window, edges repeated by clamping
_FOCAL = """WITH e AS (SELECT area, max(r) AS mr, max(c) AS mc FROM cells GROUP BY 1),
w AS (SELECT x.row_id, y.height, y.kind FROM cells x JOIN e ON x.area = e.area, range(-{h}, {h}+1) i(i), range(-{h}, {h}+1) j(j), cells y
  WHERE y.area = x.area AND y.r = greatest(0, least(mr, x.r + i.i)) AND y.c = greatest(0, least(mc, x.c + j.j)))"""


@query(_FOCAL.format(h=2) + "SELECT row_id, round(avg(height), 6) AS mean, round(stddev_pop(height), 4) AS sd FROM w GROUP BY 1")
def w7_focal(v):
    return rounded(windows.focal(v("cells"), "height", 5).select("row_id", F.col("focal_mean").alias("mean"), F.col("focal_sd").alias("sd")), sd=4)


@query("""SELECT row_id, round(CASE WHEN lag(h) OVER x IS NOT NULL AND lead(h) OVER x IS NOT NULL THEN (lead(h) OVER x - lag(h) OVER x)/60e0 WHEN lead(h) OVER x IS NOT NULL THEN (lead(h) OVER x - h)/30e0 ELSE (h - lag(h) OVER x)/30e0 END, 6) AS dz_dx,
  round(CASE WHEN lag(h) OVER y IS NOT NULL AND lead(h) OVER y IS NOT NULL THEN (lead(h) OVER y - lag(h) OVER y)/60e0 WHEN lead(h) OVER y IS NOT NULL THEN (lead(h) OVER y - h)/30e0 ELSE (h - lag(h) OVER y)/30e0 END, 6) AS dz_dy
FROM (SELECT row_id, area, r, c, coalesce(height, 0e0) AS h FROM cells) WINDOW x AS (PARTITION BY area, r ORDER BY c), y AS (PARTITION BY area, c ORDER BY r)""")
def w8_gradient(v):
    out = windows.terrain(v("cells").withColumn("height", F.coalesce("height", F.lit(0.0))), "height", 30.0)
    return rounded(out.select("row_id", "dz_dx", "dz_dy"))


_SUNS = [(90, 20), (135, 45), (180, 60), (225, 45), (270, 20)]
_SOLAR = " + ".join(f"greatest(0e0, nx*cos(radians({h}))*sin(radians({a})) + ny*cos(radians({h}))*cos(radians({a})) + nz*sin(radians({h})))" for a, h in _SUNS)


@query(_FOCAL.format(h=1) + f""", f AS (SELECT row_id, avg(coalesce(height, 0e0)) AS mean, stddev_pop(coalesce(height, 0e0)) AS sd FROM w GROUP BY 1),
g AS (SELECT row_id, h, CASE WHEN lag(h) OVER x IS NOT NULL AND lead(h) OVER x IS NOT NULL THEN (lead(h) OVER x - lag(h) OVER x)/600e0 WHEN lead(h) OVER x IS NOT NULL THEN (lead(h) OVER x - h)/300e0 ELSE (h - lag(h) OVER x)/300e0 END AS dx,
  CASE WHEN lag(h) OVER y IS NOT NULL AND lead(h) OVER y IS NOT NULL THEN (lead(h) OVER y - lag(h) OVER y)/600e0 WHEN lead(h) OVER y IS NOT NULL THEN (lead(h) OVER y - h)/300e0 ELSE (h - lag(h) OVER y)/300e0 END AS dy
  FROM (SELECT row_id, area, r, c, coalesce(height, 0e0) AS h FROM cells) WINDOW x AS (PARTITION BY area, r ORDER BY c), y AS (PARTITION BY area, c ORDER BY r)),
s AS (SELECT *, degrees(atan(sqrt(dx*dx + dy*dy))) AS slope, degrees(atan2(-dx, dy)) AS turn FROM g), a AS (SELECT *, CASE WHEN turn < 0 THEN turn + 360 ELSE turn END AS aspect FROM s),
n AS (SELECT *, sin(radians(slope))*sin(radians(aspect)) AS nx, sin(radians(slope))*cos(radians(aspect)) AS ny, cos(radians(slope)) AS nz FROM a)
SELECT row_id, round(slope, 4) AS slope, round(aspect, 4) AS aspect, round(h - mean, 4) + 0e0 AS relative_height, round(sd, 4) AS roughness, round(({_SOLAR})/5, 4) AS solar, round(nz, 4) AS normal_z FROM n JOIN f USING (row_id)""")
def w8_p26_terrain(v):
    out = windows.terrain(v("cells").withColumn("height", F.coalesce("height", F.lit(0.0))), "height", 300.0)
    return rounded(windows.solar_proxy(out).select("row_id", "slope", "aspect", "relative_height", "roughness", "solar", "normal_z"), 4)


@query("""SELECT row_id, coalesce(lag(kind) OVER x <> kind, false) OR coalesce(lead(kind) OVER x <> kind, false) OR coalesce(lag(kind) OVER y <> kind, false) OR coalesce(lead(kind) OVER y <> kind, false) AS boundary
FROM cells WINDOW x AS (PARTITION BY area, r ORDER BY c), y AS (PARTITION BY area, c ORDER BY r)""")
def w9_boundary(v):
    return windows.class_boundary(v("cells"), "kind").select("row_id", "boundary")


@query("""WITH e AS (SELECT area, max(r) AS mr, max(c) AS mc FROM cells GROUP BY 1),
w AS (SELECT x.row_id, y.height, abs(i.i) <= 1 AND abs(j.j) <= 1 AS near FROM cells x JOIN e ON x.area = e.area, range(-3, 4) i(i), range(-3, 4) j(j), cells y
  WHERE y.area = x.area AND y.r = greatest(0, least(mr, x.r + i.i)) AND y.c = greatest(0, least(mc, x.c + j.j)))
SELECT row_id, round(avg(height) FILTER (near) - avg(height), 6) AS contrast FROM w GROUP BY 1""")
def w10_contrast(v):
    return rounded(windows.scale_contrast(v("cells"), "height", 3, 7).select("row_id", "contrast"))


@query("SELECT area, round(quantile_cont(height, 0.9) - quantile_cont(height, 0.1), 6) AS amplitude FROM cells GROUP BY 1")
def w10_amplitude(v):
    return rounded(windows.amplitude(v("cells"), "height", ["area"]))


@query(_FOCAL.format(h=1) + """, s AS (SELECT row_id, avg(CASE WHEN kind=0 THEN 1e0 ELSE 0e0 END) AS a, avg(CASE WHEN kind=1 THEN 1e0 ELSE 0e0 END) AS b, avg(CASE WHEN kind=2 THEN 1e0 ELSE 0e0 END) AS c FROM w GROUP BY 1)
SELECT row_id, round(a, 6) AS share_0, round(1-a*a-b*b-c*c, 6) AS simpson, round(-(CASE WHEN a>1e-9 THEN a*ln(a) ELSE 0 END + CASE WHEN b>1e-9 THEN b*ln(b) ELSE 0 END + CASE WHEN c>1e-9 THEN c*ln(c) ELSE 0 END)/ln(3e0), 6) + 0e0 AS entropy FROM s""")
def a14_class_mix(v):
    return rounded(windows.class_mix(v("cells"), "kind", [0, 1, 2], 3).select("row_id", "share_0", "simpson", "entropy"))
