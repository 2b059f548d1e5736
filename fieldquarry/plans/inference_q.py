"""Queries of aggregations, resampling and benchmarks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates, models, resampling
from ..operators.joins import Coverage, nearest_candidate_recovery
from ..operators.selection import score_top_k
from .selection_q import cover_sql
from .views import Book, hav, rounded, with_views

BOOK = Book()
query = BOOK.query
AREA = ["survey_area_id"]
_D = hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")
_COVER = f"SELECT a.survey_area_id, a.detection_cluster_id AS occ_id, b.cand_id, {_D}/1000 AS dist_km FROM detections a JOIN candidates b ON a.survey_area_id = b.survey_area_id WHERE {_D} <= 6000"
_TOP = "SELECT survey_area_id, cand_id FROM candidates QUALIFY row_number() OVER (PARTITION BY survey_area_id ORDER BY priority_score DESC, cand_id) <= 3"


def _held(v):
    return v("detections").select("survey_area_id", F.col("detection_cluster_id").alias("occ_id"), "latitude", "longitude")


def _cover(v):
    return Coverage(_held(v), v("candidates"), 6.0, AREA)


@query(f"SELECT survey_area_id, arg_min(r, t) AS row_id, round(min(t), 2) AS total_m FROM (SELECT a.survey_area_id, a.row_id AS r, round(sum({_D}), 6) AS t FROM detections a JOIN detections b ON a.survey_area_id = b.survey_area_id GROUP BY 1, 2) GROUP BY 1")
def a1_medoid(v):
    return rounded(aggregates.medoid(v("detections"), AREA), 2)


@query(f"""SELECT h.survey_area_id, count(DISTINCT h.occ_id) AS n_heldout, count(DISTINCT CASE WHEN t.cand_id IS NOT NULL THEN c.occ_id END) AS n_recovered, round(count(DISTINCT CASE WHEN t.cand_id IS NOT NULL THEN c.occ_id END)/CAST(count(DISTINCT h.occ_id) AS DOUBLE), 6) AS recall
FROM (SELECT survey_area_id, detection_cluster_id AS occ_id FROM detections) h LEFT JOIN ({_COVER}) c ON c.survey_area_id = h.survey_area_id AND c.occ_id = h.occ_id LEFT JOIN ({_TOP}) t ON t.survey_area_id = c.survey_area_id AND t.cand_id = c.cand_id GROUP BY 1""")
def a2_recovered_fraction(v):
    return rounded(aggregates.recovered_fraction(score_top_k(v("candidates"), 3, AREA, ident="cand_id"), _cover(v), _held(v), AREA))


@query(f"""WITH n AS (SELECT a.detection_cluster_id, min({_D})/1000 AS km FROM detections a LEFT JOIN candidates b ON a.survey_area_id = b.survey_area_id GROUP BY 1)
SELECT radius_km, count(*) AS n_detections, count(*) FILTER (km <= radius_km) AS n_recovered, round(avg(CASE WHEN km <= radius_km THEN 1e0 ELSE 0e0 END), 6) AS recall, round(quantile_cont(km, 0.5), 6) AS median_km, round(max(km), 6) AS max_km FROM n, (VALUES (1e0), (2e0), (10e0)) r(radius_km) GROUP BY 1""")
def a3_recovery_summary(v):
    near = nearest_candidate_recovery(v("detections"), v("candidates"), [1.0], AREA)
    return rounded(aggregates.recovery_summary(near, [1, 2, 10]))


@query("SELECT pair_id, count(*) AS folds, count(*) FILTER (usable) AS ok_folds, CASE WHEN count(*) FILTER (usable) = count(*) THEN 'ok' WHEN count(*) FILTER (usable) = 0 THEN 'failed' ELSE 'partial' END AS completion FROM folds GROUP BY 1")
def a4_fold_completion(v):
    return aggregates.fold_completion(v("folds").withColumn("status", F.when(F.col("usable"), "ok").otherwise("error")), ["pair_id"])


_DECLARED = "(SELECT DISTINCT pair_id FROM folds)"
_ITE = f"""SELECT d.pair_id, m.method, coalesce(f.n, 0) AS returned_folds, CASE WHEN m.method = 'environment' AND coalesce(f.n, 0) < 5 THEN NULL ELSE round(coalesce(f.s, 0e0)/5, 6) END AS pair_mean
FROM {_DECLARED} d CROSS JOIN (VALUES ('rule'), ('random'), ('environment')) m(method) LEFT JOIN (SELECT pair_id, method, sum(recall) AS s, count(*) AS n FROM folds WHERE usable GROUP BY 1, 2) f ON f.pair_id = d.pair_id AND f.method = m.method"""
METHODS = ["rule", "random", "environment"]


def _means(v):
    f = v("folds")
    return aggregates.intention_to_evaluate(f.select("pair_id").distinct(), f.filter("usable"), 5, METHODS, ["environment"], ["pair_id"])


@query(_ITE)
def a5_intention_to_evaluate(v):
    return rounded(_means(v).select("pair_id", "method", "returned_folds", "pair_mean"))


@query("SELECT method, round(avg(recall), 6) AS mean_recall, count(*) AS folds, quantile_cont(candidate_pool, 0.5) AS median_pool, round(avg(recall) FILTER (rankable_fold), 6) AS rankable_mean FROM folds GROUP BY 1")
def a6_cohort_summary(v):
    return rounded(aggregates.cohort_summary(v("folds"), ["method"]))


@query("""WITH z AS (SELECT row_id AS zone_id, survey_area_id, CAST(row_id%50 AS DOUBLE) AS initial_rank, row_number() OVER (PARTITION BY survey_area_id ORDER BY aspect, row_id) AS model_rank, CASE row_id%3 WHEN 0 THEN 'Concordant — highest priority' WHEN 1 THEN 'Local evidence first' ELSE 'Model-led exploration' END AS c FROM candidates)
SELECT survey_area_id, count(*) AS zone_count, count(*) FILTER (model_rank <= 8) AS top_zone_count, count(*) FILTER (model_rank <= 8 AND c LIKE 'Concordant%') AS concordant_top_zones FROM z GROUP BY 1""")
def a7_zone_agreement(v):
    from ..operators.windows import sequence_rank

    z = sequence_rank(v("candidates"), AREA, ["aspect", "row_id"], "model_rank").withColumns({"zone_id": F.col("row_id"), "initial_rank": (F.col("row_id") % 50).cast("double")})
    z = z.withColumn("agreement_class", F.when(F.col("row_id") % 3 == 0, "Concordant — highest priority").when(F.col("row_id") % 3 == 1, "Local evidence first").otherwise("Model-led exploration"))
    return aggregates.zone_agreement(z, keys=AREA).select("survey_area_id", "zone_count", "top_zone_count", "concordant_top_zones")


@query("""WITH b AS (SELECT method AS algorithm, avg(recall) AS a FROM folds GROUP BY 1) SELECT algorithm, round(a, 6) AS validation_auc, round(1e0/count(*) OVER (), 4) AS ensemble_weight,
CASE WHEN algorithm = first_value(algorithm) OVER (ORDER BY a DESC, algorithm) THEN 'best individual model; ensemble member' ELSE 'ensemble member' END AS model_role FROM b""")
def a8_model_performance(v):
    f = v("folds").select(F.col("method").alias("algorithm"), F.col("recall").alias("auc"), F.col("repeat").alias("fold"))
    return rounded(aggregates.model_performance(f))


_OVERLAP = f"""WITH a AS ({_TOP}), b AS (SELECT survey_area_id, cand_id FROM candidates QUALIFY row_number() OVER (PARTITION BY survey_area_id ORDER BY sdm_suitability DESC NULLS LAST, cand_id) <= 3),
u AS (SELECT survey_area_id, cand_id, max(x) AS x, max(y) AS y FROM (SELECT *, 1 AS x, 0 AS y FROM a UNION ALL SELECT *, 0, 1 FROM b) GROUP BY 1, 2)"""


def _overlap(v):
    c = v("candidates")
    return aggregates.decision_overlap(score_top_k(c, 3, AREA, ident="cand_id"), score_top_k(c, 3, AREA, "sdm_suitability", "cand_id"), AREA, "cand_id")


@query(_OVERLAP + "SELECT survey_area_id, CAST(sum(x*y) AS BIGINT) AS shared, count(*) AS united, round(sum(x*y)/CAST(count(*) AS DOUBLE), 6) AS jaccard, sum(x*y) = count(*) AS exact_match FROM u GROUP BY 1")
def a9_decision_overlap(v):
    return rounded(_overlap(v))


@query(_OVERLAP + """, o AS (SELECT CASE survey_area_id%2 WHEN 0 THEN 'plant' ELSE 'animal' END AS g, sum(x*y)/CAST(count(*) AS DOUBLE) AS j, sum(x*y) = count(*) AS e FROM u GROUP BY survey_area_id)
SELECT coalesce(g, 'all') AS taxon_group, round(avg(j), 6) AS mean_jaccard, round(avg(CASE WHEN e THEN 1e0 ELSE 0e0 END), 6) AS exact_share, count(*) AS folds FROM o GROUP BY ROLLUP (g)""")
def a9_overlap_rollup(v):
    return rounded(aggregates.overlap_rollup(_overlap(v).withColumn("taxon_group", F.when(F.col("survey_area_id") % 2 == 0, "plant").otherwise("animal"))))


@query("SELECT method, taxon_group, CASE WHEN GROUPING(rep) = 0 THEN rep END AS stratum, round(avg(recall), 6) AS mean, count(recall) AS pairs FROM (SELECT *, repeat AS rep FROM folds) GROUP BY GROUPING SETS ((method), (method, taxon_group), (method, rep))")
def a10_stratum_means(v):
    return rounded(aggregates.stratum_means(v("folds").withColumnRenamed("repeat", "stratum"), strata=["taxon_group", "stratum"], value="recall"))


@query("SELECT budget, radius_km, method, round(avg(r), 6) AS mean_recall, count(*) AS taxa FROM (SELECT repeat AS budget, pair_id%3 AS radius_km, method, taxon_group, avg(recall) AS r FROM folds GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3")
def a11_budget_curve(v):
    f = v("folds").withColumns({"budget": F.col("repeat"), "radius_km": F.col("pair_id") % 3})
    return rounded(aggregates.budget_curve(f, taxon="taxon_group"))


@query(f"""WITH k AS (SELECT survey_area_id, cand_id, row_number() OVER (PARTITION BY survey_area_id ORDER BY priority_score DESC, cand_id) AS k FROM candidates),
f AS (SELECT h.survey_area_id, h.occ_id, min(k.k) AS r FROM (SELECT survey_area_id, detection_cluster_id AS occ_id FROM detections) h LEFT JOIN ({_COVER}) c ON c.occ_id = h.occ_id LEFT JOIN k ON k.cand_id = c.cand_id GROUP BY 1, 2)
SELECT survey_area_id, CASE WHEN count(*) = count(r) THEN max(r) END AS prefix FROM f GROUP BY 1""")
def a12_prefix_frontier(v):
    order = score_top_k(v("candidates"), 10**9, AREA, ident="cand_id").withColumn("decision_rank", F.col("decision_rank").cast("long"))
    return aggregates.prefix_frontier(_held(v).select("survey_area_id", "occ_id"), aggregates.covering_prefix(_held(v), order, 6.0, AREA), AREA)


@query("SELECT row_id FROM candidates a WHERE NOT EXISTS (SELECT 1 FROM candidates b WHERE b.survey_area_id = a.survey_area_id AND b.slope <= a.slope AND b.aspect <= a.aspect AND (b.slope < a.slope OR b.aspect < a.aspect))")
def a13_pareto_front(v):
    return aggregates.pareto_front(v("candidates"), "slope", "aspect", AREA).select("row_id")


@query("SELECT area, height, round(sum(count(*)) OVER (PARTITION BY area ORDER BY height)/CAST(sum(count(*)) OVER (PARTITION BY area) AS DOUBLE), 6) AS percentile FROM cells WHERE height IS NOT NULL GROUP BY 1, 2")
def a15_within_area_percentile(v):
    c = v("cells")
    return rounded(aggregates.within_area_percentile(c, c.filter("height is not null").select("area", "height").distinct(), "height").select("area", "height", "percentile"))


@query("SELECT method, count(*) AS runs, round(avg(CASE WHEN usable THEN 1e0 ELSE 0e0 END), 6) AS success_rate, min(recall) AS least, round(quantile_cont(recall, 0.05), 6) AS q05, round(quantile_cont(recall, 0.5), 6) AS median, round(quantile_cont(recall, 0.95), 6) AS q95 FROM folds GROUP BY 1")
def a16_robustness(v):
    return rounded(aggregates.robustness_summary(v("folds").withColumn("success", F.col("usable")), ["method"]))


_DESIGNS = "SELECT survey_area_id, cand_id, draw FROM candidates, range(1, 13) d(draw) QUALIFY row_number() OVER (PARTITION BY survey_area_id, draw ORDER BY md5(concat_ws(':', 0, draw, cand_id)), cand_id) <= 20 - draw%3"


# designs are draws of 18 to 20 candidates, the first is the canonical one, a kind of perturbation is draw % 3
@query(f"""WITH d AS ({_DESIGNS}), one AS (SELECT survey_area_id, cand_id FROM d WHERE draw = 1), near AS (SELECT a.survey_area_id, a.detection_cluster_id AS det, b.cand_id, {_D}/1000 AS km FROM detections a JOIN candidates b ON a.survey_area_id = b.survey_area_id),
sim AS (SELECT d.survey_area_id, draw, count(*) AS n_cells, count(one.cand_id)/CAST(count(*) + (SELECT count(*) FROM one o WHERE o.survey_area_id = d.survey_area_id) - count(one.cand_id) AS DOUBLE) AS jaccard FROM d LEFT JOIN one ON one.survey_area_id = d.survey_area_id AND one.cand_id = d.cand_id GROUP BY 1, 2),
det AS (SELECT d.survey_area_id, draw, det, min(km) AS km FROM d JOIN near USING (survey_area_id, cand_id) GROUP BY 1, 2, 3), rec AS (SELECT survey_area_id, draw, count(*) AS total, count(*) FILTER (km <= 6) AS recovered, max(km) AS far FROM det GROUP BY 1, 2)
SELECT CAST(draw%3 AS INT) AS kind, count(*) AS n, round(avg(CASE WHEN recovered = total THEN 1e0 ELSE 0e0 END), 6) AS complete_recovery_rate, round(avg(recovered), 6) AS mean_recovered, min(recovered) AS min_recovered, round(avg(jaccard), 6) AS mean_jaccard, round(quantile_cont(jaccard, 0.05), 6) AS q05_jaccard,
  round(avg(far), 6) AS mean_max_nearest_km, round(quantile_cont(far, 0.95), 6) AS q95_max_nearest_km, round(avg(n_cells), 6) AS mean_cells, round(quantile_cont(n_cells, 0.05), 6) AS q05_cells, round(quantile_cont(n_cells, 0.95), 6) AS q95_cells FROM sim JOIN rec USING (survey_area_id, draw) GROUP BY 1""")
def a16_similarity(v):
    drawn = resampling.random_sets(v("candidates"), 20, 12, AREA, "cand_id")
    w = Window.partitionBy("survey_area_id", "draw").orderBy(resampling.draw_order(0, "draw", "cand_id"), "cand_id")
    drawn = drawn.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= 20 - F.col("draw") % 3).withColumn("design", F.col("draw").cast("string"))
    similar = aggregates.design_similarity(drawn, "1", AREA, "design", "cand_id")
    places = drawn.join(v("candidates").select("survey_area_id", "cand_id", "latitude", "longitude"), ["survey_area_id", "cand_id"])
    found = nearest_candidate_recovery(v("detections").join(drawn.select("survey_area_id", "design").distinct(), "survey_area_id"), places, [6.0], ["survey_area_id", "design"], candidate_id="cand_id")
    runs = found.groupBy("survey_area_id", "design").agg(F.count("*").alias("total"), F.count_if("recovered_6km").alias("recovered"), F.max("nearest_km").alias("max_nearest_km"))
    runs = runs.join(similar, ["survey_area_id", "design"]).withColumn("kind", F.col("design").cast("int") % 3)
    return rounded(aggregates.robustness_by_kind(runs, []))


@query("SELECT taxon, count(*) AS records FROM occurrences GROUP BY 1 HAVING count(*) >= 100")
def a17_facets(v):
    return aggregates.facet_counts(v("occurrences"), "taxon", 100)


@query("SELECT survey_area_id, round(avg(CASE WHEN sdm_suitability IS NOT NULL THEN 1e0 ELSE 0e0 END), 6) AS land_fraction FROM candidates GROUP BY 1")
def a18_land_fraction(v):
    return rounded(aggregates.land_fraction(v("candidates"), "sdm_suitability", AREA))


@query("SELECT method, round(avg(r), 6) AS mean, count(*) AS n FROM (SELECT method, pair_id, avg(recall) AS r FROM folds GROUP BY 1, 2) GROUP BY 1")
def a19_two_stage_means(v):
    return rounded(aggregates.two_stage_means(v("folds"), ["method", "pair_id"], ["method"], "recall"))


@query()
def a19_accuracy_summary(v):
    metrics = v("folds").select(F.col("method").alias("algorithm"), (F.col("pair_id") % 12).alias("taxon"), "repeat", "recall", (F.col("recall") * F.col("recall")).alias("brier"))
    return rounded(aggregates.accuracy_summary(metrics, ["recall", "brier"], 100), 9)


@query(f"""WITH n AS (SELECT a.survey_area_id, a.detection_cluster_id, min({_D})/1000 AS km FROM detections a LEFT JOIN candidates b ON a.survey_area_id = b.survey_area_id GROUP BY 1, 2)
SELECT survey_area_id, count(*) AS n_detections, count(*) FILTER (km <= 2) AS n_recovered FROM n GROUP BY 1""")
def a20_area_recovery(v):
    near = nearest_candidate_recovery(v("detections"), v("candidates"), [2.0], AREA)
    return aggregates.recovery_summary(near, [2], AREA).select("survey_area_id", "n_detections", "n_recovered")


_COMPLETE = f"""SELECT d.pair_id, r.repeat, m.method, coalesce(f.recall, 0e0) AS recall, CASE WHEN f.pair_id IS NULL THEN 'artifact_missing' ELSE 'ok' END AS status FROM {_DECLARED} d CROSS JOIN (SELECT CAST(range AS INT) AS repeat FROM range(1, 6)) r
CROSS JOIN (VALUES ('rule'), ('random'), ('environment')) m(method) LEFT JOIN (SELECT * FROM folds WHERE usable) f ON f.pair_id = d.pair_id AND f.repeat = r.repeat AND f.method = m.method"""


def _complete(v):
    f = v("folds")
    return aggregates.complete_folds(f.select("pair_id").distinct(), f.filter("usable").withColumn("status", F.lit("ok")), 5, METHODS, ["pair_id"])


@query(_COMPLETE)
def a21_complete_folds(v):
    return _complete(v).select("pair_id", "repeat", "method", "recall", "status")


@query(f"SELECT pair_id, method, round(avg(recall), 6) AS evaluable_mean, count(*) AS evaluable_folds FROM ({_COMPLETE}) WHERE status = 'ok' GROUP BY 1, 2")
def a21_evaluable_means(v):
    return rounded(aggregates.evaluable_means(_complete(v), ["pair_id"]))


@query("""SELECT row_id%40 AS candidate_patch_id, round(min(slope), 6) AS best_rank, round(quantile_cont(slope, 0.5), 6) AS median_rank, round(avg(aspect), 6) AS mean_uncertainty, max(aspect) AS max_uncertainty FROM candidates GROUP BY 1""")
def a22_patch_annotation(v):
    c = v("candidates")
    ranks = c.select("row_id", F.col("slope").alias("consensus"), F.col("aspect").alias("uncertainty"))
    return rounded(aggregates.patch_annotation(c.select("row_id", (F.col("row_id") % 40).alias("candidate_patch_id")), ranks, []))


_DRAW = "md5(concat_ws(':', 0, {draw}, {id}))"


@query(f"SELECT survey_area_id, draw, site_id FROM candidates, range(1, 6) d(draw) QUALIFY row_number() OVER (PARTITION BY survey_area_id, draw ORDER BY {_DRAW.format(draw='draw', id='site_id')}, site_id) <= 3")
def r1_random_sets(v):
    return resampling.random_sets(v("candidates"), 3, 5, AREA).select("survey_area_id", F.col("draw").cast("long").alias("draw"), "site_id")


@query(f"""WITH q AS (SELECT survey_area_id, survey_area_id%3 + 1 AS quota FROM candidates GROUP BY 1)
SELECT survey_area_id, draw, site_id FROM candidates JOIN q USING (survey_area_id), range(1, 6) d(draw) QUALIFY row_number() OVER (PARTITION BY survey_area_id, draw ORDER BY {_DRAW.format(draw='draw', id='site_id')}, site_id) <= quota""")
def r2_area_quota_sets(v):
    c = v("candidates").withColumn("run", F.lit(1))
    quotas = c.select("run", "survey_area_id").distinct().withColumn("quota", F.col("survey_area_id") % 3 + 1)
    return resampling.area_quota_sets(c, quotas, 5, ["run"], "survey_area_id").select("survey_area_id", F.col("draw").cast("long").alias("draw"), "site_id")


@query("""WITH o AS (SELECT taxon_group, avg(recall) AS observed FROM folds WHERE method = 'rule' GROUP BY 1), d AS (SELECT taxon_group, recall FROM folds WHERE method = 'random')
SELECT taxon_group, round(observed, 6) AS observed, round(avg(recall), 6) AS random_mean, round(quantile_cont(recall, 0.025), 6) AS random_q025, round(quantile_cont(recall, 0.975), 6) AS random_q975, round(observed-avg(recall), 6) AS lift, round((1+count(*) FILTER (recall >= observed - 1e-12))/CAST(count(*)+1 AS DOUBLE), 6) AS p_one_sided FROM o JOIN d USING (taxon_group) GROUP BY 1, observed""")
def r2_random_recovery(v):
    f = v("folds")
    observed = f.filter("method = 'rule'").groupBy("taxon_group").agg(F.avg("recall").alias("recall"))
    return rounded(resampling.random_recovery_test(observed, f.filter("method = 'random'").select("taxon_group", "recall"), ["taxon_group"]))


_BLOCKS = lambda n: f"""WITH b AS (SELECT DISTINCT CAST(floor(latitude/0.5e0) AS BIGINT) || ':' || CAST(floor(longitude/0.5e0) AS BIGINT) AS block FROM detections),
k AS (SELECT block, repeat, row_number() OVER (PARTITION BY repeat ORDER BY {_DRAW.format(draw='repeat', id='block')}, block) AS k, count(*) OVER (PARTITION BY repeat) AS n FROM b, range(1, {n}) r(repeat))"""


@query(_BLOCKS(4) + "SELECT repeat, block, k <= greatest(1, least(n-1, round_even(n*0.2e0, 0))) AS held_out FROM k")
def r3_spatial_folds(v):
    from ..functions.geo import block_key

    points = v("detections").withColumn("block", block_key("latitude", "longitude", 0.5))
    return resampling.spatial_folds(points, 3, []).select(F.col("repeat").cast("long").alias("repeat"), "block", "held_out").distinct()


@query(_BLOCKS(9) + """, h AS (SELECT repeat, block, k <= greatest(1, least(n-1, round_even(n*0.2e0, 0))) AS held FROM k), o AS (SELECT CAST(floor(latitude/0.5e0) AS BIGINT) || ':' || CAST(floor(longitude/0.5e0) AS BIGINT) AS block FROM detections),
s AS (SELECT repeat, count(*) FILTER (held) AS h, count(*) FILTER (NOT held) AS t, array_to_string(list_sort(list_distinct(list(block) FILTER (held))), '|') AS sig FROM o JOIN h USING (block) GROUP BY 1),
g AS (SELECT sig, min(repeat) AS attempt, any_value(h) AS h FROM s WHERE h >= 5 AND t >= 10 GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY attempt) AS INT) AS repeat, h AS held FROM g QUALIFY row_number() OVER (ORDER BY attempt) <= 3""")
def r4_usable_folds(v):
    from ..functions.geo import block_key

    points = v("detections").withColumn("block", block_key("latitude", "longitude", 0.5))
    return resampling.usable_folds(points, 3, 8, [], 10, 5).groupBy("repeat").agg(F.count_if("held_out").alias("held"))


@query(f"""WITH k AS (SELECT row_id, survey_area_id, row_number() OVER (PARTITION BY survey_area_id ORDER BY slope, row_id) AS k, count(*) OVER (PARTITION BY survey_area_id) AS n FROM candidates),
s AS (SELECT row_id, survey_area_id, CAST(greatest(0, ceil((k-1)*3e0/greatest(n-1, 1) - 1e-9) - 1) AS INT) AS stratum FROM k), t AS (SELECT *, row_number() OVER (PARTITION BY survey_area_id, stratum ORDER BY {_DRAW.format(draw='stratum', id='row_id')}, row_id) AS turn FROM s)
SELECT survey_area_id, row_id FROM t QUALIFY row_number() OVER (PARTITION BY survey_area_id ORDER BY turn, stratum) <= 6""")
def r5_stratified_sample(v):
    return resampling.stratified_sample(v("candidates"), 6, "slope", 3, AREA, "row_id").select("survey_area_id", "row_id")


@query(f"""SELECT row_id AS taxon, region, candidate_type, CAST(k AS INT) AS cell_rank FROM (SELECT row_id, survey_area_id%2 AS region, candidate_type, row_number() OVER (PARTITION BY survey_area_id%2, candidate_type ORDER BY md5(concat_ws(':', 0, (survey_area_id%2) || '|' || candidate_type, row_id)), row_id) AS k FROM candidates WHERE candidate_type IN ('Habitat-match', 'Survey-gap')) WHERE k <= 4""")
def r6_factorial_cohort(v):
    taxa = v("candidates").select(F.col("row_id").alias("taxon"), (F.col("survey_area_id") % 2).alias("region"), "candidate_type")
    cells = [(r, t) for r in (0, 1) for t in ("Habitat-match", "Survey-gap")]
    return resampling.factorial_cohort(taxa, cells, 4, ["region", "candidate_type"])


_LIFT = "SELECT pair_id, taxon_group, avg(recall) - 0.45e0 AS lift FROM folds GROUP BY 1, 2"


def _lifts(v):
    return v("folds").groupBy("pair_id", "taxon_group").agg((F.avg("recall") - 0.45).alias("lift"))


@query(f"""WITH l AS ({_LIFT}), k AS (SELECT *, row_number() OVER (PARTITION BY taxon_group ORDER BY pair_id) - 1 AS i, count(*) OVER (PARTITION BY taxon_group) AS n FROM l),
p AS (SELECT k.taxon_group, draw, CAST('0x' || substr({_DRAW.format(draw='draw', id='i')}, 1, 15) AS BIGINT) % n AS j FROM k, range(1, 201) d(draw)), m AS (SELECT p.taxon_group, draw, avg(k.lift) AS m FROM p JOIN k ON k.taxon_group = p.taxon_group AND k.i = p.j GROUP BY 1, 2)
SELECT taxon_group, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high, round(avg(CASE WHEN m > 0 THEN 1e0 ELSE 0e0 END), 6) AS p_positive FROM m GROUP BY 1""")
def r8_bootstrap(v):
    return rounded(resampling.bootstrap(_lifts(v), 200, ["taxon_group"]).select("taxon_group", "ci_low", "ci_high", "p_positive"))


@query(f"""WITH l AS ({_LIFT}), f AS (SELECT taxon_group, draw, avg(CASE WHEN CAST('0x' || substr({_DRAW.format(draw='draw', id='pair_id')}, 1, 15) AS BIGINT) % 2 = 0 THEN lift ELSE -lift END) AS m FROM l, range(1, 201) d(draw) GROUP BY 1, 2),
s AS (SELECT taxon_group, avg(lift) AS mean FROM l GROUP BY 1) SELECT taxon_group, round((1+count(*) FILTER (m >= mean - 1e-12))/CAST(count(*)+1 AS DOUBLE), 6) AS p_one_sided, round((1+count(*) FILTER (abs(m) >= abs(mean) - 1e-12))/CAST(count(*)+1 AS DOUBLE), 6) AS p_two_sided FROM f JOIN s USING (taxon_group) GROUP BY 1""")
def r8_sign_flip(v):
    return rounded(resampling.sign_flip(_lifts(v), 200, ["taxon_group"]).select("taxon_group", "p_one_sided", "p_two_sided"))


_SUBSETS = f"""WITH l AS (SELECT pair_id%4 AS cohort, lift, row_number() OVER (PARTITION BY pair_id%4 ORDER BY pair_id) - 1 AS i FROM ({_LIFT})), n AS (SELECT cohort, count(*) AS n, sum(lift) AS whole FROM l GROUP BY 1),
m AS (SELECT cohort, n, whole, unnest(range(0, CAST(pow(2, n) AS BIGINT))) AS m FROM n)"""


@query(_SUBSETS + ", s AS (SELECT cohort, whole, m, sum(CASE WHEN (m >> i) & 1 = 1 THEN lift ELSE -lift END) AS t FROM m JOIN l USING (cohort) GROUP BY 1, 2, 3) SELECT cohort, round(count(*) FILTER (t >= whole - 1e-12)/count(*), 6) AS p_one_sided, round(count(*) FILTER (abs(t) >= abs(whole) - 1e-12)/count(*), 6) AS p_two_sided FROM s GROUP BY 1")
def r9_exact_sign_flip(v):
    return rounded(resampling.exact_sign_flip(_lifts(v).withColumn("cohort", F.col("pair_id") % 4), ["cohort"]).select("cohort", "p_one_sided", "p_two_sided"))


@query(f"WITH l AS ({_LIFT}), w AS (SELECT taxon_group, (sum(lift) OVER (PARTITION BY taxon_group) - lift)/(count(*) OVER (PARTITION BY taxon_group) - 1) AS w FROM l) SELECT taxon_group, round(min(w), 6) AS least_mean, round(max(w), 6) AS largest_mean FROM w GROUP BY 1")
def r10_leave_one_out(v):
    return rounded(resampling.leave_one_out_range(_lifts(v), ["taxon_group"]))


# four cohorts of 12 pairs, and one of all 48, which has too many subsets
@query(_SUBSETS + """, s AS (SELECT cohort, n//2 AS k, m, sum(CASE WHEN (m >> i) & 1 = 1 THEN lift ELSE 0e0 END)/(n//2) AS t FROM m JOIN l USING (cohort) WHERE bit_count(m) = n//2 GROUP BY cohort, n, m)
SELECT cohort, CAST(any_value(n.n) AS INT) AS n, true AS computed, CAST(any_value(k) AS INT) AS subset_size, count(*) AS subsets, round(avg(CASE WHEN t > 1e-12 THEN 1e0 ELSE 0e0 END), 6) AS positive_share, round(avg(CASE WHEN t >= 0.015 - 1e-12 THEN 1e0 ELSE 0e0 END), 6) AS threshold_share,
  round(quantile_cont(t, 0.025), 6) AS q025, round(quantile_cont(t, 0.975), 6) AS q975 FROM s JOIN n USING (cohort) GROUP BY 1 UNION ALL SELECT -1, CAST(count(*) AS INT), false, NULL, NULL, NULL, NULL, NULL, NULL FROM (""" + _LIFT + ")")
def r11_half_subsets(v):
    lifts = _lifts(v)
    both = lifts.withColumn("cohort", F.col("pair_id") % 4).unionByName(lifts.withColumn("cohort", F.lit(-1).cast("long")))
    return rounded(resampling.half_subsets(both, ["cohort"]))


def _boot(rows: str, key: str, draws: int, seeds: str = "(VALUES (0)) sd(seed)") -> str:
    """CTEs l (key, pair_id, lift), boot (key, seed, ci_low, ci_high, p_positive) and flip (key, p_one_sided, p_two_sided)."""
    one = f"md5(concat_ws(':', seed, draw, {{0}}))"
    return f"""l AS ({rows}), k AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY pair_id) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM l WHERE lift IS NOT NULL),
bp AS (SELECT k.{key}, seed, draw, CAST('0x' || substr({one.format('i')}, 1, 15) AS BIGINT) % n AS j FROM k, range(1, {draws + 1}) d(draw), {seeds}),
bm AS (SELECT bp.{key}, seed, draw, avg(k.lift) AS m FROM bp JOIN k ON k.{key} = bp.{key} AND k.i = bp.j GROUP BY 1, 2, 3),
boot AS (SELECT {key}, seed, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high, avg(CASE WHEN m > 0 THEN 1e0 ELSE 0e0 END) AS p_positive FROM bm GROUP BY 1, 2),
whole AS (SELECT {key}, avg(lift) AS mean, count(lift) AS pairs FROM l GROUP BY 1),
fm AS (SELECT {key}, draw, avg(CASE WHEN CAST('0x' || substr({one.format('pair_id')}, 1, 15) AS BIGINT) % 2 = 0 THEN lift ELSE -lift END) AS m FROM k, range(1, {draws + 1}) d(draw), (VALUES (0)) z(seed) GROUP BY 1, 2),
flip AS (SELECT {key}, (1+count(*) FILTER (m >= mean - 1e-12))/CAST(count(*)+1 AS DOUBLE) AS p_one_sided, (1+count(*) FILTER (abs(m) >= abs(mean) - 1e-12))/CAST(count(*)+1 AS DOUBLE) AS p_two_sided FROM fm JOIN whole USING ({key}) GROUP BY {key}, mean)"""


_ACCURACY = "SELECT method || '|' || metric AS g, pair_id%12 AS pair_id, avg(value) AS lift FROM (SELECT method, pair_id, 'recall' AS metric, recall AS value FROM folds UNION ALL SELECT method, pair_id, 'brier', recall*recall FROM folds) GROUP BY 1, 2"
BOOK.oracle["a19_accuracy_summary"] = with_views("WITH " + _boot(_ACCURACY, "g", 100) + """, c AS (SELECT method, count(DISTINCT pair_id%12) AS successful_taxa, count(*) AS valid_folds FROM folds GROUP BY 1)
SELECT method AS algorithm, split_part(g, '|', 2) AS metric, successful_taxa, valid_folds, round(mean, 9) AS mean, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high FROM whole JOIN boot USING (g) JOIN c ON c.method = split_part(g, '|', 1)""")


_PAIRED = """SELECT d.taxon_group, d.pair_id, coalesce(sum(recall) FILTER (method = 'rule'), 0)/5 - coalesce(sum(recall) FILTER (method = 'random'), 0)/5 AS lift
FROM (SELECT DISTINCT taxon_group, pair_id FROM folds) d LEFT JOIN (SELECT * FROM folds WHERE usable) f ON f.taxon_group = d.taxon_group AND f.pair_id = d.pair_id GROUP BY 1, 2"""


@query("WITH " + _boot(_PAIRED, "taxon_group", 200) + """, d AS (SELECT DISTINCT taxon_group, pair_id FROM folds), e AS (SELECT taxon_group, count(*) AS declared_pairs, count(*)*5 AS expected_folds FROM d GROUP BY 1),
i AS (SELECT d.taxon_group, sum(recall) FILTER (method = 'rule')/5 AS own, sum(recall) FILTER (method = 'random')/5 AS chance, sum(recall) FILTER (method = 'environment')/5 AS best FROM d LEFT JOIN (SELECT * FROM folds WHERE usable) f ON f.taxon_group = d.taxon_group AND f.pair_id = d.pair_id GROUP BY 1),
c AS (SELECT taxon_group, count(*) FILTER (method = 'rule') AS evaluated_folds, count(*) FILTER (method = 'rule' AND rankable_fold) AS rankable_folds, avg(recall) FILTER (method = 'rule' AND rankable_fold) AS r1, avg(recall) FILTER (method = 'random' AND rankable_fold) AS r2, avg(recall) FILTER (method = 'environment' AND rankable_fold) AS r3 FROM folds WHERE usable GROUP BY 1)
SELECT taxon_group, round(mean, 9) AS mean, pairs, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, round(p_positive, 9) AS p_positive, round(p_one_sided, 9) AS p_one_sided, round(p_two_sided, 9) AS p_two_sided, declared_pairs, expected_folds, evaluated_folds, rankable_folds, round(evaluated_folds/expected_folds, 9) AS fold_completion_rate, round(rankable_folds/expected_folds, 9) AS rankable_rate_of_expected,
  round(own/declared_pairs, 9) AS ite_method_recall, round(chance/declared_pairs, 9) AS ite_reference_recall, round(best/declared_pairs, 9) AS ite_oracle_recall, round(r1, 9) AS rankable_method_recall, round(r2, 9) AS rankable_reference_recall, round(r3, 9) AS rankable_oracle_recall
FROM whole JOIN boot USING (taxon_group) JOIN flip USING (taxon_group) JOIN e USING (taxon_group) JOIN i USING (taxon_group) JOIN c USING (taxon_group)""")
def r7_clustered_inference(v):
    f = v("folds")
    return rounded(resampling.clustered_inference(f.select("taxon_group", "pair_id").distinct(), f.filter("usable"), 5, 200, ["taxon_group"], "rule", "random", oracle="environment"), 9)


# three cohorts of 16 pairs whose lifts are lowered by 0, 0.03 and 0.2
_COHORTS = f"SELECT pair_id%3 AS cohort, pair_id, lift - [0e0, 0.03e0, 0.2e0][pair_id%3 + 1] AS lift FROM ({_LIFT})"


@query("WITH " + _boot(_COHORTS, "cohort", 100, "(VALUES (0), (1), (2)) sd(seed)") + """, sf AS (SELECT cohort, seed, draw, avg(CASE WHEN CAST('0x' || substr(md5(concat_ws(':', seed, draw, pair_id)), 1, 15) AS BIGINT) % 2 = 0 THEN lift ELSE -lift END) AS m FROM k, range(1, 101) d(draw), (VALUES (0), (1), (2)) sd(seed) GROUP BY 1, 2, 3),
sp AS (SELECT cohort, seed, (1 + count(*) FILTER (abs(m) >= abs(mean) - 1e-12))/CAST(count(*) + 1 AS DOUBLE) AS p FROM sf JOIN whole USING (cohort) GROUP BY 1, 2),
hf AS (SELECT cohort, seed, draw, lift, row_number() OVER (PARTITION BY cohort, seed, draw ORDER BY md5(concat_ws(':', seed, draw, 'half', pair_id)), pair_id) AS h, n FROM k, range(1, 101) d(draw), (VALUES (0), (1), (2)) sd(seed)),
hm AS (SELECT cohort, seed, avg(CASE WHEN m > 0 THEN 1e0 ELSE 0e0 END) AS p FROM (SELECT cohort, seed, draw, avg(lift) AS m FROM hf WHERE h <= greatest(2, ceil(n/2)) GROUP BY 1, 2, 3) GROUP BY 1, 2),
o AS (SELECT cohort, (sum(lift) OVER w - lift)/(count(*) OVER w - 1) AS without FROM l WINDOW w AS (PARTITION BY cohort)), r AS (SELECT cohort, min(without) AS least_mean, max(without) AS largest_mean, avg(CASE WHEN without > 0 THEN 1e0 ELSE 0e0 END) AS loo FROM o GROUP BY 1),
b AS (SELECT cohort, min(boot.p_positive) AS bp, min(hm.p) AS hp, max(sp.p) AS fp, min(ci_low) AS lo, max(ci_high) AS hi FROM boot JOIN hm USING (cohort, seed) JOIN sp USING (cohort, seed) GROUP BY 1), x AS (SELECT cohort, avg(CASE WHEN lift > 0 THEN 1e0 ELSE 0e0 END) AS pos, avg(CASE WHEN lift >= 0 THEN 1e0 ELSE 0e0 END) AS nonneg FROM l GROUP BY 1)
SELECT cohort, pairs, round(mean, 9) AS mean, round(pos, 9) AS positive_share, round(nonneg, 9) AS nonnegative_share, round(least_mean, 9) AS least_mean, round(largest_mean, 9) AS largest_mean, round(loo, 9) AS leave_one_out_positive, round(bp, 9) AS least_bootstrap_positive, round(hp, 9) AS least_half_sample_positive,
  round(fp, 9) AS largest_sign_flip_p, round(lo, 9) AS least_ci_low, round(hi, 9) AS largest_ci_high, CASE WHEN mean > 0 AND loo >= 0.9 AND bp >= 0.95 AND hp >= 0.8 THEN 'stable' WHEN mean > 0 THEN 'positive_but_composition_sensitive' ELSE 'not_stable' END AS verdict FROM b JOIN whole USING (cohort) JOIN r USING (cohort) JOIN x USING (cohort)""")
def r12_stability_audit(v):
    lower = F.element_at(F.array(F.lit(0.0), F.lit(0.03), F.lit(0.2)), (F.col("pair_id") % 3 + 1).cast("int"))
    lifts = _lifts(v).select((F.col("pair_id") % 3).alias("cohort"), "pair_id", (F.col("lift") - lower).alias("lift"))
    return rounded(resampling.stability_audit(lifts, [0, 1, 2], 100, ["cohort"]), 9)


def _contrast(reference: str) -> str:
    pairs = f"SELECT m.pair_id%2 || '|' || m.method AS g, m.pair_id, m.pair_mean - r.pair_mean AS lift FROM ({_ITE}) m JOIN ({_ITE}) r ON r.pair_id = m.pair_id AND r.method = '{reference}' WHERE m.method <> '{reference}' AND m.pair_mean IS NOT NULL AND r.pair_mean IS NOT NULL"
    return "SELECT * FROM (WITH " + _boot(pairs, "g", 50) + f"SELECT CAST(split_part(g, '|', 1) AS BIGINT) AS cohort, split_part(g, '|', 2) AS method, '{reference}' AS reference_method, round(mean, 9) AS mean, pairs, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, round(p_positive, 9) AS p_positive, round(p_two_sided, 9) AS sign_flip_p FROM whole JOIN boot USING (g) JOIN flip USING (g))"


@query(_contrast("random") + " UNION ALL " + _contrast("rule"))
def r13_method_contrasts(v):
    means = _means(v).withColumn("cohort", F.col("pair_id") % 2)
    return rounded(resampling.method_contrasts(means, ["random", "rule"], 50, ["cohort"]), 9)


@query("WITH " + _boot(_LIFT, "taxon_group", 200) + """, s AS (SELECT * FROM whole JOIN boot USING (taxon_group) JOIN flip USING (taxon_group)), q AS (SELECT coalesce((SELECT CASE taxon_group WHEN 'plant' THEN 0.1e0 ELSE 0.2e0 END FROM s WHERE ci_low > 0 AND p_one_sided < 0.05 ORDER BY mean DESC, 1 DESC LIMIT 1), 1e0) AS support_level)
SELECT taxon_group, mean >= 0.015 AS mean_gate, ci_low > 0 AS interval_gate, p_one_sided < 0.05 AS p_gate, pairs = 24 AS size_gate, mean >= 0.015 AND ci_low > 0 AND p_one_sided < 0.05 AND pairs = 24 AS claim_supported, support_level FROM s, q""")
def r14_r15_claims(v):
    base = resampling.bootstrap(_lifts(v), 200, ["taxon_group"]).join(resampling.sign_flip(_lifts(v), 200, ["taxon_group"]).drop("mean"), "taxon_group")
    gated = resampling.claim_gates(base, 24)
    level = resampling.support_level(base.withColumn("q", F.when(F.col("taxon_group") == "plant", 0.1).otherwise(0.2)))
    return gated.select("taxon_group", "mean_gate", "interval_gate", "p_gate", "size_gate", "claim_supported").crossJoin(level)


_METRICS = """WITH x AS (SELECT *, greatest(1e-15, least(1-1e-15, p)) AS q, (rank() OVER (PARTITION BY fold, algorithm ORDER BY p) + (count(*) OVER (PARTITION BY fold, algorithm, p) - 1)/2e0) AS r FROM predictions)
SELECT fold, algorithm, count(*) AS n, round((sum(r) FILTER (presence = 1) - sum(presence)*(sum(presence)+1)/2e0)/(sum(presence)*CAST(count(*)-sum(presence) AS DOUBLE)), 6) AS roc_auc, round(avg(pow(p-presence, 2)), 6) AS brier,
  round(-avg(presence*ln(q)+(1-presence)*ln(1-q)), 6) AS log_loss, round(avg(CASE WHEN p >= 0.5 THEN 1e0 ELSE 0e0 END) FILTER (presence = 1) - avg(CASE WHEN p >= 0.5 THEN 1e0 ELSE 0e0 END) FILTER (presence = 0), 6) AS tss FROM x GROUP BY 1, 2"""


@query(_METRICS)
def m10_probability_metrics(v):
    return rounded(models.probability_metrics(v("predictions"), ["fold", "algorithm"]).select("fold", "algorithm", "n", "roc_auc", "brier", "log_loss", "tss"))


def _newton(rows: str, steps: int) -> str:
    """CTEs x and b0 .. b{steps}: Newton's steps of the logistic regression of y on l for each g, with m copies of a row."""
    parts = [f"x AS ({rows})", "b0 AS (SELECT g, 0e0 AS a, 0e0 AS b FROM x GROUP BY g HAVING min(y) < max(y))"]
    for i in range(1, steps + 1):
        at = f"SELECT x.g, a, b, l, m, y - 1/(1 + exp(-(a + b*l))) AS e, (1/(1 + exp(-(a + b*l))))*(1 - 1/(1 + exp(-(a + b*l)))) AS w FROM x JOIN b{i - 1} USING (g)"
        sums = f"SELECT g, a, b, sum(m*e) AS ga, sum(m*e*l) - 1e-6*b AS gb, sum(m*w) AS haa, sum(m*w*l) AS hab, sum(m*w*l*l) + 1e-6 AS hbb FROM ({at}) GROUP BY 1, 2, 3"
        parts.append(f"b{i} AS (SELECT g, a + (hbb*ga - hab*gb)/(haa*hbb - hab*hab) AS a, b + (haa*gb - hab*ga)/(haa*hbb - hab*hab) AS b FROM ({sums}))")
    return "WITH " + ", ".join(parts) + " "


@query(_newton("SELECT {'fold': fold, 'algorithm': algorithm} AS g, ln(q/(1 - q)) AS l, y, count(*) AS m FROM (SELECT fold, algorithm, greatest(1e-6, least(1 - 1e-6, p)) AS q, CAST(CASE WHEN row_id%3 = 0 AND p > 0.5 THEN 1 WHEN fold = 4 THEN 1 ELSE presence END AS DOUBLE) AS y FROM predictions) GROUP BY 1, 2, 3", 8)
    + "SELECT k.fold, k.algorithm, round(b, 6) AS calibration_slope, round(a, 6) AS calibration_intercept FROM (SELECT DISTINCT fold, algorithm FROM predictions) k LEFT JOIN b8 ON b8.g.fold = k.fold AND b8.g.algorithm = k.algorithm")
def m10_calibration_line(v):
    # labels follow p a little, and one fold has a single class
    y = F.when((F.col("row_id") % 3 == 0) & (F.col("p") > 0.5), 1).when(F.col("fold") == 4, 1).otherwise(F.col("presence"))
    return rounded(models.calibration_lines(v("predictions").withColumn("presence", y), ["fold", "algorithm"]))


@query("""WITH s AS (SELECT fold, algorithm, p, sum(presence) AS tp, count(*) AS m FROM predictions GROUP BY 1, 2, 3), c AS (SELECT *, sum(tp) OVER d AS ctp, sum(m) OVER d AS cm, sum(tp) OVER (PARTITION BY fold, algorithm) AS a FROM s WINDOW d AS (PARTITION BY fold, algorithm ORDER BY p DESC))
SELECT fold, algorithm, round(sum(tp/CAST(a AS DOUBLE)*ctp/CAST(cm AS DOUBLE)), 6) AS average_precision FROM c GROUP BY 1, 2""")
def m10_average_precision(v):
    return rounded(models.probability_metrics(v("predictions"), ["fold", "algorithm"]).select("fold", "algorithm", "average_precision"))


def _builder(v):
    candidates = v("candidates").drop("row_id")

    def build(training):
        # a candidate pool for each taxon and repeat that has training points
        return training.select("taxon", "repeat").distinct().crossJoin(candidates)

    return build


def _taxa(v):
    from ..functions.geo import block_key

    return v("detections").withColumns({"occ_id": F.col("detection_cluster_id"), "taxon": (F.col("detection_cluster_id") % 5).cast("string"), "block": block_key("latitude", "longitude", 0.5)}).select("taxon", "occ_id", "latitude", "longitude", "block")


_CHANCE = f"md5(concat_ws(':', 0, draw, cand_id))"


@query(f"""WITH t AS (SELECT CAST(detection_cluster_id%5 AS VARCHAR) AS taxon, detection_cluster_id AS occ, latitude, longitude, CAST(floor(latitude/0.5e0) AS BIGINT) || ':' || CAST(floor(longitude/0.5e0) AS BIGINT) AS block FROM detections),
k AS (SELECT taxon, block, repeat, row_number() OVER (PARTITION BY taxon, repeat ORDER BY md5(concat_ws(':', 0, repeat, block)), block) AS k, count(*) OVER (PARTITION BY taxon, repeat) AS n FROM (SELECT DISTINCT taxon, block FROM t), range(1, 4) r(repeat)),
f AS (SELECT t.*, repeat, k <= greatest(1, least(n-1, round_even(n*0.2e0, 0))) AS held FROM t JOIN k USING (taxon, block)), pools AS (SELECT DISTINCT taxon, repeat FROM f WHERE NOT held),
c AS (SELECT taxon, repeat, cand_id, latitude, longitude, priority_score FROM pools, candidates WHERE NOT regexp_matches(candidate_type, '(?i)occurrence|known')),
n AS (SELECT taxon, repeat, count(DISTINCT occ) AS n FROM f WHERE held GROUP BY 1, 2), cov AS (SELECT a.taxon, a.repeat, b.cand_id, a.occ FROM f a JOIN c b ON a.taxon = b.taxon AND a.repeat = b.repeat WHERE a.held AND {_D} <= 10000),
top AS (SELECT taxon, repeat, cand_id FROM c QUALIFY row_number() OVER (PARTITION BY taxon, repeat ORDER BY priority_score DESC NULLS LAST, cand_id) <= 10), hit AS (SELECT taxon, repeat, count(DISTINCT occ) AS hit FROM top JOIN cov USING (taxon, repeat, cand_id) GROUP BY 1, 2),
dr AS (SELECT taxon, repeat, draw, cand_id FROM c, range(1, 21) d(draw) QUALIFY row_number() OVER (PARTITION BY taxon, repeat, draw ORDER BY {_CHANCE}, cand_id) <= 10), got AS (SELECT taxon, repeat, draw, count(DISTINCT occ) AS got FROM dr LEFT JOIN cov USING (taxon, repeat, cand_id) GROUP BY 1, 2, 3), rnd AS (SELECT taxon, repeat, avg(got/CAST(n AS DOUBLE)) AS r FROM got JOIN n USING (taxon, repeat) GROUP BY 1, 2)
SELECT taxon, CAST(repeat AS INT) AS repeat, round(coalesce(hit, 0)/n, 6) AS top_k_recall, round(r, 6) AS random_recall, round(coalesce(hit, 0)/n - r, 6) AS lift FROM n LEFT JOIN hit USING (taxon, repeat) LEFT JOIN rnd USING (taxon, repeat)""")
def m1_recovery_validation(v):
    return rounded(models.recovery_validation(_taxa(v), _builder(v), ["taxon"], 3, 10.0, 10, 20))


@query()
def m3_m4_weight_calibration(v):
    taxa = _taxa(v)
    names = ["priority_score", "analogue_score", "sdm_suitability"]
    weights = models.dirichlet_weights(taxa.sparkSession, 12, names)
    out, _ = models.multi_taxon(taxa, _builder(v), taxa.select("taxon").distinct(), names, weights, 2, 10.0, 10)
    return rounded(out)


_TWELVE = f"""t AS (SELECT CAST(detection_cluster_id%12 AS VARCHAR) AS taxon, detection_cluster_id AS occ, latitude, longitude, CAST(floor(latitude/0.5e0) AS BIGINT) || ':' || CAST(floor(longitude/0.5e0) AS BIGINT) AS block FROM detections),
fk AS (SELECT taxon, block, repeat, row_number() OVER (PARTITION BY taxon, repeat ORDER BY md5(concat_ws(':', 0, repeat, block)), block) AS k, count(*) OVER (PARTITION BY taxon, repeat) AS n FROM (SELECT DISTINCT taxon, block FROM t), range(1, 3) r(repeat)),
f AS (SELECT t.*, repeat, k <= greatest(1, least(n-1, round_even(n*0.2e0, 0))) AS held FROM t JOIN fk USING (taxon, block)), pools AS (SELECT DISTINCT taxon, repeat FROM f WHERE NOT held),
split AS (SELECT taxon, row_number() OVER (ORDER BY md5(concat_ws(':', 0, taxon)), taxon) % 2 = 1 AS calibration FROM (SELECT DISTINCT taxon FROM f WHERE held)),
c AS (SELECT taxon, repeat, cand_id, latitude, longitude, priority_score, analogue_score, sdm_suitability FROM pools, candidates WHERE NOT regexp_matches(candidate_type, '(?i)occurrence|known')),
nh AS (SELECT taxon, repeat, count(DISTINCT occ) AS n FROM f WHERE held GROUP BY 1, 2), cov AS (SELECT a.taxon, a.repeat, b.cand_id, a.occ FROM f a JOIN c b ON a.taxon = b.taxon AND a.repeat = b.repeat WHERE a.held AND {_D} <= 20000),
e AS (SELECT i AS id, [-ln((CAST('0x' || substr(md5(concat_ws(':', 0, i, x)), 1, 15) AS BIGINT) % 1000003 + 1)/1000004e0) for x in ['priority_score', 'analogue_score', 'sdm_suitability']] AS e FROM range(4, 16) r(i)),
w AS (SELECT 0 AS id, [1e0/3, 1e0/3, 1e0/3] AS w UNION ALL SELECT i + 1, list_transform(range(3), lambda j: CASE WHEN j = i THEN 1e0 ELSE 0e0 END) FROM range(3) r(i) UNION ALL SELECT id, list_transform(e, lambda x: x/list_sum(e)) FROM e),
sc AS (SELECT taxon, repeat, cand_id, id, list_sum(list_transform([priority_score, analogue_score, sdm_suitability], lambda x, i: CASE WHEN x IS NOT NULL THEN x*w[i] ELSE 0e0 END)) AS total, list_sum(list_transform([priority_score, analogue_score, sdm_suitability], lambda x, i: CASE WHEN x IS NOT NULL THEN w[i] ELSE 0e0 END)) AS there FROM c, w),
top AS (SELECT taxon, repeat, id, cand_id FROM sc QUALIFY row_number() OVER (PARTITION BY taxon, repeat, id ORDER BY round(CASE WHEN there > 0 THEN total/there ELSE 0e0 END, 9) DESC, cand_id) <= 4),
hit AS (SELECT taxon, repeat, id, count(DISTINCT occ) AS hit FROM top JOIN cov USING (taxon, repeat, cand_id) GROUP BY 1, 2, 3), rec AS (SELECT nh.taxon, nh.repeat, w.id, coalesce(hit, 0)/n AS recall, calibration FROM nh CROSS JOIN w JOIN split USING (taxon) LEFT JOIN hit ON hit.taxon = nh.taxon AND hit.repeat = nh.repeat AND hit.id = w.id),
search AS (SELECT id, avg(recall) FILTER (calibration) AS seen, avg(recall) FILTER (NOT calibration) AS unseen FROM rec GROUP BY 1), best AS (SELECT * FROM search ORDER BY round(seen, 9) DESC NULLS LAST, id LIMIT 1)"""


@query(cover_sql("SELECT DISTINCT {'taxon': taxon, 'repeat': repeat} AS g, cand_id AS a, occ AS b FROM cov JOIN split USING (taxon) WHERE NOT calibration", 4).replace("WITH ", f"WITH {_TWELVE}, ", 1)
    + f""", oracle AS (SELECT avg(coalesce(got, 0)/n) AS r FROM nh JOIN split USING (taxon) LEFT JOIN (SELECT g.taxon AS taxon, g.repeat AS repeat, sum(gain) AS got FROM every GROUP BY 1, 2) o ON o.taxon = nh.taxon AND o.repeat = nh.repeat WHERE NOT calibration),
dr AS (SELECT taxon, repeat, draw, cand_id FROM c JOIN split USING (taxon), range(1, 21) d(draw) WHERE NOT calibration QUALIFY row_number() OVER (PARTITION BY taxon, repeat, draw ORDER BY {_CHANCE}, cand_id) <= 4), gd AS (SELECT taxon, repeat, draw, count(DISTINCT occ) AS got FROM dr LEFT JOIN cov USING (taxon, repeat, cand_id) GROUP BY 1, 2, 3),
chance AS (SELECT avg(r) AS r FROM (SELECT taxon, repeat, avg(got/n) AS r FROM gd JOIN nh USING (taxon, repeat) GROUP BY 1, 2)), alone AS (SELECT max(unseen) FILTER (id = 1) AS a1, max(unseen) FILTER (id = 2) AS a2, max(unseen) FILTER (id = 3) AS a3, max(unseen) FILTER (id = 0) AS plain, max(seen) - min(seen) AS span FROM search), taxa AS (SELECT count(*) AS n FROM split)
SELECT best.id AS selected_weight_id, round(w[1], 6) AS selected_priority_score, round(w[2], 6) AS selected_analogue_score, round(w[3], 6) AS selected_sdm_suitability, round(seen, 6) AS selected_calibration_recall, round(unseen, 6) AS selected_unseen_recall, round(plain, 6) AS default_unseen_recall, round(span, 6) AS calibration_recall_range,
  round(a1, 6) AS priority_score_only_unseen_recall, round(a2, 6) AS analogue_score_only_unseen_recall, round(a3, 6) AS sdm_suitability_only_unseen_recall, round(chance.r, 6) AS random_unseen_recall, round(oracle.r, 6) AS oracle_unseen_recall, taxa.n AS taxa, round(unseen - plain, 6) AS lift_over_default, span > 1e-9 AS calibration_informative,
  span > 1e-9 AND taxa.n >= 10 AND unseen - plain > 0.02 AND unseen > chance.r AS recommend_change FROM best JOIN w USING (id), alone, chance, oracle, taxa""")
def m3_calibration_summary(v):
    taxa = _taxa(v).withColumn("taxon", (F.col("occ_id") % 12).cast("string"))
    names = ["priority_score", "analogue_score", "sdm_suitability"]
    weights = models.dirichlet_weights(taxa.sparkSession, 12, names)
    candidates, coverage, held = models.candidate_benchmark(taxa, _builder(v), ["taxon"], 2, 20.0)
    order = F.row_number().over(Window.orderBy(resampling.draw_order(0, "taxon"), "taxon"))
    split = held.select("taxon").distinct().select("taxon", (order % 2 == 1).alias("calibration"))
    search = models.calibrate_weights(candidates, coverage, held, weights, names, 4, ["taxon", "repeat"], split)
    return rounded(models.calibration_summary(search, candidates, coverage, held, weights, names, 4, ["taxon", "repeat"], split, draws=20))


@query()
def m5_fold_comparator(v):
    # in some areas a feature has gaps
    pools = v("candidates").withColumns({"taxon_group": F.when(F.col("survey_area_id") % 2 == 0, "plant").otherwise("animal"), "aspect": F.when((F.col("survey_area_id") % 6 != 0) | (F.col("row_id") % 11 != 0), F.col("aspect"))})
    return rounded(models.fold_comparator(pools, _cover(v), _held(v), 5, AREA, ["slope", "aspect"], 10, group="taxon_group"))


@query(cover_sql(f"SELECT DISTINCT {{'area': survey_area_id, 'km': radius_km}} AS g, cand_id AS a, occ_id AS b FROM ({_COVER}), (VALUES (2e0), (6e0)) r(radius_km) WHERE dist_km <= radius_km", 3) + f""", frame AS (SELECT survey_area_id, radius_km, count(DISTINCT detection_cluster_id) AS n FROM detections, (VALUES (2e0), (6e0)) r(radius_km) GROUP BY 1, 2),
own AS (SELECT g.area AS survey_area_id, g.km AS radius_km, count(DISTINCT b) AS hit FROM n JOIN ({_TOP}) t ON t.survey_area_id = n.g.area AND t.cand_id = n.a GROUP BY 1, 2), best AS (SELECT g.area AS survey_area_id, g.km AS radius_km, sum(gain) AS hit FROM every GROUP BY 1, 2),
dr AS (SELECT survey_area_id, draw, cand_id FROM candidates, range(1, 11) d(draw) QUALIFY row_number() OVER (PARTITION BY survey_area_id, draw ORDER BY {_CHANCE}, cand_id) <= 3),
got AS (SELECT dr.survey_area_id, radius_km, draw, count(DISTINCT n.b) AS got FROM dr CROSS JOIN (VALUES (2e0), (6e0)) r(radius_km) LEFT JOIN n ON n.g.area = dr.survey_area_id AND n.g.km = radius_km AND n.a = dr.cand_id GROUP BY 1, 2, 3), rnd AS (SELECT survey_area_id, radius_km, avg(got/CAST(f.n AS DOUBLE)) AS r FROM got JOIN frame f USING (survey_area_id, radius_km) GROUP BY 1, 2)
SELECT survey_area_id, radius_km, round(coalesce(own.hit, 0)/f.n, 6) AS default_recall, round(coalesce(best.hit, 0)/f.n, 6) AS greedy_oracle_recall, round(r, 6) AS random_recall FROM frame f LEFT JOIN own USING (survey_area_id, radius_km) LEFT JOIN best USING (survey_area_id, radius_km) LEFT JOIN rnd USING (survey_area_id, radius_km)""")
def m6_recovery_at_radii(v):
    return rounded(models.recovery_at_radii(v("candidates"), _cover(v), _held(v), [2.0, 6.0], 3, AREA, 10))


# an inner table for each of four cohorts and three budgets: a pair is a policy, a method a budget
@query("""WITH i AS (SELECT pair_id//12 AS cohort, method AS budget, CAST(pair_id%3 + 1 AS INT) AS k, ((pair_id//3)%4 + 1)/4e0 AS q, repeat, usable AS feasible, CASE WHEN usable THEN recall END AS recall FROM folds),
p AS (SELECT a.cohort, a.budget, a.k, a.q, count(*) AS n, count(*) FILTER (a.feasible AND b.feasible) AS good, avg(a.recall) - avg(b.recall) AS lift FROM i a JOIN i b ON a.cohort = b.cohort AND a.budget = b.budget AND a.repeat = b.repeat AND b.k = 1 AND b.q >= 1 WHERE a.q < 1 GROUP BY 1, 2, 3, 4),
best AS (SELECT * FROM p WHERE n = 5 AND good = 5 AND round(lift, 12) > 0 QUALIFY row_number() OVER (PARTITION BY cohort, budget ORDER BY round(lift, 12) DESC, q DESC, k) = 1)
SELECT d.cohort, d.budget, coalesce(k, 1) AS k, coalesce(q, 1e0) AS q, round(lift, 6) AS lift FROM (SELECT DISTINCT cohort, budget FROM i) d LEFT JOIN best USING (cohort, budget)""")
def m7_policy_choice(v):
    inner = v("folds").select(F.floor(F.col("pair_id") / 12).alias("cohort"), F.col("method").alias("budget"), (F.col("pair_id") % 3 + 1).cast("int").alias("k"), ((F.floor(F.col("pair_id") / 3) % 4 + 1) / 4.0).alias("q"), F.col("repeat").alias("fold"), F.col("usable").alias("feasible"), F.when(F.col("usable"), F.col("recall")).alias("recall"))
    return rounded(models.nested_policy_choice(inner, ["cohort", "budget"], 5))


def _labelled(v):
    return v("candidates").withColumns({"presence": ((F.col("slope") + F.col("aspect") / 6 + F.col("row_id") % 7) > 60).cast("int"), "block": (F.col("survey_area_id") % 6).cast("string")})


@query()
def m8_suitability_ensemble(v):
    rows = _labelled(v)
    scored = models.suitability_ensemble(rows.filter("row_id % 2 = 0"), rows.filter("row_id % 2 = 1").drop("sdm_suitability"), ["slope", "aspect", "analogue_score"])
    members = [c for c in scored.columns if c.startswith("p_")]
    return rounded(scored.select("row_id", "presence", "sdm_suitability", *members), 4)


@query()
def m9_spatial_accuracy(v):
    return rounded(models.spatial_model_accuracy(_labelled(v), ["slope", "aspect"], 1).select("fold", "algorithm", "n", "positives", "roc_auc", "average_precision", "brier", "log_loss", "tss"), 4)


_WIDE = """wide AS (SELECT row_id, CAST(fold%4 AS VARCHAR) AS taxon, fold, max(presence) AS presence, avg(p) AS pa, max(p) AS pb FROM predictions GROUP BY row_id, fold), prev AS (SELECT taxon, fold, sum(presence) FILTER (row_id%3 = 0)/CAST(count(*) FILTER (row_id%3 = 0) AS DOUBLE) AS prior FROM wide WHERE fold <> 4 GROUP BY 1, 2),
test AS (SELECT *, count(*) OVER g AS n, avg(presence) OVER g AS own FROM (SELECT wide.*, prior FROM wide LEFT JOIN prev USING (taxon, fold) WHERE row_id%3 <> 0) WINDOW g AS (PARTITION BY taxon, fold)),
e AS (SELECT i AS id, [-ln((CAST('0x' || substr(md5(concat_ws(':', 0, i, x)), 1, 15) AS BIGINT) % 1000003 + 1)/1000004e0) for x in ['a', 'b']] AS e FROM range(3, 23) r(i)),
w AS (SELECT id, wa, wb, s FROM (SELECT 0 AS id, 0.5e0 AS wa, 0.5e0 AS wb UNION ALL SELECT 1, 1e0, 0e0 UNION ALL SELECT 2, 0e0, 1e0 UNION ALL SELECT id, e[1]/(e[1] + e[2]), e[2]/(e[1] + e[2]) FROM e), (VALUES (0.35e0), (0.6e0), (0.8e0), (1e0)) s(s)),
loss AS (SELECT taxon, id, s, n, fold, presence AS y, greatest(1e-6, least(1 - 1e-6, coalesce(prior, own) + s*(wa*pa + wb*pb - coalesce(prior, own)))) AS p FROM test, w),
search AS (SELECT id, s, sum(-(y*ln(p) + (1-y)*ln(1-p))/n)/sum(1e0/n) AS ll, sum(pow(p - y, 2)/n)/sum(1e0/n) AS br FROM loss WHERE taxon < '2' GROUP BY 1, 2), best AS (SELECT id, s FROM search ORDER BY round(ll, 9), round(br, 9), id, s LIMIT 1)"""


@query(f"WITH {_WIDE} SELECT search.id AS weight_id, search.s AS shrinkage, round(ll, 6) AS calibration_log_loss, round(br, 6) AS calibration_brier, best.id IS NOT NULL AS recommended FROM search LEFT JOIN best ON best.id = search.id AND best.s = search.s")
def m11_shrinkage_search(v):
    return rounded(_searched(v)[0])


@query(f"""WITH {_WIDE}, two AS (SELECT 'selected' AS setting, id, s FROM best UNION ALL SELECT 'equal', 0, 1e0), r AS (SELECT setting, two.id, two.s, taxon, fold, y, p, rank() OVER (PARTITION BY setting, taxon, fold ORDER BY p) + (count(*) OVER (PARTITION BY setting, taxon, fold, p) - 1)/2e0 AS r FROM loss JOIN two ON loss.id = two.id AND loss.s = two.s WHERE taxon >= '2'),
f AS (SELECT setting, id, s, taxon, fold, avg(-(y*ln(p) + (1-y)*ln(1-p))) AS ll, avg(pow(p - y, 2)) AS br, (sum(r) FILTER (y = 1) - sum(y)*(sum(y) + 1)/2e0)/(sum(y)*CAST(count(*) - sum(y) AS DOUBLE)) AS auc FROM r GROUP BY 1, 2, 3, 4, 5), g AS (SELECT setting, id, s, avg(ll) AS ll, avg(br) AS br, avg(auc) AS auc FROM f GROUP BY 1, 2, 3)
SELECT setting, CAST(id AS BIGINT) AS weight_id, s AS shrinkage, round(ll, 6) AS log_loss, round(br, 6) AS brier, round(auc, 6) AS roc_auc, (SELECT max(ll) FILTER (setting = 'selected') < max(ll) FILTER (setting = 'equal') - 0.01 AND max(br) FILTER (setting = 'selected') < max(br) FILTER (setting = 'equal') FROM g) AS recommend_change FROM g""")
def m11_unseen_taxa(v):
    search, wide, weights, split, prevalence = _searched(v)
    return rounded(models.shrinkage_summary(search, wide, ["a", "b"], weights, split, prevalence))


def _searched(v):
    """The search, and what it was made of: a third of rows are training rows, whose prevalence is known but for one fold."""
    wide = v("predictions").groupBy("row_id", (F.col("fold") % 4).cast("string").alias("taxon"), "fold").agg(F.max("presence").alias("presence"), F.avg("p").alias("a"), F.max("p").alias("b"))
    training = wide.filter("row_id % 3 = 0 and fold <> 4").groupBy("taxon", "fold").agg(F.sum("presence").alias("training_presences"), F.count("*").alias("training_rows"))
    test = wide.filter("row_id % 3 <> 0")
    weights = models.dirichlet_weights(wide.sparkSession, 20, ["a", "b"])
    split = test.select("taxon").distinct().withColumn("calibration", F.col("taxon") < "2")
    search = models.shrinkage_search(test, ["a", "b"], weights, [0.35, 0.6, 0.8, 1.0], split, training)
    return search, test, weights, split, training
