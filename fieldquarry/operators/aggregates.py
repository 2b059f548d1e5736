"""Recovery, decision and cohort summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .joins import Coverage, coverage_of, radius_join
from .pairs import distance_sums
from .windows import percent_rank_average


def medoid(points: DataFrame, keys: list[str], ident: str = "row_id") -> DataFrame:
    """The member of each group with the least sum of distances, ties to the smaller id (A1).

    Sums are compared at a micrometre, so that equal ones tie whatever the order of addition.
    """
    sums = distance_sums(points, keys, ident).withColumn("total_m", F.round("total_m", 6))
    best = sums.groupBy(*keys).agg(F.min(F.struct("total_m", ident)).alias("b"))
    return best.select(*keys, F.col(f"b.{ident}").alias(ident), F.col("b.total_m").alias("total_m"))


def recovered_fraction(selected: DataFrame, coverage: DataFrame | Coverage, heldout: DataFrame, keys: list[str], candidate: str = "cand_id", occ: str = "occ_id") -> DataFrame:
    """Distinct held-out ids that the selection covers, over all held-out ids; 0 where nothing is selected (A2)."""
    all_ = heldout.groupBy(*keys).agg(F.countDistinct(occ).alias("n_heldout"))
    if isinstance(coverage, Coverage):  # the choice is read twice
        selected = materialise(selected.select(*keys, candidate), "recovered-selected")
    hit = selected.select(*keys, candidate).join(coverage_of(coverage, selected, keys, candidate), [*keys, candidate]).join(heldout.select(*keys, occ), [*keys, occ], "left_semi")
    hit = hit.groupBy(*keys).agg(F.countDistinct(occ).alias("n_recovered"))
    out = all_.join(hit, keys, "left").withColumn("n_recovered", F.coalesce("n_recovered", F.lit(0)))
    return out.withColumn("recall", F.col("n_recovered") / F.col("n_heldout"))


def recovery_summary(nearest: DataFrame, radii_km: list[float], keys: list[str] = (), distance: str = "nearest_km") -> DataFrame:
    """Per radius: detections, recovered, recall, median and largest finite distance (A3; with an area among keys A20)."""
    rows = nearest.withColumn("radius_km", F.explode(F.array(*map(F.lit, map(float, radii_km)))))
    d = F.when(F.col(distance) < float("inf"), F.col(distance))
    return rows.groupBy(*keys, "radius_km").agg(
        F.count("*").alias("n_detections"), F.count_if(F.col(distance) <= F.col("radius_km")).alias("n_recovered"), F.avg((F.col(distance) <= F.col("radius_km")).cast("double")).alias("recall"),
        F.percentile(d, F.lit(0.5)).alias("median_km"), F.max(d).alias("max_km"),
    )


def fold_completion(folds: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """ok if all folds are, failed if none is, else partial (A4)."""
    good = F.count_if(F.coalesce(F.col(status) == "ok", F.lit(False)))
    return folds.groupBy(*keys).agg(F.count("*").alias("folds"), good.alias("ok_folds")).withColumn("completion", F.when(F.col("ok_folds") == F.col("folds"), "ok").when(F.col("ok_folds") == 0, "failed").otherwise("partial"))


def intention_to_evaluate(declared: DataFrame, folds: DataFrame, repeats: int, methods: list[str], environmental: list[str], keys: list[str]) -> DataFrame:
    """Sum of recalls over the declared number of repeats, missing ones as 0 (A5).

    Methods in ``environmental`` are null unless all declared folds came back.
    """
    frame = declared.select(*keys).withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    sums = folds.groupBy(*keys, "method").agg(F.sum("recall").alias("_s"), F.count("recall").alias("returned_folds"))
    out = frame.join(sums, [*keys, "method"], "left").withColumn("returned_folds", F.coalesce("returned_folds", F.lit(0)))
    mean = F.coalesce(F.col("_s"), F.lit(0.0)) / repeats
    return out.withColumn("pair_mean", F.when(F.col("method").isin(*environmental) & (F.col("returned_folds") < repeats), None).otherwise(mean)).drop("_s")


def cohort_summary(folds: DataFrame, keys: list[str]) -> DataFrame:
    """Mean recall, sizes, median pool and the mean of rankable folds alone."""
    return folds.groupBy(*keys).agg(F.avg("recall").alias("mean_recall"), F.count("*").alias("folds"), F.percentile("candidate_pool", F.lit(0.5)).alias("median_pool"), F.avg(F.when(F.col("rankable_fold"), F.col("recall"))).alias("rankable_mean"))


def zone_agreement(zones: DataFrame, top: int = 8, keys: list[str] = ()) -> DataFrame:
    """Counts of agreement classes among the best zones, and the Spearman correlation of ranks."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    work = zones.withColumn("_k", F.row_number().over(w.orderBy(F.col("model_rank").asc_nulls_last(), "zone_id")))
    both = work.withColumn("_both", F.col("initial_rank").isNotNull() & F.col("model_rank").isNotNull())
    marked = percent_rank_average(percent_rank_average(both.filter("_both"), "initial_rank", [*keys], "_a"), "model_rank", [*keys], "_b")
    first = lambda name: F.count_if((F.col("_k") <= top) & (F.col("agreement_class") == name))
    counts = work.groupBy(*keys).agg(
        F.count("*").alias("zone_count"), F.count_if(F.col("_k") <= top).alias("top_zone_count"), first("Concordant — highest priority").alias("concordant_top_zones"),
        first("Local evidence first").alias("local_evidence_first_top_zones"), first("Model-led exploration").alias("model_led_top_zones"),
    )
    rho = marked.groupBy(*keys).agg(F.when(F.count("*") >= 2, F.bround(F.corr("_a", "_b"), 4)).alias("initial_model_rank_spearman"))
    return counts.join(rho, keys, "left") if keys else counts.crossJoin(rho)


def model_performance(metrics: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Each algorithm's AUC (of its mean or diagnostic folds, if any), equal ensemble weight and the best one's role."""
    kind = F.col("fold").cast("string").isin("mean", "diagnostic")
    by = metrics.groupBy(*keys, "algorithm").agg(F.avg(F.when(kind, F.col("auc"))).alias("_p"), F.avg("auc").alias("_a"), F.max(kind.cast("int")).alias("_has"))
    by = by.withColumn("validation_auc", F.when(F.col("_has") == 1, F.col("_p")).otherwise(F.col("_a"))).drop("_p", "_a", "_has")
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    best = F.min_by("algorithm", F.struct(F.coalesce(-F.col("validation_auc"), F.lit(float("inf"))), "algorithm")).over(w)
    role = F.when((F.col("algorithm") == best) & F.col("validation_auc").isNotNull(), "best individual model; ensemble member").otherwise("ensemble member")
    return by.withColumns({"ensemble_weight": F.bround(1.0 / F.count("*").over(w), 4), "model_role": role})


def decision_overlap(a: DataFrame, b: DataFrame, keys: list[str], ident: str = "site_id") -> DataFrame:
    """Shared and united members of two sets, Jaccard index and exact match for each key."""
    both = a.select(*keys, ident, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*keys, ident, F.lit(0).alias("_a"), F.lit(1).alias("_b"))).groupBy(*keys, ident).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    out = both.groupBy(*keys).agg(F.sum(F.col("_a") * F.col("_b")).alias("shared"), F.count("*").alias("united"))
    return out.withColumns({"jaccard": F.col("shared") / F.col("united"), "exact_match": F.col("shared") == F.col("united")})


def overlap_rollup(overlap: DataFrame, group: str = "taxon_group") -> DataFrame:
    """Means for each group and for all."""
    return overlap.rollup(group).agg(F.avg("jaccard").alias("mean_jaccard"), F.avg(F.col("exact_match").cast("double")).alias("exact_share"), F.count("*").alias("folds")).withColumn(group, F.coalesce(F.col(group), F.lit("all")))


def stratum_means(results: DataFrame, method: str = "method", strata: list[str] = ("taxon_group", "geographic_stratum"), value: str = "pair_mean") -> DataFrame:
    """Mean of a method over everything and over each stratum alone (A10)."""
    s = [*strata]
    sets = [[F.col(method)]] + [[F.col(method), F.col(x)] for x in s]
    return results.groupingSets(sets, F.col(method), *[F.col(x) for x in s]).agg(F.avg(value).alias("mean"), F.count(value).alias("pairs"))


def budget_curve(results: DataFrame, keys: list[str] = ("budget", "radius_km", "method"), taxon: str = "taxon") -> DataFrame:
    """Mean over repeats, then over taxa."""
    one = results.groupBy(*keys, taxon).agg(F.avg("recall").alias("recall"))
    return one.groupBy(*keys).agg(F.avg("recall").alias("mean_recall"), F.count("*").alias("taxa"))


def budget_contrast(curve: DataFrame, method: str, reference: str) -> DataFrame:
    """One method's curve less another's."""
    a, b = curve.filter(F.col("method") == method), curve.filter(F.col("method") == reference)
    return a.select("budget", "radius_km", F.col("mean_recall").alias("_a")).join(b.select("budget", "radius_km", F.col("mean_recall").alias("_b")), ["budget", "radius_km"]).select("budget", "radius_km", (F.col("_a") - F.col("_b")).alias("contrast"))


#: Rows of an order that ``covering_prefix`` takes first, and how the number grows.
PREFIX, GROWTH = 64, 8


def covering_prefix(declared: DataFrame, order: DataFrame, radius_km: float, keys: list[str], detection: str = "occ_id", candidate: str = "cand_id", rank: str = "decision_rank") -> DataFrame:
    """(keys, detection, rank): the first place of an order that covers each declared detection within the radius.

    Detections meet growing prefixes of the order and only those that a prefix leaves open meet the next, so there is no list of
    all pairs. The last piece holds all ranks that are left.
    """
    todo = materialise(declared.select(*keys, detection, "latitude", "longitude"), "prefix-todo")
    order = materialise(order.select(*keys, candidate, "latitude", "longitude", rank), "prefix-order")
    most = order.agg(F.max(rank).alias("n")).first().n or 0
    found, low, high = None, 0, PREFIX
    while True:
        piece = order.filter((F.col(rank) > low) & (F.col(rank) <= high))
        got = radius_join(todo, piece, radius_km * 1000.0, keys, left_id=detection, right_id=candidate, carry=[rank]).groupBy(*keys, detection).agg(F.min(rank).alias(rank))
        got = materialise(got, "prefix-found")
        found = got if found is None else found.unionByName(got)
        if high >= most:
            return found
        todo = materialise(todo.join(got, [*keys, detection], "left_anti"), "prefix-todo")
        if todo.isEmpty():
            return found
        low, high = high, high * GROWTH


def prefix_frontier(declared: DataFrame, covering: DataFrame, keys: list[str], detection: str = "occ_id", rank: str = "decision_rank") -> DataFrame:
    """The smallest prefix of an order that recovers every declared detection, null if it never does."""
    first = covering.groupBy(*keys, detection).agg(F.min(rank).alias("_r"))
    joined = declared.join(first, [*keys, detection], "left")
    return joined.groupBy(*keys).agg(F.when(F.count_if(F.col("_r").isNull()) == 0, F.max("_r")).alias("prefix"))


def pareto_front(df: DataFrame, a: str, b: str, keys: list[str] = ()) -> DataFrame:
    """Rows that no other row beats in one of two minimised measures without losing in the other."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    # only the best b of each a can be on the front, and only while b falls as a grows
    best = df.groupBy(*keys, a).agg(F.min(b).alias(b))
    before = F.min(b).over(w.orderBy(a).rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col(b) < F.col("_b"))).drop("_b")
    return df.join(front, [*keys, a, b], "left_semi")


def within_area_percentile(cells: DataFrame, own: DataFrame, value: str, area: str = "area", ident: str = "row_id") -> DataFrame:
    """Share of an area's cells that are at most the value at each point (A15); ``own`` holds ident, area and the value."""
    counts = cells.filter(F.col(value).isNotNull()).groupBy(area, value).agg(F.count("*").alias("_m"))
    w = Window.partitionBy(area)
    upto = counts.withColumns({"_upto": F.sum("_m").over(w.orderBy(value)), "_n": F.sum("_m").over(w)})
    return own.join(upto.select(area, value, (F.col("_upto") / F.col("_n")).alias("percentile")), [area, value], "left")


def robustness_summary(runs: DataFrame, keys: list[str], value: str = "recall", success: str = "success") -> DataFrame:
    """Rate of success, least value and quantiles over runs."""
    q = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.avg(F.col(success).cast("double")).alias("success_rate"), F.min(value).alias("least"), q[0].alias("q05"), q[1].alias("median"), q[2].alias("q95"))


def design_similarity(selected: DataFrame, canonical: str, keys: list[str], design: str = "design", cell: str = "row_id") -> DataFrame:
    """(keys, design, n_cells, jaccard): overlap of each design's cells with the canonical design's, which may be empty."""
    cells = selected.select(*keys, design, cell).distinct()
    own = cells.filter(F.col(design) == canonical).select(*keys, cell, F.lit(1).alias("_c"))
    size = own.groupBy(*keys).agg(F.count("*").alias("_k"))
    met = cells.join(own, [*keys, cell], "left").groupBy(*keys, design).agg(F.count("*").alias("n_cells"), F.count("_c").alias("_both"))
    met = met.join(size, keys, "left") if keys else met.join(F.broadcast(size), F.lit(True), "left")
    return met.select(*keys, design, "n_cells", (F.col("_both") / (F.col("n_cells") + F.coalesce("_k", F.lit(0)) - F.col("_both"))).alias("jaccard"))


def robustness_by_kind(runs: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """Complete recoveries, recovered detections, similarity to the canonical set, farthest detection and size over each kind of perturbation.

    ``runs``: keys, kind, recovered, total, jaccard, max_nearest_km, n_cells.
    """
    q = lambda c, share: F.percentile(c, F.lit(share))
    return runs.groupBy(*keys, kind).agg(
        F.count("*").alias("n"), F.avg((F.col("recovered") == F.col("total")).cast("double")).alias("complete_recovery_rate"), F.avg("recovered").alias("mean_recovered"), F.min("recovered").alias("min_recovered"),
        F.avg("jaccard").alias("mean_jaccard"), q("jaccard", 0.05).alias("q05_jaccard"), F.avg("max_nearest_km").alias("mean_max_nearest_km"), q("max_nearest_km", 0.95).alias("q95_max_nearest_km"),
        F.avg("n_cells").alias("mean_cells"), q("n_cells", 0.05).alias("q05_cells"), q("n_cells", 0.95).alias("q95_cells"),
    )


def facet_counts(df: DataFrame, facet: str, least: int, keys: list[str] = ()) -> DataFrame:
    """Records per species, of those with at least ``least``."""
    return df.groupBy(*keys, facet).agg(F.count("*").alias("records")).filter(F.col("records") >= least)


def land_fraction(sampled: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Share of points with a surface value; outside the grid counts as without."""
    return sampled.groupBy(*keys).agg(F.avg(F.col(value).isNotNull().cast("double")).alias("land_fraction"))


def two_stage_means(metrics: DataFrame, first: list[str], then: list[str], value: str) -> DataFrame:
    """Means of taxon means with their number."""
    return metrics.groupBy(*first).agg(F.avg(value).alias(value)).groupBy(*then).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def accuracy_summary(metrics: DataFrame, columns: list[str], draws: int, taxon: str = "taxon", algorithm: str = "algorithm", seed: int = 0) -> DataFrame:
    """(algorithm, metric, successful_taxa, valid_folds, mean, ci_low, ci_high): each metric's mean over taxon means and its bootstrap interval."""
    from .resampling import bootstrap

    long = metrics.select(algorithm, taxon, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_x")).select(algorithm, taxon, "_x.metric", "_x.value")
    means = long.groupBy(algorithm, "metric", taxon).agg(F.avg(F.when(~F.isnan("value"), F.col("value"))).alias("value"))
    spread = bootstrap(means, draws, [algorithm, "metric"], "value", taxon, seed).select(algorithm, "metric", "mean", "ci_low", "ci_high")
    counts = metrics.groupBy(algorithm).agg(F.countDistinct(taxon).alias("successful_taxa"), F.count("*").alias("valid_folds"))
    return counts.join(spread, algorithm)


def complete_folds(declared: DataFrame, folds: DataFrame, repeats: int, methods: list[str], keys: list[str]) -> DataFrame:
    """Every declared pair, repeat and method; what is missing has recall 0 and says so; duplicates are an error."""
    twice = folds.groupBy(*keys, "repeat", "method").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"a fold was returned twice: {twice[0].asDict()}")
    frame = declared.select(*keys).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    out = frame.join(folds.select(*keys, "repeat", "method", "recall", "status"), [*keys, "repeat", "method"], "left")
    return out.withColumns({"recall": F.coalesce("recall", F.lit(0.0)), "status": F.coalesce("status", F.lit("artifact_missing"))})


def evaluable_means(complete: DataFrame, keys: list[str]) -> DataFrame:
    """Means over folds that came back alone."""
    return complete.filter("status = 'ok'").groupBy(*keys, "method").agg(F.avg("recall").alias("evaluable_mean"), F.count("*").alias("evaluable_folds"))


def patch_annotation(members: DataFrame, ranks: DataFrame, keys: list[str], patch: str = "candidate_patch_id", cell: str = "row_id") -> DataFrame:
    """Best and median rank, mean and largest uncertainty over each patch's cells."""
    return members.join(ranks, [*keys, cell]).groupBy(*keys, patch).agg(F.min("consensus").alias("best_rank"), F.percentile("consensus", F.lit(0.5)).alias("median_rank"), F.avg("uncertainty").alias("mean_uncertainty"), F.max("uncertainty").alias("max_uncertainty"))
