"""Benchmarks and models (M1-M11): folds, draws, weights and settings are key columns of one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import finite
from ..functions.scoring import without_known_locations
from ..sources.exports import leaked_columns
from ..sources.scratch import materialise
from .aggregates import recovered_fraction
from .joins import Coverage, coverage_of
from .resampling import draw_order, hashed_int, random_sets, spatial_folds
from .selection import dual_maximin, environmental_maximin, geographic_maximin, group_policy, heldout_oracle, score_top_k
from .windows import percent_rank_average

Builder = Callable[[DataFrame], DataFrame]


def candidate_benchmark(occurrences: DataFrame, builder: Builder, keys: list[str], repeats: int, radius_km: float, block: str = "block", occ: str = "occ_id", seed: int = 0) -> tuple[DataFrame, Coverage, DataFrame]:
    """(candidates, coverage, held-out) of every repeat (M2).

    ``builder`` gets the training points alone, with their keys and ``repeat``, and gives candidates with ``cand_id``;
    known locations go, and coverage is joined only afterwards, for what is chosen.
    """
    folds = spatial_folds(occurrences, repeats, keys, block=block, seed=seed)
    by = [*keys, "repeat"]
    candidates = without_known_locations(builder(folds.filter(~F.col("held_out")).drop("held_out")))
    if told := leaked_columns(candidates):
        raise ValueError(f"candidates carry outcomes: {told}")
    held = folds.filter("held_out").select(*by, occ, "latitude", "longitude")
    return candidates, Coverage(held, candidates, radius_km, by, occ), held


def recovery_validation(occurrences: DataFrame, builder: Builder, keys: list[str], repeats: int, radius_km: float, k: int, draws: int, score: str = "priority_score", seed: int = 0) -> DataFrame:
    """Top-k recall of every repeat against the mean of random sets of the same pool (M1)."""
    candidates, coverage, held = candidate_benchmark(occurrences, builder, keys, repeats, radius_km, seed=seed)
    by = [*keys, "repeat"]
    chosen = score_top_k(candidates, k, by, score, "cand_id")
    got = recovered_fraction(chosen, coverage, held, by, occ="occ_id").select(*by, F.col("recall").alias("top_k_recall"))
    drawn = random_sets(candidates, k, draws, by, "cand_id", seed)
    chance = _draw_recall(drawn, coverage, held, by)
    return got.join(chance, by, "left").withColumn("lift", F.col("top_k_recall") - F.col("random_recall"))


def _draw_recall(drawn: DataFrame, coverage: DataFrame | Coverage, held: DataFrame, by: list[str]) -> DataFrame:
    all_ = held.groupBy(*by).agg(F.countDistinct("occ_id").alias("_all"))
    drawn = materialise(drawn.select(*by, "draw", "cand_id"), "draws")
    hit = drawn.join(coverage_of(coverage, drawn, by), [*by, "cand_id"]).groupBy(*by, "draw").agg(F.countDistinct("occ_id").alias("_hit"))
    frame = drawn.select(*by, "draw").distinct().join(hit, [*by, "draw"], "left").join(all_, by)
    return frame.groupBy(*by).agg(F.avg(F.coalesce("_hit", F.lit(0)) / F.col("_all")).alias("random_recall"))


def dirichlet_weights(spark, draws: int, names: list[str], seed: int = 0) -> DataFrame:
    """(weight_id, one column per name): the equal weights, each name alone, and draws uniform over the simplex by hashed exponentials (M3)."""
    rows = [(0, *[1.0 / len(names)] * len(names))] + [(i + 1, *[float(i == j) for j in range(len(names))]) for i in range(len(names))]
    fixed = spark.createDataFrame(rows, "weight_id long, " + ", ".join(f"{n} double" for n in names))
    e = [-F.log((hashed_int(seed, F.col("weight_id").cast("string"), F.lit(n)) % 1_000_003 + 1) / 1_000_004.0) for n in names]
    total = e[0]
    for x in e[1:]:
        total = total + x
    return fixed.unionByName(spark.range(len(rows), len(rows) + draws).withColumnRenamed("id", "weight_id").select("weight_id", *[(x / total).alias(n) for x, n in zip(e, names)]))


def calibrate_weights(candidates: DataFrame, coverage: DataFrame | Coverage, heldout: DataFrame, weights: DataFrame, names: list[str], k: int, keys: list[str], split: DataFrame, taxon: str = "taxon") -> DataFrame:
    """Mean recall of every weight on calibration and on unseen taxa, and which is best on the former (M3).

    A candidate's score is the weighted mean of the components that it has, 0 without any. ``weights`` has at most a few
    hundred rows; ``split`` says which taxa are ``calibration``.
    """
    scored = candidates.crossJoin(F.broadcast(weights.select("weight_id", *[F.col(n).alias(f"_w_{n}") for n in names])))
    part = [F.when(F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")), F.col(f"_w_{n}")) for n in names]
    total = sum((F.coalesce(F.col(n) * w, F.lit(0.0)) for n, w in zip(names, part)), F.lit(0.0))
    there = sum((F.coalesce(w, F.lit(0.0)) for w in part), F.lit(0.0))
    score = F.when(there > 0, total / there).otherwise(0.0)
    scored = scored.select(*keys, "weight_id", "cand_id", score.alias("_score"))
    # candidates are dealt to k lots; no score below the worst of the lots' best ones is among the k best, so only few rows are put in order
    lots = scored.groupBy(*keys, "weight_id", F.pmod(F.xxhash64("cand_id"), F.lit(k)).alias("_lot")).agg(F.max("_score").alias("_m"))
    least = materialise(lots.groupBy(*keys, "weight_id").agg(F.when(F.count("*") == k, F.min("_m") - 2e-9).otherwise(F.lit(float("-inf"))).alias("_least")), "weight-least")
    w = Window.partitionBy(*keys, "weight_id").orderBy(F.round("_score", 9).desc(), "cand_id")
    few = scored.join(least, [*keys, "weight_id"]).filter(F.col("_score") >= F.col("_least"))
    chosen = few.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).select(*keys, "weight_id", "cand_id")
    chosen = materialise(chosen, "weight-chosen")
    coverage = coverage_of(coverage, chosen, keys)
    all_ = heldout.groupBy(*keys).agg(F.countDistinct("occ_id").alias("_all"))
    hit = chosen.join(coverage.select(*keys, "cand_id", "occ_id"), [*keys, "cand_id"]).groupBy(*keys, "weight_id").agg(F.countDistinct("occ_id").alias("_hit"))
    frame = all_.crossJoin(F.broadcast(weights.select("weight_id"))).join(hit, [*keys, "weight_id"], "left")
    recall = frame.withColumn("recall", F.coalesce("_hit", F.lit(0)) / F.col("_all")).join(split, taxon)
    by = recall.groupBy("weight_id").agg(F.avg(F.when(F.col("calibration"), F.col("recall"))).alias("calibration_recall"), F.avg(F.when(~F.col("calibration"), F.col("recall"))).alias("unseen_recall"))
    best = F.row_number().over(Window.orderBy(F.round("calibration_recall", 9).desc_nulls_last(), "weight_id"))  # one row for each weight
    return by.withColumn("recommended", best == 1)


# fixed values: what a change of weights needs
CHANGE = {"taxa": 10, "lift": 0.02, "range": 1e-9}


def calibration_summary(search: DataFrame, candidates: DataFrame, coverage: DataFrame | Coverage, heldout: DataFrame, weights: DataFrame, names: list[str], k: int, keys: list[str], split: DataFrame, default_id: int = 0, taxon: str = "taxon", draws: int = 100, seed: int = 0) -> DataFrame:
    """One row: the chosen weights against the default, chance, the greedy oracle and each component alone, on unseen taxa (M3).

    A change is recommended if calibration tells weights apart, there are at least ten taxa and two components, the lift
    over the default is above 0.02 and the chosen weights are better than random sets of the same pools. The weights of a
    single component are those rows of ``weights`` that have nothing else.
    """
    unseen = split.filter(~F.col("calibration")).select(taxon)
    held, pool = (df.join(unseen, taxon, "left_semi") for df in (heldout, candidates))
    met = coverage.among(unseen, [taxon]) if isinstance(coverage, Coverage) else coverage.join(unseen, taxon, "left_semi")
    chance = _draw_recall(random_sets(pool, k, draws, keys, "cand_id", seed), met, held, keys).agg(F.avg("random_recall").alias("random_unseen_recall"))
    oracle = recovered_fraction(heldout_oracle(met, k, keys), met, held, keys).agg(F.avg("recall").alias("oracle_unseen_recall"))
    alone = [F.max(F.when((F.col(n) == 1) & (F.greatest(*[F.col(m) for m in names if m != n], F.lit(0.0), F.lit(0.0)) == 0), F.col("unseen_recall"))).alias(f"{n}_only_unseen_recall") for n in names]
    best = lambda c: F.max(F.when(F.col("recommended"), F.col(c)))
    default = F.max(F.when(F.col("weight_id") == default_id, F.col("unseen_recall")))
    told = search.join(F.broadcast(weights), "weight_id").agg(
        best("weight_id").alias("selected_weight_id"), *[best(n).alias(f"selected_{n}") for n in names], best("calibration_recall").alias("selected_calibration_recall"), best("unseen_recall").alias("selected_unseen_recall"),
        default.alias("default_unseen_recall"), (F.max("calibration_recall") - F.min("calibration_recall")).alias("calibration_recall_range"), *alone,
    )
    taxa = split.agg(F.count("*").alias("taxa"))
    out = told.crossJoin(F.broadcast(chance)).crossJoin(F.broadcast(oracle)).crossJoin(F.broadcast(taxa))  # one row each
    out = out.withColumns({"lift_over_default": F.col("selected_unseen_recall") - F.col("default_unseen_recall"), "calibration_informative": F.coalesce(F.col("calibration_recall_range") > CHANGE["range"], F.lit(False))})
    gate = F.col("calibration_informative") & F.lit(len(names) > 1) & (F.col("taxa") >= CHANGE["taxa"]) & (F.col("lift_over_default") > CHANGE["lift"]) & (F.col("selected_unseen_recall") > F.col("random_unseen_recall"))
    return out.withColumn("recommend_change", F.coalesce(gate, F.lit(False)))


def multi_taxon(occurrences: DataFrame, builder: Builder, declared: DataFrame, names: list[str], weights: DataFrame, repeats: int, radius_km: float, k: int, least_taxa: int = 4, taxon: str = "taxon") -> tuple[DataFrame, DataFrame]:
    """(calibration, taxa with their status): every declared taxon in one job, those without folds kept as failures (M4)."""
    candidates, coverage, held = candidate_benchmark(occurrences, builder, [taxon], repeats, radius_km)
    done = held.select(taxon).distinct().withColumn("status", F.lit("ok"))
    status = declared.select(taxon).distinct().join(done, taxon, "left").withColumn("status", F.coalesce("status", F.lit("failed")))
    good = status.filter("status = 'ok'").select(taxon, (F.row_number().over(Window.orderBy(draw_order(0, taxon), taxon)) % 2 == 1).alias("calibration"))
    if len(good.limit(least_taxa).collect()) < least_taxa:
        raise ValueError(f"fewer than {least_taxa} taxa came back")
    return calibrate_weights(candidates, coverage, held, weights, names, k, [taxon, "repeat"], good, taxon), status


METHODS = ["group_policy", "score_top_k", "geographic_maximin", "environmental_maximin", "dual_space_maximin", "random_same_pool", "heldout_oracle"]
ENVIRONMENTAL = ["environmental_maximin", "dual_space_maximin"]


def fold_comparator(candidates: DataFrame, coverage: DataFrame | Coverage, heldout: DataFrame, k: int, keys: list[str], features: list[str] = (), draws: int = 50, seed: int = 0, group: str | None = None) -> DataFrame:
    """(keys, method, status, selected_count, recall) of the seven selection rules on the same pools (M5).

    Every fold with held-out points has a row for each method. ``group`` names the column of the pool's group, whose frozen policy
    (K6) is then one of them. Environmental methods need ``features`` without a missing or non-finite value in the fold's
    pool, else they are ``environmentally_ineligible``; without candidates all are ``missing_fold_candidates``; both have recall 0.
    """
    bad = F.lit(False)
    for f in features:
        bad = bad | ~F.coalesce(finite(f), F.lit(False))
    pools = candidates.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(bad).alias("_bad"))
    usable = candidates.join(pools.filter("not _bad").select(*keys), keys, "left_semi") if features else None
    sets = {"score_top_k": score_top_k(candidates, k, keys, ident="cand_id"), "geographic_maximin": geographic_maximin(candidates, k, keys, "cand_id"), "heldout_oracle": heldout_oracle(coverage, k, keys)}
    if group:
        sets["group_policy"] = group_policy(candidates, keys, group, ident="cand_id")
    if features:
        sets["environmental_maximin"] = environmental_maximin(usable, k, [*features], keys, "cand_id")
        sets["dual_space_maximin"] = dual_maximin(usable, k, [*features], keys, ident="cand_id")
    out = None
    for name, chosen in sets.items():
        chosen = materialise(chosen.select(*keys, "cand_id"), "fold-chosen")
        count = chosen.groupBy(*keys).agg(F.count("*").alias("selected_count"))
        one = recovered_fraction(chosen, coverage, heldout, keys).select(*keys, "recall").join(count, keys, "left").withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    chance = _draw_recall(random_sets(candidates, k, draws, keys, "cand_id", seed), coverage, heldout, keys)
    chance = chance.join(pools, keys).select(*keys, F.col("random_recall").alias("recall"), F.least(F.lit(k), "_n").alias("selected_count"), F.lit("random_same_pool").alias("method"))
    names = [m for m in METHODS if group or m != "group_policy"]
    frame = heldout.select(*keys).distinct().join(pools, keys, "left").withColumn("method", F.explode(F.array(*map(F.lit, names))))
    hollow = F.col("method").isin(*ENVIRONMENTAL) & (F.lit(not features) | F.coalesce("_bad", F.lit(True)))
    status = F.when(F.col("_n").isNull(), "missing_fold_candidates").when(hollow, "environmentally_ineligible").otherwise("ok")
    got = frame.join(out.unionByName(chance), [*keys, "method"], "left").withColumn("status", status)
    ok = F.col("status") == "ok"
    return got.select(*keys, "method", "status", F.when(ok, F.coalesce("selected_count", F.lit(0))).otherwise(0).cast("long").alias("selected_count"), F.when(ok, F.coalesce("recall", F.lit(0.0))).otherwise(0.0).alias("recall"))


def recovery_at_radii(candidates: DataFrame, coverage: DataFrame | Coverage, heldout: DataFrame, radii_km: list[float], k: int, keys: list[str], draws: int = 50, seed: int = 0) -> DataFrame:
    """Score top-k, random and oracle recall at several radii from one coverage table of the largest, or from a ``Coverage`` (M6)."""
    if isinstance(coverage, Coverage):
        chosen, drawn = score_top_k(candidates, k, keys, ident="cand_id").select(*keys, "cand_id"), random_sets(candidates, k, draws, keys, "cand_id", seed)
        out = None
        for r in map(float, radii_km):
            met = coverage.within(r)
            own = recovered_fraction(chosen, met, heldout, keys).select(*keys, F.lit(r).alias("radius_km"), F.col("recall").alias("default_recall"))
            oracle = recovered_fraction(heldout_oracle(met, k, keys), met, heldout, keys).select(*keys, F.col("recall").alias("greedy_oracle_recall"))
            one = own.join(oracle, keys, "left").join(_draw_recall(drawn, met, heldout, keys), keys, "left")
            out = one if out is None else out.unionByName(one)
        return out
    levels = F.explode(F.array(*map(F.lit, map(float, radii_km))))
    cover = coverage.withColumn("radius_km", levels).filter("dist_km <= radius_km")
    spread = lambda df: df.withColumn("radius_km", levels)
    by = [*keys, "radius_km"]
    chosen = spread(score_top_k(candidates, k, keys, ident="cand_id").select(*keys, "cand_id"))
    held = spread(heldout.select(*keys, "occ_id").distinct())
    own = recovered_fraction(chosen, cover, held, by).select(*by, F.col("recall").alias("default_recall"))
    oracle = recovered_fraction(heldout_oracle(cover, k, by), cover, held, by).select(*by, F.col("recall").alias("greedy_oracle_recall"))
    chance = _draw_recall(spread(random_sets(candidates, k, draws, keys, "cand_id", seed)), cover, held, by)
    return own.join(oracle, by, "left").join(chance, by, "left")


def policy_lifts(inner: DataFrame, keys: list[str], folds: int, fold: str = "fold") -> DataFrame:
    """(keys, k, q, folds, complete, mean_recall, control_recall, lift) of every policy with q < 1 against the control k = 1, q = 1 (M7).

    ``inner``: keys, k, q, fold, feasible, recall. A policy is complete if it and the control are feasible with a recall in
    all ``folds`` inner folds; only then it has means.
    """
    control = inner.filter("k = 1 and q >= 1").select(*keys, fold, F.col("feasible").alias("_cf"), F.col("recall").alias("_cr"))
    paired = inner.filter("q < 1").join(control, [*keys, fold])
    good = F.col("feasible") & F.col("_cf") & F.col("recall").isNotNull() & F.col("_cr").isNotNull()
    by = paired.groupBy(*keys, "k", "q").agg(F.count("*").alias("folds"), F.count_if(good).alias("_good"), F.avg("recall").alias("_r"), F.avg("_cr").alias("_c"))
    complete = (F.col("folds") == folds) & (F.col("_good") == folds)
    by = by.withColumn("complete", complete)
    when = lambda c: F.when(F.col("complete"), c)
    return by.select(*keys, "k", "q", "folds", "complete", when(F.col("_r")).alias("mean_recall"), when(F.col("_c")).alias("control_recall"), when(F.col("_r") - F.col("_c")).alias("lift"))


def nested_policy_choice(inner: DataFrame, keys: list[str], folds: int, fold: str = "fold", digits: int = 12) -> DataFrame:
    """(keys, k, q, lift): for each key the complete policy of largest positive lift, ties to the larger q, then to the smaller k, else k = 1, q = 1 (M7).

    ``inner`` as in ``policy_lifts``; lifts tie at ``digits``. Outer folds see only this choice.
    """
    good = policy_lifts(inner, keys, folds, fold).filter("complete").withColumn("lift", F.round("lift", digits)).filter("lift > 0")
    best = good.groupBy(*keys).agg(F.max(F.struct("lift", "q", (-F.col("k")).alias("_k"))).alias("_b"))
    out = inner.select(*keys).distinct().join(best, keys, "left")
    return out.select(*keys, F.coalesce(-F.col("_b._k"), F.lit(1)).cast("int").alias("k"), F.coalesce("_b.q", F.lit(1.0)).alias("q"), F.col("_b.lift").alias("lift"))


def suitability_ensemble(train: DataFrame, score: DataFrame, features: list[str], label: str = "presence", seed: int = 7) -> DataFrame:
    """``score`` with each classifier's probability and their mean (M8).

    Missing features take the training median. Classes weigh alike. A forest without bootstrap stands in for extremely
    randomised trees, which the library has not.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    filled = [f"_f_{f}" for f in features]
    share = train.groupBy(label).count()
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    weight = share.select(label, (total / (2.0 * F.col("count"))).alias("_weight"))  # two rows
    data = train.join(F.broadcast(weight), label).withColumn("_label", F.col(label).cast("double"))
    stages = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_raw"), StandardScaler(withMean=True, inputCol="_raw", outputCol="_x")]
    common = {"featuresCol": "_x", "labelCol": "_label", "weightCol": "_weight"}
    members = {
        "logistic": LogisticRegression(maxIter=100, regParam=0.01, **common),
        "random_forest": RandomForestClassifier(numTrees=60, maxDepth=8, seed=seed, **common),
        "extra_trees_stand_in": RandomForestClassifier(numTrees=60, maxDepth=8, bootstrap=False, featureSubsetStrategy="sqrt", seed=seed + 1, **common),
        "boosted_trees": GBTClassifier(maxIter=30, maxDepth=3, seed=seed, **common),
    }
    prepared = Pipeline(stages=stages).fit(data)
    ready, out = prepared.transform(data).persist(), prepared.transform(score)
    for name, member in members.items():
        out = member.fit(ready).transform(out).withColumn(f"p_{name}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    ready.unpersist()
    mean = sum((F.col(f"p_{n}") for n in members), F.lit(0.0)) / len(members)
    return out.withColumn("sdm_suitability", mean).drop("_raw", "_x", *filled)


def spatial_model_accuracy(points: DataFrame, features: list[str], repeats: int, label: str = "presence", block: str = "block", ident: str = "row_id", seed: int = 0) -> DataFrame:
    """Metrics of every member on held-out blocks of each repeat; folds need both classes on both sides (M9)."""
    folds = spatial_folds(points, repeats, [], 0.25, block, seed)
    both = folds.groupBy("repeat", "held_out").agg(F.countDistinct(label).alias("_k")).groupBy("repeat").agg(F.min("_k").alias("_k")).filter("_k = 2").select("repeat")
    out = None
    for r in sorted(x.repeat for x in both.collect()):
        fold = folds.filter(F.col("repeat") == r)
        train, held = fold.filter(~F.col("held_out")), fold.filter("held_out")
        scored = suitability_ensemble(train, held, features, label)
        wide = scored.select(ident, label, F.lit(r).alias("fold"), F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in scored.columns if c.startswith("p_")]), F.array(*[F.col(c) for c in scored.columns if c.startswith("p_")]))).alias("algorithm", "p"))
        out = wide if out is None else out.unionByName(wide)
    return probability_metrics(out, ["fold", "algorithm"], label)


def probability_metrics(predictions: DataFrame, keys: list[str], label: str = "presence", p: str = "p", threshold: float = 0.5, bins: int = 10) -> DataFrame:
    """ROC AUC, average precision, Brier score, log loss, TSS at a threshold and the Boyce-Spearman index.

    AUC is from average ranks; precision is summed over distinct scores, ties together.
    """
    rows = predictions.select(*keys, F.col(label).cast("double").alias("_y"), F.col(p).cast("double").alias("_p"))
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("_p")))
    n, pos = F.count("*"), F.sum("_y")
    ranked = percent_rank_average(rows, "_p", keys, "_r")
    base = ranked.groupBy(*keys).agg(
        n.alias("n"), pos.alias("positives"),
        ((F.sum(F.when(F.col("_y") == 1, F.col("_r"))) * n - pos * (pos + 1) / 2) / (pos * (n - pos))).alias("roc_auc"),
        F.avg(F.pow(F.col("_p") - F.col("_y"), 2)).alias("brier"), (-F.avg(F.col("_y") * F.log(q) + (1 - F.col("_y")) * F.log(1 - q))).alias("log_loss"),
        (F.avg(F.when(F.col("_y") == 1, (F.col("_p") >= threshold).cast("double"))) - F.avg(F.when(F.col("_y") == 0, (F.col("_p") >= threshold).cast("double")))).alias("tss"),
    )
    steps = rows.groupBy(*keys, "_p").agg(F.sum("_y").alias("_tp"), F.count("*").alias("_m"))
    down = Window.partitionBy(*keys).orderBy(F.desc("_p"))
    whole = Window.partitionBy(*keys)
    steps = steps.withColumns({"_ctp": F.sum("_tp").over(down), "_cm": F.sum("_m").over(down), "_all": F.sum("_tp").over(whole)})
    ap = steps.groupBy(*keys).agg(F.sum(F.col("_tp") / F.col("_all") * F.col("_ctp") / F.col("_cm")).alias("average_precision"))
    binned = ranked.withColumn("_bin", F.least(F.lit(bins - 1), F.floor(F.col("_r") * bins - 1e-9)))
    ratio = binned.groupBy(*keys, "_bin").agg((F.avg("_y")).alias("_share"), F.avg("_p").alias("_mid"))
    both = percent_rank_average(percent_rank_average(ratio, "_share", keys, "_a"), "_mid", keys, "_b")
    boyce = both.groupBy(*keys).agg(F.when((F.count("*") >= 3) & (F.stddev_pop("_a") > 1e-12), F.corr("_a", "_b")).alias("boyce_spearman"))
    return base.join(ap, keys).join(boyce, keys, "left")


def calibration_lines(predictions: DataFrame, keys: list[str], label: str = "presence", p: str = "p", ridge: float = 1e-6, steps: int = 50) -> DataFrame:
    """(keys, calibration_slope, calibration_intercept): the logistic regression of labels on logits of p, all keys at once.

    Newton's steps from 0: one aggregation of sums a step for all keys, from rows counted by (keys, p, label) once, until no
    coefficient moves. The slope has a penalty of ``ridge`` / 2 times its square. Keys with one class only have null.
    """
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p).cast("double")))
    rows = predictions.filter(F.col(p).isNotNull() & F.col(label).isNotNull()).select(F.struct(*keys, F.lit(0).alias("_all")).alias("_g"), F.log(q / (1 - q)).alias("_l"), F.col(label).cast("double").alias("_y"))
    rows = materialise(rows.groupBy("_g", "_l", "_y").agg(F.count("*").alias("_m")), "calibration")
    fits = materialise(rows.groupBy("_g").agg(F.min("_y").alias("_lo"), F.max("_y").alias("_hi")).select("_g", (F.col("_lo") < F.col("_hi")).alias("_both"), F.lit(0.0).alias("_b"), F.lit(0.0).alias("_a")), "calibration-fits")
    for _ in range(steps):
        at = rows.join(fits.filter("_both"), "_g").withColumn("_p", 1 / (1 + F.exp(-(F.col("_a") + F.col("_b") * F.col("_l")))))
        m, x, left, curve = F.col("_m"), F.col("_l"), F.col("_y") - F.col("_p"), F.col("_p") * (1 - F.col("_p"))
        sums = at.groupBy("_g", "_both", "_b", "_a").agg(F.sum(m * left).alias("_ga"), F.sum(m * left * x).alias("_gb"), F.sum(m * curve).alias("_haa"), F.sum(m * curve * x).alias("_hab"), F.sum(m * curve * x * x).alias("_hbb"))
        gb, hbb = F.col("_gb") - ridge * F.col("_b"), F.col("_hbb") + ridge
        det = F.col("_haa") * hbb - F.col("_hab") * F.col("_hab")
        da, db = (hbb * F.col("_ga") - F.col("_hab") * gb) / det, (F.col("_haa") * gb - F.col("_hab") * F.col("_ga")) / det
        moved = sums.select("_g", "_both", F.when(det > 0, F.col("_b") + db).otherwise(F.col("_b")).alias("_b"), F.when(det > 0, F.col("_a") + da).otherwise(F.col("_a")).alias("_a"), F.when(det > 0, F.greatest(F.abs(da), F.abs(db))).otherwise(0.0).alias("_move"))
        moved = materialise(moved, "calibration-fits")
        most = moved.agg(F.max("_move").alias("m")).first().m
        fits = moved.drop("_move").unionByName(fits.filter("not _both"))
        if most is None or most < 1e-12:
            break
    return fits.select(*[F.col(f"_g.{c}").alias(c) for c in keys], F.when(F.col("_both"), F.col("_b")).alias("calibration_slope"), F.when(F.col("_both"), F.col("_a")).alias("calibration_intercept"))


def _ensemble(predictions: DataFrame, names: list[str], settings: DataFrame, prevalence: DataFrame, label: str, taxon: str, fold: str) -> DataFrame:
    """Every prediction with every setting's probability ``_p``: the weighted mean shrunk towards the fold's training prevalence, its own mean where that is unknown."""
    sizes = predictions.groupBy(taxon, fold).agg(F.count("*").alias("_n"), F.avg(F.col(label).cast("double")).alias("_own"))
    prior = prevalence.select(taxon, fold, (F.col("training_presences") / F.col("training_rows")).alias("_prior")).dropDuplicates([taxon, fold])
    sizes = sizes.join(prior, [taxon, fold], "left").select(taxon, fold, "_n", F.coalesce("_prior", "_own").alias("_prior"))
    rows = predictions.join(sizes, [taxon, fold]).crossJoin(F.broadcast(settings.select("weight_id", "shrinkage", *[F.col(n).alias(f"_w_{n}") for n in names])))
    mean = sum((F.col(n) * F.col(f"_w_{n}") for n in names), F.lit(0.0))
    return rows.withColumn("_p", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("_prior") + F.col("shrinkage") * (mean - F.col("_prior")))))


def shrinkage_search(predictions: DataFrame, names: list[str], weights: DataFrame, shrinkages: list[float], calibration: DataFrame, prevalence: DataFrame, label: str = "presence", taxon: str = "taxon", fold: str = "fold") -> DataFrame:
    """Log loss and Brier score of every ensemble weight and shrinkage on calibration taxa, folds weighing alike, and which is best.

    A probability is prior + shrinkage x (weighted mean - prior), where the prior is the fold's training prevalence
    (``prevalence``: taxon, fold, training_presences, training_rows), never a label that is evaluated, unless it is unknown.
    One aggregation over settings: ``weights`` and ``shrinkages`` are declared lists of bounded size. Unseen taxa take no
    part: see ``shrinkage_summary``.
    """
    settings = weights.withColumn("shrinkage", F.explode(F.array(*[F.lit(float(s)) for s in shrinkages])))
    seen = predictions.join(calibration.filter("calibration").select(taxon), taxon, "left_semi")
    rows = _ensemble(seen, names, settings, prevalence, label, taxon, fold)
    y, w = F.col(label).cast("double"), 1.0 / F.col("_n")
    loss = -(y * F.log("_p") + (1 - y) * F.log(1 - F.col("_p")))
    out = rows.groupBy("weight_id", "shrinkage").agg((F.sum(loss * w) / F.sum(w)).alias("calibration_log_loss"), (F.sum(F.pow(F.col("_p") - y, 2) * w) / F.sum(w)).alias("calibration_brier"))
    best = F.row_number().over(Window.orderBy(F.round("calibration_log_loss", 9), F.round("calibration_brier", 9), "weight_id", "shrinkage"))  # one row for each setting
    return out.withColumn("recommended", best == 1)


def shrinkage_summary(search: DataFrame, predictions: DataFrame, names: list[str], weights: DataFrame, calibration: DataFrame, prevalence: DataFrame, equal_id: int = 0, label: str = "presence", taxon: str = "taxon", fold: str = "fold") -> DataFrame:
    """(setting, weight_id, shrinkage, log_loss, brier, roc_auc, recommend_change): the chosen and the equal setting on unseen taxa, means over folds.

    A change is recommended if log loss falls by more than 0.01 and the Brier score falls.
    """
    chosen = search.filter("recommended").select("weight_id", "shrinkage", F.lit("selected").alias("setting"))
    both = chosen.unionByName(chosen.select(F.lit(equal_id).cast("long").alias("weight_id"), F.lit(1.0).alias("shrinkage"), F.lit("equal").alias("setting")))
    both = materialise(both.join(F.broadcast(weights), "weight_id"), "settings")  # two rows
    unseen = predictions.join(calibration.filter(~F.col("calibration")).select(taxon), taxon, "left_semi")
    out = None
    for setting in ("selected", "equal"):
        rows = _ensemble(unseen, names, both.filter(F.col("setting") == setting), prevalence, label, taxon, fold)
        scores = probability_metrics(rows.select(taxon, fold, label, F.col("_p").alias("p")), [taxon, fold], label)
        one = scores.agg(F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier"), F.avg("roc_auc").alias("roc_auc")).crossJoin(F.broadcast(both.filter(F.col("setting") == setting).select("setting", "weight_id", "shrinkage")))
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy(F.lit(0))  # two rows
    of = lambda c, s: F.max(F.when(F.col("setting") == s, F.col(c))).over(w)
    better = (of("log_loss", "selected") < of("log_loss", "equal") - 0.01) & (of("brier", "selected") < of("brier", "equal"))
    return out.withColumn("recommend_change", better).select("setting", "weight_id", "shrinkage", "log_loss", "brier", "roc_auc", "recommend_change")
