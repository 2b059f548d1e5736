"""Random designs, resampling and inference.

Every draw is an order by md5("seed:draw:id"), so draws depend neither on partitions nor on the engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .windows import placed_quantiles, quantile_strata


def draw_order(seed: int, *parts) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(p) if isinstance(p, str) else p for p in parts]))


def hashed_int(seed: int, *parts) -> Column:
    """A non-negative number of 60 bits from the draw's hash."""
    return F.conv(F.substring(draw_order(seed, *parts), 1, 15), 16, 10).cast("long")


def _beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows with equal keys, null ones too; without keys ``right`` has no more rows than there are draws."""
    named = right.withColumnsRenamed({c: f"_right_{c}" for c in keys})
    if not keys:
        return left.crossJoin(F.broadcast(named))
    out = left.join(named, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in keys], how)
    return out.drop(*[f"_right_{c}" for c in keys])


#: Standard deviations above a draw's size that its threshold lets through; fewer let more draws be filled up.
SLACK = 6.0


def bottom_draws(pool: DataFrame, sizes: DataFrame, draws: int, keys: list[str], ident: str, seed: int = 0, size: str = "quota", refilled: list | None = None) -> DataFrame:
    """Rows (keys, ident, size, draw, _k) of the first ``size`` rows of each pool in each draw's order, as ``_k`` from 1.

    Only rows whose hash is below a threshold are sorted: a pool of n rows lets about size + 6 sqrt(size) of them pass,
    so what is shuffled grows with the draws' sizes and not with the pools. A draw that got fewer than it needs, which is
    rare, is drawn again from its whole pool, so the sets are those of a complete order. ``sizes`` has one row for each
    pool; pools without one, or of a size null or below 1, draw nothing. Ids that stand twice in a pool are two rows. The
    number of draws filled up goes to ``refilled``.
    """
    rows = materialise(pool.select(*keys, ident), "draw-pool")
    counted = _beside(rows.groupBy(*keys).agg(F.count("*").alias("_n")), sizes.select(*keys, size), keys).filter((F.col(size) >= 1) & (F.col("_n") >= 1))
    share = (F.col(size) + SLACK * F.sqrt(F.col(size)) + SLACK) / F.col("_n")
    # 13 hexadecimal digits are 52 bits, which a double holds exactly; from a share of 1 on every row passes
    bar = F.when(share < 1, F.lower(F.lpad(F.hex(F.floor(share * float(2**52)).cast("long")), 13, "0"))).otherwise("g")
    counted = materialise(counted.withColumn("_bar", bar), "draw-sizes")
    turns, order = F.explode(F.sequence(F.lit(1), F.lit(draws))), draw_order(seed, "draw", ident)
    few = _beside(rows, counted.select(*keys, size, "_bar"), keys).withColumn("draw", turns).withColumn("_h", order)
    few = materialise(few.filter(F.col("_h") < F.col("_bar")).drop("_bar"), "draw-few")
    every = counted.select(*keys, size, "_n").withColumn("draw", turns)
    short = _beside(every, few.groupBy(*keys, "draw").agg(F.count("*").alias("_got")), [*keys, "draw"], "left")
    short = materialise(short.filter(F.coalesce("_got", F.lit(0)) < F.least(F.col(size), F.col("_n"))).select(*keys, size, "draw"), "draw-short")
    n = short.count()
    if refilled is not None:
        refilled.append(n)
    if n:
        enough = _beside(few, short.select(*keys, "draw"), [*keys, "draw"], "left_anti")
        few = enough.unionByName(_beside(rows, short, keys).withColumn("_h", order))
    w = Window.partitionBy(*keys, "draw").orderBy("_h", ident)
    return few.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= F.col(size)).drop("_h")


def random_sets(pool: DataFrame, k: int, draws: int, keys: list[str], ident: str = "site_id", seed: int = 0) -> DataFrame:
    """``draws`` sets of k rows of each pool without replacement."""
    sizes = pool.select(*keys).distinct().withColumn("_size", F.lit(k)) if keys else pool.sparkSession.range(1).select(F.lit(k).alias("_size"))
    return bottom_draws(pool, sizes, draws, keys, ident, seed, "_size").drop("_size", "_k")


def area_quota_sets(pool: DataFrame, quotas: DataFrame, draws: int, keys: list[str], area: str, ident: str = "site_id", seed: int = 0) -> DataFrame:
    """Sets with each area's quota of rows (R2)."""
    return bottom_draws(pool, quotas, draws, [*keys, area], ident, seed).drop("_k", "quota")


def random_recovery_test(observed: DataFrame, drawn: DataFrame, keys: list[str], value: str = "recall") -> DataFrame:
    """Observed value, mean and 95 % range of draws, lift, and the one-sided p (1 + draws at least as good) / (draws + 1) (R2)."""
    joined = drawn.withColumnRenamed(value, "_d").join(observed.select(*keys, F.col(value).alias("observed")), keys) if keys else drawn.withColumnRenamed(value, "_d").crossJoin(observed.select(F.col(value).alias("observed")))
    q = F.percentile("_d", F.array(F.lit(0.025), F.lit(0.975)))
    return joined.groupBy(*keys, "observed").agg(
        F.avg("_d").alias("random_mean"), q[0].alias("random_q025"), q[1].alias("random_q975"), (F.col("observed") - F.avg("_d")).alias("lift"),
        ((1 + F.count_if(F.col("_d") >= F.col("observed") - 1e-12)) / (F.count("*") + 1)).alias("p_one_sided"),
    )


def spatial_folds(points: DataFrame, repeats: int, keys: list[str], share: float = 0.2, block: str = "block", seed: int = 0) -> DataFrame:
    """Every point in every repeat with ``held_out``: whole blocks, round(share * blocks), at least 1 and not all."""
    blocks = points.select(*keys, block).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    one = Window.partitionBy(*keys, "repeat")
    n = F.count("*").over(one)
    k = F.row_number().over(one.orderBy(draw_order(seed, "repeat", block), block))
    take = F.greatest(F.lit(1), F.least(n - 1, F.bround(n * share)))
    return points.join(blocks.withColumn("held_out", k <= take), [*keys, block])


def usable_folds(points: DataFrame, repeats: int, attempts: int, keys: list[str], least_train: int, least_held: int, share: float = 0.2, block: str = "block", seed: int = 0) -> DataFrame:
    """The first ``repeats`` distinct attempts with enough training and held-out points, numbered anew."""
    tried = spatial_folds(points, attempts, keys, share, block, seed).withColumnRenamed("repeat", "attempt")
    shape = tried.groupBy(*keys, "attempt").agg(F.count_if(F.col("held_out")).alias("_h"), F.count_if(~F.col("held_out")).alias("_t"), F.concat_ws("|", F.array_sort(F.collect_set(F.when(F.col("held_out"), F.col(block))))).alias("_sig"))
    good = shape.filter((F.col("_h") >= least_held) & (F.col("_t") >= least_train)).groupBy(*keys, "_sig").agg(F.min("attempt").alias("attempt"))
    k = F.row_number().over(Window.partitionBy(*keys).orderBy("attempt"))
    picked = good.withColumn("repeat", k).filter(F.col("repeat") <= repeats).drop("_sig")
    return tried.join(picked, [*keys, "attempt"]).drop("attempt")


def stratified_sample(taxa: DataFrame, n: int, value: str, bins: int, keys: list[str], ident: str = "taxon", seed: int = 0) -> DataFrame:
    """Round-robin over quantile strata in hash order, up to ``n``."""
    strata = quantile_strata(taxa, value, bins, keys, ident)
    turn = F.row_number().over(Window.partitionBy(*keys, "stratum").orderBy(draw_order(seed, "stratum", ident), ident))
    strata = strata.withColumn("round", turn)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return strata.withColumn("sample_rank", F.row_number().over(w.orderBy("round", "stratum"))).filter(F.col("sample_rank") <= n)


def factorial_cohort(taxa: DataFrame, cells: list[tuple], per_cell: int, columns: list[str], ident: str = "taxon", seed: int = 0) -> DataFrame:
    """``per_cell`` taxa for each declared cell in turn, none used twice.

    The cells, a few dozen, are a sequence by nature: each excludes what the ones before took.
    """
    spark = taxa.sparkSession
    taken: list[tuple] = []
    for cell in cells:
        rows = taxa
        for c, v in zip(columns, cell):
            rows = rows.filter(F.col(c) == v)
        if taken:
            rows = rows.join(F.broadcast(spark.createDataFrame([(t[0],) for t in taken], f"{ident} {dict(taxa.dtypes)[ident]}")), ident, "left_anti")
        best = rows.select(ident).distinct().orderBy(draw_order(seed, F.lit("|".join(map(str, cell))), ident), ident).limit(per_cell).collect()
        taken += [(r[0], *cell, i + 1) for i, r in enumerate(best)]
    kinds = dict(taxa.dtypes)
    return spark.createDataFrame(taken, ", ".join([f"{ident} {kinds[ident]}", *[f"{c} {kinds[c]}" for c in columns], "cell_rank int"]))


def balance_audit(cohort: DataFrame, columns: list[str], per_cell: int) -> DataFrame:
    """How many of the declared number each cell has."""
    return cohort.groupBy(*columns).agg(F.count("*").alias("n")).withColumn("complete", F.col("n") == per_cell)


def bootstrap_means(values: DataFrame, draws: int, keys: list[str], value: str = "lift", order: str = "pair_id", seed: int = 0) -> DataFrame:
    """(keys, draw, mean) of resampled pairs (R8). Pairs are a cohort of bounded size; each draw is a row's worth of work."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    rows = values.filter(F.col(value).isNotNull()).select(*keys, order, F.col(value).alias("_v"))
    rows = rows.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    picks = rows.select(*keys, "_i", "_n").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_j", (hashed_int(seed, "draw", "_i") % F.col("_n")).cast("int"))
    met = picks.select(*keys, "draw", F.col("_j").alias("_i")).join(rows.select(*keys, "_i", "_v"), [*keys, "_i"])
    return met.groupBy(*keys, "draw").agg(F.avg("_v").alias("mean"))


def bootstrap(values: DataFrame, draws: int, keys: list[str], value: str = "lift", order: str = "pair_id", seed: int = 0) -> DataFrame:
    """Mean, 95 % interval and share of positive means."""
    q = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    spread = bootstrap_means(values, draws, keys, value, order, seed).groupBy(*keys).agg(q[0].alias("ci_low"), q[1].alias("ci_high"), F.avg((F.col("mean") > 0).cast("double")).alias("p_positive"))
    mean = values.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("pairs"))
    return mean.join(spread, keys, "left") if keys else mean.crossJoin(spread)


def sign_flip(values: DataFrame, draws: int, keys: list[str], value: str = "lift", order: str = "pair_id", seed: int = 0) -> DataFrame:
    """Monte-Carlo sign-flip p of the mean, one- and two-sided."""
    rows = values.filter(F.col(value).isNotNull()).select(*keys, order, F.col(value).alias("_v")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    sign = F.when(hashed_int(seed, "draw", order) % 2 == 0, 1.0).otherwise(-1.0)
    flipped = rows.groupBy(*keys, "draw").agg(F.avg(sign * F.col("_v")).alias("_m"))
    seen = values.groupBy(*keys).agg(F.avg(value).alias("mean"))
    both = flipped.join(seen, keys) if keys else flipped.crossJoin(seen)
    return both.groupBy(*keys, "mean").agg(
        ((1 + F.count_if(F.col("_m") >= F.col("mean") - 1e-12)) / (F.count("*") + 1)).alias("p_one_sided"), ((1 + F.count_if(F.abs("_m") >= F.abs("mean") - 1e-12)) / (F.count("*") + 1)).alias("p_two_sided")
    )


def exact_sign_flip(values: DataFrame, keys: list[str], value: str = "lift", order: str = "pair_id", most: int = 20) -> DataFrame:
    """The sign-flip p over all 2^n signs, n at most ``most``."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    rows = values.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), (F.row_number().over(w.orderBy(order)) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    if not rows.filter(F.col("_n") > most).limit(1).isEmpty():
        raise ValueError(f"exact signs are for at most {most} values")
    lists = rows.groupBy(*keys, "_n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("_vs"))
    signs = lists.withColumn("_m", F.explode(F.sequence(F.lit(0).cast("long"), (F.pow(F.lit(2), F.col("_n")) - 1).cast("long"))))
    total = F.aggregate(F.transform("_vs", lambda v, i: F.when(F.expr("_m").bitwiseAND(F.pow(F.lit(2), i).cast("long")) != 0, v).otherwise(-v)), F.lit(0.0), lambda s, x: s + x)
    seen = F.aggregate("_vs", F.lit(0.0), lambda s, x: s + x)
    both = signs.select(*keys, total.alias("_t"), seen.alias("_s"), "_n")
    return both.groupBy(*keys).agg(F.max("_n").alias("n"), (F.count_if(F.col("_t") >= F.col("_s") - 1e-12) / F.count("*")).alias("p_one_sided"), (F.count_if(F.abs("_t") >= F.abs("_s") - 1e-12) / F.count("*")).alias("p_two_sided"))


def leave_one_out_means(values: DataFrame, keys: list[str], value: str = "lift", order: str = "pair_id") -> DataFrame:
    """The mean without each row."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    n = F.count(value).over(w)
    return values.withColumn("mean_without", F.when(n > 1, (F.sum(value).over(w) - F.col(value)) / (n - 1)))


def leave_one_out_range(values: DataFrame, keys: list[str], value: str = "lift", order: str = "pair_id") -> DataFrame:
    """The least and largest of them."""
    return leave_one_out_means(values, keys, value, order).groupBy(*keys).agg(F.min("mean_without").alias("least_mean"), F.max("mean_without").alias("largest_mean"))


def half_subsets(values: DataFrame, keys: list[str] = (), value: str = "lift", order: str = "pair_id", threshold: float = 0.015, most: int = 3_000_000) -> DataFrame:
    """(keys, n, computed, subset_size, subsets, positive_share, threshold_share, q025, q975) over the means of all subsets of half of each key's rows, rounded down.

    ``threshold_share`` is of means of at least ``threshold``. Keys whose subsets are none or more than ``most`` are not
    computed: the rest is null. A subset is a choice from each half of the rows, so just those of the right size are made.
    """
    keys = [*keys]
    rows = values.filter(F.col(value).isNotNull())
    lists = rows.groupBy(*keys).agg(F.count("*").cast("int").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(value).alias("v")))), lambda x: x["v"]).alias("_vs"))
    sizes = {n: math.comb(n, n // 2) for n in range(2, 64) if math.comb(n, n // 2) <= most}
    small = F.col("n").isin(*sizes)
    k = F.floor(F.col("n") / 2).cast("int")

    def sums(part) -> list:
        picks = F.sequence(F.lit(0).cast("long"), (F.pow(F.lit(2), F.size(part)) - 1).cast("long"))
        return [F.explode(picks).alias("_m"), part.alias("_part")]

    taken = lambda v, i: F.when(F.expr("_m").bitwiseAND(F.pow(F.lit(2), i).cast("long")) != 0, v).otherwise(0.0)
    total = F.aggregate(F.transform("_part", taken), F.lit(0.0), lambda s, x: s + x)
    some = lists.filter(small)
    left = some.select(*keys, k.alias("_size"), *sums(F.slice("_vs", F.lit(1), k))).select(*keys, "_size", (F.col("_size") - F.bit_count("_m")).alias("_rest"), total.alias("_a"))
    right = some.select(*keys, *sums(F.slice("_vs", k + 1, F.col("n")))).select(*keys, F.bit_count("_m").alias("_rest"), total.alias("_b"))
    means = materialise(left.join(right, [*keys, "_rest"]).select(*keys, ((F.col("_a") + F.col("_b")) / F.col("_size")).alias("_mean")), "subsets")
    share = lambda c: F.avg(c.cast("double"))
    by = means.groupBy(*keys).agg(F.count("*").alias("subsets"), share(F.col("_mean") > 1e-12).alias("positive_share"), share(F.col("_mean") >= threshold - 1e-12).alias("threshold_share"))
    spread = placed_quantiles(means, "_mean", keys, [0.025, 0.975]).withColumnsRenamed({"q0": "q025", "q1": "q975"})
    both = by.join(spread, keys) if keys else by.crossJoin(F.broadcast(spread))
    frame = lists.select(*keys, "n", small.alias("computed"), F.when(small, k).alias("subset_size"))
    return frame.join(both, keys, "left") if keys else frame.join(F.broadcast(both), F.lit(True), "left")


def clustered_inference(declared: DataFrame, folds: DataFrame, repeats: int, draws: int, keys: list[str], method: str, reference: str, pair: str = "pair_id", seed: int = 0, oracle: str | None = None) -> DataFrame:
    """Lift of one method over another on intention-to-evaluate pair means, with its interval and sign-flip p.

    Also pairs and folds that were declared, came back and can be ranked, their rates, and each method's mean over declared
    pairs (missing folds 0) and over rankable folds alone; the same of an ``oracle`` method, if one is named. A fold came
    back if it has a row of ``method``.
    """
    from .aggregates import intention_to_evaluate

    names = {"method": method, "reference": reference} | ({"oracle": oracle} if oracle else {})
    pairs = declared.select(*keys, pair).distinct()
    means = intention_to_evaluate(pairs, folds, repeats, [*names.values()], [], [*keys, pair])
    wide = means.groupBy(*keys, pair).pivot("method", [*names.values()]).agg(F.first("pair_mean"))
    lifts = wide.withColumn("lift", F.col(f"`{method}`") - F.col(f"`{reference}`"))
    expected = F.count("*") * repeats
    frame = lifts.groupBy(*keys).agg(F.count("*").alias("declared_pairs"), expected.alias("expected_folds"), *[F.avg(f"`{m}`").alias(f"ite_{n}_recall") for n, m in names.items()])
    inside = folds.join(pairs, [*keys, pair], "left_semi")
    own, good = F.col("method") == method, F.col("rankable_fold")
    counts = inside.groupBy(*keys).agg(F.count_if(own).alias("evaluated_folds"), F.count_if(own & good).alias("rankable_folds"), *[F.avg(F.when((F.col("method") == m) & good, F.col("recall"))).alias(f"rankable_{n}_recall") for n, m in names.items()])
    out = bootstrap(lifts, draws, keys, "lift", pair, seed).join(sign_flip(lifts, draws, keys, "lift", pair, seed).drop("mean"), keys).join(frame, keys).join(counts, keys, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("evaluated_folds", "rankable_folds")})
    return out.withColumns({"fold_completion_rate": F.col("evaluated_folds") / F.col("expected_folds"), "rankable_rate_of_expected": F.col("rankable_folds") / F.col("expected_folds")})


def half_sample_means(values: DataFrame, draws: int, keys: list[str], value: str = "lift", order: str = "pair_id", seed: int = 0) -> DataFrame:
    """(keys, draw, mean) of half of the rows, rounded up and two at least, without replacement in hash order."""
    one = Window.partitionBy(*keys, "draw")
    rows = values.filter(F.col(value).isNotNull()).select(*keys, order, F.col(value).alias("_v")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    k = F.row_number().over(one.orderBy(draw_order(seed, "draw", F.lit("half"), order), order))
    rows = rows.withColumns({"_k": k, "_n": F.count("*").over(one)}).filter(F.col("_k") <= F.greatest(F.lit(2), F.ceil(F.col("_n") / 2)))
    return rows.groupBy(*keys, "draw").agg(F.avg("_v").alias("mean"))


# fixed values: what a stable lift needs of leave-one-out means, bootstrap means and half-sample means above zero
STABLE = {"leave_one_out": 0.90, "bootstrap": 0.95, "half_samples": 0.80}


def stability_audit(values: DataFrame, seeds: list[int], draws: int, keys: list[str], value: str = "lift", order: str = "pair_id") -> DataFrame:
    """Whether a positive mean lift survives other seeds, each pair left out and half of the pairs.

    ``stable``: a positive mean, and shares above zero of at least ``STABLE``, the least over seeds for draws;
    ``positive_but_composition_sensitive``: a positive mean without that; else ``not_stable``. Keys with fewer than two pairs
    have no audit: the verdict is null.
    """
    some = values.filter(F.col(value).isNotNull())
    runs = None
    for s in seeds:
        spread = bootstrap(some, draws, keys, value, order, s).select(*keys, F.col("p_positive").alias("_boot"), "ci_low", "ci_high")
        halves = half_sample_means(some, draws, keys, value, order, s).groupBy(*keys).agg(F.avg((F.col("mean") > 0).cast("double")).alias("_half"))
        flips = sign_flip(some, draws, keys, value, order, s).select(*keys, F.col("p_two_sided").alias("_flip"))
        one = spread.join(halves, keys).join(flips, keys).withColumn("seed", F.lit(s))
        runs = one if runs is None else runs.unionByName(one)
    by_seed = runs.groupBy(*keys).agg(F.min("_boot").alias("least_bootstrap_positive"), F.min("_half").alias("least_half_sample_positive"), F.max("_flip").alias("largest_sign_flip_p"), F.min("ci_low").alias("least_ci_low"), F.max("ci_high").alias("largest_ci_high"))
    v = F.col(value)
    whole = some.groupBy(*keys).agg(F.count("*").alias("pairs"), F.avg(v).alias("mean"), F.avg((v > 0).cast("double")).alias("positive_share"), F.avg((v >= 0).cast("double")).alias("nonnegative_share"))
    left = leave_one_out_means(some, keys, value, order).groupBy(*keys).agg(F.min("mean_without").alias("least_mean"), F.max("mean_without").alias("largest_mean"), F.avg((F.col("mean_without") > 0).cast("double")).alias("leave_one_out_positive"))
    good = (F.col("leave_one_out_positive") >= STABLE["leave_one_out"]) & (F.col("least_bootstrap_positive") >= STABLE["bootstrap"]) & (F.col("least_half_sample_positive") >= STABLE["half_samples"])
    verdict = F.when(F.col("pairs") < 2, None).when(F.col("mean") <= 0, "not_stable").when(good, "stable").otherwise("positive_but_composition_sensitive")
    return whole.join(left, keys).join(by_seed, keys).withColumn("verdict", verdict)


def method_contrasts(results: DataFrame, references: list[str], draws: int, keys: list[str] = (), pair: str = "pair_id", value: str = "pair_mean", seed: int = 0) -> DataFrame:
    """(keys, method, reference_method, ...): every other method less each reference, on pairs that have both: mean, interval, share of positive means and two-sided sign-flip p."""
    keys, out = [*keys], None
    for reference in references:
        ref = results.filter(F.col("method") == reference).select(*keys, pair, F.col(value).alias("_r"))
        joined = results.filter(F.col("method") != reference).join(ref, [*keys, pair]).withColumn("contrast", F.col(value) - F.col("_r")).filter(F.col("contrast").isNotNull())
        by = [*keys, "method"]
        one = bootstrap(joined, draws, by, "contrast", pair, seed).join(sign_flip(joined, draws, by, "contrast", pair, seed).select(*by, F.col("p_two_sided").alias("sign_flip_p")), by)
        one = one.withColumn("reference_method", F.lit(reference))
        out = one if out is None else out.unionByName(one)
    return out


def claim_gates(summary: DataFrame, pairs: int, least_mean: float = 0.015, level: float = 0.05) -> DataFrame:
    """Whether a claim's four gates are met."""
    gates = {"mean_gate": F.col("mean") >= least_mean, "interval_gate": F.col("ci_low") > 0, "p_gate": F.col("p_one_sided") < level, "size_gate": F.col("pairs") == pairs}
    return summary.withColumns(gates).withColumn("claim_supported", F.col("mean_gate") & F.col("interval_gate") & F.col("p_gate") & F.col("size_gate"))


def support_level(summary: DataFrame, level: str = "q", most_p: float = 0.05) -> DataFrame:
    """The level of largest lift that passes interval and exact p, ties to the broader, else 1.0."""
    good = (F.col("ci_low") > 0) & (F.col("p_one_sided") < most_p)
    best = F.max_by(F.when(good, F.col(level)), F.when(good, F.struct(F.col("mean"), F.col(level))))
    return summary.agg(F.coalesce(best, F.lit(1.0)).alias("support_level"))
