"""Environmental support: distance of cells to known prototypes under perturbation.

Prototypes are few: at most ``MAX_PROTOTYPES`` for each key, so cells meet their key's models and their distances are
computed in the row. Ranks are by range partitions and the counts before each, so no key, hot as it may be, is a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import complete_features, finite
from ..sources.scratch import materialise
from .joins import radius_join
from .pairs import distance_quantile
from .resampling import bottom_draws
from .windows import finite_rank, numbered, percent_rank_average

MAX_PROTOTYPES = 32
_MODEL = "world long, median array<double>, scale array<double>, prototypes array<array<double>>, ids array<long>, kernel double"


def prototype_models(prototypes: DataFrame, features: list[str], keys: list[str], ident: str = "row_id", leave_one_out: bool = False, min_kernel: float = 0.25) -> DataFrame:
    """One row per key, or per key and removed prototype (``world``): median, IQR scale, scaled prototypes, kernel scale.

    An IQR of at most 1e-9 counts as 1; the kernel scale is the median distance to the nearest other prototype, at
    least ``min_kernel``, and 1 for a single one. Everything is computed anew in each world. More than
    ``MAX_PROTOTYPES`` complete prototypes for a key are an error, so a group is bounded.
    """
    rows = complete_features(prototypes, features)
    rows = rows.select(*keys, F.col(ident).cast("long").alias("_id"), F.array(*[F.col(f).cast("double") for f in features]).alias("_f"))

    def model(world: int, ids: np.ndarray, x: np.ndarray) -> list:
        low, median, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
        scale = np.where(high - low > 1e-9, high - low, 1.0)
        z = (x - median) / scale
        kernel = 1.0
        if len(z) > 1:
            apart = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2)) + np.diag(np.full(len(z), np.inf))
            kernel = float(np.median(apart.min(axis=1)))
        return [world, median.tolist(), scale.tolist(), z.tolist(), ids.tolist(), max(kernel, min_kernel)]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_id")
        ids, x = group["_id"].to_numpy(), np.array(group["_f"].tolist(), float)
        if len(ids) > MAX_PROTOTYPES:
            raise ValueError(f"more than {MAX_PROTOTYPES} prototypes for a key")
        if leave_one_out and len(ids) < 2:
            raise ValueError("leave-one-out support needs two complete prototypes")
        worlds = [(int(ids[i]), np.arange(len(ids)) != i) for i in range(len(ids))] if leave_one_out else [(-1, np.ones(len(ids), bool))]
        out = [[*group[keys].iloc[0].tolist(), *model(w, ids[keep], x[keep])] for w, keep in worlds]
        return pd.DataFrame(out, columns=[*keys, "world", "median", "scale", "prototypes", "ids", "kernel"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name in keys)
    grouped = rows.groupBy(*keys) if keys else rows.groupBy(F.lit("all"))
    return grouped.applyInPandas(fit, kinds + _MODEL)


def scaled(features: list[str]) -> Column:
    values = F.array(*[F.col(f).cast("double") for f in features])
    return F.zip_with(F.zip_with(values, "median", lambda x, m: x - m), "scale", lambda x, s: x / s)


def distances(features: list[str]) -> Column:
    """Distances to all prototypes of the joined model (J12): in the row, without a shuffle."""
    return F.transform("prototypes", lambda p: F.sqrt(F.aggregate(F.zip_with("_z", p, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)))


def with_distances(universe: DataFrame, models: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Every cell with every model of its key: ``_d`` the distances, null for cells with a missing feature."""
    complete = F.lit(True)
    for f in features:
        complete = complete & F.coalesce(finite(f), F.lit(False))
    # models are bounded by MAX_PROTOTYPES squared rows for a key: with keys, their written size says whether they are sent out
    joined = universe.join(materialise(models, "models"), keys) if keys else universe.crossJoin(F.broadcast(models))
    return joined.withColumn("_z", scaled(features)).withColumn("_d", F.when(complete, distances(features))).drop("_z")


def geometry(universe: DataFrame, prototypes: DataFrame, features: list[str], keys: list[str], ident: str = "row_id") -> DataFrame:
    """Nearest distance (infinite for incomplete cells), its average-tie percentile rank among all cells, responsibilities of prototypes."""
    joined = with_distances(universe, prototype_models(prototypes, features, keys, ident), features, keys)
    out = joined.withColumns({
        "nearest": F.coalesce(F.array_min("_d"), F.lit(float("inf"))),
        "responsibility": F.coalesce(F.transform("_d", lambda d: F.exp(-0.5 * (d / F.col("kernel")) * (d / F.col("kernel")))), F.transform("prototypes", lambda _: F.lit(0.0))),
    })
    return percent_rank_average(out.drop("_d", "median", "scale", "prototypes", "world"), "nearest", keys, "support_rank", True)


def consensus(universe: DataFrame, prototypes: DataFrame, features: list[str], keys: list[str], cell: str = "row_id", ident: str = "row_id") -> DataFrame:
    """(keys, cell, consensus float, uncertainty float): median and population deviation of single-precision ranks over leave-one-out worlds."""
    models = prototype_models(prototypes, features, keys, ident, leave_one_out=True)
    cells = universe.select(*keys, cell, *features)
    worlds = with_distances(cells, models, features, keys).select(*keys, cell, "world", F.coalesce(F.array_min("_d"), F.lit(float("inf"))).alias("nearest"))
    ranked = percent_rank_average(worlds, "nearest", [*keys, "world"], "r", True).withColumn("r", F.col("r").cast("float"))
    return ranked.groupBy(*keys, cell).agg(F.percentile("r", F.lit(0.5)).cast("float").alias("consensus"), F.stddev_pop("r").alias("uncertainty"))


def consensus_audit(prototypes: DataFrame, features: list[str], keys: list[str], ident: str = "row_id") -> DataFrame:
    """Prototypes, worlds and the range of kernel scales of each key."""
    worlds = prototype_models(prototypes, features, keys, ident, leave_one_out=True)
    return worlds.groupBy(*keys).agg(F.count("*").alias("leave_one_out_worlds"), F.min("kernel").alias("kernel_scale_min"), F.max("kernel").alias("kernel_scale_max")).withColumn("features", F.lit(";".join(features)))


def support_cells(universe: DataFrame, ranks: DataFrame, threshold: float, tolerance: float = 0.0, keys: list[str] = (), cell: str = "row_id", rank: str = "consensus") -> DataFrame:
    """Cells of finite rank at most the threshold, compared in double precision after the single-precision rank."""
    joined = universe.join(ranks, [*keys, cell])
    keep = finite(rank) & (F.col(rank).cast("double") <= F.lit(threshold + tolerance))
    return joined.filter(keep).withColumns({"site_id": F.col(cell).cast("string"), "ecological_support_rank": F.col(rank).cast("double"), "priority_score": 1.0 - F.col(rank).cast("double")})


def finite_geometry(universe: DataFrame, prototypes: DataFrame, features: list[str], keys: list[str], ident: str = "row_id", k: int = 1) -> DataFrame:
    """Finite-only ranks of the mean of the k nearest distances (E4; k > 1: E7)."""
    joined = with_distances(universe, prototype_models(prototypes, features, keys, ident), features, keys)
    near = F.slice(F.array_sort("_d"), 1, k)
    mean = F.aggregate(near, F.lit(0.0), lambda s, d: s + d) / F.size(near)
    out = joined.withColumn("nearest", F.coalesce(F.when(F.size("_d") > 0, mean), F.lit(float("inf")))).drop("_d", "median", "scale", "prototypes", "ids", "kernel", "world")
    return finite_rank(out, "nearest", keys, "support_rank", True)


def persistent_support(universe: DataFrame, prototypes: DataFrame, features: list[str], keys: list[str], ident: str = "row_id") -> DataFrame:
    """Second-nearest distance, the mean of the nearest two, and their finite-only ranks (E5)."""
    joined = with_distances(universe, prototype_models(prototypes, features, keys, ident), features, keys)
    two = F.slice(F.array_sort("_d"), 1, 2)
    out = joined.withColumns({"second_nearest": F.coalesce(F.element_at(two, -1), F.lit(float("inf"))), "mean_two": F.coalesce((F.element_at(two, 1) + F.element_at(two, -1)) / 2, F.lit(float("inf")))})
    out = out.drop("_d", "median", "scale", "prototypes", "ids", "kernel", "world")
    return finite_rank(finite_rank(out, "second_nearest", keys, "second_rank", True), "mean_two", keys, "mean_two_rank", True)


def local_scale(universe: DataFrame, prototypes: DataFrame, features: list[str], keys: list[str], k: int, threshold: float, ident: str = "row_id", cell: str = "row_id") -> DataFrame:
    """As many cells of the least k-nearest mean as the nearest-prototype rule selects at the threshold."""
    one = finite_geometry(universe, prototypes, features, keys, ident, 1)
    target = one.filter(F.col("support_rank") <= threshold).groupBy(*keys).agg(F.count("*").alias("_t"))
    many = finite_geometry(universe, prototypes, features, keys, ident, k)
    ranked = numbered(many, ["nearest", cell], "_k", keys)
    return (ranked.join(target, keys) if keys else ranked.crossJoin(F.broadcast(target))).filter(F.col("_k") <= F.col("_t")).drop("_k", "_t")


def multi_view(views: dict[str, DataFrame], keys: list[str], target: DataFrame, cell: str = "row_id") -> DataFrame:
    """For each view (keys, cell, support_rank) its best cells up to the target area ``target_cells`` of the key."""
    out = None
    for name, view in views.items():
        best = numbered(view, ["support_rank", cell], "_k", keys).join(target, keys).filter(F.col("_k") <= F.col("target_cells")).select(*keys, cell, F.lit(name).alias("view"))
        out = best if out is None else out.unionByName(best)
    return out


def _spanning_edges(apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, length) of a minimum spanning tree of a matrix of distances: pairs from the shortest on that join two groups."""
    group = np.arange(len(apart))
    a, b = np.triu_indices(len(apart), 1)
    joins = []
    for pair in np.argsort(apart[a, b], kind="stable"):
        one, other = group[a[pair]], group[b[pair]]
        if one != other:
            group[group == other] = one
            joins.append(pair)
    return a[joins], b[joins], apart[a[joins], b[joins]]


def _long_above(lengths: np.ndarray, deviations: float) -> float:
    """The length above which an edge is long: median + ``deviations`` x 1.4826 MAD, or halfway to the least edge clearly above the median."""
    if len(lengths) < 2:
        return np.inf
    middle = np.median(lengths)
    spread = np.median(np.abs(lengths - middle))
    if spread > 0:
        return float(middle + deviations * 1.4826 * spread)
    above = lengths[lengths - middle > max(1e-12, 1e-9 * middle)]
    return float((middle + above.min()) / 2) if len(above) else np.inf


def environmental_modes(prototypes: DataFrame, features: list[str], keys: list[str], ident: str = "row_id", deviations: float = 3.0) -> DataFrame:
    """(keys, id, mode, gap): components of the minimum spanning tree in scaled space after its long edges are cut.

    Among edges of positive length, one is long above median + 3 x 1.4826 MAD; with a MAD of zero, above the middle of
    the median and the least clearly longer edge. ``gap`` is the longest edge over the median one, 1 without edges.
    Modes are numbered from 0 by their first prototype.
    """
    models = prototype_models(prototypes, features, keys, ident)

    def split(group: pd.DataFrame) -> pd.DataFrame:
        row = group.iloc[0]
        z, ids = np.array([list(p) for p in row["prototypes"]]), np.array(row["ids"])
        one, other, lengths = _spanning_edges(np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2)))
        positive = lengths[lengths > 0]
        short = lengths <= _long_above(positive, deviations)
        mode = np.arange(len(z))
        for a, b in zip(one[short], other[short]):
            mode[mode == max(mode[a], mode[b])] = min(mode[a], mode[b])
        gap = float(positive.max() / np.median(positive)) if len(positive) else 1.0
        return pd.DataFrame([[*group[keys].iloc[0].tolist(), int(i), int(m), gap] for i, m in zip(ids, np.unique(mode, return_inverse=True)[1])], columns=[*keys, ident, "mode", "gap"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in models.schema.fields if f.name in keys)
    return (models.groupBy(*keys) if keys else models.groupBy(F.lit("all"))).applyInPandas(split, f"{kinds}{ident} long, mode int, gap double")


#: Cells of a key that modes may take in turn at most.
BALANCED = 200_000


def mode_balanced(universe: DataFrame, prototypes: DataFrame, features: list[str], keys: list[str], threshold: float, ident: str = "row_id", cell: str = "row_id") -> DataFrame:
    """(keys, cell, mode, selection_rank): modes take in turn their nearest cell that none took, until as many are taken as the plain mask has.

    The plain mask is that of ranks of at most ``threshold``; with one mode it is the result. No mode looks further down
    its order than the target, so each key's group is modes x target rows; a target above ``BALANCED`` is an error.
    """
    modes = environmental_modes(prototypes, features, keys, ident).select(*keys, F.col(ident).alias("_pid"), "mode")
    plain = finite_geometry(universe, prototypes, features, keys, ident).filter(F.col("support_rank") <= threshold + 1e-12)
    target = materialise(plain.groupBy(*keys).agg(F.count("*").alias("_t")), "modes-target")
    if not target.filter(F.col("_t") > BALANCED).isEmpty():
        raise ValueError(f"modes would take more than {BALANCED} cells of a key")
    joined = with_distances(universe, prototype_models(prototypes, features, keys, ident), features, keys).filter("_d is not null")
    flat = joined.select(*keys, cell, F.explode(F.arrays_zip(F.col("ids").alias("i"), F.col("_d").alias("d"))).alias("_x"))
    flat = flat.select(*keys, cell, F.col("_x.i").alias("_pid"), F.col("_x.d").alias("_dist")).join(modes, [*keys, "_pid"])
    by_mode = flat.groupBy(*keys, cell, "mode").agg(F.min("_dist").alias("_dist"))
    placed = numbered(by_mode, ["_dist", cell], "_place", [*keys, "mode"])
    placed = (placed.join(target, keys) if keys else placed.crossJoin(F.broadcast(target))).filter(F.col("_place") <= F.col("_t"))
    kinds = dict(placed.dtypes)

    def turns(group: pd.DataFrame) -> pd.DataFrame:
        total = int(group["_t"].iloc[0])
        queues = {m: iter(rows.sort_values("_place")[cell].tolist()) for m, rows in sorted(group.groupby("mode"))}
        taken: dict = {}
        while len(taken) < total and queues:
            for m in list(queues):
                own = next((c for c in queues[m] if c not in taken), None)
                if own is None:
                    del queues[m]
                    continue
                taken[own] = m
                if len(taken) == total:
                    break
        head = group[keys].iloc[0].tolist()
        return pd.DataFrame([[*head, c, m, i + 1] for i, (c, m) in enumerate(taken.items())], columns=[*keys, cell, "mode", "selection_rank"])

    schema = "".join(f"{c} {kinds[c]}, " for c in [*keys, cell]) + "mode int, selection_rank int"
    return (placed.groupBy(*keys) if keys else placed.groupBy(F.lit("all"))).applyInPandas(turns, schema)


#: Restarts of the mode search, and its rounds at most.
STARTS, LLOYD = 50, 300


def _k_means(z: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres of least total squared distance over ``STARTS`` runs from far-apart first centres."""
    best, least = None, np.inf
    for run in range(STARTS):
        rng = np.random.default_rng((seed, k, run))
        centres = z[[rng.integers(len(z))]]
        while len(centres) < k:
            d = ((z[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
            p = d / d.sum() if d.sum() > 0 else np.full(len(z), 1 / len(z))
            centres = np.vstack([centres, z[rng.choice(len(z), p=p)]])
        for _ in range(LLOYD):
            own = ((z[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([z[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(k)])
            if np.array_equal(new, centres):
                break
            centres = new
        inertia = ((z[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()
        if inertia < least - 1e-12:
            best, least = centres, inertia
    return best[np.lexsort(best.T[::-1])]


def mode_centres(prototypes: DataFrame, features: list[str], keys: list[str], ident: str = "row_id", most: int = 6, seed: int = 0) -> DataFrame:
    """(keys, k, median, scale, centroids, medoids) of the k-means modes of each key's scaled prototypes, k = 2 .. min(most, prototypes - 1).

    A medoid is the prototype nearest to its centroid (ties: the smaller id). Prototypes are at most ``MAX_PROTOTYPES``.
    """
    models = prototype_models(prototypes, features, keys, ident)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        row = group.iloc[0]
        z, out = np.array([list(p) for p in row["prototypes"]]), []
        for k in range(2, min(most, len(z) - 1) + 1):
            centres = _k_means(z, k, seed)
            medoids = z[((z[None] - centres[:, None]) ** 2).sum(axis=2).argmin(axis=1)]
            out.append([*group[keys].iloc[0].tolist(), k, list(row["median"]), list(row["scale"]), centres.tolist(), medoids.tolist()])
        return pd.DataFrame(out, columns=[*keys, "k", "median", "scale", "centroids", "medoids"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in models.schema.fields if f.name in keys)
    schema = kinds + "k int, median array<double>, scale array<double>, centroids array<array<double>>, medoids array<array<double>>"
    return (models.groupBy(*keys) if keys else models.groupBy(F.lit("all"))).applyInPandas(fit, schema)


def mode_distances(universe: DataFrame, centres: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Every cell with each k's distance to the nearest centroid and to the nearest medoid, infinite for incomplete cells."""
    out = None
    for kind in ("centroids", "medoids"):
        models = centres.select(*keys, "k", "median", "scale", F.col(kind).alias("prototypes"))
        base = universe if out is None else out
        if out is None:
            joined = with_distances(base, models, features, keys)
        else:
            joined = base.join(materialise(models, "models"), [*keys, "k"]).withColumn("_z", scaled(features)).withColumn("_d", F.when(F.col("kmeans_centroid_distance") < float("inf"), distances(features))).drop("_z")
        name = "kmeans_centroid_distance" if kind == "centroids" else "kmeans_medoid_distance"
        out = joined.withColumn(name, F.coalesce(F.array_min("_d"), F.lit(float("inf")))).drop("_d", "median", "scale", "prototypes")
    return out


def prototype_quota(universe: DataFrame, prototypes: DataFrame, features: list[str], keys: list[str], quota: int, ident: str = "row_id", cell: str = "row_id") -> DataFrame:
    """Union of each prototype's ``quota`` cells of highest responsibility."""
    joined = geometry(universe, prototypes, features, keys, ident)
    flat = joined.select(*keys, cell, F.explode(F.arrays_zip(F.col("ids").alias("i"), F.col("responsibility").alias("r"))).alias("_x")).select(*keys, cell, "_x.i", "_x.r")
    k = F.row_number().over(Window.partitionBy(*keys, "i").orderBy(F.desc("r"), cell))  # a limit for each prototype, taken in each task first
    return flat.withColumn("_k", k).filter(F.col("_k") <= quota).groupBy(*keys, cell).agg(F.count("*").alias("prototypes"))


def perturbations(prototypes: DataFrame, keys: list[str], draws: int, share: float = 0.2, seed: int = 0, ident: str = "row_id") -> DataFrame:
    """(keys, world, removed array): nothing removed, each one removed, and distinct draws of a share, hash-ordered."""
    ids = prototypes.select(*keys, ident).distinct()
    whole = ids.select(*keys).distinct().select(*keys, F.lit("canonical").alias("world"), F.array().cast("array<long>").alias("removed"))
    one = ids.select(*keys, F.concat(F.lit("without "), F.col(ident).cast("string")).alias("world"), F.array(F.col(ident).cast("long")).alias("removed"))
    n = F.count("*").over(Window.partitionBy(*keys, "draw"))
    drawn = ids.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    k = F.row_number().over(Window.partitionBy(*keys, "draw").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "draw", ident)), ident))
    drawn = drawn.withColumns({"_k": k, "_n": n}).filter(F.col("_k") <= F.greatest(F.lit(1), F.bround(F.col("_n") * share))).groupBy(*keys, "draw").agg(F.array_sort(F.collect_list(F.col(ident).cast("long"))).alias("removed"))
    drawn = drawn.groupBy(*keys, "removed").agg(F.min("draw").alias("draw")).select(*keys, F.concat(F.lit("draw "), F.col("draw").cast("string")).alias("world"), "removed")
    return whole.unionByName(one).unionByName(drawn)


def adaptive_levels(universe: DataFrame, prototypes: DataFrame, features: list[str], keys: list[str], levels: list[float], target: float, ident: str = "row_id", cell: str = "row_id") -> DataFrame:
    """(keys, level, recovery, median_jaccard, support_quantile): how well each level holds when one prototype is left out.

    A left-out prototype's rank is that of its distance, in the world without it, among the key's complete cells and itself,
    ties averaged; with fewer than three prototypes left it is 1, as all cells' ranks are. ``recovery`` is the share of
    prototypes of rank at most the level, ``median_jaccard`` the median over worlds of the overlap of their mask with that of
    all prototypes (1 for two empty masks). ``support_quantile`` is the smallest level with a recovery of at least
    ``target``, 1 if none has it. Levels are met within 1e-12.
    """
    worlds_of = prototype_models(prototypes, features, keys, ident, leave_one_out=True)
    few = F.size("prototypes") < 3
    full = with_distances(universe.select(*keys, cell, *features), prototype_models(prototypes, features, keys, ident), features, keys)
    full = full.select(*keys, cell, few.alias("_few"), F.coalesce(F.array_min("_d"), F.lit(float("inf"))).alias("_near"))
    full = finite_rank(full, "_near", keys, "_full", True).select(*keys, cell, F.when(F.col("_few"), 1.0).otherwise(F.col("_full")).alias("_full"))
    worlds = with_distances(universe.select(*keys, cell, *features), worlds_of, features, keys)
    worlds = worlds.select(*keys, cell, "world", few.alias("_few"), F.coalesce(F.array_min("_d"), F.lit(float("inf"))).alias("_near"))
    worlds = materialise(finite_rank(worlds, "_near", [*keys, "world"], "_r", True).withColumn("_r", F.when(F.col("_few"), 1.0).otherwise(F.col("_r"))), "adaptive")
    left_out = with_distances(complete_features(prototypes, features).select(*keys, F.col(ident).cast("long").alias("_out"), *features), worlds_of, features, keys)
    left_out = left_out.filter("_out = world").select(*keys, "world", F.array_min("_d").alias("_own"))
    # average rank of one more value among the finite ones: those below, and half of the ties and itself
    below, ties, n = F.count_if(F.col("_near") < F.col("_own")), F.count_if(F.col("_near") == F.col("_own")), F.count_if(F.col("_near") < float("inf"))
    own = worlds.join(left_out, [*keys, "world"]).groupBy(*keys, "world").agg(F.when(F.first("_few") | (n == 0), 1.0).otherwise((below + (ties + 2) / 2) / (n + 1)).alias("_rank"))
    at = F.explode(F.array(*[F.lit(float(q)) for q in levels])).alias("level")
    recovery = own.select(*keys, "_rank", at).groupBy(*keys, "level").agg(F.avg((F.col("_rank") <= F.col("level") + 1e-12).cast("double")).alias("recovery"))
    both = worlds.join(full, [*keys, cell]).select(*keys, "world", "_r", "_full", at)
    inside, whole = F.col("_r") <= F.col("level") + 1e-12, F.col("_full") <= F.col("level") + 1e-12
    share = F.when(F.count_if(inside | whole) > 0, F.count_if(inside & whole) / F.count_if(inside | whole)).otherwise(1.0)
    overlap = both.groupBy(*keys, "level", "world").agg(share.alias("_j")).groupBy(*keys, "level").agg(F.percentile("_j", F.lit(0.5)).alias("median_jaccard"))
    chosen = F.coalesce(F.min(F.when(F.col("recovery") >= target, F.col("level"))).over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))), F.lit(1.0))
    return recovery.join(overlap, [*keys, "level"]).withColumn("support_quantile", chosen)  # a window over a key's levels


def survey_gap(rows: DataFrame, area: str, distance: str = "nearest_training_km") -> DataFrame:
    """``gap``: distance to the nearest training point over the area's own 95th percentile, 1e-6 at least, within 0 to 1.

    Rows without a finite distance, so all of an area without training points, have the largest gap, 1.
    """
    known = F.when(finite(distance), F.col(distance))
    top = rows.groupBy(area).agg(F.percentile(known, F.lit(0.95)).alias("_p"))
    share = known / F.greatest(F.col("_p"), F.lit(1e-6))
    return rows.join(top, area).withColumn("gap", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), F.lit(1.0))).drop("_p")


def spatial_scale(points: DataFrame, keys: list[str], ident: str = "row_id", floor_km: float = 0.25) -> DataFrame:
    """(keys, spatial_scale_km): the 90th percentile of the distances of a key's pairs, ``floor_km`` at least; 1 for a single point.

    The percentile is of all pairs by definition: see ``distance_quantile``.
    """
    at = distance_quantile(points, keys, ident, 0.9)
    n = points.groupBy(*keys).agg(F.count("*").alias("_n"))
    whole = n.join(at, keys, "left") if keys else n.join(F.broadcast(at), F.lit(True), "left")
    return whole.select(*keys, F.when(F.col("_n") <= 1, 1.0).otherwise(F.greatest(F.lit(floor_km), F.col("q0") / 1000.0)).alias("spatial_scale_km"))


def tier_masks(ranks: DataFrame, thresholds: list[float], rank: str = "consensus") -> DataFrame:
    """Every cell once for each threshold that it meets."""
    return ranks.withColumn("support_tier", F.explode(F.array(*map(F.lit, thresholds)))).filter(F.col(rank).cast("double") <= F.col("support_tier"))


def tier_evaluation(ranks: DataFrame, cells: DataFrame, detections: DataFrame, thresholds: list[float], radii_km: list[float], area: str, draws: int, seed: int = 0, rank: str = "consensus", cell: str = "row_id", detection_id: str = "detection_cluster_id") -> DataFrame:
    """Recall of each area's detections by each tier's cells at each radius, and of as many random cells of the area.

    ``cells`` and ``detections`` have the area, their id and coordinates. A detection is recovered by a cell of its area
    within the radius; areas without cells in a tier stay with recall 0.
    """
    by = [area, "support_tier", "radius_km"]
    tiers = materialise(tier_masks(ranks.join(cells.select(cell, area), cell), thresholds, rank).select(area, cell, "support_tier"), "tiers")
    near = radius_join(detections.select(area, detection_id, "latitude", "longitude"), cells.select(area, F.col(cell).alias("_cell_id"), "latitude", "longitude"), max(radii_km) * 1000.0, [area], left_id=detection_id, right_id="_cell_id")
    near = near.select(area, detection_id, F.col("_cell_id").alias(cell), "distance_m", F.explode(F.array(*[F.lit(float(r)) for r in radii_km])).alias("radius_km")).filter(F.col("distance_m") <= F.col("radius_km") * 1000.0)
    near = materialise(near.drop("distance_m"), "tiers-near")
    seen = tiers.join(near, [area, cell]).groupBy(*by).agg(F.countDistinct(detection_id).alias("n_recovered"))
    declared = detections.groupBy(area).agg(F.countDistinct(detection_id).alias("n_detections"))
    out = tier_recovery(declared, seen, thresholds, [float(r) for r in radii_km], [area])
    quota = tiers.groupBy(area, "support_tier").agg(F.count("*").alias("_quota"))
    largest = quota.groupBy(area).agg(F.max("_quota").alias("_most"))
    drawn = bottom_draws(cells, largest, draws, [area], cell, seed, "_most").drop("_most").join(quota, area).filter(F.col("_k") <= F.col("_quota"))
    got = drawn.join(near, [area, cell]).groupBy(*by, "draw").agg(F.countDistinct(detection_id).alias("_got"))
    chance = got.groupBy(*by).agg(F.sum("_got").alias("_sum"))
    out = out.join(chance, by, "left").withColumn("random_recall", F.coalesce(F.col("_sum") / (F.col("n_detections") * draws), F.lit(0.0))).drop("_sum")
    return out.withColumns({"n_recovered": F.coalesce("n_recovered", F.lit(0).cast("long")), "lift": F.col("recall") - F.col("random_recall")})


def tier_recovery(declared: DataFrame, recovered: DataFrame, thresholds: list[float], radii: list[float], keys: list[str]) -> DataFrame:
    """Recall of each declared key, tier and radius, 0 where nothing came back.

    ``declared``: keys, n_detections; ``recovered``: keys, support_tier, radius_km, n_recovered.
    """
    frame = declared.withColumn("support_tier", F.explode(F.array(*map(F.lit, thresholds)))).withColumn("radius_km", F.explode(F.array(*map(F.lit, radii))))
    joined = frame.join(recovered, [*keys, "support_tier", "radius_km"], "left")
    return joined.withColumn("recall", F.coalesce(F.col("n_recovered") / F.col("n_detections"), F.lit(0.0)))
