"""Ranks, strata and focal windows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import finite
from ..sources.scratch import materialise


def percent_rank_average(df: DataFrame, value: str, keys: list[str], out: str = "rank", distributed: bool = False) -> DataFrame:
    """Average rank of ties over the number of rows.

    With many keys a window does it. ``distributed`` is for keys with more rows than a task can sort: equal values are
    counted first, the distinct ones are range-partitioned, and each partition starts from the counts before it.
    """
    if not distributed:
        one = Window.partitionBy(*keys)
        least = F.rank().over(one.orderBy(value))
        ties = F.count("*").over(Window.partitionBy(*keys, value))
        return df.withColumn(out, (least + (ties - 1) / 2) / F.count("*").over(one))
    return df.join(_distinct_ranks(df, value, keys, out), [*keys, value])


def _distinct_ranks(df: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    """(keys, value, rank) of distinct values, by range partitions and the counts before each."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_m"))
    dealt = counts.repartitionByRange(*[F.col(k) for k in keys], F.col(value)).withColumn("_p", F.spark_partition_id())
    dealt = materialise(dealt, "rank")
    totals = dealt.groupBy(*keys, "_p").agg(F.sum("_m").alias("_t"))
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    totals = totals.withColumns({"_base": F.coalesce(F.sum("_t").over(by_key.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("_t").over(by_key)}).drop("_t")
    inner = Window.partitionBy(*keys, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.join(totals, [*keys, "_p"]).withColumn("_upto", F.col("_base") + F.sum("_m").over(inner))
    ranked = ranked.select(*keys, value, ((F.col("_upto") - (F.col("_m") - 1) / 2) / F.col("_n")).alias(out))
    return materialise(ranked, "ranks")


def finite_rank(df: DataFrame, value: str, keys: list[str], out: str = "rank", distributed: bool = False) -> DataFrame:
    """Percentile rank among finite values only; all others get 1 (E4). ``distributed`` as in ``percent_rank_average``."""
    marked = df.withColumn("_g", F.coalesce(finite(value), F.lit(False)))
    if distributed:
        good = marked.filter("_g").drop("_g")
        ranked = good.join(_distinct_ranks(good, value, keys, out), [*keys, value])
        return ranked.select(*df.columns, out).unionByName(marked.filter("not _g").drop("_g").withColumn(out, F.lit(1.0)))
    one = Window.partitionBy(*keys, "_g")
    ties = F.count("*").over(Window.partitionBy(*keys, "_g", value))
    rank = (F.rank().over(one.orderBy(value)) + (ties - 1) / 2) / F.count("*").over(one)
    return marked.withColumn(out, F.when(F.col("_g"), rank).otherwise(1.0)).drop("_g")


def numbered(df: DataFrame, order: list[str], out: str, keys: list[str] = ()) -> DataFrame:
    """1, 2, 3, ... within keys, or over the whole table, by range partitions and the counts before each; only these counts are in one task."""
    keys = [*keys]
    dealt = materialise(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()), "numbered")
    totals = dealt.groupBy(*keys, "_p").agg(F.count("*").alias("_t"))
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = by_key.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order))
    return dealt.join(totals, [*keys, "_p"]).withColumn(out, F.col("_base") + inside).drop("_p", "_base")


def placed_quantiles(df: DataFrame, value: str, keys: list[str], shares: list[float]) -> DataFrame:
    """(keys, q0, q1, ...): linear quantiles of a value that has too many rows for one task: they are numbered by range partitions and read by place."""
    keys = [*keys]
    rows = numbered(df.select(*keys, F.col(value).alias("_v")), ["_v"], "_k", keys)
    n = rows.groupBy(*keys).agg(F.max("_k").alias("_n"))
    rows = rows.join(n, keys) if keys else rows.crossJoin(F.broadcast(n))
    out = []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("_n") - 1)
        part = at - F.floor(at)
        weight = F.when(F.col("_k") - 1 == F.floor(at), 1 - part).when(F.col("_k") - 2 == F.floor(at), part)
        out.append(F.sum(weight * F.col("_v")).alias(f"q{i}"))
    return rows.groupBy(*keys).agg(*out)


def spearman(df: DataFrame, a: str, b: str, keys: list[str], least: int = 3) -> DataFrame:
    """Pearson of average ranks; null with fewer than ``least`` pairs or without variation."""
    df = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = percent_rank_average(percent_rank_average(df, a, keys, "_a"), b, keys, "_b")
    varied = (F.count("*") >= least) & (F.stddev_pop("_a") > 1e-12) & (F.stddev_pop("_b") > 1e-12)
    return both.groupBy(*keys).agg(F.when(varied, F.corr("_a", "_b")).alias("spearman"), F.count("*").alias("pairs"))


def quantile_strata(df: DataFrame, value: str, bins: int, keys: list[str], order: str = "row_id", out: str = "stratum") -> DataFrame:
    """Right-closed equal-count bins, from 0, of ranks in which the first row wins ties."""
    w = Window.partitionBy(*keys)
    k = F.row_number().over(w.orderBy(value, order))
    n = F.count("*").over(w)
    # edges lie at 1 + q (n - 1) for q = 1/bins, 2/bins, ...
    place = F.ceil((k - 1) * bins / F.greatest(n - 1, F.lit(1)) - 1e-9)
    return df.withColumn(out, F.greatest(place - 1, F.lit(0)).cast("int"))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def sequence_rank(df: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    """1, 2, 3, ... within keys."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def _edge_weighted(df: DataFrame, across: list[str], along: str, half: int, columns: list[str]) -> DataFrame:
    """Box sums of ``columns`` along one axis; cells beyond an edge repeat the edge cell."""
    w = Window.partitionBy(*across).orderBy(along)
    box = w.rangeBetween(-half, half)
    ends = Window.partitionBy(*across)
    lo, hi = F.min(along).over(ends), F.max(along).over(ends)
    before, after = F.greatest(F.lit(0), F.lit(half) - (F.col(along) - lo)), F.greatest(F.lit(0), F.lit(half) - (hi - F.col(along)))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({c: F.sum(c).over(box) + before * F.first(c).over(whole) + after * F.last(c).over(whole) for c in columns})


def focal(df: DataFrame, value: str, size: int, area: str = "area", out: str = "focal") -> DataFrame:
    """Mean and population deviation of the present values in a square of ``size`` cells, edges repeated.

    Cells are (area, r, c); the box sums run along columns, then along rows, on a full grid whose missing values are null.
    """
    if size % 2 == 0 or size < 1:
        raise ValueError("size must be odd")
    half = size // 2
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v), v)
    work = df.withColumns({"_v": F.coalesce(v, F.lit(0.0)), "_v2": F.coalesce(v * v, F.lit(0.0)), "_n": v.isNotNull().cast("double")})
    sums = ["_v", "_v2", "_n"]
    work = _edge_weighted(_edge_weighted(work, [area, "r"], "c", half, sums), [area, "c"], "r", half, sums)
    mean = F.when(F.col("_n") > 0, F.col("_v") / F.col("_n"))
    spread = F.when(F.col("_n") > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("_v2") / F.col("_n") - mean * mean)))
    return work.withColumns({f"{out}_mean": mean, f"{out}_sd": spread}).drop(*sums)


def terrain(df: DataFrame, height: str, size: float, area: str = "area") -> DataFrame:
    """Gradient by central, at edges one-sided, differences; slope and aspect in degrees; relative height and roughness of 3 by 3 cells."""

    def slope_along(across: list[str], along: str):
        w = Window.partitionBy(*across).orderBy(along)
        a, b, h = F.lag(height).over(w), F.lead(height).over(w), F.col(height)
        return F.when(a.isNotNull() & b.isNotNull(), (b - a) / (2 * size)).when(b.isNotNull(), (b - h) / size).when(a.isNotNull(), (h - a) / size)

    out = df.withColumns({"dz_dx": slope_along([area, "r"], "c"), "dz_dy": slope_along([area, "c"], "r")})
    steep = F.degrees(F.atan(F.sqrt(F.col("dz_dx") ** 2 + F.col("dz_dy") ** 2)))
    facing = F.pmod(F.degrees(F.atan2(-F.col("dz_dx"), F.col("dz_dy"))), F.lit(360.0))
    out = focal(out.withColumns({"slope": steep, "aspect": facing}), height, 3, area, "_h")
    return out.withColumns({"relative_height": F.col(height) - F.col("_h_mean"), "roughness": F.col("_h_sd")}).drop("_h_mean", "_h_sd")


def solar_proxy(df: DataFrame, slope: str = "slope", aspect: str = "aspect", suns=((90, 20), (135, 45), (180, 60), (225, 45), (270, 20))) -> DataFrame:
    """Surface normals and the mean cosine of incidence over sun positions (azimuth, height) in degrees."""
    s, a = F.radians(slope), F.radians(aspect)
    nx, ny, nz = F.sin(s) * F.sin(a), F.sin(s) * F.cos(a), F.cos(s)
    total = F.lit(0.0)
    for azimuth, height in suns:
        az, h = math.radians(azimuth), math.radians(height)
        total = total + F.greatest(F.lit(0.0), nx * (math.cos(h) * math.sin(az)) + ny * (math.cos(h) * math.cos(az)) + nz * math.sin(h))
    return df.withColumns({"normal_x": nx, "normal_y": ny, "normal_z": nz, "solar": total / len(suns)})


def class_boundary(df: DataFrame, kind: str, area: str = "area") -> DataFrame:
    """Whether any of the four neighbours is of another class."""
    rows, columns = Window.partitionBy(area, "r").orderBy("c"), Window.partitionBy(area, "c").orderBy("r")
    differs = F.lit(False)
    for w in (rows, columns):
        for step in (F.lag(kind).over(w), F.lead(kind).over(w)):
            differs = differs | F.coalesce(step != F.col(kind), F.lit(False))
    return df.withColumn("boundary", differs)


def scale_contrast(df: DataFrame, value: str, small: int, large: int, area: str = "area") -> DataFrame:
    """Small-window mean less large-window mean."""
    out = focal(focal(df, value, small, area, "_s"), value, large, area, "_l")
    return out.withColumn("contrast", F.col("_s_mean") - F.col("_l_mean")).drop("_s_mean", "_s_sd", "_l_mean", "_l_sd")


def amplitude(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """90th less 10th percentile."""
    p = F.percentile(value, F.array(F.lit(0.1), F.lit(0.9)))
    return df.groupBy(*keys).agg((p[1] - p[0]).alias("amplitude"))


def class_mix(df: DataFrame, kind: str, classes: list, size: int, area: str = "area") -> DataFrame:
    """Share of each class in the window, normalised entropy and 1 - sum of squared shares."""
    shares = []
    for c in classes:
        df = focal(df.withColumn("_is", (F.col(kind) == c).cast("double")), "_is", size, area, f"_k{c}").drop("_is", f"_k{c}_sd").withColumnRenamed(f"_k{c}_mean", f"share_{c}")
        shares.append(F.coalesce(F.col(f"share_{c}"), F.lit(0.0)))
    entropy = sum((F.when(p > 0, -p * F.log(p)).otherwise(0.0) for p in shares), F.lit(0.0)) / math.log(max(2, len(classes)))
    return df.withColumns({"entropy": entropy, "simpson": F.lit(1.0) - sum((p * p for p in shares), F.lit(0.0))})
