"""Evidence scores, roles, constraints and small decisions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geo import finite

# fixed values: component weights, and the columns that can stand for each component
WEIGHTS = {"observed": 0.35, "local_habitat": 0.25, "macro_model": 0.15, "survey_gap": 0.10, "access": 0.10, "field_validation": 0.05}
SOURCES = {
    "observed": ["observed_base_priority_score", "occurrence_support_score", "observed_species_richness", "species_richness", "record_count"],
    "local_habitat": ["analogue_score", "habitat_score", "environmental_similarity", "landcover_match_score"],
    "macro_model": ["model_support_score", "sdm_suitability", "ssdm_model_support_score", "ssdm_predicted_richness"],
    "survey_gap": ["survey_gap_score", "environmental_novelty", "environmental_distance_to_known"],
    "access": ["access_score", "accessibility_score"],
    "field_validation": ["field_validation_support_score"],
}
MODEL_PREDICTIONS = ["sdm_suitability", "ssdm_model_support_score", "ssdm_predicted_richness"]
EXPLORATORY = "(?i)model-only|sdm-high|ssdm-high|exploratory|environmental-test|environmental contrast"
KNOWN_LOCATION = "(?i)occurrence|known"


def _largest(df: DataFrame, columns: list[str]) -> Column | None:
    have = [F.expr(f"try_cast({c} AS double)") for c in columns if c in df.columns]
    return None if not have else F.greatest(*have) if len(have) > 1 else have[0]


def with_units(df: DataFrame, parts: dict[str, list[str]], keys: list[str], default: float | None = 0.0) -> DataFrame:
    """For each part the largest present column brought to 0..1 within keys.

    Values already in 0..1 stay, others go by minimum and maximum, a span of at most 1e-12 is 0.5, missing ones get
    ``default`` (null keeps them missing). One aggregation for all parts, joined back: no un-keyed window.
    """
    raw = {name: _largest(df, columns) for name, columns in parts.items()}
    work = df.withColumns({f"_u_{n}": c if c is not None else F.lit(None).cast("double") for n, c in raw.items()})
    good = {n: F.when(finite(f"_u_{n}"), F.col(f"_u_{n}")) for n in parts}
    ends = work.groupBy(*keys).agg(*[f(good[n]).alias(f"_{t}_{n}") for n in parts for f, t in ((F.min, "lo"), (F.max, "hi"))])
    work = work.join(ends, keys) if keys else work.crossJoin(F.broadcast(ends))
    rest = F.lit(default).cast("double")
    out = {}
    for n in parts:
        lo, hi, x = F.col(f"_lo_{n}"), F.col(f"_hi_{n}"), F.col(f"_u_{n}")
        unit = F.when((lo >= 0) & (hi <= 1), x).when(hi - lo <= 1e-12, F.lit(0.5)).otherwise((x - lo) / (hi - lo))
        out[n] = F.when(lo.isNull() | x.isNull(), rest).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), unit)))
    return work.withColumns(out).drop(*[f"_{t}_{n}" for n in parts for t in ("u", "lo", "hi")])


def integrated_scores(df: DataFrame, keys: list[str], weights: dict[str, float] | None = None, exclude_occurrence_derived: bool = False) -> DataFrame:
    """The integrated evidence score with its components, agreement, divergence, class and explanation.

    Weights are renormalised over the components that a row has, so missing support never lowers a score.
    ``exclude_occurrence_derived`` leaves out direct observation, survey gap and habitat flagged as derived from records.
    """
    sources = {n: [] if exclude_occurrence_derived and n in ("observed", "survey_gap") else c for n, c in SOURCES.items()}
    weigh = WEIGHTS | {k: max(0.0, float(v)) for k, v in (weights or {}).items() if k in WEIGHTS}
    out = with_units(df, {f"_c_{n}": c for n, c in sources.items()}, keys, default=None)
    if exclude_occurrence_derived and "occurrence_derived_habitat_score" in df.columns:
        out = out.withColumn("_c_local_habitat", F.when(~F.coalesce(F.col("occurrence_derived_habitat_score").cast("boolean"), F.lit(False)), F.col("_c_local_habitat")))
    if "model_support_available" in df.columns:
        told = F.coalesce(F.col("model_support_available").cast("boolean"), F.lit(False))
        for c in MODEL_PREDICTIONS:
            if c in df.columns:
                told = told | F.expr(f"try_cast({c} AS double)").isNotNull()
        out = out.withColumn("_c_macro_model", F.when(told, F.col("_c_macro_model")))
    part = {n: F.col(f"_c_{n}") for n in WEIGHTS}
    weight = sum((F.when(part[n].isNotNull(), F.lit(weigh[n])).otherwise(0.0) for n in WEIGHTS), F.lit(0.0))
    total = sum((F.coalesce(part[n], F.lit(0.0)) * weigh[n] for n in WEIGHTS), F.lit(0.0))
    evidence = F.filter(F.array(*[part[n] for n in ("observed", "local_habitat", "macro_model")]), lambda x: x.isNotNull())
    out = out.withColumns({"_w": weight, "_base": F.when(weight > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / weight))).otherwise(0.0), "_e": evidence})
    mean = F.aggregate("_e", F.lit(0.0), lambda s, x: s + x) / F.size("_e")
    spread = F.array_max("_e") - F.array_min("_e")
    two = F.size("_e") >= 2
    out = out.withColumns({"_agree": F.when(two, mean * (1 - spread)).otherwise(0.0), "_diverge": F.when(two, spread).otherwise(0.0)})
    kind = F.coalesce(F.col("candidate_type"), F.lit("")) if "candidate_type" in df.columns else F.lit("")
    bonus, explore = 0.10 * F.col("_agree"), 0.05 * F.col("_diverge") * kind.rlike(EXPLORATORY).cast("double")
    zero = {n: F.coalesce(part[n], F.lit(0.0)) for n in WEIGHTS}
    model = part["macro_model"].isNotNull()
    label = (
        F.when(model & (F.col("_agree") >= 0.55) & (zero["macro_model"] >= 0.5), "Cross-scale consensus")
        .when(model & (zero["local_habitat"] >= 0.5) & (zero["macro_model"] < 0.5), "Local-habitat support; weak macro support")
        .when(model & (zero["macro_model"] >= 0.5) & (zero["local_habitat"] < 0.5) & (zero["observed"] < 0.5), "Macro-model exploration")
        .when(zero["observed"] >= 0.5, "Known-record anchor")
        .when(zero["local_habitat"] >= 0.5, "Local-habitat potential")
        .otherwise("Limited evidence")
    )
    four = lambda c: F.bround(c, 4)
    out = out.withColumns({
        **{f"component_{n}_score": four(part[n]) for n in WEIGHTS},
        **{f"component_{n}_available": part[n].isNotNull() for n in WEIGHTS},
        "integrated_base_score": four(F.col("_base")),
        "evidence_agreement_score": four(F.col("_agree")),
        "evidence_divergence_score": four(F.col("_diverge")),
        "agreement_bonus": four(bonus),
        "divergence_exploration_bonus": four(explore),
        "integrated_support_score": four(F.least(F.lit(1.0), F.col("_base") + bonus + explore)),
        "integrated_evidence_class": label,
        "integrated_available_weight": four(F.col("_w")),
        "distance_excluded_validation_score": F.lit(exclude_occurrence_derived),
        "integrated_score_explanation": F.format_string(
            "available-weight-normalized support=%.3f; agreement=%.3f; divergence=%.3f; model=%s", "_base", "_agree", "_diverge", F.when(model, "available").otherwise("not available")
        ),
    })
    return out.drop("_w", "_base", "_e", "_agree", "_diverge", *[f"_c_{n}" for n in WEIGHTS])


def candidate_role(kind: Column) -> Column:
    """The role that a candidate type's text tells."""
    text = F.lower(F.coalesce(kind, F.lit("")))
    has = lambda *words: [text.contains(w) for w in words]
    any_of = lambda xs: xs[0] if len(xs) == 1 else xs[0] | any_of(xs[1:])
    return (
        F.when(any_of(has("model-only", "sdm-high", "ssdm-high")), "Model-led exploration zone")
        .when(any_of(has("environmental-test", "environmental contrast", "boundary")), "Range-boundary comparison zone")
        .when(any_of(has("survey-gap", "under-surveyed")), "Under-sampled verification zone")
        .when(any_of(has("habitat", "analogue")), "Similar-habitat zone")
        .when(any_of(has("occurrence", "known")), "Known-location zone")
        .otherwise("Survey evidence zone")
    )


def without_known_locations(df: DataFrame, kind: str = "candidate_type", pattern: str = KNOWN_LOCATION) -> DataFrame:
    """Rows whose type doesn't name a known location; an unknown type stays (P10)."""
    return df.filter(~F.coalesce(F.col(kind).rlike(pattern), F.lit(False)))


def hard_constraints(df: DataFrame, least_resolution_m: float | None = None, steepest: float = 45.0, farthest_m: float = 500.0) -> DataFrame:
    """Audit columns ``eligible``, ``exclusion_reason`` and ``unknown_constraints`` (P11); unknown values are flagged, not excluded."""
    have = lambda *names: next((n for n in names if n in df.columns), None)
    number = lambda c: F.expr(f"try_cast({c} AS double)")
    reasons, unknown = [], []
    lat, lon = number("latitude"), number("longitude")
    reasons.append(F.when(F.coalesce(~(lat.between(-90, 90) & lon.between(-180, 180)), F.lit(True)), "invalid_coordinate"))
    blank = ("", "nan", "none", "unknown")
    if c := have("is_land", "land_mask"):
        text = F.lower(F.col(c).cast("string"))
        reasons.append(F.when(text.isin("false", "0", "no", "water"), "water"))
        unknown.append(F.when(text.isNull() | text.isin(*blank), "land"))
    else:
        unknown.append(F.lit("land"))
    if c := have("access_restricted", "restricted_access", "is_restricted"):
        text = F.lower(F.col(c).cast("string"))
        reasons.append(F.when(text.isin("true", "1", "yes", "restricted"), "restricted_access"))
        unknown.append(F.when(text.isNull() | text.isin(*blank), "legal_access"))
    else:
        unknown.append(F.lit("legal_access"))
    if "slope" in df.columns:
        reasons.append(F.when(number("slope") > steepest, "dangerous_slope"))
    else:
        unknown.append(F.lit("slope"))
    ways = [number(c) for c in ("distance_to_road_m", "distance_to_trail_m") if c in df.columns]
    if ways:
        near = F.least(*ways) if len(ways) > 1 else ways[0]
        reasons.append(F.when(near > farthest_m, "beyond_access_distance"))
        unknown.append(F.when(near.isNull(), "physical_access"))
    else:
        unknown.append(F.lit("physical_access"))
    if least_resolution_m is not None and (c := have("effective_search_cell_size_m", "search_cell_size_m")):
        reasons.append(F.when(number(c) < least_resolution_m, "over_precision"))
    why, what = F.array_compact(F.array(*reasons)), F.array_compact(F.array(*unknown))
    return df.withColumns({"eligible": F.size(why) == 0, "exclusion_reason": F.concat_ws(";", why), "unknown_constraints": F.concat_ws(";", what)})


def _available_mean(df: DataFrame, weights: dict[str, float], default: float) -> tuple[Column, Column]:
    """(weighted mean of the unit columns a row has, how many); unit columns are named ``_n_...``."""
    have = {c: w for c, w in weights.items() if c in df.columns}
    if not have:
        return F.lit(default), F.lit(0)
    there = {c: F.expr(f"try_cast({c} AS double)").isNotNull() for c in have}
    total = sum((F.when(there[c], F.coalesce(F.col(f"_n_{c}"), F.lit(default)) * w).otherwise(0.0) for c, w in have.items()), F.lit(0.0))
    weight = sum((F.when(there[c], F.lit(w)).otherwise(0.0) for c, w in have.items()), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(default), sum((there[c].cast("int") for c in have), F.lit(0))


def discovery_learning(df: DataFrame, keys: list[str]) -> DataFrame:
    """Habitat, detectability, access, discovery and learning values, and the data quality they rest on."""
    # fixed values: the weights of the parts
    groups = {
        "habitat": ({"analogue_score": 0.35, "habitat_score": 0.25, "environmental_similarity": 0.15, "landcover_match_score": 0.25}, 0.0),
        "detect": ({"detectability": 0.60, "flowering_probability": 0.25, "season_confidence": 0.15}, 0.5),
        "access": ({"access_score": 1.0}, 0.5),
        "uncertainty": ({"model_uncertainty": 0.5, "prediction_sd": 0.3, "ensemble_sd": 0.2}, 0.0),
        "boundary": ({"environmental_novelty": 0.55, "survey_gap_score": 0.25, "environmental_distance_to_known": 0.20}, 0.0),
    }
    out = integrated_scores(df, keys)
    columns = sorted({c for weights, _ in groups.values() for c in weights} | {"sdm_suitability"})
    out = with_units(out, {f"_n_{c}": [c] for c in columns if c in df.columns}, keys, default=None)
    value = {n: _available_mean(df, w, d) for n, (w, d) in groups.items()}
    both = F.lit(False)
    apart = F.lit(0.0)
    if "analogue_score" in df.columns and "sdm_suitability" in df.columns:
        both = F.col("_n_analogue_score").isNotNull() & F.col("_n_sdm_suitability").isNotNull()
        apart = F.when(both, F.abs(F.col("_n_analogue_score") - F.col("_n_sdm_suitability"))).otherwise(0.0)
    weight = F.when(both, 0.45).otherwise(0.0) + F.when(value["uncertainty"][1] > 0, 0.30).otherwise(0.0) + F.when(value["boundary"][1] > 0, 0.25).otherwise(0.0)
    learning = F.when(weight > 0, F.least(F.lit(1.0), (0.45 * apart + 0.30 * value["uncertainty"][0] + 0.25 * value["boundary"][0]) / weight)).otherwise(0.0)
    count = sum((n for _, n in value.values()), F.lit(0))
    four = lambda c: F.bround(c, 4)
    out = out.withColumns({
        "habitat_likelihood": four(value["habitat"][0]),
        "detectability_score": four(value["detect"][0]),
        "accessibility_score": four(value["access"][0]),
        "discovery_value": four(F.col("integrated_support_score") * value["detect"][0] * value["access"][0]),
        "learning_value": four(learning),
        "model_analogue_disagreement": four(apart),
        "evidence_count": count,
        "data_quality": F.when(count >= 5, "high").when(count >= 2, "medium").otherwise("low"),
    })
    return out.drop(*[f"_n_{c}" for c in columns])


def level(x: Column) -> Column:
    """high from 0.67, medium from 0.34, else low."""
    return F.when(x >= 0.67, "high").when(x >= 0.34, "medium").otherwise("low")


# fixed values: words that tell presence and absence
PRESENT = ("1", "true", "yes", "y", "present", "found", "detected", "success")
ABSENT = ("0", "false", "no", "n", "absent", "not_found", "not found", "failure")


def field_results(df: DataFrame, target: str, site: str = "site_id", order: str = "row_id") -> DataFrame:
    """(site, success): the first determinate result of each site."""
    text = F.lower(F.trim(F.col(target).cast("string")))
    rows = df.filter(text.isin(*PRESENT, *ABSENT) & F.col(site).isNotNull()).select(site, order, text.isin(*PRESENT).alias("success"))
    return rows.groupBy(site).agg(F.min_by("success", order).alias("success"))


def modal_window(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """The most frequent phenology window of each key, ties to the first in order, with an honest fallback."""
    text = F.trim(F.col(column).cast("string"))
    counts = df.filter(text.isNotNull() & ~F.lower(text).isin("", "nan", "none", "<na>", "unknown")).groupBy(*keys, text.alias("window")).count()
    best = counts.groupBy(*keys).agg(F.min_by("window", F.struct(-F.col("count"), "window")).alias("window"))
    return df.select(*keys).distinct().join(best, keys, "left").withColumn("window", F.coalesce("window", F.lit("Unknown; verify phenology locally")))


# fixed values: classes of fish, and classes that are surveyed at ten kilometres
FISH = ("actinopterygii", "chondrichthyes", "myxini", "cephalaspidomorphi")


def surface_domain(kingdom: Column, clazz: Column, land_fraction: Column) -> Column:
    """Where candidates lie, from taxonomy and the share of records on land."""
    kingdom, clazz = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (kingdom, clazz))
    return F.when(kingdom.isin("plantae", "viridiplantae"), "terrestrial").when(land_fraction <= 0.20, "marine").when(land_fraction <= 0.65, "coastal").when(clazz.isin(*FISH), "inland_aquatic").otherwise("terrestrial")


def recovery_radius_km(clazz: Column, domain: Column) -> Column:
    """The declared radius by domain and class."""
    wide = domain.isin("marine", "coastal", "inland_aquatic") | F.lower(F.trim(F.coalesce(clazz, F.lit("")))).isin("aves", "mammalia")
    return F.when(wide, 10.0).otherwise(5.0)


def precision_audit(df: DataFrame, cell: str, environment: str, uncertainty: str, target_km: str) -> DataFrame:
    """The precision that inputs allow, what limits it, and whether the target leaves half of itself."""
    parts = {"grid half-diagonal": F.greatest(F.lit(0.0), F.col(cell)) / math.sqrt(2.0), "environmental resolution": F.greatest(F.lit(0.0), F.coalesce(environment, F.lit(0.0))), "coordinate uncertainty q75": F.greatest(F.lit(0.0), F.coalesce(uncertainty, F.lit(0.0)))}
    floor = F.greatest(*parts.values())
    limit = F.coalesce(*[F.when(v == floor, k) for k, v in parts.items()])
    target = F.greatest(F.lit(1.0), F.col(target_km) * 1000.0)
    return df.withColumns({"precision_floor_km": F.bround(floor / 1000.0, 3), "limiting_factor": limit, "technical_eligibility": floor <= target / 2})


def survey_protocol(taxa: DataFrame, protocols: DataFrame) -> DataFrame:
    """Each taxon's protocol from a declared table of (priority, kingdom, class, protocol columns); null matches all."""
    t, p = taxa.withColumns({"_k": F.lower(F.trim(F.coalesce("kingdom", F.lit("")))), "_c": F.lower(F.trim(F.coalesce("class", F.lit(""))))}), protocols.withColumnsRenamed({"kingdom": "_pk", "class": "_pc"})
    met = t.join(F.broadcast(p), (F.col("_pk").isNull() | (F.col("_pk") == F.col("_k"))) & (F.col("_pc").isNull() | (F.col("_pc") == F.col("_c"))))
    first = met.groupBy(*taxa.columns).agg(F.min_by(F.struct(*[c for c in p.columns if c not in ("_pk", "_pc")]), "priority").alias("_p"))
    return first.select(*taxa.columns, "_p.*").drop("priority")


# fixed values: cell sizes in metres
CELL_SIZES = (100, 250, 500, 1000, 2000, 5000)


def cell_size(environment: Column, access: Column, uncertainty: Column, practical: float = 100.0, allowed=CELL_SIZES) -> Column:
    """The first allowed size that doesn't overstate the inputs, else the need in whole hundreds (P20)."""
    need = F.greatest(F.lit(practical), *[F.when(finite(c) & (c > 0), c) for c in (environment, access, uncertainty)])
    first = F.array_min(F.filter(F.array(*map(F.lit, sorted(allowed))), lambda x: x >= need))
    return F.coalesce(first, (F.ceil(need / 100.0) * 100).cast("int"))


def partition_method(n: Column, span: Column) -> Column:
    """How to validate, by the number and spread of records."""
    return F.when(n < 15, "jackknife").when((n < 30) | F.coalesce(span < 2.0, F.lit(False)), "random holdout").when(n < 50, "random k-fold").otherwise("block")


def rank_blend(a: Column, b: Column, weight: float) -> Column:
    return (1 - weight) * a + weight * b


def rank_and(a: Column, b: Column) -> Column:
    """The worse of two ranks."""
    return F.greatest(a, b)


def region_of(df: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each point's region by its box, the nearest centre where boxes overlap, null outside.

    ``boxes``: region, west, south, east, north; a declared table of bounded size.
    """
    inside = F.col("longitude").between(F.col("west"), F.col("east")) & F.col("latitude").between(F.col("south"), F.col("north"))
    middle = F.pow(F.col("longitude") - (F.col("west") + F.col("east")) / 2, 2) + F.pow(F.col("latitude") - (F.col("south") + F.col("north")) / 2, 2)
    met = df.select("row_id", "latitude", "longitude").join(F.broadcast(boxes), inside)
    best = met.groupBy("row_id").agg(F.min_by("region", F.struct(middle, "region")).alias("region"))
    return df.join(best, "row_id", "left")


# fixed values: months of the climatologies, and their mean lengths in days
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
MONTH_DAYS = [31, 28.25, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]


def bioclim(temperature: DataFrame, rain_rate: DataFrame) -> DataFrame:
    """Climate variables of the cells that both monthly climatologies have: bio1, bio4, bio12, bio14, bio15.

    Both tables have latitude, longitude and ``MONTHS``; rain is a daily rate. -999 and text that is no number are
    missing, and months without a value are left out of a cell's figures. Cells without any temperature, any rain
    value, or with a mean rain that isn't positive go. Of rows of one place the first by its values stays.
    """

    def months(df: DataFrame, name: str, weights: list[float]) -> DataFrame:
        number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
        clean = df.select(number("latitude").alias("latitude"), number("longitude").alias("longitude"), F.array(*[number(c) * w for c, w in zip(MONTHS, weights)]).alias(name), F.array(*[number(c) == -999.0 for c in MONTHS]).alias("_gone"))
        clean = clean.filter("latitude is not null and longitude is not null and not isnan(latitude) and not isnan(longitude)")
        kept = F.filter(F.zip_with(name, "_gone", lambda x, gone: F.when(~gone & ~F.isnan(x), x)), lambda x: x.isNotNull())
        return clean.groupBy("latitude", "longitude").agg(F.min(kept).alias(name))

    both = months(temperature, "_t", [1.0] * 12).join(months(rain_rate, "_r", MONTH_DAYS), ["latitude", "longitude"]).filter("size(_t) > 0 and size(_r) > 0")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    mean = lambda c: total(c) / F.size(c)
    sd = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + (x - F.col(f"{c}m")) * (x - F.col(f"{c}m"))) / F.size(c))
    both = both.withColumns({"_tm": mean("_t"), "_rm": mean("_r")}).filter("_rm > 0")
    return both.select("latitude", "longitude", F.col("_tm").alias("bio1"), (sd("_t") * 100).alias("bio4"), total("_r").alias("bio12"), F.array_min("_r").alias("bio14"), (sd("_r") * 100 / F.col("_rm")).alias("bio15"))


def covered_within(coverage: DataFrame, radius_km: float) -> DataFrame:
    """Rows of the long coverage table within a smaller radius."""
    return coverage.filter(F.col("dist_km") <= radius_km)


# fixed values: the columns of the product, in order
PRODUCT = ["candidate_patch_id", "survey_area_id", "latitude", "longitude", "support_cell_count", "candidate_patch_radius_m", "patch_merge_distance_m", "support_fraction", "validation_status"]


def product(patches: DataFrame, fraction: float = 0.025, status: str = "untouched_confirmation_passed") -> DataFrame:
    """Patches in the product's nine columns, in the neutral order of area and id."""
    out = patches.withColumnsRenamed({"zone_id": "candidate_patch_id", "zone_radius_m": "candidate_patch_radius_m", "zone_member_count": "support_cell_count", "zone_merge_threshold_m": "patch_merge_distance_m"})
    return out.withColumns({"support_fraction": F.lit(fraction), "validation_status": F.lit(status)}).select(*PRODUCT).orderBy(F.col("survey_area_id").cast("string"), "candidate_patch_id")


def zone_comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ranks before and after a model, their change, harmonic agreement and its class."""
    one = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0.0))))
    local, model = F.greatest(one("observed_support_score"), one("local_habitat_support_score")), one("model_support_score")
    joined = after.drop("initial_rank").join(before.select("zone_id", F.col("zone_rank").alias("initial_rank")), "zone_id", "left")
    return joined.withColumns({
        "model_rank": F.col("zone_rank"),
        "rank_change": F.col("initial_rank") - F.col("zone_rank"),
        "agreement_score": F.bround(F.when(local + model > 0, 2 * local * model / (local + model)).otherwise(0.0), 6),
        "agreement_class": F.when((local >= 0.5) & (model >= 0.5), "Concordant — highest priority").when(local >= model, "Local evidence first").otherwise("Model-led exploration"),
    })


def top_quota(df: DataFrame, per_area: int, total: int, area: str = "survey_area_id", score: str = "priority_score", ident: str = "site_id") -> DataFrame:
    """The best ``per_area`` rows of each area if there are several areas, else the best ``total`` (K1)."""
    order = [F.desc(score), F.asc(ident)]
    several = len(df.select(area).distinct().limit(2).collect()) > 1
    if not several:
        chosen = df.orderBy(*order).limit(total)
        return chosen.withColumn("recommendation_rank", F.row_number().over(Window.orderBy(*order)))
    k = F.row_number().over(Window.partitionBy(area).orderBy(*order))
    chosen = df.withColumn("_k", k).filter(F.col("_k") <= per_area).drop("_k")
    # as many rows as areas times the quota, which is a report to read
    return chosen.withColumn("recommendation_rank", F.row_number().over(Window.orderBy(F.asc(area), *order)))
