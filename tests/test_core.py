"""Operators on literal rows with known answers, properties, and independence of partitions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldquarry.functions import geo, scoring
from fieldquarry.operators import aggregates, graph, joins, models, pairs, resampling, selection, support, windows
from fieldquarry.sources import exports, tables


def metres(a, b):
    (la, lo), (lb, lob) = ((math.radians(x), math.radians(y)) for x, y in (a, b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lob - lo) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(min(1, h)))


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    rows = [(i, "ab"[i % 2], 35 + rng.random() * 0.2, 139 + rng.random() * 0.2, rng.random()) for i in range(120)]
    return rows, spark.createDataFrame(rows, "row_id long, survey_area_id string, latitude double, longitude double, priority_score double")


def test_radius_join_is_exact_everywhere(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(-89.9, 89.9), rng.uniform(-180, 180)) for i in range(150)]
    rows += [(200 + i, rng.uniform(88, 90), rng.uniform(-180, 180)) for i in range(40)] + [(300 + i, rng.uniform(-1, 1), rng.choice([-179.95, 179.95]) + rng.uniform(-0.04, 0.04)) for i in range(40)]
    frame = spark.createDataFrame(rows, "row_id long, latitude double, longitude double")
    for radius in (30_000.0, 600_000.0):
        got = {(r.a, r.b) for r in joins.within_radius(frame, radius, []).collect()}
        want = {(a, b) for (a, x, y), (b, u, v) in itertools.product(rows, rows) if metres((x, y), (u, v)) <= radius}
        assert got == want


def test_nearest_join_by_rings_equals_all_pairs(points):
    _, frame = points
    left = frame.filter("row_id % 3 = 0").withColumnRenamed("row_id", "l")
    right = frame.filter("row_id % 3 = 1 and survey_area_id = 'a'").withColumnRenamed("row_id", "r")
    a = {r.l: r.r for r in joins.nearest_join(left, right, ["survey_area_id"], "l", "r").collect()}
    b = {r.l: r.r for r in joins.nearest_join(left, right, ["survey_area_id"], "l", "r", radius_m=200.0).collect()}
    assert a == b and any(v is None for v in a.values())


def test_average_ranks_with_ties_and_without_keys(spark):
    rows = [(i, v) for i, v in enumerate([3.0, 1.0, 3.0, 2.0, float("inf"), float("inf")])]
    frame = spark.createDataFrame(rows, "row_id long, v double")
    for far in (False, True):
        got = {r.row_id: r.rank for r in windows.percent_rank_average(frame.repartition(3), "v", [], distributed=far).collect()}
        assert [round(got[i], 6) for i in range(6)] == [round(x / 6, 6) for x in (3.5, 1, 3.5, 2, 5.5, 5.5)]


FEATURES = ["f1", "f2"]


@pytest.fixture(scope="module")
def literal(spark):
    universe = spark.createDataFrame(
        [(0, 35.0, 139.0, "a", 0.0, 0.0), (1, 35.004, 139.004, "a", 0.1, 0.1), (2, 35.05, 139.05, "a", 1.0, 1.0), (3, 35.054, 139.054, "a", 1.1, 1.1), (4, 36.0, 140.0, "b", 5.0, 5.0)],
        "row_id long, latitude double, longitude double, survey_area_id string, f1 double, f2 double",
    )
    protos = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.2, 0.2), (2, 1.0, 1.0), (3, 1.2, 1.2), (4, 2.0, float("nan"))], "row_id long, f1 double, f2 double")
    return universe, protos


def test_incomplete_prototypes_change_nothing(literal):
    universe, protos = literal
    a = support.consensus(universe, protos, FEATURES, []).orderBy("row_id").collect()
    b = support.consensus(universe.repartition(4), protos.filter("row_id < 4"), FEATURES, []).orderBy("row_id").collect()
    assert a == b and a[4].consensus == 1.0
    audit = support.consensus_audit(protos, FEATURES, []).first()
    assert audit.leave_one_out_worlds == 4 and audit.kernel_scale_min >= 0.25


def test_patches_of_the_literal_universe(literal):
    universe, protos = literal
    cells = support.support_cells(universe, support.consensus(universe, protos, FEATURES, []), 0.8)
    got = scoring.product(graph.patches(cells, 1000.0), 0.8)
    assert got.columns == scoring.PRODUCT
    assert [(r.candidate_patch_id, r.support_cell_count) for r in got.collect()] == [("a-Z001", 2), ("a-Z002", 2)]


def test_single_precision_drops_the_boundary_rank(spark):
    ranks = spark.createDataFrame([(0, 20 / 800)], "row_id long, consensus double").withColumn("consensus", F.col("consensus").cast("float"))
    universe = spark.createDataFrame([(0,)], "row_id long")
    assert support.support_cells(universe, ranks, 0.025).isEmpty() and not support.support_cells(universe, ranks, 0.025, 1e-6).isEmpty()


def sequential_patches(rows, threshold):
    patches = []
    for i, _, la, lo, _ in rows:
        best = None
        for k, members in enumerate(patches):
            far = max(metres((la, lo), m[1:]) for m in members)
            if far <= threshold and (best is None or far < best[0]):
                best = (far, k)
        if best:
            patches[best[1]].append((i, la, lo))
        else:
            patches.append([(i, la, lo)])
    return {m[0]: members[0][0] for members in patches for m in members}


def test_complete_link_by_components_equals_the_sequence(points):
    rows, frame = points
    for threshold in (1500.0, 4000.0):
        want = {}
        for area in "ab":
            want |= sequential_patches([r for r in rows if r[1] == area], threshold)
        for parts in (1, 7):
            got = {r.row_id: r.founder for r in graph.complete_link(frame.repartition(parts), threshold, ["survey_area_id"]).collect()}
            assert got == want


def test_zones_score_maxima_not_counts(spark):
    rows = [(1, "x", 0.0, 0.0, 0.2, 0.9, 400.0), (2, "x", 0.0, 0.001, 0.8, 0.1, 400.0), (3, "x", 0.0, 0.02, 0.5, None, 400.0), (4, "y", 9.0, 9.0, 0.9, 0.5, None)]
    frame = spark.createDataFrame(rows, "row_id long, survey_area_id string, latitude double, longitude double, priority_score double, analogue_score double, search_cell_radius_m double")
    got = {r.zone_id: r for r in graph.scored_zones(frame).collect()}
    assert {k: (r.zone_member_count, r.zone_score, r.representative_site_id, r.zone_merge_threshold_m) for k, r in got.items()} == {"x-Z001": (2, 0.72, 2, 800.0), "x-Z002": (1, 0.45, 3, 800.0), "y-Z001": (1, 0.81, 4, 1000.0)}
    first = got["x-Z001"]
    assert (first.local_source_site_id, first.priority_source_site_id, first.evidence_source_count, got["y-Z001"].zone_rank) == (1, 2, 2, 1)


def test_components_and_bounded_paths(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 9.0), (7, 8, 1.0), (2, 1, 0.5)], "from_node_id long, to_node_id long, distance_m double")
    nodes = spark.createDataFrame([(9,)], "node long")
    assert {r.node: r.component for r in graph.components(edges, "from_node_id", "to_node_id", nodes).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 9}
    got = {(r.source, r.node): r.cost for r in graph.bounded_paths(graph.clean_edges(edges), spark.createDataFrame([(1,)], "source long"), 4.0).collect()}
    assert got == {(1, 1): 0.0, (1, 2): 0.5, (1, 3): 1.5}


def test_an_empty_edge_table_blocks_near_patches(spark):
    patches = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, "a", 0.0, 0.0008)], "candidate_patch_id long, survey_area_id string, latitude double, longitude double")
    nodes = spark.createDataFrame([(10, "a", 0.0, 0.0), (11, "a", 0.0, 0.0008)], "network_node_id long, survey_area_id string, latitude double, longitude double")
    none = spark.createDataFrame([], "from_node_id long, to_node_id long, distance_m double")
    one = spark.createDataFrame([(10, 11, 90.0)], "from_node_id long, to_node_id long, distance_m double")
    assert graph.patch_reachability(patches, nodes, none, 500.0, 50.0).isEmpty()
    assert [(r.from_patch_id, r.to_patch_id, r.total_m) for r in graph.patch_reachability(patches, nodes, one, 500.0, 50.0).collect()] == [(1, 2, 90.0)]
    assert graph.patch_reachability(patches, nodes, one, 80.0, 50.0).isEmpty()
    with pytest.raises(ValueError, match="unknown"):
        graph.explicit_edges(patches, spark.createDataFrame([(1, 5)], "from_patch_id long, to_patch_id long"))


def line(spark):
    return spark.createDataFrame([(i, "a", 0.0, 0.005 * i, 100.0, 1000.0) for i in range(5)], "row_id long, survey_area_id string, latitude double, longitude double, candidate_patch_radius_m double, patch_merge_distance_m double")


def test_movement_cover_is_connected_and_whole(spark):
    frame = line(spark)
    assert selection.coverage_scale_km(frame) == (1.0, "patch_merge_distance_m")
    got = selection.movement_cover(frame, 0.6, 1.0).orderBy("operational_selection_step").collect()
    assert got[-1].segment_coverage_fraction == 1.0 and got[0].movement_parent is None and all(r.movement_parent is not None for r in got[1:])
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4)], "from_patch_id long, to_patch_id long")
    same = selection.reachability_cover(frame, edges, 1.0).orderBy("operational_selection_step").collect()
    assert [r.node for r in same] == [r.node for r in got]
    with pytest.raises(ValueError):
        selection.movement_cover(frame, 0.0, 1.0)


def test_thinning_keeps_rows_apart_and_the_rest_covered(points):
    rows, frame = points
    kept = {r.row_id for r in selection.distance_thinning(frame, 2500.0, ["survey_area_id"]).collect()}
    at = {r[0]: r for r in rows}
    for area in "ab":
        order, want = [r for r in rows if r[1] == area], []
        for r in order:
            if all(metres(r[2:4], at[k][2:4]) > 2500 for k in want):
                want.append(r[0])
        assert {k for k in kept if at[k][1] == area} == set(want)


def test_greedy_forms_agree_and_are_prefixes(points):
    _, frame = points
    long_ = [r.row_id for r in selection.centroid_first(frame, 9).orderBy("decision_rank").collect()]
    assert [r.row_id for r in selection.centroid_first(frame.repartition(5), 4).orderBy("decision_rank").collect()] == long_[:4]
    cover = selection.max_coverage(frame, 3.0, 4, ["survey_area_id"]).collect()
    rows, _ = points
    for area in "ab":
        own = [r for r in rows if r[1] == area]
        near = {r[0]: {s[0] for s in own if metres(r[2:4], s[2:4]) <= 3000} for r in own}
        covered, want = set(), []
        for _ in range(4):
            best = min((k for k in near if k not in want), key=lambda k: (-len(near[k] - covered), k))
            want.append(best)
            covered |= near[best]
        got = sorted((r.coverage_rank, r.row_id) for r in cover if r.survey_area_id == area)
        assert [k for _, k in got] == want
    balanced = selection.area_balanced(frame.withColumn("pool", F.lit(1)), 2, ["pool"]).join(frame, "row_id")
    assert {r.survey_area_id for r in balanced.collect()} == {"a", "b"}


def test_complementary_by_hand(spark):
    frame = spark.createDataFrame([(0, "p", 0.0, 0.0, 0.5), (1, "p", 0.0, 0.0, 0.5), (2, "p", 0.0, 1.0, 0.4)], "row_id long, pool string, latitude double, longitude double, priority_score double")
    got = selection.complementary(frame, 2, ["pool"]).orderBy("decision_rank").collect()
    assert [r.row_id for r in got] == [0, 2] and abs(got[0].utility - (0.25 * 0.5 + 0.75 * 0.5)) < 1e-12


def test_largest_remainder_and_samples(spark, points):
    w = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "area string, weight double")
    assert {r.area: r.quota for r in selection.largest_remainder(w, 4, []).collect()} == {"a": 2, "b": 1, "c": 1}
    _, frame = points
    one = {r.row_id for r in selection.balanced_sample(frame.repartition(2), 30).collect()}
    assert len(one) == 30 and one == {r.row_id for r in selection.balanced_sample(frame.repartition(9), 30).collect()}


def test_scores_renormalise_over_what_is_there(spark):
    rows = [(1, None, None, "x"), (2, 0.8, None, "x"), (3, 0.8, 0.6, "Model-only exploration"), (4, None, 0.2, "x")]
    got = {r.row_id: r for r in scoring.integrated_scores(spark.createDataFrame(rows, "row_id long, analogue_score double, sdm_suitability double, candidate_type string"), []).collect()}
    assert got[1].integrated_support_score == 0 and got[1].integrated_evidence_class == "Limited evidence"
    assert got[2].integrated_support_score == 0.8 and got[4].integrated_support_score == 0.2
    base = (0.8 * 0.25 + 0.6 * 0.15) / 0.4
    assert abs(got[3].integrated_support_score - (base + 0.1 * 0.7 * 0.8 + 0.05 * 0.2)) < 1e-4
    assert got[3].integrated_score_explanation.endswith("model=available")


def test_failures_count_as_zero(spark):
    declared = spark.createDataFrame([(1,), (2,)], "pair_id long")
    folds = spark.createDataFrame([(1, 1, "rule", 1.0, "ok"), (1, 2, "rule", 0.5, "ok"), (1, 1, "env", 1.0, "ok")], "pair_id long, repeat int, method string, recall double, status string")
    got = {(r.pair_id, r.method): r.pair_mean for r in aggregates.intention_to_evaluate(declared, folds, 3, ["rule", "env"], ["env"], ["pair_id"]).collect()}
    assert got == {(1, "rule"): 0.5, (2, "rule"): 0.0, (1, "env"): None, (2, "env"): None}
    whole = aggregates.complete_folds(declared, folds, 3, ["rule", "env"], ["pair_id"])
    assert whole.count() == 12 and whole.filter("status = 'artifact_missing'").count() == 9
    with pytest.raises(ValueError):
        aggregates.complete_folds(declared, folds.unionByName(folds), 3, ["rule"], ["pair_id"])


def test_exact_signs_by_hand(spark):
    values = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 4.0)], "pair_id long, lift double")
    got = resampling.exact_sign_flip(values, []).first()
    assert (got.p_one_sided, got.p_two_sided) == (1 / 8, 2 / 8)
    assert resampling.leave_one_out_range(values, []).first().least_mean == 1.5


def test_detections_without_candidates_are_never_recovered(spark):
    d = spark.createDataFrame([(1, "a", 35.004, 139.0), (2, "z", 35.0, 139.0)], "detection_cluster_id long, area string, latitude double, longitude double")
    c = spark.createDataFrame([(1, "a", 35.0, 139.0)], "site_id long, area string, latitude double, longitude double")
    got = {r.detection_cluster_id: r for r in joins.nearest_candidate_recovery(d, c, [0.2, 1.0], ["area"]).collect()}
    assert not got[1]["recovered_0.2km"] and got[1].recovered_1km and got[2].nearest_km == math.inf and not got[2].recovered_1km


def test_selectors_never_see_outcomes(spark):
    leaky = spark.createDataFrame([(1,)], "heldout_ids long")
    assert exports.leaked_columns(leaky) == ["heldout_ids"]
    occ = spark.createDataFrame([("t", i, 35.0 + i, 139.0, str(i)) for i in range(6)], "taxon string, occ_id long, latitude double, longitude double, block string")
    with pytest.raises(ValueError, match="outcomes"):
        models.candidate_benchmark(occ, lambda t: t.withColumns({"recall": F.lit(1), "candidate_type": F.lit("x"), "cand_id": F.col("occ_id")}), ["taxon"], 1, 5.0)


def test_exports_are_verified_and_stages_isolated(spark, tmp_path):
    frame = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, None)], "pair_id long, repeat int, v string")
    exports.export_folds(frame, f"{tmp_path}/e")
    assert exports.verify_export(spark, f"{tmp_path}/e").isEmpty() and exports.file_digests(spark, f"{tmp_path}/e/data").count() >= 3
    frame.filter("pair_id = 1").withColumn("v", F.lit("z")).write.mode("overwrite").partitionBy("pair_id", "repeat").parquet(f"{tmp_path}/e/data")
    assert exports.verify_export(spark, f"{tmp_path}/e").count() == 3
    assert exports.fingerprint({"b": 1, "a": [1, 2]}) == exports.fingerprint({"a": [1, 2], "b": 1})

    def broken():
        raise RuntimeError("no network")

    row = exports.staged([("product", lambda: frame), ("network", broken), ("plan", lambda: frame)], f"{tmp_path}/s", spark).first()
    assert (row.completed_stages, row.failed_stage, row.failure) == (["product"], "network", "no network") and spark.read.parquet(f"{tmp_path}/s/product").count() == 3


def test_reading_bad_numbers_and_names(spark, tmp_path):
    (tmp_path / "x.csv").write_text("decimalLatitude,decimalLongitude,year\n35.0,139.0,2001\nbad,139.0,x\n")
    from pyspark.sql import types as T

    kind = T.StructType([T.StructField("decimalLatitude", T.DoubleType()), T.StructField("decimalLongitude", T.DoubleType()), T.StructField("year", T.IntegerType()), T.StructField("more", T.StringType())])
    got = tables.named_coordinates(tables.read_table(spark, str(tmp_path / "x.csv"), kind)).collect()
    assert got[1].latitude is None and got[1].year is None and got[0].latitude == 35.0 and got[0].more is None


def test_climate_by_hand(spark):
    kind = "latitude double, longitude double, " + ", ".join(f"{m} double" for m in scoring.MONTHS)
    heat = spark.createDataFrame([(1.0, 1.0, *[10.0] * 12), (2.0, 1.0, -999.0, *[10.0] * 11), (3.0, 1.0, *[5.0] * 12), (4.0, 1.0, *[-999.0] * 12), (5.0, 1.0, *[5.0] * 12), (6.0, 1.0, *[float(i) for i in range(6)] * 2)], kind)
    rain = spark.createDataFrame([(1.0, 1.0, *[1.0] * 12), (2.0, 1.0, *[1.0] * 11, -999.0), (3.0, 1.0, *[0.0] * 12), (4.0, 1.0, *[1.0] * 12), (6.0, 1.0, 2.0, *[0.0] * 11)], kind)
    got = {r.latitude: r for r in scoring.bioclim(heat, rain).collect()}
    assert set(got) == {1.0, 2.0, 6.0}  # 3 is dry, 4 has no temperature, 5 no rain
    assert (got[1.0].bio1, got[1.0].bio4, got[1.0].bio12, got[1.0].bio14) == (10.0, 0.0, 365.25, 28.25)
    assert (got[2.0].bio1, got[2.0].bio12) == (10.0, 334.25)  # months without a value are left out
    assert got[6.0].bio4 == pytest.approx(100 * math.sqrt(35 / 12)) and got[6.0].bio12 == 62 and got[6.0].bio15 == pytest.approx(100 * math.sqrt(11))


def test_large_components_are_linked_and_thinned_in_rounds(points, monkeypatch):
    rows, frame = points
    rows, frame = rows[:36], frame.filter("row_id < 36")
    whole = {r.row_id for r in selection.distance_thinning(frame, 5000.0, ["survey_area_id"]).collect()}
    steps = {r[:5] for r in selection.movement_cover(frame, 5.0, 8.0).collect()}
    monkeypatch.setattr(graph, "COMPONENT", 3)
    want = {}
    for area in "ab":
        want |= sequential_patches([r for r in rows if r[1] == area], 6000.0)
    assert {r.row_id: r.founder for r in graph.complete_link(frame.repartition(5), 6000.0, ["survey_area_id"]).collect()} == want
    assert {r.row_id for r in selection.distance_thinning(frame, 5000.0, ["survey_area_id"]).collect()} == whole
    assert {r[:5] for r in selection.movement_cover(frame, 5.0, 8.0).collect()} == steps


def test_large_pools_are_chosen_in_rounds(points, monkeypatch):
    _, frame = points
    frame = frame.withColumns({"pool": F.col("row_id") % 3, "area": F.col("row_id") % 7, "taxon_group": F.when(F.col("row_id") % 3 == 1, "plant").otherwise("animal")}).unionByName(frame.limit(0).withColumns({"pool": F.lit(0), "area": F.lit(0), "taxon_group": F.lit("x")}))
    rules = [lambda d: selection.complementary(d, 6, ["pool"]), lambda d: selection.area_balanced(d, 9, ["pool"], "area"), lambda d: selection.group_policy(d, ["pool"])]
    small = [sorted((*r[:-1], round(r[-1], 9)) for r in rule(frame).collect()) for rule in rules]
    monkeypatch.setattr(selection, "POOL", 5)
    assert [sorted((*r[:-1], round(r[-1], 9)) for r in rule(frame).collect()) for rule in rules] == small
    with pytest.raises(ValueError, match="more than 5 rows"):
        selection.per_pool(frame, ["pool"], [], lambda pool: ([], []), "row_id")


def test_ring_searches_equal_all_pairs(points):
    rows, frame = points
    stations = [r for r in rows if r[0] % 4 == 0]
    held = frame.filter("row_id % 4 = 0").withColumnRenamed("row_id", "station_id")
    got = {r.row_id: r.priority_score for r in joins.inverse_distance(frame.drop("priority_score"), held, ["priority_score"]).collect()}
    bounds = {r.row_id: r for r in joins.footprint_bounds(frame, held.withColumn("radius", F.col("station_id") * 20.0), 500.0, "row_id", "station_id", "radius").collect()}
    for r in rows:
        near = sorted((metres(r[2:4], s[2:4]), s[0], s[4]) for s in stations)
        w = [1 / max(d / geo.EARTH_RADIUS_M, 1e-10) ** 2 for d, _, _ in near[:4]]
        assert got[r[0]] == pytest.approx(sum(a * v for a, (_, _, v) in zip(w, near)) / sum(w))
        least = min((max(0.0, d - 20.0 * i), i) for d, i, _ in near)
        assert bounds[r[0]].bound_m == pytest.approx(least[0], abs=1e-6) and bounds[r[0]].pruned == (least[0] > 500 + 1e-9)
    other = {r.row_id: r.n for r in joins.nearest_join(frame, frame.withColumnRenamed("row_id", "n"), ["survey_area_id"], "row_id", "n", other=True).collect()}
    for r in rows:
        assert other[r[0]] == min((metres(r[2:4], s[2:4]), s[0]) for s in rows if s[1] == r[1] and s[0] != r[0])[1]


def test_modes_by_hand(spark):
    # two groups of three points far apart, and the unit scale of a constant column
    protos = spark.createDataFrame([(i, x, 1.0) for i, x in enumerate([0.0, 1.0, 2.0, 20.0, 21.0, 22.0])], "row_id long, f1 double, f2 double")
    got = {r.row_id: (r["mode"], r.gap) for r in support.environmental_modes(protos, FEATURES, []).collect()}
    assert [got[i][0] for i in range(6)] == [0, 0, 0, 1, 1, 1] and got[0][1] == pytest.approx(18.0)
    even = protos.withColumn("f1", F.col("row_id").cast("double"))
    assert {(r["mode"], r.gap) for r in support.environmental_modes(even, FEATURES, []).collect()} == {(0, 1.0)}
    assert support._long_above(np.array([1.0, 1.0, 1.0, 2.0]), 3.0) == 1.5 and support._long_above(np.array([1.0]), 3.0) == math.inf
    universe = spark.createDataFrame([(i, float(x), 1.0) for i, x in enumerate([0, 1, 2, 3, 4, 20, 21, 22, 23, 9, 10, 11])], "row_id long, f1 double, f2 double")
    taken = support.mode_balanced(universe, protos, FEATURES, [], 0.5).orderBy("selection_rank").collect()
    ranks = support.finite_geometry(universe, protos, FEATURES, []).filter("support_rank <= 0.5").count()
    order, z = {}, {0: [0.0, 1.0, 2.0], 1: [20.0, 21.0, 22.0]}
    for m in (0, 1):
        order[m] = [i for _, i in sorted((min(abs(x - p) for p in z[m]), i) for i, x in enumerate([0, 1, 2, 3, 4, 20, 21, 22, 23, 9, 10, 11]))]
    want: list = []
    while len(want) < ranks:
        for m in (0, 1):
            if len(want) < ranks:
                want.append((next(i for i in order[m] if i not in [w[0] for w in want]), m))
    assert [(r.row_id, r["mode"]) for r in taken] == want
    one = support.mode_balanced(universe, even, FEATURES, [], 0.5).collect()
    assert {r.row_id for r in one} == {r.row_id for r in support.finite_geometry(universe, even, FEATURES, []).filter("support_rank <= 0.5").collect()}


def test_mode_centres_are_the_best_partition(spark):
    rng = random.Random(5)
    protos = [(i, rng.random(), rng.random()) for i in range(7)]
    frame = spark.createDataFrame(protos, "row_id long, f1 double, f2 double")
    model = support.prototype_models(frame, FEATURES, []).first()
    z = [tuple(p) for p in model.prototypes]
    centres = {r.k: r for r in support.mode_centres(frame, FEATURES, []).collect()}
    assert set(centres) == {2, 3, 4, 5, 6}
    for k in (2, 3):
        least = math.inf
        for labels in itertools.product(range(k), repeat=7):
            parts = [[p for p, j in zip(z, labels) if j == c] for c in range(k)]
            if all(parts):
                middles = [[sum(x) / len(part) for x in zip(*part)] for part in parts]
                least = min(least, sum(math.dist(p, middles[j]) ** 2 for p, j in zip(z, labels)))
        found = sum(min(math.dist(p, c) ** 2 for c in centres[k].centroids) for p in z)
        assert found == pytest.approx(least)
        assert all(tuple(m) in z and math.dist(m, c) == min(math.dist(p, c) for p in z) for m, c in zip(centres[k].medoids, centres[k].centroids))
    universe = spark.createDataFrame([*protos, (50, None, 0.5)], "row_id long, f1 double, f2 double")
    keyed = universe.withColumn("one", F.lit(1))
    far = {(r.row_id, r.k): r for r in support.mode_distances(keyed, support.mode_centres(frame.withColumn("one", F.lit(1)), FEATURES, ["one"]), FEATURES, ["one"]).collect()}
    assert len(far) == 40 and far[50, 2].kmeans_centroid_distance == math.inf == far[50, 2].kmeans_medoid_distance
    for i, p in enumerate(z):
        assert far[i, 3].kmeans_centroid_distance == pytest.approx(min(math.dist(p, c) for c in centres[3].centroids))
        assert far[i, 6].kmeans_medoid_distance == pytest.approx(min(math.dist(p, c) for c in centres[6].medoids))


def test_survey_scopes(spark):
    kind = "taxon string, row_id long, latitude double, longitude double"
    rows = [("few", i, 1.0 * i, 0.0) for i in range(4)] + [("apart", 10 + i, 4.0 * i, 0.0) for i in range(6)]
    # a range of six, another of three, two strays together and one alone, and a repeated place
    rows += [("many", 20 + i, 0.0, 0.05 * i) for i in range(6)] + [("many", 30 + i, 10.0, 0.05 * i) for i in range(3)] + [("many", 40, 20.0, 0.0), ("many", 41, 20.0, 0.05), ("many", 50, 30.0, 0.0), ("many", 51, 0.0, 0.0)]
    got = {r.row_id: r for r in graph.survey_scope(spark.createDataFrame(rows, kind), ["taxon"]).collect()}
    assert {got[i].scope_class for i in range(4)} == {"main_range"} and got[0].cluster_eps_m is None
    assert {got[10 + i].scope_class for i in range(6)} == {"main_range"} and got[10].cluster_eps_m == 120_000.0
    assert {i: got[i].scope_class[:4] for i in got if i >= 20} == {**{20 + i: "main" for i in range(6)}, 51: "main", **{30 + i: "disj" for i in range(3)}, 40: "poss", 41: "poss", 50: "poss"}
    assert got[20].cluster_eps_m == pytest.approx(3 * metres((0, 0), (0, 0.05)), rel=1e-3)


def test_regions_cards_and_regimes(spark):
    rows = [(i, 0.0, 0.02 * i) for i in range(5)] + [(10 + i, 0.0, 2.0 + 0.02 * i) for i in range(3)] + [(20 + i, 3.0, 0.02 * i) for i in range(4)] + [(30, 8.0, 8.0)]
    frame = spark.createDataFrame(rows, "row_id long, latitude double, longitude double")
    regions = graph.survey_regions(frame, 40_000.0)
    table = graph.region_table(regions)
    got = {r.region_id: r for r in table.collect()}
    assert [got[i].record_count for i in (1, 2, 3, 4)] == [5, 4, 3, 1] and got[1].medoid_id == 2 and got[1].record_share == round(5 / 13, 4)
    cards = {r.card_rank: (r.region_id, r.card_role, r.recommended) for r in graph.region_cards(table).collect()}
    assert cards == {1: (1, "Recommended", True), 2: (2, "Discovery", False), 3: (3, "Range contrast", False)}
    regime = graph.distribution_regime(regions, table).first()
    span = max(metres(a[1:], b[1:]) for a in rows for b in rows) / 1000
    assert (regime.distribution_regime, regime.stable_regions, regime.eligible_records) == ("disjunct", 3, 13) and regime.total_span_km == round(span, 1)


def test_maximin_needs_no_matrix_of_a_pool(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 16)
    monkeypatch.setattr(selection, "per_pool", None)  # no pool is a group in one task
    rng = random.Random(8)
    rows = [(i, [None, 1, 2][i % 3], 30 + rng.random(), 130 + rng.random(), None if i % 7 == 0 else rng.random(), float(i % 5), 4.0) for i in range(150)]
    frame = spark.createDataFrame(rows, "row_id long, area int, latitude double, longitude double, a double, b double, c double").repartition(5)
    for name, out in (
        ("geo", selection.geographic_maximin(frame, 6, ["area"])),
        ("env", selection.environmental_maximin(frame, 6, ["a", "b", "c"], ["area"])),
        ("dual", selection.dual_maximin(frame, 6, ["a", "b", "c"], ["area"], 0.3)),
    ):
        got = {(r.area, r.decision_rank): (r.row_id, r[-1]) for r in out.collect()}
        assert len(got) == 18
        for area in (None, 1, 2):
            pool = [r for r in rows if r[1] == area]
            lat, lon = np.array([r[2] for r in pool]), np.array([r[3] for r in pool])
            x = np.array([r[4:] for r in pool], float)
            x = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
            low, mid, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
            z = (x - mid)[:, :2] / (high - low)[:2]
            apart = {"geo": pairs.metres(lat[:, None], lon[:, None], lat, lon), "env": np.sqrt(((z[:, None] - z) ** 2).sum(axis=2))}
            apart["dual"] = 0.7 * apart["geo"] / apart["geo"].max() + 0.3 * apart["env"] / apart["env"].max()
            m = apart[name]
            picked = [int(np.argmax(np.round(m.mean(axis=1) / m.max(), 12)))]
            values = [m[picked[0]].mean()]
            while len(picked) < 6:
                near = m[picked].min(axis=0)
                near[picked] = -1
                picked.append(int(np.argmax(near)))
                values.append(near[picked[-1]])
            for turn in range(6):
                ident, value = got[area, turn + 1]
                assert ident == pool[picked[turn]][0] and abs(value - values[turn]) < 1e-6 * max(1, value), (name, area, turn)


def test_ranks_without_keys_are_not_one_task(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0.5, 1.5, 2.5, rng.random()]), float(i % 9)) for i in range(300)] + [(300, None, 1.0), (301, math.nan, 1.0), (302, math.inf, 1.0)]
    universe = spark.createDataFrame(rows, "row_id long, f1 double, f2 double").repartition(5)
    protos = universe.filter("row_id < 12")
    features = ["f1", "f2"]
    keyed = lambda df: df.withColumn("one", F.lit(1))
    for make, names in (
        (lambda u, p, k: support.geometry(u, p, features, k), ["support_rank"]),
        (lambda u, p, k: support.consensus(u, p, features, k), ["consensus", "uncertainty"]),
        (lambda u, p, k: support.finite_geometry(u, p, features, k), ["support_rank"]),
        (lambda u, p, k: support.persistent_support(u, p, features, k), ["second_rank", "mean_two_rank"]),
        (lambda u, p, k: support.local_scale(u, p, features, k, 3, 0.2), ["nearest"]),
    ):
        out = make(universe, protos, [])
        got = {r[0]: r[1:] for r in out.select("row_id", *names).collect()}
        want = {r[0]: r[1:] for r in make(keyed(universe), keyed(protos), ["one"]).select("row_id", *names).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "rank(" not in plan and "row_number() windowspecdefinition(nearest" not in plan  # these would be one task
