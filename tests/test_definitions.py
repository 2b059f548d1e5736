"""Definitions checked by sequences, exhaustive search and hand-made rows: tiles, greedy choices by bounds, gaps, catchments, inference."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldquarry.operators import graph, models, resampling, selection, support, tiles
from fieldquarry.operators.pairs import metres


def in_order(lat, lon, limit):
    """(founders, kept) by taking points one by one."""
    founder, kept = [], []
    for i in range(len(lat)):
        apart = metres(lat[i], lon[i], lat[:i], lon[:i])
        fits = sorted((apart[[j for j in range(i) if founder[j] == f]].max(), f) for f in set(founder))
        founder.append(fits[0][1] if fits and fits[0][0] <= limit else i)
        kept.append(not any(kept[j] and apart[j] <= limit for j in range(i)))
    return founder, kept


@pytest.mark.parametrize("shape", ["rows", "cloud over the date line"])
def test_tiles_decide_as_the_sequence(spark, shape):
    rng = np.random.default_rng(1)
    if shape == "rows":
        r, c = np.divmod(np.arange(196), 14)
        lat, lon = 35 + r * 0.001, 139 + c * 0.0012
    else:
        lat, lon = 35 + rng.normal(0, 0.008, 150), (180 + rng.normal(0, 0.008, 150)) % 360
        lon = np.where(lon > 180, lon - 360, lon)
    founder, kept = in_order(lat, lon, 150.0)
    frame = spark.createDataFrame([(i, 1, float(a), float(b), 150.0) for i, (a, b) in enumerate(zip(lat, lon))], "node long, component long, latitude double, longitude double, limit double")
    told = []
    linked = tiles.in_tiles(frame, 300.0 * (1 + 1e-9) + 1e-3, tiles.link_step, F.col("node"), 80, told).collect()
    thinned = tiles.in_tiles(frame, 150.0, tiles.thin_step, F.lit(False), 80, told).collect()
    assert {r.node: r.value for r in linked} == dict(enumerate(founder)) and {r.node: r.value for r in thinned} == dict(enumerate(kept))
    assert 1 < max(told) < 24  # far fewer than points wait for each other in a row


def test_close_pairs_are_all_pairs():
    rng = np.random.default_rng(4)
    for lat, lon in ((rng.normal(35, 0.02, 200), rng.normal(139, 0.02, 200)), (rng.uniform(89.8, 90, 150), rng.uniform(-180, 180, 150))):
        i, j, apart = tiles.close_pairs(lat, lon, 1500.0, np.arange(len(lat)))
        want = {(a, b) for a in range(len(lat)) for b in range(a) if metres(lat[a], lon[a], lat[b], lon[b]) <= 1500.0}
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(want) and (apart <= 1500.0).all()


@pytest.fixture(scope="module")
def patches(spark):
    rng = random.Random(8)
    rows = [(i, i % 2, (i // 2) % 4, 35 + rng.random() * 0.3, 139 + rng.random() * 0.3, rng.random(), rng.random(), rng.random(), 5.0 + (i // 2) % 4, [rng.random(), rng.random()]) for i in range(60)]
    kind = "candidate_patch_id long, pool long, component long, latitude double, longitude double, support double, cost double, gap double, spatial_scale_km double, responsibility array<double>"
    targets = [(i % 2, i, t, 0.05) for i in range(60) for t in {i % 9, i % 5}]
    return rows, spark.createDataFrame(rows, kind), spark.createDataFrame(targets, "pool long, patch long, target long, weight double"), targets


def greedy(rows, targets, k, w):
    out = {}
    for pool in (0, 1):
        own, state, picked, covered = [r for r in rows if r[1] == pool], [0.0, 0.0], [], set()
        while len(picked) < k:

            def key(r):
                same = [p for p in picked if p[2] == r[2]]
                cover = sum(max(a - s, 0) for a, s in zip(r[9], state)) / 2
                spread = min(1.0, min(metres(r[3], r[4], np.array([p[3]]), np.array([p[4]]))[0] for p in same) / 1000 / r[8]) if same else 1.0
                catch = sum(t[3] for t in targets if t[0] == pool and t[1] == r[0] and t[2] not in covered)
                value = w[0] * cover + w[1] * r[5] + w[2] * (not same) - w[3] * r[6] + w[4] * spread + w[5] * r[7] + w[6] * catch
                return (round(value, 12), round(catch, 12), round(cover, 12), round(spread, 12), r[7], r[5], -r[6], -r[0])

            best = max((r for r in own if r not in picked), key=key)
            picked.append(best)
            state = [max(a, s) for a, s in zip(best[9], state)]
            covered |= {t[2] for t in targets if t[1] == best[0]}
        out[pool] = [p[0] for p in picked]
    return out


@pytest.mark.parametrize("block", [2, 7, 999])
def test_patch_choices_by_bounds_are_the_greedy_ones(patches, block):
    rows, frame, reach, targets = patches
    w = (1.0, 0.2, 0.3, 0.1, 0.4, 0.2, 1.5)
    got = selection.prototype_greedy(frame, 8, ["pool"], weights=w, targets=reach, block=block).collect()
    assert {p: [r.candidate_patch_id for r in sorted((r for r in got if r.pool == p), key=lambda r: r.decision_rank)] for p in (0, 1)} == greedy(rows, targets, 8, w)


def test_portfolios_do_not_depend_on_the_block(spark):
    rng = random.Random(3)
    kinds = ["Occurrence-supported", "Habitat-match", "Survey-gap", "Environmental-test", "other", None]
    rows = [(i, i % 2, f"a{rng.randrange(4)}", 35 + rng.random(), 139 + rng.random(), rng.choice(kinds), rng.random(), rng.random(), rng.random(), rng.choice([None, rng.random()])) for i in range(80)]
    frame = spark.createDataFrame(rows, "row_id long, pool long, survey_area_id string, latitude double, longitude double, candidate_type string, discovery_value double, learning_value double, accessibility_score double, survey_gap double")
    for k in (3, 9):
        want = sorted(map(tuple, selection.portfolio(frame, "Balanced", k, ["pool"]).collect()))
        assert len(want) == 2 * k and sorted(map(tuple, selection.portfolio(frame, "Balanced", k, ["pool"], block=1).collect())) == want


def test_catchments_weigh_to_one_and_cover_themselves(spark):
    rows = [(1, "p", "a", 35.0, 139.0), (2, "p", "b", 35.001, 139.0), (3, "p", "b", None, None), (4, "p", "c", None, 139.0), (5, "q", "d", 35.0, 139.0)]
    got = graph.catchments(spark.createDataFrame(rows, "row_id long, survey_area_id string, candidate_patch_id string, latitude double, longitude double"), 500.0, []).collect()
    assert {(r.patch, r.target) for r in got} == {(a, b) for a in "ab" for b in "ab"} | {("c", "c"), ("d", "d")}
    weight = {r.target: r.weight for r in got}
    raw = {"a": 0.5 / math.sqrt(3), "b": 0.5 / math.sqrt(3), "c": 1 / math.sqrt(3), "d": 1.0}
    assert all(weight[t] == pytest.approx(raw[t] / sum(raw.values())) for t in raw)


def test_gaps_and_scales(spark):
    rows = spark.createDataFrame([(i, "a", float(i)) for i in range(11)] + [(20, "a", None), (30, "b", None), (40, "c", 0.0)], "row_id long, area string, nearest_training_km double")
    gap = {r.row_id: r.gap for r in support.survey_gap(rows, "area").collect()}
    assert gap[5] == pytest.approx(5 / 9.5) and gap[10] == gap[20] == gap[30] == 1.0 and gap[40] == 0.0
    points = [(i, "a", 35 + 0.01 * i * i, 139.0) for i in range(7)] + [(50, "b", 35.0, 139.0), (60, "c", 35.0, 139.0), (61, "c", 35.0001, 139.0)]
    got = {r.area: r.spatial_scale_km for r in support.spatial_scale(spark.createDataFrame(points, "row_id long, area string, latitude double, longitude double"), ["area"]).collect()}
    apart = [metres(a[2], a[3], np.array([b[2]]), np.array([b[3]]))[0] / 1000 for a, b in itertools.combinations(points[:7], 2)]
    assert got == {"a": pytest.approx(np.quantile(apart, 0.9)), "b": 1.0, "c": 0.25}


def test_a_left_out_prototype_need_not_be_a_cell(spark):
    cells = spark.createDataFrame([(i, "a", i / 10, None if i == 9 else 0.0) for i in range(10)], "row_id long, area string, f double, g double")
    protos = spark.createDataFrame([(100, "a", 0.0, 0.0), (101, "a", 0.1, 0.0), (102, "a", 0.25, 0.0), (103, "a", 5.0, 0.0)], "row_id long, area string, f double, g double")
    got = sorted(map(tuple, support.adaptive_levels(cells, protos, ["f", "g"], ["area"], [0.1, 0.5, 0.9], 0.7).collect()))
    ranks = []
    f = np.array([0.0, 0.1, 0.25, 5.0])
    for out in range(4):
        near = np.abs(np.arange(9)[:, None] / 10 - np.delete(f, out)).min(axis=1)
        own = np.abs(f[out] - np.delete(f, out)).min()
        ranks.append(((near < own - 1e-12).sum() + ((abs(near - own) < 1e-12).sum() + 2) / 2) / 10)
    assert [r[2] for r in got] == [pytest.approx(np.mean([x <= q + 1e-12 for x in ranks])) for q in (0.1, 0.5, 0.9)]
    met = [q for q, r in zip((0.1, 0.5, 0.9), got) if r[2] >= 0.7]
    assert {r[4] for r in got} == {met[0] if met else 1.0}


def test_half_subsets_exhaustively(spark):
    rng = random.Random(1)
    values = {"x": [rng.uniform(-1, 1.3) for _ in range(7)], "y": [0.5, -0.5], "one": [1.0], "many": [0.1] * 30}
    frame = spark.createDataFrame([(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)] + [("x", 99, None)], "cohort string, pair_id long, lift double")
    got = {r.cohort: r for r in resampling.half_subsets(frame, ["cohort"], threshold=0.2).collect()}
    for k in ("x", "y"):
        means = [np.mean(c) for c in itertools.combinations(values[k], len(values[k]) // 2)]
        r = got[k]
        assert (r.computed, r.subsets, r.positive_share, r.threshold_share) == (True, len(means), pytest.approx(np.mean(np.array(means) > 1e-12)), pytest.approx(np.mean(np.array(means) >= 0.2 - 1e-12)))
        assert (r.q025, r.q975) == (pytest.approx(np.quantile(means, 0.025)), pytest.approx(np.quantile(means, 0.975)))
    assert not got["one"].computed and not got["many"].computed and got["many"].subsets is None


def test_policies_need_all_folds_and_ties_go_to_the_broader_then_the_simpler(spark):
    def rows(key, k, q, recalls):
        return [(key, k, q, i, r is not None, r) for i, r in enumerate(recalls)]

    inner = rows("a", 1, 1.0, [0.2, 0.2]) + rows("a", 1, 0.5, [0.9, None]) + rows("a", 3, 0.5, [0.4, 0.4]) + rows("a", 2, 0.5, [0.3, 0.5]) + rows("a", 2, 0.25, [0.4, 0.4])
    inner += rows("b", 1, 1.0, [0.2, None]) + rows("b", 2, 0.5, [0.9, 0.9]) + rows("c", 1, 1.0, [0.5, 0.5]) + rows("c", 2, 0.5, [0.5, 0.4]) + rows("d", 1, 1.0, [0.1, 0.1]) + rows("d", 2, 0.5, [0.9])
    frame = spark.createDataFrame(inner, "key string, k int, q double, fold int, feasible boolean, recall double")
    assert {r.key: (r.k, r.q) for r in models.nested_policy_choice(frame, ["key"], 2).collect()} == {"a": (2, 0.5), "b": (1, 1.0), "c": (1, 1.0), "d": (1, 1.0)}


def test_calibration_lines_minimise_the_loss(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(0.01, 0.99, 400)
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-(0.4 + 0.7 * np.log(p / (1 - p)))))).astype(int)
    rows = [("x", float(a), int(b)) for a, b in zip(p, y)] + [("one", 0.3, 1), ("one", 0.6, 1)]
    got = {r.g: r for r in models.calibration_lines(spark.createDataFrame(rows, "g string, p double, presence int"), ["g"]).collect()}
    assert got["one"].calibration_slope is None
    b, a, x = got["x"].calibration_slope, got["x"].calibration_intercept, np.log(p / (1 - p))
    left = y - 1 / (1 + np.exp(-(a + b * x)))
    assert abs(left.sum()) < 1e-8 and abs((left * x).sum() - 1e-6 * b) < 1e-8


def test_shrinkage_is_towards_the_training_prevalence(spark):
    rows = [("t", 1, 0.5, 1), ("t", 1, 0.5, 1), ("u", 1, 0.5, 0)]
    frame = spark.createDataFrame(rows, "taxon string, fold int, a double, presence int")
    weights = spark.createDataFrame([(0, 1.0)], "weight_id long, a double")
    split = spark.createDataFrame([("t", True), ("u", False)], "taxon string, calibration boolean")
    prior = spark.createDataFrame([("t", 1, 1, 10)], "taxon string, fold int, training_presences int, training_rows int")
    got = {r.shrinkage: r for r in models.shrinkage_search(frame, ["a"], weights, [0.5, 1.0], split, prior).collect()}
    assert got[0.5].calibration_log_loss == pytest.approx(-math.log(0.1 + 0.5 * 0.4)) and got[1.0].recommended


def test_regions_by_dominant_hubs_are_the_sequence(spark):
    rng = random.Random(6)
    rows = [(i, "ab"[i % 2], 35 + rng.choice([0, 0.4]) + rng.gauss(0, 0.05), 139 + rng.gauss(0, 0.1)) for i in range(160)]
    rows += [(200 + i, "a", 36.5, 139.0 + 0.05 * i) for i in range(9)]  # equal counts in a row
    want = {}
    for area in "ab":
        left, turn = [r for r in rows if r[1] == area], 0
        while left:
            turn += 1
            lat, lon = np.array([r[2] for r in left]), np.array([r[3] for r in left])
            inside = [metres(r[2], r[3], lat, lon) <= 6000.0 for r in left]
            hub = min(range(len(left)), key=lambda i: (-inside[i].sum(), left[i][0]))
            want |= {r[0]: (left[hub][0], turn) for r, near in zip(left, inside[hub]) if near}
            left = [r for r, near in zip(left, inside[hub]) if not near]
    told = []
    frame = spark.createDataFrame(rows + [(999, "a", None, 139.0)], "row_id long, area string, latitude double, longitude double").repartition(3)
    got = {r.row_id: (r.hub, r.region_id) for r in graph.survey_regions(frame, 6000.0, ["area"], told=told).collect()}
    assert got == want and told[0] < max(t for _, t in want.values())
    assert {i for i, (_, t) in want.items() if t <= 2} == {r.row_id for r in graph.survey_regions(frame, 6000.0, ["area"], most=2).collect()}
