"""Draws by threshold against complete orders, with few and with many draws filled up."""

import hashlib

import pytest
from pyspark.sql import functions as F

from fieldquarry.operators import resampling


def _ordered(pool, size, draws, seed):
    out = set()
    for key in {k for k, _ in pool}:
        ids = [i for k, i in pool if k == key]
        for d in range(1, draws + 1):
            order = sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{d}:{i}".encode()).hexdigest(), i))
            out |= {(key, i, d, n) for n, i in enumerate(order[: size.get(key) or 0], 1)}
    return out


@pytest.mark.parametrize("slack", [6.0, 0.0, -1.5])
def test_draws_are_those_of_a_complete_order(spark, monkeypatch, slack):
    monkeypatch.setattr(resampling, "SLACK", slack)
    pool = [("a", i) for i in range(3000)] + [("b", i) for i in range(40)] + [("c", 1), ("d", 5), ("e", 6), (None, 7), (None, 8)]
    size = {"a": 12, "b": 4, "c": 3, "d": 0, "e": None, None: 1, "none": 2}
    rows, sizes = spark.createDataFrame(pool, "k string, id long").withColumn("extra", F.lit(1)), spark.createDataFrame([*size.items()], "k string, quota int")
    told = []
    got = resampling.bottom_draws(rows, sizes, 9, ["k"], "id", seed=3, refilled=told)
    assert {(r.k, r.id, r.draw, r._k) for r in got.collect()} == _ordered(pool, size, 9, 3)
    assert (told[0] == 0) if slack > 1 else (told[0] > 0)


def test_what_is_sorted_follows_the_size_and_not_the_pool(spark, monkeypatch):
    written = {}

    def noted(df, tag, plain=resampling.materialise):
        out = plain(df, tag)
        written[tag] = out.count()
        return out

    monkeypatch.setattr(resampling, "materialise", noted)
    rows = spark.range(20_000).withColumnRenamed("id", "site_id")
    got = resampling.random_sets(rows, 10, 5, [])
    assert {(None, r.site_id, r.draw) for r in got.collect()} == {t[:3] for t in _ordered([(None, i) for i in range(20_000)], {None: 10}, 5, 0)}
    assert 5 * 10 <= written["draw-few"] <= 5 * 60 and written["draw-short"] == 0
    assert resampling.random_sets(rows.limit(0), 10, 5, []).count() == 0
