"""The step of all distance joins: what it costs, and its cells."""

import math

from pyspark.sql import functions as F

from fieldquarry.operators import joins
from fieldquarry.plans.views import rounded_metres


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_neither_side_is_broadcast_and_rows_are_dealt_before_they_are_placed(spark):
    # tables of few bytes are one task, and small enough for a broadcast by their size
    points = spark.range(0, 200, 1, 1).select(F.lit(1).alias("k"), F.col("id").alias("row_id"), (F.col("id") / 1000.0 + 40).alias("latitude"), (F.col("id") / 900.0 + 9).alias("longitude"))
    for df in (joins.within_radius(points, 500.0, ["k"]), joins.pair_distances(points.withColumnRenamed("row_id", "a"), points.withColumnRenamed("row_id", "b"), ["k"], "a", "b")):
        plan = _plan(df)
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
        # below the last explode there is an exchange
        assert "Exchange" in plan[plan.index("Generate explode") :].split("Range")[0].split("SortMergeJoin")[0]


def test_cells_of_few_longitudes(spark):
    rows = [(i, lat, lon) for i, (lat, lon) in enumerate([(89.99, 0.0), (89.99, 180.0), (89.9, -90.0), (89.5, 91.0), (-89.95, 10.0), (-89.95, -170.0), (0.0, 179.99), (0.0, -179.99), (0.01, 0.0)])]
    points = spark.createDataFrame(rows, "row_id long, latitude double, longitude double").withColumn("k", F.lit(1))

    def apart(p, q):
        a, b, c, d = map(math.radians, (p[1], p[2], q[1], q[2]))
        return 2 * joins.EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))

    for radius in (3_000.0, 70_000.0, 9_000_000.0, joins.FARTHEST):
        got = [(r.a, r.b) for r in joins.within_radius(points, radius, ["k"]).collect()]
        named = points.withColumn("reach", F.lit(radius))
        other = joins.radius_join(named.withColumnRenamed("row_id", "a"), named.withColumnRenamed("row_id", "b"), "reach", ["k"])
        want = sorted((p[0], q[0]) for p in rows for q in rows if apart(p, q) <= radius)
        assert sorted(got) == want and sorted((r.a, r.b) for r in other.collect()) == want


def test_rounded_metres(spark):
    df = spark.createDataFrame([(0.0,), (1234.56789,), (1234.5674,), (0.0625,), (None,)], "m double")
    assert [r.m for r in rounded_metres(df, "m").collect()] == [0.0, 1234.568, 1234.567, 0.063, None]
