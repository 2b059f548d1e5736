"""Payloads are parsed once."""

from fieldquarry.sources import network


def test_elements_are_parsed_once(spark):
    payloads = spark.createDataFrame([("7", '{"elements":[{"type":"node","id":3},{"type":"way","id":4,"nodes":[3]}]}')], "area string, payload string")
    items = network.elements(payloads)
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan and "Generate" not in plan
    assert [(r.area, r.place, r.type, r.id) for r in items.orderBy("place").collect()] == [("7", 0, "node", 3), ("7", 1, "way", 4)]
