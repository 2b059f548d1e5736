"""Survey tables made of the given tables by integer arithmetic, in SQL that both engines read alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EARTH = 6371008.8


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """SQL of the great-circle distance in metres."""
    a = f"pow(sin((radians({lat2})-radians({lat1}))/2),2)+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin((radians({lon2})-radians({lon1}))/2),2)"
    return f"(2*{EARTH}e0*asin(sqrt(greatest(0e0,least(1e0,{a})))))"


_PLACE = "30e0 + {area}*0.25e0 + CAST(({id}*{a})%10007 AS DOUBLE)/10007e0*0.2e0 AS latitude, 130e0 + {area}*0.25e0 + CAST(({id}*{b})%10009 AS DOUBLE)/10009e0*0.2e0 AS longitude"
_CANDIDATE_PLACE = _PLACE.format(area="c_nationkey", id="c_custkey", a=7919, b=104729)
VIEWS = {
    "candidates": f"""SELECT c_custkey AS row_id, c_custkey AS site_id, c_custkey AS cand_id, c_nationkey AS survey_area_id, {_CANDIDATE_PLACE},
  (c_acctbal+1000e0)/11000e0 AS priority_score,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Occurrence-supported survey range' WHEN 'AUTOMOBILE' THEN 'Habitat-match' WHEN 'MACHINERY' THEN 'Environmental-test'
    WHEN 'HOUSEHOLD' THEN 'Survey-gap' ELSE 'Model-only exploration' END AS candidate_type,
  CASE WHEN c_custkey%5=0 THEN NULL ELSE CAST(c_custkey%97 AS DOUBLE)/96e0 END AS analogue_score,
  CASE WHEN c_custkey%3=0 THEN NULL ELSE CAST(c_custkey%89 AS DOUBLE)/88e0 END AS sdm_suitability,
  CAST(c_custkey%61 AS DOUBLE) AS slope, CASE WHEN c_custkey%7=0 THEN NULL ELSE CAST(c_custkey%701 AS DOUBLE) END AS distance_to_road_m,
  CASE c_custkey%4 WHEN 0 THEN 'yes' WHEN 1 THEN 'water' WHEN 2 THEN 'unknown' ELSE 'TRUE' END AS is_land, CAST((c_custkey*37)%360 AS DOUBLE) AS aspect FROM customer""",
    "detections": f"SELECT s_suppkey AS detection_cluster_id, s_suppkey AS row_id, s_nationkey AS survey_area_id, {_PLACE.format(area='s_nationkey', id='s_suppkey', a=6007, b=90001)}, s_acctbal AS value FROM supplier",
    "occurrences": """SELECT event_id AS row_id, event_id AS occ_id, event_type AS taxon, 34e0 + CAST((user_id*7919 + event_id%7)%997 AS DOUBLE)/997e0 AS latitude,
  138e0 + CAST((user_id*104729 + event_id%11)%991 AS DOUBLE)/991e0 AS longitude FROM events""",
    "edges": """SELECT DISTINCT least(a.l_suppkey,b.l_suppkey) AS from_node_id, greatest(a.l_suppkey,b.l_suppkey) AS to_node_id
FROM lineitem a JOIN lineitem b ON a.l_orderkey=b.l_orderkey AND b.l_linenumber=a.l_linenumber+1 WHERE a.l_suppkey<>b.l_suppkey""",
    "folds": """SELECT o_custkey%48 AS pair_id, CAST(o_orderkey%5+1 AS INT) AS repeat, CASE CAST(floor(o_orderkey/5e0) AS BIGINT)%3 WHEN 0 THEN 'rule' WHEN 1 THEN 'random' ELSE 'environment' END AS method,
  CASE o_custkey%2 WHEN 0 THEN 'plant' ELSE 'animal' END AS taxon_group, CAST(min(o_orderkey)%101 AS DOUBLE)/100e0 AS recall, CAST(count(*) AS DOUBLE) AS candidate_pool, count(*)>2 AS rankable_fold, min(o_orderkey)%9<>0 AS usable
  FROM orders GROUP BY 1,2,3,4""",
    # points of ways: an order is a way, a supplier a place; places have a number of their own for every two areas
    "ways": """SELECT CAST(floor(o_orderkey/1024e0) AS BIGINT) AS area, o_orderkey AS way, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_suppkey) AS pos, l_suppkey + 10000000*CAST(floor(o_orderkey/2048e0) AS BIGINT) AS node,
  30e0 + s_nationkey*0.25e0 + CAST((s_suppkey*6007)%10007 AS DOUBLE)/10007e0*0.2e0 AS latitude, 130e0 + s_nationkey*0.25e0 + CAST((s_suppkey*90001)%10009 AS DOUBLE)/10009e0*0.2e0 AS longitude,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'ferry' WHEN '2-HIGH' THEN 'path' ELSE 'residential' END AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""",
    "cells": """SELECT CAST(p_partkey%4 AS INT) AS area, CAST(floor(floor(p_partkey/4)/20) AS INT) AS r, CAST(floor(p_partkey/4)%20 AS INT) AS c, p_partkey AS row_id,
  CASE WHEN p_partkey%13=0 THEN NULL ELSE CAST((p_partkey*7919)%1009 AS DOUBLE) END AS height, CAST((p_partkey*31)%3 AS INT) AS kind FROM part
  WHERE floor(floor(p_partkey/4)/20) < (SELECT floor(count(*)/80) FROM part)""",
    "predictions": """SELECT l_orderkey AS row_id, CAST(l_suppkey%5 AS INT) AS fold, CASE l_linenumber%3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS algorithm,
  CASE WHEN (l_orderkey*7+l_partkey)%10 < 4 THEN 1 ELSE 0 END AS presence, CAST(1+(l_partkey*13 + l_orderkey%50)%98 AS DOUBLE)/100e0 AS p FROM lineitem""",
}
_DIMS = 6
FEATURES = [f"f{i + 1}" for i in range(_DIMS)]


def _universe(index: str) -> str:
    features = ", ".join(f"CAST(embedding[{i if index == 'spark' else i + 1}] AS DOUBLE) AS f{i + 1}" for i in range(_DIMS))
    return f"""SELECT vec_id AS row_id, vec_id AS cell_id, label AS survey_area_id, 35e0 + label*0.5e0 + CAST((vec_id*7919)%1009 AS DOUBLE)/1009e0*0.1e0 AS latitude,
  139e0 + label*0.5e0 + CAST((vec_id*104729)%1013 AS DOUBLE)/1013e0*0.1e0 AS longitude, {features} FROM embeddings"""


def _top(index: str, feature: str, n: int) -> str:
    """The cells of each area where a feature is highest."""
    columns = ", ".join(["row_id", "row_id AS detection_cluster_id", "survey_area_id", "latitude", "longitude", *FEATURES])
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY survey_area_id ORDER BY {feature} DESC, row_id) AS place FROM ({_universe(index)}) AS u) AS t WHERE place <= {n}"


def _derived(index: str) -> dict[str, str]:
    """The universe of cells, its known points (prototypes), and points found later."""
    return {"universe": _universe(index), "known": _top(index, "f6", 12), "later": _top(index, "f5", 8)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = (VIEWS | _derived("spark"))[name]
    tables = [t for t in ("customer", "supplier", "events", "lineitem", "orders", "part", "embeddings") if f"FROM {t}" in sql or f"JOIN {t}" in sql]
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def with_views(sql: str) -> str:
    """The statement with the views that it names in front."""
    import re

    both = VIEWS | _derived("duckdb")
    used = [n for n in both if re.search(rf"(FROM|JOIN|,) {n}\b", sql)]
    if not used:
        return sql
    head = ", ".join(f"{n} AS ({both[n]})" for n in used)
    body = sql.lstrip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:]}"
    return f"WITH {head}, {body[4:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


class Book:
    """Queries of a module, each with its SQL where there is one."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
            self.queries[f.__name__] = lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))
            if sql:
                self.oracle[f.__name__] = with_views(sql)
            return f

        return add


def rounded(df: DataFrame, digits: int = 6, **by) -> DataFrame:
    """Doubles rounded, so that the order of summation doesn't show."""
    return df.select(*[(F.round(c, by.get(c, digits)) + F.lit(0.0)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def rounded_metres(df: DataFrame, column: str, digits: int = 3) -> DataFrame:
    """A distance rounded half up in doubles, for lists of pairs: `round` goes through decimals, at twice the cost of the distance."""
    return df.withColumn(column, F.floor(F.col(column) * float(10**digits) + 0.5) / float(10**digits))
