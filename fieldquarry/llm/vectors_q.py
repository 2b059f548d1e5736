"""Queries of the vector searches, with brute-force SQL."""

from pyspark.sql import DataFrame, SparkSession

from .ann import nearest
from .common import table
from .topk import exact_topk

EVERY_100TH = "id % 100 = 0"


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), EVERY_100TH)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), EVERY_100TH)


_VECTORS = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: {each}) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 {more}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, {score} AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {way}, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, {out} FROM r WHERE k <= 10
"""
QUERIES = {"op3_exact_topk": op3_exact_topk, "op9_nearest_neighbours": op9_nearest_neighbours}
ORACLE = {
    "op3_exact_topk": _VECTORS.format(each="floor(1024 * CAST(x AS DOUBLE))", more="", score="list_inner_product(q.x, c.x)", way="DESC", out="CAST(score AS BIGINT) AS score"),
    "op9_nearest_neighbours": _VECTORS.format(
        each="CAST(x AS DOUBLE)", more="AND len(list_filter(embedding, lambda x: x <> 0)) > 0", score="list_distance(q.x, c.x)", way="", out="score"
    ),
}
