"""Query of near-duplicate detection, with brute-force SQL."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .minhash import near_duplicates


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op1_minhash_near_dedup": op1_minhash_near_dedup}
ORACLE = {
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n, s, hash(list_sort(s)) AS h FROM s),
reps AS (SELECT h, min(doc_id) AS rep, any_value(n) AS n FROM n WHERE n > 0 GROUP BY h),
x AS (SELECT rep, reps.n, unnest(s) AS g FROM reps JOIN n ON doc_id = rep),
i AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) + any_value(b.n) AS t, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
e AS (SELECT a, b FROM i WHERE 100 * k >= 85 * (t - k)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT rep AS v, rep AS c FROM reps UNION SELECT r.v, e2.b FROM r JOIN both_ways e2 ON r.c = e2.a),
c AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(c.c, n.doc_id) AS component_id, coalesce(c.c, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN reps ON n.n > 0 AND n.h = reps.h LEFT JOIN c ON c.v = reps.rep
"""
}
