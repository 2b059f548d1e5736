"""Query of the conversations' prefix trie, with SQL over lists of turns."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .conversations import prefix_trie, rebuilt


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations"), group=5, longest=9))


# crc32 of the decimal text, bit by bit
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))))"""

_TRIE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(sha256(length(role)::VARCHAR || ':' || role || ':' || text) || ':' || strlen(text)::VARCHAR ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
h AS (SELECT conv_id, turns, ({_CRC}) % 9 AS h FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.turns[:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, len(turns) AS whole, unnest(range(len(turns) + 1)) AS depth, turns FROM r),
q AS (SELECT conv_id, whole, depth, sha256(array_to_string(turns[:depth], ',')) AS node, sha256(array_to_string(turns[:depth - 1], ',')) AS up,
  CASE WHEN depth = 0 THEN 0 ELSE split_part(turns[depth], ':', 2)::BIGINT END AS size FROM p),
v AS (SELECT depth, node, CASE WHEN depth = 0 THEN NULL ELSE any_value(up) END AS up, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n,
  sha256(coalesce(string_agg(CASE WHEN whole = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends FROM q GROUP BY depth, node),
k AS (SELECT a.depth, a.node, count(b.node) AS kids FROM v a LEFT JOIN v b ON b.up = a.node AND b.depth = a.depth + 1 GROUP BY ALL),
-- a node's ancestors are the prefixes of its smallest member
s AS (SELECT q.depth, q.node, sum((v.n - 1) * v.size) AS saved, count(*) FILTER (k.kids = 0) AS leaves
  FROM v JOIN k USING (depth, node) JOIN q ON q.conv_id = v.conv_id AND q.depth <= v.depth GROUP BY q.depth, q.node)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n::BIGINT AS n_convs, k.kids::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
FROM v JOIN k USING (depth, node) JOIN s USING (depth, node) LEFT JOIN v u ON u.node = v.up AND u.depth = v.depth - 1
"""
QUERIES = {"op12_conversation_trie": op12_conversation_trie}
ORACLE = {"op12_conversation_trie": _TRIE}
