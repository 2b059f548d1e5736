"""Queries and candidates in blocks: the skeleton of the two vector searches.

Candidates are dealt into blocks of bounded size by a hash of their id and queries into blocks likewise; each query
block meets each candidate block in one group of bounded size, which gives each of its queries at most k rows. Within a
group, tiles of ``TILE_QUERIES`` by ``TILE`` are computed one after another, so large blocks, of which few copies travel,
need little memory. The best k of all groups are taken per query after a second, small shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates and queries of a group at most for vectors of up to ``DIMENSIONS``, fewer of longer ones, and of a tile.
CANDIDATES, QUERIES, DIMENSIONS = 8192, 16384, 128
TILE, TILE_QUERIES = 1024, 512

#: (candidate ids, candidate matrix) to a function of (query ids, query matrix, each query's k-th best score so far), which gives (query id, candidate id, score), at most k of each query
Prepare = Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]]


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """(id, x array<double>) of rows with an id and a vector of finite components only; ``zero``: all-zero ones too.

    Of several such rows with one id that of the smallest vector, component by component, counts.
    """
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter("id is not null and size(x) > 0")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.filter(~F.coalesce(bad, F.lit(True)))
    rows = rows if zero else rows.filter(F.exists("x", lambda v: v != 0))
    return rows.groupBy("id").agg(F.min("x").alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def best_of(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int, ascending: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, candidate, score) of each query, best first, ties to the smaller candidate id."""
    by = np.lexsort((v, s if ascending else -s, q))
    q, v, s = q[by], v[by], s[by]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], v[first], s[first]


def _kth(q_ids: np.ndarray, held: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, none: float) -> np.ndarray:
    """The k-th best score that each query has, ``none`` where it has fewer."""
    out = np.full(len(q_ids), none)
    q, _, s = held
    lo, hi = np.searchsorted(q, q_ids), np.searchsorted(q, q_ids, "right")
    full = hi - lo >= k
    out[full] = s[lo[full] + k - 1]
    return out


def block_search(rows: DataFrame, is_query, k: int, prepare: Prepare, score_type: str, ascending: bool) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all other rows of its dimension, ties to the smaller id."""
    is_query = F.expr(is_query) if isinstance(is_query, str) else is_query
    size = rows.select(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(F.size("x")).alias("d")).first()
    longer = max(1, math.ceil((size.d or 1) / DIMENSIONS))
    q_blocks = max(1, math.ceil(size.q * longer / QUERIES))
    # no smaller than a tile, no larger than a group, and if there is choice enough groups for all tasks
    tasks = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c_blocks = max(1, math.ceil(size.n * longer / CANDIDATES), min(math.ceil(size.n / TILE), tasks // q_blocks))
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    rows = rows.withColumn("d", F.size("x"))
    cands = rows.withColumn("c", deal(c_blocks, 1)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)).cast("array<long>"))).withColumn("kind", F.lit(1))
    asked = rows.filter(is_query).withColumn("q", deal(q_blocks, 2)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)).cast("array<long>"))).withColumn("kind", F.lit(0))
    names = ["id", "x", "d", "c", "q", "kind"]
    both = asked.select(names).unionByName(cands.select(names))

    kind_of = pa.float64() if score_type == "double" else pa.int64()

    def run(group: pa.Table) -> pa.Table:
        kind = group["kind"].to_numpy()
        ids, x = group["id"].to_numpy(), _matrix(group["x"].combine_chunks())
        q_ids, q, ids, x = ids[kind == 0], x[kind == 0], ids[kind == 1], x[kind == 1]
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, kind_of.to_pandas_dtype()))
        held = {b: none for b in range(0, len(q_ids), TILE_QUERIES)}
        for a in range(0, len(ids) if len(q_ids) else 0, TILE):
            tile = prepare(ids[a : a + TILE], x[a : a + TILE])
            for b in held:
                own = q_ids[b : b + TILE_QUERIES]
                # a candidate of a later tile must be at least as good as the k-th best of earlier ones
                got = tile(own, q[b : b + TILE_QUERIES], _kth(own, held[b], k, np.inf if ascending else -np.inf))
                held[b] = best_of(*map(np.concatenate, zip(held[b], got)), k, ascending)
        best = tuple(map(np.concatenate, zip(none, *held.values())))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(c, t) for c, t in zip(best, (pa.int64(), pa.int64(), kind_of))))))

    found = both.groupBy("c", "q", "d").applyInArrow(run, f"query_id long, vec_id long, score {score_type}")
    order = [F.col("score").asc() if ascending else F.col("score").desc(), F.col("vec_id").asc()]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias("rank")
    return found.select("query_id", "vec_id", "score", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
