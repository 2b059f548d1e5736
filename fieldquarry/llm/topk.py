"""Exact top-k inner products by no-random-access aggregation over sorted lists.

In a block every dimension has its candidates sorted by component; a query reads a list from the end that its own
component's sign makes best. After the first L entries of every list, a candidate's score lies between its seen part
plus the least, and plus the most, that its unseen entries can still add. Reading goes deeper until, for each query,
so few candidates can still reach the k-th lower bound, or the k-th score of tiles before, that their scores are worth resolving.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import best_of, block_search, usable

#: Entries read of every list at first, and how many times more with each further reading.
FIRST_DEPTH, DEEPER = 64, 4


def nra_tile(k: int):
    def prepare(ids: np.ndarray, x: np.ndarray):
        """The lists of a tile, sorted once for all its queries."""
        n = len(x)
        order = np.argsort(-x, axis=0, kind="stable")
        ranks = np.empty_like(order)
        np.put_along_axis(ranks, order, np.arange(n)[:, None], axis=0)
        down = np.take_along_axis(x, order, axis=0)
        largest = np.abs(x).max(axis=0)
        ints = x.astype(np.int64)

        def tile(q_ids: np.ndarray, q: np.ndarray, held: np.ndarray):
            m = len(q)
            if q.shape[1] * max(1.0, largest.max()) * max(1.0, np.abs(q).max()) >= 2.0**62:
                raise OverflowError("scores of such components may pass 64 bits")
            up, un = np.maximum(q, 0.0), np.minimum(q, 0.0)
            # bounds are sums of d products in floating point; this slack covers their rounding
            slack = 1e-9 * (np.abs(q) @ largest) + 1e-9
            live, depth, read = np.arange(m), min(FIRST_DEPTH, n), 0
            seen = np.zeros((n, m))
            out_q, out_v, out_s = [], [], []
            while len(live):
                top, low = ranks < depth, ranks >= n - depth
                p, u = up[live].T, un[live].T
                # only entries between the last depth and this one are added to what was seen
                seen += np.where(top & (ranks >= read), x, 0.0) @ p + np.where(low & (ranks < n - read), x, 0.0) @ u
                if depth == n:
                    most = least = seen.copy()
                else:
                    # what the unseen entries can add: at most the list's value at this depth, at least its last value
                    rest_top, rest_low = (~top).astype(np.float64), (~low).astype(np.float64)
                    most = seen + rest_top @ (p * down[depth - 1][:, None]) + rest_low @ (u * down[n - depth][:, None])
                    least = seen + rest_top @ (p * down[n - 1][:, None]) + rest_low @ (u * down[0][:, None])
                own = ids[:, None] == q_ids[live][None, :]
                most[own], least[own] = -np.inf, -np.inf
                bar = np.partition(least, n - k, axis=0)[n - k] if n > k else np.full(len(live), -np.inf)
                bar = np.maximum(bar, held[live])
                open_ = (most >= bar - 2 * slack[live]) & ~own
                done = (open_.sum(axis=0) <= 4 * k) | (depth == n)
                cand, col = np.nonzero(open_[:, done])
                if len(cand):
                    asked = live[done][col]
                    out_q.append(asked)
                    out_v.append(cand)
                    out_s.append((q[asked].astype(np.int64) * ints[cand]).sum(axis=1))
                live, seen, read, depth = live[~done], seen[:, ~done], depth, min(DEEPER * depth, n)
            if not out_q:
                none = np.empty(0, np.int64)
                return none, none, none
            asked, cand, score = map(np.concatenate, (out_q, out_v, out_s))
            return best_of(q_ids[asked], ids[cand], score, k, ascending=False)

        return tile

    return prepare


def exact_topk(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score long): each query's k highest inner products of floor(scale * x) vectors.

    ``is_query`` is a condition over ``id``, a column or SQL. All rows but the query's own are candidates; ties go to the smaller
    id; all candidates return where there are fewer than k. Rows with a null id, or a vector that is null, empty or
    holds null or non-finite components, take no part; other columns are ignored. Of several
    rows with one id that of the smallest vector counts; equal vectors of different ids are candidates each. Components
    whose products could pass 64 bits are an error. Vectors of another dimension than the query's are not its candidates.
    A table without queries or without candidates gives no rows.
    """
    rows = usable(vectors, id_col, vector_col, zero=True)
    rows = rows.withColumn("x", F.transform("x", lambda v: F.floor(v * scale).cast("double")))
    return block_search(rows, is_query, k, nra_tile(k), "long", ascending=False)
